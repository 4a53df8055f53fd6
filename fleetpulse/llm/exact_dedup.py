"""Exact dedup with a minimal perfect hash over the distinct digests of the history.

Every text becomes one SHA-256 digest, so only digests travel.  Digests of history and of arrivals are counted on the
map side before they meet, so a group of copies is one row a task however large it is.  Each bucket of digests builds a
minimal perfect hash over its history: slot i holds one full digest and the locator (largest id) of its winner.
Arrivals look up their slot and compare all 32 bytes; what is no member forms groups of its own.  Rows get their
group back by shuffle, those of large groups by broadcast of these groups (2000 at most), so no task holds a group.

Edge cases: a null text equals the empty text; null ids never win unless a group has no other id (then ``keep_id`` is
null); rows that repeat id and text are all kept and all count; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import HOT_KEYS, checksum_mod, join_hot, mix64, stage, text_of

#: Digests that share one perfect hash, on average.
BUCKET_ROWS = 4096
GAMMA = 1.5


class PerfectHash:
    """Minimal perfect hash over distinct 32-byte digests, by levels of collision-free bits.

    On each level a key hashes to one of ``GAMMA * n`` bits; keys alone on their bit stay there, the others go on to
    the next level.  The rank of a key's bit over all levels is its slot.
    """

    def __init__(self, words: np.ndarray) -> None:
        self.sizes, marks, rest = [], [], words
        while len(rest):
            m = max(2, int(GAMMA * len(rest)) | 1)
            at = self._place(rest, len(self.sizes), m)
            alone = np.bincount(at, minlength=m) == 1
            self.sizes.append(m)
            marks.append(alone)
            rest = rest[~alone[at]]
        self.starts = np.concatenate(([0], np.cumsum(self.sizes))).astype(np.int64)
        self.marks = np.concatenate(marks) if marks else np.zeros(0, bool)
        self.ranks = np.cumsum(self.marks) - 1

    @staticmethod
    def _place(words: np.ndarray, level: int, m: int) -> np.ndarray:
        seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        return (mix64(words[:, level % 4] ^ mix64(words[:, (level + 1) % 4] + seed)) % np.uint64(m)).astype(np.int64)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level claims it.  A key outside the set may get any slot."""
        found = np.full(len(words), -1, np.int64)
        open_ = np.arange(len(words))
        for level, m in enumerate(self.sizes):
            if not len(open_):
                break
            at = self.starts[level] + self._place(words[open_], level, m)
            hit = self.marks[at]
            found[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit]
        return found


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, digests)), np.uint64).reshape(-1, 4)


def _larger(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Elementwise larger id; NaN-free float loss is avoided by object arithmetic on None."""
    return np.array([y if x is None else x if y is None else max(x, y) for x, y in zip(a, b)], object)


def _ids(s: pd.Series) -> np.ndarray:
    return np.array([None if pd.isna(x) else int(x) for x in s], object)


def _resolve(history: pd.DataFrame, arrivals: pd.DataFrame) -> pd.DataFrame:
    """One bucket: build the hash over its history, look its arrivals up, return one row per distinct digest."""
    slot_of = PerfectHash(_words(history["h_digest"]))
    n = len(history)
    table = np.zeros((n, 4), np.uint64)
    winner, size = np.full(n, None, object), np.zeros(n, np.int64)
    if n:
        own = _words(history["h_digest"])
        at = slot_of.slots(own)
        table[at], winner[at], size[at] = own, _ids(history["h_winner"]), history["h_n"].to_numpy()
    if len(arrivals):
        keys = _words(arrivals["a_digest"])
        at = slot_of.slots(keys)
        member = at >= 0
        member[member] = (table[at[member]] == keys[member]).all(axis=1)  # all 32 bytes
        ids, counts = _ids(arrivals["a_winner"]), arrivals["a_n"].to_numpy()
        winner[at[member]] = _larger(winner[at[member]], ids[member])
        size[at[member]] += counts[member]
        table = np.concatenate((table, keys[~member]))
        winner, size = np.concatenate((winner, ids[~member])), np.concatenate((size, counts[~member]))
    return pd.DataFrame({
        "digest": [r.tobytes() for r in table],
        "keep_id": pd.array(list(winner), dtype="Int64"),
        "group_size": size,
    })


def digest_classes(digests: DataFrame, history: Column, rows: int) -> DataFrame:
    """(digest, keep_id, group_size) for every distinct digest of (doc_id, digest)."""
    buckets = max(1, -(-rows // BUCKET_ROWS))
    # the sides have no column in common: Spark drops columns of a cogroup whose sides share attributes
    def counted(part: DataFrame, prefix: str) -> DataFrame:
        own = part.select(F.col("doc_id").alias(f"{prefix}id"), F.col("digest").alias(f"{prefix}digest"))
        return own.groupBy(f"{prefix}digest").agg(F.max(f"{prefix}id").alias(f"{prefix}winner"), F.count(F.lit(1)).alias(f"{prefix}n"))

    def bucket(prefix: str) -> Column:
        return F.pmod(F.xxhash64(f"{prefix}digest"), F.lit(buckets)).alias(f"{prefix}bucket")

    old, new = counted(digests.filter(history), "h_"), counted(digests.filter(~history), "a_")
    old, new = old.select("*", bucket("h_")).groupBy("h_bucket"), new.select("*", bucket("a_")).groupBy("a_bucket")
    return old.cogroup(new).applyInPandas(_resolve, "digest binary, keep_id bigint, group_size bigint")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: Column | None = None) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``history`` marks (over the column doc_id) the rows already seen; without it the rows with an even checksum play
    that part.  The result doesn't depend on the choice.
    """
    digests = stage(docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.unhex(F.sha2(text_of(text_col), 256)).alias("digest"),
    ), "digests")
    history = checksum_mod("doc_id", 2) == 0 if history is None else F.coalesce(history, F.lit(False))
    rows = digests.count()
    classes = stage(digest_classes(digests, history, rows), "digest_classes")
    return join_hot(digests, classes, ["digest"], "group_size", max(rows, HOT_KEYS)).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )

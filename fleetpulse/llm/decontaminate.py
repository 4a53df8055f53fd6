"""Benchmark decontamination by greedy string tiling.

Texts and test items become lower-case words of letters and digits.  Word 4-grams that a text shares with an item are
the seeds; where seeds could cover enough of the item, tiles are laid: the longest matches of unmarked words, found by
running Karp-Rabin hashes over lengths that shrink to ``LEAST``, are marked again and again without overlap, so a
passage whose parts were moved still covers its item.  Coverage is the share of the item's words under tiles.

Items are broadcast in shards of ``SHARD_WORDS`` words; a larger benchmark takes one scan of the texts for each shard.

Edge cases: null and empty texts match nothing; items without words and null items are left out, items of fewer words
than ``LEAST`` match as a whole; repeated items all report; rows with a null id report a null id; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import mix64, small_batches, string_hash

LEAST, COVERAGE = 4, 0.5
SHARD_WORDS = 2_000_000
BREAK = r"[^\p{L}\p{N}]+"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the words of all texts, and each text's offsets."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    parts = pc.split_pattern_regex(low, BREAK)
    offsets = np.asarray(parts.offsets).astype(np.int64)
    offsets -= offsets[0]
    flat = parts.flatten()
    full = np.asarray(pc.not_equal(flat, ""))
    coded = flat.filter(pa.array(full)).dictionary_encode()
    codes = string_hash(coded.dictionary)[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.uint64)
    return codes, np.concatenate(([0], np.cumsum(full)))[offsets]


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive codes, by a polynomial whose powers wrap."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * _BASE + codes[i:i + n]
        return mix64(out)


def tiles(item: list[int], text: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in text, length), longest first, no word used twice."""
    least = max(1, min(least, len(item)))
    used_a, used_b = [False] * len(item), [False] * len(text)
    out: list[tuple[int, int, int]] = []
    length = max(least, min(len(item), len(text)))
    mask, base = (1 << 61) - 1, 1_000_003
    while length >= least:
        # running hashes of the unmarked stretches of both sides
        def windows(seq: list[int], used: list[bool]) -> Iterator[tuple[int, int]]:
            top, h, run = pow(base, length, mask), 0, 0
            for i, c in enumerate(seq):
                if used[i]:
                    h = run = 0
                    continue
                h = (h * base + c) % mask
                run += 1
                if run > length:
                    h = (h - seq[i - length] * top) % mask
                if run >= length:
                    yield h, i - length + 1

        at: dict[int, list[int]] = {}
        for h, i in windows(item, used_a):
            at.setdefault(h, []).append(i)
        for h, j in windows(text, used_b) if at else ():
            for i in at.get(h, ()):
                if not any(used_a[i:i + length]) and not any(used_b[j:j + length]) and item[i:i + length] == text[j:j + length]:
                    used_a[i:i + length] = [True] * length
                    used_b[j:j + length] = [True] * length
                    out.append((i, j, length))
                    break
        length -= 1
    return out


def _matcher(items: list[tuple[int, np.ndarray]], threshold: float):
    """A function over record batches (doc_id, text) for one shard of items."""
    seeds, owners, places = [], [], []
    for n, (_, codes) in enumerate(items):
        h = rolling(codes, min(LEAST, len(codes)))
        seeds.append(h + np.uint64(min(LEAST, len(codes))))
        owners.append(np.full(len(h), n))
        places.append(np.arange(len(h)))
    seed, owner, place = (np.concatenate(x) for x in (seeds, owners, places))
    order = np.argsort(seed, kind="stable")
    seed, owner, place = seed[order], owner[order], place[order]
    lengths = sorted({min(LEAST, len(c)) for _, c in items})

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            codes, offsets = word_codes(batch.column(1))
            found: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for k in lengths:
                grams = rolling(codes, k) + np.uint64(k)
                hit = np.flatnonzero(np.isin(grams, seed))
                doc = np.searchsorted(offsets, hit, side="right") - 1
                inside = hit + k <= offsets[doc + 1]
                for at, d in zip(hit[inside].tolist(), doc[inside].tolist()):
                    lo, hi = np.searchsorted(seed, grams[at], "left"), np.searchsorted(seed, grams[at], "right")
                    for s in range(lo, hi):
                        if min(LEAST, len(items[owner[s]][1])) == k:
                            found.setdefault((d, int(owner[s])), []).append((at, int(place[s])))
            rows = []
            for (d, n), hits in found.items():
                own = items[n][1]
                k = min(LEAST, len(own))
                could = np.zeros(len(own), bool)
                for p in {p for _, p in hits}:
                    could[p:p + k] = True
                if could.mean() < threshold:
                    continue
                near = sorted({w for at, _ in hits for w in range(at, at + k)})
                text, last = [], None
                for w in near:  # the text's words under seeds; a gap breaks every match
                    if last is not None and w != last + 1:
                        text.append(-1)
                    text.append(int(codes[w]))
                    last = w
                laid = tiles([int(c) for c in own], text)
                cover = sum(t[2] for t in laid) / len(own)
                if cover >= threshold:
                    rows.append((d, items[n][0], cover, len(laid), len(own)))
            rows.sort()
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                *(pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))),
            ], ["doc_id", "item_id", "coverage", "n_tiles", "item_words"])

    return match


SCHEMA = "doc_id bigint, item_id bigint, coverage double, n_tiles bigint, item_words bigint"


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, item_words) for each text that covers ``threshold`` of an item."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tests = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    words = tests.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    shards = max(1, -(-words // SHARD_WORDS))
    out = None
    for k in range(shards):
        part = tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        collected = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda x: (x[0], x[1]))
        codes, offsets = word_codes(pa.array([t for _, t in collected], pa.large_string()))
        items = [(i, codes[a:b]) for (i, _), a, b in zip(collected, offsets[:-1], offsets[1:]) if b > a]
        if items:
            found = rows.mapInArrow(_matcher(items, threshold), SCHEMA)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)

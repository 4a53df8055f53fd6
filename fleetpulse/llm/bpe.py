"""Byte-level BPE encoding and decoding by a segment tree over byte positions.

A piece (one match of the splitting pattern) is a row of live byte spans.  Leaf i of the segment tree holds the rank of
the pair that starts at byte i; an inner node holds the least rank of its ``WIDE`` children, so the way down to the first
child with the root's rank names the leftmost pair of least rank.  A merge joins two live neighbours and updates three leaves, so a piece
of n bytes costs O(n log n) even where it has no break; the tree of a short piece is its leaves and the root.  Pieces repeat, so each Python worker keeps what it has merged in a bounded
cache.

Edge cases: a null or empty text has no tokens and decodes to no bytes; rows are independent, so repeated rows, ties
and other columns don't matter; columns that exist under the result's names are replaced.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Above all ranks.
NO_RANK = (1 << 30) - 1
#: Children of an inner node.
WIDE = 16
CACHE_PIECES = 150_000
CACHE_PIECE_CHARS = 40


class MergedPieces:
    """Packed ids by piece in two generations: when the young one is full it becomes the old one."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            ids = merge_piece(piece.encode(), self.ranks)
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHE_PIECE_CHARS:
            if len(self.young) >= CACHE_PIECES:
                self.old, self.young = self.young.copy(), self.young
                self.young.clear()
            self.young[piece] = got
        return got


#: By path of the rank table; they live as long as the Python worker.
_pieces_of: dict[str, MergedPieces] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    rank = ranks.get
    leaves = [rank(piece[i:i + 2], NO_RANK) for i in range(n - 1)] + [NO_RANK]
    levels = [leaves]
    while len(levels[-1]) > WIDE:
        below = levels[-1]
        levels.append([min(below[k:k + WIDE]) for k in range(0, len(below), WIDE)])
    top, down, inner = levels[-1], levels[-2::-1], list(zip(levels, levels[1:]))
    end = list(range(1, n + 1))  # live span i covers piece[i:end[i]]
    before = list(range(-1, n))

    while (least := min(top)) < NO_RANK:
        i = top.index(least)
        for level in down:
            i = level.index(least, i * WIDE)
        j = end[i]
        k = end[i] = end[j]
        before[k] = i
        h = before[i]
        leaves[j] = NO_RANK
        leaves[i] = rank(piece[i:end[k]], NO_RANK) if k < n else NO_RANK
        if h >= 0:
            leaves[h] = rank(piece[h:k], NO_RANK)
        if inner:
            changed = {i, j, max(h, 0)}
            for below, level in inner:
                changed = {at // WIDE for at in changed}
                for at in changed:
                    level[at] = min(below[at * WIDE:at * WIDE + WIDE])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


def encoder(spark: SparkSession, ranks_path: str, pattern: str):
    """A Pandas UDF text -> struct(n_tokens, ids_le, decoded).  The rank file has a fixed size, so it is broadcast."""
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @F.pandas_udf("n_tokens bigint, ids_le binary, decoded binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import regex

        ranks = shared.value
        bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, r in ranks.items():
            bytes_of[r] = b
        find = regex.compile(pattern).findall
        if ranks_path not in _pieces_of:
            _pieces_of[ranks_path] = MergedPieces(ranks)
        packed = _pieces_of[ranks_path]
        get = packed.young.get
        for texts in batches:
            counts, ids, back = [], [], []
            for text in texts:
                le = b"".join([get(p) or packed(p) for p in find(text or "")])
                own = np.frombuffer(le, "<u4")
                counts.append(len(own))
                ids.append(le)
                back.append(b"".join([bytes_of[i] for i in own.tolist()]))
            yield pd.DataFrame({"n_tokens": counts, "ids_le": ids, "decoded": back})

    return encode


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", decode: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids_le (ids as little-endian unsigned 32-bit integers) and, if asked, decoded bytes."""
    names = ["n_tokens", "ids_le"] + ["decoded"] * decode
    kept = [c for c in docs.columns if c not in names]
    coded: Column = encoder(docs.sparkSession, ranks_path, pattern)(F.col(text_col).cast("string"))
    return docs.select(*kept, coded.alias("_coded")).select(*kept, *[F.col(f"_coded.{n}").alias(n) for n in names])

"""Suffix-array dedup over windows of 200 bytes, by induced sorting.

Repeated passages are found by anchors (see ``repeats``).  The contents of a shard of anchors that may share a window
(equal fingerprints only choose candidates) are joined into one
string, whose suffix array is built by induced sorting: positions are classified as smaller or larger than the next,
leftmost-smaller substrings are sorted by a first induction, named, and sorted recursively where names repeat; a second
induction places all other suffixes.  Induction runs bucket by bucket over arrays, so it costs a few array operations
for each round of a bucket; short rounds go one by one.  Permuted common prefixes with the neighbour in suffix order, most of which follow from the
position before, tell which windows occur twice.

Edge cases: null and empty texts have no bytes; texts under 200 bytes lose nothing; all copies of a repeated passage go,
the first one too; overlapping repeats inside one text are found; repeated rows are repeats of each other; null ids are
kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import mix64
from fleetpulse.llm.repeats import Repeats, Windows, candidates, covered, runs_of

BYTES, GRAM = 200, 32
#: Symbols of larger alphabets are written as two digits, so that induction walks few buckets.
MAX_SIGMA = 1024
#: Up to so many suffixes are induced one by one: array operations cost more for them.
FEW = 96


def _induce(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes in order, given the leftmost-smaller ones (in any order: then their substrings are in order)."""
    size = np.bincount(t, minlength=sigma)
    end = np.cumsum(size)
    head, tail = end - size, end.copy()
    out = np.empty(len(t), np.int32)
    symbol, is_smaller, placed, place = memoryview(t), memoryview(smaller), memoryview(out), {1: memoryview(head), -1: memoryview(tail)}

    def put_few(entries: list[int], kind: bool, step: int) -> None:
        at = place[step]
        for p in entries:
            if p and is_smaller[p - 1] == kind:
                s = symbol[p - 1]
                placed[at[s] if step > 0 else at[s] - 1] = p - 1
                at[s] += step

    def put(entries: np.ndarray, kind: bool, at: np.ndarray, step: int) -> None:
        """The suffixes one symbol longer than ``entries``, of one kind, into their buckets from ``at`` on."""
        if len(entries) <= FEW:
            put_few(entries.tolist(), kind, step)
            return
        p = entries[entries > 0] - 1
        p = p[smaller[p] == kind]
        if not len(p):
            return
        s = t[p]
        by = np.argsort(s, kind="stable")
        s, count = s[by], np.bincount(s, minlength=sigma)
        rank = np.arange(len(s)) - (np.cumsum(count) - count)[s]
        out[at[s] + (rank if step > 0 else -1 - rank)] = p[by]
        at += step * count

    by = np.argsort(t[seeds], kind="stable")
    seeds, ends = seeds[by], np.cumsum(np.bincount(t[seeds], minlength=sigma))
    for c in np.flatnonzero(size).tolist():
        done = int(end[c] - size[c])
        while done < head[c]:
            part, done = out[done:head[c]], int(head[c])
            put(part, False, head, 1)
        put(seeds[ends[c - 1] if c else 0:ends[c]], False, head, 1)
    out[0], tail[0] = len(t) - 1, 0
    for c in np.flatnonzero(size)[::-1].tolist():
        done = int(end[c])
        while done > tail[c]:
            part, done = out[tail[c]:done][::-1], int(tail[c])
            put(part, True, tail, -1)
        put(out[end[c] - size[c]:head[c]][::-1], True, tail, -1)
    return out


def _classify(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than the next one, and the leftmost ones of their runs."""
    n = len(t)
    step = np.sign(t[:-1].astype(np.int32) - t[1:])
    differs = np.append(np.where(step != 0, np.arange(n - 1), n - 1), n - 1)
    differs = np.minimum.accumulate(differs[::-1])[::-1]
    smaller = np.append(step < 0, True)[differs]
    return smaller, (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)


def _same_substrings(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the substrings of ``length`` at a and at b are equal, symbol by symbol."""
    starts = np.cumsum(length) - length
    step = np.arange(length.sum()) - np.repeat(starts, length)
    return np.logical_and.reduceat(t[np.repeat(a, length) + step] == t[np.repeat(b, length) + step], starts) if len(a) else np.zeros(0, bool)


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of ``t``, whose last symbol is the only 0."""
    n = len(t)
    if n < 3:
        return np.arange(n, dtype=np.int32)[::-1]
    if sigma > MAX_SIGMA:  # two digits for each symbol keep the buckets few, if the next level's string is shorter then
        base = int(np.ceil(np.sqrt(sigma)))
        digits = np.zeros(2 * n + 1, np.int32)
        digits[:-1:2], digits[1::2] = t // base + 1, t % base + 1
        if len(_classify(digits)[1]) < 0.9 * n:
            order = suffix_array(digits, base + 1)
            return (order[(order % 2 == 0) & (order < 2 * n)] // 2).astype(np.int32)
    t = t.astype(np.uint16 if sigma < 1 << 16 else np.int32)
    smaller, leftmost = _classify(t)
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    order = _induce(t, smaller, leftmost, sigma)
    order = order[is_leftmost[order]]
    # a leftmost-smaller substring runs to the next one; equal ones get equal names
    length = np.zeros(n, np.int64)
    length[leftmost] = np.append(leftmost[1:], n - 1) + 1 - leftmost
    same = length[order[1:]] == length[order[:-1]]
    same[same] = _same_substrings(t, order[:-1][same], order[1:][same], length[order[1:]][same])
    if not same.any():
        return _induce(t, smaller, order, sigma)
    name = np.zeros(n, np.int32)
    name[order] = np.concatenate(([0], np.cumsum(~same)))
    names = name[leftmost]
    return _induce(t, smaller, leftmost[suffix_array(names, int(names.max()) + 1)], sigma)


def permuted_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each position, the common prefix with the suffix before it in order, up to ``most`` symbols.

    Where the symbols before both suffixes are equal too, the prefix is one shorter than that of the position before;
    only the others are compared, four symbols at a time.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[order[1:]] = order[:-1]
    own = np.arange(n)
    follows = (phi > 0) & (own > 0)
    follows[follows] = t[own[follows] - 1] == t[phi[follows] - 1]
    padded = np.concatenate((t.astype(np.uint64), np.zeros(8, np.uint64)))
    four = padded[:-3] << np.uint64(48) | padded[1:-2] << np.uint64(32) | padded[2:-1] << np.uint64(16) | padded[3:]
    out = np.zeros(n, np.int64)
    left = np.flatnonzero(~follows & (phi >= 0))  # the last symbol is unique, so no two suffixes are equal
    while len(left):
        a, b = left + out[left], phi[left] + out[left]
        equal = four[a] == four[b]
        for k in range(3):
            part = ~equal & (padded[a + k] == padded[b + k])
            if k:
                part &= on
            on = part
            out[left[on]] += 1
        left = left[equal]
        out[left] += 4
    start = np.maximum.accumulate(np.where(follows, 0, own))
    return np.minimum(out[start] - (own - start), most)


def _decide(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard: windows of each class that occur in another class as well."""
    rows = candidates(rows, np.uint8, BYTES)
    if not len(rows):
        return pd.DataFrame({"anchor": [], "snippet": [], "windows": []}, dtype=object)
    contents = [np.frombuffer(c, np.uint8) for c in rows["content"]]
    t = np.concatenate([np.append(c.astype(np.int16) + 2, 1) for c in contents] + [np.zeros(1, np.int16)])
    order = suffix_array(t, 258)
    # windows never hold the marks 0 and 1, so a position whose window meets a mark can't be equal to another's
    both = permuted_prefixes(t, order, BYTES) >= BYTES
    both[order[:-1]] |= both[order[1:]].copy()
    out, at = [], 0
    for anchor, snippet, count, c in zip(rows["anchor"], rows["snippet"], rows["count"], contents):
        windows = np.flatnonzero(both[at:at + count])
        if len(windows):
            out.append((anchor, snippet, windows.tolist()))
        at += len(c) + 1
    return pd.DataFrame(out, columns=["anchor", "snippet", "windows"])


_MIXED = mix64(np.arange(1, 257, dtype=np.uint64))


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = raw_bytes(texts)
    return _MIXED[data], offsets


WINDOWS = Windows(_symbols, BYTES, GRAM)


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, firsts array<int>, ends array<int>"


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        data, offsets = raw_bytes(pa.array(b["text"], pa.large_string(), from_pandas=True))
        out = []
        for i, (d, c) in enumerate(zip(b["doc_id"], b["cuts"])):
            own = data[offsets[i]:offsets[i + 1]]
            gone = covered(len(own), BYTES, *runs_of(d, c))
            edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
            out.append((d, len(own), int(gone.sum()), len(edge) // 2, own[~gone].tobytes(), edge[::2].tolist(), edge[1::2].tolist()))
        made = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "firsts", "ends"])
        made["doc_id"] = pd.array(list(b["doc_id"]), dtype="Int64")
        yield made


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts that may lose bytes, all other texts).

    The first has doc_id, n_bytes, n_removed, n_spans, kept bytes and the removed spans (firsts, ends); the second
    doc_id, n_bytes and digest (SHA-256 of the bytes).
    """
    found = Repeats(docs, WINDOWS, False, id_col, text_col)
    cut, whole = found.finished(found.cuts(raw_bytes, np.uint8, _decide))
    raw = F.coalesce("text", F.lit(""))
    return cut.mapInPandas(_finish, RESULT), whole.select("doc_id", F.octet_length(raw).cast("bigint").alias("n_bytes"), F.sha2(raw, 256).alias("digest"))

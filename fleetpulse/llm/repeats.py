"""Finding repeated windows of a corpus: the part that word-window and byte-window dedup share.

A window is ``length`` consecutive symbols of one text.  Each window has an anchor, the k-gram of least hash in it
(leftmost on ties), so equal windows have equal anchors at equal places.  Neighbouring windows mostly share an anchor:
an occurrence of an anchor stands for a run of windows, its snippet.

1. Only anchors that occur twice in the corpus can lie in repeated windows; all others are dropped by a count.
2. Texts with repeated anchors are kept aside; the others are finished.
3. Equal snippets (same anchor, same content: two 64-bit hashes) are one class, counted on the map side.
4. Where an anchor has several classes, their contents go to a shard of anchors of ``SHARD_BYTES`` on average, which
   decides window by window (the operator's own method).
5. An anchor whose contents alone exceed ``SHARD_BYTES`` can't be gathered in a task.  It is split by its windows: all
   equal windows are one group, counted on the map side, whatever snippets they come from.
6. Decisions return to all occurrences and then to their texts.

Anchors, snippets and windows that hold over one in ``HOT_KEYS`` rows are joined by broadcast, all others by shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import bucketed, discard, join_hot, mix64, small_batches, stage

SHARD_BYTES = 1 << 20
SEGMENT, CHUNK = 1 << 20, 1 << 20
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@dataclass(frozen=True)
class Windows:
    """symbols: texts -> (64-bit symbols of all texts, offsets by text); length of a window, and of an anchor's k-gram."""

    symbols: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    length: int
    gram: int

    def runs(self, codes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Runs of windows with one anchor, by chunks: text, anchor's place, first window, windows, anchor's hash,
        snippet's hash.  Places count from the text's start.  Long texts go in overlapping segments."""
        parts: list[tuple[int, int, int]] = []
        size = 0
        for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            for s in range(a, b - self.length + 1, SEGMENT):
                e = min(b, s + SEGMENT + self.length - 1)
                parts.append((d, s, e))
                size += e - s
                if size >= CHUNK:
                    yield self._chunk(codes, offsets, parts)
                    parts, size = [], 0
        if parts:
            yield self._chunk(codes, offsets, parts)

    def _chunk(self, codes: np.ndarray, offsets: np.ndarray, parts: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
        with np.errstate(over="ignore"):
            t = np.concatenate([codes[s:e] for _, s, e in parts])
            ends = np.cumsum([e - s for _, s, e in parts])
            starts = np.concatenate(([0], ends[:-1]))
            grams = gram_hashes(t, self.gram)
            width = self.length - self.gram + 1
            low = np.uint64((1 << 24) - 1)
            least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), width)
            inside = np.zeros(len(least), bool)
            for s, e in zip(starts, ends):
                inside[s:e - self.length + 1] = True
            first = np.flatnonzero(inside)
            place = (least[first] & low).astype(np.int64)
            part = np.searchsorted(ends, first, side="right")
            new = np.ones(len(first), bool)
            new[1:] = (place[1:] != place[:-1]) | (part[1:] != part[:-1])
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(first)))
            first, place, part = first[at], place[at], part[at]
            text = np.array([d for d, _, _ in parts])[part]
            base = np.array([s for _, s, _ in parts])[part] - starts[part] - offsets[text]
            snippet = range_hash(t, first, first + count - 1 + self.length) + mix64(((place - first) << 20 | count).astype(np.uint64))
            return text, place + base, first + base, count, grams[place].view(np.int64), mix64(snippet).view(np.int64)


def gram_hashes(t: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive symbols, by doubling."""
    n = len(t) - k + 1
    out, done, power, h, size = np.zeros(max(0, n), np.uint64), 0, _B1, t, 1
    while True:
        if k & size:
            out = out * np.uint64(power) + h[done:done + n]
            done += size
        if done == k or n <= 0:
            return mix64(out)
        h = h[:-size] * np.uint64(power) + h[size:]
        size, power = 2 * size, power * power & 0xFFFFFFFFFFFFFFFF


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, size = len(x) - width + 1, 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size:width - size + n])


def range_hash(t: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the symbols of each range, from prefix sums of a wrapping polynomial."""
    power = np.full(len(t) + 1, np.uint64(_B2))
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(t) * power[:-1], dtype=np.uint64)))
    back = np.full(len(t) + 1, np.uint64(pow(_B2, -1, 1 << 64)))
    back[0] = 1
    return (sums[end] - sums[start]) * np.cumprod(back, dtype=np.uint64)[start]


def _anchor_rows(windows: Windows) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rid = np.asarray(batch.column(0))
            for text, place, _, _, anchor, _ in windows.runs(*windows.symbols(batch.column(1))):
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(rid[text]), pa.array(place.astype(np.int32))], ["anchor", "rid", "place"])

    return rows


def _snippet_rows(windows: Windows) -> Callable:
    """Of texts with their repeated anchors (rid, doc_id, text, places): one row for each of those occurrences."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rid, keys, texts, places = (batch.column(i) for i in range(4))
            wanted_at = np.asarray(places.offsets).astype(np.int64)[:len(places) + 1]
            wanted_at -= wanted_at[0]
            wanted = np.asarray(places.flatten()).astype(np.int64)
            owner = np.repeat(np.arange(len(rid)), np.diff(wanted_at))
            known = np.sort(owner << 40 | wanted)
            for text, place, first, count, anchor, snippet in windows.runs(*windows.symbols(texts)):
                own = text << 40 | place
                at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                on = np.flatnonzero(known[at] == own) if len(known) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchor[on]), pa.array(snippet[on]), keys.take(pa.array(text[on])), rid.take(pa.array(text[on])),
                    pa.array(place[on].astype(np.int32)), pa.array(first[on].astype(np.int32)), pa.array(count[on].astype(np.int32)),
                ], ["anchor", "snippet", "doc_id", "rid", "place", "first", "count"])

    return rows


def _contents(windows: Windows, content: Callable) -> Callable:
    """Of texts with the snippets asked of them (rid, text, then lists): the contents."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            codes, offsets = content(pa.array(b["text"], pa.large_string(), from_pandas=True))
            for i, asked in enumerate(b["asked"]):
                own = codes[offsets[i]:offsets[i + 1]]
                key = None if pd.isna(b["doc_id"].iat[i]) else b["doc_id"].iat[i]
                for a in asked:
                    if a["doc_id"] != key:  # another text with this hash
                        continue
                    out.append((a["anchor"], a["snippet"], a["doc_id"], b["rid"].iat[i], a["place"], a["place"] - a["first"], a["count"],
                                own[a["first"]:a["first"] + a["count"] - 1 + windows.length].tobytes()))
            made = pd.DataFrame(out, columns=["anchor", "snippet", "doc_id", "rid", "place", "lead", "count", "content"])
            made["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in made["doc_id"]], dtype="Int64")
            yield made

    return rows


def _window_rows(windows: Windows, dtype: type) -> Callable:
    """Contents to one row for each window: its fingerprints and its number in the snippet."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            contents = [np.frombuffer(c, dtype) for c in b["content"]]
            if not contents:
                continue
            size, count = np.array([len(c) for c in contents]), b["count"].to_numpy()
            of = np.repeat(np.arange(len(b)), count)
            number = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            at = (np.cumsum(size) - size)[of] + number
            with np.errstate(over="ignore"):
                t = mix64(np.concatenate(contents).astype(np.uint64) + np.uint64(1))
                h1, h2 = gram_hashes(t, windows.length)[at], range_hash(t, at, at + windows.length)
            yield pd.DataFrame({c: b[c].to_numpy()[of] for c in ("anchor", "snippet", "rid", "place")} | {
                "doc_id": pd.array(b["doc_id"].astype("Int64"))[of], "h1": h1.view(np.int64), "h2": h2.view(np.int64), "window": number.astype(np.int32)}
            )[["anchor", "snippet", "doc_id", "rid", "place", "h1", "h2", "window"]]

    return rows


def candidates(rows: pd.DataFrame, dtype: type, length: int) -> pd.DataFrame:
    """Classes with a window whose fingerprint occurs twice in the shard; the others have nothing to match.  Equal
    fingerprints decide nothing: the operator's own method does."""
    contents = [np.frombuffer(c, dtype) for c in rows["content"]]
    size, count = np.array([len(c) for c in contents], np.int64), rows["count"].to_numpy()
    at = np.repeat(np.cumsum(size) - size, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        prints = gram_hashes(mix64(np.concatenate([np.zeros(0, dtype), *contents]).astype(np.uint64) + np.uint64(1)), length)[at]
    order = np.argsort(prints)
    same = prints[order][1:] == prints[order][:-1]
    twice = np.zeros(len(prints), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    shared = np.zeros(len(rows), bool)
    shared[np.repeat(np.arange(len(rows)), count)[twice]] = True
    return rows[shared]


class Repeats:
    """The steps above for one table; ``earlier`` says whether only windows with an earlier equal one count.

    A text's key is its id with ``rid``, a hash of id and text that doesn't depend on how the table is dealt.  Texts move
    once, into a table bucketed by ``rid``; what is found about them moves to them afterwards.
    """

    def __init__(self, docs: DataFrame, windows: Windows, earlier: bool, id_col: str, text_col: str) -> None:
        self.windows, self.earlier = windows, earlier
        rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.docs = bucketed(rows.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text"), "texts", "rid")

    def with_anchors(self) -> DataFrame:
        """Texts that have repeated anchors, with their places."""
        self.found = stage(self.docs.select("rid", "text").mapInArrow(_anchor_rows(self.windows), "anchor bigint, rid bigint, place int"), "anchors", "zstd")
        twice = stage(self.found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "twice", "zstd")
        places = join_hot(self.found, twice, ["anchor"], "n", self.found.count()).groupBy("rid").agg(F.collect_set("place").alias("places"))
        return self.docs.join(places, "rid").select("rid", "doc_id", "text", "places")

    def cuts(self, content: Callable, dtype: type, decide: Callable) -> DataFrame:
        """(rid, cuts): by text, runs of windows to remove: doc_id, first, count, windows (null: the whole run).

        ``decide`` gets one shard's classes (anchor, snippet, doc_id, rid, place, count, content) and returns the
        numbers of their repeated windows.
        """
        occurrences = stage(self.with_anchors().mapInArrow(
            _snippet_rows(self.windows), "anchor bigint, snippet bigint, doc_id bigint, rid bigint, place int, first int, count int"), "occurrences", "zstd")
        discard(self.found)
        first = F.min(F.struct("doc_id", "rid", "place", "first", "count")).alias("f")
        classes = occurrences.groupBy("anchor", "snippet").agg(F.count(F.lit(1)).alias("n"), first)
        classes = stage(classes.select("anchor", "snippet", "n", "f.*"), "classes", "zstd")
        kinds = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), (F.sum(F.col("count") + self.windows.length - 1) * np.dtype(dtype).itemsize).alias("size")).filter("kinds > 1")
        kinds = stage(kinds, "kinds")
        fits = F.col("size") <= SHARD_BYTES
        shards = max(1, -(-(kinds.filter(fits).agg(F.sum("size")).first()[0] or 0) // SHARD_BYTES))
        n_classes, n_occurrences = classes.count(), occurrences.count()

        def contents(of: DataFrame) -> DataFrame:
            wanted = join_hot(classes, of.select("anchor", "kinds"), ["anchor"], "kinds", n_classes)
            asked = wanted.groupBy("rid").agg(F.collect_list(F.struct("anchor", "snippet", "doc_id", "place", "first", "count")).alias("asked"))
            return self.docs.join(asked, "rid").select("rid", "doc_id", "text", "asked").mapInPandas(
                _contents(self.windows, content), "anchor bigint, snippet bigint, doc_id bigint, rid bigint, place int, lead int, count int, content binary")

        def once(rows: pd.DataFrame) -> pd.DataFrame:
            return decide(rows.drop_duplicates(["anchor", "snippet"]))  # repeated rows of the table gave a content twice

        usual = contents(kinds.filter(fits)).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
        verdicts = stage(usual.groupBy("shard").applyInPandas(once, "anchor bigint, snippet bigint, windows array<int>"), "decided", "zstd")
        if not kinds.filter(~fits).isEmpty():
            verdicts = verdicts.unionByName(self._by_window(contents(kinds.filter(~fits)).dropDuplicates(["anchor", "snippet"]), dtype))

        fate = classes.select("anchor", "snippet", "n", F.col("doc_id").alias("f_id"), F.col("rid").alias("f_rid"), F.col("place").alias("f_place"))
        fate = fate.join(verdicts.filter(F.size("windows") > 0), ["anchor", "snippet"], "left").filter((F.col("n") > 1) | F.col("windows").isNotNull())
        fate = stage(fate, "fate", "zstd")
        is_first = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("rid") == F.col("f_rid")) & (F.col("place") == F.col("f_place"))
        whole = (F.col("n") > 1) & (~is_first if self.earlier else F.lit(True))
        out = join_hot(occurrences, fate, ["anchor", "snippet"], "n", n_occurrences)
        out = out.filter(whole | F.col("windows").isNotNull()).select("rid", F.struct("doc_id", "first", "count", F.when(~whole, F.col("windows")).alias("windows")).alias("c"))
        out = stage(out.groupBy("rid").agg(F.collect_list("c").alias("cuts")), "cuts", "zstd")
        discard(occurrences, classes, kinds, fate)
        return out

    def _by_window(self, rows: DataFrame, dtype: type) -> DataFrame:
        """Repeated windows of the classes of anchors too large for a task: a group is all equal windows of an anchor."""
        each = stage(rows.mapInPandas(_window_rows(self.windows, dtype), "anchor bigint, snippet bigint, doc_id bigint, rid bigint, place int, h1 bigint, h2 bigint, window int"), "windows", "zstd")
        groups = each.groupBy("anchor", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "rid", "place")).alias("f"))
        repeated = join_hot(each, stage(groups.filter("n > 1"), "groups", "zstd"), ["anchor", "h1", "h2"], "n", each.count())
        if self.earlier:
            repeated = repeated.filter((F.col("rid") != F.col("f.rid")) | (F.col("place") != F.col("f.place")))
        return repeated.groupBy("anchor", "snippet").agg(F.collect_list("window").alias("windows"))

    def finished(self, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(doc_id, text, cuts) of texts with cuts, (doc_id, text) of all others."""
        return self.docs.join(cuts, "rid").select("doc_id", "text", "cuts"), self.docs.join(cuts.select("rid"), "rid", "left_anti").select("doc_id", "text")


def runs_of(doc_id: object, cuts: list) -> tuple[list, list, list]:
    """A text's own runs: first windows, numbers of windows, chosen windows."""
    key = None if pd.isna(doc_id) else int(doc_id)
    own = [c for c in cuts if c["doc_id"] == key]
    return [c["first"] for c in own], [c["count"] for c in own], [c["windows"] for c in own]


def covered(size: int, length: int, firsts: np.ndarray, counts: np.ndarray, windows: list) -> np.ndarray:
    """Which symbols of a text lie in a removed window."""
    edge = np.zeros(size + 1, np.int64)
    for f, n, w in zip(firsts, counts, windows):
        if w is None:
            edge[f] += 1
            edge[f + n - 1 + length] -= 1
        else:
            w = np.asarray(w, np.int64)
            np.add.at(edge, f + w, 1)
            np.add.at(edge, f + w + length, -1)
    return np.cumsum(edge[:-1]) > 0

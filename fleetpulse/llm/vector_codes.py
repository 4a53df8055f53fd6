"""Vector code compression: product codes whose nearest entries are found by Orchard's search.

Vectors become integers, floor(SCALE * x), and are cut into PARTS parts.  Each part has a codebook of up to ENTRIES
entries, refined by rounds of assigning and averaging.  The nearest entry of a part is found without comparing it with
all entries: every entry keeps the list of all others by distance; a search starts at some entry, walks that entry's
list, jumps to the list of any entry that is nearer (or as near and of a lower index), marks what it has measured and
stops once the list is beyond twice the current distance, where the triangle inequality rules the rest out.  Searches
of one batch run in step, part by part and vector by vector at once; a search starts at the entry that is nearest in
its first component.

Each round is one pass over the vectors: tasks add up their parts for each entry, so only PARTS x ENTRIES sums a task
are shuffled, and the codebooks, bounded by the same, are the only thing the driver gets.

Defined results: rows whose vector is null or holds null or non-finite components are dropped, and so are vectors that
can't be cut like the others (another length than that of the least kept id's vector, or one PARTS doesn't divide).
Of equal ids the least vectors come first; null ids come last.  Components beyond LIMIT after scaling count as LIMIT,
so that no sum overflows.  Ties go to the lower index; entries without parts stay; fewer than ENTRIES vectors give as
many entries; repeated rows count each time; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import HOT_KEYS, join_hot, small_batches, stage

PARTS, ENTRIES, ROUNDS, SCALE, LIMIT = 16, 64, 2, 256, 1 << 26


class Codebook:
    """Entries of all parts (PARTS x entries x width) with their distance-sorted neighbour lists."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        apart = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(3)
        self.near = np.argsort(apart, axis=2, kind="stable").astype(np.int64)  # an entry's list begins with itself or its equals
        self.apart = np.take_along_axis(apart, self.near, 2)
        by = np.argsort(entries[:, :, 0], axis=1, kind="stable")
        self.by, self.firsts = by, np.take_along_axis(entries[:, :, 0], by, 1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of every part of the vectors (rows x PARTS x width)."""
        n, parts, width = vectors.shape
        size = self.entries.shape[1]
        start = np.empty((n, parts), np.int64)
        for p in range(parts):
            start[:, p] = self.by[p][np.minimum(np.searchsorted(self.firsts[p], vectors[:, p, 0]), size - 1)]
        flat = np.ascontiguousarray(vectors).reshape(-1, width)
        part = np.tile(np.arange(parts), n)
        entries, near, apart = self.entries.reshape(-1, width), self.near.reshape(-1, size), self.apart.reshape(-1, size)
        index, best = start.ravel(), None
        best = ((flat - entries[part * size + index]) ** 2).sum(1)
        # one search for each (vector, part): where it stands, what it has marked, how far down its list it is
        live = np.arange(len(flat))
        own, base, now, dist = flat, part * size, index.copy(), best.copy()
        marked, down = np.left_shift(np.uint64(1), now.astype(np.uint64)), np.zeros(len(flat), np.int64)
        while len(live):
            row = base + now
            stop = (down >= size)
            at = np.minimum(down, size - 1)
            stop |= apart[row, at] > 4 * dist
            if stop.any():
                index[live[stop]], best[live[stop]] = now[stop], dist[stop]
                go = ~stop
                live, own, base, now, dist, marked, down, row, at = (x[go] for x in (live, own, base, now, dist, marked, down, row, at))
                if not len(live):
                    break
            to = near[row, at]
            bit = np.left_shift(np.uint64(1), to.astype(np.uint64))
            new = np.flatnonzero((marked & bit) == 0)
            marked |= bit
            down += 1
            if len(new):
                there = to[new]
                found = ((own[new] - entries[base[new] + there]) ** 2).sum(1)
                better = (found < dist[new]) | ((found == dist[new]) & (there < now[new]))
                jump = new[better]
                now[jump], dist[jump], down[jump] = there[better], found[better], 0
        return index.reshape(n, parts), best.reshape(n, parts)

    def averaged(self, sums: dict[tuple[int, int], tuple[list[int], int]]) -> Codebook:
        entries = self.entries.copy()
        for (part, entry), (total, count) in sums.items():
            entries[part, entry] = [t // count for t in total]
        return Codebook(entries)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def kept_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows whose vectors hold finite components only."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    one = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    fits = (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0)
    scaled = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x * SCALE, F.lit(-1e15)), F.lit(1e15))), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    return one.filter(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & fits).select("vec_id", "label", scaled.alias("vector"))


def _parts(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(-1, PARTS, width)


def _summed(book: Codebook, width: int):
    """Sums of the parts of each entry, over a whole task: PARTS x ENTRIES rows at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = book.entries.shape[1]
        sums, counts = np.zeros((PARTS * size, width), np.int64), np.zeros(PARTS * size, np.int64)
        for batch in small_batches(batches, 8000):
            vectors = _parts(batch.column(0), width)
            index, _ = book.nearest(vectors)
            slot = (index + np.arange(PARTS) * size).ravel()
            order = np.argsort(slot, kind="stable")
            kinds, starts, n = np.unique(slot[order], return_index=True, return_counts=True)
            sums[kinds] += np.add.reduceat(vectors.reshape(-1, width)[order], starts, axis=0)
            counts[kinds] += n
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used // size), pa.array(used % size), pa.array(sums[used].tolist(), pa.list_(pa.int64())), pa.array(counts[used])], names=["part", "entry", "sums", "n"])
    return run


def fit(vectors: DataFrame, width: int) -> Codebook:
    """The codebooks after all rounds, from the first ENTRIES vectors by id."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    book = Codebook(np.array([r["vector"] for r in first], np.int64).reshape(len(first), PARTS, width).transpose(1, 0, 2).copy())
    for _ in range(ROUNDS):
        partial = vectors.select("vector").mapInArrow(_summed(book, width), "part bigint, entry bigint, sums array<bigint>, n bigint")
        total = partial.groupBy("part", "entry").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)], F.sum("n").alias("n")).collect()
        book = book.averaged({(r["part"], r["entry"]): ([r[f"s{i}"] for i in range(width)], r["n"]) for r in total})
    return book


def _coded(book: Codebook, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 8000):
            index, error = book.nearest(_parts(batch.column(batch.schema.get_field_index("vector")), width))
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("vec_id")), batch.column(batch.schema.get_field_index("label")),
                pa.array([row.tobytes().hex() for row in index.astype(np.uint8)], pa.string()), pa.array(error.sum(1))], names=["vec_id", "label", "code", "error"])
    return run


def encode(rows: DataFrame) -> tuple[DataFrame, Codebook | None]:
    """((vec_id, label, code, error) of every kept vector, codebooks); no codebooks where nothing is kept."""
    vectors = kept_vectors(rows)
    least = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).select(F.size("vector").alias("n")).collect()
    if not least:
        return vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), None
    length = least[0]["n"]
    vectors, width = vectors.filter(F.size("vector") == length), length // PARTS
    book = fit(vectors, width)
    return vectors.select("vec_id", "label", "vector").mapInArrow(_coded(book, width), "vec_id bigint, label string, code string, error bigint"), book


def decode(codes: DataFrame, book: Codebook) -> DataFrame:
    """(vec_id, vector): the integers that each code stands for."""
    entries, length = book.entries, book.entries.shape[0] * book.entries.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), np.uint8).reshape(-1, PARTS)
            flat = entries[np.arange(PARTS), index].reshape(len(index), length)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat.tolist(), pa.list_(pa.int64()))], names=["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id bigint, vector array<bigint>")


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error, the error summed over equal labels (nulls are equal to each other).

    The codes are staged, small as they are, so that searches run once; sums are taken on the map side, and labels that
    hold many rows are joined by broadcast.
    """
    keyed = stage(codes.select("vec_id", "code", "error", F.coalesce("label", F.lit("")).alias("_label"), F.col("label").isNull().alias("_none")), "codes")
    sums = keyed.groupBy("_label", "_none").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    return join_hot(keyed, sums, ["_label", "_none"], "_n", max(keyed.count(), HOT_KEYS)).select(
        "vec_id", F.when(~F.col("_none"), F.col("_label")).alias("label"), "code", "error", "label_error")

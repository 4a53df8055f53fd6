"""Helpers that all training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions.staging import remember_table, run_path, staging_root

#: White space of the contracts: space, tab, LF, VT, FF, CR.
SPACE_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of the current run in the one all executors share (``spark.checkpoint.dir``)."""
    return run_path(spark, staging_root(spark))


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go as soon as each write ends, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def stage(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with dropping_shuffles(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in staged:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """Write ``df`` once as a table bucketed by ``key``; later joins on the key don't move its rows again."""
    spark = df.sparkSession
    name, n = f"{label}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    remember_table(spark, name)
    with dropping_shuffles(spark):
        df.repartition(n, key).write.format("parquet").option("compression", "zstd").bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


#: Keys that hold more than one in so many rows are joined by broadcast; there can't be more such keys.
HOT_KEYS = 2000


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join with ``table``, which has each key once and in ``n`` how many of the ``total`` rows have it.

    Rows of hot keys stay where they are: a key is hot with over ``total / HOT_KEYS`` rows, so at most HOT_KEYS rows of
    the table are broadcast.  All other rows are shuffled by key.
    """
    hot = F.broadcast(table.filter(F.col(n) > total / HOT_KEYS))
    cold = table.filter(F.col(n) <= total / HOT_KEYS)
    return rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(cold, keys))


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def checksum_mod(col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % F.lit(n)


# ---- Arrow / numpy helpers that run inside tasks ------------------------------------------------------------

def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and xor-shift, wrapping."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows: bounds what a task holds beside Spark's own batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def string_hash(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit xxhash of every (distinct) string."""
    import xxhash

    one = xxhash.xxh64_intdigest
    return np.fromiter((one(w, seed) for w in words.to_pylist()), np.uint64, len(words))


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of every text, dictionary-encoded and flattened, with the offsets of each text's words.

    ``lower`` lowers A-Z in the dictionary, which may then hold a word twice.  (Arrow's lower-casing misreads the cast of
    a slice, so whole texts are never lowered here.)
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.split_pattern_regex(texts, SPACE_RE)
    offsets = np.asarray(parts.offsets).astype(np.int64)
    flat = parts.flatten()
    offsets = offsets - offsets[0]
    filled = np.asarray(pc.not_equal(flat, ""))
    before = np.concatenate(([0], np.cumsum(filled)))
    words = flat.filter(pa.array(filled)).dictionary_encode()
    if lower:
        words = pa.DictionaryArray.from_arrays(words.indices, pc.ascii_lower(words.dictionary))
    return words, before[offsets]


def hashed_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(64-bit hash of each word occurrence, offsets by text, dictionary-encoded words)."""
    words, offsets = split_words(texts, lower)
    per_word = string_hash(words.dictionary)
    codes = np.asarray(words.indices)
    return (per_word[codes] if len(codes) else np.zeros(0, np.uint64)), offsets, words

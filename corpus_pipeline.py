"""The corpus pipeline: toxic texts, exact copies, near copies and leaked benchmark passages go; the rest is encoded.

Each stage takes (spark, docs, sf_dir); run() writes its result as Parquet in the shared folder and rereads it as the
next stage's documents.  All stages but the last return the columns of ``docs``.  A row with a null id passes the
filters that report by id; repeated rows stay repeated except where a stage removes copies.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm.bpe import bpe_encode
from fleetpulse.llm.common import checksum_mod, stage, table
from fleetpulse.llm.decontaminate import contaminated
from fleetpulse.llm.exact_dedup import exact_dedup
from fleetpulse.llm.ngram_join import ngram_join
from fleetpulse.llm.toxicity import scorer, train


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, table(spark, sf_dir, "labels"), checksum_mod("_id", 5) != 0)
    score = _fresh(docs, "_toxicity")
    return docs.withColumn(score, scorer(docs, model)(F.col("text").cast("string"))).filter(F.col(score) < 0.5).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays; another text under a dropped copy's id stays as well."""
    who, what = _fresh(docs, "_gone"), _fresh(docs, "_digest")
    gone = exact_dedup(docs).filter(~F.col("kept")).select(F.col("doc_id").alias(who), F.col("text_sha256").alias(what))
    same = (docs["doc_id"].cast("bigint") == F.col(who)) & (F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256) == F.col(what))
    return docs.join(gone, same, "left_anti").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the least id stays; so does an id with another text that is no copy."""
    who = _fresh(docs, "_gone")
    gone = ngram_join(docs).groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("class_id")).alias("gone")).filter("gone").select(F.col("doc_id").alias(who))
    return docs.join(gone, docs["doc_id"].cast("bigint") == F.col(who), "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """An id with a leaked passage goes with all of its texts: leaks are reported by id."""
    leaks = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe_encode(docs, ranks, public_tokenizers.PATTERN)
    intact = F.col("decoded") == F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return coded.withColumn("round_trip", intact).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: The trained classifier, the min-hashed join, the tiling and the merges have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

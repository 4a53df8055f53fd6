"""The registered query of each operator, with its production parameters and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm import oracles
from fleetpulse.llm.bpe import bpe_encode
from fleetpulse.llm.common import checksum_mod, table
from fleetpulse.llm.conversation_repair import damaged, repair_conversations
from fleetpulse.llm.decontaminate import contaminated
from fleetpulse.llm.exact_dedup import exact_dedup
from fleetpulse.llm.ngram_join import ngram_join
from fleetpulse.llm.pii import KINDS, find_pii, span_text
from fleetpulse.llm.quality_outliers import quality_verdicts
from fleetpulse.llm.substring_dedup import substring_dedup
from fleetpulse.llm.suffix_array import suffix_array_dedup
from fleetpulse.llm.suffix_tree_lm import suffix_tree_scores
from fleetpulse.llm.toxicity import toxic_scores, train
from fleetpulse.llm.url_filter import filter_urls
from fleetpulse.llm.vector_codes import encode, label_errors

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


#: (verdict, host, path) of the url rules.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(table(spark, sf_dir, "documents"), checksum_mod("doc_id", 7) == 2)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_encode(docs, RANKS, public_tokenizers.PATTERN).select(
        "doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, whole = substring_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")).unionByName(
        whole.select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("digest").alias("kept_sha256")))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), checksum_mod("_id", 5) != 0)
    return toxic_scores(docs, model).select(
        "doc_id", (checksum_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, whole = suffix_array_dedup(table(spark, sf_dir, "documents"))
    zero = F.lit(0).cast("bigint")
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).unionByName(
        whole.select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("digest").alias("kept_sha256")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("bigint").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] < 4)
    return found.select("doc_id", *[kind(k) for k in KINDS[:4]], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), kind(KINDS[4]))


def op11_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, book = encode(table(spark, sf_dir, "embeddings"))
    return label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(book.sha256() if book else "").alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_suffix_tree_lm, op2_ngram_jaccard_join, op3_byte_bpe, op4_exact_dedup, op5_url_filter,
        op6_substring_dedup, op7_benchmark_decontamination, op8_toxicity, op9_suffix_array_dedup, op10_pii, op11_quality_outliers, op12_conversation_repair, op13_vector_codes)
}

ORACLES: dict[str, str] = {
    "op4_exact_dedup": oracles.EXACT_DEDUP,
    "op12_conversation_repair": oracles.CONVERSATION_REPAIR,
    "op13_vector_codes": oracles.VECTOR_CODES,
}

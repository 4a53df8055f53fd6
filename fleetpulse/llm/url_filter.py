"""URL filters: host word segmentation by unigram Viterbi, then multinomial naive Bayes over host and path tokens.

Rules decide the urls they fit (a rule's host and its subdomains, path by prefix, longest rule first).  Those decisions
are the training labels of the naive Bayes classifier, which decides all other urls.  Host labels are split into words
by the most probable sequence under unigram counts of the words of all pages; path tokens are runs of letters, and runs
of digits as one token.

Edge cases: a null url, or one without ``://``, has an empty host and path and no tokens, and gets the class of the
larger prior; ties and an empty class mean allow; null and repeated page ids are judged like any other row; a null html
adds no words; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import join_hot, stage

#: Words of at least this share of all words are in the unigram model, hence at most 2 ** 17 of them.
MIN_WORD = 2.0 ** -17
MAX_WORD = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = "(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, parts, 1), UPPER, LOWER), F.regexp_extract(text, parts, 2)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule of (verdict, host, path) and its verdict, null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def word_counts(texts: DataFrame, col: str) -> DataFrame:
    """Counts of the letter runs of a column, tags of markup left out."""
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(col).cast("string"), F.lit(""))), "<[^>]*+>", " ")
    words = texts.select(F.explode(F.split(plain, "[^a-z]+")).alias("word"))
    return words.filter((F.length("word") > 0) & (F.length("word") <= MAX_WORD)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def viterbi(label: str, log_p: dict[str, float], unknown: float) -> list[str]:
    """The most probable split of a label; an unknown word costs ``unknown`` and as much again for each character."""
    best, cut = [0.0] + [-math.inf] * len(label), [0] * (len(label) + 1)
    for end in range(1, len(label) + 1):
        for start in range(max(0, end - MAX_WORD), end):
            word = label[start:end]
            p = best[start] + log_p.get(word, unknown * (1 + len(word)))
            if p > best[end]:
                best[end], cut[end] = p, start
    words, end = [], len(label)
    while end:
        words.append(label[cut[end]:end])
        end = cut[end]
    return words[::-1]


def tokenizer(words: DataFrame):
    """A Pandas UDF (host, path) -> tokens, with the bounded unigram model broadcast."""
    spark = words.sparkSession
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] or 1
    rows = words.filter(F.col("n") >= total * MIN_WORD).collect()  # at most 1 / MIN_WORD rows
    shared = spark.sparkContext.broadcast(({r["word"]: math.log(r["n"] / total) for r in rows}, -math.log(total + 1)))

    @F.pandas_udf("array<string>")
    def tokens(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        log_p, unknown = shared.value
        seen: dict[str, list[str]] = {}

        def split(label: str) -> list[str]:
            got = seen.get(label)
            if got is None:
                got = [f"h:{w}" for part in re.split("([0-9]+)", label) if part for w in (["#"] if part.isdigit() else viterbi(part, log_p, unknown))]
                if len(seen) > 100_000:
                    seen.clear()
                seen[label] = got
            return got

        for hosts, paths in batches:
            out = []
            for host, path in zip(hosts, paths):
                own = [t for label in re.split(r"[^\w]+|_", host) if label for t in split(label)]
                own += ["p:#" if t.isdigit() else f"p:{t.lower()}" for t in re.findall(r"[0-9]+|[^\W\d_]+", path)]
                out.append(own)
            yield pd.Series(out)

    return tokens


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and log_odds of block over allow by the classifier."""
    host, path = host_and_path(F.col("url"))
    tokens = tokenizer(stage(word_counts(pages, "html"), "word_counts"))
    parts = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = stage(parts.select("row", "page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"),
                                tokens("host", "path").alias("tokens")), "urls")

    block, allow = F.col("by_rule") == "block", F.col("by_rule") == "allow"
    docs = judged.agg(F.count_if(block), F.count_if(allow)).first()
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    by_token = judged.select("by_rule", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), count(block).alias("n_block"), count(allow).alias("n_allow"))
    by_token = stage(by_token, "tokens")
    sums = by_token.agg(F.coalesce(F.sum("n_block"), F.lit(0)), F.coalesce(F.sum("n_allow"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if docs[0] and docs[1]:
        prior = math.log(docs[0] / docs[1])
        weight = (F.log((F.col("n_block") + 1) / F.lit(float(sums[0] + sums[2]))) - F.log((F.col("n_allow") + 1) / F.lit(float(sums[1] + sums[2]))))
    else:
        prior, weight = -1.0, F.lit(0.0)
    weights = by_token.select("token", "n", weight.alias("w"))
    odds = (join_hot(judged.select("row", F.explode("tokens").alias("token")), weights, ["token"], "n", sums[3]).groupBy("row")
            .agg(F.sum(F.round("w", 9)).alias("odds")))
    log_odds = F.round(F.coalesce("odds", F.lit(0.0)) + F.lit(prior), 6)
    return judged.join(odds, "row", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(log_odds > 0, "block").otherwise("allow")).alias("verdict"), log_odds.alias("log_odds"))

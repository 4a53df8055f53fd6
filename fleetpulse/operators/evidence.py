"""Leak suspects, the class graph and data quality: the L, U05 and Q families; code problems are in ``problems``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions import text

# ---- L: leaks -----------------------------------------------------------------------------------------------


def suspects(retained: DataFrame) -> DataFrame:
    """Retained objects by class, holder (else the owner, else the class) and place."""
    holder = text.known(F.col("holder"), F.col("owner"), F.col("class"))
    return retained.withColumn("holder", holder).groupBy("run_set", "class", "holder", "screen", "flow", "step").agg(
        F.sum("n").cast("bigint").alias("count"), F.max("age_ms").alias("max_age_ms"),
        F.sum(F.when(F.col("evidence") == "confirmed", F.col("n")).otherwise(0)).cast("bigint").alias("confirmed"))


def retained_kb(max_pss_kb: Column) -> Column:
    """Base size of the kind times count and age factor, at most a third of PSS but the base at least."""
    base = text.base_size_kb(F.col("kind")).cast("bigint")
    age = F.when(F.col("max_age_ms") >= 60000, 3).when(F.col("max_age_ms") >= 30000, 2).otherwise(1)
    full = base * F.greatest("count", F.lit(1)) * age
    return F.when(max_pss_kb > 0, F.least(full, F.greatest(F.floor(max_pss_kb / 3).cast("bigint"), base))).otherwise(full)


#: Weights of the kinds of evidence.
EVIDENCE_WEIGHT = {"confirmed_path": 1.0, "after_explicit_gc": 0.75, "unconfirmed_heap": 0.6, "time_only": 0.45}
#: Parts of the names of classes whose retention is a high risk.
RISKY = ["activity", "fragment", "context", "viewmodel", "service", "dialog", "viewholder", "adapter", "binding", "view"]
SUSPECT = ["run_set", "class", "holder", "screen", "flow", "step"]


def leak_scores(found: DataFrame, memory: DataFrame, heap: DataFrame | None = None) -> DataFrame:
    """Size, score, evidence and severity of each suspect; weak evidence never makes a high severity.

    memory has run_set, max_pss_kb and low_memory (samples).  heap, where there is a dump, has a suspect's best evidence:
    its key, heap_kb, heap_holder, heap_path (whether a path from a root was found) and chain, the fingerprint of its
    reference chain, which stays with the suspect.
    """
    s = found.join(F.broadcast(memory), "run_set", "left").withColumn("kind", text.object_kind(F.col("class")))
    if heap is None:
        s = s.withColumns({"heap_kb": F.lit(None).cast("bigint"), "heap_holder": F.lit(None).cast("string"), "heap_path": F.lit(None).cast("boolean"), "chain": F.lit(None).cast("string")})
    else:
        s = s.join(heap.select(*SUSPECT, "heap_kb", "heap_holder", "heap_path", "chain"), SUSPECT, "left")
    pss, owner = F.coalesce("max_pss_kb", F.lit(0)), text.known(F.col("heap_holder"), F.col("holder"))
    estimate, path = retained_kb(pss), F.coalesce("heap_path", F.lit(False))
    evidence = (F.when(path, "confirmed_path").when(F.col("confirmed") < F.col("count"), "time_only").when(F.col("confirmed") > 0, "after_explicit_gc")
                .when(F.col("heap_kb").isNotNull(), "unconfirmed_heap").otherwise("time_only"))
    s = s.withColumns({"estimate": estimate, "evidence": evidence})
    weight = F.lit(1.0)
    for name, w in EVIDENCE_WEIGHT.items():
        weight = F.when(F.col("evidence") == name, F.lit(w)).otherwise(weight)
    yes = lambda c, n: F.when(c, F.lit(float(n))).otherwise(0.0)
    low, age = F.lower("class"), F.col("max_age_ms")
    risky = F.lit(False)
    for part in RISKY:
        risky = risky | low.contains(part)
    raw = (F.col("count") * 2.0 + age / 10000.0 + F.when(age >= 60000, 8.0).when(age >= 30000, 4.0).otherwise(0.0) + yes(text.is_app(F.col("class")) | text.is_app(owner), 4) + yes(text.is_system(F.col("class")), 3)
           + yes(risky, 5) + yes(F.coalesce("low_memory", F.lit(0)) > 0, 2) + yes(pss >= 512 * 1024, 2) + F.when(F.col("estimate") >= 16384, 5.0).when(F.col("estimate") >= 4096, 2.0).otherwise(0.0))
    s = s.withColumn("retained_kb", F.when(F.col("heap_kb") > 0, F.col("heap_kb")).otherwise(F.col("estimate")))
    bonus = F.when(path, 6.0 + F.when(F.col("retained_kb") >= 16384, 4.0).when(F.col("retained_kb") >= 4096, 2.0).otherwise(0.0)).otherwise(0.0)
    s = s.withColumn("raw_score", raw * weight + bonus)
    high = (F.col("raw_score") >= 16) | (age >= 60000) | (F.col("count") >= 10) | (F.col("retained_kb") >= 16384)
    medium = (F.col("raw_score") >= 7) | (age >= 15000) | (F.col("count") >= 2) | (F.col("retained_kb") >= 4096)
    weak = F.col("evidence").isin("time_only", "unconfirmed_heap")
    severity = F.when(high & ~weak, "high").when(high | medium, "medium").otherwise("ok")
    return s.withColumns({"score": F.round("raw_score", 1), "severity": severity}).drop("max_pss_kb", "low_memory", "estimate", "raw_score", "heap_kb", "heap_holder", "heap_path")


def leak_fingerprint() -> Column:
    """The reference chain where a dump has one, else place and parties in lower case."""
    names = F.lower(F.concat_ws("|", *[F.trim(c) for c in SUSPECT[1:]]))
    return F.when(F.col("chain") != "", F.concat(F.lit("chain|"), "chain")).otherwise(names)


def leak_compare(scored: DataFrame) -> DataFrame:
    """New, resolved, worse, better or same by fingerprint, with the severity of the change.

    Of several suspects of a run set with one fingerprint, a chain seen in several places, the one with the largest score
    stands for it; ties go by count, age, size and names.
    """
    rows = scored.withColumn("fingerprint", leak_fingerprint())
    values = ["score", "count", "max_age_ms", "retained_kb"]
    side = lambda s: F.max_by(F.struct(*values, "evidence", "severity", "class", "holder", "chain"), F.when(F.col("run_set") == s, F.struct(*values, *SUSPECT[1:])))
    j = rows.groupBy("fingerprint").agg(side("baseline").alias("b"), side("candidate").alias("c"))
    names = [*values, "evidence", "holder", "chain"]
    j = j.select("fingerprint", F.coalesce("c.class", "b.class").alias("class"), *[F.col(f"{p}.{v}").alias(f"{p}_{v}") for p in "bc" for v in names], F.col("b.class").alias("b_class"), F.col("c.class").alias("c_class"), F.col("c.severity").alias("c_severity"))
    d = {v: F.col(f"c_{v}") - F.col(f"b_{v}") for v in values}
    no_b, no_c = F.col("b_score").isNull(), F.col("c_score").isNull()
    much = (d["score"] >= 8) | (d["count"] >= 5) | (d["max_age_ms"] >= 30000) | (d["retained_kb"] >= 8192)
    more = (d["score"] >= 3) | (d["count"] > 0) | (d["max_age_ms"] > 0) | (d["retained_kb"] > 0)
    less = (d["score"] <= -3) | (d["count"] < 0) | (d["max_age_ms"] < 0) | (d["retained_kb"] < 0)
    status = F.when(no_b, "new").when(no_c, "resolved").when(much | more, "worse").when(less, "better").otherwise("same")
    at_least = F.when(F.col("c_severity") == "high", "high").otherwise("medium")
    effect = F.when(no_b, at_least).when(no_c, "ok").when(much, "high").when(more, at_least).when(less, "ok").otherwise(F.col("c_severity"))
    weak = F.coalesce(F.col("c_evidence").isin("time_only", "unconfirmed_heap"), F.lit(False))
    out = j.withColumns({"status": status, "severity": F.when((effect == "high") & weak, "medium").otherwise(effect), "has_baseline": ~no_b, "has_candidate": ~no_c})
    return out.fillna(0, [f"{p}_{v}" for p in "bc" for v in values]).drop("c_severity")


def leak_statistics(scored: DataFrame) -> DataFrame:
    """L09."""
    n = lambda c: F.count_if(c)
    user = text.is_app(F.col("class")) | text.is_app(F.col("holder"))
    return scored.groupBy("run_set").agg(
        F.count(F.lit(1)).alias("suspects"), n(F.col("severity") == "high").alias("high"), n(F.col("severity") == "medium").alias("medium"),
        n(F.col("evidence") == "confirmed_path").alias("heap_confirmed"), n(F.col("evidence") != "confirmed_path").alias("runtime_only"),
        n(F.col("evidence") == "after_explicit_gc").alias("after_explicit_gc"), n(F.col("evidence") == "time_only").alias("time_only"),
        n(text.is_unknown(F.col("holder"))).alias("unknown_holder"), n(user).alias("user_owned"), n(text.is_system(F.col("class"))).alias("system_retained"),
        F.count_distinct(F.lower("class")).alias("classes"), F.count_distinct(F.lower("holder")).alias("holders"),
        F.sum("count").alias("objects"), F.sum("retained_kb").alias("retained_kb"), F.max("max_age_ms").alias("max_age_ms"))


# ---- U: the class graph --------------------------------------------------------------------------------------


def class_edges(calls: DataFrame) -> DataFrame:
    """Merged edges between classes; self edges are dropped and a count of 0 is 1."""
    rows = calls.groupBy("run_set", "caller", "callee").agg(F.sum(F.greatest("n", F.lit(1))).alias("n"))  # names are taken apart once a pair
    rows = rows.select("run_set", text.class_of_owner(F.col("caller")).alias("from_class"), text.class_of_owner(F.col("callee")).alias("to_class"), "n")
    return rows.filter("from_class <> to_class").groupBy("run_set", "from_class", "to_class").agg(F.sum("n").cast("bigint").alias("count"))


# ---- Q: quality of the collected data ---------------------------------------------------------------------------


def chain_conflicts(segments: DataFrame) -> DataFrame:
    """Q01: sessions whose segments disagree on what has to be constant, and indexes that occur twice."""
    fixed = ["process_name", "namespace"]
    c = segments.groupBy("session_id").agg(*[F.count_distinct(f).alias(f) for f in fixed], F.count(F.lit(1)).alias("n"), F.count_distinct("segment_index").alias("indexes"))
    issues = F.array(*[F.when(F.col(f) > 1, F.lit(f"{f}_conflict")) for f in fixed], F.when(F.col("n") > F.col("indexes"), F.lit("duplicate_index")))
    return c.select("session_id", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("issue"))


def chain_gaps(segments: DataFrame, *also: str) -> DataFrame:
    """Q02: chains that start late, have gaps, run backwards, or go on after an unsealed segment.

    A chain is a session; columns in ``also`` belong to its key.
    """
    w = Window.partitionBy(*also, "session_id").orderBy("segment_index")
    p_ix, p_t, p_seal = F.lag("segment_index").over(w), F.lag("start_ms").over(w), F.lag("sealed").over(w)
    issues = F.array(F.when(p_ix.isNull() & (F.col("segment_index") != 0), F.lit("late_start")), F.when(F.col("segment_index") > p_ix + 1, F.lit("gap")),
                     F.when(F.col("start_ms") < p_t, F.lit("backwards")), F.when(~p_seal, F.lit("after_unsealed")))
    rows = segments.select(*also, "session_id", "segment_index", issues.alias("i"))
    return rows.select(*also, "session_id", "segment_index", F.explode(F.filter("i", lambda x: x.isNotNull())).alias("issue"))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Q03, Q04: per identity the snapshot of the largest sequence; then each counter summed, saturating."""
    last = snapshots.groupBy("run_set", "session_id").agg(F.max_by("counters", F.struct("sequence", "segment_index")).alias("counters"))
    return last.select("run_set", F.explode("counters").alias("counter", "value")).groupBy("run_set", "counter").agg(F.sum("value").alias("value"))


def collection_quality(totals: DataFrame) -> DataFrame:
    """Q05: level and reasons from accepted, written, lost and unsealed counts of each run set."""
    lost_pct = F.when(F.col("accepted") > 0, F.col("lost") * 100.0 / F.col("accepted")).otherwise(0.0)
    heavy = (F.col("lost") >= 100) | (lost_pct >= 1)
    reasons = F.array(F.when(heavy, F.lit("heavy_loss")).when(F.col("lost") > 0, F.lit("some_loss")), F.when(F.col("unsealed") > 0, F.lit("unsealed_segments")), F.when(F.col("issues") > 0, F.lit("chain_issues")))
    level = F.when(heavy | (F.col("issues") > 0), "low").when((F.col("lost") > 0) | (F.col("unsealed") > 0), "medium").otherwise("high")
    return totals.select("run_set", level.alias("level"), F.array_join(F.filter(reasons, lambda r: r.isNotNull()), "|").alias("reasons"), F.round(lost_pct, 6).alias("lost_pct"))

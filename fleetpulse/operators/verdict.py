"""Verdicts over summaries: scorecard, findings, cohort warnings, compare verdict, sections, problem flow, hot paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions.staging import cut

#: Rows of the scorecard in their order, and their weights.
WEIGHTS = {"data_quality": 20, "retained_signal": 20, "heap_actionability": 20, "compare_stability": 15, "gate_readiness": 15, "readability": 10}
#: Score of a confidence.
CONFIDENCE_SCORE = {"high": 9.0, "medium": 7.0, "low": 4.0}


def _rated(name: str, score: Column, exercised: Column | None = None, idle: float = 5.0) -> Column:
    """One row of the scorecard: clamped, rounded to a tenth; its status comes from the score before rounding."""
    exercised = F.lit(True) if exercised is None else exercised
    status = F.when(~exercised, "not_exercised").when(score >= 8, "strong").when(score >= 6, "needs_work").otherwise("weak")
    value = F.when(exercised, F.round(F.least(F.lit(10.0), F.greatest(F.lit(0.0), score)), 1)).otherwise(F.lit(idle))
    return F.struct(F.lit(name).alias("area"), F.lit(WEIGHTS[name]).alias("weight"), value.alias("score"), status.alias("status"))


def scorecard(facts: DataFrame) -> DataFrame:
    """V08, V09 of one row of facts: weighted rows, their mean, go, qa_only or blocked by the mean before rounding, next actions.

    facts: confidence, baseline_quality, candidate_quality (levels), cohort_warnings, quality_warnings, baseline_logs,
    candidate_logs; of the candidate's leaks: leaks, unknown_holder, user_owned, max_age_ms, heap_confirmed, with_field,
    with_path, with_alternatives, explained; of the comparison: deltas, high_match, medium_match.
    """
    c = F.col
    base = F.lit(CONFIDENCE_SCORE["low"])
    for level, v in CONFIDENCE_SCORE.items():
        base = F.when(c("confidence") == level, F.lit(v)).otherwise(base)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    cohorts, quality, leaks = c("cohort_warnings"), c("quality_warnings"), c("leaks")
    less = lambda n: F.least(F.lit(2.0), n * 0.5)
    retained = 4 + ratio(leaks - c("unknown_holder"), leaks) * 3 + ratio(c("user_owned"), leaks) * 2 + F.when(c("max_age_ms") >= 30000, 1.0).otherwise(0.0)
    heap = 3 + ratio(c("heap_confirmed"), leaks) * 3 + ratio(c("with_field"), leaks) * 1.5 + ratio(c("with_path"), leaks) * 1.5 + ratio(c("with_alternatives"), leaks)
    stable = base * 0.4 + ratio(c("high_match"), c("deltas")) * 4 + ratio(c("medium_match"), c("deltas")) * 2
    ready = base - F.when(cohorts > 0, 2.0).otherwise(0.0) - F.when(quality > 0, 2.0).otherwise(0.0) + F.when((c("baseline_logs") >= 5) & (c("candidate_logs") >= 5), 1.0).otherwise(0.0)
    clamped = F.least(F.lit(10.0), F.greatest(F.lit(0.0), ready))
    rows = F.array(_rated("data_quality", base - less(cohorts) - less(quality)), _rated("retained_signal", retained, leaks > 0), _rated("heap_actionability", heap, leaks > 0),
                   _rated("compare_stability", stable, c("deltas") > 0, 6.0), _rated("gate_readiness", clamped), _rated("readability", 3 + ratio(c("explained"), leaks) * 7, leaks > 0, 6.0))
    each = facts.withColumn("rows", rows)
    whole = F.aggregate("rows", F.lit(0.0), lambda a, r: a + r["score"] * r["weight"]) / sum(WEIGHTS.values())
    each = each.withColumn("whole", whole)  # decides before it is rounded
    low = (c("baseline_quality") == "low") | (c("candidate_quality") == "low")
    clean = (c("confidence") != "low") & (cohorts == 0) & (quality == 0)
    decision = F.when(low, "blocked").when((F.col("whole") >= 8) & clean, "go").when(F.col("whole") >= 6, "qa_only").otherwise("blocked")
    actions = F.concat_ws("|", F.when(c("baseline_quality") != "high", "resolve_baseline_quality"), F.when(c("candidate_quality") != "high", "resolve_candidate_quality"), F.when(cohorts > 0, "align_cohorts"),
                          F.when((leaks > c("heap_confirmed")) & (c("heap_confirmed") == 0), "collect_heap_evidence"))
    return each.withColumns({"decision": decision, "next_actions": actions, "total": F.round("whole", 1)}).select(F.inline("rows"), "total", "decision", "next_actions")


def findings(s: DataFrame) -> DataFrame:
    """The rules that a run set breaks, or the one row that none is.

    s: run_set, events, http, http_failed, http_p95_ms, ui_jank_pct, ui_avg_fps, stall_max_ms, low_memory, retained; what
    a run set lacks is 0.
    """
    c = F.col
    rate = F.when(c("http") > 0, c("http_failed") * 100.0 / c("http")).otherwise(0.0)
    rules = [("low_sample", c("events"), F.when(c("events") < 50, "medium")),
             ("http_failures", rate, F.when((c("http") > 0) & (rate >= 10), "high").when((c("http") > 0) & (c("http_failed") > 0), "medium")),
             ("http_p95", c("http_p95_ms"), F.when(c("http_p95_ms") >= 1500, "high").when(c("http_p95_ms") >= 700, "medium")),
             ("ui_jank", c("ui_jank_pct"), F.when(c("ui_jank_pct") >= 10, "high").when(c("ui_jank_pct") >= 3, "medium")),
             ("ui_fps", c("ui_avg_fps"), F.when((c("ui_avg_fps") > 0) & (c("ui_avg_fps") < 45), "high").when((c("ui_avg_fps") > 0) & (c("ui_avg_fps") < 55), "medium")),
             ("stall", c("stall_max_ms"), F.when(c("stall_max_ms") >= 1000, "high").when(c("stall_max_ms") >= 250, "medium")),
             ("low_memory", c("low_memory"), F.when(c("low_memory") > 0, "high")),
             ("retained", c("retained"), F.when(c("retained") >= 10, "high").when(c("retained") > 0, "medium"))]
    found = F.array_compact(F.array(*[F.when(sev.isNotNull(), F.struct(F.lit(n).alias("rule"), F.round(v.cast("double"), 6).alias("value"), sev.alias("severity"))) for n, v, sev in rules]))
    fine = F.array(F.struct(F.lit("none").alias("rule"), F.lit(0.0).alias("value"), F.lit("ok").alias("severity")))
    return s.select("run_set", F.inline(F.when(F.size(found) > 0, found).otherwise(fine)))


def compare_verdict(deltas: DataFrame, cohort_warnings: DataFrame) -> DataFrame:
    """Regressions of deltas (metric, severity), one row for each cohort warning (dimension), or that there is none;
    with the verdict of the whole."""
    rows = deltas.filter("severity in ('high', 'medium')").select(F.concat(F.lit("regression:"), "metric").alias("finding"), "severity")
    worst = rows.agg(F.coalesce(F.max(F.when(F.col("severity") == "high", 2).otherwise(1)), F.lit(0)).alias("worst"))
    rows = rows.unionByName(cohort_warnings.select(F.concat(F.lit("cohort:"), "dimension").alias("finding"), F.lit("medium").alias("severity")))
    rows = rows.unionByName(worst.filter("worst = 0").select(F.lit("no_regression").alias("finding"), F.lit("ok").alias("severity")))
    advice = F.when(F.col("worst") == 2, "investigate_first").when(F.col("worst") == 1, "review_and_repeat").otherwise("keep_report")
    return rows.crossJoin(F.broadcast(worst.select(advice.alias("advice"))))


def warnings(mix_deltas: DataFrame, quality: DataFrame) -> DataFrame:
    """Cohorts whose mix differs, and the reasons that cap a side's collection quality.

    mix_deltas: dimension, severity; quality: run_set, level, reasons (joined by |).
    """
    cohorts = mix_deltas.filter("severity <> 'ok'").select(F.lit("cohort").alias("kind"), F.lit("both").alias("side"), F.col("dimension").alias("warning"))
    capped = quality.filter("level <> 'high'").select(F.lit("quality").alias("kind"), F.col("run_set").alias("side"), F.explode(F.split(F.when(F.col("reasons") == "", F.col("level")).otherwise(F.col("reasons")), "[|]")).alias("warning"))
    return cohorts.unionByName(capped)


def section_statuses(rows: DataFrame) -> DataFrame:
    """Of each section (run_set, section, severity, score) the worst severity, how many rows aren't ok, the top one."""
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    r = rows.withColumn("rank", rank)
    worst = F.when(F.max("rank") == 3, "high").when(F.max("rank") == 2, "medium").otherwise("ok")
    return r.groupBy("run_set", "section").agg(worst.alias("status"), F.count_if(F.col("rank") > 1).alias("findings"), F.max_by("name", F.struct("rank", "score", "name")).alias("top"))


def significant(states: DataFrame) -> DataFrame:
    """Buckets that a report shows: neither healthy nor empty of signals."""
    some = F.lit(False)
    for c in ("http", "http_failed", "frames", "jank", "stalls", "pss_kb", "rx", "tx"):
        some = some | (F.col(c) > 0)
    return states.filter((F.col("state") != "healthy") & some)


#: Area of a metric in a comparison.
AREAS = {"network": ["http_p95_ms", "http_failed", "rx_bytes", "tx_bytes"], "ui": ["ui_jank_pct", "ui_avg_fps"], "main_thread": ["stall_max_ms"], "memory": ["max_pss_kb", "min_ram_kb", "retained"], "logs": ["log_spam"], "problems": ["problems"]}


def area(metric: Column) -> Column:
    """V14."""
    out = F.lit("other")
    for name, metrics in AREAS.items():
        out = F.when(metric.isin(*metrics), F.lit(name)).otherwise(out)
    return out


def deltas_by_area(deltas: DataFrame) -> DataFrame:
    """Deltas (metric, severity, regression_pct) by area: how many, how many are worse, and the worst."""
    d = deltas.withColumn("area", area(F.col("metric")))
    return d.groupBy("area").agg(F.count(F.lit(1)).alias("metrics"), F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"), F.max_by("metric", F.struct("regression_pct", "metric")).alias("worst"))


def problem_flow(flows: DataFrame, score: Column) -> DataFrame:
    """The flow with the largest score of each run set."""
    f = flows.withColumn("score", score)
    best = F.max_by(F.struct("screen", "flow", "step", "owner", "score"), F.struct("score", "screen", "flow", "step", "owner"))
    return f.groupBy("run_set").agg(best.alias("b")).select("run_set", "b.*")


def within(points: DataFrame, ranges: DataFrame, width: int = 3_600_000) -> DataFrame:
    """For each point (run_set, at) the largest confidence of the ranges (run_set, first, last, confidence) around it.

    Ranges are laid on a grid of ``width`` ms: a cell that a range covers whole keeps only its largest confidence, and
    points meet the ranges that begin or end in their own cell.  So no run set's points meet all of its ranges.
    """
    r = ranges.filter("confidence >= 0.35 and first <= last").withColumns({"a": F.floor(F.col("first") / width), "b": F.floor(F.col("last") / width)})
    p = points.select("run_set", "at").distinct().withColumn("cell", F.floor(F.col("at") / width))
    inner = r.filter("b > a + 1").select("run_set", F.explode(F.sequence(F.col("a") + 1, F.col("b") - 1)).alias("cell"), "confidence").groupBy("run_set", "cell").agg(F.max("confidence").alias("confidence"))
    whole = p.join(inner, ["run_set", "cell"]).select("run_set", "at", "confidence")
    ends = r.select("run_set", F.explode(F.array_distinct(F.array("a", "b"))).alias("cell"), "first", "last", "confidence")
    part = p.join(ends, ["run_set", "cell"]).filter(F.col("at").between(F.col("first"), F.col("last"))).select("run_set", "at", "confidence")
    return whole.unionByName(part).groupBy("run_set", "at").agg(F.max("confidence").alias("confidence"))


#: Sources, hops and factor of a target with runtime symptoms; paths kept.
SOURCES, HOPS, RUNTIME, PATHS = 80, 4, 1.35, 8


def hot_paths(edges: DataFrame, nodes: DataFrame, hops: int = HOPS, most: int | None = PATHS) -> DataFrame:
    """Paths of up to ``hops`` edges from the SOURCES best classes that call others, to classes with a score or
    runtime symptoms; the shortest path to a target counts, the heaviest first.

    edges: run_set, from_class, to_class, count.  nodes: run_set, class, score, runtime.  The weight is the sum of log1p
    of the calls over the root of the depth, raised by the scores of both ends and by RUNTIME.  Of paths of one depth
    the heavier sum is kept, then the larger path.
    """
    edges, nodes = cut(edges, "edges"), cut(nodes, "nodes")
    callers = edges.select("run_set", F.col("from_class").alias("class")).distinct()
    w = Window.partitionBy("run_set").orderBy(F.desc("score"), "class")
    top = nodes.filter("score > 0").join(callers, ["run_set", "class"], "left_semi").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= SOURCES)
    level = cut(top.select("run_set", F.col("class").alias("source"), F.col("class").alias("at"), F.array("class").alias("path"), F.lit(0.0).alias("sum"), F.lit(0).alias("depth")), "paths")
    seen = level
    for depth in range(1, hops + 1):
        step = level.join(edges, (level["run_set"] == edges["run_set"]) & (level["at"] == edges["from_class"])).select(
            level["run_set"], "source", F.col("to_class").alias("at"), F.concat("path", F.array("to_class")).alias("path"), (F.col("sum") + F.log1p("count")).alias("sum"))
        step = step.join(seen.select("run_set", "source", "at"), ["run_set", "source", "at"], "left_anti")
        best = step.groupBy("run_set", "source", "at").agg(F.max_by(F.struct("path", "sum"), F.struct("sum", "path")).alias("b"))
        level = cut(best.select("run_set", "source", "at", "b.path", "b.sum", F.lit(depth).alias("depth")), "paths")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    s = nodes.select("run_set", "class", "score", "runtime")
    j = seen.filter("depth > 0").join(s.select("run_set", F.col("class").alias("source"), F.col("score").alias("s")), ["run_set", "source"])
    j = j.join(s.select("run_set", F.col("class").alias("at"), F.col("score").alias("t"), "runtime"), ["run_set", "at"]).filter("runtime or t > 0")
    weight = F.when(F.col("sum") == 0, 1.0).otherwise(F.col("sum")) / F.sqrt(F.col("depth").cast("double")) * (1 + 0.25 * F.col("s") + 0.75 * F.col("t")) * F.when(F.col("runtime"), RUNTIME).otherwise(1.0)
    out = j.select("run_set", "source", F.col("at").alias("target"), "depth", F.array_join("path", ">").alias("path"), F.round(weight, 4).alias("weight"), "runtime")
    if most is None:
        return out
    rank = F.row_number().over(Window.partitionBy("run_set").orderBy(F.desc("weight"), "path"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")

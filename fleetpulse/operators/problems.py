"""Code problems and influence of classes.

Both score the same four inputs, each one row a context: problem windows (A10), scored leak suspects (L03), log spam (A09)
and runtime calls (A11); windows of retained objects and of log spam are left to the latter paths.  They differ in their
weights: the registry is about a class and method, influence about a class among its neighbours.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions import text
from fleetpulse.functions.numbers import saturating_score

OK, MEDIUM, HIGH = 1, 2, 3
SEVERITY = {OK: "ok", MEDIUM: "medium", HIGH: "high"}

#: Kinds of problem windows by group; category and further categories of each group.
MAIN_THREAD = ["main_thread_stall", "main_thread_dispatch", "wrapped_click"]
MAIN_IO = ["main_thread_io", "main_thread_disk_io", "disk_io_main_thread"]
HTTP = ["http_problem", "http_slow_or_failed"]
GC = ["gc_pressure", "gc_count", "gc_time"]
KINDS = [(HTTP, "network", ["network_duplicates"]), (MAIN_THREAD, "main_thread", ["anr_risk"]), (MAIN_IO, "main_thread_io", ["anr_risk", "main_thread"]), (["ui_jank"], "ui", []), (GC, "runtime", ["gc_pressure", "oom_risk"])]
ELSEWHERE = ["retained_object", "log_spam"]
#: Parts of the names of owners that work on the main thread.
MAIN_NAMES = ["main", "ui", "click", "render", "bind"]
#: Pivots of scores (count, longest, total) and limits of severities (medium, high).
WINDOW_PIVOTS, SPAM_PIVOT, CALL_PIVOTS, CALLER_PIVOT = (8, 500), 160, (160, 500, 2200), 220
CALLER_SHARE, LEAK_SHARE, CONTEXT_BONUS = 0.45, 0.45, 0.35

SIGNAL = ["run_set", "class", "method", "category", "name", "severity", "score", "count", "total_ms", "max_ms", "screen", "flow", "step", "extra", "retained", "memory_kb"]


def steps(value: Column, medium: float, high: float) -> Column:
    """a severity's rank by two limits."""
    return F.when(value >= high, HIGH).when(value >= medium, MEDIUM).otherwise(OK)


def severity_name(rank: Column) -> Column:
    return F.when(rank >= HIGH, SEVERITY[HIGH]).when(rank == MEDIUM, SEVERITY[MEDIUM]).otherwise(SEVERITY[OK])


def _of_kind(values: list[tuple[list[str], object]], other: object) -> Column:
    lit = lambda v: F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)
    return reduce(lambda out, kv: F.when(F.col("kind").isin(*kv[0]), lit(kv[1])).otherwise(out), reversed(values), lit(other))


def window_severity() -> Column:
    long, n = F.col("max_ms"), F.col("count")
    stall = steps(long, 2000, 8000)
    return (F.when(F.col("kind").isin("main_thread_stall", "main_thread_dispatch", *MAIN_IO), stall).when(F.col("kind") == "ui_jank", steps(n, 20, 100))
            .when(F.col("kind").isin(*HTTP), steps(long, 700, 1500)).otherwise(steps(n, 4, 20)))


def _leak_target(leaks: DataFrame) -> DataFrame:
    return leaks.withColumn("target", F.when(text.is_app(F.col("holder")), F.col("holder")).otherwise(F.col("class")))


def _place(owner: str, normal: bool = False) -> list[Column]:
    klass = text.class_of_owner(F.col(owner))
    return [(F.coalesce(klass, text.normal_class(F.col(owner))) if normal else klass).alias("class"), text.method_of_owner(F.col(owner)).alias("method")]


def signals(windows: DataFrame, leaks: DataFrame, spam: DataFrame, calls: DataFrame) -> DataFrame:
    """Every scored signal with its class, method, category, severity and further categories."""
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("bigint")

    def part(df: DataFrame, place: list[Column], **values: Column) -> DataFrame:
        given = {"total_ms": zero, "max_ms": zero, "retained": zero, "memory_kb": zero, "extra": none} | values
        return df.select("run_set", *place, "screen", "flow", "step", *[v.alias(k) for k, v in given.items()]).select(*SIGNAL)

    n, p = F.col("count"), WINDOW_PIVOTS
    w = windows.filter(~F.col("kind").isin(*ELSEWHERE))
    rows = part(w, _place("owner"), category=_of_kind([(k, c) for k, c, _ in KINDS], "runtime"), name=F.col("kind"), severity=window_severity(), count=n,
                score=saturating_score(n, p[0]) + saturating_score(F.col("max_ms"), p[1]), total_ms=F.col("window_ms"), max_ms=F.col("max_ms"), extra=_of_kind([(k, e) for k, _, e in KINDS], []))
    oom = F.when((F.col("retained_kb") >= 4096) | (F.coalesce("heap_objects", zero) >= 3), F.array(F.lit("lifecycle_leak"), F.lit("oom_risk"))).otherwise(F.array(F.lit("lifecycle_leak")))
    leak = _leak_target(leaks if "heap_objects" in leaks.columns else leaks.withColumn("heap_objects", zero))
    rank = F.when(F.col("severity") == "high", HIGH).when(F.col("severity") == "medium", MEDIUM).otherwise(OK)
    rows = rows.unionByName(part(leak, _place("target", True), category=F.lit("memory"), name=F.when(F.col("evidence") == "confirmed_path", "confirmed_retention_path").otherwise("retention_signal"), severity=rank,
                                 count=n, score=F.col("score"), max_ms=F.col("max_age_ms"), extra=oom, retained=n, memory_kb=F.col("retained_kb")))
    rows = rows.unionByName(part(spam, _place("owner"), category=F.lit("logging"), name=F.lit("log_spam"), severity=steps(n, 100, 1000), count=n, score=saturating_score(n, SPAM_PIVOT), extra=F.array(F.lit("log_spam"))))
    c = CALL_PIVOTS
    cost = saturating_score(n, c[0]) + saturating_score(F.col("total_ms"), c[2]) + saturating_score(F.col("max_ms"), c[1])
    for owner, name, share in (("caller", "call_initiator", CALLER_SHARE), ("callee", "called_work", 1.0)):
        main = F.lower(owner).rlike("|".join(MAIN_NAMES)) & (F.col("max_ms") >= 700)
        rows = rows.unionByName(part(calls, _place(owner), category=F.lit("runtime"), name=F.lit(name), severity=steps(F.col("max_ms"), 500, 2000), count=n, score=cost * share,
                                     total_ms=F.col("total_ms"), max_ms=F.col("max_ms"), extra=F.when(main, F.array(F.lit("anr_risk"))).otherwise(none)))
    return rows.filter(F.col("class").isNotNull())


def merged_signals(rows: DataFrame) -> DataFrame:
    """Signals of one class, method, category and name as one, with the worst severity."""
    out = rows.groupBy("run_set", "class", "method", "category", "name").agg(
        F.sum("count").alias("count"), F.sum("total_ms").alias("total_ms"), F.max("max_ms").alias("max_ms"), F.round(F.sum("score"), 4).alias("score"), F.max("severity").alias("rank"))
    return out.withColumn("severity", severity_name(F.col("rank"))).drop("rank")


def _known(c: str) -> Column:
    return F.when(~text.is_unknown(F.col(c)) & (F.trim(c) != ""), F.col(c))


def _some(c: Column, most: int | None = None) -> Column:
    values = F.array_sort(F.collect_set(c))
    return F.array_join(values if most is None else F.slice(values, 1, most), "|")


def registry(rows: DataFrame, most: int | None = 200) -> DataFrame:
    """One row for each class and method: score, severity, categories, problems, contexts and what was measured.

    Severity is the worst of the signals, medium at least from a score of 7 on, high from 18 on.  ``rank`` orders a run set's
    rows by score; the first ``most`` are kept.
    """
    by = ["run_set", "class", "method"]
    of = lambda names, c: F.sum(F.when(F.col("name").isin(*names), F.col(c)).otherwise(0)).alias
    calls, elsewhere = ["call_initiator", "called_work"], ["log_spam", "retention_signal", "confirmed_retention_path"]
    sums = rows.groupBy(*by).agg(
        F.round(F.sum("score"), 1).alias("score"), F.sum("count").alias("count"), F.max("severity").alias("worst"), F.collect_set("category").alias("own"), F.array_distinct(F.flatten(F.collect_set("extra"))).alias("more"),
        _some(F.col("name")).alias("problems"), _some(_known("screen"), 6).alias("screens"), _some(_known("flow"), 6).alias("flows"), _some(_known("step"), 6).alias("steps"),
        F.sum(F.when(F.col("name").isin(*calls, *elsewhere), 0).otherwise(F.col("count"))).alias("problem_count"), of(["log_spam"], "count")("log_spam"), F.sum("retained").alias("retained"), F.sum("memory_kb").alias("memory_kb"),
        of(calls, "count")("calls"), of(calls, "total_ms")("call_ms"), F.max("max_ms").alias("max_ms"))
    rank = F.when(F.col("score") >= 18, HIGH).when(F.col("score") >= 7, F.greatest(F.col("worst"), F.lit(MEDIUM))).otherwise(F.col("worst"))
    out = sums.select(*by, "score", severity_name(rank).alias("severity"), "count", F.array_join(F.array_sort(F.array_union("own", "more")), "|").alias("categories"), "problems", "screens", "flows", "steps",
                      "problem_count", "log_spam", "retained", "memory_kb", "calls", "call_ms", "max_ms")
    if most is None:
        return out
    w = Window.partitionBy("run_set").orderBy(F.desc("score"), "class", "method")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def influence(windows: DataFrame, leaks: DataFrame, spam: DataFrame, calls: DataFrame, static: DataFrame | None = None) -> DataFrame:
    """Score of each class with a symptom, a bonus for each flow and screen it was seen in; with the edges of a class
    graph (run_set, from_class, to_class) also the classes that are only in it, as ``static_only``.

    ``raw`` is the score before rounding, which edges and hotspots are weighed by.
    """
    zero = F.lit(0).cast("bigint")

    def part(df: DataFrame, klass: Column, score: Column, reason: Column, **values: Column) -> DataFrame:
        given = {c: zero for c in ("problems", "log_spam", "main_ms", "runtime_ms", "retained", "memory_kb")} | values
        return df.select("run_set", klass.alias("class"), "flow", "screen", score.cast("double").alias("score"), reason.alias("reason"), *[v.cast("bigint").alias(k) for k, v in given.items()])

    n, p, c = F.col("count"), WINDOW_PIVOTS, CALL_PIVOTS
    owner = text.class_of_owner(F.col("owner"))
    w = windows.filter(~F.col("kind").isin(*ELSEWHERE))
    rows = part(spam, owner, saturating_score(n, SPAM_PIVOT), F.lit("log_spam"), log_spam=n)
    rows = rows.unionByName(part(w, owner, saturating_score(n, p[0]) + saturating_score(F.col("max_ms"), p[1]), F.col("kind"), problems=n,
                                 main_ms=F.when(F.col("kind").isin(*MAIN_THREAD, *MAIN_IO), F.col("window_ms")).otherwise(0)))
    leak = _leak_target(leaks)
    rows = rows.unionByName(part(leak, F.coalesce(text.class_of_owner(F.col("target")), text.normal_class(F.col("target"))), F.col("score") * LEAK_SHARE, F.col("evidence"), retained=n, memory_kb=F.col("retained_kb")))
    pairs = calls.withColumns({"a": text.class_of_owner(F.col("caller")), "b": text.class_of_owner(F.col("callee"))}).filter("a <> b")
    cost = saturating_score(n, c[0]) + saturating_score(F.col("total_ms"), c[2]) + saturating_score(F.col("max_ms"), c[1])
    rows = rows.unionByName(part(pairs, F.col("a"), saturating_score(n, CALLER_PIVOT) * CALLER_SHARE, F.lit("calls"), runtime_ms=F.expr("total_ms div 4")))
    rows = rows.unionByName(part(pairs, F.col("b"), cost, F.lit("calls"), runtime_ms=F.col("total_ms"))).filter(F.col("class").isNotNull())
    own = rows.groupBy("run_set", "class").agg(
        F.sum("score").alias("sum"), (F.count_distinct(_known("flow")) + F.count_distinct(_known("screen"))).alias("contexts"), *[F.sum(x).alias(x) for x in ("problems", "log_spam", "main_ms", "runtime_ms", "retained", "memory_kb")],
        _some(_known("flow"), 4).alias("flows"), _some(_known("screen"), 4).alias("screens"), _some(F.col("reason"), 5).alias("reasons"))
    raw = F.col("sum") + CONTEXT_BONUS * F.col("contexts")
    out = own.withColumns({"raw": raw, "score": F.round(raw, 1), "status": F.lit("runtime")}).drop("sum")
    if static is not None:
        both = static.select("run_set", F.explode(F.array("from_class", "to_class")).alias("class")).distinct()
        rest = both.join(out, ["run_set", "class"], "left_anti").withColumns({"raw": F.lit(0.0), "score": F.lit(0.0), "status": F.lit("static_only")})
        out = out.unionByName(rest, allowMissingColumns=True).fillna(0).fillna("")
    return out.withColumn("severity", F.when(F.col("score") >= 12, "high").when(F.col("score") >= 6, "medium").otherwise("ok"))


def influence_edges(static: DataFrame, calls: DataFrame, nodes: DataFrame, selected: DataFrame, most: int | None = 120) -> DataFrame:
    """Edges at selected classes (run_set, class), and static ones into classes with symptoms.

    A static edge counts its calls times the larger of the target's score and .35 of the source's; a call of this run its
    count, total / 25 and longest / 5.  Both add up for one pair of classes.
    """
    s = nodes.select("run_set", "class", "raw", (F.col("status") == "runtime").alias("runtime")).join(selected.select("run_set", "class", F.lit(True).alias("selected")), ["run_set", "class"], "left")
    end = lambda c, p: s.select("run_set", F.col("class").alias(c), F.col("raw").alias(f"{p}_raw"), F.col("runtime").alias(f"{p}_runtime"), F.coalesce("selected", F.lit(False)).alias(f"{p}_selected"))
    known = lambda df: df.join(end("from_class", "f"), ["run_set", "from_class"]).join(end("to_class", "t"), ["run_set", "to_class"])
    st = known(static).filter("f_selected or t_selected or t_runtime").select(
        "run_set", "from_class", "to_class", "count", (F.col("count") * F.greatest(F.col("t_raw"), F.col("f_raw") * 0.35)).alias("influence"), (F.col("f_runtime") | F.col("t_runtime")).alias("confirmed"),
        F.when(F.col("t_runtime"), 2).when(F.col("f_runtime"), 1).otherwise(0).alias("reason"))
    pairs = calls.groupBy("run_set", "caller", "callee").agg(F.sum("count").alias("count"), F.sum("total_ms").alias("total_ms"), F.sum("max_ms").alias("max_ms"))  # a row's longest call counts for the row
    pairs = pairs.select("run_set", text.class_of_owner(F.col("caller")).alias("from_class"), text.class_of_owner(F.col("callee")).alias("to_class"), "count", "total_ms", "max_ms").filter("from_class <> to_class")
    rt = known(pairs).filter("f_selected or t_selected").select("run_set", "from_class", "to_class", "count", (F.col("count") + F.col("total_ms") / 25 + F.col("max_ms") / 5).alias("influence"), F.lit(True).alias("confirmed"), F.lit(3).alias("reason"))
    out = st.unionByName(rt).groupBy("run_set", "from_class", "to_class").agg(F.sum("count").cast("bigint").alias("count"), F.round(F.sum("influence"), 4).alias("influence"), F.bool_or("confirmed").alias("confirmed"), F.max("reason").alias("reason"))
    out = out.withColumn("reason", F.element_at(F.array(*map(F.lit, ["static", "near_symptoms", "calls_symptoms", "called_in_run"])), F.col("reason") + 1))
    if most is None:
        return out
    w = Window.partitionBy("run_set").orderBy(F.desc("influence"), F.desc("count"), "from_class", "to_class")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def top_nodes(nodes: DataFrame, most: int = 60) -> DataFrame:
    """Classes by score; only those with symptoms or a score."""
    w = Window.partitionBy("run_set").orderBy(F.desc("score"), "class")
    return nodes.filter("status = 'runtime' or score > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def shown_nodes(nodes: DataFrame, edges: DataFrame, most: int = 80) -> DataFrame:
    """The top nodes, then the ends of the top edges in their order, each class once."""
    top = top_nodes(nodes).select("run_set", "class", F.col("rank").cast("bigint").alias("at"))
    ends = edges.select("run_set", F.posexplode(F.array("from_class", "to_class")).alias("side", "class"), (F.col("rank") * 2 + 1000).alias("base")).select("run_set", "class", (F.col("base") + F.col("side")).cast("bigint").alias("at"))
    first = top.unionByName(ends).groupBy("run_set", "class").agg(F.min("at").alias("at"))
    w = Window.partitionBy("run_set").orderBy("at")
    return first.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("run_set", "class", "place").join(nodes, ["run_set", "class"])


def method_hotspots(methods: DataFrame, nodes: DataFrame, most: int | None = 12) -> DataFrame:
    """Methods as callers and as callees by the logarithms of their edges' calls, raised by their class's score.

    methods: run_set, from_class, from_method, to_class, to_method, count.  Edges between classes without a score don't count.
    """
    s = nodes.filter("raw > 0").select("run_set", "class", "raw")
    j = methods.join(s.select("run_set", F.col("class").alias("from_class"), F.col("raw").alias("f")), ["run_set", "from_class"], "left")
    j = j.join(s.select("run_set", F.col("class").alias("to_class"), F.col("raw").alias("t")), ["run_set", "to_class"], "left").filter("f is not null or t is not null")
    side = lambda p, role, s: F.struct(F.col(f"{p}_class").alias("class"), F.col(f"{p}_method").alias("method"), F.lit(role).alias("role"), (F.log1p("count") * (1 + F.coalesce(s, F.lit(0.0)))).alias("weight"))
    each = j.select("run_set", "count", F.explode(F.array(side("from", "caller", "f"), side("to", "callee", "t"))).alias("m")).select("run_set", "count", "m.*").filter("method <> '' and method <> '<unknown>'")
    out = each.groupBy("run_set", "class", "method", "role").agg(F.sum("count").cast("bigint").alias("calls"), F.round(F.sum("weight"), 1).alias("heat"))
    if most is None:
        return out
    w = Window.partitionBy("run_set").orderBy(F.desc("heat"), "class", "method", "role")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).drop("rank")

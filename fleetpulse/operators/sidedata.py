"""Quality counters, filters, build-time side data and code-problem details (Q06-Q11, P02-P04, P10-P12, P30, X01-X03, E, J02-J04, J23, S10, S20, S21, B05, B06, U03, U06, U10, A23, A26, T06, M01, R05)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fleetpulse.functions import text

#: Quality counters by id; the first block counts from 1, the second from 0x2000.
COUNTERS = ["accepted_event", "written_event", "queue_full", "not_accepting", "control_lane_full", "control_timeout", "control_interrupted", "writer_io_error", "event_lost_after_io", "dictionary_overflow",
            "dictionary_value_truncated", "oversized_record", "committed_chunk", "failed_chunk", "recovery", "close_timeout", "event_lost_after_size_limit"]
REGISTRY_COUNTERS = ["metric_cardinality_loss", "invalid_metric", "runtime_graph_capacity_loss", "runtime_stack_mismatch", "log_spam_cardinality_loss", "handler_entry_limit", "handler_wrapper_limit", "lifecycle_registry_limit",
                     "object_watcher_limit", "jankstats_handle_limit", "metric_flush_timeout"]
#: Counters of the first block that are no defect by themselves (or are told elsewhere).
SILENT = ["accepted_event", "written_event", "dictionary_overflow", "committed_chunk"]
#: Names of the record types from 1 on, of the five derived problem kinds, and the number of the type of retained objects.
EVENT_TYPES = ["dictionary", "session", "context", "http", "ui_window", "stall", "memory", "retained", "counter", "gauge", "flow_transition", "log_spam", "problem", "runtime_call", "quality_snapshot", "segment_end"]
LEGACY_KINDS = ["http_slow_or_failed", "main_thread_stall", "ui_jank", "retained_object", "log_spam"]
RETAINED_TYPE = 8


def by_position(c: Column, names: list[str], first: int, other: Column) -> Column:
    at = (c - first + 1).cast("int")
    return F.when((c >= first) & (c < first + len(names)), F.try_element_at(F.array(*map(F.lit, names)), F.greatest(at, F.lit(1)))).otherwise(other)


def counter_name(c: Column) -> Column:
    """Q11: by block, ``event_<type>_reason_<reason>`` from 0x1000 on, else ``quality_<id>``."""
    lost = F.concat(F.lit("event_"), F.floor((c - 0x1000) / 16).cast("string"), F.lit("_reason_"), ((c - 0x1000) % 16).cast("string"))
    plain = F.when((c >= 0x1000) & (c < 0x2000), F.concat(lost, F.lit("_total"))).otherwise(F.concat(F.lit("quality_"), c.cast("string")))
    return by_position(c, [n + "_total" for n in COUNTERS], 1, by_position(c, [n + "_total" for n in REGISTRY_COUNTERS], 0x2000, plain))


def event_type_name(c: Column) -> Column:
    """A26."""
    return by_position(c, EVENT_TYPES, 1, F.concat(F.lit("event_"), c.cast("string")))


def quality_warnings(totals: DataFrame) -> DataFrame:
    """Q06 of counter totals (run_set, id, value): one row per defect, and the gap between accepted and written events."""
    named = totals.withColumn("warning", counter_name(F.col("id")))
    loud = [n + "_total" for n in [*COUNTERS, *REGISTRY_COUNTERS] if n not in SILENT]
    rows = named.filter(F.col("warning").isin(*loud) & (F.col("value") > 0)).select("run_set", "warning", "value")
    both = totals.groupBy("run_set").agg(*[F.coalesce(F.sum(F.when(F.col("id") == i, F.col("value"))), F.lit(0)).alias(n) for i, n in ((1, "a"), (2, "w"))])
    return rows.unionByName(both.filter("a > w").select("run_set", F.lit("accepted_not_written").alias("warning"), (F.col("a") - F.col("w")).alias("value")))


#: How a segment ends, from 1 on.
END_REASONS = ["normal", "shutdown", "size_limit", "io_error"]


def segment_end_warnings(segments: DataFrame) -> DataFrame:
    """Q07 of (source, reason): ends other than normal ones."""
    name = by_position(F.col("reason"), END_REASONS, 1, F.concat(F.lit("unknown_"), F.col("reason").cast("string")))
    return segments.withColumn("warning", name).filter(~F.col("warning").isin("normal", "shutdown")).select("source", "warning")


def retention_quality(totals: DataFrame) -> DataFrame:
    """Q08 of counter totals: what retained objects may be missing, and whether their names may be degraded."""
    lost = F.col("id").between(0x1000 + RETAINED_TYPE * 16 + 1, 0x1000 + RETAINED_TYPE * 16 + 5)
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("value"))), F.lit(0)).cast("bigint")
    limit = lambda name: n(F.col("id") == 0x2000 + REGISTRY_COUNTERS.index(name))
    out = totals.groupBy("run_set").agg(n(lost).alias("events_lost"), limit("object_watcher_limit").alias("watcher_lost"), limit("lifecycle_registry_limit").alias("lifecycle_lost"), n(F.col("id") == 10).alias("overflow"))
    return out.select("run_set", (F.col("events_lost") + F.col("watcher_lost")).alias("runtime_loss"), ((F.col("events_lost") > 0) | (F.col("watcher_lost") > 0) | (F.col("lifecycle_lost") > 0)).alias("may_be_incomplete"), (F.col("overflow") > 0).alias("dictionary_degraded"))


def instrumentation_quality(classes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Q10 of diagnostics: classes (class, hooks, annotated) and decisions (kind, reason, count); one row per defect."""
    c = classes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("hooks"), F.lit(0)).alias("hooks"), F.coalesce(F.sum("annotated"), F.lit(0)).alias("annotated"))
    bad = (F.col("kind") == "unsupported") | (F.col("reason") == "unsupported_signature")
    d = decisions.agg(F.coalesce(F.sum(F.when(bad, F.col("count"))), F.lit(0)).cast("bigint").alias("unsupported"))
    rules = F.array(F.when(F.col("n") == 0, F.struct(F.lit("no_classes").alias("warning"), F.lit(0).cast("bigint").alias("value"))),
                    F.when((F.col("n") > 0) & (F.col("hooks") == 0) & (F.col("annotated") == 0), F.struct(F.lit("no_hooks").alias("warning"), F.col("n").alias("value"))),
                    F.when(F.col("unsupported") > 0, F.struct(F.lit("unsupported_signatures").alias("warning"), F.col("unsupported").alias("value"))))
    return c.crossJoin(F.broadcast(d)).select(F.inline(F.array_compact(rules)))


def diagnostics_rollup(records: DataFrame, dims: dict[str, list[str]]) -> DataFrame:
    """Totals of diagnostics (dimension, key columns, count) by each dimension's keys, as one long table."""
    out = None
    for name, keys in dims.items():
        part = records.filter(F.col("dimension") == name).groupBy(F.concat_ws("|", *keys).alias("key")).agg(F.sum("count").cast("bigint").alias("count")).withColumn("dimension", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def class_ranking(classes: DataFrame, most: int = 200) -> DataFrame:
    """Classes by hooks, annotated methods, methods, name."""
    w = Window.partitionBy("run_set").orderBy(F.desc("hooks"), F.desc("annotated"), F.desc("methods"), "class")
    return classes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def merged_catalogue(classes: DataFrame) -> DataFrame:
    """Class records (name, framework, roles, generated) merged by name and framework: united roles, any generated."""
    return classes.groupBy("name", "framework").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("roles")))), "|").alias("roles"), F.bool_or("generated").alias("generated"), F.count(F.lit(1)).alias("records"))


def catalogue_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges (consumer, dependency, framework, site) without those of a class to itself."""
    return edges.filter("consumer <> dependency").distinct()


def merged_shards(lines: DataFrame) -> DataFrame:
    """Distinct lines of all shards, in order."""
    return lines.distinct().orderBy("line")


def with_ancestors(c: Column) -> Column:
    """A class and the classes around it."""
    parts = F.split(c, "[$]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "$"))


def observations(names: DataFrame, observed: DataFrame) -> DataFrame:
    """Labels under which a class (name), or one around it, was observed (class, label), or one around that was."""
    seen = observed.select(F.explode(with_ancestors(F.col("class"))).alias("at"), "label").distinct()
    asked = names.select("name", F.explode(with_ancestors(F.col("name"))).alias("at"))
    return asked.join(seen, "at").groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("label")), "|").alias("labels"))


def injection_report(classes: DataFrame, edges: DataFrame, observed: DataFrame) -> DataFrame:
    """By framework its classes and edges, and how many of them were observed at run time (edges: either end)."""
    seen = observations(classes.select("name").union(edges.select("consumer")).union(edges.select("dependency")).distinct(), observed).select("name").withColumn("seen", F.lit(1))
    c = classes.join(seen, "name", "left").groupBy("framework").agg(F.count(F.lit(1)).alias("classes"), F.count("seen").alias("classes_seen"))
    e = edges.join(seen.withColumnsRenamed({"name": "consumer", "seen": "a"}), "consumer", "left").join(seen.withColumnsRenamed({"name": "dependency", "seen": "b"}), "dependency", "left")
    e = e.groupBy("framework").agg(F.count(F.lit(1)).alias("edges"), F.count(F.coalesce("a", "b")).alias("edges_seen"))
    return c.join(e, "framework", "full").fillna(0)


@F.pandas_udf(StringType())
def stable_id(names: pd.Series) -> pd.Series:
    """FNV-1a of 64 bits over the UTF-8 bytes, in canonical text."""
    out = np.full(len(names), 0xCBF29CE484222325, np.uint64)
    raw = [n.encode() for n in names]
    width = max(map(len, raw), default=0)
    size = np.array([len(r) for r in raw])
    grid = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(len(raw), width) if width else np.zeros((len(raw), 0), np.uint8)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = np.where(k < size, (out ^ grid[:, k]) * np.uint64(0x100000001B3), out)
    return pd.Series([f"stable:0x{x:016x}" for x in out.tolist()])


def owner_map(methods: DataFrame) -> DataFrame:
    """Ids of methods (class, method, descriptor), parts joined by NUL, with how many symbols share an id."""
    symbol = F.concat_ws(".", "class", "method")
    ids = methods.distinct().select(stable_id(F.concat_ws("\0", "class", "method", "descriptor")).alias("id"), symbol.alias("symbol"))
    return ids.groupBy("id").agg(F.min("symbol").alias("symbol"), F.count_distinct("symbol").alias("symbols"))


def resolved(refs: DataFrame, embedded: DataFrame, owners: DataFrame) -> DataFrame:
    """Names of stable ids (source, namespace, id): from the same file, else from the owner map of the same
    namespace, else unresolved."""
    j = refs.join(embedded.select("source", "id", F.col("value").alias("own")), ["source", "id"], "left").join(owners.select("namespace", "id", F.col("owner").alias("mapped")), ["namespace", "id"], "left")
    return j.withColumns({"name": F.coalesce("own", "mapped"), "by": F.when(F.col("own").isNotNull(), "embedded").when(F.col("mapped").isNotNull(), "owner_map").otherwise("unresolved")}).drop("own", "mapped")


def namespace_conflicts(segments: DataFrame, owners: DataFrame) -> DataFrame:
    """Segments whose namespace the owner map lacks."""
    return segments.join(F.broadcast(owners.select("namespace").distinct()), "namespace", "left_anti")


@dataclass(frozen=True)
class Options:
    """Filters of all commands (lower-case parts of names; empty passes), the route redactor (X01), and row limits."""

    route: str = ""
    screen: str = ""
    owner: str = ""
    klass: str = ""
    redact: Callable[[Column], Column] = text.redact_route
    most_rows: int = 1000

    @property
    def active(self) -> bool:
        return bool(self.route or self.screen or self.owner or self.klass)


def contains(c: Column, part: str) -> Column:
    return F.lit(True) if not part else F.contains(F.lower(c), F.lit(part.lower()))


def metric_contains(c: Column, part: str) -> Column:
    """Also matches after other characters are collapsed."""
    flat = "_".join(x for x in "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in part.lower()).split())
    return contains(c, part) | (contains(c, flat) if flat else F.lit(False))


def maths_filter(events: DataFrame, o: Options) -> DataFrame:
    """Calls by route and owner, UI by screen, stalls and calls by owner; memory passes."""
    by = {"http": contains(F.col("route"), o.route) & contains(F.col("owner"), o.owner), "ui": contains(F.col("screen"), o.screen), "call": contains(F.col("owner"), o.owner)}
    keep = F.lit(True)
    for kind, when in by.items():
        keep = F.when(F.col("type") == kind, when).otherwise(keep)
    return events.filter(keep)


def filter_warnings(events: DataFrame, o: Options) -> DataFrame:
    """With a filter, the kinds of events that it doesn't touch."""
    if not o.active:
        return events.select("run_set", F.lit("").alias("untouched")).limit(0)
    kinds = F.array_sort(F.collect_set(F.when(F.col("type") == "memory", "device_context").when(F.col("type") == "call", "custom_metrics")))
    return events.groupBy("run_set").agg(F.array_join(kinds, "|").alias("untouched")).filter("untouched <> ''")


def limited(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows of each run set, with how many there are in all."""
    total = rows.groupBy("run_set").agg(F.count(F.lit(1)).alias("total"))
    rank = F.row_number().over(Window.partitionBy("run_set").orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most).join(F.broadcast(total), "run_set")


def run_key() -> Column:
    """Run, else session, else source; ids of zeros are missing."""
    known = lambda c: F.when(~F.col(c).rlike("^0*$"), F.col(c))
    return F.coalesce(known("run_id"), known("session_id"), F.col("source"))


def sample_quality(n: Column) -> Column:
    """R05."""
    return F.when(n < 5, "small").when(n < 20, "limited").when(n < 50, "enough").otherwise("good")


def data_size(kb: Column) -> Column:
    """KB, MB or GB with one decimal, ties to even."""
    say = lambda v, u: F.format_string(f"%.1f {u}", F.bround(v, 1))
    return F.when(kb >= 1024 * 1024, say(kb / (1024 * 1024), "GB")).when(kb >= 1024, say(kb / 1024, "MB")).otherwise(F.concat(kb.cast("string"), F.lit(" KB")))


def sampling_warnings(routes: DataFrame, most: int = 20_000) -> DataFrame:
    """Routes with more calls than an exact percentile is promised for."""
    return routes.groupBy("run_set").agg(F.count_if(F.col("count") > most).alias("routes"), F.coalesce(F.sum(F.when(F.col("count") > most, F.col("count"))), F.lit(0)).cast("bigint").alias("calls")).filter("routes > 0")


def drill_down(rows: DataFrame, most: int = 12) -> DataFrame:
    """Of each class and method the places to look: flows by up to three screens, steps and routes, the first twelve."""
    of = lambda c, k: F.when(F.size(F.collect_set(c)) == 0, F.array(F.lit(""))).otherwise(F.slice(F.array_sort(F.collect_set(c)), 1, k))
    sets = rows.groupBy("run_set", "class", "method").agg(of("flow", most).alias("flows"), *[of(c, 3).alias(f"{c}s") for c in ("screen", "step", "route")])
    out = sets
    for c in ("flow", "screen", "step", "route"):
        out = out.withColumn(c, F.explode(f"{c}s"))
    w = Window.partitionBy("run_set", "class", "method").orderBy("flow", "screen", "step", "route")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("run_set", "class", "method", "flow", "screen", "step", "route", "rank")


#: Impact and advice of a category, as codes.
IMPACT = {
    "network": ("delays", "check_requests"), "ui": ("janky", "move_work_off_frames"), "main_thread": ("blocks_main_thread", "move_off_main_thread"), "memory": ("memory_pressure", "release_holders"),
    "logging": ("noise", "limit_logs"), "runtime": ("heavy_chain", "shorten_chain"), "anr_risk": ("not_responding", "split_long_work"), "oom_risk": ("out_of_memory", "bound_caches"),
    "gc_pressure": ("gc_pauses", "allocate_less"), "network_duplicates": ("repeated_requests", "merge_requests"), "lifecycle_leak": ("outlives_screen", "clear_on_lifecycle"),
    "log_spam": ("logs_in_hot_path", "aggregate_logs"), "main_thread_io": ("io_on_main_thread", "move_io"),
}


def impacts(registry: DataFrame) -> DataFrame:
    """Impact and advice of a registry row, by its categories (joined by |)."""
    rules = registry.sparkSession.createDataFrame([(k, *v) for k, v in IMPACT.items()], "category string, impact string, advice string")
    each = registry.select("run_set", "class", "method", F.explode(F.split("categories", "[|]")).alias("category")).join(F.broadcast(rules), "category")
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", c))), lambda x: x[c]), "|").alias(c)
    return each.groupBy("run_set", "class", "method").agg(join("impact"), join("advice"))


def method_graph(calls: DataFrame) -> DataFrame:
    """Calls merged by both classes and both methods."""
    pairs = calls.groupBy("run_set", "caller", "callee").agg(F.sum(F.greatest("n", F.lit(1))).cast("bigint").alias("count"))
    return pairs.select("run_set", text.class_of_owner(F.col("caller")).alias("from_class"), text.method_of_owner(F.col("caller")).alias("from_method"),
                        text.class_of_owner(F.col("callee")).alias("to_class"), text.method_of_owner(F.col("callee")).alias("to_method"), "count").groupBy("run_set", "from_class", "from_method", "to_class", "to_method").agg(F.sum("count").alias("count"))


def relevant_edges(edges: DataFrame, selected: DataFrame, targets: DataFrame, most: int = 2500) -> DataFrame:
    """Edges at selected classes and into runtime targets (run_set, class each), the heaviest ``most``."""
    at = lambda df, c: edges.join(df.withColumnRenamed("class", c), ["run_set", c], "left_semi")
    every = at(selected, "from_class").unionByName(at(selected, "to_class")).unionByName(at(targets, "to_class")).distinct()
    w = Window.partitionBy("run_set").orderBy(F.desc("count"), "from_class", "to_class")
    return every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def influence_findings(nodes: DataFrame, most: int = 60) -> DataFrame:
    """The classes with the largest scores, with the number of their severity in the run set."""
    w = Window.partitionBy("run_set").orderBy(F.desc("score"), "class")
    n = nodes.groupBy("run_set", "severity").agg(F.count(F.lit(1)).alias("same_severity"))
    return nodes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).join(n, ["run_set", "severity"]).select("run_set", "class", "score", "severity", "rank", "same_severity")


#: The statistical methods, what they need and what they give.
METHODS = [("robust", 5, "median, MAD, trimmed mean, bootstrap interval"), ("cliffs_delta", 20, "effect size"), ("change_points", 6, "sliding medians"), ("autocorrelation", 12, "lags"), ("spectrum", 12, "peaks"),
           ("network_loops", 12, "periodic bursts"), ("integrals", 1, "areas"), ("states", 2, "transitions"), ("explanation_graph", 1, "paths")]

"""Inspection of a stream, kept as mergeable partial states in one versioned table.

A family (A01-A17, Q03 and Q04) says what has to be remembered of its rows: keys, sums, least and largest numbers, the
rows seen first and last by ``ord``, and, where a percentile is asked for, how often each value occurred.  All of that
merges by sum, min and max, so any split of the events into batches, in any order, gives the rows of one pass.  All
families share one layout, so a batch is one union and one shuffle, and the table one set of files.

``StateTable`` is that table in a folder: a batch writes ``batch=N`` (running it again replaces it), and ``compact`` merges
the last version with all batches since into ``base=N``; a version counts once Spark has marked it as complete, so a
reader or a restarted job never sees half of one.  What a version has taken in is deleted one compaction later.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetpulse.functions.numbers import counter_delta, int_div, share
from fleetpulse.operators import inspect as op
from fleetpulse.streaming.windows import latest_snapshots

SUMS, LOWS, TOPS = 8, 2, 3
NUMBERS = [f"s{i}" for i in range(SUMS)] + [f"l{i}" for i in range(LOWS)] + [f"t{i}" for i in range(TOPS)]
STATE = ", ".join(["family string", "key string", "value bigint", *[f"s{i} bigint" for i in range(SUMS)], *[f"l{i} double" for i in range(LOWS)], *[f"t{i} double" for i in range(TOPS)],
                   "first struct<ord:bigint,row:string>", "last struct<ord:bigint,row:string>"])


@dataclass(frozen=True)
class Family:
    """What is remembered of ``rows``; ``final`` makes the result of columns of these names (and ``value``, first_x, last_x)."""

    rows: Callable[[dict[str, DataFrame]], DataFrame]
    keys: list[str]
    final: Callable[[DataFrame], DataFrame]
    sums: dict[str, str] = field(default_factory=dict)
    lows: dict[str, str] = field(default_factory=dict)
    tops: dict[str, str] = field(default_factory=dict)
    first: dict[str, str] = field(default_factory=dict)
    last: dict[str, str] = field(default_factory=dict)
    value: str | None = None
    types: dict[str, str] = field(default_factory=dict)

    def partial(self, name: str, views: dict[str, DataFrame]) -> DataFrame:
        """One row for each input row, in the layout of the table."""
        none = lambda kind: F.lit(None).cast(kind)
        some = lambda given, n, kind, p: [(F.expr(list(given.values())[i]).cast(kind) if i < len(given) else none(kind)).alias(f"{p}{i}") for i in range(n)]
        seen = lambda given: F.struct(F.col("ord").cast("bigint").alias("ord"), F.to_json(F.struct(*given)).alias("row")) if given else none("struct<ord:bigint,row:string>")
        return self.rows(views).select(
            F.lit(name).alias("family"), F.to_json(F.struct(*self.keys), {"ignoreNullFields": "false"}).alias("key"), (F.col(self.value) if self.value else F.lit(None)).cast("bigint").alias("value"),
            *some(self.sums, SUMS, "bigint", "s"), *some(self.lows, LOWS, "double", "l"), *some(self.tops, TOPS, "double", "t"), seen(self.first).alias("first"), seen(self.last).alias("last"))

    def named(self, name: str, state: DataFrame) -> DataFrame:
        """The family's merged rows under their own names."""
        schema = lambda given: ", ".join(f"`{c}` {t}" for c, t in given.items())
        keys = schema({k: self.types.get(k, "string") for k in self.keys})
        out = state.filter(F.col("family") == name).withColumn("_k", F.from_json("key", keys))
        at = lambda given, p, kind: [F.col(f"{p}{i}").cast(self.types.get(c, kind)).alias(c) for i, c in enumerate(given)]
        row = lambda given, which: [F.from_json(f"{which}.row", schema(given))[c].alias(f"{which}_{c}") for c in given]
        return out.select(*[F.col("_k")[k].alias(k) for k in self.keys], "value", *at(self.sums, "s", "bigint"), *at(self.lows, "l", "bigint"), *at(self.tops, "t", "bigint"),
                          F.col("first.ord").alias("first_ord"), F.col("last.ord").alias("last_ord"), *row(self.first, "first"), *row(self.last, "last"))


def merged(state: DataFrame) -> DataFrame:
    """One row for each family, key and value: what partial rows or partial states add up to."""
    return state.groupBy("family", "key", "value").agg(
        *[F.sum(f"s{i}").alias(f"s{i}") for i in range(SUMS)], *[F.min(f"l{i}").alias(f"l{i}") for i in range(LOWS)], *[F.max(f"t{i}").alias(f"t{i}") for i in range(TOPS)],
        F.min("first").alias("first"), F.max("last").alias("last"))


def ranked(by: list[str], p: float, name: str) -> Column:
    """For use over columns value, n and ``upto``, ``all``: the nearest-rank percentile."""
    return F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * p), F.col("value"))).alias(name)


def with_ranks(rows: DataFrame, by: list[str], n: str) -> DataFrame:
    """Adds how many of a key's rows have a value up to this one, and how many there are; null values count as none."""
    known = F.when(F.col("value").isNotNull(), F.col(n)).otherwise(0)
    w = Window.partitionBy(*by)
    return rows.withColumns({"upto": F.sum(known).over(w.orderBy(F.col("value").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0)), "all": F.sum(known).over(w)})


def _sum(*names: str) -> list[Column]:
    return [F.sum(c).alias(c) for c in names]


def _run_totals(d: DataFrame) -> DataFrame:
    return d.groupBy("run_set").agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("logs"), F.sum(F.col("to") - F.col("at")).alias("duration_ms"))


def _http_totals(d: DataFrame) -> DataFrame:
    return with_ranks(d, ["run_set"], "n").groupBy("run_set").agg(F.sum("n").alias("http_count"), F.sum("failed").alias("http_failed"), ranked([], 0.95, "http_p95_ms"))


def _routes(d: DataFrame) -> DataFrame:
    by = ["run_set", "route"]
    r = with_ranks(d, by, "n").groupBy(*by).agg(
        F.sum("n").alias("count"), F.sum("failures").alias("failures"), ranked(by, 0.5, "p50_ms"), ranked(by, 0.95, "p95_ms"), F.max("value").alias("max_ms"),
        F.sum(F.col("value") * F.col("n")).alias("total"), F.min_by("first_owner", "first_ord").alias("owner_sample"))
    return r.withColumn("avg_ms", int_div(F.col("total"), F.col("count"))).drop("total")


def _shares(d: DataFrame) -> DataFrame:
    return d.withColumn("jank_pct", F.round(share(F.col("jank"), F.col("frames")), 6)).withColumn("avg_fps", F.round(share(F.col("frames"), F.col("window_ms"), 1000.0), 6))


def _screens(d: DataFrame) -> DataFrame:
    return _shares(d).drop("value", "first_ord", "last_ord")


def _ui_totals(d: DataFrame) -> DataFrame:
    return _shares(d.groupBy("run_set").agg(*_sum("windows", "window_ms", "frames", "jank"), F.min("min_fps").alias("min_fps")))


def _flows(d: DataFrame) -> DataFrame:
    by = ["run_set", *op.CONTEXT]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    top = lambda c, name: F.coalesce(F.max(c), F.lit(0)).alias(name)
    return with_ranks(d, by, "http").groupBy(*by).agg(
        total("http"), total("failed"), F.coalesce(ranked(by, 0.95, "x"), F.lit(0)).alias("http_p95_ms"), total("stall"), total("windows"), total("frames"), total("jank"), total("spam"), total("problems"),
        top("problem_max", "problem_max_ms"), top("pss", "pss_kb"))


def _gauges(d: DataFrame) -> DataFrame:
    mode = F.col("last_mode")
    value = F.when(mode == "average", int_div(F.col("total"), F.col("samples"))).when(mode == "boolean", int_div(F.col("total") * 100, F.col("samples"))).otherwise(F.col("last_v"))
    return d.select("run_set", "name", mode.alias("mode"), value.alias("value"), "max", "samples")


def _traffic(d: DataFrame) -> DataFrame:
    return d.groupBy("run_set").agg(*[F.sum(counter_delta(F.col(f"last_{c}"), F.col(f"first_{c}"))).alias(f"{c}_bytes") for c in ("rx", "tx")])


def _quality(d: DataFrame) -> DataFrame:
    last = d.groupBy("run_set", "session_id").agg(F.max_by(F.struct("accepted", "written"), "segment_index").alias("l"))
    counters = F.create_map(F.lit("accepted"), F.col("l.accepted"), F.lit("written"), F.col("l.written"))
    return last.select("run_set", F.explode(counters).alias("counter", "value")).groupBy("run_set", "counter").agg(F.sum("value").alias("value"))


def _plain(*columns: str) -> Callable[[DataFrame], DataFrame]:
    return lambda d: d.select(*columns)


def _owner_rows(v: dict[str, DataFrame]) -> DataFrame:
    one = F.lit(1)
    part = lambda df, kind, owner, value, n, stack: df.select("run_set", F.col(owner).alias("owner"), F.lit(kind).alias("kind"), F.col(value).alias("v"), n.alias("n"), stack.alias("stack"), "ord")
    none = F.lit(None).cast("string")
    return (part(v["http"], "http", "owner", "dur", one, none).unionByName(part(v["stalls"], "main_thread_stall", "owner", "dur", one, F.col("stack")))
            .unionByName(part(v["retained"], "retained_object", "class", "age_ms", F.col("n"), none)))


def _flow_rows(v: dict[str, DataFrame]) -> DataFrame:
    one = F.lit(1)
    names = ["http", "failed", "http_ms", "stall", "windows", "frames", "jank", "spam", "problems", "problem_max", "pss"]
    part = lambda df, **values: df.select("run_set", *op.CONTEXT, *[values.get(n, F.lit(None)).cast("bigint").alias(n) for n in names])
    parts = [part(v["http"], http=one, failed=F.col("failed").cast("int"), http_ms=F.col("dur")), part(v["ui"], windows=one, frames=F.col("frames"), jank=F.col("jank")), part(v["stalls"], stall=one),
             part(v["spam"], spam=F.col("n")), part(v["device"], pss=F.col("pss_kb")), part(v["problems"], problems=F.col("n"), problem_max=F.col("max_ms"))]
    return reduce(DataFrame.unionByName, parts)


CTX = ["run_set", *op.CONTEXT]

#: By query: what each family remembers.
FAMILIES: dict[str, Family] = {
    "a01_run_totals": Family(lambda v: v["events"], ["run_set", "source"], _run_totals, sums={"n": "1"}, lows={"at": "time_ms"}, tops={"to": "time_ms"}),
    "a02_http_totals": Family(lambda v: v["http"], ["run_set"], _http_totals, sums={"n": "1", "failed": "int(failed)"}, value="dur"),
    "a03_route_stats": Family(lambda v: v["http"], ["run_set", "route"], _routes, sums={"n": "1", "failures": "int(failed)"}, first={"owner": "string"}, value="dur"),
    "a04_screen_stats": Family(lambda v: v["ui"].withColumn("fps", F.col("frames") * 1000.0 / F.col("window_ms")), ["run_set", "screen"], _screens, types={"min_fps": "double"},
                               sums={"windows": "1", "window_ms": "window_ms", "frames": "frames", "jank": "jank"}, lows={"min_fps": "if(fps > 0, fps, null)"}, tops={"max_p95_ms": "p95_ms", "max_p99_ms": "p99_ms"}),
    "a05_ui_totals": Family(lambda v: v["ui"].withColumn("fps", F.col("frames") * 1000.0 / F.col("window_ms")), ["run_set"], _ui_totals, types={"min_fps": "double"},
                            sums={"windows": "1", "window_ms": "window_ms", "frames": "frames", "jank": "jank"}, lows={"min_fps": "if(fps > 0, fps, null)"}),
    "a06_owner_stats": Family(_owner_rows, ["run_set", "owner", "kind"], lambda d: d.select("run_set", "owner", "kind", "count", "total_ms", "max_ms", F.col("first_stack").alias("stack")),
                              sums={"count": "n", "total_ms": "v"}, tops={"max_ms": "v"}, first={"stack": "string"}),
    "a07_stall_totals": Family(lambda v: v["stalls"], ["run_set"], _plain("run_set", "stall_count", "stall_max_ms"), sums={"stall_count": "1"}, tops={"stall_max_ms": "dur"}),
    "a08_flow_stats": Family(_flow_rows, CTX, _flows, value="http_ms", sums={c: c for c in ("http", "failed", "stall", "windows", "frames", "jank", "spam", "problems")}, tops={"problem_max": "problem_max", "pss": "pss"}),
    "a09_log_spam": Family(lambda v: v["spam_named"], [*CTX, "log_source", "level"], _plain(*CTX, "log_source", "level", "count", "windows"), sums={"count": "n", "windows": "1"}),
    "a10_problem_stats": Family(lambda v: v["problems"], [*CTX, "kind"], _plain(*CTX, "kind", "windows", "count", "window_ms", "max_ms"), sums={"windows": "1", "count": "n", "window_ms": "window_ms"}, tops={"max_ms": "max_ms"}),
    "a11_runtime_calls": Family(lambda v: v["calls"], [*CTX, "caller", "callee"], _plain(*CTX, "caller", "callee", "count", "total_ms", "max_ms"), sums={"count": "n", "total_ms": "total_ms"}, tops={"max_ms": "dur"}),
    "a12_counters": Family(lambda v: v["metrics"].filter("mode = 'counter'"), ["run_set", "name"], lambda d: d.select("run_set", "name", F.col("total").alias("value")), sums={"total": "v"}),
    "a13_gauges": Family(lambda v: v["metrics"].filter("mode <> 'counter'").withColumn("times", F.greatest(F.col("n"), F.lit(1))), ["run_set", "name"], _gauges,
                         sums={"total": "v * times", "samples": "times"}, tops={"max": "v"}, last={"mode": "string", "v": "bigint"}),
    "a14_device_context": Family(lambda v: v["device"], ["run_set"], lambda d: d.select("run_set", F.col("last_battery").alias("battery"), F.col("last_network").alias("network"), F.col("last_ram_kb").alias("ram_kb"), "min_battery", "min_ram_kb", "low_memory", "contexts"),
                                 sums={"low_memory": "int(low_memory)", "contexts": "1"}, lows={"min_battery": "nullif(battery, 0)", "min_ram_kb": "nullif(ram_kb, 0)"},
                                 last={"battery": "int", "network": "string", "ram_kb": "bigint"}, types={"min_battery": "int"}),
    "a15_memory": Family(lambda v: v["device"], ["run_set"], _plain("run_set", "samples", "max_pss_kb"), sums={"samples": "1"}, tops={"max_pss_kb": "pss_kb"}),
    "a16_traffic": Family(lambda v: v["device"], ["run_set", "source"], _traffic, first={"rx": "bigint", "tx": "bigint"}, last={"rx": "bigint", "tx": "bigint"}),
    "a17_retained_by_class": Family(lambda v: v["retained"], ["run_set", "class"], _plain("run_set", "class", "count", "max_age_ms"), sums={"count": "n"}, tops={"max_age_ms": "age_ms"}),
    "a17_retained_by_age": Family(lambda v: v["retained"].withColumn("age", op.age_bucket(F.col("age_ms"))), ["run_set", "age"], _plain("run_set", "age", "count"), sums={"count": "n"}),
    "q04_quality_totals": Family(lambda v: v["segments"], ["run_set", "session_id", "segment_index"], _quality, sums={"accepted": "accepted", "written": "written"}, types={"segment_index": "bigint"}),
}


def partials(views: dict[str, DataFrame]) -> DataFrame:
    """The partial state of one batch, all families in one shuffle; views as ``streaming_views`` names them."""
    return merged(reduce(DataFrame.unionByName, (f.partial(name, views) for name, f in FAMILIES.items())))


def result(state: DataFrame, name: str) -> DataFrame:
    return FAMILIES[name].final(FAMILIES[name].named(name, state))


class StateTable:
    """Partial states in a folder, by batch, with compacted versions; ``merge`` makes one state of several."""

    def __init__(self, spark: SparkSession, path: str, schema: str = STATE, merge: Callable[[DataFrame], DataFrame] = merged) -> None:
        self.spark, self.path, self.schema, self.merge = spark, path.rstrip("/"), schema, merge
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _complete(self, kind: str) -> list[int]:
        if not self._fs.exists(self._hadoop(self.path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._hadoop(self.path))]
        numbers = [int(m[1]) for n in names if (m := re.fullmatch(rf"{kind}=(\d+)", n))]
        return sorted(n for n in numbers if self._fs.exists(self._hadoop(f"{self.path}/{kind}={n}/_SUCCESS")))

    def folders(self) -> list[str]:
        """The last complete version and the complete batches after it."""
        bases = self._complete("base")
        done = bases[-1] if bases else -1
        return [f"{self.path}/base={n}" for n in bases[-1:]] + [f"{self.path}/batch={n}" for n in self._complete("batch") if n > done]

    def add(self, number: int, state: DataFrame) -> None:
        """A batch's state; a batch that is run again replaces its own, one that a version has taken in is known."""
        if number > max(self._complete("base"), default=-1):
            state.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def read(self) -> DataFrame:
        parts = [self.spark.read.schema(self.schema).parquet(f) for f in self.folders()]
        return self.merge(reduce(DataFrame.unionByName, parts)) if parts else self.spark.createDataFrame([], self.schema)

    def compact(self) -> None:
        """A new version of all complete batches; the version before it stays for readers, what that one had taken in goes."""
        batches = self._complete("batch")
        bases = self._complete("base")
        if not batches or batches[-1] <= max(bases, default=-1):
            return
        self.read().write.mode("overwrite").parquet(f"{self.path}/base={batches[-1]}")
        for kind, known in (("base", bases[:-1]), ("batch", [b for b in batches if bases and b <= bases[-1]])):
            for n in known:
                self._fs.delete(self._hadoop(f"{self.path}/{kind}={n}"), True)


def inspect_stream(events: DataFrame, views: Callable[[DataFrame], dict[str, DataFrame]], path: str, every: int = 20):
    """The job: each micro-batch of raw events adds its partial states to the table at ``path``; each ``every`` it is compacted."""
    def add(batch: DataFrame, number: int) -> None:
        table = StateTable(batch.sparkSession, path)
        batch.persist()
        try:
            table.add(number, partials(views(batch)))
        finally:
            batch.unpersist()
        if number % every == every - 1:
            table.compact()

    return events.writeStream.foreachBatch(add)


#: What is known of a file's segment.
SEGMENT = "source string, sequence bigint, bytes bigint, sealed boolean"


def snapshot_table(spark: SparkSession, path: str) -> StateTable:
    """The last known row of each file; a later read of a file that has grown supersedes its open row."""
    return StateTable(spark, path, SEGMENT, latest_snapshots)


def follow_snapshots(segments: DataFrame, path: str, every: int = 20):
    """W20 as a job over a stream of segment rows; a batch that is run again changes nothing."""
    def add(batch: DataFrame, number: int) -> None:
        table = snapshot_table(batch.sparkSession, path)
        table.add(number, latest_snapshots(batch.select(*[c.split()[0] for c in SEGMENT.split(", ")])))
        if number % every == every - 1:
            table.compact()

    return segments.writeStream.foreachBatch(add)

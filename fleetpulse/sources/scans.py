"""Scans and sinks of telemetry files: S01-S04, S06, S07, S09, S13, S16, S19; problem datasets are in ``datasets``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Versions of the side files.
VERSIONS = {"owner_map": 4, "class_graph": 1, "diagnostics": 1, "di_catalog": 1}
EVENT = "type int, delta_us bigint, flags bigint, thread_id bigint, chunk_seq int, rec_ix int, segment_start_us bigint, context struct<screen:string,owner:string,flow:string,step:string>, payload string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event lines with their file; blank lines are skipped, a line that is no JSON fails the read."""
    rows = spark.read.schema(EVENT).option("mode", "FAILFAST").json(path)
    return rows.withColumn("source", F.col("_metadata.file_path"))


def with_times(events: DataFrame) -> DataFrame:
    """Elapsed time of each record from its segment's start and the deltas so far; a negative one is an error."""
    w = Window.partitionBy("source", "chunk_seq").orderBy("rec_ix").rowsBetween(Window.unboundedPreceding, 0)
    us = F.col("segment_start_us") + F.sum(F.coalesce("delta_us", F.lit(0))).over(w)
    checked = F.when(us >= 0, us).otherwise(F.raise_error(F.lit("negative event time")).cast("bigint"))
    return events.withColumn("time_us", checked).withColumn("time_ms", F.expr("time_us div 1000"))


def with_context(events: DataFrame, same_flag: int) -> DataFrame:
    """Records that say "same context" take the last explicit one of their chunk."""
    w = Window.partitionBy("source", "chunk_seq").orderBy("rec_ix").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("flags").bitwiseAND(same_flag) != 0
    explicit = F.when(~same, F.col("context"))
    return events.withColumn("context", F.when(same, F.last(explicit, ignorenulls=True).over(w)).otherwise(F.col("context")))


def versioned(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of a side file whose format number is the known one; another or none is an error."""
    good = F.col("format") == VERSIONS[kind]
    return rows.filter(F.when(F.coalesce(good, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"unknown {kind} format")).cast("boolean"))).drop("format")


def read_owner_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, owner, symbolNamespace) of lines {format, kind, symbolNamespace, id, owner, name, value}."""
    rows = versioned(spark.read.schema("format int, kind string, symbolNamespace string, id string, owner string, name string, value string").json(path), "owner_map")
    named = F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in ("owner", "name", "value")])
    space = F.first(F.when(F.col("kind") == "metadata", F.col("symbolNamespace")), ignorenulls=True).over(Window.partitionBy(F.col("_file")))
    rows = rows.withColumn("_file", F.col("_metadata.file_path")).withColumn("space", space).filter("id is not null")
    ok = F.col("id").rlike("^stable:0x[0-9a-f]{16}$")
    return rows.select(F.when(ok, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("bad stable id "), "id"))).alias("id"), named.alias("owner"), F.col("space").alias("namespace"))


def read_name_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(obfuscated, original) of lines ``original -> obfuscated:``; indented member lines are ignored."""
    line = F.col("value")
    parts = r"^(\S.*?)\s+->\s+(\S+):\s*$"
    return spark.read.text(path).filter(line.rlike(parts)).select(F.regexp_extract(line, parts, 2).alias("obfuscated"), F.regexp_extract(line, parts, 1).alias("original"))


def read_class_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges of lines {format, class, edges[]}; self edges go, a count of 0 is 1."""
    rows = versioned(spark.read.schema("format int, class string, edges array<struct<caller:string,calleeClass:string,calleeMethod:string,count:bigint>>").json(path), "class_graph")
    e = rows.select(F.regexp_replace("class", "/", ".").alias("from_class"), F.explode("edges").alias("e"))
    out = e.select("from_class", F.regexp_replace("e.calleeClass", "/", ".").alias("to_class"), F.col("e.caller").alias("caller_method"), F.col("e.calleeMethod").alias("callee_method"),
                   F.greatest(F.coalesce("e.count", F.lit(0)), F.lit(1)).alias("count"))
    return out.filter("from_class <> to_class")


#: One line for each class: S09.
DIAGNOSTICS = """format int, class string, methods int, ignoredMethods int, annotatedMethods int, skippedMethods array<struct<reason:string,count:bigint>>, hooks array<struct<intent:string,signature:string,bridge:string,method:string,line:int,count:bigint>>,
  decisions array<struct<kind:string,module:string,family:string,reason:string,method:string,line:int,count:bigint>>, annotations array<struct<owner:string,screen:string,flow:string,trace:string,count:bigint>>"""


def known_keys(text: Column, schema: str, what: str) -> Column:
    """The text, or an error that names the keys of its JSON object which the schema doesn't have."""
    names = F.array(*[F.lit(c) for c in T.StructType.fromDDL(schema).names])
    more = F.array_except(F.map_keys(F.from_json(text, "map<string,string>")), names)
    return F.when(F.size(more) > 0, F.raise_error(F.concat(F.lit(f"unknown keys in {what}: "), F.array_join(more, ", "))).cast("string")).otherwise(text)


def read_diagnostics(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Build diagnostics by class; with ``strict`` a key that isn't known is an error, else it is ignored."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    text = known_keys(F.col("value"), DIAGNOSTICS, "diagnostics") if strict else F.col("value")
    return versioned(lines.select(F.from_json(text, DIAGNOSTICS, {"mode": "FAILFAST"}).alias("r")).select("r.*"), "diagnostics")


def diagnostic_records(diagnostics: DataFrame) -> DataFrame:
    """S09 as E01 takes it: one row (dimension, the keys of all dimensions, count) for each skipped method, hook, decision and annotation."""
    dims = {"skipped": ("skippedMethods", ["reason"]), "hook": ("hooks", ["intent", "signature", "bridge", "method"]), "decision": ("decisions", ["kind", "module", "family", "reason", "method"]), "annotation": ("annotations", ["owner", "screen", "flow", "trace"])}
    keys = list(dict.fromkeys(k for _, ks in dims.values() for k in ks))
    parts = [diagnostics.select(F.col("class"), F.inline(c)).select("class", F.lit(name).alias("dimension"), *[(F.col(k) if k in ks else F.lit(None).cast("string")).alias(k) for k in keys], "count") for name, (c, ks) in dims.items()]
    return reduce(DataFrame.unionByName, parts)


LEAK_LIMITS = ["max_candidate_total", "max_new", "max_worse", "max_high", "max_runtime_only", "fail_on_new", "fail_on_worse", "fail_on_new_high", "require_heap_for_high"]
THRESHOLDS = ("max_severity string, min_confidence string, require_clean_cohorts boolean, metrics map<string,struct<max_severity:string,max_regression_abs:double,max_regression_pct:double>>, leaks struct<"
              + ",".join(f"{c}:{'int' if c.startswith('max') else 'boolean'}" for c in LEAK_LIMITS) + ">")


def read_thresholds(spark: SparkSession, path: str | None, strict: bool = False) -> DataFrame:
    """One row of the gate's limits; no path is a row without limits, a document that is no such object fails."""
    if not path:
        return spark.range(1).select(F.from_json(F.lit("{}"), THRESHOLDS).alias("r")).select("r.*")
    text = known_keys(F.col("value"), THRESHOLDS, "thresholds") if strict else F.col("value")
    return spark.read.text(path, wholetext=True).select(F.from_json(text, THRESHOLDS, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def metric_limits(thresholds: DataFrame) -> DataFrame:
    """S13 as V06 takes it: metric ('*' for all), max_severity, max_abs, max_pct."""
    every = thresholds.select(F.lit("*").alias("metric"), F.nullif("max_severity", F.lit("")).alias("max_severity"), F.lit(None).cast("double").alias("max_abs"), F.lit(None).cast("double").alias("max_pct"))
    own = thresholds.select(F.explode("metrics").alias("metric", "m")).select("metric", F.nullif("m.max_severity", F.lit("")).alias("max_severity"), F.col("m.max_regression_abs").alias("max_abs"), F.col("m.max_regression_pct").alias("max_pct"))
    return every.unionByName(own)


def leak_limits(thresholds: DataFrame) -> dict[str, int]:
    """S13 as V07 takes it; the one row's leak limits by name without ``max_``."""
    row = thresholds.select(*[F.coalesce(F.col("leaks")[c].cast("int"), F.lit(0)).alias(c.removeprefix("max_")) for c in LEAK_LIMITS]).first()
    return {c: v for c, v in row.asDict().items() if v}


def event_lines(events: DataFrame) -> DataFrame:
    """Each event as one line of JSON, fields in the columns' order, without those that are null; ``read_events`` reads them."""
    return events.select(F.to_json(F.struct(*[c for c in events.columns if c != "source"])).alias("value"))


def write_events(events: DataFrame, path: str) -> None:
    event_lines(events).write.text(path)


def write_results(results: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One dataset for each result table."""
    for name, df in results.items():
        df.write.format(fmt).save(f"{path}/{name}")


def flat_lists(df: DataFrame, separator: str = "|") -> DataFrame:
    """Lists as joined text and structs as dotted columns, ready for CSV."""
    def columns(c: str, kind: str) -> list[Column]:
        if kind.startswith("array<string"):
            return [F.array_join(c, separator).alias(c.replace(".", "_"))]
        if kind.startswith("struct"):
            inner = df.select(f"{c}.*").dtypes
            return [x for n, k in inner for x in columns(f"{c}.{n}", k)]
        if kind.startswith(("array", "map")):
            return [F.to_json(c).alias(c.replace(".", "_"))]
        return [F.col(c).alias(c.replace(".", "_"))]

    return df.select(*[x for c, k in df.dtypes for x in columns(c, k)])

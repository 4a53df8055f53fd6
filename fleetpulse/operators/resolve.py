"""Joins that resolve names and select inputs: S14, S15, J01, J02, J05, J06, S04, S05."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.operators.leaks import normal_evidence

#: What may follow an obfuscated prefix.
BOUNDARIES = [".", "$", "#", " ", "(", "[", ":"]


def latest_sessions(logs: DataFrame) -> DataFrame:
    """Per process the logs of the latest (day, index); all of them on ties."""
    w = Window.partitionBy("process_name").orderBy(F.desc("day"), F.desc("ix"))
    return logs.withColumn("r", F.rank().over(w)).filter("r = 1").drop("r")


def overlap(events: DataFrame, key: str) -> DataFrame:
    """Sources that stand in both run sets; a comparison needs none."""
    seen = events.groupBy(key).agg(F.max(F.col("run_set") == "baseline").alias("b"), F.max(F.col("run_set") == "candidate").alias("c"))
    return seen.filter("b and c").select(key)


def symbols_as_of(refs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The definition of an id in the same source that was valid at the reference, else ``id:<n>``.

    One window over the union of both sides: an as-of join without pairs.
    """
    both = refs.select("source", "ord", "id", F.lit(None).cast("string").alias("value"), F.lit(1).alias("side")).unionByName(dictionary.select("source", "ord", "id", "value", F.lit(0).alias("side")))
    w = Window.partitionBy("source", "id").orderBy("ord", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("symbol", F.last("value", ignorenulls=True).over(w)).filter("side = 1")
    return found.select("source", "ord", "id", F.coalesce("symbol", F.concat(F.lit("id:"), F.col("id").cast("string"))).alias("symbol"))


def deobfuscate(values: DataFrame, col: str, mapping: DataFrame) -> DataFrame:
    """Exact names first, else the longest obfuscated prefix that ends at a boundary.

    Prefixes of a value that end at a boundary are listed and joined by equality, so there is no theta join.
    """
    keyed = values.withColumn("_ends", F.sequence(F.lit(1), F.length(col)))
    is_end = lambda i: (i == F.length(col)) | F.substr(F.col(col), i + 1, F.lit(1)).isin(*BOUNDARIES)
    prefixes = keyed.select(col, F.explode(F.transform(F.filter("_ends", is_end), lambda i: F.substr(F.col(col), F.lit(1), i))).alias("obfuscated")).distinct()
    best = prefixes.join(mapping, "obfuscated").groupBy(col).agg(F.max_by(F.struct("obfuscated", "original"), F.length("obfuscated")).alias("m"))
    j = values.join(best, col, "left")
    plain = F.when(F.col("m").isNotNull(), F.concat("m.original", F.substr(F.col(col), F.length("m.obfuscated") + 1))).otherwise(F.col(col))
    return j.withColumn("plain", plain).drop("m")


def renamed(rows: DataFrame, mapping: DataFrame, *columns: str) -> DataFrame:
    """J05 on several columns at once: their distinct values are resolved together and joined back."""
    values = reduce(DataFrame.unionByName, [rows.select(F.col(c).alias("value")) for c in columns]).filter("value is not null").distinct()
    names = deobfuscate(values, "value", mapping)
    for c in columns:
        rows = rows.join(names.select(F.col("value").alias(c), F.col("plain").alias(f"_{c}")), c, "left").withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    return rows


def plain_class_graph(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """A class graph (run_set, from_class, to_class, count) under original names; edges that become one are merged,
    those of a class to itself go."""
    out = renamed(edges, mapping, "from_class", "to_class").filter("from_class <> to_class")
    return out.groupBy("run_set", "from_class", "to_class").agg(F.sum("count").cast("bigint").alias("count"))


def plain_heap_evidence(leaks: DataFrame, mapping: DataFrame) -> DataFrame:
    """Heap evidence (class, holder, field, root, path) under original names, steps of paths included; the chain's
    fingerprint is computed again from them.

    Paths are taken apart, their distinct names resolved with all others, and put together in their order.
    """
    keyed = leaks.withColumn("_id", F.xxhash64(*[F.col(c) for c in leaks.columns if c != "path"], F.to_json("path")))
    steps = keyed.select("_id", F.posexplode("path").alias("at", "s")).distinct().select("_id", "at", F.col("s.class").alias("step_class"), "s")
    paths = renamed(steps, mapping, "step_class").groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("step_class").alias("class"), F.col("s.field").alias("field"), F.col("s.kind").alias("kind")))),
                                                                                     lambda x: F.struct(x["class"].alias("class"), x["field"].alias("field"), x["kind"].alias("kind"))).alias("_path"))
    out = renamed(keyed.join(paths, "_id", "left").withColumn("path", F.coalesce("_path", "path")).drop("_path", "_id"), mapping, "class", "holder", "field", "root")
    return normal_evidence(out.withColumn("fingerprint", F.lit("")))


def owner_conflicts(maps: DataFrame) -> DataFrame:
    """Ids that merged owner maps give two names."""
    return maps.groupBy("id").agg(F.count_distinct("owner").alias("owners")).filter("owners > 1")


def stable_names(refs: DataFrame, embedded: DataFrame, owners: DataFrame) -> DataFrame:
    """A stable id's name from its own file, else from the owner map of the same namespace, else null."""
    own = refs.join(embedded.withColumnRenamed("name", "own_name"), ["source", "id"], "left")
    return own.join(owners.withColumnRenamed("owner", "map_name"), ["namespace", "id"], "left").withColumn("name", F.coalesce("own_name", "map_name")).drop("own_name", "map_name")

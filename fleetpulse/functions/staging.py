"""Cutting lineage in iterative operators: written tables in the folder all executors share, and their end."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Setting that names the run whose folder and tables are being filled.
RUN = "spark.fleetpulse.run"
_tables: dict[str, list[str]] = {}


def staging_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without that setting (tests) a temporary folder, but only on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.fleetpulse.staging", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="fleetpulse-")
        spark.conf.set("spark.fleetpulse.staging", root)
    return root.rstrip("/")


def run_path(spark: SparkSession, root: str) -> str:
    """``root``, or the current run's folder in it."""
    run = spark.conf.get(RUN, None)
    return f"{root}/run-{run}" if run else root


def remember_table(spark: SparkSession, name: str) -> None:
    """A table that goes with the current run."""
    if run := spark.conf.get(RUN, None):
        _tables.setdefault(run, []).append(name)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[None]:
    """All that operators stage inside goes when the block ends, with its tables; results have to be written by then."""
    was, run = spark.conf.get(RUN, None), uuid.uuid4().hex
    spark.conf.set(RUN, run)
    try:
        yield
    finally:
        spark.conf.set(RUN, was) if was else spark.conf.unset(RUN)
        for name in _tables.pop(run, []):
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{staging_root(spark)}/run-{run}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below spark.checkpoint.dir and read it back; without that setting (tests) below a temporary folder."""
    spark = df.sparkSession
    path = f"{run_path(spark, staging_root(spark))}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Incremental inspection: any split into batches, runs again, versions and a stream give the rows of one pass."""

import glob

import pytest
from pyspark.sql import functions as F

from fleetpulse.catalog import QUERIES
from fleetpulse.plans.stream_queries import views
from fleetpulse.streaming.incremental import FAMILIES, StateTable, inspect_stream, partials, result

DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.select(*sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def one_pass(spark):
    return {name: rows(QUERIES[name](spark, DIR)) for name in FAMILIES}


def check(table, one_pass, names=None):
    state = table.read().persist()
    for name in names or FAMILIES:
        assert rows(result(state, name)) == one_pass[name], name
    state.unpersist()


def test_splits_reruns_and_versions(spark, tmp_path, one_pass):
    raw = spark.read.parquet(f"{DIR}/events.parquet")
    table = StateTable(spark, f"file://{tmp_path}/state")
    assert table.read().count() == 0
    cuts = [F.col("event_id") % 7 == 3, F.col("event_id") < 300, F.lit(True)]
    left, batches = raw, []
    for c in cuts:
        batches.append(left.filter(c))
        left = left.filter(~c)
    table.add(1, partials(views(batches[1])))  # out of order
    table.add(0, partials(views(batches[0])))
    table.add(0, partials(views(batches[0])))  # run again
    table.compact()
    assert [f.rsplit("/", 1)[1] for f in table.folders()] == ["base=1"]
    table.add(1, partials(views(batches[1])))  # the version has it already
    table.add(2, partials(views(batches[2])))
    check(table, one_pass)
    table.compact()
    table.compact()  # nothing new
    assert [f.rsplit("/", 1)[1] for f in table.folders()] == ["base=2"]
    assert sorted(p.rsplit("/", 1)[1] for p in glob.glob(f"{tmp_path}/state/*")) == ["base=1", "base=2", "batch=2"]
    check(table, one_pass, ["a03_route_stats", "a13_gauges", "a16_traffic"])


def test_stream_job(spark, tmp_path, one_pass):
    raw = spark.read.parquet(f"{DIR}/events.parquet")
    src, path = str(tmp_path / "src"), f"file://{tmp_path}/state"
    raw.repartition(5, "user_id").write.parquet(src)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 2).parquet(src)
    q = inspect_stream(stream, views, path, every=2).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    check(StateTable(spark, path), one_pass, ["a01_run_totals", "a08_flow_stats", "a14_device_context", "q04_quality_totals"])


def test_half_a_version_is_not_read(spark, tmp_path):
    table = StateTable(spark, f"file://{tmp_path}/state")
    state = partials(views(spark.read.parquet(f"{DIR}/events.parquet").limit(50)))
    table.add(0, state)
    (tmp_path / "state" / "base=5").mkdir()
    (tmp_path / "state" / "batch=3").mkdir()
    assert [f.rsplit("/", 1)[1] for f in table.folders()] == ["batch=0"]

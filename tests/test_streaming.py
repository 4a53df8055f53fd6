import datetime as dt

from pyspark.sql import functions as F

from fleetpulse.streaming import windows as w

T0 = dt.datetime(2024, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)


def run(spark, tmp_path, rows, schema, job, name, extra_ts=1000):
    """A job over a file stream that gets a far later row at last, so that all windows close."""
    src = str(tmp_path / name)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = job(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-ck")).start()
    q.processAllAvailable()
    late = [tuple(at(extra_ts) if isinstance(v, dt.datetime) else (10 ** 9 if isinstance(v, int) and c == "object_id" else v) for c, v in zip(spark.read.parquet(src).columns, rows[-1]))]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_metric_windows(spark, tmp_path):
    rows = [(1, at(0), "counter", "m", 3), (1, at(1), "counter", "m", 4), (1, at(2), "counter", "m", -1), (1, at(6), "counter", "m", 5)]
    schema = "process_id bigint, ts timestamp, kind string, name string, value bigint"
    got = run(spark, tmp_path, rows, schema, w.metric_windows, "metrics")
    assert sorted((r["sum"], r["count"], r["invalid"]) for r in got) == [(5, 1, 0), (7, 2, 1)]
    batch = w.metric_windows(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["sum"], r["count"]) for r in batch) == [(5, 1), (7, 2)]


def test_retained_objects(spark, tmp_path):
    watched = spark.createDataFrame([(1, at(0), "A"), (2, at(0), "B"), (3, at(1), "C")], "object_id bigint, ts timestamp, class string")
    cleared = spark.createDataFrame([(1, at(3)), (2, at(9))], "object_id bigint, ts timestamp")
    assert sorted(r["class"] for r in w.retained_objects(watched, cleared).collect()) == ["B", "C"]


def test_watches_count_once_and_groups_are_capped(spark, tmp_path):
    schema = "object_id bigint, ts timestamp, class string, owner string, process_id bigint, evidence string"
    rows = [(1, at(0), "A", "x", 1, "confirmed"), (1, at(1), "A", "x", 1, "confirmed"), (2, at(2), "A", "x", 1, "time_only"), (3, at(3), "B", "x", 1, "confirmed"), (4, at(4), "C", "x", 1, "confirmed"), (5, at(4), "C", "x", 1, "gc_requested")]
    job = lambda df: w.retained_groups(w.retained_objects(df, spark.createDataFrame([(4, at(5))], "object_id bigint, ts timestamp") if not df.isStreaming else df.filter("false").select("object_id", "ts")), 2)
    got = [tuple(r)[2:] for r in job(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("A", "x", 2, "time_only"), ("B", "x", 1, "confirmed"), (None, None, 1, None)]))
    one = spark.createDataFrame(rows, schema)
    assert sorted(r["object_id"] for r in w.first_watches(one).collect()) == [1, 2, 3, 4, 5]
    seen = run(spark, tmp_path, rows, schema, w.first_watches, "watches")
    assert sorted(r["object_id"] for r in seen if r["object_id"] < 10 ** 9) == [1, 2, 3, 4, 5]


def test_call_graph_counts_edges_and_mismatches(spark):
    rows = [(1, 1, 0, 0, "enter", 10), (1, 1, 5, 1, "enter", 20), (1, 1, 8, 2, "exit", 20), (1, 1, 9, 3, "enter", 20), (1, 1, 12, 4, "exit", 20), (1, 1, 13, 5, "exit", 99)]
    got = w.call_graph(spark.createDataFrame(rows, "process_id bigint, thread_id bigint, ms bigint, ord bigint, op string, method_id bigint")).collect()
    assert sorted(map(str, [(r["caller"], r["callee"], r["count"], r["total_ms"], r["max_ms"]) for r in got])) == ["(10, 20, 2, 6, 3)", "(None, None, 1, 0, 0)"]


def test_projections(spark):
    df = spark.createDataFrame([(1, 0, 0, False), (0, 31, 999, False), (0, 32, 1000, True)], "jank int, p95_ms int, duration_ms int, failed boolean")
    got = df.select(w.ui_problem().alias("a"), w.slow_request().alias("b"), w.wrapped_problem().alias("c")).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (False, False, True), (True, True, True)]
    assert df.filter(F.col("jank") > 5).count() == 0

"""Steps by worked cases; batches against plain loops; streams (late, idle, restarted) against batches."""

import random

import pytest
from pyspark.sql import functions as F

from fleetpulse.streaming import steps as st
from fleetpulse.streaming.stateful import follow, replay

IDLE = 100_000


def walked(step, rows, idle=IDLE):
    """Rows (key, ms, ord, ...) through the step, key by key."""
    out = []
    for key in sorted({r[0] for r in rows}):
        state, last = step.start(), None
        for r in sorted((r[1:] for r in rows if r[0] == key), key=lambda r: r[:2]):
            if last is not None and r[0] - last > idle:
                out += [(key, *x) for x in step.end(state)]
                state = step.start()
            state, more = step.add(state, r)
            out += [(key, *x) for x in more]
            last = r[0]
        out += [(key, *x) for x in step.end(state)]
    return out


def test_call_stack_never_guesses():
    rows = [(0, 0, "enter", 1), (1, 1, "enter", 2), (2, 2, "enter", 3), (5, 3, "exit", 3), (6, 4, "enter", 4), (7, 5, "exit", 1), (8, 6, "exit", 9), (9, 7, "enter", 1), (9, 8, "enter", 1), (12, 9, "exit", 1), (13, 10, "exit", 8)]
    assert [r[1:] for r in walked(st.Calls(), [(1, *r) for r in rows])] == [
        (5, 2, 3, 3, False), (7, None, 1, None, True), (8, None, 9, None, True), (12, 1, 1, 3, False), (13, None, 8, None, True)]


def test_http_call_pairs_first_in_first_out():
    p = [(0, "call", "start", "", 0, False), (1, "dns", "start", "h", 0, False), (2, "dns", "start", "h", 0, False), (5, "dns", "end", "h", 0, False), (9, "dns", "end", "h", 0, True),
         (10, "connect", "start", "a", 0, False), (14, "connect", "end", "a", 0, False), (15, "connect", "start", "b", 0, False), (20, "first_byte", "end", "", 7, False), (30, "call", "end", "", 5, False), (31, "first_byte", "end", "", 99, True)]
    rows = [(1, ms, i, *x) for i, (ms, *x) in enumerate(p)] + [(2, 0, 0, "call", "start", "", None, False)]
    assert walked(st.HttpCalls(), rows) == [(1, 0, 30, 11, 4, 20, 12, 2, False, True, False), (2, 0, None, 0, 0, 0, None, 0, True, False, True)]


def test_window_keys_are_capped_by_first_sight():
    rows = [(1, 0, 0, "a", 3), (1, 1, 1, "b", 1), (1, 2, 2, "c", 9), (1, 3, 3, "a", 4), (1, 4, 4, "c", 1), (1, 5, 5, "a", -1), (1, 5001, 6, "c", 2)]
    assert walked(st.CappedWindows(keys=2), rows) == [(1, 0, "a", 7, 2, 4, 0, 0), (1, 0, "b", 1, 1, 1, 0, 0), (1, 0, None, 0, 0, None, 2, 1), (1, 5000, "c", 2, 1, 2, 0, 0)]


def test_samples_are_kept_on_change():
    step = st.Samples({"pss_kb": 4096, "battery": 2}, ["network"], ["low"])
    rows = [(1, 0, 0, 1, 50, "wifi", False), (1, 10, 1, 4000, 51, "wifi", False), (1, 20, 2, 4097, 51, "wifi", False), (1, 30, 3, 4097, 51, None, False), (1, 40, 4, 4097, 51, None, True), (1, 60_039, 5, 4097, 52, None, False), (1, 60_040, 6, 4097, 52, None, False)]
    assert [r[1] for r in walked(step, rows)] == [0, 20, 30, 40, 60_040]


def test_stalls_and_dispatches_and_scopes():
    assert walked(st.Stalls(), [(1, 0, 0), (1, 699, 1), (1, 1399, 2), (1, 1399 + IDLE + 1, 3)]) == [(1, 699, 700)]
    lines = [(0, ">>>>> Dispatching to Handler {a} x: 1"), (5, "other"), (30, "<<<<< Finished to Handler"), (31, "<<<<< Finished"), (40, ">>>>> Dispatching soon"), (41, ">>>>> Dispatching to  Looper: y"), (60, "<<<<< Finished")]
    assert walked(st.Dispatches(), [(1, ms, i, x) for i, (ms, x) in enumerate(lines)]) == [(1, 0, 30, "Handler"), (1, 41, 19, "Looper")]
    ops = [("start", "f"), ("step", "a"), ("start", "g"), ("end", None), ("end", None), ("end", None)]
    assert [r[3:] for r in walked(st.Scopes(), [(1, i, i, *o) for i, o in enumerate(ops)])] == [("f", ""), ("f", "a"), ("g", ""), ("f", "a"), ("", ""), ("", "")]


def of(step, seed):
    """Rows of four keys; one key's rows have a silence longer than the idle time."""
    rnd = random.Random(seed)
    make = {
        st.Frames: lambda: (rnd.choice("AB"), rnd.randint(5, 90), rnd.random() < 0.2), st.Calls: lambda: (rnd.choice(["enter", "exit"]), rnd.randint(1, 3)),
        st.HttpCalls: lambda: (rnd.choice(["dns", "connect", "first_byte", "call", "dns", "connect"]), rnd.choice(["start", "end"]), rnd.choice("hk"), rnd.choice([None, 3]), rnd.random() < 0.1),
        st.Stalls: lambda: (), st.Dispatches: lambda: (rnd.choice([">>>>> Dispatching to X", "<<<<< Finished", "?"]),), st.Samples: lambda: (rnd.randint(0, 9000), rnd.choice(["wifi", None]), rnd.random() < 0.1),
        st.Scopes: lambda: (rnd.choice(["start", "step", "end"]), rnd.choice("fgh")), st.CappedWindows: lambda: (rnd.choice("abcd"), rnd.randint(-1, 9)), st.Deltas: lambda: (rnd.randint(0, 99), rnd.randint(0, 9)), st.Changes: lambda: (rnd.choice(["x", "y", None]),),
    }[type(step)]
    rows = [(k, 10_000 + i * rnd.choice([37, 410, 900]), i, *make()) for k in range(4) for i in range(40)]
    return rows + [(3, 400_000 + 50 * i, 100 + i, *make()) for i in range(5)]


TYPES = {"screen": "string", "duration_ms": "bigint", "is_jank": "boolean", "op": "string", "method_id": "bigint", "phase": "string", "part": "string", "key": "string", "bytes": "bigint", "failed": "boolean", "line": "string",
         "pss_kb": "bigint", "network": "string", "low": "boolean", "name": "string", "value": "bigint", "a": "bigint", "b": "bigint", "context": "string"}
STEPS = [st.Frames(), st.Calls(), st.HttpCalls(), st.Stalls(), st.Dispatches(), st.Samples({"pss_kb": 4096}, ["network"], ["low"]), st.Scopes(), st.CappedWindows(keys=3), st.Deltas(["a", "b"]), st.Changes()]


def schema(step):
    return ", ".join(["process_id bigint", "ms bigint", "ord bigint", *[f"{c} {TYPES[c]}" for c in step.columns]])


@pytest.mark.parametrize("step", STEPS, ids=lambda s: type(s).__name__)
def test_batch_equals_loop(spark, step):
    rows = of(step, 1)
    got = replay(spark.createDataFrame(rows, schema(step)).repartition(3), ["process_id"], step, IDLE)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, walked(step, rows)))
    assert replay(spark.createDataFrame([], schema(step)), ["process_id"], step).count() == 0


def state_rows(query):
    return query.lastProgress.stateOperators[0].numRowsTotal if query.lastProgress.stateOperators else 0


@pytest.mark.parametrize("step", STEPS[:7], ids=lambda s: type(s).__name__)
def test_stream_equals_batch(spark, tmp_path, step):
    """Rows in four shuffled files; the query is stopped and started again after the second one."""
    rows = of(step, 2)
    rnd = random.Random(7)
    parts = [[r for r in rows if r[1] < 25_000], [r for r in rows if 25_000 <= r[1] < 60_000], [r for r in rows if r[1] >= 60_000]]
    src, name = str(tmp_path / "src"), f"follow_{type(step).__name__.lower()}"
    filler = lambda ms: [(99, ms, 0, *[None if TYPES[c] == "string" else False if TYPES[c] == "boolean" else 0 for c in step.columns])]
    spark.createDataFrame(rows[:1], schema(step)).limit(0).write.parquet(src)

    def add(batch):
        rnd.shuffle(batch)
        spark.createDataFrame(batch, schema(step)).coalesce(1).write.mode("append").parquet(src)

    def start(part):
        out = follow(spark.readStream.schema(schema(step)).parquet(src), ["process_id"], step, "10 seconds", IDLE).filter("process_id < 99")
        return out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).queryName(f"{name}{part}").start()

    q = start(0)
    add(parts[0])
    q.processAllAvailable()
    add(parts[1])
    q.processAllAvailable()
    held = state_rows(q)
    q.stop()
    q = start(1)  # from the checkpoint
    add(parts[2])
    q.processAllAvailable()
    add([(0, 11_000, 999, *parts[0][0][3:])] + filler(10_000_000))  # a row far behind the watermark, and silence
    q.processAllAvailable()
    q.processAllAvailable()
    dropped = sum(o.numRowsDroppedByWatermark for p in q.recentProgress for o in p.stateOperators)
    left = state_rows(q)
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = replay(spark.createDataFrame(rows, schema(step)), ["process_id"], step, IDLE)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert dropped >= 1 and held > 0
    assert left <= 2  # only the filler's key is left
    assert got.filter(F.col("process_id") == 3).count() > 0 or type(step) in (st.Stalls, st.Dispatches)

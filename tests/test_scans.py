import json

import pytest

from fleetpulse.sources import scans


def write(tmp_path, name, lines):
    p = tmp_path / name
    p.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(p)


def test_event_lines(spark, tmp_path):
    ctx = {"screen": "A", "owner": "o", "flow": "f", "step": "s"}
    p = write(tmp_path, "e.json", [{"type": 2, "delta_us": 1500, "flags": 0, "chunk_seq": 0, "rec_ix": 0, "segment_start_us": 1000, "context": ctx, "extra": 1}, "",
                                   {"type": 3, "delta_us": -500, "flags": 1, "chunk_seq": 0, "rec_ix": 1, "segment_start_us": 1000}])
    e = scans.with_context(scans.with_times(scans.read_events(spark, p)), 1).orderBy("rec_ix").collect()
    assert [(r["time_us"], r["time_ms"], r["context"]["screen"]) for r in e] == [(2500, 2, "A"), (2000, 2, "A")]
    bad = write(tmp_path, "bad.json", ["{no json"])
    with pytest.raises(Exception):
        scans.read_events(spark, bad).collect()


def test_side_files(spark, tmp_path):
    owners = write(tmp_path, "o.json", [{"format": 4, "kind": "metadata", "symbolNamespace": "ab"}, {"format": 4, "id": "stable:0x0123456789abcdef", "name": " Feed "}])
    assert [tuple(r) for r in scans.read_owner_map(spark, owners).collect()] == [("stable:0x0123456789abcdef", "Feed", "ab")]
    old = write(tmp_path, "old.json", [{"format": 3, "id": "stable:0x0123456789abcdef", "name": "x"}])
    with pytest.raises(Exception):
        scans.read_owner_map(spark, old).collect()
    mapping = write(tmp_path, "m.txt", ["# note", "com.x.Feed -> a.b:", "    int f -> c", "com.x.Other -> c:"])
    assert sorted(tuple(r) for r in scans.read_name_mapping(spark, mapping).collect()) == [("a.b", "com.x.Feed"), ("c", "com.x.Other")]
    graph = write(tmp_path, "g.json", [{"format": 1, "class": "a/A", "edges": [{"caller": "f", "calleeClass": "a/B", "calleeMethod": "g", "count": 0}, {"caller": "f", "calleeClass": "a/A", "calleeMethod": "h", "count": 2}]}])
    assert [tuple(r) for r in scans.read_class_graph(spark, graph).collect()] == [("a.A", "a.B", "f", "g", 1)]


def test_flat_lists(spark):
    df = spark.sql("SELECT 1 AS a, array('x', 'y') AS l, named_struct('p', 2, 'q', array('z')) AS s")
    assert scans.flat_lists(df).collect()[0].asDict() == {"a": 1, "l": "x|y", "s_p": 2, "s_q": "z"}

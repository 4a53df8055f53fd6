"""Conversation repair against enumeration, a string program and SQL."""

import hashlib
import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from fleetpulse.llm import conversation_repair as cr
from fleetpulse.llm.queries import ORACLES, op12_conversation_repair

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, gone_ string, kind int"


def enumerated(rows):
    """(cost, audit) over all edit scripts with up to two inserts before each message and at the end."""
    best = None
    gaps = ["", "u", "a", "ua", "au", "uu", "aa"]
    choices = [[("D", 4, None)] + ([] if kind in (1, 2) else [("K", 3 * (kind == 3), role[:1]), ("R", 3 + 3 * (kind == 3), "u"), ("R", 3 + 3 * (kind == 3), "a")]) for kind, role in rows]
    for picks in itertools.product(*choices):
        for fills in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, roles = 3 * sum(map(len, fills)), "", ""
            for fill, (letter, price, role) in zip(fills, picks):
                audit += "I" * len(fill) + letter
                roles += fill + (role or "" if letter != "D" else "")
                cost += price
            roles, audit = roles + fills[-1], audit + "I" * len(fills[-1])
            state = 0
            for r in roles:
                state = NEXT.get((state, r))
                if state is None:
                    break
            ok = state in (0, 3) and not any(p[0] == "K" and not p[2] for p in picks)
            if ok and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def by_strings(rows):
    """Backward program over (message, state) with the audits as strings."""
    after = {q: min((3 * len(f), "I" * len(f)) for f, to in cr_fills(q) if to in (0, 3)) for q in range(4)}
    for kind, role in reversed(rows):
        now = {}
        for q in range(4):
            ways = []
            for fill, mid in cr_fills(q):
                head = (3 * len(fill), "I" * len(fill))
                outs = [("D", 4, mid)]
                if kind in (0, 3):
                    outs += [("K", 3 * (kind == 3), NEXT[mid, role[:1]])] if (mid, role[:1]) in NEXT else []
                    outs += [("R", 3 + 3 * (kind == 3), NEXT[mid, r]) for r in "ua" if (mid, r) in NEXT]
                ways += [(head[0] + cost + after[to][0], head[1] + letter + after[to][1]) for letter, cost, to in outs]
            now[q] = min(ways)
        after = now
    return after[0]


def cr_fills(q):
    return {0: [("", 0), ("u", 2), ("ua", 3)], 1: [("", 1), ("u", 2), ("ua", 3)], 2: [("", 2), ("a", 3)], 3: [("", 3), ("u", 2)]}[q]


def run(rows):
    repair = cr.Repair()
    for kind, role in rows:
        repair.add(kind, role, "x")
    return repair.end()[:2]


def test_integers_decide_as_enumeration():
    kinds = [(k, r) for k in (0, 1, 3) for r in ("system", "user", "assistant", "tool")]
    rnd = random.Random(3)
    cases = [()] + [(k,) for k in kinds] + [tuple(rnd.choices(kinds, k=2)) for _ in range(60)] + [tuple(rnd.choices(kinds, k=3)) for _ in range(12)]
    for case in cases:
        assert run(case) == enumerated(case), case


@pytest.mark.parametrize("n", [5, 63, 64, 65, 129, 400])
def test_long_conversations_cross_blocks(n):
    for seed in range(6):
        rnd = random.Random(seed * 1000 + n)
        rows = [(rnd.choice((0, 0, 0, 1, 2, 3)), rnd.choice(("system", "user", "user", "assistant", "assistant", "", "Übel"))) for _ in range(n)]
        assert run(rows) == by_strings(rows)


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (None, 0, "user", "Who?"), (None, None, None, None), (2, None, "user", "a."), (2, 5, "user", "a."), (2, 5, "user", "a."),
            (3, 0, "assistant", " \n"), (4, 1, "", "x."), (4, 2, "user", "no end  \t"), (5, 7, "system", "Only."), (6, 0, "user", "ü" * 200_000 + "?"), (6, 3, "assistant", "ok\x1c")]
    rnd = random.Random(5)
    rows += [(7, t, rnd.choice(["user", "assistant"]), rnd.choice(["Go.", "Stay", "", f"Turn {t}!"])) for t in range(500)]  # a hot conversation
    return spark.createDataFrame([(*r, "k", "g", 1) for r in rows], SCHEMA).repartition(4)


def told(rows):
    """Kinds by the contract's words."""
    blank, seen, out = " \t\n\x0b\x0c\r", set(), []
    for _, role, text in rows:
        core = text.strip(blank)
        out.append(1 if not core else 2 if (role, text) in seen else 0 if core[-1] in ".!?" else 3)
        seen.add((role, text))
    return out


def test_report_and_messages(spark, hard):
    report = cr.repair_conversations(hard)
    got = {r["conv_id"]: r for r in report.collect()}
    by = {}
    for r in hard.collect():
        by.setdefault(r["conv_id"], []).append((r["turn"], " " if r["role"] is None else r["role"], " " if r["text"] is None else r["text"]))
    assert set(got) == set(by)
    messages = {}
    for r in cr.repaired_messages(hard, report).collect():
        messages.setdefault(r["conv_id"], []).append((r["position"], f"{r['role']}:{r['text']}"))
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        kinds, row = told(rows), got[conv]
        turns = {t for t, _, _ in rows if t is not None}
        assert row["gaps"] == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        assert (row["blank"], row["duplicate"], row["truncated"]) == tuple(kinds.count(k) for k in (1, 2, 3))
        assert row["illegal"] == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        assert (row["cost"], row["audit"]) == by_strings([(k, r[1]) for k, r in zip(kinds, rows)])
        text = "\n".join(m for _, m in sorted(messages.get(conv, [])))
        assert row["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_damage_names_every_conversation(spark, hard):
    import zlib

    got = {}
    for r in cr.damaged(hard.filter("conv_id is null or conv_id < 7")).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"], r["gone"]))
    for r in hard.filter("conv_id is null or conv_id < 7").collect():
        fault = zlib.crc32(f"{' ' if r['conv_id'] is None else r['conv_id']}:{' ' if r['turn'] is None else r['turn']}".encode()) % 20
        role, text = ("user" if fault == 4 else " " if r["role"] is None else r["role"]), (" " if r["text"] is None else r["text"])
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        assert got[r["conv_id"], r["turn"]].count((role, text, fault == 0)) >= (2 if fault == 3 else 1)
    assert cr.repair_conversations(cr.damaged(hard)).count() == 8


def test_no_rows_after_damage_and_empty_table(spark, hard):
    gone = cr.damaged(hard.limit(1)).withColumn("gone", F.lit(True))
    row = cr.repair_conversations(gone).first()
    assert tuple(row)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert cr.repair_conversations(cr.damaged(hard.limit(0))).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    rel = con.sql(ORACLES["op12_conversation_repair"])
    df = op12_conversation_repair(spark, d)
    assert df.columns == rel.columns
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())

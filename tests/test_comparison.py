"""Leak comparison, confidence, gate and scorecard by worked cases."""

import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import compare, evidence, leaks, verdict

SCHEMA = "run_set string, class string, holder string, screen string, flow string, step string, chain string, score double, count bigint, max_age_ms bigint, retained_kb bigint, evidence string, severity string"


def side(run_set, name, screen, score, chain=None, holder="x.H", evidence="time_only", severity="medium", count=1):
    return run_set, name, holder, screen, "f", "s", chain, score, count, 100, 10, evidence, severity


@pytest.fixture(scope="module")
def deltas(spark):
    rows = [side("baseline", "x.A", "Feed", 5.0, "c1", evidence="confirmed_path"), side("candidate", "x.A", "List", 5.0, "c1", evidence="confirmed_path"),  # one chain over two screens
            side("baseline", "x.B", "Feed", 5.0), side("candidate", "X.b", "Feed", 9.0),  # names match but for case
            side("baseline", "x.C", "Feed", 5.0), side("candidate", "x.C", "Feed", 5.0, evidence="confirmed_path"), side("candidate", "x.D", "Feed", 3.0, "c2", evidence="confirmed_path", severity="high"),
            side("baseline", "x.E", "Feed", 3.0), side("baseline", "x.F", "Feed", 4.0), side("candidate", "x.F", "Feed", 4.0), side("baseline", "x.G", "Feed", 4.0, holder=""), side("candidate", "x.G", "Feed", 4.0, holder=""),
            side("candidate", "x.A", "Other", 4.0, "c1", evidence="time_only", count=9)]  # the weaker place of c1 doesn't stand for it
    return leaks.match_confidence(evidence.leak_compare(spark.createDataFrame(rows, SCHEMA)))


def test_chains_match_over_screens(deltas):
    got = {r["fingerprint"]: (r["status"], r["match"]) for r in deltas.collect()}
    assert got == {"chain|c1": ("same", "high_heap_chain"), "x.b|x.h|feed|f|s": ("worse", "low_fallback"), "x.c|x.h|feed|f|s": ("same", "low_evidence_differs"), "chain|c2": ("new", "medium_chain_one_side"),
                   "x.e|x.h|feed|f|s": ("resolved", "medium_one_side"), "x.f|x.h|feed|f|s": ("same", "medium_class_holder"), "x.g||feed|f|s": ("same", "low_class_only")}
    cut = leaks.match_confidence(deltas.drop("match").withColumn("c_degraded", F.lit(True)))
    assert {r["match"] for r in cut.collect()} == {"low_degraded"}


def test_confidence_is_capped_by_quality(spark):
    totals = spark.createDataFrame([("baseline", 9, 900), ("candidate", 6, 600)], "run_set string, logs bigint, events bigint")
    level = lambda *ls: compare.comparison_confidence(totals, spark.createDataFrame([(str(i), x) for i, x in enumerate(ls)], "run_set string, level string")).first()[0]
    assert [level("high", "high"), level("high", "medium"), level("low", "high"), level("", None), level()] == ["high", "medium", "low", "high", "high"]


def test_gate_of_the_comparison(spark):
    d = spark.createDataFrame([("m", "medium"), ("n", "medium")], "metric string, confidence string")
    cohorts = spark.createDataFrame([("network",), ("sdk",)], "dimension string")
    rows = lambda *a: sorted(tuple(r) for r in compare.comparison_gate(d, cohorts, *a).collect())
    assert rows("high", True) == [("cohort_mismatch", "network"), ("cohort_mismatch", "sdk"), ("confidence", "medium")]
    assert rows("medium", False) == [] and rows(None, False) == [] and rows("low", True)[0][0] == "cohort_mismatch"
    assert compare.comparison_gate(d.limit(0), cohorts, "high", False).count() == 0


FACTS = {"confidence": "high", "baseline_quality": "high", "candidate_quality": "high", "cohort_warnings": 0, "quality_warnings": 0, "baseline_logs": 9, "candidate_logs": 9, "leaks": 4, "unknown_holder": 1, "user_owned": 2, "max_age_ms": 10, "heap_confirmed": 2,
         "with_field": 2, "with_path": 2, "with_alternatives": 0, "explained": 4, "deltas": 4, "high_match": 2, "medium_match": 1}


def card(spark, **changes):
    facts = {**FACTS, **changes}
    rows = verdict.scorecard(spark.createDataFrame([tuple(facts.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'bigint'}" for k, v in facts.items()))).collect()
    return {r["area"]: r["score"] for r in rows}, rows[0]["total"], rows[0]["decision"], rows[0]["next_actions"]


def test_scorecard_decides_before_rounding(spark):
    """9 * 20 + 7.3 * 20 + 6 * 20 + 6.1 * 15 + 10 * 15 + 10 * 10 = 787.5 of 100: 7.875 shows as 7.9."""
    scores, total, decision, actions = card(spark)
    assert scores == {"data_quality": 9.0, "retained_signal": 7.3, "heap_actionability": 6.0, "compare_stability": 6.1, "gate_readiness": 10.0, "readability": 10.0}
    assert (total, decision, actions) == (7.9, "qa_only", "")
    # 7.3 and 6.7 there: 803.5 would be go; a total of 7.95 or more shows as 8.0 and still isn't
    scores, total, decision, _ = card(spark, with_alternatives=0, high_match=3, medium_match=0)
    assert scores["compare_stability"] == 6.6 and total == 8.0 and decision == "qa_only"
    assert card(spark, high_match=4, medium_match=0)[1:3] == (8.1, "go")
    assert card(spark, candidate_quality="low", heap_confirmed=0, with_field=0, with_path=0, cohort_warnings=1)[2:] == ("blocked", "resolve_candidate_quality|align_cohorts|collect_heap_evidence")

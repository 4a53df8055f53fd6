"""Every registered telemetry query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from fleetpulse import catalog

DIR = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("events", "pages", "documents", "lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(rows):
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 5) if isinstance(v, float) else v
    return sorted((str([clean(v) for v in r]) for r in rows))


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLES])
def test_matches_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, DIR)
    rel = db.sql(catalog.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == kinds
    at = [rel.columns.index(c) for c in cols]
    assert plain(tuple(r) for r in df.select(*cols).collect()) == plain(tuple(r[i] for i in at) for r in rel.fetchall())


#: No SQL: resampling, spectra, shortest paths over any number of hops, and what depends on the order of arrival.
NO_SQL = {"r04_bootstrap_p95", "d05_spectral_peaks", "d06_periodic_report", "g05_shortest_paths", "n08_loops", "n09_loop_compare", "c03_changes_nearby", "g02_loop_edges", "g05_explanation_paths", "g06_all_paths",
          "g08_graph_compare", "h05_reference_paths", "h06_alternative_paths", "s21_owner_map", "w01_frame_windows", "w05_call_graph", "w12_kept_samples", "w14_flow_scopes"}


def test_every_query_has_sql_or_a_reason():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == NO_SQL

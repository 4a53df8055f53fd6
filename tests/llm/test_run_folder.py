"""A run's folder and tables go with it."""

import glob

import pytest

from fleetpulse.functions.staging import run_folder
from fleetpulse.llm.common import shared_dir, stage
from fleetpulse.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op6_substring_dedup", "op13_vector_codes"])
def test_operators_leave_nothing(spark, tmp_path, name):
    stage(spark.range(1), "before")
    left = lambda: (set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/**", recursive=True)), {t.name for t in spark.catalog.listTables()})
    before = left()
    with run_folder(spark):
        QUERIES[name](spark, DIR).write.parquet(str(tmp_path / "out"))
    assert left() == before
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0

import glob
import os

import pytest

from fleetpulse.catalog import QUERIES
from fleetpulse.functions.staging import cut, run_folder, staging_root

DIR = "/root/testdata/sf0.001"


def files(spark):
    return set(glob.glob(f"{staging_root(spark).removeprefix('file://')}/**", recursive=True))


def test_a_run_leaves_nothing(spark, tmp_path):
    cut(spark.range(1), "before")  # makes the folder
    before = files(spark)
    with run_folder(spark):
        QUERIES["h03_retained"](spark, DIR).write.parquet(str(tmp_path / "out"))
        assert len(files(spark)) > len(before)
    assert files(spark) == before and spark.read.parquet(str(tmp_path / "out")).count() > 0
    kept = cut(spark.range(3), "after")
    assert kept.count() == 3 and len(files(spark)) > len(before)


def test_a_failed_run_leaves_nothing(spark):
    before = files(spark)
    with pytest.raises(ValueError), run_folder(spark):
        cut(spark.range(2), "x")
        with run_folder(spark):
            cut(spark.range(2), "inner")
        raise ValueError
    assert files(spark) == before and os.path.isdir(staging_root(spark).removeprefix("file://"))

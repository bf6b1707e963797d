"""Nearest-neighbour information in parts of set size: a task's rows don't grow with the table."""

import pytest
from pyspark.sql import functions as F

from lapsekit.operators import information as inf
from lapsekit.operators.rank import running_totals


def data(spark):
    rows = [(("a", "b")[i % 2] if i % 11 else None, float((i * 37) % 101) if i % 13 else None, float(i % 5)) for i in range(600)]
    return spark.createDataFrame(rows, "y string, u double, v double")


def test_small_parts_give_the_same_information(spark, monkeypatch):
    whole = {r[0]: r[1] for r in inf.neighbour_information(data(spark), ["u", "v"], "y").collect()}
    monkeypatch.setattr(inf, "PART_ROWS", 16)
    assert {r[0]: r[1] for r in inf.neighbour_information(data(spark), ["u", "v"], "y").collect()} == pytest.approx(whole, abs=1e-12)


def test_ranges_are_as_many_as_asked_for(spark):
    total = running_totals(spark.range(1000).withColumn("w", F.lit(2)), ["id"], {"t": ("w", True)}, ranges=7)
    assert total.where(F.col("t") != 2 * (F.col("id") + 1)).count() == 0
    assert total.rdd.getNumPartitions() == 7            # the window's tasks too, whatever the session's number
    assert inf.parts_of(100 * inf.PART_ROWS, spark) == 100

"""Prepared tables follow their input files month by month; replaced versions go."""

import datetime
import os
import time

from pyspark.sql import functions as F

from lapsekit import session
from lapsekit.operators.lifecycle import trailing_window
from lapsekit.sources import testdata as td
from lapsekit.sources.incremental import MONTH, NO_MONTH, manifests, refresh
from paths import SF_CHECK


def _put(spark, folder, name, rows):
    spark.createDataFrame(rows, "k long, ts timestamp_ntz").coalesce(1).write.mode("overwrite").parquet(os.path.join(folder, name))


def _at(text):
    return datetime.datetime.fromisoformat(text)


def _stamps(path):
    """Files of each month of the table, with their times."""
    out = {}
    for month in os.listdir(os.path.join(path, "data")):
        if month.startswith(MONTH):
            d = os.path.join(path, "data", month)
            out[month.split("=")[1]] = {(f, os.stat(os.path.join(d, f)).st_mtime_ns) for f in os.listdir(d) if f.endswith(".parquet")}
    return out


def test_one_new_file_rewrites_one_month(spark, tmp_path):
    src, path = str(tmp_path / "log"), str(tmp_path / "table")
    _put(spark, src, "a", [(1, _at("2024-01-05")), (2, _at("2024-02-05")), (3, None)])
    _put(spark, src, "b", [(4, _at("2024-02-06")), (5, _at("2024-03-01"))])
    _put(spark, src, "nothing", [])
    read = lambda: refresh(spark, path, src, lambda raw: raw.select((F.col("k") * 10).alias("key"), "ts"), "ts")
    rows = lambda: sorted((r.key, r[MONTH].isoformat()[:7]) for r in read().collect())
    assert rows() == [(10, "2024-01"), (20, "2024-02"), (30, NO_MONTH.isoformat()[:7]), (40, "2024-02"), (50, "2024-03")]
    before = _stamps(path)
    assert rows() and _stamps(path) == before                               # nothing new: nothing written
    time.sleep(0.02)
    _put(spark, src, "c", [(6, _at("2024-02-20"))])
    assert (60, "2024-02") in rows() and len(rows()) == 6                   # the old rows of the month are there too
    after = _stamps(path)
    assert {m for m in after if after[m] != before.get(m)} == {"2024-02-01"}
    assert len(manifests(spark, path)) == 1                                 # the replaced manifest went

    _put(spark, src, "b", [(7, _at("2024-04-01"))])                         # a changed file: its old months lose its rows
    assert rows() == [(10, "2024-01"), (20, "2024-02"), (30, NO_MONTH.isoformat()[:7]), (60, "2024-02"), (70, "2024-04")]
    assert "2024-03-01" not in _stamps(path) and _stamps(path)["2024-01-01"] == before["2024-01-01"]


def test_a_run_that_died_is_repeated(spark, tmp_path):
    """Data written, manifest not: the next run writes the same months again."""
    src, path = str(tmp_path / "log"), str(tmp_path / "table")
    _put(spark, src, "a", [(1, _at("2024-01-05"))])
    read = lambda: sorted(r.k for r in refresh(spark, path, src, lambda raw: raw, "ts").collect())
    assert read() == [1]
    kept = manifests(spark, path)
    _put(spark, src, "b", [(2, _at("2024-01-06"))])
    assert read() == [1, 2]
    os.rename(os.path.join(path, "manifest", manifests(spark, path)[0]), os.path.join(path, "manifest", kept[0]))    # the state before
    assert read() == [1, 2]


def test_an_empty_log_has_its_columns(spark, tmp_path):
    src, path = str(tmp_path / "log"), str(tmp_path / "table")
    _put(spark, src, "a", [])
    got = refresh(spark, path, src, lambda raw: raw.withColumnRenamed("k", "key"), "ts")
    assert got.columns == ["key", "ts", MONTH] and got.count() == 0


def test_a_trailing_window_skips_months(spark, tmp_path):
    src, path = str(tmp_path / "log"), str(tmp_path / "table")
    _put(spark, src, "a", [(y * 100 + m, _at(f"{y}-{m:02d}-15")) for y in (2022, 2023, 2024) for m in range(1, 13)])
    log = refresh(spark, path, src, lambda raw: raw, "ts")
    cut = trailing_window(log, "ts", 1, as_of=F.lit("2024-12-20").cast("date"), month_partition=MONTH)
    assert sorted(r.k for r in cut.collect()) == [202400 + m for m in range(1, 13)]
    scan = [x for x in cut._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    assert len(scan) == 1 and "PartitionFilters: [isnotnull(month" in scan[0]
    files = lambda d: {f.split(f"{MONTH}=")[1][:7] for f in d.inputFiles()}
    assert files(log.where(F.col(MONTH) >= F.lit("2024-11-01").cast("date"))) >= {"2024-11", "2024-12"}


def test_the_click_log_is_whole(spark):
    raw = spark.read.parquet(os.path.join(SF_CHECK, "events.parquet"))
    assert td.events_all(spark, SF_CHECK).count() == raw.count()
    assert MONTH not in td.events(spark, SF_CHECK).columns
    plan = td.events(spark, SF_CHECK)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_replaced_versions_go(spark, tmp_path):
    spark.conf.set("spark.lapsekit.tables.dir", str(tmp_path))
    try:
        for size in (1, 2, 3, 4):
            session.materialized(spark, "t", ["v1", f"/in/a:1:{size}:9"], lambda: spark.range(size))
        other = session.materialized(spark, "t", ["v1", "/in/b:1:1:9"], lambda: spark.range(7))     # the same table of another place
        assert session.materialized(spark, "t", ["v1", "/in/a:1:4:9"], lambda: spark.range(0)).count() == 4
        assert other.count() == 7
        assert len(session.children(spark, str(tmp_path))) == 2 + session.KEEP_REPLACED
        for size in (1, 2, 3):
            session.bucketed(spark, "b", [f"/in/a:1:{size}:9"], lambda: spark.range(size).withColumnRenamed("id", "k"), "k", buckets=2)
        assert len([n for n in session.children(spark, str(tmp_path)) if n.startswith("b-")]) == 1 + session.KEEP_REPLACED
    finally:
        spark.conf.unset("spark.lapsekit.tables.dir")

"""Prepared tables that follow their input files month by month.

A log grows by files. ``refresh`` keeps a prepared copy of it in month partitions and a manifest of what each input file (path, length,
time) gave to which month. A run compares the files that are there with the manifest:

* months of new, changed and removed files are written anew, from all files that hold rows of them (dynamic partition overwrite);
* other months are not read and not written; a month without rows left is removed;
* the next manifest is written last, and older manifests go. A run that dies before that is repeated by the next one, with the
  same result, so a lost driver costs one run.

Only file names and months come to the driver, as in any Spark read. One writer at a time per table; readers that listed the table before
a run read it again after it. Rows without a date lie in a month of their own (``NO_MONTH``), rows of a file without any are none.
"""

from __future__ import annotations

import datetime
import hashlib
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsekit.session import children, cut_lineage, exists, input_fingerprint, remove

MONTH = "month"
NO_MONTH = datetime.date(1600, 1, 1)
_SAME = ["file", "length", "modified"]
_MANIFEST = "file string, path string, length long, modified timestamp, month date"
_LOCKS: dict[str, threading.Lock] = {}


def refresh(spark: SparkSession, path: str, source: str, prepare: Callable[[DataFrame], DataFrame], date: str, suffix: str = ".parquet",
            read: Callable[[list[str]], DataFrame] | None = None) -> DataFrame:
    """Bring the table at ``path`` up to date with the files under ``source`` and read it, partitioned by ``MONTH``.

    ``prepare`` turns raw rows into table rows, each by itself (it selects and filters); ``date`` names the date or time of a prepared
    row. ``read`` reads files by name (Parquet by default). The source has no partition columns of its own.
    """
    read = read or (lambda names: spark.read.parquet(*names))
    digest = hashlib.sha1(input_fingerprint(spark, [source])[0].encode()).hexdigest()[:16]
    with _LOCKS.setdefault(path, threading.Lock()):
        versions = manifests(spark, path)
        if not versions or not versions[-1].endswith(digest):
            _update(spark, path, source, prepare, date, suffix, read, versions, digest)
    if not children(spark, f"{path}/data"):
        return _with_month(prepare(_no_rows(spark, source, read, suffix)), date).limit(0)
    return spark.read.parquet(f"{path}/data")


def manifests(spark: SparkSession, path: str) -> list[str]:
    """Committed manifests of a table, oldest first."""
    names = [n for n in children(spark, f"{path}/manifest") if exists(spark, f"{path}/manifest/{n}/_SUCCESS")]
    return sorted(names)


def _files(spark: SparkSession, source: str, suffix: str) -> DataFrame:
    """Names, lengths and times of the input files; their content is not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(source)
    return listed.select(F.col("_metadata.file_path").alias("file"), "path", "length", F.col("modificationTime").alias("modified"))


def _no_rows(spark, source, read, suffix) -> DataFrame:
    return read([r.path for r in _files(spark, source, suffix).limit(1).collect()]).limit(0)     # one file, for its columns


def _with_month(rows: DataFrame, date: str) -> DataFrame:
    return rows.withColumn(MONTH, F.coalesce(F.trunc(F.col(date).cast("date"), "MM"), F.lit(NO_MONTH)))


def _update(spark, path, source, prepare, date, suffix, read, versions, digest) -> None:
    files = cut_lineage(_files(spark, source, suffix))
    old = spark.read.parquet(f"{path}/manifest/{versions[-1]}") if versions else spark.createDataFrame([], _MANIFEST)
    fresh = files.join(old, _SAME, "left_anti")
    gone = old.join(files, _SAME, "left_anti")
    names = [r.path for r in fresh.select("path").collect()]
    held = old.join(files, _SAME, "left_semi").select("file", "path", "length", "modified", MONTH)
    if names:                                                       # only the new files' dates are read for this
        given = _with_month(prepare(read(names)), date).select(F.col("_metadata.file_path").alias("file"), MONTH).distinct()
        held = held.unionByName(fresh.join(given, "file", "left").select(*held.columns))
    manifest = cut_lineage(held)
    touched = manifest.join(fresh.select("file"), "file", "left_semi").select(MONTH).union(gone.select(MONTH)).where(F.col(MONTH).isNotNull())
    months = [r[0] for r in touched.distinct().collect()]
    if months:
        inside = manifest.where(F.col(MONTH).isin(months))
        names = [r.path for r in inside.select("path").distinct().collect()]
        live = {r[0] for r in inside.select(MONTH).distinct().collect()}
        if names:
            rows = _with_month(prepare(read(names)), date).where(F.col(MONTH).isin(months))
            # clustered by month and then by time: a large month is split over many tasks, and a task writes few months
            (rows.repartitionByRange(MONTH, date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(MONTH).parquet(f"{path}/data"))
        for month in set(months) - live:
            remove(spark, f"{path}/data/{MONTH}={month.isoformat()}")
    number = int(versions[-1].split("-")[0]) + 1 if versions else 0
    manifest.write.mode("overwrite").parquet(f"{path}/manifest/{number:08d}-{digest}")
    for name in versions:
        remove(spark, f"{path}/manifest/{name}")

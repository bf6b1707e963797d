"""Session construction and lineage-cut helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Defaults for a session we build ourselves. A session handed to us keeps its own settings.
_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "lapsekit", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point reliable checkpoints at ``spark.checkpoint.dir``.

    The cluster names a shared folder there. Only when it is unset *and* the master is
    local (tests, laptop runs) do we create a scratch folder of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder for checkpoints")
        path = tempfile.mkdtemp(prefix="lapsekit-ckpt-")
    sc.setCheckpointDir(path)
    return path


def tables_dir(spark: SparkSession) -> str:
    """Folder of the prepared tables: ``spark.lapsekit.tables.dir``, else one beside the applications' own checkpoint
    folders under ``spark.checkpoint.dir``, so that a later application finds them again."""
    named = spark.conf.get("spark.lapsekit.tables.dir", None)
    if named:
        return named.rstrip("/")
    own = ensure_checkpoint_dir(spark).rstrip("/")
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return f"{(shared or own).rstrip('/')}/lapsekit-tables"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def _exists(spark: SparkSession, path: str) -> bool:
    """Does ``path`` exist, on whatever file system it names."""
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(conf).exists(p))
    except Exception:  # noqa: BLE001 - no JVM access (e.g. Spark Connect): fall back to a read
        try:
            spark.read.text(path).limit(0).collect()
            return True
        except Exception:  # noqa: BLE001
            return False


def exists(spark: SparkSession, path: str) -> bool:
    return _exists(spark, path)


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of whatever file system, without hidden ones; none if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return [n for n in (str(s.getPath().getName()) for s in fs.listStatus(p)) if not n.startswith(("_", "."))]


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of a prepared table."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: replaced versions of a prepared table that stay, for readers that are still at work
KEEP_REPLACED = 1


def _version(name: str, key_parts: list[str]) -> tuple[str, str]:
    """(prefix, full name) of a prepared table: the prefix names the table and where its inputs are, the full name their state as well."""
    import hashlib
    import re
    place = [re.sub(r"(:\d+){3}$", "", k) for k in key_parts]
    prefix = f"{name}-{hashlib.sha1('|'.join(place).encode()).hexdigest()[:8]}-"
    return prefix, prefix + hashlib.sha1("|".join(key_parts).encode()).hexdigest()[:16]


def drop_replaced(spark: SparkSession, prefix: str, current: str) -> list[str]:
    """Remove versions that ``current`` replaced, all but the last ``KEEP_REPLACED``; the removed names."""
    root = tables_dir(spark)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    aged = []
    for n in children(spark, root):
        if n.startswith(prefix) and n != current:
            p = fs_path(f"{root}/{n}")
            aged.append((p.getFileSystem(conf).getFileStatus(p).getModificationTime(), n))
    out = [n for _, n in sorted(aged, reverse=True)[KEEP_REPLACED:]]
    for n in out:
        remove(spark, f"{root}/{n}")
    return out


_LOCKS: dict[str, object] = {}


def materialized(spark: SparkSession, name: str, key_parts: list[str], build, rebuild: bool = False,
                 partition_by: list[str] | None = None, cluster_by: list[str] | None = None) -> DataFrame:
    """A prepared table written once as Parquet under the shared checkpoint folder and read back.

    ``key_parts`` (input paths, their sizes and times, a version) name the copy, so changed inputs
    give a new table; versions replaced earlier are removed. The write commits atomically (``_SUCCESS``); later readers get a plain
    Parquet scan with column pruning and filter pushdown instead of the whole preparation plan.
    """
    prefix, version = _version(name, key_parts)
    path = f"{tables_dir(spark)}/{version}"
    import threading
    lock = _LOCKS.setdefault(path, threading.Lock())
    with lock:  # queries run from several threads build a table once
        if rebuild or not _exists(spark, f"{path}/_SUCCESS"):
            df = build()
            if partition_by:
                # each task sorts its rows by the partition columns and ``cluster_by``, so it writes one file a partition at a time;
                # a range shuffle instead would move every row once more and run the build a second time to sample its bounds
                df = df.sortWithinPartitions(*partition_by, *(cluster_by or []))
                df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
            else:
                df.write.mode("overwrite").parquet(path)
            drop_replaced(spark, prefix, version)
    return spark.read.parquet(path)


def prepared(spark: SparkSession, name: str, key_parts: list[str]) -> DataFrame | None:
    """The table that ``materialized`` wrote for this state of the inputs; None if it was not written."""
    path = f"{tables_dir(spark)}/{_version(name, key_parts)[1]}"
    return spark.read.parquet(path) if _exists(spark, f"{path}/_SUCCESS") else None


def _table_name(version: str) -> str:
    return f"lapsekit_{version.replace('-', '_')}"


def bucketed(spark: SparkSession, name: str, key_parts: list[str], build, key: str, buckets: int | None = None, rebuild: bool = False) -> DataFrame:
    """A prepared table like ``materialized``, stored in buckets by ``key`` (``spark.lapsekit.buckets``, else as many as there are shuffle partitions):
    tables with as many buckets join on ``key`` and group by it without an exchange. A later application finds the files and names them anew."""
    buckets = buckets or int(spark.conf.get("spark.lapsekit.buckets", None) or spark.conf.get("spark.sql.shuffle.partitions"))
    prefix, version = _version(name, [*key_parts, key, str(buckets)])
    path, table = f"{tables_dir(spark)}/{version}", _table_name(version)
    import threading
    with _LOCKS.setdefault(path, threading.Lock()):
        if rebuild or not _exists(spark, f"{path}/_SUCCESS"):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
            (build().repartition(buckets, key).write.format("parquet").mode("overwrite").bucketBy(buckets, key).sortBy(key)
             .option("path", path).saveAsTable(table))
            for replaced in drop_replaced(spark, prefix, version):
                spark.sql(f"DROP TABLE IF EXISTS {_table_name(replaced)}")
        elif not spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def input_fingerprint(spark: SparkSession, paths: list[str]) -> list[str]:
    """Length and time of all files under each path, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        size = latest = n = 0
        try:
            files = path.getFileSystem(conf).listFiles(path, True)
            while files.hasNext():
                f = files.next()
                size, latest, n = size + f.getLen(), max(latest, f.getModificationTime()), n + 1
        except Exception as e:  # noqa: BLE001 - a missing input: its reader says so
            if "FileNotFound" not in str(e):
                raise
        out.append(f"{p}:{n}:{size}:{latest}")
    return out

"""Readers and writers (A1-A5)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "parquet", header: bool = True) -> DataFrame:
    """Read one table. CSV always goes through a fixed schema (no inference pass)."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", header).option("mode", "PERMISSIVE")
        if schema is None:
            raise ValueError("CSV needs a schema: type inference costs a full extra pass")
    if schema is not None and fmt != "parquet":
        reader = reader.schema(schema)
    return reader.load(path)


def _csv_safe(df: DataFrame) -> DataFrame:
    """CSV cannot hold arrays or structs: arrays become ', '-joined text (A4)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            cols.append(F.concat_ws(", ", F.array_sort(F.col(f.name).cast("array<string>"))).alias(f.name))
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Iterable[str] | None = None) -> None:
    """Write a prepared table (A2, A4). Parquet by default; ``partition_by`` gives pruning later."""
    out = _csv_safe(df) if fmt == "csv" else df
    writer = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def recast_dates(df: DataFrame, cols: Iterable[str], fmt: str | None = None) -> DataFrame:
    """Re-type date columns after a text round trip (A5). Bad text gives null, not an error."""
    def conv(c: str) -> Column:
        return F.try_to_timestamp(F.col(c), F.lit(fmt)).cast("date") if fmt else F.col(c).try_cast("date")
    return df.withColumns({c: conv(c) for c in cols})

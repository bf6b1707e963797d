"""Global running totals, ranks and quantiles without one giant partition (E5).

``Window.orderBy(...)`` without ``partitionBy`` sorts the whole table in one task. Here rows are first
range-partitioned by all order columns, in their own types. Spark samples the split points, so there are as many
ranges as shuffle partitions, and a value that a third of all rows share is split by the columns behind it. The
ranges are written to the checkpoint folder with their numbers, so every later step sees the same ones. A small table
of totals per range (one row per partition) gives each range its offset; a window inside each range does the rest.

The result equals a single global window. Ties must be broken by the caller (the order columns must identify a
row) for ``row_number``-style ranks. Nulls come first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsekit.session import cut_lineage


def running_total(df: DataFrame, order: Sequence[str], weight: str | None = None, out: str = "running",
                  inclusive: bool = True) -> DataFrame:
    """Running sum of ``weight`` (row count when ``None``) in ascending ``order``, over the whole table."""
    return running_totals(df, order, {out: (weight, inclusive)})


def running_totals(df: DataFrame, order: Sequence[str], sums: dict[str, tuple[str | None, bool]], ranges: int | None = None) -> DataFrame:
    """Several running sums in one pass: ``sums = {out: (weight column or None, inclusive)}``. ``ranges`` sets the number of ranges,
    for a caller that knows its rows: the session's own number, joined by bytes, lets a range grow with rows that pack well."""
    order = list(order)
    ranged = cut_lineage((df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)).withColumn("_rb", F.spark_partition_id()))
    ws = {o: (F.col(w) if w else F.lit(1)) for o, (w, _) in sums.items()}
    totals = ranged.groupBy("_rb").agg(*[F.sum(w).alias(f"_tot_{i}") for i, w in enumerate(ws.values())])
    before = Window.orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)      # one row per partition
    offsets = totals.select("_rb", *[F.coalesce(F.sum(f"_tot_{i}").over(before), F.lit(0)).alias(f"_off_{i}")
                                     for i in range(len(ws))])
    frame = Window.partitionBy("_rb").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if ranges:
        ranged = ranged.repartition(ranges, "_rb")      # the session's own number would bring many ranges into one task
    res = ranged.join(F.broadcast(offsets), on="_rb", how="inner")
    for i, (o, (_, inclusive)) in enumerate(sums.items()):
        w = ws[o]
        within = F.sum(w).over(frame) if inclusive else F.sum(w).over(frame) - w
        res = res.withColumn(o, F.col(f"_off_{i}") + within)
    return res.drop("_rb", *[f"_off_{i}" for i in range(len(ws))])


def rank_first(df: DataFrame, key: str, tie: str, out: str = "rank") -> DataFrame:
    """1-based rank by ``key``, ties broken by ``tie`` (pandas ``rank(method='first')`` with a
    deterministic tie order, Q4)."""
    return running_total(df, [key, tie], None, out=out).withColumn(out, F.col(out).cast("long"))


def average_ranks(values: DataFrame, value: str, count: str = "count", out: str = "avg_rank") -> DataFrame:
    """Average (mid) rank of each distinct value from a (value, count) table: ties share the mean
    of their positions, as in rank tests and ROC curves."""
    cum = running_total(values, [value], count, out="_cum")
    return cum.withColumn(out, F.col("_cum") - (F.col(count) - 1) / 2.0).drop("_cum")


def group_quantiles(df: DataFrame, group: str, value: str, probs: Sequence[float], out: str = "q") -> DataFrame:
    """(group, q): exact linear quantiles of ``value`` in each group, as one array per group.

    Values are counted first, so a value that many rows share is one row, and the values around each position are looked up by
    running count: no task holds a column. ``group`` must have a bounded number of values; nulls in ``value`` are left out.
    """
    src = df.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    counted = cut_lineage(src.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_c")))
    ranked = running_total(counted, ["_g", "_v"], "_c", out="_r")
    sizes = counted.groupBy("_g").agg(F.sum("_c").alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))     # one row per group
    at = ranked.join(F.broadcast(sizes), "_g").withColumn("_end", F.col("_r") - F.col("_before")).withColumn("_start", F.col("_end") - F.col("_c"))

    def holds(pos: Column) -> Column:
        return F.max(F.when((pos >= F.col("_start")) & (pos < F.col("_end")), F.col("_v")))

    def edge(p: float) -> Column:
        pos = F.lit(p) * (F.col("_n") - 1)
        low, high = F.floor(pos), F.ceil(pos)
        a, b = holds(low), holds(high)
        return F.when(F.max(low) == F.max(high), a).otherwise(F.max(high - pos) * a + F.max(pos - low) * b)

    return at.groupBy(F.col("_g").alias(group)).agg(F.array(*[edge(p) for p in probs]).alias(out))

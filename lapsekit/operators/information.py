"""Nearest-neighbour mutual information of continuous columns with a discrete label.

For every row the distance to its k-th nearest neighbour of the same label is found on one column, and the rows of any label
nearer than that are counted: ``digamma(n) + mean(digamma(k) - digamma(rows of the label) - digamma(rows within))``, at least 0.

One dimension needs no neighbour search. Rows are counted by (column, label, value) first, so a value that a third of the rows
share is one row. The values are ranked in that order (E5), cut into blocks with the k rows beside each block copied in, and
a value's neighbours are the k before and the k behind it. The rows within a radius come from merging two orders: the values, and the two
ends of each radius, in one running total.

Defined cases. Ties: equal values are neighbours at distance 0; a value with more than k rows of its label has radius 0, and
then the rows of equal value count, itself included. A radius over 0 is open, so the k-th neighbour itself is not within; both ends are
computed in double precision. A label with one row on a column leaves that row out; with at most k rows, k is one less than its
rows. Null and NaN values and null labels are left out, column by column. A constant column has 0, and an empty one has no row. The
estimate does not depend on the column's unit, so columns need no scaling.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsekit.operators.rank import running_totals
from lapsekit.session import cut_lineage

BLOCK = 1 << 16
PART_ROWS = 1 << 18                   #: rows of a task that sorts


def digamma(n: Column) -> Column:
    """Digamma of a whole number from 1 on: six steps up, then the asymptotic series (about 1e-10)."""
    x = n.cast("double")
    up = x + 6.0
    low = sum((1.0 / (x + float(i)) for i in range(6)), F.lit(0.0))
    inv = 1.0 / (up * up)
    return F.log(up) - 0.5 / up - inv * (F.lit(1 / 12) - inv * (F.lit(1 / 120) - inv * (F.lit(1 / 252) - inv / 240.0))) - low


def value_counts(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """(feature, label, value, n) of all columns, without the rows of a label that has one row on a column."""
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = df.selectExpr(f"`{label}` AS label", f"stack({len(cols)}, {stack}) AS (feature, value)")
    long = long.filter(F.col("label").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    counts = (long.select("feature", F.col("label").cast("string").alias("label"), (F.col("value") + F.lit(0.0)).alias("value"))
              .groupBy("feature", "label", "value").agg(F.count(F.lit(1)).alias("n")))
    sizes = counts.groupBy("feature", "label").agg(F.sum("n").alias("n_label"))
    return counts.join(sizes.filter("n_label > 1"), ["feature", "label"])


def parts_of(rows: int, spark) -> int:
    """Parts that hold at most about ``PART_ROWS`` rows each, enough for all cores."""
    return max(-(-rows // PART_ROWS), min(spark.sparkContext.defaultParallelism, -(-rows // 4096)), 1)


def label_radius(counts: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """``counts`` with ``k`` and ``radius``: the distance of each value's k-th nearest neighbour of its label."""
    order = ["feature", "label", "value"]
    parts = parts_of(counts.count(), counts.sparkSession)
    placed = running_totals(counts, order, {"at": (None, True)}, ranges=parts).withColumn("at", F.col("at") - 1)
    placed = placed.withColumns({"block": F.floor(F.col("at") / block), "inside": F.pmod("at", F.lit(block))})
    # each block sees the k rows before and behind it
    beside = F.array_compact(F.array(F.col("block"), F.when(F.col("inside") < k, F.col("block") - 1), F.when(F.col("inside") >= block - k, F.col("block") + 1)))
    seen = placed.withColumn("window", F.explode(beside)).repartition(parts, "window")
    w = Window.partitionBy("window").orderBy("at")

    def neighbour(step: int) -> Column:
        same = (F.lag("feature", step).over(w) == F.col("feature")) & (F.lag("label", step).over(w) == F.col("label"))
        return F.when(same, F.struct(F.abs(F.lag("value", step).over(w) - F.col("value")).alias("d"), F.lag("n", step).over(w).alias("n")))

    near = F.array_sort(F.array_compact(F.array(F.struct(F.lit(0.0).alias("d"), (F.col("n") - 1).alias("n")),
                                                *[neighbour(s) for i in range(1, k + 1) for s in (i, -i)])))
    seen = seen.withColumn("near", near).filter("window = block")
    own = F.least(F.lit(k), F.col("n_label") - 1)
    # the distance at which the running count of neighbours reaches k
    start = F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast("double").alias("r"))
    walk = F.aggregate("near", start, lambda s, x: F.struct((s["c"] + x["n"]).alias("c"), F.when((s["c"] < F.col("k")) & (s["c"] + x["n"] >= F.col("k")), x["d"]).otherwise(s["r"]).alias("r")))
    return seen.withColumn("k", own).withColumn("radius", walk["r"]).select("feature", "label", "value", "n", "n_label", "k", "radius")


def rows_within(values: DataFrame) -> DataFrame:
    """``values`` with ``within``: rows of any label in the open interval of the radius; at radius 0, rows of equal value."""
    rows = cut_lineage(values)
    parts = parts_of(3 * rows.count(), rows.sparkSession)
    # order at one point: an end that excludes the value, the value, an end that includes it
    mark = rows.select("feature", F.col("value").alias("x"), F.lit(1).alias("turn"), F.col("n").alias("w"), F.lit(None).cast("struct<label:string,value:double,side:int>").alias("of"))

    def end(x: Column, turn: Column, side: int) -> DataFrame:
        return rows.select("feature", x.alias("x"), turn.alias("turn"), F.lit(0).cast("long").alias("w"), F.struct("label", "value", F.lit(side).alias("side")).alias("of"))

    zero = F.col("radius") == 0
    ends = end(F.col("value") - F.col("radius"), F.when(zero, 0).otherwise(2), 0).unionByName(end(F.col("value") + F.col("radius"), F.when(zero, 2).otherwise(0), 1))
    merged = running_totals(mark.unionByName(ends).withColumns({"_l": F.col("of.label"), "_v": F.col("of.value")}),
                            ["feature", "x", "turn", "_l", "_v"], {"seen": ("w", True)}, ranges=parts).filter("of IS NOT NULL")
    merged = merged.select("feature", F.col("of.label").alias("label"), F.col("of.value").alias("value"), F.col("of.side").alias("side"), "seen")
    both = merged.repartition(parts, "feature", "label", "value").groupBy("feature", "label", "value").agg(
        (F.max(F.when(F.col("side") == 1, F.col("seen"))) - F.max(F.when(F.col("side") == 0, F.col("seen")))).alias("within"))
    return rows.repartition(parts, "feature", "label", "value").join(both, ["feature", "label", "value"])


def neighbour_information(df: DataFrame, cols: Sequence[str], label: str, k: int = 3, top: int | None = None) -> DataFrame:
    """(feature, mutual_info) in nats, with ``mi_rank`` if only the ``top`` features are asked for."""
    rows = rows_within(label_radius(cut_lineage(value_counts(df, cols, label)), k))
    mi = rows.groupBy("feature").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * (digamma(F.col("k")) - digamma(F.col("n_label")) - digamma(F.col("within")))) / F.sum("n")).alias("m"))
    mi = mi.select("feature", F.greatest(F.lit(0.0), digamma(F.col("n")) + F.col("m")).alias("mutual_info"))
    if top:
        mi = mi.withColumn("mi_rank", F.row_number().over(Window.orderBy(F.col("mutual_info").desc(), "feature"))).filter(F.col("mi_rank") <= top)   # one row per column
    return mi


def digamma_sql(n: str) -> str:
    """``digamma`` as an SQL expression."""
    up = f"(CAST({n} AS DOUBLE) + 6.0)"
    low = " + ".join(f"1.0 / (CAST({n} AS DOUBLE) + {i})" for i in range(6))
    inv = f"(1.0 / ({up} * {up}))"
    return (f"(ln({up}) - 0.5 / {up} - {inv} * ({1 / 12!r} - {inv} * ({1 / 120!r} - {inv} * ({1 / 252!r} - {inv} / 240.0))) - ({low}))")


def psi(n: int) -> float:
    """Digamma of a whole number, for tests."""
    return -0.5772156649015329 + math.fsum(1 / i for i in range(1, n))

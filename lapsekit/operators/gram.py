"""Sums of products of many columns in one pass.

``gram`` gives, for each pair of columns, count, sums, squares and product over the rows that hold both. Every task multiplies its rows in
blocks (numpy) and puts out its p (p + 1) / 2 pairs once; Spark adds them by pair. So the plan has a handful of expressions whatever the number of
columns, and the work of a row is one row of a matrix product. Values are shifted by the column's mean first, which keeps the differences of large sums exact
enough; the shift is one aggregate with an expression per column.

Nulls leave a row out of the pairs of that column only. A pair whose sums are not finite, or with a column constant on its rows, has no correlation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
#: a variance below this share of its mean square is rounding
FLAT = 1e-12
_SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]
_SCHEMA = "i int, j int, " + ", ".join(f"{c} double" for c in _SUMS)


def gram(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) of shifted values for column positions i <= j, and each column's ``shift_i``, ``shift_j``."""
    p = len(cols)
    names = [f"c{k}" for k in range(p)]
    x = df.select(*[F.col(f"`{c}`").cast("double").alias(k) for c, k in zip(cols, names)])
    means = x.agg(*[F.avg(k).alias(k) for k in names]).first()             # one number per column
    shift = np.array([means[k] if means[k] is not None and np.isfinite(means[k]) else 0.0 for k in names])
    upper = np.triu_indices(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q, xy = (np.zeros((p, p)) for _ in range(4))
        seen = False
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                there = np.column_stack([~part.column(k).is_null().to_numpy(zero_copy_only=False) for k in range(p)])
                v = np.column_stack([part.column(k).to_numpy(zero_copy_only=False) for k in range(p)]) - shift
                v[~there] = 0.0
                m = there.astype(float)
                n, s, q, xy, seen = n + m.T @ m, s + v.T @ m, q + (v * v).T @ m, xy + v.T @ v, True
        if seen:
            i, j = upper
            sums = [n[upper], s[upper], s.T[upper], q[upper], q.T[upper], xy[upper]]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *map(pa.array, sums)], ["i", "j", *_SUMS])

    if not p:
        return df.sparkSession.createDataFrame([], _SCHEMA + ", shift_i double, shift_j double")
    added = x.mapInArrow(run, _SCHEMA).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])
    of = lambda c: F.element_at(F.array(*[F.lit(float(v)) for v in shift]), F.col(c) + 1)
    return added.withColumns({"shift_i": of("i"), "shift_j": of("j")})


def covariance() -> Column:
    """Sample covariance of a ``gram`` row; null with fewer than two rows."""
    return F.try_divide(F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n")), F.when(F.col("n") > 1, F.col("n") - 1))


def correlation() -> Column:
    """Pearson correlation of a ``gram`` row; null if a column is constant on the rows of the pair."""
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    varies = (vx > F.lit(FLAT) * n * F.col("sxx")) & (vy > F.lit(FLAT) * n * F.col("syy")) & ~F.isnan(vx * vy)
    r = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.sqrt(vx) * F.sqrt(vy))
    return F.when(varies & ~F.isnan(r), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def corr_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair (i < j in the given order), long form (I7): (col_a, col_b, r)."""
    name = lambda c: F.element_at(F.array(*[F.lit(x) for x in cols]), F.col(c) + 1)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, r double")
    return gram(df, cols).where("i < j").select(name("i").alias("col_a"), name("j").alias("col_b"), correlation().alias("r"))


def moments(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, covariance matrix, correlation matrix): sized by the columns. Missing entries are 0, the diagonal of the correlations 1."""
    p = len(cols)
    mean, cov, corr = np.zeros(p), np.zeros((p, p)), np.eye(p)
    rows = gram(df, cols).select("i", "j", covariance().alias("c"), correlation().alias("r"),
                                 (F.col("shift_i") + F.try_divide("sx", "n")).alias("m")).collect()
    for x in rows:
        cov[x.i, x.j] = cov[x.j, x.i] = x.c or 0.0
        if x.i == x.j:
            mean[x.i] = x.m or 0.0
        else:
            corr[x.i, x.j] = corr[x.j, x.i] = x.r or 0.0
    return mean, cov, corr


def first_axis(cov: np.ndarray) -> np.ndarray:
    """First principal axis of a covariance matrix, its largest entry positive (Q20)."""
    vals, vecs = np.linalg.eigh(cov)
    v = vecs[:, int(np.argmax(vals))]
    return -v if v[int(np.argmax(np.abs(v)))] < 0 else v

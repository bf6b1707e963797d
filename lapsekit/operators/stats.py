"""Distributions, group tests and feature screening.

Test statistics are one-pass aggregates (moments, rank sums from value counts); only the tail
probabilities of a few numbers go through a small Arrow-batched pandas UDF, because Spark SQL has
neither ``erfc`` nor the incomplete beta function.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapsekit.operators.gram import corr_pairs
from lapsekit.operators.rank import average_ranks, group_quantiles, running_total, running_totals

# --- tail probabilities (per-row helpers on a handful of rows) ----------------------------------


def _norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0)) if z == z else float("nan")


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction for the regularised incomplete beta (modified Lentz)."""
    tiny, eps = 1e-300, 1e-15
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def _betainc(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1 - x) / b


def _t_cdf(t: float, df: float) -> float:
    if t != t or df != df or df <= 0:
        return float("nan")
    x = df / (df + t * t)
    tail = 0.5 * _betainc(df / 2.0, 0.5, x)
    return tail if t < 0 else 1.0 - tail


@F.pandas_udf(T.DoubleType())
def norm_sf(z: pd.Series) -> pd.Series:
    """P(Z > z) for a standard normal Z."""
    return z.map(lambda v: _norm_sf(float(v)) if v is not None and not pd.isna(v) else None).astype("float64")


@F.pandas_udf(T.DoubleType())
def t_cdf(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(T <= t) for Student's t with ``df`` degrees of freedom (Welch's fractional df allowed)."""
    return pd.Series([_t_cdf(float(a), float(b)) if not (pd.isna(a) or pd.isna(b)) else None
                      for a, b in zip(t, df)], dtype="float64")


# --- D15, D16, I5: histogram and density ---------------------------------------------------------

def histogram(df: DataFrame, col: str, bins: int = 30, group: str | None = None) -> DataFrame:
    """Equal-width histogram over [min, max] per group, last bin closed, as numpy/seaborn.

    Columns: [group], bin, bin_start, bin_end, count, density (= count / (n * width)).
    Empty bins are listed too. A constant column gets the range [v - 0.5, v + 0.5] like numpy.
    """
    keys = [group] if group else []
    x = F.col(col).cast("double")
    src = df.where(x.isNotNull())
    rng = src.groupBy(*keys).agg(F.min(x).alias("_lo0"), F.max(x).alias("_hi0"), F.count(F.lit(1)).alias("_n"))
    rng = rng.select(*keys, "_n",
                     F.when(F.col("_lo0") == F.col("_hi0"), F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).alias("_lo"),
                     F.when(F.col("_lo0") == F.col("_hi0"), F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).alias("_hi"))
    if keys:  # one row per group
        j = src.select(*keys, x.alias("_x")).join(rng, on=keys, how="inner")
    else:     # one row in all: scalar subqueries, no join
        j = src.select(x.alias("_x"), *[rng.select(c).scalar().alias(c) for c in ["_n", "_lo", "_hi"]])
    b = F.least(F.floor((F.col("_x") - F.col("_lo")) * F.lit(bins) / (F.col("_hi") - F.col("_lo"))), F.lit(bins - 1))
    counts = j.groupBy(*keys, b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select(*keys, "_n", "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, on=keys + ["bin"], how="left").na.fill(0, subset=["count"])
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    return out.select(*keys, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
                      (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"), "count",
                      (F.col("count") / (F.col("_n") * width)).alias("density"))


def kde(df: DataFrame, col: str, grid: int = 200, cut: float = 3.0, bw_adjust: float = 1.0,
        group: str | None = None, step: float | None = None) -> DataFrame:
    """Gaussian kernel density on an evenly spaced grid, Scott's bandwidth (D16, I5 per group).

    bandwidth h = n^(-1/5) * sample std * bw_adjust; grid from min - cut*h to max + cut*h.
    Exact: every grid point is one aggregate over the value counts, so the data is read once
    and no grid x data join is formed.

    With ``step``, values are first dealt to bins ``step * h`` wide, each value to the two bin edges around it in proportion to its
    nearness (linear binning); the kernel then meets the bins. A column with many distinct values costs bins x grid, not rows x grid. The kernel between two
    edges is off its chord by at most an eighth of the squared width times its greatest curvature, so no density is off by more than
    ``error_bound`` = step^2 / (8 sqrt(2 pi) h), a further column.

    Per-group parameters join on the group key (one row per
    group); without a group they enter as scalar subqueries.
    """
    keys = [group] if group else []
    x = F.col(col).cast("double")
    src = df.where(x.isNotNull())
    vc = (src.select(*keys, x.alias("_v"), F.lit(1).alias("_c")) if step
          else src.groupBy(*keys, x.alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    stats = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp(x).alias("_sd"),
                                   F.min(x).alias("_lo0"), F.max(x).alias("_hi0"))
    stats = stats.withColumn("_h", F.pow(F.col("_n").cast("double"), -0.2) * F.col("_sd") * F.lit(bw_adjust))
    params = ["_n", "_h", "_lo0", "_hi0"]
    if keys:
        vc = vc.join(stats.select(*keys, *params), on=keys)
    else:  # the scalars enter the plan once, as columns
        vc = vc.withColumns({p: stats.select(p).scalar() for p in params})
    if step:
        vc = _binned(vc, keys, params, step)
    h = F.col("_h")
    lo = F.col("_lo0") - F.lit(cut) * h
    hi = F.col("_hi0") + F.lit(cut) * h
    vc = vc.withColumns({"_glo": lo, "_step": (hi - lo) / F.lit(grid - 1)})
    norm = F.lit(1.0 / math.sqrt(2 * math.pi))
    # a constant column (or a single row) has no bandwidth: its density is null
    aggs = [F.sum(F.col("_c") * F.exp(F.lit(-0.5) * F.pow(F.try_divide(F.col("_glo") + F.lit(k) * F.col("_step") - F.col("_v"), h), 2)))
            .alias(f"g{k}") for k in range(grid)]
    wide = vc.groupBy(*keys).agg(*aggs, F.first("_n").alias("_n"), F.first("_h").alias("_h"),
                                 F.first("_glo").alias("_glo"), F.first("_step").alias("_step"))
    stack = ", ".join(f"{k}, g{k}" for k in range(grid))
    long = wide.selectExpr(*keys, f"stack({grid}, {stack}) as (grid_index, s)", "_n", "_h", "_glo", "_step")
    bound = [F.try_divide(F.lit(step * step / 8.0 / math.sqrt(2 * math.pi)), F.col("_h")).alias("error_bound")] if step else []
    return long.select(*keys, F.col("grid_index").cast("int").alias("grid_index"), *bound,
                       (F.col("_glo") + F.col("grid_index") * F.col("_step")).alias("x"),
                       F.try_divide(F.col("s") * norm, F.col("_n") * F.col("_h")).alias("density"))


def _binned(values: DataFrame, keys: list[str], params: list[str], step: float) -> DataFrame:
    """(value, weight) of the bin edges that hold anything, for values with the columns ``_lo0`` and ``_h``."""
    width = F.lit(step) * F.col("_h")
    at = values.withColumn("_t", F.try_divide(F.col("_v") - F.col("_lo0"), width))
    at = at.withColumn("_k", F.floor("_t"))
    near = F.col("_t") - F.col("_k")
    halves = at.groupBy(*keys, "_k").agg(F.sum((1 - near) * F.col("_c")).alias("_a"), F.sum(near * F.col("_c")).alias("_b"),
                                         *[F.first(p).alias(p) for p in params])
    edges = halves.select(*keys, *params, F.inline(F.array(F.struct(F.col("_k").alias("_e"), F.col("_a").alias("_w")),
                                                           F.struct((F.col("_k") + 1).alias("_e"), F.col("_b").alias("_w")))))
    bins = edges.groupBy(*keys, "_e").agg(F.sum("_w").alias("_c"), *[F.first(p).alias(p) for p in params])
    return bins.withColumn("_v", F.col("_lo0") + F.col("_e") * F.lit(step) * F.col("_h"))


# --- I1: normality --------------------------------------------------------------------------------

def normality(df: DataFrame, col: str, group: str | None = None) -> DataFrame:
    """Jarque-Bera test per group (I1): JB = n/6 * (S^2 + K^2/4) with population skewness S and
    excess kurtosis K; p = exp(-JB/2) (chi-square with 2 df). Re-aims Shapiro-Wilk, which needs
    all values of a group on one machine."""
    keys = [group] if group else []
    x = F.col(col).cast("double")
    g = df.where(x.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.skewness(x).alias("skewness"),
                                                   F.kurtosis(x).alias("kurtosis"))
    jb = F.col("n") / 6.0 * (F.pow("skewness", 2) + F.pow("kurtosis", 2) / 4.0)
    return g.withColumn("jb", jb).withColumn("p_value", F.exp(-F.col("jb") / 2.0))


# The coefficients of the rational approximation 26.2.17 of Abramowitz and Stegun.
_CDF_P = 0.2316419
_CDF_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(z: Column) -> Column:
    """P(Z <= z) of a standard normal Z as a column expression, to 7.5e-8."""
    t = 1 / (1 + F.lit(_CDF_P) * F.abs(z))
    series = F.lit(0.0)
    for b in reversed(_CDF_B):
        series = (series + F.lit(b)) * t
    upper = F.exp(-z * z / 2) / F.lit(math.sqrt(2 * math.pi)) * series
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def ks_normal(df: DataFrame, col: str, group: str | None = None) -> DataFrame:
    """Kolmogorov-Smirnov distance of a column from the normal distribution with its own mean and deviation, per group.

    Columns: [group], n, mean, sd, ks_d (largest distance between the steps of the empirical distribution and the normal one),
    ks_scaled (sqrt(n) * ks_d). Values are counted before they are ranked (``rank``), so a frequent value is one row and no task holds a
    group. A group without spread has no distance. The fitted distance has no simple p-value; compare it with Lilliefors' tables.
    """
    keys = [group] if group else []
    x = F.col(col).cast("double")
    src = df.where(x.isNotNull()).select(*keys, x.alias("_v"))
    fit = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"))
    counts = src.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    cum = running_total(counts, [*keys, "_v"], "_c", out="_r")
    if keys:                                                        # a row per group: how many rows lie in groups before it
        before = F.coalesce(F.sum("n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cum = cum.join(fit.withColumn("_before", before).withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    else:
        cum = cum.withColumns({c: fit.select(c).scalar() for c in ("n", "mean", "sd")}).withColumn("_before", F.lit(0))
    phi = normal_cdf(F.try_divide(F.col("_v") - F.col("mean"), F.col("sd")))
    upto = (F.col("_r") - F.col("_before")) / F.col("n")
    below = (F.col("_r") - F.col("_before") - F.col("_c")) / F.col("n")
    far = F.when(F.col("sd") > 0, F.greatest(upto - phi, phi - below))
    out = cum.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("n", "mean", "sd")], F.max(far).alias("ks_d"))
    return out.withColumn("ks_scaled", F.sqrt(F.col("n")) * F.col("ks_d"))


def probplot(df: DataFrame, col: str, key: str, group: str | None = None) -> DataFrame:
    """Normal probability-plot points (I2): ordered values against normal quantiles of Filliben's
    order-statistic medians. Ranks come from the bucketed global rank (no single-partition window)."""
    from statistics import NormalDist

    @F.pandas_udf(T.DoubleType())
    def ppf(p: pd.Series) -> pd.Series:
        nd = NormalDist()
        return p.map(lambda v: nd.inv_cdf(float(v))).astype("float64")

    keys = [group] if group else []
    x = F.col(col).cast("double")
    src = df.where(x.isNotNull()).select(*keys, key, x.alias("value"))
    if group:
        codes = src.select(group).distinct()
        codes = codes.withColumn("_g", F.dense_rank().over(Window.orderBy(group)))  # the distinct groups only
        src = src.join(codes, on=group)
        ranked = running_total(src, ["_g", "value", key], None, out="_r")
        offs = src.groupBy("_g").agg(F.count(F.lit(1)).alias("n"))
        offs = offs.withColumn("_off", F.coalesce(F.sum("n").over(Window.orderBy("_g").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)))
        ranked = ranked.join(F.broadcast(offs), "_g").withColumn("i", F.col("_r") - F.col("_off")).drop("_g", "_r", "_off")
    else:
        ranked = running_total(src, ["value", key], None, out="i")
        ranked = ranked.withColumn("n", src.select(F.count(F.lit(1))).scalar())
    n, i = F.col("n").cast("double"), F.col("i").cast("double")
    last = F.pow(F.lit(0.5), 1.0 / n)
    m = F.when(F.col("i") == F.col("n"), last).when(F.col("i") == 1, 1 - last).otherwise((i - 0.3175) / (n + 0.365))
    return ranked.withColumn("osm", ppf(m)).withColumnRenamed("value", "osr")


def probplot_fit(points: DataFrame, group: str | None = None) -> DataFrame:
    keys = [group] if group else []
    return points.groupBy(*keys).agg(F.regr_slope("osr", "osm").alias("slope"),
                                     F.regr_intercept("osr", "osm").alias("intercept"),
                                     F.corr("osr", "osm").alias("r"))


# --- I3, I4: two-group tests -----------------------------------------------------------------------

def mann_whitney(df: DataFrame, col: str, label: str, first=True) -> DataFrame:
    """Mann-Whitney U of the ``label == first`` sample against the rest, one-sided 'less'
    (the first sample tends to be smaller), average ranks, tie and continuity correction (I3).

    Columns: n1, n2, u1, u2, tie_term, z, p_value. Ranks come from value counts, so ties cost
    nothing and the data is never sorted in one task.
    """
    x = F.col(col).cast("double")
    is1 = F.col(label) == F.lit(first)
    vc = (df.where(x.isNotNull()).groupBy(x.alias("_v"))
          .agg(F.count(F.lit(1)).alias("count"), F.count_if(is1).alias("_c1")))
    r = average_ranks(vc, "_v", "count", out="_ar")
    s = r.agg(F.sum(F.col("_ar") * F.col("_c1")).alias("r1"), F.sum("_c1").alias("n1"),
              F.sum("count").alias("n"),
              F.sum(F.pow(F.col("count").cast("double"), 3) - F.col("count")).alias("tie_term"))
    s = s.withColumn("n2", F.col("n") - F.col("n1"))
    n1, n2, n = F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("n").cast("double")
    s = s.withColumn("u1", F.col("r1") - n1 * (n1 + 1) / 2).withColumn("u2", n1 * n2 - F.col("u1"))
    # all values tied, or one side empty: z and p are null
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.try_divide(F.col("tie_term"), n * (n - 1))))
    # 'less': scipy evaluates the upper tail of U2 with the continuity correction
    s = s.withColumn("z", F.try_divide(F.col("u2") - n1 * n2 / 2.0 - 0.5, sigma))
    return s.select(F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"),
                    "u1", "u2", "tie_term", "z", norm_sf(F.col("z")).alias("p_value"))


def welch_t(df: DataFrame, col: str, label: str, first=True) -> DataFrame:
    """Welch's t-test of the ``label == first`` mean against the rest, one-sided 'less' (I4)."""
    x = F.col(col).cast("double")
    is1 = F.col(label) == F.lit(first)
    g = df.where(x.isNotNull()).agg(
        F.count(F.when(is1, x)).alias("n1"), F.avg(F.when(is1, x)).alias("mean1"), F.var_samp(F.when(is1, x)).alias("var1"),
        F.count(F.when(~is1, x)).alias("n2"), F.avg(F.when(~is1, x)).alias("mean2"), F.var_samp(F.when(~is1, x)).alias("var2"))
    a, b = F.try_divide(F.col("var1"), F.col("n1")), F.try_divide(F.col("var2"), F.col("n2"))
    # no variance, or under two rows on a side: t, df and p are null
    g = g.withColumn("t", F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(a + b)))
    g = g.withColumn("df", F.try_divide(F.pow(a + b, 2), F.try_divide(F.pow(a, 2), F.col("n1") - 1) + F.try_divide(F.pow(b, 2), F.col("n2") - 1)))
    return g.withColumn("p_value", t_cdf(F.col("t"), F.col("df")))


# --- I6-I8: outliers and correlation screening ----------------------------------------------------

def zscore_filter(df: DataFrame, cols: Sequence[str], threshold: float = 3.0) -> tuple[DataFrame, dict]:
    """Keep rows with |z| <= threshold, one column after the other, each on the rows the previous
    column kept (I6). Mean and sample std stay in the plan as scalar subqueries.
    Returns (kept rows, {column: outlier count column as a one-row DataFrame})."""
    out, counts = df, {}
    for c in cols:
        st = out.agg(F.avg(c).alias("m"), F.stddev_samp(c).alias("s"))
        # a constant column has no outliers: its z is null, which counts as 0
        z = F.abs(F.coalesce(F.try_divide(F.col(c) - st.select("m").scalar(), st.select("s").scalar()),
                             F.when(F.col(c).isNotNull(), F.lit(0.0))))
        counts[c] = out.where(z > threshold).agg(F.count(F.lit(1)).alias(f"{c}_outliers"))
        out = out.where(z <= threshold)
    return out, counts


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    num = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, num) and f.name not in exclude]


def varying_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns with a non-zero variance (Q23: correlation with a constant column is undefined)."""
    row = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] > 0]


def high_corr_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.86) -> DataFrame:
    """Pairs with |r| > threshold (I7); a column without variance has no r."""
    return corr_pairs(df, cols).where(F.abs("r") > threshold)


def drop_correlated(df: DataFrame, cols: Sequence[str], threshold: float = 0.86) -> tuple[DataFrame, list[str]]:
    """Drop the later column of every pair above the threshold (I8). The p x p matrix is read on
    the driver (it is sized by the column count, never by rows)."""
    pairs = high_corr_pairs(df, cols, threshold).collect()
    dropped = sorted({r["col_b"] for r in pairs}, key=list(cols).index)
    return df.drop(*dropped), dropped


# --- J8, J9: classifier evaluation from a fixed score column --------------------------------------

def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 for a 0/1 label and prediction."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    c = df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
               F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 1) & (p == 0)).alias("fn"))
    tp, fp, tn, fn = (F.col(k) for k in ["tp", "fp", "tn", "fn"])
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return c.select("tp", "fp", "tn", "fn",
                    ((tp + tn) / (tp + fp + tn + fn)).alias("accuracy"), prec.alias("precision"),
                    rec.alias("recall"),
                    F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0)).alias("f1"))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC points at every distinct score (descending thresholds) and, per row, the running
    trapezoid area (J9). Built from per-score counts and bucketed running totals."""
    s = F.col(score).cast("double")
    y = F.col(label).cast("int")
    from lapsekit.session import cut_lineage
    vc = cut_lineage(df.where(s.isNotNull()).groupBy((-s).alias("_neg")).agg(F.count_if(y == 1).alias("_pos"),
                                                                             F.count_if(y == 0).alias("_negc")))
    tot = vc.agg(F.sum("_pos").alias("P"), F.sum("_negc").alias("N"))
    P, N = tot.select("P").scalar(), tot.select("N").scalar()
    c = running_totals(vc, ["_neg"], {"_tp": ("_pos", True), "_fp": ("_negc", True),
                                      "_tp0": ("_pos", False), "_fp0": ("_negc", False)})
    # with one class only, the rate of the other and the area are null
    tpr, fpr = F.try_divide(F.col("_tp"), P), F.try_divide(F.col("_fp"), N)
    area = F.try_divide(F.col("_fp") - F.col("_fp0"), N) * F.try_divide(F.col("_tp") + F.col("_tp0"), P) / 2.0
    return c.select((-F.col("_neg")).alias("threshold"), F.col("_tp").alias("tp"), F.col("_fp").alias("fp"),
                    tpr.alias("tpr"), fpr.alias("fpr"), area.alias("area"))


def auc(roc: DataFrame) -> DataFrame:
    """Area under the ROC curve: the sum of the trapezoids (equals U / (n1 * n2))."""
    return roc.agg(F.sum("area").alias("auc"))


def mutual_info(df: DataFrame, cols: Sequence[str], label: str, bins: int = 10, top: int | None = None) -> DataFrame:
    """Binned mutual information between each feature and the label, nats.

    Features are cut at exact quantiles (ties merge bins), features are stacked to long form so
    all of them share one aggregation. The reference's estimator is nearest-neighbour based;
    this is the plug-in binned estimate.
    """
    probs = [i / bins for i in range(1, bins)]
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {stack}) as (feature, value)", f"`{label}` as _y")
    e_long = group_quantiles(long, "feature", "value", probs, out="edges")
    j = long.where(F.col("value").isNotNull()).join(F.broadcast(e_long), on="feature")  # one row per feature
    j = j.withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("value"))))
    joint = j.groupBy("feature", "bin", "_y").agg(F.count(F.lit(1)).alias("c"))
    w_f = Window.partitionBy("feature")
    joint = (joint.withColumn("n", F.sum("c").over(w_f))
             .withColumn("cb", F.sum("c").over(Window.partitionBy("feature", "bin")))
             .withColumn("cy", F.sum("c").over(Window.partitionBy("feature", "_y"))))
    mi = joint.groupBy("feature").agg(
        F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cb") * F.col("cy")))).alias("mutual_info"))
    if top:
        mi = mi.withColumn("mi_rank", F.row_number().over(Window.orderBy(F.col("mutual_info").desc(), "feature")))
        mi = mi.where(F.col("mi_rank") <= top)
    return mi

"""I1, I7, I9, D16, J11, K3 and exact quantiles against plain numpy and exact forms."""

import itertools
import math
import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lapsekit.operators import basket as bk
from lapsekit.operators import gram as gm
from lapsekit.operators import ml
from lapsekit.operators import stats as st
from lapsekit.operators.rank import group_quantiles
from paths import SF_SMALL


def test_three_hundred_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 300)) * 10.0 ** rng.integers(-3, 4, 300) + rng.normal(size=300) * 1e6
    x[:, 1] = 2 * x[:, 0] + 3
    x[:, 7] = 5.0                                                   # a constant column
    cols = [f"f.{i}" for i in range(300)]                           # names that need quoting
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols)).repartition(5)
    got = {(r.col_a, r.col_b): r.r for r in gm.corr_pairs(df, cols).collect()}
    assert len(got) == 300 * 299 // 2
    with np.errstate(invalid="ignore", divide="ignore"):
        want = np.corrcoef(x.T)
    for (a, b), r in got.items():
        i, j = int(a[2:]), int(b[2:])
        if 7 in (i, j):
            assert r is None
        else:
            assert abs(r - want[i, j]) < 1e-7
    mean, cov, corr = gm.moments(df, cols)
    assert np.allclose(mean, x.mean(0)) and np.allclose(np.diag(cov), x.var(0, ddof=1), rtol=1e-9)
    assert len(gm.gram(df, cols)._jdf.queryExecution().optimizedPlan().toString()) < 200_000


def test_pairs_use_the_rows_that_hold_both(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, None, 5.0), (3.0, 6.5, 1.0), (4.0, 7.0, 2.0), (None, 1.0, 9.0)], "a double, b double, c double")
    got = {(r.col_a, r.col_b): r.r for r in gm.corr_pairs(df, ["a", "b", "c"]).collect()}
    for (a, b), r in got.items():
        assert abs(r - df.select(F.corr(a, b)).first()[0]) < 1e-12
    empty = gm.corr_pairs(df.limit(0), ["a", "b"])
    assert empty.where("r IS NOT NULL").count() == 0 and gm.corr_pairs(df, ["a"]).count() == 0


def test_binned_density_keeps_its_bound(spark):
    df = spark.read.parquet(os.path.join(SF_SMALL, "lineitem.parquet")).select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("v"))
    exact = {(r.l_returnflag, r.grid_index): r.density for r in st.kde(df, "v", 60, group="l_returnflag").collect()}
    worst = {}
    for step in (0.5, 0.05):
        rows = st.kde(df, "v", 60, group="l_returnflag", step=step).collect()
        assert len(rows) == len(exact)
        worst[step] = max(abs(r.density - exact[r.l_returnflag, r.grid_index]) for r in rows)
        assert all(abs(r.density - exact[r.l_returnflag, r.grid_index]) <= r.error_bound + 1e-12 for r in rows)
    assert worst[0.05] < worst[0.5] / 20                            # the error falls with the square of the width
    flat = st.kde(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v", 5, step=0.05).collect()
    assert all(r.density is None for r in flat)


def test_normal_cdf(spark):
    zs = [float(z) for z in np.linspace(-6, 6, 241)]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", st.normal_cdf(F.col("z")).alias("p")).collect()
    assert max(abs(r.p - 0.5 * math.erfc(-r.z / math.sqrt(2))) for r in got) < 7.5e-8


def test_ks_distance(spark):
    rng = np.random.default_rng(5)
    data = {"n": rng.normal(3, 2, 300), "e": rng.exponential(1, 200), "t": np.repeat([1.0, 2.0], [90, 30]), "c": np.full(4, 7.0), None: rng.normal(0, 1, 50)}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("n", None)]
    got = {r.g: r for r in st.ks_normal(spark.createDataFrame(rows, "g string, v double").repartition(3), "v", "g").collect()}
    for g, vs in data.items():
        vs = np.sort(vs)
        if vs.std() == 0:
            assert got[g].ks_d is None
            continue
        phi = np.array([0.5 * math.erfc(-(v - vs.mean()) / vs.std(ddof=1) / math.sqrt(2)) for v in vs])
        n = len(vs)
        d = max((np.searchsorted(vs, vs, "right") / n - phi).max(), (phi - np.searchsorted(vs, vs, "left") / n).max())
        assert got[g].n == n and abs(got[g].ks_d - d) < 1e-6
    one = st.ks_normal(spark.createDataFrame([(float(v),) for v in data["e"]], "v double"), "v").first()
    assert abs(one.ks_d - got["e"].ks_d) < 1e-12


def test_vertical_sets_equal_fp_growth(spark):
    rng = np.random.default_rng(11)
    rows = [(k, sorted({f"i{x}" for x in rng.zipf(1.4, rng.integers(1, 9)) if x < 30} | {"hot"})) for k in range(400)]
    b = spark.createDataFrame(rows, "k long, items array<string>").repartition(5)
    key = lambda df: {(tuple(r.itemset), r.freq, round(r.support, 12), r.length) for r in df.collect()}
    want = key(bk.frequent_itemsets(b, 0.03))
    assert max(s[3] for s in want) > 3
    assert key(bk.vertical_itemsets(b, "k", 0.03)) == want
    for m in (1, 2, 3):
        assert key(bk.vertical_itemsets(b, "k", 0.03, max_len=m)) == {s for s in want if s[3] <= m}
    assert bk.vertical_itemsets(b.limit(0), "k", 0.03).count() == 0


def test_permutation_importance_meets_donors_once(spark):
    from pyspark.ml.classification import LogisticRegression
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] > 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"customer_id": np.arange(90), "y": y, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    model = LogisticRegression(featuresCol="features", labelCol="_label").fit(ml.assemble(df.withColumn("_label", F.col("y").cast("double")), ["a", "b", "c"]))
    got = {r.feature: r for r in ml.permutation_importance(model, df, ["a", "b", "c"], "y").collect()}
    order = [r.customer_id for r in df.orderBy(F.xxhash64("customer_id", F.lit(42)), "customer_id").collect()]
    place = {k: i for i, k in enumerate(order)}
    w, b0 = model.coefficients.toArray(), model.intercept
    rates = lambda m: ((m == y).mean(), (m & (y == 1)).sum() / m.sum())
    accuracy, precision = rates((x @ w + b0 > 0).astype(int))
    for j, c in enumerate("abc"):
        moved = x.copy()
        for k in range(90):                                         # row at place r takes the value of place r - shift
            moved[k, j] = x[order[(place[k] - (90 // 3 + 1)) % 90], j]
        a, p = rates((moved @ w + b0 > 0).astype(int))
        assert abs(got[c].importance - (accuracy - a)) < 1e-12 and abs(got[c].precision_drop - (precision - p)) < 1e-12
    assert got["a"].importance > got["c"].importance


def test_quantiles_of_a_value_that_most_rows_share(spark):
    vals = [1.0] * 50 + [float(v) for v in range(2, 25)] + [None] * 3
    rows = list(itertools.chain((("h", v) for v in vals), (("s", v) for v in (4.0, 1.0)), [("o", 3.0)]))
    probs = [0.0, 0.1, 0.5, 0.69, 0.75, 0.9, 1.0]
    got = {r.g: r.q for r in group_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(4), "g", "v", probs).collect()}
    for g in "hso":
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g and v is not None], probs))

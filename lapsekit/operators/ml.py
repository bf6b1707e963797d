"""Lapse model, feature grouping, oversampling, scoring and clustering.

Rows never pass through the driver. What the driver holds is sized by the number of columns:
scaler statistics, the p x p correlation / covariance matrices, PCA loadings and cluster
centres. Projections and scaling are then plain column expressions, so they run in codegen
and partition like any other projection. Iterative fits read a checkpointed feature table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsekit.operators.gram import first_axis, moments
from lapsekit.operators.rank import running_totals

KEY = "customer_id"


# --- J1: standardisation ---------------------------------------------------------------------

def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column (sklearn's StandardScaler divides by the population std,
    Spark's by the sample std, Q19). One aggregate row, read on the driver."""
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m_{i}"] or 0.0, row[f"s_{i}"] or 0.0) for i, c in enumerate(cols)}


def standardize(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / std; a zero std leaves the centred value (sklearn keeps scale 1 there)."""
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s if s > 0 else 1.0) for c, (m, s) in stats.items()})


def inverse_standardize(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.lit(s if s > 0 else 1.0) + F.lit(m) for c, (m, s) in stats.items()})


# --- J2: stratified split -----------------------------------------------------------------------

def stratified_split(df: DataFrame, label: str, key: str = KEY, test_frac: float = 0.2,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Exact stratified split: inside each label, rows are ordered by a seeded hash of the key and
    the first round(test_frac * n_label) go to test. Deterministic and partition-independent."""
    d = df.withColumns({"_y": F.col(label).cast("int"), "_h": F.xxhash64(F.col(key), F.lit(seed))})
    d = running_totals(d, ["_y", "_h", key], {"_pos": (None, True)})
    sizes = d.groupBy("_y").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per label
    d = d.join(F.broadcast(sizes), "_y")
    in_test = (F.col("_pos") - F.col("_before")) <= F.round(F.col("_n") * F.lit(test_frac))
    d = d.withColumn("_test", in_test).drop("_y", "_h", "_pos", "_n", "_before")
    return d.where(~F.col("_test")).drop("_test"), d.where(F.col("_test")).drop("_test")


# --- J3: SMOTE --------------------------------------------------------------------------------

def projected_neighbours(df: DataFrame, key: str, cols: Sequence[str], k: int, seed: int = 42, projections: int = 8, reach: int = 8) -> DataFrame:
    """(a, b, d, place): the ``k`` nearest of the rows that stand ``reach`` places before or behind a row in one of a few random
    projections (E5). Approximate and linear in the rows; ``neighbours.exact_neighbours`` is the exact form."""
    directions = np.random.default_rng(seed).standard_normal((projections, len(cols)))
    near = None
    for d in directions:
        at = sum((F.col(c).cast("double") * float(w) for c, w in zip(cols, d)), F.lit(0.0))
        ranked = running_totals(df.select(key, at.alias("_at")), ["_at", key], {"_r": (None, True)}).select(key, "_r")
        ahead = ranked.select(F.col(key).alias("a"), F.explode(F.sequence(F.col("_r") + 1, F.col("_r") + reach)).alias("_r"))
        met = ahead.join(ranked.withColumnRenamed(key, "b"), "_r").select("a", "b")
        met = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = met if near is None else near.unionByName(met)
    side = lambda n: df.select(F.col(key).alias(n), *[F.col(c).cast("double").alias(f"{n}_{i}") for i, c in enumerate(cols)])
    pairs = near.distinct().join(side("a"), "a").join(side("b"), "b")
    dist = F.sqrt(sum((F.pow(F.col(f"a_{i}") - F.col(f"b_{i}"), 2) for i in range(len(cols))), F.lit(0.0)))
    # at most 2 * reach * projections candidates per row
    ranked = pairs.select("a", "b", dist.alias("d")).withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy("d", "b")))
    return ranked.where(F.col("place") <= k)


def smote(df: DataFrame, cols: Sequence[str], label: str, k: int = 5, seed: int = 42, key: str = KEY, exact: bool = True) -> DataFrame:
    """Oversample the minority class to the majority count.

    Each synthetic row lies on the segment between a minority row and one of its ``k`` nearest minority rows
    (``exact_neighbours``; or, if not ``exact``, ``projected_neighbours``), with a seeded fraction. A minority of one
    row is its own neighbour: its synthetic rows are copies.
    """
    from lapsekit.operators.neighbours import exact_neighbours
    from lapsekit.session import cut_lineage

    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row per class
    if len(counts) < 2:
        return df.select(key, *cols, label, F.lit(False).alias("synthetic"))
    minority = min(counts, key=counts.get)
    need = max(counts.values()) - counts[minority]
    mino = cut_lineage(df.where(F.col(label) == F.lit(minority)))
    n_min = counts[minority]
    if n_min == 1:
        nbrs = mino.select(F.col(key).alias("_a"), F.col(key).alias("_b"), F.lit(1).alias("_j"))
    else:
        nbrs = (exact_neighbours if exact else projected_neighbours)(mino, key, cols, k, seed=seed)
        nbrs = nbrs.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("place").alias("_j"))
    nbrs = cut_lineage(nbrs)
    nbrs = nbrs.join(nbrs.groupBy("_a").agg(F.count(F.lit(1)).alias("_kn")), "_a")

    # how many synthetic rows each minority row makes: need // n_min, +1 for the first need % n_min
    base, extra = divmod(need, n_min)
    ranked = running_totals(mino.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))), ["_h", key],
                            {"_r": (None, True)})
    gen = ranked.withColumn("_m", F.lit(base) + F.when(F.col("_r") <= extra, 1).otherwise(0)).where(F.col("_m") > 0)
    gen = gen.select(key, *cols, F.explode(F.sequence(F.lit(1), F.col("_m"))).alias("_s"))
    gen = gen.join(nbrs.select(F.col("_a").alias(key), "_kn").distinct(), key)
    pick = (F.pmod(F.xxhash64(F.col(key), F.col("_s"), F.lit(seed)), F.col("_kn")) + 1).cast("int")
    gen = gen.withColumn("_j", pick)
    nb_vals = nbrs.join(mino.select(F.col(key).alias("_b"), *[F.col(c).alias(f"_nb_{c}") for c in cols]), "_b")
    gen = gen.join(nb_vals.select(F.col("_a").alias(key), "_j", *[f"_nb_{c}" for c in cols]), [key, "_j"])
    gap = (F.pmod(F.xxhash64(F.col(key), F.col("_s"), F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30))
    gen = gen.withColumn("_gap", gap)
    synth = gen.select(F.lit(None).cast(df.schema[key].dataType).alias(key),
                       *[(F.col(c) + F.col("_gap") * (F.col(f"_nb_{c}") - F.col(c))).alias(c) for c in cols],
                       F.lit(minority).cast(df.schema[label].dataType).alias(label),
                       F.lit(True).alias("synthetic"))
    orig = df.select(key, *cols, label, F.lit(False).alias("synthetic"))
    return orig.unionByName(synth)


# --- I8, I9: correlation screening and grouped PCA ---------------------------------------------

def ward_groups(points: np.ndarray, threshold: float = 1.0) -> list[list[int]]:
    """Agglomerative Ward clustering of a few points (the rows of a p x p matrix), merging while
    the Ward distance sqrt(2 |A||B| / (|A|+|B|)) * ||cA - cB|| is below ``threshold``."""
    clusters = [[i] for i in range(len(points))]
    cents = [points[i].astype(float) for i in range(len(points))]
    while len(clusters) > 1:
        best = None
        for a in range(len(clusters)):
            for b in range(a + 1, len(clusters)):
                na, nb = len(clusters[a]), len(clusters[b])
                d = np.sqrt(2.0 * na * nb / (na + nb)) * np.linalg.norm(cents[a] - cents[b])
                if best is None or d < best[0]:
                    best = (d, a, b)
        if best[0] >= threshold:
            break
        _, a, b = best
        na, nb = len(clusters[a]), len(clusters[b])
        cents[a] = (cents[a] * na + cents[b] * nb) / (na + nb)
        clusters[a] = clusters[a] + clusters[b]
        del clusters[b], cents[b]
    return [sorted(c) for c in clusters]


def pca_loadings(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """First principal axis of the centred columns and the means, from one pass of products.
    Sign fixed so that the largest absolute loading is positive (Q20)."""
    mean, cov, _ = moments(df, cols)
    return first_axis(cov), mean


def pca_by_group(df: DataFrame, cols: Sequence[str], threshold: float = 1.0, key: str = KEY,
                 keep: Sequence[str] = ()) -> tuple[DataFrame, dict[str, list[str]]]:
    """Group correlated features (Ward on the rows of the standardised correlation matrix), replace
    each group of two or more by its first principal component of the unscaled centred columns,
    keep singletons (I9)."""
    cols = list(cols)
    means, cov, corr = moments(df, cols)                 # one pass serves the grouping and every group's component
    groups = ward_groups(corr, threshold)
    exprs, mapping = [], {}
    for g_id, members in enumerate(groups):
        names = [cols[i] for i in members]
        if len(names) == 1:
            exprs.append(F.col(names[0]))
            mapping[names[0]] = names
            continue
        v = first_axis(cov[np.ix_(members, members)])
        proj = sum((F.col(n) - F.lit(float(m))) * F.lit(float(w)) for n, m, w in zip(names, means[members], v))
        name = f"PCA_Cluster_{g_id}"
        exprs.append(proj.alias(name))
        mapping[name] = names
    return df.select(key, *keep, *exprs), mapping


# --- J4-J7, J10: models -------------------------------------------------------------------------

def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def regression_report(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    e = F.col(label) - F.col(prediction)
    return df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                  (1 - F.sum(e * e) / (F.count(F.lit(1)) * F.var_pop(label))).alias("r2"),
                  F.count(F.lit(1)).alias("n"))


def behavior_regression(df: DataFrame, cols: Sequence[str], target: str, key: str = KEY, seed: int = 42):
    """Standardise -> first principal component -> linear regression, 80/20 split.
    Returns (train report, test report, test predictions with residuals)."""
    from pyspark.ml.regression import LinearRegression
    stats = fit_scaler(df, cols)
    z = standardize(df, stats)
    v, mean = pca_loadings(z, cols)
    pc = sum((F.col(c) - F.lit(float(m))) * F.lit(float(w)) for c, m, w in zip(cols, mean, v))
    z = z.withColumn("pc1", pc)
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100))
    train, test = z.where(h >= 20), z.where(h < 20)
    model = LinearRegression(featuresCol="features", labelCol=target).fit(assemble(train, ["pc1"]))
    pred_train = model.transform(assemble(train, ["pc1"]))
    pred_test = model.transform(assemble(test, ["pc1"])).withColumn("residual", F.col(target) - F.col("prediction"))
    return regression_report(pred_train, target), regression_report(pred_test, target), pred_test


def train_classifier(train: DataFrame, cols: Sequence[str], label: str, folds: int = 3, seed: int = 42):
    """Logistic regression, random forest and gradient-boosted trees, each under k-fold cross
    validation; the one with the best mean precision for class 1 wins (J7). Returns
    (best fitted model, {name: cv precision})."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    data = assemble(train.withColumn("_label", F.col(label).cast("double")), cols)
    ev = MulticlassClassificationEvaluator(labelCol="_label", metricName="precisionByLabel", metricLabel=1.0)
    cands = {
        "logistic_regression": LogisticRegression(featuresCol="features", labelCol="_label", maxIter=100),
        "random_forest": RandomForestClassifier(featuresCol="features", labelCol="_label", numTrees=100,
                                                maxDepth=5, seed=seed),
        "gradient_boosted_trees": GBTClassifier(featuresCol="features", labelCol="_label", maxIter=10,
                                                maxDepth=5, seed=seed),
    }
    scores, best = {}, None
    for name, est in cands.items():
        cv = CrossValidator(estimator=est, estimatorParamMaps=ParamGridBuilder().build(), evaluator=ev,
                            numFolds=folds, seed=seed, parallelism=folds)
        m = cv.fit(data)
        scores[name] = float(m.avgMetrics[0])
        if best is None or scores[name] > scores[best[0]]:
            best = (name, m.bestModel)
    return best[1], scores, best[0]


def score(model, df: DataFrame, cols: Sequence[str], label: str | None = None) -> DataFrame:
    """Predicted class and probability of class 1 for every row."""
    from pyspark.ml.functions import vector_to_array
    d = assemble(df if label is None else df.withColumn("_label", F.col(label).cast("double")), cols)
    out = model.transform(d)
    return out.withColumn("lapse_probability", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability")


def permutation_importance(model, df: DataFrame, cols: Sequence[str], label: str, key: str = KEY,
                           seed: int = 42) -> DataFrame:
    """Drop in accuracy and in precision of class 1 when one feature's values are moved to other rows (J11, re-aims SHAP).

    The permutation is a rotation of a seeded hash order: every row takes the value of the row ``shift`` places before it. A row meets
    its donor once, in one key join; all variants (none moved, each feature moved) are scored from that pair. A precision without
    predicted rows counts as 0.
    """
    from lapsekit.session import cut_lineage
    cols = list(cols)
    base = df.select(key, label, *cols).withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    ranked = cut_lineage(running_totals(base, ["_h", key], {"_r": (None, True)}))
    n = ranked.select(F.count(F.lit(1))).scalar()
    donors = ranked.select(F.pmod(F.col("_r") - 1 + F.floor(n / 3) + 1, n).alias("_at"), F.struct(*cols).alias("_donor"))
    pairs = ranked.withColumn("_at", F.col("_r") - 1).join(donors, "_at")
    variants = pairs.withColumn("_moved", F.explode(F.sequence(F.lit(-1), F.lit(len(cols) - 1))))
    variants = variants.select(label, "_moved", *[F.when(F.col("_moved") == j, F.col("_donor")[c]).otherwise(F.col(c)).alias(c) for j, c in enumerate(cols)])
    hit, y = F.col("prediction") == F.col("_label"), F.col("prediction") == 1
    rates = cut_lineage(score(model, variants, cols, label).groupBy("_moved").agg(
        F.avg(hit.cast("double")).alias("accuracy"), F.coalesce(F.try_divide(F.count_if(hit & y), F.count_if(y)), F.lit(0.0)).alias("precision")))
    whole = rates.where("_moved = -1")
    return rates.where("_moved >= 0").select(
        F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_moved") + 1).alias("feature"),
        (whole.select("accuracy").scalar() - F.col("accuracy")).alias("importance"), (whole.select("precision").scalar() - F.col("precision")).alias("precision_drop"))


def recursive_elimination(df: DataFrame, cols: Sequence[str], label: str, step: int = 5, min_features: int = 5,
                          folds: int = 5, trees: int = 100, depth: int = 5, seed: int = 42) -> DataFrame:
    """Recursive feature elimination with a random forest scored by cross-validated F1 (I11):
    drop the ``step`` least important features per round; one row per round."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    data = df.withColumn("_label", F.col(label).cast("double"))
    ev = MulticlassClassificationEvaluator(labelCol="_label", metricName="fMeasureByLabel", metricLabel=1.0)
    feats, rounds = list(cols), []
    while True:
        rf = RandomForestClassifier(featuresCol="features", labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed)
        cv = CrossValidator(estimator=rf, estimatorParamMaps=ParamGridBuilder().build(), evaluator=ev,
                            numFolds=folds, seed=seed, parallelism=folds).fit(assemble(data, feats))
        imp = cv.bestModel.featureImportances.toArray()
        rounds.append((len(feats), float(cv.avgMetrics[0]), ", ".join(feats)))
        if len(feats) <= min_features:
            break
        drop_n = min(step, len(feats) - min_features)
        order = np.argsort(imp, kind="stable")[:drop_n]
        feats = [f for i, f in enumerate(feats) if i not in set(order.tolist())]
    return df.sparkSession.createDataFrame(rounds, "n_features int, cv_f1 double, features string")


# --- J12-J15: clustering ----------------------------------------------------------------------

def kmeans(df: DataFrame, cols: Sequence[str], k: int = 6, seed: int = 42, method: str = "kmeans"):
    """K-means (J12) or bisecting k-means (J13, re-aims the Ward dendrogram over customers).
    Returns (model, rows with ``cluster``, silhouette)."""
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    est = (KMeans if method == "kmeans" else BisectingKMeans)(k=k, seed=seed, featuresCol="features",
                                                              predictionCol="cluster")
    d = assemble(df, cols)
    model = est.fit(d)
    out = model.transform(d)
    n_clusters = len(model.clusterCenters())
    # silhouette is undefined for a single cluster (bisecting can stop early on small data)
    sil = (ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(out)
           if n_clusters > 1 and out.select("cluster").distinct().limit(2).count() > 1 else None)
    return model, out.drop("features"), sil


def silhouette(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> float | None:
    """Mean silhouette of given clusters by squared distances (J14); null with fewer than two of them."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    if df.select(cluster).distinct().limit(2).count() < 2:
        return None
    return ClusteringEvaluator(featuresCol="features", predictionCol=cluster).evaluate(assemble(df, cols))


def fit_line(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Rows with ``prediction`` and ``residual`` of a linear regression on ``cols``."""
    from pyspark.ml.regression import LinearRegression
    data = assemble(df, cols)
    out = LinearRegression(featuresCol="features", labelCol=target).fit(data).transform(data)
    return out.drop("features").withColumn("residual", F.col(target) - F.col("prediction"))


def cluster_profile(clustered: DataFrame, cols: Sequence[str], stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Per-cluster size and means in the original units."""
    orig = inverse_standardize(clustered, {c: stats[c] for c in cols})
    return orig.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_customers"), *[F.avg(c).alias(c) for c in cols])

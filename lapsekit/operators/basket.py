"""Order-timing counts, top items and market-basket rules.

Baskets stay long (one row per basket and item) or as sorted arrays; the customer x item
matrix is never densified. Frequent item sets come from Spark's FP-Growth. Its own rules have a
single-item consequent, so rules with every antecedent / consequent split are generated here from
the frequent sets and their supports (downward closure guarantees every part is frequent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsekit.functions.calendar import calendar_labels, weekday_name
from lapsekit.functions.scalar import clean_item, itemset_str

UNITS = {"month": ("month", "month_num"), "weekday": ("weekday", "weekday_num"),
         "hour": ("hour", "hour_num"), "period_day": ("period_day", None)}


# --- timing counts ---------------------------------------------------------------------------

def orders_by(df: DataFrame, unit: str, ts: str, order_key: str) -> DataFrame:
    """Item rows and distinct orders per month / weekday / hour band / part of day.
    The label's number travels along, so ordering never relies on hard-coded label lists."""
    label, num = UNITS[unit]
    lab = calendar_labels(df, ts)
    keys = [label] + ([num] if num else [])
    return lab.groupBy(*keys).agg(F.count(F.lit(1)).alias("item_rows"),
                                  F.count_distinct(order_key).alias("orders"))


def busy_dates(df: DataFrame, date: str, min_rows: int | None = None, k: float = 1.5) -> DataFrame:
    """Dates with at least ``min_rows`` item rows, with the weekday name.

    Without ``min_rows``, a date is busy from the upper IQR fence of daily rows, so the rule follows the data's
    size. The label is computed after the aggregation, so no join back is needed."""
    g = df.groupBy(F.col(date).cast("date").alias(date)).agg(F.count(F.lit(1)).alias("item_rows"))
    if min_rows is None:
        q = g.select(F.percentile("item_rows", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))    # one row per day
        least = q.select((F.get("q", 1) + F.lit(k) * (F.get("q", 1) - F.get("q", 0))).alias("fence")).scalar()
    else:
        least = F.lit(min_rows)
    return g.where(F.col("item_rows") >= least).withColumn("weekday", weekday_name(date))


def value_counts(df: DataFrame, col: str, out: str = "n_rows") -> DataFrame:
    """Rows per value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(out))


def top_items(df: DataFrame, item: str, k: int) -> DataFrame:
    """The ``k`` most frequent items, ties by item name (F1). The top-k is the feature here."""
    return value_counts(df, item).orderBy(F.col("n_rows").desc(), F.col(item)).limit(k)


def top_items_by(df: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """Top ``k`` items per group (F2, D20). Aggregate first, so the window sees one row per
    (group, item), never the raw rows."""
    c = df.groupBy(group, item).agg(F.count(F.lit(1)).alias("n_rows"))
    w = Window.partitionBy(group).orderBy(F.col("n_rows").desc(), F.col(item))
    return c.withColumn("item_rank", F.row_number().over(w)).where(F.col("item_rank") <= k)


def keep_popular(df: DataFrame, item: str, k: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """Items whose row count reaches the upper IQR fence of item counts, and the rows of those
    items via a left-semi join (C13). Returns (item counts with the flag, kept rows)."""
    counts = value_counts(df, item)
    q = counts.select(F.percentile("n_rows", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    q1, q3 = F.get(q["q"], 0), F.get(q["q"], 1)
    fence = q.select((q3 + F.lit(k) * (q3 - q1)).alias("fence")).scalar()
    flagged = counts.withColumn("fence", fence).withColumn("is_popular", F.col("n_rows") >= F.col("fence"))
    kept = df.join(flagged.where("is_popular").select(item), on=item, how="left_semi")
    return flagged, kept


# --- baskets -----------------------------------------------------------------------------------

def basket_counts(df: DataFrame, key: str, item: str) -> DataFrame:
    """Item rows per (basket, item)."""
    return df.groupBy(key, item).agg(F.count(F.lit(1)).alias("n_rows"))


def baskets(df: DataFrame, key: str, item: str) -> DataFrame:
    """One row per basket with its sorted distinct items (K2, D22 presence matrix in long form).
    ``collect_set`` combines map-side and is bounded by the item catalogue, so a hot basket key
    costs nothing; duplicates are removed, which FP-Growth requires."""
    return (df.where(F.col(item).isNotNull()).groupBy(key)
            .agg(F.array_sort(F.collect_set(clean_item(item))).alias("items")))


def basket_matrix(df: DataFrame, key: str, item: str, items: list[str]) -> DataFrame:
    """Dense basket x item 0/1 matrix, only on request (D22): ``pivot`` with an explicit, capped
    item list; the long form (``baskets``) is what the rule mining uses."""
    g = df.select(key, clean_item(item).alias("_i")).groupBy(key).pivot("_i", items).agg(F.count(F.lit(1)))
    return g.select(key, *[(F.coalesce(F.col(f"`{i}`"), F.lit(0)) >= 1).cast("int").alias(i) for i in items])


def export_rules(rules: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write the rules with item sets as 'a, b' text (K6, A4)."""
    from lapsekit.sources.io import write_table
    write_table(rules_as_text(rules), path, fmt)


def frequent_itemsets(b: DataFrame, min_support: float = 0.01, items: str = "items") -> DataFrame:
    """Frequent item sets with support = baskets containing the set / baskets (K3).

    Spark's parallel FP-Growth; ``minCount = ceil(min_support * n)`` is the same cut as
    ``support >= min_support``.
    """
    from pyspark.ml.fpm import FPGrowth

    from lapsekit.session import cut_lineage
    n = b.select(F.count(F.lit(1))).scalar()
    model = FPGrowth(itemsCol=items, minSupport=min_support, minConfidence=1.0).fit(b)
    # freqItemsets is backed by the mining RDD and would be mined again on every use:
    # checkpoint it once (reliable checkpoint in spark.checkpoint.dir).
    # The basket count enters once, before the checkpoint, so later uses of the support do not
    # carry its subquery.
    return cut_lineage(model.freqItemsets.select(
        F.array_sort("items").alias("itemset"), F.col("freq").cast("long").alias("freq"),
        (F.col("freq") / n).alias("support"), F.size("items").alias("length")))


def vertical_itemsets(b: DataFrame, key: str, min_support: float = 0.01, max_len: int | None = None, items: str = "items") -> DataFrame:
    """Frequent item sets of at most ``max_len`` items (K3), the columns and the cut of ``frequent_itemsets``.

    Baskets (one row per ``key``) are numbered; an item is a column of bits over them, kept as a row per 64 baskets that hold it. Level by level, two
    sets that differ in their last item only meet on the words that both have; the bits of both are the baskets of the larger set.
    Counts combine map-side and only frequent sets go on, so a low support with a small ``max_len`` never builds longer sets.
    """
    from lapsekit.operators.rank import running_total
    from lapsekit.session import cut_lineage
    n = b.select(F.count(F.lit(1))).scalar()
    enough = F.col("freq") >= F.ceil(F.lit(float(min_support)) * n)
    at = running_total(b.select(key, items), [key], None, out="_r").select(F.col("_r").cast("long").alias("_r"), F.explode(F.array_distinct(items)).alias("last"))
    words = at.groupBy("last", F.floor(F.col("_r") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_r % 64 AS INT))")).alias("bits"))
    none = F.array().cast(f"array<{b.schema[items].dataType.elementType.simpleString()}>")
    level = cut_lineage(words.where(F.col("last").isNotNull()).select(none.alias("first"), "last", "word", "bits"))
    found = cut_lineage(level.groupBy("first", "last").agg(F.sum(F.bit_count("bits")).alias("freq")).where(enough))
    out, k = found, 1
    while (max_len is None or k < max_len) and not found.isEmpty():
        kept = level.join(found.select("first", "last"), ["first", "last"], "left_semi")
        other = kept.select("first", "word", F.col("last").alias("next"), F.col("bits").alias("more"))
        both = kept.join(other, ["first", "word"]).where(F.col("last") < F.col("next"))
        grown = both.select(F.concat("first", F.array("last")).alias("first"), F.col("next").alias("last"), "word", F.col("bits").bitwiseAND(F.col("more")).alias("bits"))
        level = cut_lineage(grown.where("bits <> 0"))
        found = cut_lineage(level.groupBy("first", "last").agg(F.sum(F.bit_count("bits")).alias("freq")).where(enough))
        out, k = out.unionByName(found), k + 1
    itemset = F.concat("first", F.array("last"))
    return out.select(itemset.alias("itemset"), "freq", (F.col("freq") / n).alias("support"), F.size(itemset).alias("length"))


def _splits(sets: DataFrame, itemset: str, out: str) -> DataFrame:
    """A row for each non-empty proper subset of a (sorted) array, as a sorted array.

    The 64-bit mask comes in two halves, exploded one after the other, so no row ever holds an array of 2^k masks.
    """
    k = F.size(itemset)
    low = F.floor(k / 2).cast("int")
    top = lambda n: F.expr("1L") * F.pow(F.lit(2.0), n).cast("long") - 1
    rows = (sets.withColumn("_hi", F.explode(F.sequence(F.lit(0).cast("long"), top(k - low))))
            .withColumn("_lo", F.explode(F.sequence(F.lit(0).cast("long"), top(low))))
            .withColumn("_mask", F.col("_hi") * (top(low) + 1) + F.col("_lo"))
            .where((F.col("_mask") > 0) & (F.col("_mask") < top(k))))
    bit = lambda i: F.expr("_mask").bitwiseAND((F.pow(F.lit(2.0), i)).cast("long")) != 0
    return rows.withColumn(out, F.filter(itemset, lambda x, i: bit(i))).drop("_hi", "_lo", "_mask")


def association_rules(freq: DataFrame, metric: str = "lift", min_threshold: float = 1.0) -> DataFrame:
    """Rules A -> S \\ A for every frequent set S and every non-empty proper subset A (K4, K5).

    Metrics: support, confidence, lift, leverage, conviction (null when confidence is 1),
    Zhang's metric, Jaccard, certainty, Kulczynski; rules kept where ``metric >= min_threshold``.
    """
    sup = freq.select("itemset", "support")
    multi = freq.where(F.col("length") >= 2)
    r = _splits(multi.select(F.col("itemset").alias("_s"), F.col("support")), "_s", "antecedent")
    r = r.withColumn("consequent", F.array_sort(F.array_except("_s", "antecedent")))
    r = (r.join(sup.select(F.col("itemset").alias("antecedent"), F.col("support").alias("antecedent_support")),
                on="antecedent", how="inner")
         .join(sup.select(F.col("itemset").alias("consequent"), F.col("support").alias("consequent_support")),
               on="consequent", how="inner"))
    s, sa, sc = F.col("support"), F.col("antecedent_support"), F.col("consequent_support")
    conf = s / sa
    r = r.withColumns({
        "confidence": conf,
        "lift": conf / sc,
        "leverage": s - sa * sc,
        "conviction": F.when(conf < 1, (1 - sc) / (1 - conf)),
        "zhangs_metric": F.try_divide(s - sa * sc, F.greatest(s * (1 - sa), sa * (sc - s))),
        "jaccard": s / (sa + sc - s),
        "certainty": F.try_divide(conf - sc, 1 - sc),
        "kulczynski": (s / sa + s / sc) / 2,
    })
    r = r.where(F.col(metric) >= min_threshold)
    return r.select("antecedent", "consequent", "antecedent_support", "consequent_support", "support",
                    "confidence", "lift", "leverage", "conviction", "zhangs_metric", "jaccard", "certainty",
                    "kulczynski")


def rules_as_text(rules: DataFrame) -> DataFrame:
    """Item sets rendered as 'a, b' text for export."""
    return rules.withColumns({"antecedents": itemset_str("antecedent"), "consequents": itemset_str("consequent"),
                              "antecedent_len": F.size("antecedent"), "consequent_len": F.size("consequent")}
                             ).drop("antecedent", "consequent")


def recommend(b: DataFrame, rules: DataFrame, key: str, top: int = 3, items: str = "items") -> DataFrame:
    """Suggestions from rules whose antecedent is inside the basket and whose consequent is not
    fully in it, best ``top`` per basket by confidence, then lift (K8).

    Candidate pairs come from an equi-join on the antecedent's rarest item (no cross join);
    the subset test then runs on those pairs only.
    """
    flat = b.select(key, items, F.explode(items).alias("_item"))
    often = flat.groupBy("_item").agg(F.count(F.lit(1)).alias("_often"))
    rarest = (rules.select("antecedent").distinct().withColumn("_item", F.explode("antecedent")).join(often, "_item")
              .groupBy("antecedent").agg(F.min_by("_item", F.struct("_often", "_item")).alias("_item")))
    rr = rules.join(rarest, "antecedent")
    cand = flat.join(rr, on="_item", how="inner")
    cand = cand.where((F.size(F.array_except("antecedent", items)) == 0) &
                      (F.size(F.array_except("consequent", items)) > 0))
    w = Window.partitionBy(key).orderBy(F.col("confidence").desc(), F.col("lift").desc(),
                                        itemset_str("consequent"), itemset_str("antecedent"))
    ranked = cand.withColumn("suggestion_rank", F.row_number().over(w)).where(F.col("suggestion_rank") <= top)
    return ranked.select(key, "suggestion_rank", itemset_str("antecedent").alias("because"),
                         itemset_str(F.array_except("consequent", items)).alias("suggest"), "confidence", "lift")


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line y = slope * x + intercept and R^2."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))

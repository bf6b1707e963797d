"""RFM table, scores and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsekit.functions.scalar import money_sum
from lapsekit.operators.lifecycle import CUSTOMER, DATE, present_day
from lapsekit.operators.rank import group_quantiles, rank_first

# Fixed values that must equal the reference's: quantile cut points for recency (scores 5..1) and amount.
RECENCY_QUANTILES = [0.0, 0.25, 0.45, 0.60, 0.75, 1.0]
MONETARY_QUANTILES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


def rfm(tx: DataFrame, as_of: Column | None = None, customer: str = CUSTOMER, date: str = DATE,
        session: str = "session_id", amount: str = "amount", joined: str = "first_join_date") -> DataFrame:
    """recency (days since last purchase), frequency (distinct sessions), monetary (sum of
    amount), join_period (days since joining) per customer (D7)."""
    as_of = as_of if as_of is not None else present_day(tx, date)
    g = tx.groupBy(customer).agg(
        F.max(date).cast("date").alias("_last"),
        F.count_distinct(session).alias("frequency"),
        money_sum(amount).alias("monetary"),
        F.max(joined).cast("date").alias("_joined"))
    g = g.withColumn("_as_of", as_of)
    return g.select(customer,
                    F.datediff(F.col("_as_of"), F.col("_last")).alias("recency"),
                    "frequency", "monetary",
                    F.datediff(F.col("_as_of"), F.col("_joined")).alias("join_period"))


def _ladder(value: Column, edges: Column, scores: list[int]) -> Column:
    """Right-closed bins by the first edge >= value; the lowest edge is included.

    ``edges`` holds the inner cut points in ascending order. Duplicate edges do not raise: the
    value simply goes to the first bin whose edge it does not exceed.
    """
    expr = None
    for i, s in enumerate(scores[:-1]):
        cond = value <= F.get(edges, i)
        expr = F.when(cond, F.lit(s)) if expr is None else expr.when(cond, F.lit(s))
    return expr.otherwise(F.lit(scores[-1])).cast("int")


def quantile_edges(df: DataFrame, col: str, probs: list[float]) -> Column:
    """Exact (linear) quantiles of a column with a bounded number of values (days), as one array-valued
    scalar subquery. Continuous columns go through ``group_quantiles``."""
    return df.select(F.percentile(F.col(col), F.array(*[F.lit(p) for p in probs])).alias("q")).scalar()


def qcut_rank_score(rank: Column, n: Column, q: int = 5) -> Column:
    """pandas ``qcut(rank, q)`` label for rank r of n, in integer arithmetic (Q5):
    ``max(1, ceil((r - 1) * q / (n - 1)))``; n = 1 gives 1."""
    num = (rank - 1) * q
    den = n - 1
    return F.when(den <= 0, F.lit(1)).otherwise(
        F.greatest(F.lit(1), ((num + den - 1) / den).cast("long"))).cast("int")


def tenure_score(join_period: Column) -> Column:
    """(0,90] -> 5, (90,180] -> 4, (180,270] -> 3, (270,360] -> 2, > 360 -> 1, <= 0 -> null (Q6)."""
    jp = join_period
    return (F.when(jp <= 0, F.lit(None)).when(jp <= 90, 5).when(jp <= 180, 4).when(jp <= 270, 3)
            .when(jp <= 360, 2).when(jp > 360, 1)).cast("int")


def rfm_scores(r: DataFrame, customer: str = CUSTOMER) -> DataFrame:
    """Add recency/frequency/monetary/period scores and the RF / RFM score strings.

    The per-customer table is checkpointed once: quantile edges, the count and the rank all read it.
    """
    from lapsekit.session import cut_lineage
    r = cut_lineage(r)
    rec_edges = quantile_edges(r, "recency", RECENCY_QUANTILES[1:-1])
    mon_edges = group_quantiles(r.select(F.lit(0).alias("all"), "monetary"), "all", "monetary", MONETARY_QUANTILES[1:-1])
    mon_edges = mon_edges.select("q").scalar()
    n = r.select(F.count(F.lit(1))).scalar()
    ranked = rank_first(r, "frequency", customer, out="_frank")
    # each scalar subquery enters the plan once, as a column
    ranked = ranked.withColumns({"_re": rec_edges, "_me": mon_edges, "_n": n})
    out = ranked.withColumns({
        "recency_score": _ladder(F.col("recency"), F.col("_re"), [5, 4, 3, 2, 1]),
        "frequency_score": qcut_rank_score(F.col("_frank"), F.col("_n")),
        "monetary_score": _ladder(F.col("monetary"), F.col("_me"), [1, 2, 3, 4, 5]),
        "period_score": tenure_score(F.col("join_period")),
    }).drop("_frank", "_re", "_me", "_n")
    return out.withColumns({
        "rf_score": F.concat(F.col("recency_score").cast("string"), F.col("frequency_score").cast("string")),
        "rfm_score": F.concat(F.col("recency_score").cast("string"), F.col("frequency_score").cast("string"),
                              F.col("monetary_score").cast("string")),
    })


def segment_of(r: Column, f: Column, period: Column) -> Column:
    """Segment name from the two integer scores; tenure score 5 -> new_customers."""
    seg = (F.when(r <= 2, F.when(f <= 2, "hibernating").when(f <= 4, "at_Risk").otherwise("cant_loose"))
           .when(r == 3, F.when(f <= 2, "about_to_sleep").when(f == 3, "need_attention").otherwise("loyal_customers"))
           .when(r == 4, F.when(f == 1, "promising").when(f <= 3, "potential_loyalists").otherwise("loyal_customers"))
           .otherwise(F.when(f == 1, "promising").when(f <= 3, "potential_loyalists").otherwise("champions")))
    return F.when(period == 5, F.lit("new_customers")).otherwise(seg)


def rfm_segment(df: DataFrame) -> DataFrame:
    return df.withColumn("segment", segment_of(F.col("recency_score"), F.col("frequency_score"), F.col("period_score")))


def rfm_table(tx: DataFrame, as_of: Column | None = None) -> DataFrame:
    """rfm -> scores -> segment in one call."""
    return rfm_segment(rfm_scores(rfm(tx, as_of)))

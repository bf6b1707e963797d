"""One state per customer for C6, C7, C10 and what builds on them.

``purchase_state`` is one aggregate of the item table, ``click_state`` one of the click log. Both hold only counts, sums and ends of
ranges, so states of parts of the input merge into the state of the whole (``merge_purchases``, ``merge_clicks``): new files are aggregated by themselves. Everything
per customer is derived from them by column arithmetic. Stored in buckets by customer (``session.bucketed``), the tables join and aggregate without an exchange.

A session's rows lie in one part (its booking is one row), so distinct sessions add up. Money is an exact decimal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsekit.functions.scalar import money
from lapsekit.operators.activity import CUSTOMER, event_counts
from lapsekit.operators.lifecycle import DATE, iqr_fence
from lapsekit.operators.rfm import rfm_scores, rfm_segment

_WIDE = "decimal(38,4)"


def purchase_state(tx: DataFrame, customer: str = CUSTOMER, date: str = DATE, session: str = "session_id", amount: str = "amount",
                   joined: str = "first_join_date") -> DataFrame:
    """Mergeable purchase aggregates of each customer."""
    return tx.groupBy(customer).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(date).cast("date").alias("first_purchase"), F.max(date).cast("date").alias("last_purchase"),
        F.count_distinct(session).alias("n_sessions"), F.count(amount).alias("n_amounts"), F.sum(money(amount)).cast(_WIDE).alias("amount_sum"),
        F.max(joined).cast("date").alias("joined"))


def merge_purchases(parts: DataFrame, customer: str = CUSTOMER) -> DataFrame:
    """States of parts (rows of several ``purchase_state`` results) as one state."""
    return parts.groupBy(customer).agg(
        F.sum("n_rows").alias("n_rows"), F.min("first_purchase").alias("first_purchase"), F.max("last_purchase").alias("last_purchase"),
        F.sum("n_sessions").alias("n_sessions"), F.sum("n_amounts").alias("n_amounts"), F.sum("amount_sum").cast(_WIDE).alias("amount_sum"),
        F.max("joined").alias("joined"))


def click_state(ev: DataFrame, kinds: Sequence[str], customer: str = CUSTOMER) -> DataFrame:
    """Mergeable event counts of each customer."""
    return event_counts(ev, [customer], kinds)


def merge_clicks(parts: DataFrame, customer: str = CUSTOMER) -> DataFrame:
    return parts.groupBy(customer).agg(*[F.sum(c).alias(c) for c in parts.columns if c != customer])


def with_cycle(state: DataFrame) -> DataFrame:
    """Span and mean purchase cycle (D1) of a purchase state."""
    span = F.datediff("last_purchase", "first_purchase")
    cycle = F.when(F.col("n_rows") > 1, F.expr("datediff(last_purchase, first_purchase) div (n_rows - 1)")).otherwise(0)
    return state.withColumns({"span_days": span, "avg_pur_cycle": cycle.cast("long")})


def average_order(state: DataFrame) -> Column:
    """Mean amount of an item row, in cents."""
    return F.round(F.try_divide(F.col("amount_sum"), F.col("n_amounts")), 2).cast("double")


def with_recency(state: DataFrame, as_of: Column) -> DataFrame:
    """recency, frequency, monetary, join_period (D7) of a purchase state."""
    d = state.withColumn("_as_of", as_of)
    return d.withColumns({"recency": F.datediff("_as_of", "last_purchase"), "frequency": F.col("n_sessions"),
                          "monetary": F.col("amount_sum").cast("double"), "join_period": F.datediff("_as_of", "joined")}).drop("_as_of")


def fence(state: DataFrame, k: float = 1.5) -> DataFrame:
    """The lapse fence (D3) of a purchase state."""
    return iqr_fence(with_cycle(state), "avg_pur_cycle", k, where=F.col("avg_pur_cycle") != 0)


def lapsed(state: DataFrame, as_of: Column, customer: str = CUSTOMER) -> DataFrame:
    """(customer, last_purchase, days_since, is_churned)."""
    d = state.select(customer, "last_purchase").withColumns({"_as_of": as_of, "_fence": fence(state).select("upper_bound").scalar()})
    d = d.withColumn("days_since", F.datediff("_as_of", "last_purchase"))
    return d.withColumn("is_churned", F.col("days_since").cast("double") > F.col("_fence")).drop("_as_of", "_fence")


def scored(state: DataFrame, as_of: Column, customer: str = CUSTOMER) -> DataFrame:
    """The RFM table (D7, E6-E11) of a purchase state."""
    return rfm_segment(rfm_scores(with_recency(state, as_of).select(customer, "recency", "frequency", "monetary", "join_period")))


def judged(state: DataFrame, as_of: Column, customer: str = CUSTOMER) -> DataFrame:
    """RFM scores, segment and lapse label of each customer, one row each."""
    return scored(state, as_of, customer).join(lapsed(state, as_of, customer), customer)


def info(purchases: DataFrame, clicks: DataFrame, verdicts: DataFrame, kinds: Sequence[str], booking_kind: str, customer: str = CUSTOMER) -> DataFrame:
    """The customer feature table (C6) from the stored states: customers with purchases and clicks."""
    rate = F.round(F.coalesce(F.try_divide(F.col(booking_kind) * 100.0, F.col("n_events")), F.lit(0.0)), 2)
    joined = with_cycle(purchases).withColumns({"aov": average_order(purchases), "amount": F.col("amount_sum").cast("double")}).join(clicks, customer)
    return joined.join(verdicts.drop("last_purchase"), customer).select(
        customer, "avg_pur_cycle", "aov", "recency", "frequency", "join_period", *kinds, "n_events", "amount", "segment", "is_churned", rate.alias("conversion_rate"))

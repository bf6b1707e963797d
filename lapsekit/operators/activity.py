"""Click-stream activity, conversion and the customer feature tables.

The reference joins per-session event counts to item rows, so every count is multiplied by the
number of items in the session (Q8). Both meanings are offered, without a row blow-up:

* ``weight="item"``   -- the reference value: each session's counts times its item count;
* ``weight="session"`` -- each session counted once.

The item count per session is aggregated first (one row per session) and multiplied in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsekit.functions.scalar import money_avg, money_sum, planar_distance, ratio_or_zero, row_sum, safe_ratio

CUSTOMER = "customer_id"


def event_counts(ev: DataFrame, keys: Sequence[str], kinds: Sequence[str], kind: str = "event_name") -> DataFrame:
    """Per-key count of each event kind, 0 when absent, plus the total.

    The session x kind pivot with an explicit kind list, written as one aggregate of ``count_if``
    per kind: a single shuffle, no pass to discover the values, fixed width.
    """
    aggs = [F.count_if(F.col(kind) == F.lit(k)).alias(k) for k in kinds]
    return ev.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n_events"))


def session_items(tx: DataFrame, session: str = "session_id", customer: str = CUSTOMER,
                  amount: str = "amount") -> DataFrame:
    """One row per session: customer, item rows, amount (the 'items' side of C4)."""
    return tx.groupBy(session, customer).agg(F.count(F.lit(1)).alias("n_items"),
                                             money_sum(amount).alias("amount"))


def weighted_activity(counts: DataFrame, items: DataFrame, kinds: Sequence[str], weight: str = "item",
                      on: str = "session_id", customer: str = CUSTOMER) -> DataFrame:
    """Per-customer sums of per-session kind counts and amount.

    ``counts``: one row per session with a column per kind (``event_counts``); ``items``: one row
    per session with ``n_items`` and ``amount`` (``session_items``). Inner join, as the reference.
    """
    j = counts.join(items, on=on, how="inner")
    w = F.col("n_items") if weight == "item" else F.lit(1)
    aggs = [F.sum(F.col(k) * w).alias(k) for k in kinds]
    aggs.append(F.sum(F.col("n_events") * w).alias("n_events"))
    # item rows carry their own amounts, so the amount is the session total in both modes
    aggs.append(money_sum("amount").alias("amount"))
    return j.groupBy(customer).agg(*aggs)


def conversion_rate(counts: DataFrame, booking_kind: str, keys: Sequence[str] = (CUSTOMER,),
                    weight_col: str | None = None) -> DataFrame:
    """BOOKING events / all events x 100 per key, rounded to 2 places; 0 without bookings."""
    w = F.col(weight_col) if weight_col else F.lit(1)
    g = counts.groupBy(*keys).agg(F.sum(F.col(booking_kind) * w).alias("n_bookings"),
                                  F.sum(F.col("n_events") * w).alias("n_events"))
    rate = F.coalesce(F.try_divide(F.col("n_bookings") * 100.0, F.col("n_events")), F.lit(0.0))
    return g.withColumn("conversion_rate", F.round(rate, 2))


def aov(tx: DataFrame, customer: str = CUSTOMER, amount: str = "amount") -> DataFrame:
    """Average item-row amount per customer, rounded to cents."""
    return tx.groupBy(customer).agg(money_avg(amount, 2).alias("aov"))


def traffic_pivot(ev: DataFrame, session: str = "session_id", source: str = "traffic_source",
                  mobile: str = "MOBILE", web: str = "WEB") -> DataFrame:
    """Per-session event counts by traffic source and a mobile flag.

    The reference takes the mean of a 0/1 code per source, which makes its ``web`` column
    always 0; counts keep the information and ``has_mobile`` equals its ``mobile`` column.
    """
    return ev.groupBy(session).agg(F.count_if(F.col(source) == mobile).alias("mobile_events"),
                                   F.count_if(F.col(source) == web).alias("web_events"),
                                   (F.count_if(F.col(source) == mobile) > 0).cast("int").alias("has_mobile"))


def recent_features(recent_rows: DataFrame, session_counts: DataFrame, traffic: DataFrame | None = None,
                    session: str = "session_id") -> DataFrame:
    """Recent item rows joined with their session's event counts and traffic counts.

    Both right-hand tables are one row per session, so the inner joins keep the item grain
    (items of sessions without click data drop out, as in the reference)."""
    out = recent_rows.join(session_counts, on=session, how="inner")
    if traffic is not None:
        out = out.join(traffic, on=session, how="inner")
    return out.dropDuplicates()


def customer_info(cycle: DataFrame, aov_df: DataFrame, rfm_df: DataFrame, activity: DataFrame,
                  segments: DataFrame, lapsed: DataFrame, conversion: DataFrame,
                  profile: DataFrame | None = None, customer: str = CUSTOMER) -> DataFrame:
    """Customer feature table: chain of inner joins on the customer key.

    Inner joins drop customers without click data, as in the reference. Every input is one row
    per customer, so the joins never multiply rows.
    """
    parts = [cycle.select(customer, "avg_pur_cycle"), aov_df,
             rfm_df.select(customer, "recency", "frequency", "join_period"), activity]
    if profile is not None:
        parts.append(profile)
    parts += [segments.select(customer, "segment"), lapsed.select(customer, "is_churned"),
              conversion.select(customer, "conversion_rate")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, on=customer, how="inner")
    return out


def behavior_features(activity: DataFrame, aov_df: DataFrame, kinds_activity: Sequence[str], booking_kind: str,
                      info: DataFrame, lapsed: DataFrame, center: tuple[float, float] | None = None,
                      lat: str = "home_location_lat", lon: str = "home_location_long",
                      customer: str = CUSTOMER) -> DataFrame:
    """Derived behaviour features in a past window.

    ``total_activity`` = row sum of the non-booking kinds; ``activity_ratio`` = safe booking /
    activity ratio; ``amount_to_aov`` = amount / aov (0 for a zero aov); ``recency_ratio`` =
    safe recency / purchase cycle; ``distance_from_center`` when coordinates are given.
    """
    b = activity.join(aov_df, on=customer, how="inner")
    b = b.withColumn("total_activity", row_sum(kinds_activity))
    b = b.withColumn("activity_ratio", safe_ratio(booking_kind, "total_activity"))
    b = b.withColumn("amount_to_aov", ratio_or_zero("amount", "aov"))
    if center is not None:
        b = b.withColumn("distance_from_center", planar_distance(lat, lon, center[0], center[1]))
    b = b.join(info.select(customer, "avg_pur_cycle", "recency", "join_period", "segment"), on=customer, how="inner")
    b = b.withColumn("recency_ratio", safe_ratio("recency", "avg_pur_cycle"))
    return b.join(lapsed.select(customer, "is_churned"), on=customer, how="inner")


def group_mean_diff(df: DataFrame, label: str, cols: Sequence[str], places: int = 2) -> DataFrame:
    """Per-feature mean of each label group and the (label false - label true) difference, long
    form (D14): one row per feature."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.when(~F.col(label), F.col(c))).alias(f"{c}__f"), F.avg(F.when(F.col(label), F.col(c))).alias(f"{c}__t")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__f`, `{c}__t`" for c in cols)
    long = wide.selectExpr(f"stack({len(cols)}, {stack}) as (feature, mean_active, mean_lapsed)")
    return long.select("feature", F.round("mean_active", places).alias("mean_active"),
                       F.round("mean_lapsed", places).alias("mean_lapsed"),
                       F.round(F.round("mean_active", places) - F.round("mean_lapsed", places), places).alias("diff"))


def customer_model_table(df: DataFrame, sum_cols: Sequence[str], key: str = CUSTOMER,
                         drop: Sequence[str] = ()) -> DataFrame:
    """Customer grain: ``sum`` for the named columns, ``avg`` for every other numeric column.
    The aggregate list is generated from the schema, not typed out."""
    from pyspark.sql import types as T
    numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)
    aggs = []
    for f in df.schema.fields:
        if f.name == key or f.name in drop or not isinstance(f.dataType, numeric):
            continue
        c = F.col(f.name).cast("double") if isinstance(f.dataType, T.BooleanType) else F.col(f.name)
        aggs.append((F.sum(c) if f.name in sum_cols else F.avg(c)).alias(f.name))
    return df.groupBy(key).agg(*aggs)

"""Purchase rhythm, lapse label, cohorts, time windows.

Scalars that the reference computes once (as-of date, lapse fence) stay inside the plan as
scalar subqueries (``DataFrame.scalar()``): Spark runs the one-row aggregate once and inlines
the value. Nothing is collected to the driver and no cross join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUSTOMER = "customer_id"
DATE = "transaction_date"


# --- B13-B15: as-of date and windows ---------------------------------------------------------

def present_day(df: DataFrame, col: str = DATE, days: int = 2) -> Column:
    """As-of date = max(date) + ``days`` (B13), as a scalar subquery column."""
    return df.select(F.date_add(F.max(F.col(col)).cast("date"), days).alias("as_of")).scalar()


def trailing_window(df: DataFrame, col: str = DATE, years: int = 1, as_of: Column | None = None,
                    days: int = 2, year_partition: str | None = None, month_partition: str | None = None) -> DataFrame:
    """Rows with ``col >= as_of - years`` (B14). Each table may use its own as-of date.

    With ``year_partition`` (a partition column holding ``year(col)``) the same bound is also
    stated on the partition column, so whole year directories are skipped at scan time; the same for
    ``month_partition`` (a partition column holding the first day of the month).
    """
    as_of = as_of if as_of is not None else present_day(df, col, days)
    start = F.add_months(as_of, -12 * years)
    if year_partition:
        df = df.where(F.col(year_partition) >= F.year(start))
    if month_partition:
        df = df.where(F.col(month_partition) >= F.trunc(start, "MM"))
    return df.where(F.col(col) >= start)


def days_before(as_of: Column, days) -> Column:
    """Timestamp ``as_of - days``; ``days`` may be fractional (compared to the second)."""
    d = days if isinstance(days, Column) else F.lit(float(days))
    secs = (d * 86400.0).cast("decimal(18,6)")
    return as_of.cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


def window_between(df: DataFrame, col: str, lo_days, hi_days, as_of: Column) -> DataFrame:
    """Rows in ``[as_of - hi_days, as_of - lo_days)``."""
    c = F.col(col).cast("timestamp_ntz")
    d = df.withColumns({"_lo_d": lo_days if isinstance(lo_days, Column) else F.lit(float(lo_days)),
                        "_hi_d": hi_days if isinstance(hi_days, Column) else F.lit(float(hi_days)),
                        "_as_of": as_of})
    d = d.where((c >= days_before(F.col("_as_of"), F.col("_hi_d"))) & (c < days_before(F.col("_as_of"), F.col("_lo_d"))))
    return d.drop("_lo_d", "_hi_d", "_as_of")


# --- D1-D4: purchase cycle, fence, lapse label --------------------------------------------------

def purchase_cycle(tx: DataFrame, customer: str = CUSTOMER, date: str = DATE) -> DataFrame:
    """Average days between purchases per customer.

    The mean of consecutive differences telescopes to (last - first) / (n - 1); ``n`` counts item
    rows, as in the reference, and whole days are floored. One row -> 0 (Q2, Q3).
    Plain ``groupBy`` with count/min/max: combines map-side, so a hot customer costs nothing.
    """
    g = tx.groupBy(customer).agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.min(date).cast("date").alias("first_purchase"),
                                 F.max(date).cast("date").alias("last_purchase"))
    span = F.datediff("last_purchase", "first_purchase")
    cycle = F.when(F.col("n_rows") > 1, F.expr("datediff(last_purchase, first_purchase) div (n_rows - 1)")).otherwise(0)
    return g.withColumn("span_days", span).withColumn("avg_pur_cycle", cycle.cast("long"))


def mean_cycle(cycles: DataFrame, col: str = "avg_pur_cycle") -> DataFrame:
    """Mean purchase cycle over customers with a non-zero cycle."""
    return cycles.where(F.col(col) != 0).agg(F.avg(col).alias("mean_cycle"), F.count(F.lit(1)).alias("n_customers"))


def iqr_fence(df: DataFrame, col: str, k: float = 1.5, where: Column | None = None,
              approx: bool = False, accuracy: int = 100000) -> DataFrame:
    """One row: q1, q3, iqr, upper = q3 + k * iqr (D3).

    Exact ``percentile`` interpolates linearly like pandas. It keeps a value -> count map, which is
    small for day counts; ``approx=True`` switches to ``percentile_approx`` for wide domains.
    """
    src = df.where(where) if where is not None else df
    if approx:
        q = F.percentile_approx(F.col(col).cast("double"), [0.25, 0.75], accuracy)
    else:
        q = F.percentile(F.col(col), F.array(F.lit(0.25), F.lit(0.75)))
    qs = src.agg(q.alias("_q"))
    q1, q3 = F.get(F.col("_q"), 0).cast("double"), F.get(F.col("_q"), 1).cast("double")
    return qs.select(q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"),
                     (q3 + F.lit(k) * (q3 - q1)).alias("upper_bound"))


def lapse_fence(tx: DataFrame, k: float = 1.5, approx: bool = False) -> DataFrame:
    """Fence on the non-zero purchase cycles (D3 as used by D4)."""
    cyc = purchase_cycle(tx)
    return iqr_fence(cyc, "avg_pur_cycle", k, where=F.col("avg_pur_cycle") != 0, approx=approx)


def lapsed_label(tx: DataFrame, fence: Column | None = None, as_of: Column | None = None,
                 customer: str = CUSTOMER, date: str = DATE) -> DataFrame:
    """``is_churned`` = (as_of - last purchase) > fence days."""
    fence = fence if fence is not None else lapse_fence(tx).select("upper_bound").scalar()
    as_of = as_of if as_of is not None else present_day(tx, date)
    last = tx.groupBy(customer).agg(F.max(date).cast("date").alias("last_purchase"))
    last = last.withColumns({"_as_of": as_of, "_fence": fence})
    since = F.datediff(F.col("_as_of"), F.col("last_purchase"))
    return (last.withColumn("days_since", since)
            .withColumn("is_churned", F.col("days_since").cast("double") > F.col("_fence"))
            .drop("_as_of", "_fence"))


# --- D5, D6, E2: cohorts ----------------------------------------------------------------------

def first_purchase(tx: DataFrame, customer: str = CUSTOMER, date: str = DATE) -> DataFrame:
    """First purchase date on every row (E2), as aggregate + join, not a per-customer window."""
    firsts = tx.groupBy(customer).agg(F.min(date).cast("date").alias("first_purchase"))
    return tx.join(firsts, on=customer, how="inner")


def cohort_counts(tx: DataFrame, customer: str = CUSTOMER, date: str = DATE) -> DataFrame:
    """Distinct customers per (first-purchase month, order month)."""
    base = tx.select(customer, F.col(date).cast("date").alias("_d")).distinct()
    firsts = base.groupBy(customer).agg(F.trunc(F.min("_d"), "month").alias("cohort"))
    monthly = base.select(customer, F.trunc("_d", "month").alias("order_month")).distinct()
    counts = (monthly.join(firsts, on=customer).groupBy("cohort", "order_month")
              .agg(F.count(F.lit(1)).alias("n_customers")))
    period = ((F.year("order_month") - F.year("cohort")) * 12 + F.month("order_month") - F.month("cohort"))
    return counts.withColumn("period_number", period.cast("int"))


def cohort_retention(tx: DataFrame, **kw) -> DataFrame:
    """Cohort size (period 0) and retention share per period, long form."""
    counts = cohort_counts(tx, **kw)
    sizes = counts.where(F.col("period_number") == 0).select("cohort", F.col("n_customers").alias("cohort_size"))
    return (counts.join(sizes, on="cohort", how="left")
            .withColumn("retention", F.col("n_customers") / F.col("cohort_size")))


def cohort_matrix(retention: DataFrame, max_period: int) -> DataFrame:
    """Wide cohort x period view with explicit period columns (no discovery pass)."""
    return (retention.groupBy("cohort", "cohort_size")
            .pivot("period_number", list(range(max_period + 1))).agg(F.first("retention")))


# --- E3, E4: per-customer date order -------------------------------------------------------------

def purchase_dates(tx: DataFrame, customer: str = CUSTOMER, date: str = DATE) -> DataFrame:
    """One row per (customer, purchase date) with the item-row count. A customer has at most one
    row per calendar day, so per-customer windows over this table stay small even for a customer
    holding a third of all rows."""
    return tx.groupBy(customer, F.col(date).cast("date").alias(date)).agg(F.count(F.lit(1)).alias("n_rows"))


def purchase_gaps(tx: DataFrame, customer: str = CUSTOMER, date: str = DATE) -> DataFrame:
    """Days since the previous purchase date (E4). In row form the first row of a date carries the
    gap and the other ``n_rows - 1`` rows of that date a gap of 0."""
    from pyspark.sql import Window
    d = purchase_dates(tx, customer, date)
    w = Window.partitionBy(customer).orderBy(date)
    return d.withColumn("gap_days", F.datediff(F.col(date), F.lag(date).over(w)))


def last_n_dates(tx: DataFrame, n: int = 3, customer: str = CUSTOMER, date: str = DATE) -> DataFrame:
    """All item rows on each customer's latest ``n`` distinct purchase dates."""
    from pyspark.sql import Window
    d = purchase_dates(tx, customer, date)
    ranked = d.withColumn("date_rank", F.row_number().over(Window.partitionBy(customer).orderBy(F.col(date).desc())))
    keep = ranked.where(F.col("date_rank") <= n).select(customer, date, "date_rank")
    return tx.join(keep, on=[customer, date], how="inner")

"""Customer metrics kept up to date by a stream of purchases.

Each micro-batch is aggregated by itself into partial states (``operators.customer.purchase_state``) and written under its batch id. The states
merge, so the metrics are those of a base and the batches behind it. Every ``compact`` batches these become the next base and what it
replaces goes: reading stays cheap, and no batch rewrites the states of all customers.

A batch id counts once: a repeated batch overwrites its own part, and one that a base already holds is skipped. A base names the last
batch it holds and counts only when it is committed; a run that dies at any point is repeated with the same result. A batch holds whole bookings
(a booking's item rows arrive in one file), as ``purchase_state`` asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsekit.operators import customer as cu
from lapsekit.session import children, exists, remove


def _committed(spark: SparkSession, path: str, kind: str) -> dict[int, str]:
    """Batch id -> folder of the written bases or parts."""
    names = [n for n in children(spark, f"{path}/{kind}") if exists(spark, f"{path}/{kind}/{n}/_SUCCESS")]
    return {int(n): f"{path}/{kind}/{n}" for n in names}


def _parts(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Last batch of the newest base (-1: none) and the folders that make up the state."""
    bases = _committed(spark, path, "base")
    last = max(bases, default=-1)
    behind = [f for b, f in sorted(_committed(spark, path, "batch").items()) if b > last]
    return last, ([bases[last]] if bases else []) + behind


def merge_batch(batch: DataFrame, batch_id: int, path: str, compact: int = 20) -> None:
    """Take one micro-batch of item rows into the state at ``path`` (the function of ``foreachBatch``)."""
    spark = batch.sparkSession
    last, _ = _parts(spark, path)
    if batch_id <= last:
        return
    cu.purchase_state(batch).write.mode("overwrite").parquet(f"{path}/batch/{batch_id}")
    last, folders = _parts(spark, path)
    if len(folders) > compact:
        newest = max(_committed(spark, path, "batch"))
        cu.merge_purchases(spark.read.parquet(*folders)).write.mode("overwrite").parquet(f"{path}/base/{newest}")
        for f in folders:                                           # only after the new base is committed
            remove(spark, f)


def live_state(spark: SparkSession, path: str) -> DataFrame:
    """The purchase state of all batches so far, one row per customer."""
    _, folders = _parts(spark, path)
    if not folders:
        raise ValueError(f"no batch has been taken into {path}")
    return cu.merge_purchases(spark.read.parquet(*folders))


def live_metrics(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """Average order value, historical value, orders, last purchase, lapse label of each customer as of a date."""
    from lapsekit.session import cut_lineage
    state = cut_lineage(live_state(spark, path))
    return metrics(state, cu.lapsed(state, as_of))


def metrics(state: DataFrame, labels: DataFrame, customer: str = cu.CUSTOMER) -> DataFrame:
    """Dashboard metrics (J17) of a purchase state and lapse labels."""
    values = state.select(customer, cu.average_order(state).alias("aov"), F.col("amount_sum").cast("double").alias("historical_value"),
                          F.col("n_sessions").alias("orders"))
    return values.join(labels.select(customer, "last_purchase", "is_churned"), customer)


def start_live(items: DataFrame, path: str, checkpoint: str, compact: int = 20):
    """Keep the state at ``path`` up to date from a stream of item rows; both folders lie in the shared folder on a cluster."""
    return (items.writeStream.foreachBatch(lambda batch, batch_id: merge_batch(batch, batch_id, path, compact))
            .option("checkpointLocation", checkpoint).start())

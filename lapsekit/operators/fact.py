"""Item-grain fact table: bookings x items x customers x products."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsekit.functions.scalar import line_amount


def once_per_group(df: DataFrame, group: Sequence[str] | str, col: str, order: Sequence[str],
                   out: str | None = None) -> DataFrame:
    """Keep ``col`` only on the first row (by ``order``) of each run of equal values in a group,
    0 elsewhere (E1).

    A booking-level amount repeated on every item row is counted once. Written as
    ``min(order key)`` per (group, value) plus an equi-join on (group, value, key), not as a
    window: a window would put a whole hot group into one task, while the aggregate combines
    map-side and the three-column join spreads a hot group over many partitions.
    ``order`` must identify a row within a group.
    """
    group = [group] if isinstance(group, str) else list(group)
    out = out or col
    key = F.struct(*[F.col(c) for c in order])
    firsts = (df.groupBy(*group, col).agg(F.min(key).alias("_first"))
              .select(*[F.col(g).alias(f"_g_{i}") for i, g in enumerate(group)], F.col(col).alias("_v"),
                      *[F.col(f"_first.{c}").alias(f"_k_{c}") for c in order], F.lit(True).alias("_is_first")))
    cond = [F.col(g).eqNullSafe(F.col(f"_g_{i}")) for i, g in enumerate(group)] + [F.col(col).eqNullSafe(F.col("_v"))]
    cond += [F.col(c) == F.col(f"_k_{c}") for c in order]
    joined = df.join(firsts, on=cond, how="left")
    keep = F.when(F.col("_is_first"), F.col(col)).otherwise(F.lit(0).cast(df.schema[col].dataType))
    if out == col:
        cols = [keep.alias(col) if c == col else F.col(c) for c in df.columns]
    else:
        cols = [F.col(c) for c in df.columns] + [keep.alias(out)]
    return joined.select(*cols)


def merge_fact(bookings: DataFrame, items: DataFrame, customers: DataFrame, products: DataFrame,
               item_order: Sequence[str] = ("item_pos",),
               once_cols: Sequence[str] = ("promo_amount", "shipment_fee"), late: Mapping[str, Column] | None = None,
               partitions: int | None = None) -> DataFrame:
    """Item-grain fact table ``tx``.

    * items carry ``booking_id`` from the explode (no positional alignment, Q1): inner join;
    * customers are joined left, so bookings of unknown customers stay (C1);
    * products are joined left, so items of unknown products stay (C3);
    * booking-level promo / fee are kept once per session (E1), then
      ``amount = item_price * quantity - promo + fee`` (B12).

    Customers meet the bookings before the items do, and the items meet their bookings before their products: a reader's bound on the
    date or the customer then leaves only its own item rows for the second exchange. ``late`` gives item columns made from others after
    the last join; inputs of theirs that are no column of the fact table are named ``_...`` and dropped. ``partitions`` sets the
    number of parts of both exchanges of the items, so that a task's rows stay in memory whatever the size of the tables.

    No broadcast hints: AQE turns a join into a broadcast at run time when the measured side is
    small enough, and keeps a shuffle join otherwise.
    """
    late = dict(late or {})
    heads = bookings.join(customers, on="customer_id", how="left")
    spread = (lambda d, key: d.repartition(partitions, key)) if partitions else (lambda d, key: d)
    tx = spread(spread(items, "booking_id").join(heads, on="booking_id", how="inner"), "product_id")
    tx = tx.join(products, on="product_id", how="left").withColumns(late)
    keys = ["product_id", "customer_id", "booking_id"]
    tx = tx.select(*keys, *[c for d in (items, bookings, customers, products) for c in d.columns if c not in keys and not c.startswith("_")], *late)
    for c in once_cols:
        tx = once_per_group(tx, "session_id", c, list(item_order))
    return tx.withColumn("amount", line_amount("item_price", "quantity", "promo_amount", "shipment_fee"))

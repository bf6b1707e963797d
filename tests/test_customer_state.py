"""The stored customer state: parts merge into the whole, joins need no exchange, files are found again."""

from pyspark.sql import functions as F

from lapsekit.operators import customer as cu
from lapsekit.operators import lifecycle as lc
from lapsekit.operators.activity import aov, event_counts
from lapsekit.operators.rfm import rfm
from lapsekit.plans.catalog import customer_info
from lapsekit.sources import testdata as td
from paths import SF_SMALL


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_parts_merge_into_the_whole(spark):
    tx, ev = td.fact(spark, SF_SMALL), td.events(spark, SF_SMALL)
    parts = [cu.purchase_state(tx.where(F.pmod(F.xxhash64("booking_id"), F.lit(3)) == i)) for i in range(3)]
    whole = cu.purchase_state(tx)
    assert rows(cu.merge_purchases(parts[0].unionByName(parts[1]).unionByName(parts[2]))) == rows(whole)
    clicks = [cu.click_state(ev.where(F.pmod("event_id", F.lit(2)) == i), td.EVENT_KINDS) for i in range(2)]
    assert rows(cu.merge_clicks(clicks[0].unionByName(clicks[1]))) == rows(event_counts(ev, ["customer_id"], td.EVENT_KINDS))


def test_state_gives_what_the_item_table_gives(spark):
    tx, as_of = td.fact(spark, SF_SMALL), td.as_of(spark, SF_SMALL)
    state = td.purchases(spark, SF_SMALL)
    assert rows(cu.with_cycle(state).select(*lc.purchase_cycle(tx).columns)) == rows(lc.purchase_cycle(tx))
    assert rows(cu.with_recency(state, as_of).select(*rfm(tx, as_of).columns)) == rows(rfm(tx, as_of))
    assert rows(state.select("customer_id", cu.average_order(state).alias("aov"))) == rows(aov(tx))
    assert rows(cu.lapsed(state, as_of)) == rows(lc.lapsed_label(tx, as_of=as_of))


def test_customer_info_joins_without_exchange(spark):
    customer_info(spark, SF_SMALL).count()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = customer_info(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
    assert plan.count("FileScan parquet") == 3 and "fact_all" not in plan and "events_all" not in plan


def test_stored_state_is_named_anew(spark):
    """What a later application does: the files are there, the table's name isn't."""
    before = rows(td.purchases(spark, SF_SMALL))
    table = [t.name for t in spark.catalog.listTables() if t.name.startswith("lapsekit_customer_purchases")]
    for t in table:
        spark.sql(f"DROP TABLE {t}")
    assert table and rows(td.purchases(spark, SF_SMALL)) == before
    plan = td.purchases(spark, SF_SMALL).groupBy("customer_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan

"""The fact table as a plan: readers run the columns and dates they ask for, and no wide table is written for them."""

import datetime

from pyspark.sql import Row
from pyspark.sql import functions as F

from lapsekit.operators.fact import merge_fact
from lapsekit.plans.catalog import orders_by_month
from lapsekit.session import children, tables_dir
from lapsekit.sources import testdata as td


def make_tables(spark, folder, stamp=datetime.datetime(2024, 3, 1)):
    day = lambda n: stamp + datetime.timedelta(days=n)
    tables = {
        "orders": ([Row(o_orderkey=i, o_custkey=i % 3 if i else None, o_orderstatus="F", o_totalprice=1.0, o_orderdate=day(i), o_orderpriority="2-HIGH") for i in range(6)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        # order 5, the latest, has no items; part 1 is there twice, part 9 isn't
        "lineitem": ([Row(l_orderkey=o, l_partkey=p, l_suppkey=1, l_linenumber=n, l_quantity=2.0, l_extendedprice=10.0 * (n + 1), l_discount=0.1, l_returnflag="N", l_shipdate=day(9))
                      for o in (0, 1, 2, 3, 4, 7, None) for n, p in enumerate((1, 9, None))],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp"),
        "part": ([Row(p_partkey=p, p_name="blue", p_brand=b, p_type="PROMO", p_size=1) for p, b in ((1, "x"), (1, "y"), (2, "z"))],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "customer": ([Row(c_custkey=c, c_name="n", c_nationkey=1, c_acctbal=1.0, c_mktsegment="m") for c in (1, 2)],
                     "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_a_query_writes_no_fact_table_and_reads_its_own_columns(spark, tmp_path):
    sf = make_tables(spark, tmp_path / "t")
    before = set(children(spark, tables_dir(spark)))
    out = orders_by_month(spark, sf)
    assert [tuple(r) for r in out.select("month", "item_rows", "orders").collect()] == [("March", 20, 5)]
    assert {n.split("-")[0] for n in set(children(spark, tables_dir(spark))) - before} == {"fact_as_of"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "p_name" not in plan and "c_mktsegment" not in plan


def test_the_plan_gives_the_rows_of_the_stored_table(spark, tmp_path):
    sf = make_tables(spark, tmp_path / "t")
    plan = rows(td.fact_all(spark, sf))
    assert len(plan) == 20 and rows(td.fact_all(spark, sf, rebuild=True)) == plan and rows(td.fact_all(spark, sf)) == plan
    as_of = spark.range(1).select(td.as_of(spark, sf)).first()[0]
    assert as_of == datetime.date(2024, 3, 7)           # of order 4: the latest with items


def test_set_parts_of_the_exchanges_change_no_rows(spark, tmp_path, monkeypatch):
    sf = make_tables(spark, tmp_path / "t")
    sides = (td.bookings(spark, sf), td.items(spark, sf), td.customers(spark, sf), td.products(spark, sf))
    whole = merge_fact(*sides, item_order=td.ITEM_ORDER, once_cols=(), late={"item_price": td.item_price()})
    parts = merge_fact(*sides, item_order=td.ITEM_ORDER, once_cols=(), late={"item_price": td.item_price()}, partitions=3)
    assert rows(parts) == rows(whole) and "REPARTITION_BY_NUM" in parts._jdf.queryExecution().executedPlan().toString()
    assert td.item_parts(spark, sf) is None
    monkeypatch.setattr(td, "ITEM_PART_BYTES", 8)
    assert td.item_parts(spark, sf) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert td.fact_all(spark, sf).agg(F.count(F.lit(1))).first()[0] == 20


def test_model_rows_are_those_of_customers_with_clicks(spark):
    from lapsekit.plans.catalog import _recent_rows
    from paths import SF_SMALL
    tx, recent = _recent_rows(spark, SF_SMALL)
    clicked = td.clicks(spark, SF_SMALL).select("customer_id")
    assert tx.join(clicked, "customer_id", "left_anti").count() == 0
    assert recent.select("customer_id").distinct().count() == td.fact(spark, SF_SMALL).join(clicked, "customer_id").select("customer_id").distinct().count()

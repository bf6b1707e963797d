"""A1-A5: fixed-schema reads, Parquet / CSV writes with arrays as text, date re-typing, basket matrix."""

import os
import tempfile


from lapsekit.operators import basket as bk
from lapsekit.sources import io
from lapsekit.sources.schemas import CUSTOMER


def test_csv_round_trip(spark):
    out = tempfile.mkdtemp(prefix="lapsekit-io-")
    df = spark.createDataFrame([(1, ["b", "a"], "2024-02-29")], "k long, items array<string>, d string")
    io.write_table(df, os.path.join(out, "t_csv"), fmt="csv")
    back = spark.read.option("header", True).csv(os.path.join(out, "t_csv"))
    assert back.first()["items"] == "a, b"
    io.write_table(df, os.path.join(out, "t_pq"), partition_by=["k"])
    pq = io.read_table(spark, os.path.join(out, "t_pq"))
    assert pq.where("k = 1").count() == 1
    typed = io.recast_dates(back, ["d"])
    assert str(typed.first()["d"]) == "2024-02-29"


def test_fixed_schema_csv(spark):
    out = tempfile.mkdtemp(prefix="lapsekit-csv-")
    path = os.path.join(out, "customer.csv")
    with open(path, "w") as f:
        f.write(",".join(x.name for x in CUSTOMER.fields) + "\n")
        f.write("7,A,B,u,e,F,1990-05-01,iOS,d1,v,1.5,2.5,home,ID,2021-01-01\n")
    df = io.read_table(spark, path, CUSTOMER, fmt="csv")
    r = df.first()
    assert r.customer_id == 7 and str(r.birthdate) == "1990-05-01" and r.home_location_lat == 1.5


def test_basket_matrix(spark):
    df = spark.createDataFrame([(1, " A"), (1, "b"), (2, "b")], "k long, item string")
    m = {r.k: (r.a, r.b) for r in bk.basket_matrix(df, "k", "item", ["a", "b"]).collect()}
    assert m == {1: (1, 1), 2: (0, 1)}


def test_export_rules(spark, tmp_path):
    """K6: rules are written with their item sets as text."""
    freq = spark.createDataFrame([(["a"], 3, 0.6, 1), (["b"], 3, 0.6, 1), (["a", "b"], 3, 0.6, 2)],
                                 "itemset array<string>, freq long, support double, length int")
    bk.export_rules(bk.association_rules(freq), str(tmp_path / "rules"), "csv")
    rows = spark.read.csv(str(tmp_path / "rules"), header=True).collect()
    assert {(r.antecedents, r.consequents) for r in rows} == {("a", "b"), ("b", "a")}


def test_rules_of_a_long_set(spark):
    """Splits of a set beyond 31 items' worth of mask bits start out right: each split once, none empty."""
    items = [f"i{k:02d}" for k in range(9)]
    got = bk._splits(spark.createDataFrame([(items,)], "s array<string>"), "s", "a").select("a").collect()
    assert len(got) == len({tuple(r.a) for r in got}) == 2 ** 9 - 2 and all(0 < len(r.a) < 9 for r in got)

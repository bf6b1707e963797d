"""Hand-made fixtures, one per semantic decision (see FIXTURES.md section 3)."""

import datetime as dt

from pyspark.sql import functions as F

from lapsekit.functions import scalar as sc
from lapsekit.operators import activity as act
from lapsekit.operators import lifecycle as lc
from lapsekit.operators import rfm as R
from lapsekit.operators.fact import once_per_group

D = dt.date


def test_item_booking_key(spark):
    """Q1: items stay with their own booking after a date filter drops the first booking."""
    b = spark.createDataFrame([("b1", D(2019, 5, 1), "[{'product_id': 1, 'quantity': 1, 'item_price': 1.0}]"),
                               ("b2", D(2020, 2, 1), "[{'product_id': 2, 'quantity': 2, 'item_price': 2.0}]"),
                               ("b3", D(2020, 3, 1), "[{'product_id': 3, 'quantity': 3, 'item_price': 3.0}]")],
                              "booking_id string, d date, meta string")
    from lapsekit.sources.schemas import ITEM
    kept = b.where(F.col("d") >= "2020-01-01")
    items = sc.explode_items(kept, "meta", ITEM, ["booking_id"])
    got = sorted((r.booking_id, r.product_id) for r in items.collect())
    assert got == [("b2", 2), ("b3", 3)]


def test_cycle_unsorted_and_single(spark):
    """Q2, Q3: cycle = floor((max - min) / (n - 1)) regardless of row order; one row -> 0."""
    tx = spark.createDataFrame([(1, D(2024, 1, 5)), (1, D(2024, 1, 1)), (1, D(2024, 1, 20)), (1, D(2024, 1, 2)),
                                (2, D(2024, 1, 3))], "customer_id long, transaction_date date")
    got = {r.customer_id: r.avg_pur_cycle for r in lc.purchase_cycle(tx).collect()}
    assert got == {1: 6, 2: 0}
    fence = lc.lapse_fence(tx).first()
    assert fence.q1 == 6.0 and fence.q3 == 6.0  # the single-row customer is not in the quartiles


def test_frequency_ties(spark):
    """Q4, Q5: equal frequencies are ranked by customer id; qcut labels 1,1,2,3,4,5,5."""
    r = spark.createDataFrame([(i, 10, 3, 1.0, 100) for i in range(7)],
                              "customer_id long, recency int, frequency long, monetary double, join_period int")
    got = [x.frequency_score for x in R.rfm_scores(r).orderBy("customer_id").collect()]
    assert got == [1, 1, 2, 3, 4, 5, 5]


def test_qcut_formula_matches_pandas():
    """Q5: the integer formula equals pandas.qcut(rank, 5) for many sizes."""
    import pandas as pd
    for n in list(range(5, 120)) + [399, 1000]:
        ranks = pd.Series(range(1, n + 1), dtype=float)
        ref = pd.qcut(ranks, 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
        ours = [max(1, -(-((r - 1) * 5) // (n - 1))) for r in range(1, n + 1)]
        assert ours == ref, n


def test_recency_flat(spark):
    """Q7: duplicate quantile edges do not raise; everyone gets one score."""
    r = spark.createDataFrame([(i, 30, i + 1, float(i), 100) for i in range(6)],
                              "customer_id long, recency int, frequency long, monetary double, join_period int")
    assert {x.recency_score for x in R.rfm_scores(r).collect()} == {5}


def test_tenure_edges(spark):
    """Q6: (0, 90] -> 5 ... > 360 -> 1, <= 0 -> null."""
    df = spark.createDataFrame([(v,) for v in [-1, 0, 1, 90, 91, 361]], "jp int")
    got = [r.s for r in df.select(R.tenure_score(F.col("jp")).alias("s")).collect()]
    assert got == [None, None, 5, 5, 4, 1]


def test_rf_grid(spark):
    """Every (R, F) pair maps to exactly one segment; tenure score 5 overrides."""
    rows = [(r, f, 3) for r in range(1, 6) for f in range(1, 6)] + [(1, 1, 5)]
    df = spark.createDataFrame(rows, "r int, f int, p int")
    got = df.select("r", "f", "p", R.segment_of(F.col("r"), F.col("f"), F.col("p")).alias("s")).collect()
    seg = {(x.r, x.f): x.s for x in got if x.p == 3}
    assert len(seg) == 25 and None not in seg.values()
    assert seg[(1, 1)] == "hibernating" and seg[(3, 3)] == "need_attention" and seg[(5, 5)] == "champions"
    assert seg[(4, 1)] == "promising" and seg[(4, 5)] == "loyal_customers" and seg[(2, 5)] == "cant_loose"
    assert [x.s for x in got if x.p == 5] == ["new_customers"]


def _events(spark, rows):
    return spark.createDataFrame(rows, "session_id string, event_name string")


def test_fanout_modes(spark):
    """Q8: item mode multiplies a session's counts by its items; session mode does not."""
    ev = _events(spark, [("s1", "CLICK"), ("s1", "CLICK"), ("s1", "SCROLL"), ("s1", "BOOKING")])
    tx = spark.createDataFrame([("s1", 7, 10.0)] * 3, "session_id string, customer_id long, amount double")
    counts = act.event_counts(ev, ["session_id"], ["CLICK", "SCROLL", "BOOKING"])
    items = act.session_items(tx)
    item = act.weighted_activity(counts, items, ["CLICK", "SCROLL", "BOOKING"], "item").first()
    sess = act.weighted_activity(counts, items, ["CLICK", "SCROLL", "BOOKING"], "session").first()
    assert (item.n_events, item.BOOKING) == (12, 3) and (sess.n_events, sess.BOOKING) == (4, 1)
    j = counts.join(items, "session_id")
    r_item = act.conversion_rate(j, "BOOKING", weight_col="n_items").first().conversion_rate
    r_sess = act.conversion_rate(j, "BOOKING").first().conversion_rate
    assert r_item == r_sess == 25.0


def test_fanout_mixed(spark):
    ev = _events(spark, [("s1", "BOOKING"), ("s1", "CLICK"), ("s2", "CLICK"), ("s2", "CLICK"), ("s2", "CLICK"),
                         ("s2", "BOOKING")])
    tx = spark.createDataFrame([("s1", 7, 1.0)] + [("s2", 7, 1.0)] * 3, "session_id string, customer_id long, amount double")
    j = act.event_counts(ev, ["session_id"], ["CLICK", "BOOKING"]).join(act.session_items(tx), "session_id")
    r_item = act.conversion_rate(j, "BOOKING", weight_col="n_items").first().conversion_rate
    r_sess = act.conversion_rate(j, "BOOKING").first().conversion_rate
    assert r_sess == round(2 / 6 * 100, 2) and r_item == round(4 / 14 * 100, 2)


def test_age_birthday(spark):
    """Q9: whole years; the day before the birthday counts one year less."""
    a = D(2024, 6, 15)
    df = spark.createDataFrame([(D(2000, 6, 14),), (D(2000, 6, 15),), (D(2000, 6, 16),)], "b date")
    got = [r.y for r in df.select(sc.age_years("b", F.lit(a)).alias("y")).collect()]
    assert got == [24, 24, 23]


def test_month_ends(spark):
    """Relativedelta month counting at month ends."""
    df = spark.createDataFrame([(D(2023, 1, 30), D(2023, 2, 28)), (D(2023, 1, 31), D(2023, 2, 27)),
                                (D(2023, 1, 31), D(2023, 4, 30))], "s date, e date")
    assert [r.m for r in df.select(sc.full_months("s", "e").alias("m")).collect()] == [1, 0, 3]


def test_traffic_web(spark):
    """Q10: a web-only session has a web count and no mobile flag."""
    ev = spark.createDataFrame([("s1", "WEB"), ("s1", "WEB")], "session_id string, traffic_source string")
    r = act.traffic_pivot(ev).first()
    assert r.web_events == 2 and r.has_mobile == 0


def test_last_dates(spark):
    """Q11: the latest three distinct dates and all their rows."""
    rows = [(1, D(2024, 1, d)) for d in [3, 1, 5, 2, 4]] + [(1, D(2024, 1, 4))]
    tx = spark.createDataFrame(rows, "customer_id long, transaction_date date")
    got = sorted(r.transaction_date.day for r in lc.last_n_dates(tx, 3).collect())
    assert got == [3, 4, 4, 5]


def test_fee_once(spark):
    """Q12: a repeated booking-level value is kept on its first row only."""
    df = spark.createDataFrame([("s", i, f) for i, f in enumerate([1.0, 1.0, 0.0, 2.0, 2.0])],
                               "session_id string, pos int, fee double")
    got = [r.fee for r in once_per_group(df, "session_id", "fee", ["pos"]).orderBy("pos").collect()]
    assert got == [1.0, 0.0, 0.0, 2.0, 0.0]


def test_metadata_text(spark):
    """JSON and Python-literal text parse; None becomes a null field; garbage and null give null."""
    from lapsekit.sources.schemas import ITEM
    df = spark.createDataFrame([
        (1, '[{"product_id": 1, "quantity": 2, "item_price": 3.5}]'),
        (2, "[{'product_id': 2, 'quantity': 1, 'item_price': 1.0}]"),
        (3, "[{'product_id': 3, 'quantity': None, 'item_price': 2.0}]"),
        (4, "not a list"), (5, None)], "k int, meta string")
    got = {r.k: (r.product_id, r.quantity) for r in sc.explode_items(df, "meta", ITEM, ["k"]).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (3, None), 4: (None, None), 5: (None, None)}


def test_zero_denominators(spark):
    """Zero denominators give 0 (or the numerator), never an error under ANSI."""
    df = spark.createDataFrame([(5.0, 0.0), (0.0, 0.0), (6.0, 3.0)], "x double, d double")
    got = [(r.a, r.b) for r in df.select(sc.safe_ratio("x", "d").alias("a"), sc.ratio_or_zero("x", "d").alias("b")).collect()]
    assert got == [(5.0, 0.0), (0.0, 0.0), (2.0, 2.0)]


def test_constant_column_dropped(spark):
    """Q23: a constant column is left out of the correlation screen (no error)."""
    from lapsekit.operators import stats as st
    df = spark.createDataFrame([(float(i), 2.0 * i + 1, 7.0) for i in range(10)], "a double, b double, c double")
    pairs = st.high_corr_pairs(df, ["a", "b", "c"], 0.86).collect()
    assert [(p.col_a, p.col_b) for p in pairs] == [("a", "b")]
    reduced, dropped = st.drop_correlated(df, ["a", "b", "c"], 0.86)
    assert dropped == ["b"]


def test_iso_split(spark):
    """B1: with and without fraction, bad text -> null."""
    df = spark.createDataFrame([("2021-03-04T05:06:07.123456Z",), ("2021-03-04T05:06:07Z",), ("bad",)], "t string")
    got = sc.split_iso_ts(df, "t", "x").collect()
    assert got[0].x_time == "05:06:07" and got[1].x_date == D(2021, 3, 4) and got[2].x_datetime is None


def test_one_hot_and_codes(spark):
    """B3, B4, B10."""
    df = spark.createDataFrame([("M",), ("F",), ("X",)], "g string")
    assert [r.c for r in df.select(sc.encode_map("g", {"F": 0, "M": 1}).alias("c")).collect()] == [1, 0, None]
    coded = {r.g: r.code for r in sc.encode_sorted(df, "g", "code").collect()}
    assert coded == {"F": 0, "M": 1, "X": 2}
    oh = sc.one_hot(df, "g", "G", ["F", "M", "X"]).orderBy("g").collect()
    assert [(r.G_F, r.G_M, r.G_X) for r in oh] == [(1, 0, 0), (0, 1, 0), (0, 0, 1)]


def test_small_steps(spark):
    """B2, B5, B7, B8, B25, B30, B31, C9."""
    from lapsekit.functions import calendar as cal
    df = spark.createDataFrame([(1, None, "Footwear", D(2019, 12, 31), "10:20:30", 3),
                                (2, "x", "Apparel", D(2020, 1, 4), "23:00:00", 0)],
                               "k int, a string, cat string, d date, t string, n int")
    r = df.select(sc.fill_from("a", "cat").alias("f"),
                  sc.fill_when("a", F.col("cat") == "Footwear", "All Seasons").alias("w"),
                  cal.weekday_weekend("d").alias("ww"), sc.combine_ts("d", "t").alias("ts"),
                  sc.presence("n").alias("p")).collect()
    assert [x.f for x in r] == ["Footwear", "x"] and [x.w for x in r] == ["All Seasons", "x"]
    assert [x.ww for x in r] == ["Weekday", "Weekend"] and r[0].ts.hour == 10 and [x.p for x in r] == [1, 0]
    assert [x.k for x in sc.since(df, "d", "2020-01-01").collect()] == [2]
    filled = sc.fill_nulls(df.withColumn("year", F.lit(None).cast("int")), {"year": "unknown", "a": "None"})
    assert {x.year for x in filled.collect()} == {"unknown"} and filled.first().a == "None"
    rows = spark.createDataFrame([("s1", 1), ("s1", 2), ("s2", 3)], "session_id string, item int")
    counts = spark.createDataFrame([("s1", 4)], "session_id string, CLICK long")
    traffic = spark.createDataFrame([("s1", 0, 4, 0)], "session_id string, mobile_events long, web_events long, has_mobile int")
    assert sorted(x.item for x in act.recent_features(rows, counts, traffic).collect()) == [1, 2]

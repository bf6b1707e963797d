"""One key holding a third of all rows: results stay exact."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lapsekit.operators.fact import once_per_group
from lapsekit.streaming import sessions as ss


def test_once_per_group_hot_session(spark):
    rows = [("hot" if i % 3 == 0 else f"s{i % 40}", i, float(i % 4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "session_id string, pos int, fee double")
    got = once_per_group(df, "session_id", "fee", ["pos"])
    kept = got.where("fee <> 0").groupBy("session_id", "fee").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("p"))
    ref = df.where("fee <> 0").groupBy("session_id", "fee").agg(F.min("pos").alias("p"))
    assert kept.where("n <> 1").count() == 0
    assert sorted(kept.select("session_id", "fee", "p").collect()) == sorted(ref.collect())


def test_sessionize_hot_user(spark):
    random.seed(7)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        user = 1 if i % 3 == 0 else 2 + i % 30
        rows.append((i, user, base + dt.timedelta(minutes=random.randint(0, 60 * 24 * 20))))
    ev = spark.createDataFrame(rows, "event_id long, customer_id long, event_ts timestamp_ntz")
    ours = ss.sessionize(ev, "2 hours", bucket="30 minutes").groupBy("customer_id", "session_start").count()
    ref = (ev.groupBy("customer_id", F.session_window(F.col("event_ts").cast("timestamp"), "2 hours").alias("w"))
           .agg(F.min("event_ts").alias("session_start"), F.count(F.lit(1)).alias("count"))).drop("w")
    assert sorted(ours.collect()) == sorted(ref.select("customer_id", "session_start", "count").collect())

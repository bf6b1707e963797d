"""S2 with state and timers, J17 live: streams give the batch results, once."""

import os

import numpy as np
from pyspark.sql import functions as F

from lapsekit.operators import customer as cu
from lapsekit.plans.catalog import customer_value
from lapsekit.sources import testdata as td
from lapsekit.streaming import live
from lapsekit.streaming import sessions as ss
from lapsekit.streaming.events import EVENTS_SCHEMA
from lapsekit.streaming.stateful import late_rows, merge_intervals, start_sessions
from paths import SF_SMALL

COLS = ["session_id", "customer_id", "session_start", "session_end", "n_events", *td.EVENT_KINDS, "converted"]


def _rows(df):
    return sorted(tuple(r) for r in df.select(COLS).collect())


def test_merge_intervals_in_any_order():
    rng = np.random.default_rng(7)
    for _ in range(200):
        t = rng.integers(0, 60, rng.integers(1, 30))
        want, cut = [], 5
        for x in sorted(t.tolist()):
            if want and x - want[-1][1] <= cut:
                want[-1] = [want[-1][0], x, want[-1][2] + 1]
            else:
                want.append([x, x, 1])
        s = e = np.zeros(0, np.int64)
        c = np.zeros((0, 1), np.int64)
        for part in np.array_split(t, 3):                           # piece by piece, as chunks and batches arrive
            s, e, c = merge_intervals(np.concatenate((s, part)), np.concatenate((e, part)), np.concatenate((c, np.ones((len(part), 1), np.int64))), cut)
        assert [[a, b, int(n[0])] for a, b, n in zip(s.tolist(), e.tolist(), c)] == want


def test_stateful_sessions_equal_batch(spark, tmp_path):
    """Stream = batch with session ids, through out-of-order files, a restart, and a late row that is counted and changes nothing."""
    src, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    raw = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    times = raw.select(F.min("ts"), F.max("ts")).first()
    day = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(times[0]).cast("timestamp"))) / F.lit(86_400_000_000))
    odd = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 1
    put = lambda df, name: df.coalesce(1).write.parquet(os.path.join(src, name))
    run = lambda: start_sessions(spark, os.path.join(src, "*"), sink, checkpoint, "8 hours", "40 days", td.EVENT_KINDS, td.BOOKING_KIND, 1)

    put(raw.where((day < 20) & odd), "a")
    q = run()
    q.processAllAvailable()
    q.stop()
    put(raw.where((day >= 20) & odd), "b")                          # after a restart
    put(raw.where(~odd), "c")                                       # between the events of a and b: their sessions join
    q = run()
    q.processAllAvailable()
    assert late_rows(q) == 0
    beyond = spark.createDataFrame([(-1, None, -1, "view", 0.0, None)], EVENTS_SCHEMA)
    put(beyond.withColumn("ts", F.lit(times[1]) + F.expr("INTERVAL 60 DAYS")), "d")     # moves the watermark past all of them
    q.processAllAvailable()
    put(raw.limit(1).withColumn("ts", F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")), "e")
    q.processAllAvailable()
    dropped = late_rows(q)
    q.stop()
    batch = ss.session_summary(ss.sessionize(td.events_all(spark, SF_SMALL), "8 hours"), td.EVENT_KINDS, td.BOOKING_KIND)
    got = _rows(spark.read.parquet(sink))
    assert got == _rows(batch) and dropped == 1


def test_live_metrics_count_a_batch_once(spark, tmp_path):
    path = str(tmp_path / "live")
    tx = td.fact(spark, SF_SMALL)
    parts = [tx.where(F.pmod("booking_id", F.lit(5)) == i) for i in range(5)]       # whole bookings
    as_of = td.as_of(spark, SF_SMALL)
    rows = lambda df: sorted(tuple(r) for r in df.select("customer_id", "aov", "historical_value", "orders", "last_purchase", "is_churned").collect())
    for i, part in enumerate(parts):
        live.merge_batch(part, i, path, compact=2)
        if i == 3:
            live.merge_batch(part, i, path, compact=2)              # repeated: a base holds it already
            live.merge_batch(parts[0], 0, path, compact=2)          # an old one as well
    assert len(live._committed(spark, path, "base")) == 1           # the replaced base and its batches went
    want = rows(customer_value(spark, SF_SMALL))
    assert rows(live.live_metrics(spark, path, as_of)) == want
    live.merge_batch(parts[4], 4, path, compact=2)                  # the last batch, still a part of its own or held: the same
    assert rows(live.live_metrics(spark, path, as_of)) == want


def test_a_repeated_part_overwrites_itself(spark, tmp_path):
    path = str(tmp_path / "live")
    tx = td.fact(spark, SF_SMALL)
    for _ in range(2):
        live.merge_batch(tx, 0, path)
    state = live.live_state(spark, path)
    assert state.agg(F.sum("n_rows")).first()[0] == tx.count()
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, cu.purchase_state(tx).collect()))

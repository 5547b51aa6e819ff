"""Velocity counts from a stream: equal to brute force and to the batch bridge, late rows aside, across restarts."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from txrisk.plans import fixtures as fx
from txrisk.streaming.velocity import DAY_US, WEEK_US, earlier_counts, split_late, velocity_counts

from sf_paths import SF_SMALL

SCHEMA = "event_id long, user_id long, timestamp timestamp"


def run(spark, src, out, ckpt, files=1, **how):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(src)
    q = (velocity_counts(stream, **how).writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()



def test_counts_of_instants():
    at, n = np.array([10, 20, 30]), np.array([1, 2, 3])
    assert earlier_counts(at, n, np.array([5, 10, 20, 30, 31, 40, 60]), 20).tolist() == [0, 0, 1, 2, 5, 3, 0]


def test_stream_equals_the_batch_windows_and_survives_a_restart(spark, tmp_dir):
    """Events in disorder within an hour, in three runs of the query on one checkpoint."""
    rnd = random.Random(4)
    events = fx.table(spark, SF_SMALL, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("timestamp"))
    rows = [(r.event_id, r.user_id, r.timestamp) for r in events.collect()]
    rows.sort(key=lambda r: r[2].timestamp() + rnd.uniform(0, 3000))
    src, out, ckpt = (os.path.join(tmp_dir, d) for d in ("in", "out", "ckpt"))
    parts = [rows[i * len(rows) // 3:(i + 1) * len(rows) // 3] for i in range(3)]
    end = max(r[2] for r in rows)
    for i, part in enumerate(parts):
        os.makedirs(src, exist_ok=True)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        if i == 2:      # one more event, far ahead, moves the horizon past all others
            far = spark.createDataFrame([(-1, -1, end)], SCHEMA).withColumn("timestamp", F.col("timestamp") + F.expr("interval 60 days"))
            far.coalesce(1).write.mode("append").parquet(src)
        run(spark, src, out, ckpt)
    settled, late = split_late(spark.read.schema("user string, id string, us long, count_24h long, count_7d long, is_late boolean").parquet(out))
    got = {int(r.id): (r.count_24h, r.count_7d) for r in settled.collect()}
    assert late.count() == 0 and set(got) == {r[0] for r in rows}
    by_user = {}
    for i, u, t in rows:
        by_user.setdefault(u, []).append((int(t.timestamp() * 1e6 + 0.5), i))
    for u, mine in by_user.items():
        at = np.array([t for t, _ in mine])
        for t, i in mine:
            assert got[i] == (int(((at < t) & (at > t - DAY_US)).sum()), int(((at < t) & (at > t - WEEK_US)).sum()))
    batch = {r.event_id: (r.transaction_count_24h, r.transaction_count_7d) for r in fx.transfers(spark, SF_SMALL).collect()}
    assert all(got[i] == c for i, c in batch.items())


def test_late_rows_are_set_aside(spark, tmp_dir):
    src, out, ckpt = (os.path.join(tmp_dir, d) for d in ("in", "out", "ckpt"))
    at = lambda hours: f"timestamp'2024-05-01 00:00:00' + interval {int(hours * 60)} minutes"
    batches = [[(1, 7, 0), (2, 7, 10), (3, 8, 10)], [(4, 7, 5), (5, 7, 9.5), (6, 9, 400)], [(7, 7, 100), (8, 9, 401)], [(9, 9, 900)]]
    for batch in batches:
        df = spark.createDataFrame([(i, u) for i, u, _ in batch], "event_id long, user_id long")
        when = F.expr("CASE " + " ".join(f"WHEN event_id = {i} THEN {at(h)}" for i, _, h in batch) + " END")
        df.withColumn("timestamp", when).coalesce(1).write.mode("append").parquet(src)
        run(spark, src, out, ckpt)
    settled, late = split_late(spark.read.schema("user string, id string, us long, count_24h long, count_7d long, is_late boolean").parquet(out))
    # after the first run the horizon is hour 9: row 4 is late, row 5 is not; row 7 comes when it is 399
    assert sorted(int(r.id) for r in late.collect()) == [4, 7]
    got = {int(r.id): (r.count_24h, r.count_7d) for r in settled.collect()}
    assert got == {1: (0, 0), 5: (1, 1), 2: (2, 2), 3: (0, 0), 6: (0, 0), 8: (1, 1)}

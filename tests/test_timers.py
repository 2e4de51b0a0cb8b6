"""Timeouts as a stream with restarts, against the rule over the finished table."""

import random

import pytest
from pyspark.sql import functions as F

from textquarry.streaming import ingest, timers

SCHEMA = "id string, status string, ts timestamp"


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, timers.STORE)
    yield
    spark.conf.set(name, before)


def rows(spark, some):
    df = spark.createDataFrame(some, "id string, status string, s long")
    return df.select("id", "status", (F.lit("2024-03-01").cast("timestamp") + F.make_interval(secs=F.col("s"))).alias("ts"))


def test_limits_over_a_finished_table(spark):
    events = rows(spark, [("a", "embedding", 0), ("a", "completed", 299), ("b", "embedding", 0), ("b", "embedding", 301), ("c", "failed", 0), ("d", "waiting", 0), ("e", "active", 10), ("a", None, 5)])
    got = {(r["id"], r["action"], r["status"]) for r in timers.timed_out_by(events, "2024-03-01 02:00:00").collect()}
    assert got == {("b", "waiting", "embedding"), ("e", "removed", "active")}
    late = timers.timed_out_by(events, "2024-03-09").collect()
    assert sorted((r["id"], r["action"]) for r in late) == [("a", "removed"), ("b", "waiting"), ("b", "waiting"), ("c", "removed"), ("e", "removed")]


def test_stream_with_restarts_is_the_table_rule(spark, store, tmp_path):
    rng = random.Random(3)
    events, at = [], 0
    for _ in range(120):
        at += rng.choice([1, 30, 200, 400, 2000])
        events.append((rng.choice("abcdef"), rng.choice(["embedding", "completed", "failed", "active", "waiting"]), at))
    end = ("clock", "waiting", at + 30 * 24 * 3600)
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    parts = [events[:40], events[40:41], events[41:100], events[100:], [end], [("clock", "waiting", end[2] + 1)]]
    for part in parts:  # each run ends, and the next goes on from the checkpoint
        rows(spark, part).coalesce(1).write.mode("append").parquet(source)
        out = timers.timed_out(ingest.stream(spark, source, SCHEMA))

        def put(batch, number):
            batch.coalesce(1).write.mode("overwrite").parquet(f"{target}/batch={number}")

        out.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(180)
    got = sorted((r["id"], r["action"], r["status"], r["since"], r["due"]) for r in spark.read.parquet(target).collect())
    want = sorted(tuple(r) for r in timers.timed_out_by(rows(spark, [*events, end]), "2024-06-01").where("id <> 'clock'").collect())
    assert got == want and len(want) > 20

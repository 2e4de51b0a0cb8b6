from pyspark.sql import functions as F

from textquarry.streaming import ingest


def test_a_hash_is_taken_once(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows in ([("a", 1), ("b", 2), ("a", 3)], [("b", 4), ("c", 5), (None, 6)]):
        spark.createDataFrame(rows, "hash string, v int").coalesce(1).write.mode("append").parquet(source)
        q = ingest.ingest_once(ingest.stream(spark, source, "hash string, v int"), target, state)
        q.awaitTermination(120)
    got = [r["hash"] for r in spark.read.parquet(target).collect()]
    assert sorted(got) == ["a", "b", "c"]


def test_windows_and_sessions(spark):
    df = spark.range(6).select(F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, id * 4)").alias("ts"), F.lit("x").alias("k"), F.col("id").alias("v"))
    got = ingest.windowed(df, "ts", ["k"], size="10 minutes", total=F.sum("v")).orderBy("window_start").collect()
    assert [(r["n"], r["total"]) for r in got] == [(3, 3), (2, 7), (1, 5)]
    assert ingest.sessions(df, "ts", ["k"], gap="3 minutes").count() == 6 and ingest.sessions(df, "ts", ["k"], gap="5 minutes").count() == 1

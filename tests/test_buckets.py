"""The bucketed table: what a change writes, what a reader sees, and batches that run twice."""

import os

import pytest
from pyspark.sql import functions as F

from textquarry.operators import mutations
from textquarry.sources import buckets
from textquarry.streaming import ingest

ROWS = "k long, name string, v double"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"), F.col("id").cast("double").alias("v"))
    return buckets.BucketTable.create(rows.union(rows.limit(3)).union(spark.createDataFrame([(None, "x", 1.0)], ROWS)), f"{tmp_path}/t", "k", 16)


def test_one_key_writes_one_bucket(spark, table):
    before, whole = files(f"{table.path}/rows"), table.read()
    assert whole.count() == 500
    touched = table.upsert(spark.createDataFrame([(7, 1, 70.0)], "k int, o int, v double"), "o")
    new = files(f"{table.path}/rows") - before
    assert len(touched) == 1 and new and all(f"bucket={touched[0]}/" in f for f in new)
    assert table.at(7).first()["v"] == 70.0 and table.at(7).first()["name"] == "n7"
    # a reader from before still has what it read
    assert whole.where("k = 7").first()["v"] == 7.0 and whole.count() == 500
    plan = table.at(7)._jdf.queryExecution().toString()
    assert plan.count("bucket=") <= 4


def test_changes_are_those_of_the_whole_table(spark, table):
    changes = spark.createDataFrame([(3, 1, "a", 1.5), (3, 2, None, 2.5), (900, 1, "new", None), (None, 1, "no", 0.0), (901, 5, "z", 1.0), (901, 4, "y", 2.0)], "k long, o int, name string, v double")
    start = table.read()
    want = rows_of(mutations.upsert(start, changes, "k", "o", {"v": 9.0}))
    table.upsert(changes, "o", {"v": 9.0})
    assert rows_of(table.read()) == want
    # the same buckets again, and once more
    table.upsert(changes, "o", {"v": 9.0})
    assert rows_of(table.read()) == want
    table.delete(spark.createDataFrame([(3,), (900,), (12345,), (None,)], "k int"))
    assert rows_of(table.read()) == [r for r in want if r[0] not in (3, 900)]
    assert table.replace(F.col("k") == 901, {"name": F.lit("off")}) and table.at(901).first()["name"] == "off"
    assert table.replace(F.col("k") < 0, {"name": F.lit("off")}) == []
    n = table.read().count()
    assert len(table.vacuum()) >= 1 and table.read().count() == n == 499 + 1


def test_empty_tables_and_buckets(spark, tmp_path):
    none = spark.createDataFrame([], ROWS)
    t = buckets.BucketTable.create(none, f"{tmp_path}/e", "k", 4)
    assert t.read().count() == 0 and t.upsert(none.withColumn("o", F.lit(1)), "o") == [] and t.delete(none) == []
    t.upsert(spark.createDataFrame([(1, "a", 1.0, 1)], ROWS + ", o int"), "o")
    t.delete(spark.createDataFrame([(1,)], "k long"))
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([(1, "b", 1.0, 1)], ROWS + ", o int"), "o")
    assert rows_of(t.read()) == [(1, "b", 1.0)]


def test_a_batch_counts_once_and_a_lost_race_writes_nothing(spark, table, monkeypatch):
    one = spark.createDataFrame([(7, 1, 70.0)], "k long, o int, v double")
    assert table.upsert(one, "o", batch="b1") and table.upsert(one, "o", batch="b1") == []
    held = table.held()
    table.upsert(one.withColumn("v", F.lit(71.0)), "o")
    monkeypatch.setattr(buckets.BucketTable, "held", lambda self, first=[held], real=buckets.BucketTable.held: first.pop() if first else real(self))
    with pytest.raises(buckets.Changed):
        table.upsert(one.withColumn("v", F.lit(99.0)), "o")
    assert table.at(7).first()["v"] == 71.0


def test_stream_of_changes_with_a_restart(spark, table, tmp_path):
    source, state = f"{tmp_path}/in", f"{tmp_path}/state"
    schema = "k long, o long, v double"
    for k, batch in enumerate([[(1, 1, 10.0), (2, 1, 20.0)], [(1, 2, 11.0), (1000, 1, 5.0)]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        buckets.upsert_stream(ingest.stream(spark, source, schema), table, "o", state).awaitTermination(120)
        assert table.at(1).first()["v"] == (10.0, 11.0)[k]
    assert table.read().count() == 501
    # the batch as it would run again after a failure: its name is in the log
    names = {r["batch"] for r in table.log().where("batch IS NOT NULL").collect()}
    assert len(names) == 2
    assert table.upsert(spark.createDataFrame([(1, 3, 99.0)], schema), "o", batch=max(names)) == []

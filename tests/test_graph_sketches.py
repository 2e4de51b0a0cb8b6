"""Distances by sketches against all pairs, and the deletion of a graph in one call."""

import random

import pytest
from pyspark.sql import functions as F

from textquarry.operators import graph


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(2)
    some = {(k, k + 1) for k in range(0, 40)} | {tuple(rng.sample(range(120), 2)) for _ in range(150)} | {(500, k) for k in range(600, 900)} | {(7, 7), (8, 7), (7, 8)}
    return spark.createDataFrame(sorted(some), "src long, dst long")


def test_small_graphs_are_as_good_as_exact(edges):
    want = {r["node"]: r["closeness"] for r in graph.closeness(edges).collect()}
    got = {r["node"]: r["closeness"] for r in graph.sketched_closeness(edges).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=0.01) for k in want)
    a, b = graph.mean_path_length(edges).first(), graph.sketched_path_length(edges).first()
    assert b["mean_path_length"] == pytest.approx(a["mean_path_length"], rel=0.01) and b["pairs"] == pytest.approx(a["pairs"], rel=0.01)


def test_sketches_smaller_than_the_graph(spark, edges):
    """64 counters for 300 nodes: within the error, with one row a node and round."""
    near = graph.neighbourhoods(edges, lg=8)
    assert near.count() <= 40 * 421
    want = graph.mean_path_length(edges).first()["mean_path_length"]
    assert graph.sketched_path_length(edges, lg=8).first()["mean_path_length"] == pytest.approx(want, rel=0.1)
    assert graph.sketched_closeness(edges.limit(0)).count() == 0


def test_customer_graph_within_five_percent(spark):
    d = "/root/testdata/sf0.001"
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"))
    want = {r["node"]: r["closeness"] for r in graph.closeness(c).collect()}
    got = {r["node"]: r["closeness"] for r in graph.sketched_closeness(c).collect()}
    assert all(abs(got[k] - v) <= 0.05 * v for k, v in want.items()) and got.keys() == want.keys()


def test_graph_of_a_segment_or_dataset_goes(spark):
    nodes = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (3, 1, "b"), (4, 2, None)], "node int, dataset_id int, segment_id string")
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 4, 2), (4, 1, None)], "src int, dst int, dataset_id int")
    n, e, r = graph.without(nodes, edges, segment="a")
    assert {x["node"] for x in n.collect()} == {3, 4} and [(x["src"], x["dst"]) for x in e.collect()] == [(3, 4)] and tuple(r.first()) == (2, 3)
    n, e, r = graph.without(nodes, edges, dataset=1)
    assert {x["node"] for x in n.collect()} == {4} and {(x["src"], x["dst"]) for x in e.collect()} == {(3, 4), (4, 1)} and tuple(r.first()) == (3, 2)
    assert tuple(graph.without(nodes, edges, segment="z")[2].first()) == (0, 0)
    with pytest.raises(ValueError):
        graph.without(nodes, edges)


def test_leaves_hold_no_sketch(spark, monkeypatch):
    """A star of 3000, a pair and a short chain: sketches are kept for the nodes inside alone, with the distances of all pairs."""
    sketches, cut = [], graph._cut

    def counted(df):
        out = cut(df)
        if "sketch" in out.columns:
            sketches.append(out.count())
        return out

    monkeypatch.setattr(graph, "_cut", counted)
    e = spark.range(1, 3001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")).union(spark.createDataFrame([(9001, 9000), (9101, 9100), (9101, 9102), (9102, 9103)], "src long, dst long"))
    got = {(r["node"], r["distance"]): r["n"] for r in graph.neighbourhoods(e).collect()}
    assert sketches and max(sketches) <= 4
    assert {k: v for k, v in got.items() if k[0] >= 9000} == {(9000, 1): 1, (9001, 1): 1, (9100, 1): 1, (9100, 2): 1, (9100, 3): 1, (9101, 1): 2, (9101, 2): 1, (9102, 1): 2, (9102, 2): 1, (9103, 1): 1, (9103, 2): 1, (9103, 3): 1}
    assert got[0, 1] == pytest.approx(3000, rel=0.05) and all(got[k, 1] == 1 and got[k, 2] == pytest.approx(2999, rel=0.05) for k in range(1, 3001))

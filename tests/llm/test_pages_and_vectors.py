"""URL reputation and nearest neighbours."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import forest, reputation


def test_rules_and_reputation(spark):
    urls = ["http://A.Example.NET/en/x?y#z", "http://example.net/de/", "https://x.example.com/de/1", "http://foo.org/fr/", "http://foo.org", "http://net/", None, "no scheme", "http://notexample.com/de/", "http://bad.example.io/1", "a://b://c/d", "http://h.net", ""]
    pages = spark.createDataFrame([*enumerate(urls), (3, urls[3]), (None, urls[9])], "page_id long, url string").withColumn("host", F.lit("clash"))
    more = spark.range(100, 160).select(F.col("id").alias("page_id"), F.lit("http://bad.example.io/2").alias("url"), F.lit("clash").alias("host"))
    outcomes = spark.range(100, 160).select(F.col("id").alias("page_id"), F.lit(1).alias("bad")).union(spark.createDataFrame([(None, 1), (0, None)], "page_id long, bad int"))
    got = reputation.judge_urls(pages.union(more), outcomes).collect()
    assert len(got) == pages.count() + 60
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert by[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert by[1] == ("example.net", "/de/", "net/", "block")
    assert by[2] == ("x.example.com", "/de/1", "example.com/de/", "block")
    assert by[3] == ("foo.org", "/fr/", "org/fr/", "allow") and by[4][:3] == ("foo.org", "", None)
    assert by[5][2] == "net/" and by[11][:3] == ("h.net", "", None)
    assert by[6][:2] == by[7][:2] == by[12][:2] == ("", "")
    assert by[8][:3] == ("notexample.com", "/de/", None)
    assert by[9] == ("bad.example.io", "/1", None, "block")
    assert by[10][:2] == ("b:", "//c/d")
    assert reputation.judge_urls(pages.limit(0), outcomes).count() == 0
    assert {r["verdict"] for r in reputation.judge_urls(pages, outcomes.limit(0)).where("rule IS NULL").collect()} == {"allow"}


def test_shrinkage(spark):
    """A host without outcomes takes its domain's rate; many outcomes outweigh it."""
    hosts = spark.createDataFrame([("a.bad.io", 50, 45), ("b.bad.io", 0, 0), ("c.bad.io", 2, 0), ("x.good.io", 80, 2), ("y.good.io", 0, 0)], "host string, n long, bad long")
    r = {x["host"]: x for x in reputation.host_reputation(hosts).collect()}
    assert r["a.bad.io"]["bad_rate"] > r["b.bad.io"]["bad_rate"] > r["c.bad.io"]["bad_rate"] > r["x.good.io"]["bad_rate"]
    assert r["b.bad.io"]["bad_rate"] > r["y.good.io"]["bad_rate"]
    assert all(0 <= x["bad_rate_low"] <= x["bad_rate"] <= 1 for x in r.values())


def test_domains(spark):
    df = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "b.com", "x.y.b.com:80", "u@a.b.com", "10.0.0.1", "localhost", "")], "h string")
    got = [tuple(r) for r in df.select(*reputation.domain_and_suffix(F.col("h"))).collect()]
    assert got == [("b.co.uk", "co.uk"), ("b.com", "com"), ("b.com", "com"), ("b.com", "com"), ("10.0.0.1", "10.0.0.1"), ("localhost", "localhost"), ("", "")]


def brute(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    return {q: sorted(((-float(good[q] @ good[i]), i) for i in good if i != q))[:k] for q in good if q % every == 0}


def test_forest_on_few_vectors_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8) * (1 + i % 3)]) for i in range(120)]
    rows += [(i, rows[5][1]) for i in range(200, 260)]
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None] + [1.0] * 7), (304, [1.0] * 3), (None, [1.0] * 8), (305, [float("inf")] * 8), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("mark", F.lit(2))
    got = forest.nearest(df, k=7, every=20, budget=1e9).orderBy("query_id", "rank").collect()
    want = brute(rows, 7, 20)
    assert {r["query_id"] for r in got} == set(want)
    for q, near in want.items():
        mine = [r for r in got if r["query_id"] == q]
        assert [r["rank"] for r in mine] == list(range(1, 8))
        assert np.allclose([r["score"] for r in mine], [-s for s, _ in near])
        assert [r["vec_id"] for r in mine] == [i for _, i in near]


def test_forest_recall_and_edges(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(10, 32))
    x = centre[rng.integers(0, 10, 3000)] + rng.normal(size=(3000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = forest.nearest(df, k=10, every=100, sample=1500, leaf=64)
    hits = n = 0
    for r in got.groupBy("query_id").agg(F.collect_list("vec_id").alias("ids")).collect():
        s = x @ x[r["query_id"]]
        s[r["query_id"]] = -np.inf
        hits += len(set(np.argsort(-s)[:10]) & set(r["ids"]))
        n += 10
    assert n == 300 and hits / n >= 0.9
    assert forest.nearest(df.limit(0)).count() == 0
    assert [r["vec_id"] for r in forest.nearest(df.where("vec_id IN (0, 7, 9)")).where("query_id = 0").orderBy("rank").collect()].__len__() == 2


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_tables_at_production_parameters(spark, sf):
    path = f"/root/testdata/{sf}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    rows = spark.read.parquet(path).collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in forest.nearest(spark.read.parquet(path)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        recall.append(len(got[int(ids[i])] & set(ids[np.argsort(-s, kind="stable")[:20]].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_vectors_with_structure_need_few_leaves():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, 32))
    x = np.concatenate([c + 0.05 * rng.normal(size=(60, 32)) for c in centres])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    x = x[rng.permutation(len(x))]
    lifted = np.hstack([x, np.zeros((len(x), 1))])
    grown = [forest.grow(lifted, 64, rng) for _ in range(8)]
    assert forest.measured_budget(grown, lifted, lifted[:100], 20) < 0.6


def clustered(n, seed=5, size=25, d=16):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(size=(n // size, d)), size, axis=0) + 0.05 * rng.normal(size=(n, d))
    x = x / np.linalg.norm(x, axis=1)[:, None]
    return x[rng.permutation(n)]


def found(spark, x, **how):
    read = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in forest.nearest(df, k=10, every=max(1, len(x) // 40), compared=read, **how).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = []
    for q, ids in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        recall.append(len(ids & set(np.argsort(-s)[:10].tolist())) / 10)
    return np.mean(recall), read.value / len(got)


@pytest.mark.parametrize("sample", [1 << 16, 600])
def test_compared_rows_stay_when_rows_grow_tenfold(spark, sample):
    """Clusters of one size: ten times the rows, about as many compared for a query; whether all rows fit the sample or leaves are split where they are owned."""
    small, large = clustered(1_000), clustered(10_000)
    recall_small, read_small = found(spark, small, sample=sample, leaf=32)
    recall_large, read_large = found(spark, large, sample=sample, leaf=32)
    assert recall_small >= 0.9 and recall_large >= 0.9
    assert read_large < 2.5 * read_small, (read_small, read_large)


def test_split_leaves_find_all_when_all_are_read(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)] + [(i, [1.0] * 8) for i in range(900, 960)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = forest.nearest(df, k=7, every=20, sample=60, leaf=8, budget=1e9)
    tree, parts = forest.bottoms(np.hstack([np.array([v for _, v in rows]), np.zeros((460, 1))]), 1, 8)
    assert sorted(np.concatenate(parts).tolist()) == list(range(460)) and len(parts) == len(tree.leaf_rows)
    want = brute(rows, 7, 20)
    hits = sum(len({i for _, i in want[q]} & {r["vec_id"] for r in got.where(f"query_id = {q}").collect()}) for q in list(want)[:5])
    assert hits >= 0.9 * 5 * 7

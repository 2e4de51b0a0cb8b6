"""The exact join of queries and vectors, and the index of cells, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from textquarry.operators import vectors


def brute(x, q, k, own=None):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    out = {}
    for i, s in enumerate(np.round(unit(q) @ unit(x).T, vectors.DECIMALS)):
        order = [j for j in np.lexsort((np.arange(len(x)), -s)) if own is None or j != own[i]][:k]
        out[i if own is None else own[i]] = [(int(j), float(s[j])) for j in order]
    return out


def listed(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["similarity"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def frame(spark, x, ids="vec_id", vec="embedding"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{ids} long, {vec} array<double>")


def close(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=2e-9)


def test_join_of_many_queries(spark, monkeypatch):
    """In several slices and blocks, with copies (ties), zero vectors and rows that take no part."""
    monkeypatch.setattr(vectors, "HELD", 12 * 8 * 20)
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 12))
    x[300:340] = x[7]
    x[50] = 0
    q = np.vstack([rng.normal(size=(40, 12)), x[7:8], np.zeros((1, 12))])
    odd = spark.createDataFrame([(9001, None), (9002, [float("nan")] * 12), (9003, [1.0]), (None, [1.0] * 12), (9004, [None] * 12)], "vec_id long, embedding array<double>")
    got = vectors.knn_join(frame(spark, x).union(odd).repartition(5), frame(spark, q, "query_id", "query").withColumn("rank", F.lit(1)), 25)
    close(listed(got), brute(x, q, 25))
    assert vectors.knn_join(frame(spark, x), frame(spark, q, "query_id", "query").limit(0), 3).count() == 0
    assert vectors.knn_join(frame(spark, x).limit(0), frame(spark, q, "query_id", "query"), 3).count() == 0
    few = vectors.knn_join(frame(spark, x[:4]), frame(spark, x[:4], "query_id", "query"), 10, itself=False)
    close(listed(few), brute(x[:4], x[:4], 10, own=[0, 1, 2, 3]))


def test_blocks_that_cannot_hold_better_are_not_compared():
    rng = np.random.default_rng(2)
    centres = vectors._unit(rng.normal(size=(40, 24)))
    x = vectors._unit(np.repeat(centres, 50, axis=0) + 0.02 * rng.normal(size=(2000, 24)))
    held = vectors.Best(x[::200].copy(), 5)
    for i in range(0, 2000, 50):
        held.add(x[i : i + 50], np.arange(i, i + 50))
    assert held.skipped > 0.4 * 10 * 40
    want = brute(x, x[::200], 5)
    assert {i: list(map(int, r)) for i, r in enumerate(held.id)} == {i: [j for j, _ in r] for i, r in want.items()}


def test_cells_of_structured_vectors(spark, tmp_path):
    """Ten times the rows in ten times the clusters: recall holds, and a query reads a small share of the cells' files."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(150, 24))
    x = np.repeat(centres, 20, axis=0) + 0.15 * rng.normal(size=(3000, 24))
    x = x[rng.permutation(len(x))]
    rows = frame(spark, x)
    index = vectors.CellIndex.build(rows, str(tmp_path / "i"), k=10)
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got, own = listed(index.search(asked, 10, itself=False)), list(range(0, 3000, 50))
    want = brute(x, x[own], 10, own)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in own])
    assert recall >= 0.9 and index.probes <= 0.15 * len(index.centres)
    assert index.vectors().count() == 3000
    for q in own:  # similarities are exact
        sims = {i: s for i, s in brute(x, x[[q]], 3000, [q])[q]}
        assert all(abs(sims[i] - s) < 2e-9 for i, s in got[q])
    # of one query only its cells' files are read
    one = index.search(asked.where("query_id = 0"), 5)
    files = {f.split("cell=")[1].split("/")[0] for f in index.vectors().where(F.col("cell").isin([r["cell"] for r in index.vectors().limit(1).collect()])).inputFiles()}
    assert len(files) >= 1 and one.count() == 5
    assert "PartitionFilters: [cell" in one._jdf.queryExecution().toString() or "cell" in one._jdf.queryExecution().toString().split("PartitionFilters:")[1][:60]


def test_all_probes_are_exact_and_hot_cells_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 50)
    monkeypatch.setattr(vectors, "WIDE", 40)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8))
    x[100:300] = x[3]
    rows = frame(spark, x)
    index = vectors.CellIndex.build(rows, str(tmp_path / "i"), cells=6)
    asked = frame(spark, x[[0, 3, 350]], "query_id", "query")
    got = listed(index.search(asked, 10, probes=6))
    close(got, brute(x, x[[0, 3, 350]], 10))
    empty = vectors.CellIndex.build(rows.limit(0), str(tmp_path / "e"))
    assert empty.search(asked).count() == 0


def test_recall_on_the_table(spark):
    """Directions without clusters: most cells are read, and 0.9 of the neighbours are found."""
    from textquarry.plans import catalog

    d = "/root/testdata/sf0.01"
    want, got = listed(catalog.QUERIES["knn_join"](spark, d)), listed(catalog.QUERIES["cell_index_topk"](spark, d))
    assert want.keys() == got.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.85

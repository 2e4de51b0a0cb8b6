"""The keyword index against the scan of all texts."""

import random

import pytest
from pyspark.sql import functions as F

from textquarry.operators import postings, retrieval

WORDS = ["alpha", "beta", "gamma", "delta", "über", "k9_x", "omega", "pi", "of", "sigma", "theta", "kappa", *(f"rare{k}" for k in range(12))]
WEIGHTS = [8] * 6 + [2] * 6 + [1] * 12


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices(WORDS, WEIGHTS)[0] + rng.choice(["", "", ",", ".", "-x"]) for _ in range(rng.randint(0, 40))), [rng.choice(["Alpha", "sigma", "none"])] * rng.randint(0, 2)) for k in range(300)]
    rows += [(1000, None, None), (1001, "", ["alpha"]), (1002, "alpha " * 3000 + "beta gamma", [])]
    return spark.createDataFrame(rows, "doc_id long, text string, tags array<string>")


@pytest.mark.parametrize("keywords", [None, "tags"])
def test_scores_of_a_hundred_queries(spark, docs, tmp_path, keywords, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 7)
    index = postings.Postings.build(docs, str(tmp_path / "i"), keywords=keywords, buckets=8)
    rng = random.Random(7)
    queries = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) for _ in range(97)] + ["", "pi of", "Alpha, BETA!"]
    got = {}
    for r in index.search(spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")).collect():
        got.setdefault(r["query_id"], {})[r["doc_id"]] = r["score"]
    rows = docs.collect()
    lists = {r["doc_id"]: [w for w in "".join(c if c.isascii() and (c.isalnum() or c == "_") else " " for c in (r["text"] or "").lower()).split() if len(w) > 2] for r in rows}
    sizes = {r["doc_id"]: len((r["text"] or "").split()) for r in rows}
    tags = {r["doc_id"]: [x.lower() for x in r["tags"] or ()] if keywords else [] for r in rows}
    import math

    n, mean = len(rows), sum(sizes.values()) / len(rows)
    for q, text in enumerate(queries):
        terms = [w for w in "".join(c if c.isascii() and (c.isalnum() or c == "_") else " " for c in text.lower()).split() if len(w) > 2]
        want = {}
        for d, ts in lists.items():
            total, present = 0.0, 0
            for w in dict.fromkeys(terms):
                df = sum(w in x for x in lists.values())
                idf = 0 if not df else math.log(1.1) if df >= n else math.log((n - df + 0.5) / (df + 0.5))
                tf = ts.count(w) + 3 * tags[d].count(w)
                if tf:
                    present += 1
                    total += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * sizes[d] / mean))
            row = any(ts[k : k + len(terms)] == terms for k in range(len(ts))) if terms else False
            score = total * (3 if row else 0.3 + 0.7 * present / max(len(set(terms)), 1))
            if score > 0:
                want[d] = score
        mine = got.get(q, {})
        assert mine.keys() == want.keys() and all(abs(mine[d] - s) < 1e-9 for d, s in want.items()), text
    assert sum(map(len, got.values())) > 1000


def test_same_as_the_scan_and_only_the_terms_buckets_are_read(spark, docs, tmp_path):
    index = postings.Postings.build(docs, str(tmp_path / "i"), buckets=32)
    for q in ("alpha sigma", "rare3", "kappa beta rare1", "rare2 rare4"):
        found = index.search(spark.createDataFrame([(1, q)], "query_id int, query string"))
        want = {r["doc_id"]: r["score"] for r in retrieval.bm25(docs, q).collect()}
        whole = {r["doc_id"] for r in docs.where(F.contains(F.lower("text"), F.lit(q))).collect()}
        got = {r["doc_id"]: r["score"] for r in found.collect()}
        assert got.keys() == want.keys()
        # a phrase parted otherwise than by one space is a phrase for the index only
        assert all(abs(got[d] - s) < 1e-9 for d, s in want.items() if d in whole or " " not in q or got[d] < 2 * s)
        assert sum(abs(got[d] - s) < 1e-9 for d, s in want.items()) >= 0.8 * len(want) > 0
    asked = index.search(spark.createDataFrame([(1, "rare5 kappa")], "query_id int, query string"), 5)
    plan = asked._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters:")[1][:200]
    ranks = [(r["rank"], r["score"]) for r in asked.orderBy("rank").collect()]
    assert [r for r, _ in ranks] == [1, 2, 3, 4, 5] and sorted(ranks, key=lambda x: -x[1]) == ranks
    files = asked._jdf.queryExecution().analyzed().toString()
    assert "text" not in files


def test_empty_index(spark, docs, tmp_path):
    index = postings.Postings.build(docs.where("doc_id = 1000"), str(tmp_path / "i"))
    assert index.search(spark.createDataFrame([(1, "alpha")], "query_id int, query string")).count() == 0


def test_documents_of_a_term_lie_together_before_the_shuffle():
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"doc": [5, 6, 7], "low": ["one two one", "two", ""], "kw": [["two"], [], ["six"]], "len": [3.0, 1.0, 0.0]}, schema=pa.schema([("doc", pa.int64()), ("low", pa.string()), ("kw", pa.list_(pa.string())), ("len", pa.float64())]))
    got = {r["term"]: (r["df"], r["doc"], r["kw"], r["positions"]) for b in postings._posted(iter([rows])) for r in b.to_pylist()}
    assert got == {"one": (1, [5], [0], [[0, 2]]), "two": (2, [5, 6], [1, 0], [[1], [0]]), "six": (0, [7], [1], [[]])}

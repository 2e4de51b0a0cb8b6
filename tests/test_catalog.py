"""The registered queries against their SQL on the smallest tables."""

import math
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from textquarry.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return (None if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    got = sorted([tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()], key=repr)
    rel = duck.sql(entry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert sorted(rel.columns) == sorted(df.columns)
    assert sorted([tuple(plain(r[i]) for i in at) for r in rel.fetchall()], key=repr) == got


def _letters(texts):
    return Counter(c for t in texts for c in t if c.isalnum())


@pytest.mark.parametrize("name", sorted(n for n in set(catalog.QUERIES) - set(catalog.SQL) if n.startswith("chunk_")))
def test_chunks_hold_the_whole_text(spark, name):
    """Without SQL: positions count from 1, and no letter or digit of a text is lost (separators at a cut may be)."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(DATA / "documents.parquet")).collect()}
    chunks = {}
    for r in sorted(entry.queries()[name](spark, str(DATA)).collect(), key=lambda r: r["position"]):
        chunks.setdefault(r["doc_id"], []).append(r)
    assert chunks.keys() == {i for i, t in texts.items() if (t or "").strip()}
    for i, rows in chunks.items():
        assert [r["position"] for r in rows] == list(range(1, len(rows) + 1)) and all(r["chunk"].strip() for r in rows)
        got = [r["chunk"] for r in rows if name != "chunk_parent_child" or r["kind"] == "parent"]
        # equal chunks are given once by the splitter at separators
        if name == "chunk_separators":
            bare = lambda t: set(re.findall(r"\w+", t))
            assert bare(texts[i]) <= bare(" ".join(got))
        else:
            assert not _letters([texts[i]]) - _letters(got)


def test_stems(spark):
    got = entry.queries()["stemmed_keywords"](spark, str(DATA)).collect()
    ranked = {}
    for r in entry.queries()["keyword_topn"](spark, str(DATA)).collect():
        ranked.setdefault(r["doc_id"], {})[r["rank"]] = r["token"]
    assert {r["doc_id"] for r in got} == ranked.keys() and all(len(r["keywords"]) == len(set(r["keywords"])) for r in got)
    assert all(set(r["keywords"]) & set(ranked[r["doc_id"]].values()) for r in got)


def test_names_are_matched_as_by_hand(spark):
    """Runs of words at a distance of at most one letter each, compared with every run of every text."""
    names = {r["item_id"]: " ".join(r["text"].split(" ")[:3]) for r in spark.read.parquet(str(DATA / "benchmark.parquet")).collect()}
    words = lambda x: [w for w in re.split(r"\s+", re.sub(r"[^\w\s]|_", " ", x or "").lower()) if len(w) > 2]

    def close(a, b):
        if a == b:
            return True
        if abs(len(a) - len(b)) > 1:
            return False
        k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]

    memo = {}
    want = set()
    entries = {i: words(n) for i, n in names.items() if words(n)}
    for r in spark.read.parquet(str(DATA / "documents.parquet")).collect():
        w = words(r["text"])
        for i, e in entries.items():
            for at in range(len(w) - len(e) + 1):
                near = sum(memo.setdefault((x, y), close(x, y)) for x, y in zip(w[at : at + len(e)], e, strict=True))
                if near / len(e) >= 0.7:
                    want.add((r["doc_id"], i, at + 1))
    got = {(r["doc_id"], r["entity_id"], r["at"]) for r in entry.queries()["dictionary_matches"](spark, str(DATA)).collect()}
    assert got == want and want


def test_nothing_is_left_unchecked():
    assert {n for n in set(catalog.QUERIES) - set(catalog.SQL) if not n.startswith("chunk_")} == {"stemmed_keywords", "dictionary_matches"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_filters_reach_the_scan(spark):
    df = catalog.QUERIES["generic_query"](spark, str(DATA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "o_custkey" not in plan

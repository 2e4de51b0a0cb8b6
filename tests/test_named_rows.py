"""Functions that no query runs: what they give on small rows."""

import pytest
from pyspark.sql import functions as F

from textquarry.functions import records, splitters, text
from textquarry.operators import entities, graph, joins, metrics, predicates, retrieval
from textquarry.sources import files
from textquarry.streaming import ingest


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return frame(spark, [tuple(values.values()) or ("",)], schema).select(column.alias("y")).first()["y"]


def test_templates_rename_what_they_know(spark):
    df = frame(spark, [("t", "b", "x")], "Headline string, ` Body ` string, other string")
    assert files.apply_template(df, "news_article").columns == ["title", "content"]
    with pytest.raises(KeyError):
        files.apply_template(df, "none")


def test_provider_with_most_models(spark):
    rows = frame(spark, [(1, ["a"], 3), (2, ["a", "b"], 2), (3, ["c", "d"], 1), (4, None, 0)], "id int, models array<string>, created_at int")
    assert predicates.best_provider(rows).first()["id"] == 3 and predicates.best_provider(rows.where("id IN (1, 4)")).first()["id"] == 1


def test_samples_have_an_owner(spark):
    v = frame(spark, [(k, [1.0] * (2 if k < 5 else 3)) for k in range(7)], "embedding_id int, embedding array<double>")
    got = {(r["dimension"], r["rank"]): r["owner"] for r in joins.samples_with_owner(v, frame(spark, [(0, 70), (6, 76)], "embedding_id int, segment_id int"), 2).collect()}
    assert got == {(2, 1): "70", (2, 2): "orphan", (3, 1): "orphan", (3, 2): "76"}


def test_context_of_a_prompt(spark):
    hits = frame(spark, [(1, 0.2, "low"), (2, 0.9, "high"), (3, 0.9, "high too")], "id int, score double, content string")
    assert retrieval.prompt_context(hits, order=[F.desc("score"), F.col("id")]).first()["context"] == "[1] high\n\n[2] high too\n\n[3] low"


def test_summary_of_a_step(spark):
    df = frame(spark, [("one two three",), (None,), ("x" * 300,)], "c string")
    summary, shown = metrics.step_summary(df, "c", n=2, width=5)
    r = summary.first()
    assert (r["n"], r["mean_words"]) == (3, pytest.approx(4 / 3)) and r["mean_tokens"] == pytest.approx((4 + 0 + 75) / 3)
    assert shown.count() == 2 and all(x["preview"] is None or len(x["preview"]) <= 5 for x in shown.collect())


def test_pages_of_messages(spark):
    turns = frame(spark, [(1, n, "u", f"m{n}") for n in range(7)] + [(2, 0, "u", "z")], "conv_id int, turn int, role string, text string")
    page = lambda k: [(r["turn"], r["has_more"]) for r in retrieval.message_page(turns, 1, k, 3).collect()]
    assert page(1) == [(4, True), (5, True), (6, True)] and page(2) == [(1, True), (2, True), (3, True)] and page(3) == [(0, False)] and page(4) == []


def test_types_by_number(spark):
    nodes = frame(spark, [("b",), ("a",), ("b",), ("c",), ("a",)], "type string")
    assert [tuple(r) for r in graph.top_types(nodes, 2).collect()] == [("a", 2), ("b", 2)]


def test_entities_of_a_prompt(spark):
    m = frame(spark, [(1, "brand", "B"), (1, "brand", "A"), (1, "brand", "A"), (1, "place", "P"), (2, "brand", "C")], "doc_id int, type string, name string")
    assert {r["doc_id"]: r["entities"] for r in entities.grouped_prompt(m).collect()} == {1: "brand: A, B\nplace: P", 2: "brand: C"}


def test_maps_reviews_and_lines(spark):
    df = frame(spark, [({"a": "1", "b": "2"}, {"b": "3", "c": "4"})], "x map<string,string>, y map<string,string>")
    assert df.select(records.spread(F.col("x"), F.col("y")).alias("z")).first()["z"] == {"a": "1", "b": "3", "c": "4"}
    ok = frame(spark, [(" Approved ", "r", 0.456)], "d string, r string, c double").select(records.approval(F.col("d"), F.col("r"), F.col("c")).alias("z")).first()["z"]
    assert (ok["status"], ok["reason"], str(ok["confidence"])) == ("approved", "r", "0.46")
    assert one(spark, records.approval(F.col("d"), F.lit(None).cast("string"), F.lit(None))["status"], d="no") == "rejected"
    assert one(spark, text.labelled_lines([("Title", F.col("a")), ("Author", F.lit("")), ("Likes", F.lit(3)), ("Url", F.lit(None).cast("string"))]), a="T") == "Title: T\nLikes: 3"


@pytest.mark.parametrize(("block", "kind"), [("## Head", "title"), ("1.2 Scope", "title"), ("ALL CAPS HEAD", "title"), ("- item", "list"), ("2) item", "list"), ("Page 3 of 9", "footer"), ("3 / 9", "footer"), ("© 2024 us", "footer"), ("A plain sentence.", "paragraph")])
def test_kinds_of_blocks(spark, block, kind):
    assert one(spark, text.block_kind(F.col("x")), x=block) == kind


def test_spaces_of_chinese_text(spark):
    assert one(spark, text.clean_chinese(F.col("x")), x=" 中 文 ， 测 试  （ 好 ） ab  cd \n") == "中文，测试（好）ab cd"
    assert one(spark, text.clean_chinese(F.lit(None).cast("string"))) == ""


def test_structural_parts():
    a, b, c = "First part. " * 6, "Second part. " * 6, "Third part. " * 6
    got = splitters.structural(f"{a}\n\nshort\n\n{b}\n \n{c}")
    assert got == [a.strip(), b.strip(), c.strip()]
    assert all(len(p) >= 50 for p in splitters.structural(f"{a}\n\n{b}", how="sentence", least=50))
    long = "A sentence of some words here. " * 200
    parts = splitters.structural(long)
    assert len(parts) >= 3 and all(len(p) <= 2000 for p in parts) and "".join(parts).replace(" ", "") == long.replace(" ", "")


def test_children_are_cut_from_their_parent():
    words = " ".join(f"w{k}" for k in range(400))
    rows = splitters.hierarchical(words, 200, 0)
    parents = {r["position"]: r["chunk"] for r in rows if r["kind"] == "parent"}
    for p, chunk in parents.items():
        own = [r for r in rows if r["kind"] == "child" and r["parent"] == p]
        assert [r["position"] for r in own] == list(range(1, len(own) + 1)) and own
        assert all(len(r["chunk"]) <= 200 for r in own) and " ".join(r["chunk"] for r in own).split() == chunk.split()
    assert splitters.hierarchical(None, 200, 20) == []


def test_progress_is_kept(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    frame(spark, [("a",), ("b",)], "hash string").write.parquet(source)
    seen = ingest.Progress(most=50)
    spark.streams.addListener(seen)
    try:
        ingest.ingest_once(ingest.stream(spark, source, "hash string"), target, str(tmp_path / "state")).awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(seen)
    import time

    for _ in range(50):
        if any(r["event"] == "ended" for r in seen.reports):
            break
        time.sleep(0.2)
    kinds = [r["event"] for r in seen.reports]
    assert kinds[0] == "started" and "ended" in kinds and sum(r.get("rows", 0) for r in seen.reports) >= 2 and not seen.errors

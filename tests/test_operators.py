"""Operators on small tables with known answers."""

import random
import re
import math

import pytest
from pyspark.sql import functions as F

from textquarry.functions import records, splitters, text
from textquarry.operators import brands, dedup, entities, graph, joins, metrics, mutations, predicates, retrieval
from textquarry.plans.workflow import Node, Workflow, chain
from textquarry.sources import files, tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def posts(spark):
    return frame(spark, [(1, "Hello world"), (2, "Test message"), (3, "Another test"), (4, None), (5, "   ")], "position int, content string")


def test_rule_filter(spark, posts):
    rule = predicates.FilterRule("t", "test")
    keep = predicates.rule_filter(posts, predicates.RuleFilter((rule,))).collect()
    assert [r["position"] for r in keep] == [1]
    kept = predicates.rule_filter(posts, predicates.RuleFilter((rule,), preserve_empty=True)).count()
    assert kept == 3
    # content is lowered, patterns are not
    assert predicates.rule_filter(posts, predicates.RuleFilter((predicates.FilterRule("t", "Test"),))).count() == 3
    assert predicates.rule_filter(posts, predicates.RuleFilter((predicates.FilterRule("t", "Test"),), case_sensitive=True)).count() == 2
    assert predicates.rule_filter(posts, predicates.RuleFilter((predicates.FilterRule("x", "(", "remove"), predicates.FilterRule("off", ".", enabled=False)))).count() == 3
    lengths = frame(spark, [(1, "a" * 5), (2, "b" * 24), (3, "c" * 3)], "position int, content string")
    assert predicates.rule_filter(lengths, predicates.RuleFilter(min_length=10)).count() == 1
    assert predicates.rule_filter(posts, predicates.RuleFilter(content="none")).count() == 0
    assert predicates.RuleFilter(min_length=5, max_length=2).problems() and not predicates.RuleFilter((rule,)).problems()
    first = predicates.RuleFilter((predicates.FilterRule("k", "message", "keep"), rule), default_action="remove")
    assert [r["position"] for r in predicates.rule_filter(posts, first).collect()] == [2]


def test_hash_duplicates(spark):
    df = frame(spark, [(1, "a  b"), (2, "A b "), (3, "c"), (4, None), (5, "")], "p int, c string")
    assert [r["is_duplicate"] for r in dedup.hash_duplicates(df, "c", "p").orderBy("p").collect()] == [False, True, False, False, True]
    assert [r["is_duplicate"] for r in dedup.hash_duplicates(df, "c", "p", case_sensitive=True).orderBy("p").collect()] == [False, False, False, False, True]
    marks = frame(spark, [(1, "é"), (2, "e\u0301")], "p int, c string")
    assert dedup.hash_duplicates(marks, "c", "p", decompose=True).where("is_duplicate").count() == 1


@pytest.mark.parametrize(("threshold", "kept"), [(0, {1}), (0.1, {1, 5}), (0.3, {1, 5}), (0.5, {1, 4, 5}), (0.67, {1, 3, 4, 5}), (1.0, {1, 3, 4, 5}), ("0.5", {1, 4, 5}), (7, {1, 3, 4, 5})])
def test_similarity_duplicates(spark, threshold, kept):
    df = frame(spark, [(1, "Apple banana cherry"), (2, "Apple banana cherry"), (3, "Apple banana"), (4, "Apple"), (5, "Orange grapefruit lemon")], "p int, c string")
    got = dedup.similarity_duplicates(df, "c", "p", threshold).where("NOT is_duplicate").collect()
    assert {r["p"] for r in got} == kept


def test_record_search(spark):
    df = frame(spark, [(1, "News A", '{"k": "abc", "n": 5, "post_timestamp": "2024-01-02"}'), (2, "other", '{"k": "xyz"}'), (3, None, None)], "id int, title string, meta string")
    ids = lambda **kw: [r["id"] for r in df.where(predicates.RecordSearch(**kw).condition()).collect()]
    assert ids(title="news") == [1] and ids(meta_key="k") == [1, 2] and ids(meta_key="k", meta_value="abc") == [1]
    assert ids(meta_key="k", meta_value="/^X/i") == [2] and ids(meta_key="k", meta_value="/^X/") == [] and ids(meta_key="k", meta_value="a.c") == [1]
    assert ids(meta_key="n", meta_value=5) == [1] and ids(meta_from="2024-01-01", meta_to="2024-01-31") == [1]


def test_guarded_conditions():
    for bad in ("system('x')", "a; drop", "b = 1", "(select 1)"):
        with pytest.raises(ValueError):
            predicates.guarded(bad, ["a"])


def test_upsert_and_delete(spark):
    table = frame(spark, [("a", 1, "x"), ("b", 2, "y")], "k string, v int, s string")
    changes = frame(spark, [("b", 5, 1), ("b", None, 2), ("c", 7, 3), (None, 9, 4)], "k string, v int, n int")
    got = {r["k"]: (r["v"], r["s"]) for r in mutations.upsert(table, changes, "k", "n", {"s": "pending"}).collect()}
    assert got == {"a": (1, "x"), "b": (5, "y"), "c": (7, "pending")}
    ids = frame(spark, [("a",), ("z",), ("a",), (None,)], "k string")
    assert [r["k"] for r in mutations.delete(table, ids, "k").collect()] == ["b"]
    r = mutations.delete_report(table, ids, "k").first()
    assert (r["requested"], r["deleted"], r["failed"]) == (2, 1, 1)
    keys = frame(spark, [("T ", "c", None), ("t", " C", "s"), (None, None, None)], "t string, c string, s string")
    k = mutations.strategy_key("TITLE_CONTENT_SITE", {"title": F.col("t"), "content": F.col("c"), "site": F.col("s")})
    got = [r["k"] for r in keys.select(k.alias("k")).collect()]
    assert got[0] == "title=t|content=c" and got[1] == "title=t|content=c|site=s" and got[2] is None


def test_segments(spark):
    s = frame(spark, [("r", None), ("a", "r"), ("b", "a"), ("x", None)], "segment_id string, parent_id string")
    assert {(r["node"], r["depth"]) for r in mutations.descendants(s, "r").collect()} == {("r", 0), ("a", 1), ("b", 2)}
    v = frame(spark, [(1, [1.0, 2.0], "done"), (2, [1.0, 2.0], "done"), (3, [1.0], "done")], "id int, embedding array<double>, status string")
    got = {r["id"]: (r["status"], r["embedding"]) for r in mutations.consistent_vectors(v).collect()}
    assert got[3] == ("waiting", None) and got[1] == ("done", [1.0, 2.0])


def test_bm25(spark):
    df = frame(spark, [(1, "alpha beta gamma"), (2, "alpha delta"), (3, "epsilon zeta"), (4, None)], "doc_id int, text string")
    got = {r["doc_id"]: r["score"] for r in retrieval.bm25(df, "beta alpha").collect()}
    mean, idf_b = (3 + 2 + 2 + 0) / 4, math.log((4 - 1 + 0.5) / (1 + 0.5))
    tf = lambda n, length: n * 2.5 / (n + 1.5 * (0.25 + 0.75 * length / mean))
    assert set(got) == {1} or set(got) == {1, 2}
    idf_a = math.log((4 - 2 + 0.5) / (2 + 0.5))
    assert abs(got[1] - (idf_a * tf(1, 3) + idf_b * tf(1, 3))) < 1e-9
    assert retrieval.bm25(df, "an of").count() == 0


def test_knn_and_fusion(spark):
    v = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0])], "vec_id int, embedding array<double>")
    assert [r["vec_id"] for r in retrieval.knn(v, [1.0, 0.0], 3, above=0.0).collect()] == [1, 3]
    with pytest.raises(ValueError):
        retrieval.knn(v, [], 3)
    sem, kw = frame(spark, [(1, 0.9), (2, 0.2)], "k int, score double"), frame(spark, [(2, 3.0), (3, 1.0)], "k int, score double")
    got = retrieval.fused(retrieval.combined(sem, kw, "k"), "k").collect()
    assert [(r["k"], r["match_type"]) for r in got] == [(2, "hybrid"), (1, "semantic"), (3, "keyword")]
    scaled = retrieval.fused(retrieval.combined(sem, kw, "k"), "k", scaled=True, model=F.when(F.col("k") == 2, 0.1).otherwise(0.9)).collect()
    assert [r["k"] for r in scaled] == [1, 2, 3]
    assert retrieval.weights_of((None, 0.5), (0.2, 0.9)) == (0.2, 0.5)


def test_quality(spark):
    res = frame(spark, [("q", "a", 1), ("q", "x", 2), ("q", "b", 3)], "query_id string, item_id string, rank int")
    exp = frame(spark, [("q", "a", 1), ("q", "b", 2), ("q", "c", 1)], "query_id string, item_id string, relevance int")
    r = metrics.retrieval_quality(res, exp).first()
    dcg, ideal = 1 + 3 / 2, 3 + 1 / math.log2(3) + 1 / 2
    assert abs(r["ndcg"] - dcg / ideal) < 1e-9 and abs(r["average_precision"] - (1 + 2 / 3) / 3) < 1e-9 and r["precision"] == r["recall"] == 2 / 3


def test_latency(spark):
    r = metrics.latency(frame(spark, [("a", float(i)) for i in range(1, 21)], "g string, v double"), "v", "g").first()
    assert (r["n"], r["mean"], r["median"], r["p95"]) == (20, 10.5, 10.5, 20.0)


@pytest.fixture(scope="module")
def path_graph(spark):
    rows = [("Nike", "Air Jordan 1"), ("Air Jordan 1", "NBA Finals"), ("NBA Finals", "@lebron"), ("@lebron", "Great shoes"), ("Adidas", "Stan Smith")]
    return frame(spark, rows, "src string, dst string")


def test_graph(spark, path_graph):
    r = graph.shortest_path(path_graph, "Nike", "Great shoes").first()
    assert r["distance"] == 4 and r["path"] == ["Nike", "Air Jordan 1", "NBA Finals", "@lebron", "Great shoes"]
    assert graph.shortest_path(path_graph, "Great shoes", "Nike").count() == 0 and graph.shortest_path(path_graph, "Nike", "Nike").first()["distance"] == 0
    assert {(r["node"], r["distance"]) for r in graph.neighbours(path_graph, "NBA Finals", 1).collect()} == {("NBA Finals", 0), ("Air Jordan 1", 1), ("@lebron", 1)}
    c = graph.communities(path_graph).collect()
    assert len(c) == 1 and (c[0]["size"], c[0]["internal"], c[0]["density"]) == (5, 4, 0.4)
    assert {r["node"]: r["betweenness"] for r in graph.betweenness(path_graph).collect()} == {"Air Jordan 1": 3, "NBA Finals": 4, "@lebron": 3}
    assert graph.closeness(path_graph).where("node = 'NBA Finals'").first()["closeness"] == 4 / 6
    assert graph.degree(path_graph, 3).count() == 3
    nodes = frame(spark, [("Nike", "brand"), ("lonely", "brand")], "node string, type string")
    assert [r["node"] for r in graph.isolated(nodes, path_graph).collect()] == ["lonely"]


def test_distances_on_a_long_path(spark):
    n = 68  # further apart than 64 hops
    e = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    r = graph.mean_path_length(e).first()
    assert r["pairs"] == n * (n + 1) // 2 and abs(r["mean_path_length"] - (n + 2) / 3) < 1e-9


def test_components_of_a_long_path(spark):
    e = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.component_labels(e).select("component").distinct().collect()[0][0] == 0


def test_brands(spark):
    m = frame(spark, [(1, "a", "u", 0.9, None), (2, "a", "v", 0.0, None), (3, "a", "v", 0.1, "positive"), (4, "b", "v", 0.2, None)], "mention_id int, brand string, author string, score double, tag string").withColumn("ts", F.expr("timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, mention_id)"))
    r = {x["brand"]: x for x in brands.sentiment(m).collect()}
    assert (r["a"]["positive"], r["a"]["negative"], r["a"]["neutral"]) == (2, 0, 1) and r["b"]["negative"] == 1
    assert {x["brand"]: x["trend"] for x in brands.trend(m).collect()} == {"a": "decreasing", "b": "stable"}
    o = brands.influencer_overlap(m).first()
    assert (o["shared"], o["overlap"]) == (1, 0.5)


def test_label_pairs_are_all_pairs(spark):
    import random

    rng = random.Random(3)
    labels = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(70)]
    df = frame(spark, [(i, s, "t" if i % 2 else "u") for i, s in enumerate(labels)], "id int, label string, type string")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for t in (0.6, 0.8):
        want = {(i, j) for i in range(70) for j in range(i + 1, 70) if i % 2 == j % 2 and (n := max(len(labels[i]), len(labels[j]))) and (n - lev(labels[i], labels[j])) / n >= t}
        assert {(r["i"], r["j"]) for r in entities.label_pairs(df, t).collect()} == want


def test_entities(spark):
    nodes = frame(spark, [(1, "Nike", "brand", 0.5), (2, "Nikee", "brand", 0.9), (3, "Adidas", "brand", 0.4)], "id int, label string, type string, confidence double")
    groups = {r["id"]: r["leader"] for r in entities.duplicate_groups(nodes).collect()}
    assert groups == {1: 1, 2: 1, 3: 3}
    target = entities.canonical_node(nodes.join(entities.duplicate_groups(nodes), "id"), "leader")
    assert {r["leader"]: r["target"] for r in target.collect()} == {1: 2, 3: 3}
    edges = frame(spark, [(1, 3, "competes_with"), (2, 3, "competes_with"), (1, 2, "x")], "src int, dst int, edge_type string")
    kept, moved, log = entities.merged(nodes, edges, frame(spark, [(1, 2)], "source int, target int"))
    assert {r["id"] for r in kept.collect()} == {2, 3} and [(r["src"], r["dst"]) for r in moved.collect()] == [(2, 3)] and log.count() == 1
    ent = frame(spark, [(7, "Air Jordan Shoes"), (8, "of a")], "entity_id int, name string")
    docs = frame(spark, [(1, "new air jordon shoes today"), (2, "air jordan shoes"), (3, "air only")], "doc_id int, text string")
    got = {(r["doc_id"], r["entity_id"]): r["confidence"] for r in entities.dictionary_matches(docs, ent).collect()}
    assert got == {(1, 7): 1.0, (2, 7): 1.0}
    used = entities.used(frame(spark, [(7, 3, 0.5)], "entity_id int, usage long, confidence double"), frame(spark, [(7,), (7,)], "entity_id int")).first()
    assert used["usage"] == 5 and abs(used["confidence"] - (0.5 + 0.04 + 0.05)) < 1e-9


def test_records(spark):
    df = frame(spark, [(" Approved ", '{"data": {"classification": "spam", "confidence": 0.9}}', None)], "d string, payload string, z string")
    m = records.Mapping({"meta.classification": records.Field("payload.data.classification"), "status": records.Field("d", "trim_lowercase"), "gone": records.Field("z", default="none")}, {"status": {"approved": "APPROVED"}}, {"kind": "x"})
    r = records.mapped(df, m, keep=False).first()
    assert (r["meta_classification"], r["status"], r["gone"], r["kind"]) == ("spam", "APPROVED", "none", "x")
    h = frame(spark, [("a", None, "b"), ("a", "b", None)], "x string, y string, z string").select(records.record_hash([F.col(c) for c in "xyz"]).alias("h")).collect()
    assert h[0]["h"] == h[1]["h"]
    assert records.literal("5") == 5 and records.literal("x") == "x" and records.literal("TRUE") is True
    reply = frame(spark, [(1, '{"entities": [{"id": "n1", "type": "Person", "name": "Ann"}, {"id": "n2", "type": "thing", "label": "Acme"}], "relationships": [{"from": "n1", "to": "n2", "type": "uses"}]}')], "k int, j string")
    nodes, edges = records.extraction(reply, "j", "k")
    assert {(r["type"], r["label"]) for r in nodes.collect()} == {("author", "Ann"), ("organization", "Acme")}
    assert [tuple(r) for r in edges.select("source_label", "target_label", "edge_type").collect()] == [("Ann", "Acme", "related_to")]


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(text.levenshtein_similarity(F.lit("kitten"), F.lit("sitting"))) == 4 / 7 and one(text.levenshtein_similarity(F.lit(""), F.lit(""))) == 1
    assert one(text.aliases(F.lit("Air Jordan"))) == ["AirJordan", "Air_Jordan", "Air-Jordan", "air jordan"]
    assert one(text.is_chinese(F.lit("你好 world"))) and not one(text.is_chinese(F.lit("hello")))
    assert one(text.clean_general(F.lit("a  b\r\n\r\n  “x” \n"))) == 'a b\n"x"'
    assert one(text.filled("{{content}}-{{k}}", {"k": F.lit(1)}, F.lit("c"))) == "c-1"
    assert text.stem("caresses") == "caress" and text.stem("running") == "run" and text.stem("relational") == "relat" and text.stem("hopping") == "hop"
    assert text.highlight("nike and Nike", [("nike", "NIKE", 1.0)]) == "[NIKE] and [NIKE]"
    zh = text.chinese_keywords(frame(spark, [(1, "知识库知识库API接口")], "doc_id int, text string"), 3).collect()
    assert "知识" in {r["token"] for r in zh}


def test_splitters():
    body = "One sentence here. Another one follows! A third? " * 30
    for name, f in splitters.SPLITTERS.items():
        for overlap in (0, 15):
            chunks = f(body, 100, overlap)
            assert chunks and all(c.strip() for c in chunks), name
        assert f("", 100, 10) == []
    assert splitters.character("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert splitters.sentence_splitter("A b. C d! E f?", 9, 0) == ["A b. C d!", "E f?"]
    assert splitters.markdown("# A\nx\n## B\ny", 100, 0) == ["# A\nx", "## B\ny"]
    assert splitters.python_code("import os\ndef f():\n  pass\nclass A:\n  pass", 100, 0) == ["import os", "def f():\n  pass", "class A:\n  pass"]
    assert splitters.unique(["a", "b", " a "]) == ["a", "b"]
    pc = splitters.parent_child(body, 200, 20)
    assert {x["kind"] for x in pc} == {"parent", "child"} and all(x["parent"] <= sum(y["kind"] == "parent" for y in pc) for x in pc if x["kind"] == "child")
    assert splitters.tables("x\na\tb\nc\td\te\n\nend") == [[["a", "b", ""], ["c", "d", "e"]]]
    assert splitters.ChunkConfig(size=50).problems() and not splitters.ChunkConfig().problems()
    assert splitters.chinese("你好。世界！" * 40, 50, 0)


def test_workflow(spark, posts):
    flow = chain(("rule_based_filter", {"content": "content", "rules": [{"id": "t", "pattern": "another"}]}), ("duplicate_segment", {}), ("limit", {"order": ["position"], "rows": 5}))
    assert flow.result({"s0": posts}).count() == 2
    assert flow.run({"s0": posts})[0]["status"] == "completed"
    two = Workflow([Node("a", "trigger_manual"), Node("b", "trigger_manual"), Node("c", "trigger_manual", enabled=False)], [("a", "c"), ("b", "c")])
    assert two.result({"a": posts, "b": posts.withColumn("more", F.lit(1))}).count() == 10
    assert Workflow([Node("a", "trigger_manual"), Node("b", "trigger_manual")], [("a", "b"), ("b", "a")]).problems()
    assert Workflow([Node("a", "nothing")]).problems()


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Name , Text\n"a ""q""", 12\n\nb,hello\n')
    rows = files.read_csv(spark, str(tmp_path / "x.csv"))
    assert rows.columns == ["Name", "Text"] and rows.count() == 2
    seg = files.csv_segments(rows.withColumn("n", F.monotonically_increasing_id()), ["Name", "Text"], "n").orderBy("position").collect()
    assert [(r["position"], r["content"]) for r in seg] == [(1, 'a "q"'), (2, "b\n\nhello")]
    assert files.header_check(["A", "b"], ["a", "c"]) == {"valid": False, "missing": ["c"], "extra": ["b"]}
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.md").write_text("# Title\nhello there")
    (tmp_path / "f" / "b.txt").write_bytes("grüße".encode("utf-16"))
    got = {r["path"].rsplit("/", 1)[-1]: r for r in files.read_files(spark, str(tmp_path / "f")).collect()}
    assert got["a.md"]["text_type"] == "markdown" and got["a.md"]["language"] == "english" and got["b.txt"]["encoding"] == "utf-16"
    v, want = 12345, []
    for _ in range(6):
        v = (v * 9301 + 49297) % 233280
        want.append(int(v / 233280 * 1000))
    mock = tables.mock_rows(spark, 3, {"x": "number", "y": "number"}).orderBy("position").collect()
    assert [n for r in mock for n in (r["x"], r["y"])] == want
    assert tables.date_chunks(spark, "2024-01-01 10:00:00", "2024-01-02", 60).count() == 48
    items = spark.createDataFrame([('["a","b"]',), ('{"data": ["c"]}',), ('{"x": 1}',)], "p string").select(tables.payload_items(F.col("p")).alias("i")).collect()
    assert [r["i"] for r in items] == [["a", "b"], ["c"], ['{"x": 1}']]


def test_joins(spark):
    a = frame(spark, [(1, "x"), (2, "y")], "k int, s string")
    many = frame(spark, [(1, 5, "p"), (1, 3, "q")], "k int, n int, t string")
    got = {r["k"]: [x["n"] for x in r["m"]] for r in joins.with_many(a, many, "k", "m", ["n"]).collect()}
    assert got == {1: [3, 5], 2: []}
    assert [r["k"] for r in joins.orphans(a, many, "k").collect()] == [2]


def test_outline_models_and_overlap(spark):
    from pyspark.sql.types import ArrayType, DoubleType

    from textquarry.functions import models

    df = frame(spark, [(1, "Companies:\n* Acme (maker)\n* Bolt Inc\nOrganizations:\n* Cee\nProducts:\n* Rocket (red)")], "k int, t string")
    nodes, edges = records.outlined(df, "t", "k")
    assert ("product", "Rocket", "red") in {(r["type"], r["label"], r["description"]) for r in nodes.collect()}
    assert {(r["source_label"], r["target_label"], r["edge_type"]) for r in edges.collect()} >= {("Acme", "Cee", "competes_with"), ("Cee", "Rocket", "offers")}
    v = models.with_model(df, models.hashed_embedding, "t", "v", ArrayType(DoubleType())).first()["v"]
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-9
    assert models.leading_sentences(["One. Two. " + "x" * 400, None]) == ["One. Two.", ""]
    chunks = frame(spark, [(1, 1, "abcdefghij"), (1, 2, "klm")], "doc_id int, position int, chunk string")
    assert [r["chunk"] for r in splitters.with_overlap(chunks, 0.2).orderBy("position").collect()] == ["abcdefghij", "ij klm"]


def test_sentence_overlap(spark):
    """Chunks worked out by hand: trailing sentences repeat, else the end of the chunk from a word's start; a long sentence stays whole."""
    one, two, three = "Aa bb cc.", "Dd ee ff gg.", "Hh ii jj kk."
    text = f"{one} {two} {three}"
    assert splitters.sentence_splitter(text, 22, 10) == [f"{one} {two}", f"{two} {three}"]
    # the last sentence is longer than 1.2 x 5: the end of five characters, from a word's start in its first half if there is one
    assert splitters.sentence_splitter(text, 22, 5) == [f"{one} {two}", f"f gg. {three}"[1:].strip()]
    assert splitters.sentence_splitter(text, 22, 0) == [f"{one} {two}", three]
    long = "x" * 700 + "."
    assert splitters.sentence_splitter(f"Short one. {long} End now.", 500, 0) == ["Short one.", long, "End now."]
    # the whole chunk is no longer than the overlap
    assert splitters.sentence_splitter("Ab. Cd ef gh.", 8, 5) == ["Ab.", "Ab. Cd ef gh."]


def test_smart_chunks(spark):
    a, b = "p" * 60, "q" * 30
    assert splitters.smart_chunking(f"{b}\n\n{a}\n\n{b}\n\n{b}\n\n{b}", 100, 0) == [f"{b} {a}", f"{b} {b}", b]
    s = ["One two three four five six.", "Seven eight nine ten eleven.", "Twelve thirteen fourteen."]
    assert splitters.smart_chunking(" ".join(s), 60, 20) == [" ".join(s[:2]), f"{splitters._tail(' '.join(s[:2]), 20)} {s[2]}"]
    assert splitters.smart_chunking(" ".join(s), 60, 22) == [" ".join(s[:2]), f"{s[1]} {s[2]}"]


def test_token_overlap():
    text = " ".join(f"word{i}" for i in range(40))
    got = splitters.token_based(text, 20, 1)
    assert got[0].split() == [f"word{i}" for i in range(10)] and got[1].split()[:4] == [f"word{i}" for i in range(6, 10)]
    assert sum(len(c.split()) for c in splitters.token_based("a " * 5000, 50, 25)) == 5000


def test_tables_as_rows(spark):
    got = splitters.table_rows(frame(spark, [(1, "intro\na\tb\n1\t<2>\nend"), (2, None)], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["table"], r["cells"]) for r in got] == [(1, 1, [["a", "b"], ["1", "<2>"]])]
    assert got[0]["html"] == "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>&lt;2&gt;</td></tr></table>"


def test_trend_takes_half_for_a_missing_score(spark):
    rows = [("a", 1, None), ("a", 2, 0.0), ("a", 3, 0.9), ("a", 4, 0.9), ("b", 1, 0.9), ("c", 1, 0.9), ("c", 2, 0.1), ("c", 3, 0.1)]
    df = frame(spark, [(b, i, s) for b, i, s in rows], "brand string, mention_id int, score double").withColumn("ts", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, mention_id * 10)"))
    got = {r["brand"]: (r["n"], None if r["change"] is None else round(r["change"], 9), r["trend"]) for r in brands.trend(df).collect()}
    assert got == {"a": (4, 0.4, "increasing"), "b": (1, None, "stable"), "c": (3, -0.8, "decreasing")}


def test_merged_properties_come_in_order(spark):
    nodes = frame(spark, [(1, {"a": "1"}), (2, {"a": "2", "b": "2"}), (3, {"a": "3"})], "id long, properties map<string,string>")
    edges = frame(spark, [(2, 9, "x"), (3, 9, "x"), (2, 1, "x")], "src long, dst long, edge_type string")
    kept, again, log = entities.merged(nodes, edges, frame(spark, [(2, 1), (3, 1)], "source long, target long"))
    assert [(r["id"], r["properties"]) for r in kept.collect()] == [(1, {"a": "3", "b": "2"})]
    assert [(r["src"], r["dst"]) for r in again.collect()] == [(1, 9)] and log.count() == 2


def test_long_chains_and_cycles(spark):
    n = 70
    chain_ = frame(spark, [(i, i - 1 if i else None) for i in range(n)], "segment_id long, parent_id long")
    assert mutations.descendants(chain_, 0).agg(F.max("depth")).first()[0] == n - 1
    ring = frame(spark, [(0, 2), (1, 0), (2, 1)], "segment_id long, parent_id long")
    assert mutations.descendants(ring, 0).count() == 3


def test_upserts_by_strategy(spark):
    there = frame(spark, [("h1", "Old", "x"), ("h2", "Other", "y")], "hash string, title string, content string")
    items = frame(spark, [(1, " old ", "X"), (2, None, "z"), (3, "New", "n"), (4, "new", "n"), (5, "third", None)], "n int, title string, content string")
    table, report = mutations.upsert_by_strategy(there, items, "TITLE_CONTENT", order="n")
    assert {r["n"]: r["status"] for r in report.collect()} == {1: "updated", 2: "failed", 3: "created", 4: "updated", 5: "created"}
    assert sorted((r["title"], r["content"]) for r in table.collect() if r["content"]) == [(" old ", "X"), ("Other", "y"), ("new", "n")] and table.count() == 4
    table, report = mutations.upsert_by_strategy(there, items, "TITLE_CONTENT", order="n", update=False)
    assert {r["n"]: r["status"] for r in report.collect()} == {1: "skipped", 2: "failed", 3: "created", 4: "skipped", 5: "created"}
    assert "New" in {r["title"] for r in table.collect()}


def test_nodes_are_identified(spark):
    old = frame(spark, [("a", 1, "brand", "Nike", {"x": "1"})], "node_id string, dataset_id int, node_type string, label string, properties map<string,string>")
    new = frame(spark, [(1, "brand", " nike", {"x": "2", "y": "1"}, 1), (1, "brand", "Puma", {"z": "1"}, 2), (1, "brand", "puma ", {"z": "2"}, 3)], "dataset_id int, node_type string, label string, properties map<string,string>, n int")
    got = {r["label"]: r["properties"] for r in dedup.identified(old, new).collect()}
    assert got == {"Nike": {"x": "2", "y": "1"}, "Puma": {"z": "2"}}


def test_entities_are_imported(spark):
    e = frame(spark, [("e1", "A", "t", 0.4)], "entity_id string, name string, type string, confidence double")
    new = frame(spark, [("e1", "B", "t", 1), (None, "A", "t", 2), (None, "C", "t", 3), (None, "C", "t", 4), (None, "", "t", 5)], "entity_id string, name string, type string, n int")
    out, report = entities.imported(e, new)
    assert {r["n"]: r["status"] for r in report.collect()} == {1: "skipped", 2: "skipped", 3: "created", 4: "skipped", 5: "failed"}
    assert sorted((r["name"], r["confidence"]) for r in out.collect()) == [("A", 0.4), ("C", 0.8)]
    out, report = entities.imported(e, new.where("n = 1"), update=True)
    assert [(r["entity_id"], r["name"]) for r in out.collect()] == [("e1", "B")] and report.first()["status"] == "created"


def test_normalised_in_one_call(spark):
    nodes = frame(spark, [(1, "Company One", "b", 0.5), (2, "Company Onne", "b", 0.9), (3, "Else", "b", 0.1), (4, "Company One", "c", 0.1)], "id long, label string, type string, confidence double")
    edges = frame(spark, [(1, 3, "x"), (2, 3, "x")], "src long, dst long, edge_type string")
    kept, again, log = entities.normalised(nodes, edges, 0.8)
    assert {r["id"] for r in kept.collect()} == {2, 3, 4} and [(r["src"], r["dst"]) for r in again.collect()] == [(2, 3)] and log.count() == 1
    assert {r["id"] for r in entities.normalised(nodes, edges, 0.8, only="c")[0].collect()} == {1, 2, 3, 4}


def test_paths_policies_and_hashes(spark):
    df = frame(spark, [(1, '{"status": "done", "data": {"classification": "x", "confidence": 0.5}}', "waiting")], "id int, reply string, status string")
    r = records.with_policy(df, "reply").first()
    assert r["status"] == "done" and r["meta"]["classification"] == "x" and r["meta"]["confidence"] == "0.5"
    r = records.with_paths(df, {"a.b.c": F.lit(1), "a.b.d": F.lit(2), "a.e": F.lit(3), "id": F.lit(9)}).first()
    assert r["a"].asDict(True) == {"b": {"c": 1, "d": 2}, "e": 3} and r["id"] == 9
    assert records.deep_merged({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "c": [1]}) == {"a": {"x": 1, "y": 3}, "b": 1, "c": [1]}

    def by_hand(s):
        h = 0
        for k in range(0, len(raw := s.encode("utf-16-le")), 2):
            h = (h * 31 + int.from_bytes(raw[k : k + 2], "little") + 2**31) % 2**32 - 2**31
        digits, x = "", abs(h)
        while x:
            digits, x = "0123456789abcdefghijklmnopqrstuvwxyz"[x % 36] + digits, x // 36
        return ("-" if h < 0 else "") + (digits or "0")

    texts = ["", "a", "hello world", "é漢字", "x😀y", "q" * 300]
    got = [r["h"] for r in frame(spark, [(t,) for t in texts], "t string").select(text.string_hash32(F.col("t")).alias("h")).collect()]
    assert got == [by_hand(t) for t in texts]
    shown = frame(spark, [("Nike and NIKE shoes, nikes", [("nike", "Nike$", 0.5), ("nike and", "N&A", 0.9)])], "t string, m array<struct<found:string,canonical:string,score:double>>").select(text.highlighted(F.col("t"), F.col("m")).alias("s")).first()["s"]
    assert shown == "[N&A] [Nike$] shoes, nikes"


def test_retrieval_routes(spark):
    s_ = frame(spark, [(1, 10, [1.0, 0.0]), (2, 10, [0.0, 1.0]), (3, 20, [0.9, 0.1]), (4, 20, None)], "segment_id int, document_id int, embedding array<double>")
    ids = lambda df: [r["segment_id"] for r in df.collect()]
    assert ids(retrieval.retrieved(s_, [1.0, 0.0], 2)) == [1, 3] and ids(retrieval.retrieved(s_, [1.0, 0.0], 2, document_ids=[20])) == [3]
    got = retrieval.retrieved(s_, [1.0, 0.0], 5, segment_ids=[2, 4]).collect()
    assert [(r["segment_id"], r["similarity"]) for r in got] == [(4, 0.5), (2, 0.0)]
    both = frame(spark, [(1, 2.0, 0.5), (2, 1.0, 0.9)], "id int, keyword_score double, semantic_score double")
    plain = [(r["id"], r["final_score"]) for r in retrieval.fused(both, "id").collect()]
    assert [(r["id"], r["final_score"]) for r in retrieval.reranked(both, "id", scorer=lambda df: F.col("no_such_column")).collect()] == plain
    assert retrieval.reranked(both, "id", scorer=lambda df: F.lit(0.2)).first()["final_score"] < retrieval.reranked(both, "id", scorer=lambda df: F.lit(0.9)).first()["final_score"]


def test_each_node_of_a_workflow_runs_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    df = frame(spark, [(i, f"text {i}") for i in range(6)], "position int, content string").mapInArrow(counted, "position int, content string")
    out = chain(("trigger_schedule", {"cron": "* * * * *", "timezone": "Europe/Paris"}), ("duplicate_segment", {})).run({"s0": df})
    assert [r["status"] for r in out] == ["completed", "completed"] and [r["rows"] for r in out] == [6, 6] and made.value == 6
    assert Workflow([Node("a", "trigger_schedule", {"cron": "* * * * *", "timezone": "Mars/Base"})]).problems()
    old = frame(spark, [("h", "old")], "hash string, title string")
    new = frame(spark, [(1, "new"), (2, " ")], "position int, title string")
    up = chain(("post_upserter", {"table": old, "hash_fields": ["title"]})).result({"s0": new})
    assert sorted(r["title"] for r in up.collect()) == ["new", "old"]
    gone = chain(("post_deleter", {"table": old, "path": "hash", "key": "hash"})).result({"s0": old})
    assert gone.count() == 0 and Workflow([Node("a", "post_deleter")]).problems()


def test_mock_before_and_pages(spark):
    df = frame(spark, [("z",)], "content string")
    got = tables.with_mock(df, 2).collect()
    assert [r["content"] for r in got] == ["Mock content 1", "Mock content 2", "z"]
    some, total = tables.post_source(spark.range(250).toDF("id"), F.col("id") >= 10, order=[F.col("id")], number=3)
    assert total == 240 and [r["id"] for r in some.collect()] == list(range(210, 250)) and predicates.page_count(spark.range(250).toDF("id"), 100) == 3
    jobs = frame(spark, [("failed", '{"documentId": "7"}'), ("active", '{"data": {"documentId": "7"}}'), ("gone", '{"documentId": "7"}'), ("active", "{}")], "state string, payload string")
    assert tables.jobs_of(jobs, 7).count() == 2


def test_inserts_are_checked(spark):
    segments = frame(spark, [(1, 5, "a", 1, "done")], "segment_id int, document_id int, content string, position long, status string")
    new = frame(spark, [(2, "b", 1)], "segment_id int, content string, n int")
    sets, docs = frame(spark, [(1, 9)], "dataset_id int, user_id int"), frame(spark, [(5, 1)], "document_id int, dataset_id int")
    got = mutations.inserted(segments, new, sets, docs, dataset_id=1, document_id=5, user_id=9)
    assert [(r["position"], r["status"]) for r in got.orderBy("position").collect()] == [(1, "done"), (2, "waiting")]
    for bad, error in (({"user_id": 8}, PermissionError), ({"dataset_id": 2}, ValueError), ({"document_id": 6}, ValueError)):
        with pytest.raises(error):
            mutations.inserted(segments, new, sets, docs, **{"dataset_id": 1, "document_id": 5, "user_id": 9, **bad})


def test_keywords_are_counted_where_texts_are_read(spark, tmp_path):
    """No shuffle by document, whole ties and order; rows that share an id are counted together."""
    from textquarry.functions import text as texts

    rows = [(k, " ".join(random.Random(k).choices(["alpha", "beta", "gamma", "delta", "the", "x1", "of"], k=k % 40))) for k in range(700)] + [(1000, None), (1001, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = texts.keywords(docs, 2)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()

    def want(by):
        for k, t in by.items():
            listed = [w for w in t.split() if w.isalpha() and w not in ("the", "of")]
            for r, w in enumerate(sorted(set(listed), key=lambda w: (-listed.count(w), listed.index(w)))[:2]):
                yield k, r + 1, w, listed.count(w)

    assert {tuple(r) for r in got.collect()} == set(want({k: t or "" for k, t in rows}))
    twice = docs.where("doc_id < 50").union(spark.createDataFrame([(7, "omega omega omega omega omega omega omega omega"), (None, "beta beta"), (None, "gamma beta")], "doc_id long, text string"))
    both = {tuple(r) for r in texts.keywords(twice, 1).collect()}
    assert (7, 1, "omega", 8) in both and (None, 1, "beta", 3) in both and len([r for r in both if r[0] == 7]) == 1


def test_chunks_of_two_levels_leave_in_small_batches():
    """A batch of 200 texts is not held with all its chunks."""
    import pyarrow as pa

    from textquarry.functions import splitters

    class Docs:
        schema = {"doc_id": type("Field", (), {"dataType": type("Kind", (), {"simpleString": staticmethod(lambda: "bigint")})})}

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    run = splitters.split_hierarchy(Docs(), 20, 5)
    out = list(run(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": ["one two three four five six seven"] * 200})])))
    assert len(out) > 1 and [k for b in out for k in dict.fromkeys(b.column(0).to_pylist())] == list(range(200))


def test_names_are_matched_where_texts_are_read(spark, monkeypatch):
    """No text or word is shuffled for a small dictionary; the join for large ones finds the same."""
    rng = random.Random(5)
    letters = ["abc", "abd", "xyz", "xyzz", "hello", "hallo", "world", "no"]
    docs = spark.createDataFrame([(k, None if k == 3 else " ".join(rng.choices(letters, k=k % 25))) for k in range(150)], "doc_id long, text string")
    ent = spark.createDataFrame([(1, "abc xyz"), (2, "hello world"), (3, "hallo"), (4, "abc abc abc xyz"), (5, "no")], "entity_id long, name string")
    near = entities.dictionary_matches(docs, ent)
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, near.collect()))
    monkeypatch.setattr(entities, "NEAR", 0)
    assert got and sorted(map(tuple, entities.dictionary_matches(docs, ent).collect())) == got


def test_stems_are_made_where_texts_are_read(spark):
    """Without shared keys nothing is shuffled; rows that share a key are counted together, as before."""
    texts = ["running runs ran running cats", None, "", "dogs dog running jumps", "the of and", "connection connected connections"]
    tokens = lambda s: [w for w in re.findall(r"[a-z]+", s or "") if len(w) > 2 and w not in text.STOP_WORDS]
    top = lambda ws: sorted(dict.fromkeys(ws), key=lambda w: (-ws.count(w), ws.index(w)))[:10]
    want = lambda ts: list(dict.fromkeys([*ts, *map(text.stem, ts)]))[:8]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = text.stemmed_keywords(df)
    assert {r["doc_id"]: r["keywords"] for r in out.collect()} == {k: want(top(tokens(s))) for k, s in enumerate(texts) if tokens(s)}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    both = spark.createDataFrame([(1, "cats cats dogs"), (2, "running"), (1, "cats birds"), (None, "mice")], "doc_id int, text string")
    assert {r["doc_id"]: r["keywords"] for r in text.stemmed_keywords(both).collect()} == {2: want(["running"]), None: want(["mice"]), 1: want(["cats", "birds", "dogs"])}

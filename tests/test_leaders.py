"""Greedy leaders: one task, components, rounds; and classes of copies."""

import random

import pytest
from pyspark.sql import functions as F

from textquarry.operators import dedup, entities


def greedy(keys, links):
    before = {}
    for i, j in links:
        before.setdefault(j, []).append(i)
    kept = {}
    for k in sorted(keys):
        kept[k] = not any(kept[i] for i in before.get(k, ()))
    return kept


@pytest.fixture
def writes(monkeypatch):
    """Counts the tables that are written."""
    from textquarry.operators import graph

    done, cut = [], dedup.cut

    def counted(df):
        done.append(1)
        return cut(df)

    monkeypatch.setattr(dedup, "cut", counted)
    monkeypatch.setattr(graph, "_cut", counted)
    return done


def test_a_long_chain_takes_few_writes(spark, writes):
    n = 10_000
    df = spark.range(n).select(F.col("id").alias("k"))
    pairs = df.where(f"k < {n - 1}").select(F.col("k").alias("i"), (F.col("k") + 1).alias("j"), F.lit(0.9).alias("similarity"))
    got = {r["k"]: r["kept"] for r in dedup.leaders(df, "k", pairs).collect()}
    assert got == {k: k % 2 == 0 for k in range(n)} and len(writes) <= 5


@pytest.mark.parametrize("most", [1_000_000, 40, 6])
def test_all_paths_give_the_sequential_scan(spark, monkeypatch, most):
    """One task; components over several tasks; and rounds for the large ones."""
    monkeypatch.setattr(dedup, "ONE_SCAN", most)
    rng = random.Random(9)
    links = {(i, i + 1) for i in range(60)} | {tuple(sorted(rng.sample(range(100, 160), 2))) for _ in range(90)}
    links |= {(200 + 3 * k, 201 + 3 * k) for k in range(30)} | {(200 + 3 * k, 202 + 3 * k) for k in range(30)}
    keys = range(310)
    pairs = spark.createDataFrame(sorted(links), "i long, j long")
    got = {r["k"]: r["kept"] for r in dedup.leaders(spark.createDataFrame([(k,) for k in keys], "k long"), "k", pairs).collect()}
    assert got == greedy(keys, links)


def test_keys_of_text_and_structs(spark):
    keys = [("b", 2), ("Z", 9), ("é", 1), ("a", 3), ("a", 1), ("", 5)]
    order = sorted(keys, key=lambda k: (k[0].encode(), k[1]))
    links = [(order[0], order[1]), (order[1], order[2]), (order[1], order[4]), (order[2], order[5])]
    df = spark.createDataFrame([(k,) for k in keys], "k struct<label:string,id:int>")
    pairs = spark.createDataFrame(links, "i struct<label:string,id:int>, j struct<label:string,id:int>")
    got = {tuple(r["k"]): r["kept"] for r in dedup.leaders(df, "k", pairs).collect()}
    place = {k: n for n, k in enumerate(order)}
    want = greedy(range(6), [(place[a], place[b]) for a, b in links])
    assert got == {k: want[place[k]] for k in keys}
    assert dedup.leaders(df, "k", pairs.limit(0)).where("NOT kept").count() == 0


def words_of(text):
    return frozenset((text or "").lower().split())


def test_copies_are_classes_before_any_pair(spark):
    """3000 copies would make 4.5 million pairs; the classes' links stay few, and the result is the scan's."""
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(80)]
    texts = [" ".join(rng.sample(vocabulary, 12)) for _ in range(40)]
    texts += [" ".join([*t.split()[:-1], "other"]) for t in texts[:20]]
    texts = [*texts, *[texts[3]] * 1500, *[texts[45]] * 1500, "", " ", None, "A a  A"]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "p int, c string").withColumn("rep", F.lit(1)).withColumn("k", F.lit(2))
    sets = [words_of(t) for t in texts]
    kept, want = [], {}
    first = True
    for k, s in enumerate(sets):
        same = [x for x in kept if (len(x & s) / len(x | s) if x | s else 1) >= 0.8] if s else []
        want[k] = bool(same) if s else not first
        if not want[k] and s:
            kept.append(s)
        first = False
    got = {r["p"]: r["is_duplicate"] for r in dedup.similarity_duplicates(df, "c", "p", 0.8).collect()}
    assert got == want
    rows = df.select("p", dedup.word_set(dedup.normalised(F.col("c"))).alias("w"))
    member, links = dedup.similar_classes(rows, "p", "w", 0.8)
    assert links.count() < 100 and member.count() == sum(bool(s) for s in sets)


def test_few_buckets_lose_no_pair(spark, monkeypatch):
    """Words that share a bucket are ordered otherwise, with the same pairs."""
    monkeypatch.setattr(dedup, "BUCKETS", 4)
    rng = random.Random(6)
    sets = [rng.sample([f"w{k}" for k in range(25)], rng.randint(1, 9)) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(sets)), "k int, w array<string>")
    for t in (0.5, 0.75, 1.0):
        want = {(i, j) for i in range(120) for j in range(i + 1, 120) if len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= t}
        assert {(r["i"], r["j"]) for r in dedup.similar_pairs(df, "k", "w", t).collect()} == want


@pytest.fixture
def asked(monkeypatch):
    """Counts the pairs whose sets are compared, and the sets sent for them."""
    compared, sent, run = [], [], dedup._verified

    def counted(near, sets, threshold):
        compared.append(near.count())
        return run(near, sets, threshold)

    def ends(df):
        out = cut(df)
        if out.columns == ["cell", "k"]:
            sent.append(out.count())
        return out

    cut = dedup.cut
    monkeypatch.setattr(dedup, "_verified", counted)
    monkeypatch.setattr(dedup, "cut", ends)
    return compared, sent


@pytest.mark.parametrize("most", [250_000, 100])
def test_sets_are_sent_once_a_cell_and_for_likely_pairs_alone(spark, monkeypatch, asked, most):
    """A group of 120 near copies among texts that share some rare words: all its pairs, few others compared, few sets sent."""
    monkeypatch.setattr(dedup, "CELL_PAIRS", most)
    rng = random.Random(4)
    base = [f"b{k}" for k in range(60)]
    sets = [[w for w in base if w != f"b{k % 60}"] + [f"x{k}"] for k in range(120)]
    sets += [rng.sample([f"v{k}" for k in range(900)], rng.randint(40, 60)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(sets)), "k int, w array<string>")
    want = {(i, j) for i in range(320) for j in range(i + 1, 320) if len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= 0.8}
    links = dedup.similar_classes(df, "k", "w", 0.8)[1].collect()
    assert {(r["a"], r["b"]) for r in links} == want and len(want) == 120 * 119 // 2
    assert all(r["similarity"] == len(set(sets[r["a"]]) & set(sets[r["b"]])) / len(set(sets[r["a"]]) | set(sets[r["b"]])) for r in links)
    compared, sent = asked
    assert compared[0] <= len(want) + 100
    # a pair alone would send two: over 14 000
    assert sent[0] <= (300 if most > 100 else 120 * 20)


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.5, 0.65, 0.8, 0.9, 1.0])
def test_sizes_of_all_ratios_lose_no_pair(spark, threshold):
    """Near copies of sets of 1 to 40 words, cut, grown and replaced by every amount."""
    rng = random.Random(8)
    sets = []
    for n in (1, 2, 3, 5, 9, 20, 40):
        base = rng.sample([f"w{k}" for k in range(120)], n)
        sets += [base[: n - k] for k in range(0, n, max(1, n // 6))] + [base + rng.sample([f"y{m}" for m in range(40)], k) for k in range(0, n, max(1, n // 6))] + [base[k:] + [f"z{m}" for m in range(k)] for k in range(0, n, max(1, n // 8))]
    df = spark.createDataFrame(list(enumerate(sets)), "k int, w array<string>")
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= threshold}
    assert {(r["i"], r["j"]) for r in dedup.similar_pairs(df, "k", "w", threshold).collect()} == want


def test_short_labels_and_copies(spark):
    labels = ["a", "ab", "b", "abc", "a", None, "abcd", "abce", "abcd", ""]
    nodes = spark.createDataFrame([(k, s, "t" if k % 3 else None) for k, s in enumerate(labels)], "id int, label string, type string")
    pairs = {(r["i"], r["j"]) for r in entities.label_pairs(nodes, 0.5, kind=None).collect()}
    assert {(0, 1), (1, 2), (1, 3), (0, 4), (1, 4), (3, 6), (6, 8), (7, 8)} <= pairs and (0, 2) not in pairs
    groups = {r["id"]: r["leader"] for r in entities.duplicate_groups(nodes, 0.75, kind=None).collect()}
    assert groups == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: 5, 6: 3, 7: 3, 8: 3, 9: 9}
    # ids divisible by 3 have no type and resemble nothing
    typed = {r["id"]: r["leader"] for r in entities.duplicate_groups(nodes, 0.75).collect()}
    assert typed == {k: k for k in range(10)} | {7: 8}


def test_labels_are_compared_once_however_many_nodes_have_them(spark):
    """40 labels on 4000 nodes: links between labels stay few, and pairs, aliases and actions are those of the nodes."""
    rng = random.Random(3)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 6))) for _ in range(40)]
    nodes = spark.range(4000).select("id", F.element_at(F.lit(names), (F.col("id") % 40 + 1).cast("int")).alias("label"), (F.col("id") % 2).cast("string").alias("type"))
    links = entities.label_links(nodes, 0.6)
    assert links.count() < 40 * 40
    found = {(r["type"], r["a"], r["b"]): r["similarity"] for r in links.collect()}
    of = {}
    for k in range(40):
        of.setdefault((str(k % 2), names[k]), []).append(k)
    few = nodes.where("id < 40")
    want = {(i, j) for t, a in of for u, b in of if t == u and (a == b or (t, min(a, b), max(a, b)) in found) for i in of[t, a] for j in of[u, b] if i < j}
    assert {(r["i"], r["j"]) for r in entities.label_pairs(few, 0.6).collect()} == want and want
    ent = nodes.where("id < 2000").select(F.col("id").alias("entity_id"), F.col("label").alias("name"), "type")
    known = spark.createDataFrame([], "entity_id long, alias string")
    got = entities.alias_candidates(ent, nodes.where("id >= 2000"), known, 0.6)
    assert {(r["entity_id"], r["alias"], r["similarity"]) for r in got.collect()} == {(e, x, s) for (t, a, b), s in found.items() for y, x in ((a, b), (b, a)) for k in of[t, y] for e in range(k, 2000, 40)}


def test_texts_are_read_once_and_not_shuffled(spark):
    """The scan's result joins the rows by key; neither words nor, where it is not asked for, the text goes with it."""
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["", "a b c", "c b a", None, "d e"])], "p int, c string")
    out = dedup.similarity_duplicates(df, "c", "p", 0.8)
    assert {r["p"]: r["is_duplicate"] for r in out.collect()} == {0: False, 1: False, 2: True, 3: True, 4: False}
    plan = out.select("p", "is_duplicate")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "regexp_replace" not in plan

"""The pipeline's stages, each on its own input, and the contract of its module."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from textquarry.llm import minhash, mixing, pieces, pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    clean = [" ".join(f"w{(i * 37 + k * k) % 997}" for k in range(60)) for i in range(80)]
    texts = [*clean, clean[0], clean[1] + " more", *(f"{c} zgrob" for c in clean[2:22]), "mail a@b.org now please", None, ""]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(82 <= i < 102)) for i in range(104)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "sentencepiece"]
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["toxicity"](spark, docs, tables)
    assert kept.columns == COLUMNS
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == set(range(105)) - set(range(82, 102))
    single = steps["near_dedup"](spark, kept, tables)
    want = {r["doc_id"] for r in minhash.near_duplicates(kept).where("kept").collect()}
    assert single.columns == COLUMNS and {r["doc_id"] for r in single.collect()} == want and not {80, 81} & want
    private = steps["pii"](spark, single, tables)
    text = {r["doc_id"]: r["text"] for r in private.collect()}
    assert private.columns == COLUMNS and text[102] == "mail [EMAIL] now please"
    weights = pii.trained()
    assert all(t == pii.redact(o["text"], pii.find_spans(o["text"], weights)[1]) for o in single.collect() for t in [text[o["doc_id"]]])
    mixed = steps["mixing"](spark, private, tables)
    assert mixed.columns == COLUMNS
    total = sum(len((t or "").split()) for t in text.values())
    taken = sum(len((r["text"] or "").split()) for r in mixed.collect())
    assert abs(taken - 1.5 * total) <= 3 * 61
    last = steps["sentencepiece"](spark, mixed, tables)
    v = pieces.load(pieces.default_path())
    assert last.where("NOT round_trip").count() == 0
    assert {pieces.decode(v, r["piece_ids"]) for r in last.collect()} <= set(text.values())


def test_copies_without_an_id_of_their_own_go(spark, tables):
    a, b, c, d = (" ".join(f"{x}{k * k % 211}" for k in range(60)) for x in "abcd")
    rows = [(None, a), (None, a), (7, b), (7, b), (9, c), (3, c + " more"), (3, d), (None, d), (None, ""), (None, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s0", None if t is None else len(t)) for i, t in rows], spark.read.parquet(f"{tables}/documents.parquet").schema)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, tables)
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert out.columns == COLUMNS
    assert got == sorted([(None, a), (7, b), (3, c + " more"), (3, d), (None, ""), (None, ""), (5, None)], key=str)


def test_rows_of_one_id_are_mixed_one_by_one(spark, tables):
    rows = [(None if i % 2 else i % 6, f"word {'more ' * (i % 4)}{i}", "en", f"s{i % 3}", 9) for i in range(120)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{tables}/documents.parquet").schema)
    labels = spark.read.parquet(f"{tables}/labels.parquet").select("doc_id", "quality")
    want = {r["source"]: r["n"] for r in mixing.mix_sources(docs, labels).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    out = corpus_pipeline.mix_to_targets(spark, docs, tables)
    got = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert out.columns == COLUMNS and got == {s: n for s, n in want.items() if n}


def test_run(spark, tables):
    assert corpus_pipeline.run(spark, tables).agg(F.count("*")).first()[0] > 0


CLASHING = ["toxicity", "times", "epoch", "row", "row_number", "number", "size", "taken", "key", "node", "component_id", "n_shingles", "kept", "turn", "a b", "score"]


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_inputs(spark, tables, stage):
    """Null and repeated ids, empty and very long texts, columns with the operators' own names; then no rows at all."""
    run = dict(corpus_pipeline.STAGES)[stage]
    schema = spark.read.parquet(f"{tables}/documents.parquet").schema
    long = " ".join(f"v{(k * k) % 7919}" for k in range(20_000))
    texts = [(1, long), (1, long), (None, long + " end"), (None, None), (None, "plain words for all of us here"), (4, ""), (4, " \n "), (5, "one"), (6, "call +1 (555) 555-0100 now")]
    docs = spark.createDataFrame([(i, t, None if k % 2 else "en", None if k % 3 else "s0", None) for k, (i, t) in enumerate(texts)], schema)
    for k, c in enumerate(CLASHING):
        docs = docs.withColumn(c, F.lit(float(k)))
    out = run(spark, docs, tables)
    rows = out.collect()
    if stage == "sentencepiece":
        assert len(rows) == len(texts) and set(out.columns) == {*docs.columns, "piece_ids", "n_pieces", "round_trip"} - {"text"}
        assert all(r["round_trip"] for r in rows) and sum(r["n_pieces"] > 20_000 for r in rows) == 3
    else:
        assert out.columns == docs.columns
    assert all(r[c] == float(k) for r in rows for k, c in enumerate(CLASHING))
    if stage in ("toxicity", "pii"):
        assert len(rows) == len(texts)
    if stage == "near_dedup":
        assert sorted(str(r["text"])[:9] for r in rows) == sorted(str(t)[:9] for t in (long, None, texts[4][1], "", " \n ", "one", texts[8][1]))
    assert run(spark, docs.limit(0), tables).count() == 0

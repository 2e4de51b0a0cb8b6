"""The corpus pipeline: toxicity, near duplicates, personal data, source mix, token pieces.

Each stage takes (spark, docs, sf_dir), with ``docs`` as its predecessor left them,
and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.minhash import near_duplicates
from textquarry.llm.mixing import mix_sources
from textquarry.llm.pieces import encode_documents
from textquarry.llm.pii import redacted
from textquarry.llm.shared import named, semi, settle, table, unused
from textquarry.llm.toxicity import learn, score_documents

#: A document goes if its toxicity reaches this.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC by the grammar learnt from the labelled ones among them.

    Null, empty and white-space texts match nothing and stay; texts of any length are read
    whole. Equal texts (ties, repeated rows) have equal scores and go or stay together. A null
    doc_id has no label and is scored like any other. All columns stay as they are,
    whatever their names. Empty input: no rows.
    """
    grammar = learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    score = unused("toxicity", docs)
    return score_documents(docs, grammar, score).where(F.col(score) < TOXIC).select(*named(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near duplicates; a null id counts as the largest.

    Of rows that tie (one id, or null ids), one stays. Null, empty and white-space texts are
    linked with nothing and all stay, repeated or not; texts of any length are compared whole.
    All columns stay as they are, whatever their names. Empty input: no rows.
    """
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("rows_of_id")).where("rows_of_id > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        gone = settle(near_duplicates(docs).where(~F.col("kept")).select("doc_id"), "pipeline-duplicates")
        return semi(docs, gone, "doc_id", "left_anti").select(*named(docs))
    # ids that do not tell rows apart: each row is compared under a number of its own
    number = unused("row_number", docs)
    rows = settle(docs.withColumn(number, F.monotonically_increasing_id()), "pipeline-rows")
    found = settle(near_duplicates(rows.select(F.col(number).alias("doc_id"), "text")).select(F.col("doc_id").alias("number"), "component_id"), "pipeline-groups")
    ids = rows.select(F.col(number).alias("number"), F.col("doc_id").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "number")).alias("first")
    stay = found.join(ids, "number").groupBy("component_id").agg(first).select(F.col("first.number").alias("number"))
    gone = settle(found.select("number").join(stay, "number", "left_anti").withColumnRenamed("number", number), "pipeline-duplicates")
    return semi(rows, gone, number, "left_anti").select(*named(docs))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars, where there is one, follows the new text.

    Null text stays null (n_chars null), empty text empty; texts of any length are read whole.
    Each row is its own, so ids may be null or repeated; overlapping spans become one.
    All other columns stay as they are, whatever their names. Empty input: no rows.
    """
    return redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*named(docs))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes that row.

    Null, empty and white-space texts have size 0 and are not taken; size counts the
    words of the whole text. A null source is a source of its own. Null ids share one key;
    rows that tie are taken one by one. All columns stay as they are, whatever their
    names. Empty input: no rows.
    """
    mixed = mix_sources(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), whole=True)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0)).cast("int")
    out = mixed.select("row", times.alias("times")).where("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("turn")).select("row.*")


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but text, with piece_ids, n_pieces and round_trip (whether the ids decode to the text).

    Null text: null ids, 0 pieces; empty text: no pieces; texts of any length are encoded whole.
    Each row is its own, so ids may be null or repeated. Columns with those three names
    are replaced, the others stay. Empty input: no rows.
    """
    return encode_documents(docs).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_to_targets),
    ("sentencepiece", to_pieces),
]

#: A learnt grammar, hashed candidates and piece lattices are not for SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, f"pipeline-{name}")
    return docs

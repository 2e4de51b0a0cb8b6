"""Canonical exact digest of documents, in SQL expressions only.

A text is brought to Unicode form KC, case-folded, normalised again, and runs of
white space become one space, none at the ends. The canonical form is hashed to
128 bits by two xxhash64 of differing input. Documents with equal digests are
grouped, and inside a bucket the canonical bytes themselves are grouped, so that a
collision can neither merge two texts nor part two equal ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import held, settle

#: Documents a window of neighbours holds, on average, and most windows.
RUN_ROWS, MOST_RUNS = 2048, 1 << 16

_COMPOSE = "reflect('com.ibm.icu.text.Normalizer', 'compose', {}, true)"
_FOLD = "reflect('com.ibm.icu.lang.UCharacter', 'foldCase', {}, true)"


def canonical(text: str) -> Column:
    """The canonical form of the string column named ``text``; null counts as empty."""
    some = f"coalesce({text}, '')"
    once = _COMPOSE.format(_FOLD.format(_COMPOSE.format(some)))
    # plain ASCII has only its case and white space to fold
    folded = f"CASE WHEN {some} RLIKE '[^\\\\x00-\\\\x7F]' THEN {once} ELSE lower({some}) END"
    return F.expr(f"trim(regexp_replace({folded}, '[\\\\s\\\\x{{85}}\\\\p{{Z}}]+', ' '))")


def digest(form: Column) -> Column:
    """128 bits in hex of a canonical form."""
    return F.concat(*[F.lpad(F.lower(F.hex(x)), 16, "0") for x in (F.xxhash64(form), F.xxhash64(F.lit(0x5BD1E995), form, F.length(form)))])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""
    return docs.select("doc_id", digest(canonical("text")).alias("fingerprint"))


def exact_groups(docs: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """doc_id, fingerprint -> group_id for the documents whose canonical form another one has.

    group_id is the smallest doc_id among those with equal canonical bytes; documents of one
    bucket with other bytes (a collision) make groups of their own. Null doc_ids
    take no part. Rows that share a doc_id stay single rows of the result. ``prints``: the
    settled fingerprints of ``docs``, if they are known already.
    """
    if prints is None:
        prints = settle(fingerprints(docs), "fingerprints")
    prints = prints.select("doc_id", "fingerprint").where("doc_id IS NOT NULL")
    buckets = prints.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    members = settle(prints.join(buckets, "fingerprint").select("doc_id").distinct(), "fingerprint-members")
    # only texts of shared buckets move
    known = docs.select("doc_id", "text").join(held(members), "doc_id").select("doc_id", canonical("text").cast("binary").alias("form"))
    known = known.withColumn("fingerprint", digest(F.col("form").cast("string")))
    # equal bytes meet by partial aggregation, so a bucket of very many copies is no hot spot
    least = known.groupBy("fingerprint", "form").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return known.join(least, ["fingerprint", "form"]).groupBy("doc_id", "fingerprint").agg(F.min("group_id").alias("group_id"))


def _run_of(key: Column, bounds: list[int]) -> Column:
    """Which run a key lies in: the number of bounds up to it, by bisection."""
    if not bounds:
        return F.lit(0)
    n, steps = len(bounds), []
    step = 1 << (n.bit_length() - 1)
    while step:
        steps.append(step)
        step >>= 1
    edges = F.lit(bounds)
    take = lambda acc, s: F.when((acc + s <= n) & (F.get(edges, F.least(acc + s, F.lit(n)) - 1) <= key), acc + s).otherwise(acc)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), take)


def with_next(docs: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Each row's doc_id, text and fingerprint with next_text and next_fingerprint, those of the next row in order of doc_id (after the last: the first).

    Rows are dealt into runs of neighbouring ids by quantiles of all ids; a window
    orders each run, and the last row of a run gets the first text of the next run.
    Null doc_ids come first. Rows with one doc_id go by text.
    """
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("place", F.coalesce("doc_id", lowest))
    count = rows.count()
    runs = min(MOST_RUNS, count // run_rows + 1)
    bounds: list[int] = []
    if runs > 1:
        cuts = rows.agg(F.percentile_approx("place", [i / runs for i in range(1, runs)], 10_000).alias("cuts")).first()["cuts"]
        bounds = sorted({int(x) for x in cuts})
    run = lambda df: df.withColumn("run", _run_of(F.col("place"), bounds))
    # the fingerprint is found once, before the texts move
    placed = run(rows).withColumn("fingerprint", digest(canonical("text"))).withColumn("after", F.lit(0))
    # one row a run: its first place, then the first text there, which closes the run before it
    firsts = run(rows.select("place")).groupBy("run").agg(F.min("place").alias("place"))
    order = [r["run"] for r in firsts.select("run").orderBy("run").collect()]
    pairs = docs.sparkSession.createDataFrame(list(zip(order[1:] + order[:1], order, strict=True)), "run int, before int")  # at most MOST_RUNS rows of two numbers
    heads = rows.select("place", "text").join(F.broadcast(firsts), "place").groupBy("run").agg(F.min("text").alias("text"))
    none = F.lit(None).cast(docs.schema["doc_id"].dataType)
    heads = heads.join(F.broadcast(pairs), "run").select(none.alias("doc_id"), "text", F.lit(None).cast("long").alias("place"), F.col("before").alias("run"), digest(canonical("text")).alias("fingerprint"), F.lit(1).alias("after"))
    # heads come by a union, not by a join on run: from such a join the optimizer infers the expression of run for the other side, which has no place
    in_run = Window.partitionBy("run").orderBy("after", "place", "text")
    closed = placed.unionByName(heads).withColumn("next_text", F.lead("text").over(in_run)).withColumn("next_fingerprint", F.lead("fingerprint").over(in_run))
    return closed.where("after = 0").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")


def fingerprint_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id.

    The likeness of two digests is 1 if they are equal, else 0: an exact digest knows nothing between.
    Null text counts as empty; texts of any length are read whole. group_id is null for a document
    without an equal. Null doc_ids come first in order and have no group; rows that share a
    doc_id go by text. Other columns are ignored. Empty input: no rows.
    """
    d = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    head = F.substring("next_text", F.lit(1), half)
    # as many code points of the next text as are replaced, or all of it if it is shorter
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), head))
    same = lambda x: F.when(F.col("fingerprint") == F.col(x), 1.0).otherwise(0.0)
    d = d.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", digest(canonical("edited")).alias("edited_fingerprint"), "next_fingerprint")
    d = d.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"))
    d = settle(d, "fingerprint-rows")
    return d.join(exact_groups(docs, d), ["doc_id", "fingerprint"], "left").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id")

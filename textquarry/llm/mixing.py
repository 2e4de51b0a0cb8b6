"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document has the key ``-ln(u) / w``: an exponential variable scaled by its
quality weight, with u drawn from a hash of its id. A source first gives as many
complete epochs as fit its target; what is left is filled with documents in
ascending key order up to the token budget.

Nothing gathers a source in one task: keys are dealt into bins, bins are summed
with partial aggregation, and only the one bin per source in which the budget runs
out is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Share of all sizes that the mix takes, and times of a source's size that it takes at most.
SHARE, MOST = 1.5, 2.0
#: Quality weights of documents labelled good, labelled bad, and without label.
GOOD, BAD, UNKNOWN = 1.0, 0.25, 0.5
#: Bins of keys in each source.
BINS = 4096


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u)/w with u in (0, 1) from 52 bits of an MD5 of the seed and the id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.ln(u) / weight


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> also weight and target.

    The level x solves sum(min(most * size, x * weight)) = share * total: sources
    in ascending order of cap / weight are full as long as the level that the rest
    would get lies above their own. One row per source is ordered here, no documents.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, after = by_cap.rowsBetween(Window.unboundedPreceding, 0), by_cap.rowsBetween(1, Window.unboundedFollowing)
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    # the level if this source and all before it are full
    s = s.withColumn("level", F.try_divide(F.col("budget") - F.sum("cap").over(upto), F.sum("weight").over(after)))
    # that level rises with each source that is rightly full and falls after; so the largest is the solution
    x0 = F.col("budget") / F.sum("weight").over(every)
    level = F.greatest(x0, F.coalesce(F.max("level").over(every), x0))
    target = F.least(F.col("cap"), level * F.col("weight"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17, bins: int = BINS, whole: bool = False) -> DataFrame:
    """doc_id, size, source, source_size, target, weight, epochs, taken for every row of ``docs``.

    ``docs`` has doc_id, text and source; ``quality`` has doc_id and quality (0, 1 or
    null; the largest of repeated ids counts).
    Null text: size 0, nothing to take. Null source: a source of its own, last in order.
    Null doc_id: one fixed key. Repeated rows: each counts and is taken on its own.
    Ties in the key go by doc_id, then size. Texts of any length are counted whole. Other columns are ignored.
    Empty input: no rows.
    With ``whole`` each row also has ``row``, a struct of all its columns in ``docs``.
    """
    also = ["row"] if whole else []
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *([F.struct(*docs.columns).alias("row")] if whole else []))
    if quality is None:
        rows = rows.withColumn("q", F.lit(UNKNOWN))
    else:
        q = quality.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        rows = rows.join(q, "doc_id", "left").withColumn("q", F.when(F.col("quality") == 1, GOOD).when(F.col("quality") == 0, BAD).otherwise(F.lit(UNKNOWN))).drop("quality")
    key = sampling_key(F.col("doc_id"), F.col("q"), seed)
    # exp(-key) is spread over (0, 1); small keys, the first to be taken, lie near 1
    cell = F.least(F.floor((1 - F.exp(-F.col("key"))) * bins), F.lit(bins - 1)).cast("int")
    rows = settle(rows.withColumn("key", key).withColumn("bin", cell).drop("q"), "mixing-rows")

    cells = settle(rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "mixing-bins")
    t = targets(cells.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, most)
    full = F.col("source_size").cast("double")
    t = t.withColumn("epochs", F.when(full > 0, F.floor(F.col("target") / full)).otherwise(F.lit(0)).cast("long"))
    t = settle(t.withColumn("rest", F.col("target") - F.col("epochs") * full), "mixing-targets")

    # the bin of each source in which the running size passes the rest; a source has at most `bins` bins
    run = F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin"))
    same = cells["source"].eqNullSafe(t["source"])
    edge = cells.withColumn("upto", run).join(t, same).where(F.col("upto") > F.col("rest")).groupBy(t["source"]).agg(F.min(F.struct("bin", "upto", "bin_size")).alias("e"))
    edge = edge.select(F.col("source").alias("edge_source"), F.col("e.bin").alias("edge_bin"), (F.col("e.upto") - F.col("e.bin_size")).alias("before"))
    t = t.join(edge, t["source"].eqNullSafe(F.col("edge_source")), "left").drop("edge_source")

    t = settle(t.withColumnRenamed("source", "t_source"), "mixing-sources")
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("t_source")), "left")
    inside = F.coalesce(F.col("bin") == F.col("edge_bin"), F.lit(False))
    w = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    at_edge = rows.where(inside).withColumn("run", F.col("before") + F.sum("size").over(w))
    # the document in which the budget ends is taken if that brings the sum closer to it
    gap = F.col("rest") - (F.col("run") - F.col("size"))
    at_edge = at_edge.withColumn("extra", ((F.col("run") <= F.col("rest")) | ((gap > 0) & (F.col("size") < 2 * gap))).cast("long")).drop("run")
    others = rows.where(~inside).withColumn("extra", (F.col("rest") > 0).cast("long") * F.when(F.col("edge_bin").isNull(), 1).when(F.col("bin") < F.col("edge_bin"), 1).otherwise(0))
    out = at_edge.unionByName(others)
    return out.select("doc_id", "size", "source", "source_size", "target", "weight", "epochs", ((F.col("epochs") + F.col("extra")) * F.col("size")).cast("long").alias("taken"), *also)

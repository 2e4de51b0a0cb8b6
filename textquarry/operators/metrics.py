"""Aggregations: distributions, document totals, execution metrics, retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def totals(df: DataFrame, by: str, **columns: Column) -> DataFrame:
    """Sums by a key."""
    return df.groupBy(by).agg(*[F.sum(c).alias(n) for n, c in columns.items()])


def dimension_histogram(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Vectors by dimension, the modal one marked (the smaller of equals)."""
    sizes = vectors.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("dimension")).agg(F.count("*").alias("n"))
    return sizes.withColumn("modal", F.row_number().over(Window.orderBy(F.desc("n"), "dimension")) == 1)


def samples_per_dimension(vectors: DataFrame, n: int = 3, *, key: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    sized = vectors.withColumn("dimension", F.size(vec_col))
    return sized.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy(key))).where(F.col("rank") <= n)


def top_connected(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """Nodes (id, label) by outgoing edges (src), zero included."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("edges"))
    return nodes.join(out, "id", "left").fillna(0, ["edges"]).orderBy(F.desc("edges"), "id").limit(n)


def entity_discovery(nodes: DataFrame) -> DataFrame:
    """Count and last time by (type, label)."""
    return nodes.groupBy("type", "label").agg(F.count("*").alias("n"), F.max("created_at").alias("last_seen"))


def node_patterns(nodes: DataFrame, known: DataFrame | None = None, least: int = 3) -> DataFrame:
    """Labels seen ``least`` times and not known yet, with confidence min(0.9, 0.1 n)."""
    out = nodes.groupBy("type", "label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    if known is not None:
        out = out.join(known, ["type", "label"], "left_anti")
    return out.withColumn("confidence", F.least(F.lit(0.9), F.col("n") * 0.1))


def edge_patterns(nodes: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """Frequency of (source type, target type, edge type)."""
    s, t = nodes.select(F.col("id").alias("src"), F.col("type").alias("src_type")), nodes.select(F.col("id").alias("dst"), F.col("type").alias("dst_type"))
    return edges.join(s, "src").join(t, "dst").groupBy("src_type", "dst_type", "edge_type").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def run_statistics(runs: DataFrame, by: list[str]) -> DataFrame:
    """total, ok, failed, mean duration of the finished, last start."""
    done = F.when(F.col("duration").isNotNull(), F.col("duration"))
    return runs.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.avg(done).alias("avg_duration"), F.max("started_at").alias("last_start"))


def step_metrics(runs: DataFrame) -> DataFrame:
    """By step: items in, out, filtered; summed duration; items a second."""
    out = runs.groupBy("step").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"), F.sum("duration").alias("duration"), F.avg("duration").alias("avg_duration"))
    return out.withColumn("filtered", F.col("n_in") - F.col("n_out")).withColumn("items_per_s", F.try_divide(F.col("n_in"), F.col("duration")))


def preview(df: DataFrame, content: str, n: int = 10, width: int = 200) -> DataFrame:
    return df.limit(n).withColumn("preview", F.substring(content, 1, width))


def retrieval_quality(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query: precision, recall, f1, ndcg and average precision.

    ``results``: query_id, item_id, rank (from 1); ``expected``: query_id, item_id,
    relevance. Gain is (2^rel - 1) / log2(rank + 1) over as many results as are
    expected; average precision divides by the number expected.
    """
    e = expected.groupBy("query_id").agg(F.count("*").alias("n_expected"), F.sort_array(F.collect_list("relevance"), asc=False).alias("ideal"))
    hit = results.join(expected, ["query_id", "item_id"], "left").join(e, "query_id")
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.withColumn("is_hit", F.col("relevance").isNotNull().cast("int")).withColumn("so_far", F.sum("is_hit").over(w))
    gain = lambda rel, rank: (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)
    dcg = F.sum(F.when((F.col("is_hit") == 1) & (F.col("rank") <= F.col("n_expected")), gain(F.col("relevance"), F.col("rank"))).otherwise(0.0))
    per = hit.groupBy("query_id").agg(F.count("*").alias("n_results"), F.sum("is_hit").alias("hits"), F.first("n_expected").alias("n_expected"), F.first("ideal").alias("ideal"), dcg.alias("dcg"), F.sum(F.when(F.col("is_hit") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("ap"))
    idcg = F.aggregate(F.zip_with("ideal", F.sequence(F.lit(1), F.size("ideal")), lambda r, i: gain(r, i)), F.lit(0.0), lambda s, x: s + x)
    out = per.withColumn("precision", F.col("hits") / F.col("n_results")).withColumn("recall", F.col("hits") / F.col("n_expected"))
    out = out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    return out.select("query_id", "n_results", "hits", "precision", "recall", "f1", F.coalesce(F.try_divide(F.col("dcg"), idcg), F.lit(0.0)).alias("ndcg"), (F.col("ap") / F.col("n_expected")).alias("average_precision"))


def consistency(df: DataFrame, value: str, *by: str) -> DataFrame:
    """max(0, 1 - population deviation / mean); fewer than two values give 1."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return out.withColumn("consistency", F.when(F.col("n") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(F.col("sd"), F.col("mean")), F.lit(0.0)))))


def report(metrics: DataFrame, columns: list[str], groupings: list[str]) -> DataFrame:
    """Mean metrics overall and by each grouping on its own: grouping, value, means."""
    mean = [F.avg(c).alias(c) for c in columns]
    out = metrics.agg(*mean).select(F.lit("overall").alias("grouping"), F.lit("").alias("value"), *columns)
    for g in groupings:
        out = out.unionByName(metrics.groupBy(F.col(g).cast("string").alias("value")).agg(*mean).select(F.lit(g).alias("grouping"), "value", *columns))
    return out


def latency(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, median and p95 by position: the value at index floor(0.95 n), not interpolated.

    Counts by distinct value are summed before values are ordered, so a group's
    order holds its distinct values, and equal ones count once in the shuffle.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("c").over(Window.partitionBy(*by))
    c = c.withColumn("n", n).withColumn("upto", F.sum("c").over(w))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("v")))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    out = c.groupBy(*by).agg(F.first("n").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.first("n")).alias("mean"), ((at(low) + at(high)) / 2).alias("median"), at(F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)).alias("p95"))
    return out


def execution_metrics(runs: DataFrame) -> DataFrame:
    """One row: runs by status, summed and mean duration, largest memory, items and items a second."""
    out = runs.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == x).alias(x) for x in ("completed", "failed", "running", "pending")],
        F.sum("duration").alias("duration"), F.avg("duration").alias("avg_duration"), F.max("memory").alias("max_memory"), F.sum("items").alias("items"),
    )
    return out.withColumn("items_per_s", F.coalesce(F.try_divide(F.col("items"), F.col("duration")), F.lit(0.0)))


def step_summary(df: DataFrame, content: str, n: int = 10, width: int = 200) -> tuple[DataFrame, DataFrame]:
    """One row of n, mean words and mean tokens (a quarter of the length); and the first rows with a preview."""
    words, size = F.regexp_count(F.coalesce(content, F.lit("")), F.lit(r"\S+")), F.length(F.coalesce(content, F.lit("")))
    return df.agg(F.count("*").alias("n"), F.avg(words).alias("mean_words"), F.avg(F.ceil(size / F.lit(4.0))).alias("mean_tokens")), preview(df, content, n, width)

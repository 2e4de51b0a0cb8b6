"""Named joins of the knowledge-base model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def embedded_segments(segments: DataFrame, vectors: DataFrame, *, model: str | None = None, documents: list | None = None) -> DataFrame:
    """Enabled segments with their non-null vectors, of one model and of some documents if given."""
    v = vectors.where(F.col("embedding").isNotNull())
    if model is not None:
        v = v.where(F.col("model") == model)
    s = segments.where("enabled")
    if documents is not None:
        s = s.where(F.col("document_id").isin(documents))
    return s.join(v, "embedding_id")


def orphans(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Rows that no owner refers to."""
    return rows.join(owners.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def with_graph(segments: DataFrame, nodes: DataFrame, edges: DataFrame | None = None, *, present: bool = True, key: str = "segment_id") -> DataFrame:
    """Segments with (or without) nodes, or edges if given."""
    ids = nodes.select(key)
    if edges is not None:
        ids = ids.union(edges.select(key))
    return segments.join(ids.where(F.col(key).isNotNull()), key, "left_semi" if present else "left_anti")


def with_many(rows: DataFrame, many: DataFrame, key: str, name: str, order: list[str]) -> DataFrame:
    """Rows with the array of related rows, ordered; empty where there are none. One row a parent, whatever its number."""
    fields = [*order, *(c for c in many.columns if c not in (key, *order))]
    grouped = many.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return rows.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))


def resolved_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by labels to node ids; unknown labels drop out, of equal labels the last node counts."""
    ids = nodes.groupBy("label").agg(F.max("node").alias("node"))
    out = edges
    for end in ("src", "dst"):
        out = out.join(ids.select(F.col("label").alias(f"{end}_label"), F.col("node").alias(end)), f"{end}_label")
    return out


def merged_inputs(inputs: list[DataFrame]) -> DataFrame:
    """All rows of all inputs, columns by name, absent ones null."""
    out = inputs[0]
    for df in inputs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def first_matches(rows: DataFrame, others: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each row with the first other row of its key."""
    w = Window.partitionBy(key).orderBy(*order)
    one = others.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return rows.join(one, key, "left")


def samples_with_owner(vectors: DataFrame, segments: DataFrame, n: int = 3) -> DataFrame:
    """Up to n vectors of each dimension with the segment they belong to, ``orphan`` without one."""
    w = Window.partitionBy("dimension").orderBy("embedding_id")
    top = vectors.withColumn("dimension", F.size("embedding")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return top.join(segments.select("embedding_id", F.col("segment_id")), "embedding_id", "left").withColumn("owner", F.coalesce(F.col("segment_id").cast("string"), F.lit("orphan")))

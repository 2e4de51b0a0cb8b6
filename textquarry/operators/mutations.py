"""Upserts and deletes as set operations that give the new table."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

# Parts of the duplicate key by strategy; a strategy falls back to title and content where site or channel is missing.
STRATEGIES = {
    "HASH": ("hash",),
    "TITLE_CONTENT": ("title", "content"),
    "TITLE_CONTENT_SITE": ("title", "content", "site"),
    "TITLE_CONTENT_CHANNEL": ("title", "content", "channel"),
    "TITLE_CONTENT_SITE_CHANNEL": ("title", "content", "site", "channel"),
}


def strategy_key(strategy: str, columns: dict[str, Column], custom: tuple[str, ...] = ()) -> Column:
    """The duplicate key: lower, trimmed parts; null if there is nothing to compare, and null never matches."""
    parts = custom if strategy == "CUSTOM" else STRATEGIES[strategy]
    clean = {n: F.when(F.length(F.trim(c)) > 0, F.lower(F.trim(c))) for n, c in columns.items()}
    given = [clean[p] for p in parts if p in clean]
    wide = F.concat_ws("|", *[F.concat(F.lit(f"{p}="), clean[p]) for p in parts if p in clean])
    if strategy not in ("HASH", "CUSTOM", "TITLE_CONTENT"):
        short = F.concat_ws("|", *[F.concat(F.lit(f"{p}="), clean[p]) for p in ("title", "content") if p in clean])
        complete = F.lit(True)
        for c in given:
            complete = complete & c.isNotNull()
        wide = F.when(complete, wide).otherwise(short)
    return F.when(F.length(wide) > 0, wide)


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in order; rows without key stay, each for itself.

    ``max`` over a struct sums partially, so a key with many rows is no hot spot.
    """
    rest = [c for c in df.columns if c not in (key, order)]
    with_key = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *rest)).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in [order, *rest]])
    return with_key.select(*df.columns).unionByName(df.where(F.col(key).isNull()))


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """``table`` after ``changes``: given values overwrite, null ones leave what is there, new keys are added with defaults.

    Of several changes to a key each given field's last value counts. Key order plays no part.
    """
    fields = [c for c in table.columns if c != key]
    given = [c for c in fields if c in changes.columns]
    merged = changes.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_new_{c}") for c in given])
    out = table.withColumn("_old", F.lit(True)).join(merged, key, "full_outer")
    cols = []
    for c in fields:
        new = F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in given else F.col(c)
        if defaults and c in defaults:
            new = F.when(F.col("_old").isNull(), F.coalesce(new, F.lit(defaults[c]))).otherwise(new)
        cols.append(new.alias(c))
    return out.select(key, *cols)


def delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def delete_report(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """One row: requested ids, deleted ones, failed ones."""
    asked = ids.select(key).where(F.col(key).isNotNull()).distinct()
    there = asked.join(table.select(key).distinct(), key, "left_semi")
    return asked.agg(F.count("*").alias("requested")).join(there.agg(F.count("*").alias("deleted"))).withColumn("failed", F.col("requested") - F.col("deleted"))


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false or unknown."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def ids_at(payload: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Ids under a path: ``id``, or ``array.id`` into an array of structs."""
    head, _, leaf = path.partition(".")
    if leaf:
        return payload.select(F.explode(head).alias("x")).select(F.col(f"x.{leaf}").alias(key))
    return payload.select(F.col(head).alias(key))


def cascade(tables: dict[str, DataFrame], root: str, ids: DataFrame, links: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Delete ``ids`` (column id) from ``root`` and, link by link (child, column, parent, key), all that points to what went."""
    gone = {root: tables[root].join(ids.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left_semi")}
    for child, column, parent, key in links:
        if parent in gone:
            mine = tables[child].join(gone[parent].select(F.col(key).alias(column)).distinct(), column, "left_semi").select(*tables[child].columns)
            gone[child] = gone[child].union(mine).distinct() if child in gone else mine
    return {n: df.join(gone[n].select("id").distinct(), "id", "left_anti").select(*df.columns) if n in gone else df for n, df in tables.items()}


def descendants(segments: DataFrame, root, *, key: str = "segment_id", parent: str = "parent_id") -> DataFrame:
    """A segment and all below it with their depth; delete in descending order of it. A segment that lies below itself is met once."""
    front = segments.where(F.col(key) == root).select(F.col(key).alias("node"), F.lit(0).alias("depth"))
    found = front
    for d in count(1):
        below = segments.join(front, segments[parent] == front["node"]).select(F.col(key).alias("node")).distinct().join(found.select("node"), "node", "left_anti")
        front = cut(below.withColumn("depth", F.lit(d)))
        if front.isEmpty():
            return found
        found = found.union(front)


def unstuck(segments: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Segments embedding for more than ``minutes`` wait again."""
    stuck = (F.col("status") == "embedding") & (F.col("indexing_at") < now - F.make_interval(mins=F.lit(minutes)))
    return segments.withColumn("status", F.when(stuck, "waiting").otherwise(F.col("status")))


def consistent_vectors(segments: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Vectors of another than the modal dimension become null, and their segments wait."""
    modal = segments.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not modal:
        return segments
    odd = F.size(vec_col) != modal[0]["d"]
    return segments.withColumn("status", F.when(odd, "waiting").otherwise(F.col("status"))).withColumn(vec_col, F.when(~odd, F.col(vec_col)))


def appended(segments: DataFrame, new: DataFrame, document: str = "document_id", order: str = "n") -> DataFrame:
    """New segments positioned after those of their document, waiting."""
    there = segments.groupBy(document).agg(F.count("*").alias("_c"))
    own = F.row_number().over(Window.partitionBy(document).orderBy(order))
    out = new.join(there, document, "left").withColumn("position", (F.coalesce("_c", F.lit(0)) + own).cast("long")).withColumn("status", F.lit("waiting")).drop("_c")
    return segments.unionByName(out.select(*segments.columns))


def upsert_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by labels: matched by (src, dst, edge_type), weight overwritten, properties merged; unknown labels drop out.

    A label that several nodes have stands for the last of them.
    """
    by_label = nodes.groupBy("label").agg(F.max("node").alias("node"))
    e = new
    for end in ("src", "dst"):
        e = e.join(by_label.select(F.col("label").alias(f"{end}_label"), F.col("node").alias(end)), f"{end}_label")
    e = e.groupBy("src", "dst", "edge_type").agg(F.max_by("weight", "n").alias("new_weight"), F.max_by("properties", "n").alias("new_properties"))
    out = edges.join(e, ["src", "dst", "edge_type"], "full_outer")
    both = F.when(F.col("properties").isNull(), F.col("new_properties")).when(F.col("new_properties").isNull(), F.col("properties")).otherwise(F.map_concat(F.map_filter("properties", lambda k, _: ~F.map_contains_key("new_properties", k)), "new_properties"))
    return out.select("src", "dst", "edge_type", F.coalesce("new_weight", "weight").alias("weight"), both.alias("properties"))


def inserted(segments: DataFrame, new: DataFrame, datasets: DataFrame, documents: DataFrame, *, dataset_id, document_id, user_id, order: str = "n") -> DataFrame:
    """``appended`` after checks: the dataset exists and is the user's, the document exists and belongs to it."""
    owner = datasets.where(F.col("dataset_id") == dataset_id).select("user_id").limit(1).collect()
    if not owner:
        raise ValueError("no such dataset")
    if owner[0]["user_id"] != user_id:
        raise PermissionError("the dataset belongs to another user")
    if documents.where((F.col("document_id") == document_id) & (F.col("dataset_id") == dataset_id)).isEmpty():
        raise ValueError("no such document in the dataset")
    return appended(segments, new.withColumn("document_id", F.lit(document_id)), order=order)


def marked(table: DataFrame, ids: DataFrame, key: str, **values: object) -> DataFrame:
    """``table`` with ``values`` in the rows whose key is in ``ids``: bulk enable, disable, status."""
    hit = ids.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("_hit", F.lit(True))
    out = table.join(hit, key, "left")
    for name, value in values.items():
        out = out.withColumn(name, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(name)))
    return out.select(*table.columns)


def upsert_by_strategy(table: DataFrame, items: DataFrame, strategy: str, *, order: str, id_col: str = "hash", required: tuple[str, ...] = ("title",), custom: tuple[str, ...] = (), update: bool = True) -> tuple[DataFrame, DataFrame]:
    """The table after a batch, and the batch's report: order and status (created, updated, skipped, failed).

    Rows match by the strategy's key. Items act in order, so a later one meets what an earlier one
    has created; set-based, the first of a key without a match creates it and the last given values
    count. Without ``update`` a match is skipped. An item without a required field fails alone. An item
    whose key is null matches nothing and is created.
    """
    keyed = lambda df: df.withColumn("_key", strategy_key(strategy, {c: F.col(c).cast("string") for c in df.columns}, custom))
    good = F.lit(True)
    for c in required:
        good = good & (F.length(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) > 0)
    items = keyed(items).withColumn("_good", good)
    # an item without key is its own
    items = items.withColumn("_own", F.coalesce("_key", F.concat(F.lit("\x00"), F.col(order).cast("string"))))
    there = keyed(table).where("_key IS NOT NULL").groupBy(F.col("_key").alias("_own")).agg(F.min(id_col).alias("_there"))
    first = items.where("_good").groupBy("_own").agg(F.min(order).alias("_first"))
    items = items.join(there, "_own", "left").join(first, "_own", "left")
    creates = F.col("_there").isNull() & (F.col(order) == F.col("_first"))
    status = F.when(~F.col("_good"), "failed").when(creates, "created").when(F.lit(update), "updated").otherwise("skipped")
    items = items.withColumn("status", status)
    new_id = F.coalesce("_there", F.sha2(F.concat_ws("|", F.lit(strategy), "_own"), 256))
    changes = items.where("status IN ('created', 'updated')").withColumn(id_col, new_id)
    return upsert(table, changes.select(*[c for c in table.columns if c in changes.columns], *({order} - set(table.columns))), id_col, order), items.select(order, "status")

"""Graph operators over edge tables (src, dst): frontier joins, components, centralities.

All-pairs measures (closeness, betweenness, mean path length) hold a row for each
reachable pair, as their definitions need; they are for graphs of bounded size. Where the graph is large,
``sketched_closeness`` and ``sketched_path_length`` hold one sketch a node instead.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut as _cut


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once, without loops."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()


def shortest_path(edges: DataFrame, start, end, most: int = 5) -> DataFrame:
    """distance and path (ordered nodes) of a shortest directed path of at most ``most`` hops, the smallest of equals; no row if none."""
    spark = edges.sparkSession
    e = edges.select("src", "dst").distinct()
    front = spark.createDataFrame([(start, [start])], f"node {e.schema['src'].dataType.simpleString()}, path array<{e.schema['src'].dataType.simpleString()}>")
    if start == end:
        return front.select(F.lit(0).alias("distance"), "path")
    seen = front.select("node")
    for _ in range(most):
        step = front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        front = _cut(step)
        hit = front.where(F.col("node") == end)
        if not hit.isEmpty():
            return hit.select((F.size("path") - 1).alias("distance"), "path")
        if front.isEmpty():
            break
        seen = seen.union(front.select("node"))
    return front.limit(0).select((F.size("path") - 1).alias("distance"), "path")


def neighbours(edges: DataFrame, start, depth: int = 1, allowed: DataFrame | None = None) -> DataFrame:
    """node and distance within ``depth`` undirected hops; only nodes in ``allowed`` (node) are entered."""
    both = undirected(edges)
    if allowed is not None:
        both = both.join(allowed.select(F.col("node").alias("dst")), "dst", "left_semi")
    found = edges.sparkSession.createDataFrame([(start, 0)], f"node {edges.schema['src'].dataType.simpleString()}, distance int")
    front = found
    for d in range(1, depth + 1):
        front = _cut(front.join(both, front["node"] == both["src"]).select(F.col("dst").alias("node")).distinct().join(found.select("node"), "node", "left_anti").withColumn("distance", F.lit(d)))
        found = found.union(front)
    return found


def component_labels(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node), by smallest neighbour's label and pointer jumping."""
    both = _cut(undirected(edges))
    labels = _cut(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        step = _cut(step.join(jump, "component", "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component"), "old"))
        labels = step.select("node", "component")
        if step.where("component <> old").isEmpty():
            return labels


def communities(edges: DataFrame, least: int = 3) -> DataFrame:
    """component, size, internal edges and density of the components with ``least`` nodes."""
    labels = component_labels(edges)
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"))
    inside = undirected(edges).where("src < dst").join(labels.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.count("*").alias("internal"))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    return sizes.join(inside, "component").where(F.col("size") >= least).withColumn("density", F.col("internal") / pairs)


def modularity(found: DataFrame, n_edges: int) -> DataFrame:
    """Sum over communities of internal / E - ((n (n-1) / 2) / E)^2."""
    pairs = F.col("size") * (F.col("size") - 1) / 2
    return found.agg(F.sum(F.col("internal") / n_edges - F.pow(pairs / n_edges, 2)).alias("modularity"))


def degree(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """node, degree (edges that touch it, a loop once) and rank by position."""
    ends = edges.select(F.col("src").alias("node")).union(edges.where("src <> dst").select("dst"))
    out = ends.groupBy("node").agg(F.count("*").alias("degree"))
    top = out.orderBy(F.desc("degree"), "node")
    top = top.limit(limit) if limit else top
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "node"))) if limit else top


def influential(edges: DataFrame, nodes: DataFrame, limit: int, kind: str | None = None, least: int = 0) -> DataFrame:
    """The 2 limit nodes of highest degree, then filtered by type and degree, then ``limit`` of them."""
    top = degree(edges, 2 * limit).join(nodes, "node")
    if kind:
        top = top.where(F.col("type") == kind)
    return top.where(F.col("degree") >= least).orderBy("rank").limit(limit)


def distances(edges: DataFrame) -> DataFrame:
    """src, dst, distance of every reachable pair, undirected."""
    both = _cut(undirected(edges))
    found = both.withColumn("distance", F.lit(1))
    near = front = found
    for d in count(2):
        step = front.select("src", F.col("dst").alias("mid")).join(both.select(F.col("src").alias("mid"), "dst"), "mid").where("src <> dst").select("src", "dst").distinct()
        # in an undirected graph a step leads to a pair of the last two rounds or to a new one
        new = _cut(step.join(near.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("distance", F.lit(d)))
        if new.isEmpty():
            return found
        near, front = front.union(new), new
        found = found.union(new)


def closeness(edges: DataFrame) -> DataFrame:
    """node and (reached - 1) / sum of distances, the node itself counted as reached."""
    return distances(edges).groupBy(F.col("src").alias("node")).agg((F.count("*") / F.sum("distance")).alias("closeness"))


def mean_path_length(edges: DataFrame) -> DataFrame:
    return distances(edges).where("src < dst").agg(F.avg("distance").alias("mean_path_length"), F.count("*").alias("pairs"))


def neighbourhoods(edges: DataFrame, lg: int = 12) -> DataFrame:
    """node, distance, n: about how many nodes lie within that distance of it (itself too), round by round until no more are met.

    Each node keeps a HyperLogLog sketch of 2^lg counters of what it reaches; a round unites it with its neighbours' sketches,
    in partial sums before the shuffle, so a node of many edges is no hot spot. The error is about 1.04 / sqrt(2^lg) of n; small n are as good as exact.
    A node with one edge keeps none: beyond distance 1 it reaches what its neighbour reaches one step earlier. Sketches
    compress well in files, so their size there is no measure for a broadcast: they meet by merge joins.
    """
    both = _cut(undirected(edges))
    ends = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.min("dst").alias("hub"))
    degrees = ends.select(F.col("node").alias("hub"), F.col("degree").alias("more")).hint("merge")
    # of two nodes that have only each other one is the leaf
    leaves = _cut(ends.where("degree = 1").join(degrees, "hub").where("more > 1 OR node > hub").select("node", "hub"))
    inner = both.join(leaves.select(F.col("node").alias("src")).hint("merge"), "src", "left_anti")
    core = _cut(inner.join(leaves.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_anti"))
    reached = inner.select(F.col("src").alias("node"), "dst").unionByName(inner.select(F.col("src").alias("node"), F.col("src").alias("dst")).distinct())
    now = _cut(reached.groupBy("node").agg(F.hll_sketch_agg("dst", F.lit(lg)).alias("sketch")).withColumn("n", F.hll_sketch_estimate("sketch")))
    found = now.select("node", F.lit(1).alias("distance"), (F.col("n") - 1).alias("n"))
    for d in count(2):
        near = core.join(now.select(F.col("node").alias("dst"), "sketch").hint("merge"), "dst").select(F.col("src").alias("node"), "sketch")
        new = near.unionByName(now.select("node", "sketch")).groupBy("node").agg(F.hll_union_agg("sketch").alias("sketch"))
        before = now.select("node", F.col("n").alias("before")).hint("merge")
        step = _cut(new.join(before, "node").withColumn("n", F.hll_sketch_estimate("sketch")))
        if step.where("n > before").isEmpty():
            break
        found = found.unionByName(step.select("node", F.lit(d).alias("distance"), (F.col("n") - F.col("before")).alias("n")))
        now = step.select("node", "sketch", "n")
    later = leaves.join(found.withColumnRenamed("node", "hub"), "hub")
    # of what the neighbour meets at once the leaf is one itself
    later = later.select("node", (F.col("distance") + 1).alias("distance"), (F.col("n") - F.when(F.col("distance") == 1, 1).otherwise(0)).alias("n"))
    out = found.unionByName(leaves.select("node", F.lit(1).alias("distance"), F.lit(1).cast("long").alias("n"))).unionByName(later)
    return out.where("n > 0")


def sketched_closeness(edges: DataFrame, lg: int = 12) -> DataFrame:
    """``closeness`` from sketches: one row a node and round instead of one a pair."""
    return neighbourhoods(edges, lg).groupBy("node").agg((F.sum("n") / F.sum(F.col("n") * F.col("distance"))).alias("closeness"))


def sketched_path_length(edges: DataFrame, lg: int = 12) -> DataFrame:
    """``mean_path_length`` from sketches."""
    return neighbourhoods(edges, lg).agg((F.sum(F.col("n") * F.col("distance")) / F.sum("n")).alias("mean_path_length"), F.floor(F.sum("n") / 2).alias("pairs"))


def betweenness(edges: DataFrame) -> DataFrame:
    """node and the number of unordered pairs whose one shortest path passes through it; of equal paths, the smallest.

    Paths grow by one hop a round and only the smallest of each pair is kept.
    """
    both = _cut(undirected(edges))
    found = both.withColumn("path", F.array("src", "dst"))
    front = found
    while True:
        step = front.select("src", F.col("dst").alias("mid"), "path").join(both.select(F.col("src").alias("mid"), "dst"), "mid").where("src <> dst")
        step = step.groupBy("src", "dst").agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        front = _cut(step.join(found.select("src", "dst"), ["src", "dst"], "left_anti"))
        if front.isEmpty():
            break
        found = found.union(front)
    inner = found.where("src < dst").select(F.explode(F.slice("path", F.lit(2), F.size("path") - 2)).alias("node"))
    return inner.groupBy("node").agg(F.count("*").alias("betweenness"))


def bridges(edges: DataFrame, most: int = 50, least: float = 0.1) -> DataFrame:
    return betweenness(edges).where(F.col("betweenness") >= least).orderBy(F.desc("betweenness"), "node").limit(most)


def density(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes, edges and E / (n (n-1) / 2), 0 for fewer than two nodes."""
    n, e = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    one = n.join(e)  # one row each
    pairs = F.col("nodes") * (F.col("nodes") - 1) / 2
    return one.withColumn("density", F.when(F.col("nodes") < 2, 0.0).otherwise(F.try_divide(F.col("edges"), pairs)))


def subgraph(nodes: DataFrame, edges: DataFrame, segment: str) -> tuple[DataFrame, DataFrame]:
    """The nodes of a segment and the edges that touch one of them, with labels."""
    mine = nodes.where(F.col("segment_id") == segment)
    ids = mine.select("node")
    touching = edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").union(edges.join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)).distinct()
    label = lambda end: nodes.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    return mine, touching.join(label("src"), "src").join(label("dst"), "dst")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return nodes.join(ends, "node", "left_anti")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean degree 2E / V, and the node with most edges at its ends (the smallest of equals)."""
    n, e = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    top = degree(edges).agg(F.min(F.struct((-F.col("degree")).alias("d"), "node")).alias("t")).select(F.col("t.node").alias("most_connected"), (-F.col("t.d")).alias("most_degree"))
    one = n.join(e).join(top)  # one row each
    return one.withColumn("mean_degree", F.coalesce(F.try_divide(2 * F.col("edges"), F.col("nodes")), F.lit(0.0)))


def top_types(nodes: DataFrame, n: int = 5, kind: str = "type") -> DataFrame:
    return nodes.groupBy(kind).agg(F.count("*").alias("n")).orderBy(F.desc("n"), kind).limit(n)


def created(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` with ``new`` ones appended; missing columns are null."""
    return nodes.unionByName(new, allowMissingColumns=True).select(*nodes.columns)


def without(nodes: DataFrame, edges: DataFrame, *, dataset: object = None, segment: object = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges without the graph of a dataset or of a segment, and one row of nodes_deleted and edges_deleted.

    A dataset's edges carry its id themselves; a segment's edges are those that touch one of its nodes.
    """
    if (dataset is None) == (segment is None):
        raise ValueError("one of dataset and segment")
    mine = F.coalesce(F.col("dataset_id") == F.lit(dataset) if segment is None else F.col("segment_id") == F.lit(segment), F.lit(False))
    kept = nodes.where(~mine)
    if segment is None:
        left = edges.where(~mine)
    else:
        gone = nodes.where(mine).select("node").distinct()
        left = edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select(*edges.columns)
    number = lambda df, name: df.agg(F.count("*").alias(name))
    sizes = number(nodes, "n").join(number(kept, "kept")).join(number(edges, "e")).join(number(left, "left"))  # one row each
    return kept, left, sizes.select((F.col("n") - F.col("kept")).alias("nodes_deleted"), (F.col("e") - F.col("left")).alias("edges_deleted"))


def linked(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with those of ``new`` whose ends exist and that are not there yet by (src, dst, edge_type); of equal new ones, one."""
    both = new.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
    fresh = both.join(edges, ["src", "dst", "edge_type"], "left_anti").dropDuplicates(["src", "dst", "edge_type"])
    return edges.unionByName(fresh, allowMissingColumns=True).select(*edges.columns)

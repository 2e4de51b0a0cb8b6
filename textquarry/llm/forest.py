"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample (SAMPLE vectors): each node splits at the
median of the projection on the difference of two sampled vectors, down to LEAF of them. Every row is
then routed to one leaf of each tree. A query searches all trees through one
priority queue, the leaf least far beyond the cuts first, until the leaves it has opened
hold enough of the sample; the candidates of those leaves are reranked exactly in double
precision, leaf by leaf, and the best of all leaves are merged. Leaves below one node of the tree make a cell,
which one task owns: rows and queries go there once a tree and cell.

How much is enough is measured on the sample: TRIALS of its vectors are searched
against the rest of it, and the budget is that at which the share TARGET of their true
neighbours has been met. Vectors with structure need few leaves; for vectors without any
(uniform directions in 64 dimensions) no index reads less than most rows.

A table of more rows than the sample has larger leaves. These are split again where they are owned, by a tree over
their own rows down to LEAF, which the query searches in the same way. How many rows it reads in a leaf is measured too, on the
whole table: the trial queries' true neighbours among all rows are found, and how far down the order of each leaf they stand.

Largest inner product is turned into angle by one more dimension, which brings all
rows to the largest norm. Equal vectors are searched once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

#: Sampled vectors to fit on, trees, and sampled vectors in a leaf.
SAMPLE, TREES, LEAF = 65_536, 8, 64
#: Cells of a tree, about.
CELLS = 16
#: Sampled vectors that the budget is measured with, and the share of their neighbours that it must meet;
#: the share of those met in a leaf that must be met in the part of it that is read.
TRIALS, TARGET, INSIDE = 100, 0.95, 0.98
#: Rows of a cell that one task holds at a time; a cell of more is dealt out by a hash, and its queries go to each part.
CHUNK = 65_536


@dataclass
class Tree:
    """Inner nodes: normal, threshold, children (a negative child -1-k is leaf k)."""

    normals: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    leaf_rows: np.ndarray  # sampled rows in each leaf
    cell: np.ndarray  # of each leaf


def grow(x: np.ndarray, leaf: int, rng: np.random.Generator, cell: int = 1_024) -> Tree:
    """A tree over rows ``x`` down to ``leaf`` of them; leaves below a node of at most ``cell`` rows are one cell."""
    normals, cuts, children, sizes, cells = [], [], [], [], []
    n_cells = 0

    def node(rows: np.ndarray, own: int = -1) -> int:
        nonlocal n_cells
        if own < 0 and len(rows) <= cell:
            own, n_cells = n_cells, n_cells + 1
        if len(rows) > leaf:
            for _ in range(8):
                a, b = rng.choice(rows, 2, replace=False)
                normal = x[a] - x[b]
                side = x[rows] @ normal
                cut = float(np.median(side))
                low = side < cut
                if 0 < low.sum() < len(rows):
                    at = len(normals)
                    scale = np.linalg.norm(normal)
                    normals.append(normal / scale)
                    cuts.append(cut / scale)
                    children.append([0, 0])
                    children[at] = [node(rows[low], own), node(rows[~low], own)]
                    return at
        if own < 0:  # rows that no cut parts
            own, n_cells = n_cells, n_cells + 1
        sizes.append(len(rows))
        cells.append(own)
        return -len(sizes)

    node(np.arange(len(x)))
    d = x.shape[1]
    return Tree(np.array(normals).reshape(-1, d), np.array(cuts), np.array(children, int).reshape(-1, 2), np.array(sizes), np.array(cells, np.int32))


def route(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of every row."""
    at = np.zeros(len(x), int)
    if not len(tree.cuts):
        return at
    live = np.arange(len(x))
    while len(live):
        n = at[live]
        right = (np.einsum("ij,ij->i", x[live], tree.normals[n]) >= tree.cuts[n]).astype(int)
        at[live] = tree.children[n, right]
        live = live[at[live] >= 0]
    return -1 - at


def search(forest: list[Tree], q: np.ndarray, rows: float) -> list[tuple[int, int]]:
    """(tree, leaf) of one query in order of opening, until they hold ``rows`` sampled rows."""
    sides = [t.normals @ q - t.cuts for t in forest]
    heap = [(0.0, k, 0 if len(t.cuts) else -1) for k, t in enumerate(forest)]
    heapq.heapify(heap)
    out, held = [], 0
    while heap and held < rows:
        cost, k, n = heapq.heappop(heap)
        while n >= 0:
            margin = sides[k][n]
            near, far = forest[k].children[n][::-1] if margin >= 0 else forest[k].children[n]
            # the squares of how far the query lies beyond the cuts on the way
            heapq.heappush(heap, (cost + margin * margin, k, int(far)))
            n = int(near)
        out.append((k, -1 - n))
        held += int(forest[k].leaf_rows[-1 - n])
    return out


def measured_budget(forest: list[Tree], x: np.ndarray, queries: np.ndarray, k: int, trials: int = TRIALS, target: float = TARGET, nearest: list[np.ndarray] | None = None) -> float:
    """Share of the sample ``x`` (lifted rows) to open, all trees together, so that ``target`` of the k nearest of its first rows are met.

    ``nearest``: these neighbours (lifted), where they are to be looked for in more than the sample.
    """
    met = []
    for i in range(min(trials, len(queries))):
        if nearest is None:
            score = x @ queries[i]
            score[i] = -np.inf
            near = x[np.argsort(-score, kind="stable")[: min(k, len(x) - 1)]]
        else:
            near = nearest[i]
        need, held = np.full(len(near), np.inf), 0
        leaf_of = [route(t, near) for t in forest]
        for t, leaf in search(forest, queries[i], np.inf):
            # a leaf is opened while what is held before it is below the budget
            need[(leaf_of[t] == leaf) & np.isinf(need)] = held + 1
            held += int(forest[t].leaf_rows[leaf])
            if np.isfinite(need).all():
                break
        met.append(need)
    every = np.sort(np.concatenate(met)) if met else np.zeros(0)
    return float(every[min(len(every) - 1, int(np.ceil(target * len(every))))]) / len(x) if len(every) else 1.0


def bottoms(x: np.ndarray, seed: int, leaf: int = LEAF) -> tuple[Tree, list[np.ndarray]]:
    """A tree over the rows of one leaf (lifted), and the rows of each of its own leaves."""
    tree = grow(x, leaf, np.random.default_rng(seed))
    at = route(tree, x)
    order = np.argsort(at, kind="stable")
    return tree, np.split(order, np.searchsorted(at[order], np.arange(1, len(tree.leaf_rows))))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1) if n else np.zeros((0, 0))


class _Best:
    """What each query of a cell has met so far; cut back now and then to all that reach the k-th score, so that ties are settled at the end."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores: list[list[np.ndarray]] = [[] for _ in range(queries)]
        self.marks: list[list[np.ndarray]] = [[] for _ in range(queries)]
        self.last = np.full(queries, -np.inf)

    def add(self, who: np.ndarray, scores: np.ndarray, marks: np.ndarray) -> None:
        """``scores``: a row for each of ``who``, a column for each of ``marks``."""
        n = scores.shape[1]
        top = np.partition(scores, n - min(self.k, n), axis=1)[:, n - min(self.k, n)]
        for r, c, row in zip(who.tolist(), top.tolist(), scores, strict=True):
            at = np.flatnonzero(row >= max(c if n >= self.k else -np.inf, self.last[r]) - 1e-12)
            if len(at):
                self.scores[r].append(row[at])
                self.marks[r].append(marks[at])
                if sum(map(len, self.scores[r])) >= 8 * self.k:
                    self._cut(r)

    def _cut(self, r: int) -> None:
        s, m = np.concatenate(self.scores[r]), np.concatenate(self.marks[r])
        if len(s) > self.k:
            self.last[r] = np.partition(s, len(s) - self.k)[len(s) - self.k]
            keep = s >= self.last[r] - 1e-12
            s, m = s[keep], m[keep]
        self.scores[r], self.marks[r] = [s], [m]

    def frame(self, names: np.ndarray) -> pd.DataFrame:
        held = [r for r, s in enumerate(self.scores) if s]
        for r in held:
            self._cut(r)
        if not held:
            return pd.DataFrame({"q": [], "mark": [], "score": []})
        return pd.DataFrame({"q": np.repeat(names[held], [len(self.scores[r][0]) for r in held]), "mark": np.concatenate([self.marks[r][0] for r in held]), "score": np.concatenate([self.scores[r][0] for r in held])})


def _exact(points: DataFrame, queries: np.ndarray, k: int) -> dict[int, list[bytes]]:
    """Marks of the k rows of ``points`` (mark, v) with the largest inner product with each of a few queries, but equal vectors."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Best(len(queries), k + 1)
        for b in batches:
            m = _matrix(b.column("v"))
            if len(m):
                held.add(np.arange(len(queries)), queries @ m.T, np.array(b.column("mark").to_pylist(), object))
        yield pa.RecordBatch.from_pandas(held.frame(np.arange(len(queries))).astype({"q": "int32", "score": "float64"}), schema=pa.schema([("q", pa.int32()), ("mark", pa.binary()), ("score", pa.float64())]), preserve_index=False)

    w = Window.partitionBy("q").orderBy(F.desc("score"), "mark")
    top = points.mapInArrow(best, "q int, mark binary, score double").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).collect()
    own = [xxhash.xxh3_128_digest(q.tobytes()) for q in queries]
    out: dict[int, list[bytes]] = {}
    for r in sorted(top, key=lambda r: (r["q"], r["r"])):
        if bytes(r["mark"]) != own[r["q"]] and len(out.setdefault(r["q"], [])) < k:
            out[r["q"]].append(bytes(r["mark"]))
    return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part: not null, not zero, all components finite, of the usual dimension."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    return rows


def nearest(vectors: DataFrame, *, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, budget: float | None = None, seed: int = 11, compared=None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``.

    Vectors that are null, zero, or hold null or non-finite components take no part,
    nor do null ids or vectors of another length than the commonest. Repeated rows of
    an id count once (the smallest vector). Ties go to the smaller id. A query with
    fewer candidates than k gets all of them. Other columns are ignored. Empty input: no rows.
    ``budget``: share of the sample to open, all trees together; measured if not given. ``compared``: an accumulator
    that gets the number of rows that queries are compared with.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_col, vec_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = settle(rows.withColumn("dim", F.size("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), "forest-rows")
    dims = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], schema)
    dim, top = dims[0]["dim"], dims[0]["norm"]

    # one row for each distinct vector, with the k+1 smallest ids of its copies: no query needs more of them
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [xxhash.xxh3_128_digest(r.tobytes()) for r in _matrix(b.column("v"))]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(marks, pa.binary())], names=["vec_id", "v", "mark"])

    rows = rows.where(F.col("dim") == dim).select("vec_id", "v").mapInArrow(distinct, "vec_id long, v array<double>, mark binary")
    rows = settle(rows, "forest-marks")
    firsts = rows.groupBy("mark").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    bin_of = F.pmod(F.xxhash64("vec_id"), F.lit(256))
    several = rows.join(firsts.where("copies > 1").select("mark"), "mark").select("mark", "vec_id")
    few = several.withColumn("bin", bin_of).withColumn("r", F.row_number().over(Window.partitionBy("mark", "bin").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("mark").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    few = few.groupBy("mark").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    single = rows.join(firsts.select(F.col("first").alias("vec_id"), "mark"), ["vec_id", "mark"])
    points = settle(single.join(few, "mark", "left").select("mark", "v", F.coalesce("ids", F.array("vec_id")).alias("ids")), "forest-points")

    total = points.count()
    # about `sample` rows pass a threshold on a hash before the few that remain are put in order
    place = F.pmod(F.xxhash64("mark", F.lit(seed)), F.lit(1 << 40))
    chosen = points.select("v", place.alias("place")).where(F.col("place") < int(min(1.0, 1.1 * sample / total + 2000 / total) * (1 << 40))).orderBy("place").limit(sample)
    x = _matrix(chosen.select("v").toArrow().column("v"))
    lift = lambda x: np.hstack([x, np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))[:, None]])
    level = lambda x: np.hstack([x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None] * top, np.zeros((len(x), 1))])
    plain, x = x, lift(x)
    rng = np.random.default_rng(seed)
    cell = len(x) // CELLS + 2
    grown = [grow(x, leaf, rng, cell) for _ in range(trees)]
    trial, truth, near = plain[:TRIALS], {}, None
    if total > len(x):
        # the sample is thinner than the table: true neighbours are found among all rows
        truth = _exact(points.select("mark", "v"), trial, k)
        marks = spark.createDataFrame([(y,) for y in {y for own in truth.values() for y in own}], "mark binary")  # TRIALS * k rows at most
        vector_of = {bytes(r["mark"]): r["v"] for r in points.select("mark", "v").join(F.broadcast(marks), "mark").collect()}
        near = [lift(np.array([vector_of[y] for y in truth.get(i, [])], float).reshape(-1, dim)) for i in range(len(trial))]
    if budget is None:
        budget = measured_budget(grown, x, level(trial), k, nearest=near)
    forest = spark.sparkContext.broadcast(grown)  # bounded by the sample
    chunks = max(1, -(-total * cell // (max(len(x), 1) * CHUNK)))
    enough = budget * len(x)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = lift(_matrix(b.column("v")))
            part = pa.array(np.array([xxhash.xxh3_64_intdigest(y.as_py()) % chunks for y in b.column("mark")], np.int32))
            for t, tree in enumerate(forest.value):
                at = route(tree, m)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), t, np.int32)), pa.array(tree.cell[at]), part, pa.array(at.astype(np.int32)), b.column("mark"), b.column("v")], names=["tree", "cell", "chunk", "leaf", "mark", "v"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, tree_of, cell_of, leaves = [], [], [], []
            for k, q in enumerate(level(_matrix(b.column("v")))):
                by: dict[tuple[int, int], list[int]] = {}
                for t, n in search(forest.value, q, enough):
                    by.setdefault((t, int(forest.value[t].cell[n])), []).append(n)
                rows += [k] * len(by)
                tree_of += [t for t, _ in by]
                cell_of += [c for _, c in by]
                leaves += by.values()
            at, listed = pa.array(rows, pa.int64()), pa.array(leaves, pa.list_(pa.int32()))
            for c in range(chunks):
                yield pa.RecordBatch.from_arrays([pa.array(tree_of, pa.int32()), pa.array(cell_of, pa.int32()), pa.array(np.full(len(rows), c, np.int32)), listed, *(b.column(x).take(at) for x in b.schema.names)], names=["tree", "cell", "chunk", "leaves", *b.schema.names])

    cells = ["tree", "cell", "chunk"]
    where = "tree int, cell int, chunk int"
    asking = rows.where(F.col("vec_id") % every == 0).select("vec_id", "mark")
    asks = points.join(asking.select("mark").distinct(), "mark").select("mark", "v")
    asks = asks.repartition(max(4, spark.sparkContext.defaultParallelism))
    index = points.select("mark", "v").mapInArrow(routed, f"{where}, leaf int, mark binary, v array<double>")

    def by_leaf(key, mine: pd.DataFrame, queries: pd.DataFrame):
        """Of each leaf that queries open: its rows (marks, vectors), the queries' places, and the tree over its rows if it is large."""
        order = np.lexsort((mine["mark"].to_numpy(object), mine["leaf"].to_numpy()))
        leaf_of, marks = mine["leaf"].to_numpy()[order], mine["mark"].to_numpy(object)[order]
        m = np.array(mine["v"].tolist(), float)[order]
        opened = queries["leaves"].tolist()
        place, name = np.repeat(np.arange(len(opened)), [len(o) for o in opened]), np.concatenate(opened)
        for n in np.unique(name):
            a, b = np.searchsorted(leaf_of, [n, n + 1])
            if b > a:
                local = bottoms(lift(m[a:b]), int(n) + 1000 * int(key[0]), leaf) if total > len(x) and b - a > 2 * leaf else None
                yield marks[a:b], m[a:b], place[name == n], local

    allowed = np.inf
    if truth:
        # leaves are larger than on the sample: how far down their own order do true neighbours stand?
        asks_of = spark.createDataFrame([(int(i), trial[i].tolist(), list(marks)) for i, marks in truth.items()], "q int, v array<double>, near array<binary>")

        def depths(key, mine: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple[int, bytes, float]] = []
            if len(mine) and len(queries):
                qv, near = level(np.array(queries["v"].tolist(), float)), queries["near"].tolist()
                for marks, _, asking, local in by_leaf(key, mine, queries):
                    at = {y: j for j, y in enumerate(marks)}
                    for i in asking:
                        wanted = {at[y] for y in near[i] if y in at}
                        if not wanted:
                            continue
                        read = 0
                        for rows_of in ([np.arange(len(marks))] if local is None else [local[1][n] for _, n in search([local[0]], qv[i], np.inf)]):
                            # a bottom is opened while what is read before it is below the allowance
                            out += [(int(queries["q"].iloc[i]), marks[j], float(read + 1)) for j in wanted.intersection(rows_of.tolist())]
                            read += len(rows_of)
            return pd.DataFrame(out, columns=["q", "mark", "need"])

        seen = index.groupBy(*cells).cogroup(asks_of.mapInArrow(asked, f"{where}, leaves array<int>, q int, v array<double>, near array<binary>").groupBy(*cells)).applyInPandas(depths, "q int, mark binary, need double")
        needs = sorted(r["need"] for r in seen.groupBy("q", "mark").agg(F.min("need").alias("need")).collect())  # TRIALS * k rows at most
        if needs:
            allowed = needs[min(len(needs) - 1, int(np.ceil(INSIDE * len(needs))))]

    def rerank(key, mine: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(queries):
            return pd.DataFrame({"q": [], "mark": [], "score": []})
        qv, names = np.array(queries["v"].tolist(), float), queries["mark"].to_numpy(object)
        raised = level(qv)
        best = _Best(len(qv), k + 1)
        for marks, m, asking, local in by_leaf(key, mine, queries):
            if local is None:
                parts = [(np.arange(len(m)), asking)]
            else:
                opened = [[n for _, n in search([local[0]], raised[i], allowed)] for i in asking]
                place, name = np.repeat(asking, [len(o) for o in opened]), np.concatenate(opened)
                parts = [(local[1][n], place[name == n]) for n in np.unique(name)]
            for rows_of, own in parts:
                if compared is not None:
                    compared.add(len(rows_of) * len(own))
                for i in range(0, len(own), 256):
                    best.add(own[i : i + 256], qv[own[i : i + 256]] @ m[rows_of].T, marks[rows_of])
        return best.frame(names)

    met = index.groupBy(*cells).cogroup(asks.mapInArrow(asked, f"{where}, leaves array<int>, mark binary, v array<double>").groupBy(*cells))
    found = met.applyInPandas(rerank, "q binary, mark binary, score double")
    found = found.groupBy("q", "mark").agg(F.max("score").alias("score"))
    # distinct vectors: the k+1 best of each query vector with all that tie with the last, then their ids in order
    found = found.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", 9))))).where(F.col("r") <= k + 1).drop("r")
    best = found.join(points.select("mark", "ids"), "mark")
    best = best.select("q", F.struct((-F.col("score")).alias("s"), F.get("ids", F.lit(0)).alias("i"), "mark", "ids").alias("c"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("c"))).where(F.col("r") <= k + 1)
    vs = points.select("mark", "v")
    best = best.select("q", F.col("c.mark").alias("mark"), F.col("c.ids").alias("ids")).join(vs, "mark").join(vs.select(F.col("mark").alias("q"), F.col("v").alias("qv")), "q")
    dot = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    best = best.select("q", F.explode("ids").alias("vec_id"), dot.alias("score"))
    lists = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("all"))
    lists = lists.select(F.col("q").alias("mark"), F.slice("all", 1, 2 * k + 2).alias("all"))
    out = asking.join(lists, "mark").select(F.col("vec_id").alias("query_id"), F.filter("all", lambda c: c["vec_id"] != F.col("vec_id")).alias("all"))
    out = out.select("query_id", F.posexplode(F.slice("all", 1, k)).alias("p", "c"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("c.vec_id").alias("vec_id"), (-F.col("c.s")).alias("score"))

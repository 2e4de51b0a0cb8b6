"""Vector search for tables of queries: an exact join in blocks, and a stored index of cells.

Similarity is the cosine, 0 for a zero vector, in double precision; nine decimals decide the order, and ties go to the smaller
id. Vectors that are null or hold null or non-finite components take no part, nor do those of another length than the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Bytes of query vectors that a task holds; more queries make more passes over the vectors. Rows scored at a time.
HELD, BLOCK = 32 << 20, 1024
#: Decimals that decide the order.
DECIMALS = 9
#: Most cells, sampled vectors a cell that they are fitted on, and rounds of the fit.
CELLS, FIT, ROUNDS = 4096, 64, 8
#: Sampled queries that the number of probes is measured with, and the share of their neighbours that it must meet.
TRIALS, TARGET = 200, 0.93
#: Rows of a cell that one task holds, and how many times k candidates of the coarse codes are compared exactly.
PART, WIDE = 8192, 4


def _usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & good)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1) if n else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    big = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x = x / np.where(big > 0, big, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class Best:
    """The k best of each query so far: similarities, best first, and where they came from."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = queries, k
        self.score = np.full((len(queries), k), -np.inf)
        self.id = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.skipped = 0

    def add(self, x: np.ndarray, ids: np.ndarray) -> None:
        """Unit rows and their ids. A query is not compared with a block that can't hold better than its k-th so far."""
        centre = x.mean(axis=0)
        reach = np.linalg.norm(x - centre, axis=1).max()
        live = np.flatnonzero(self.q @ centre + reach * np.linalg.norm(self.q, axis=1) >= self.score[:, -1] - 2 * 10.0**-DECIMALS)
        self.skipped += len(self.q) - len(live)
        for i in range(0, len(live), 512):
            some = live[i : i + 512]
            score = np.hstack([self.score[some], np.round(self.q[some] @ x.T, DECIMALS)])
            from_ = np.hstack([self.id[some], np.broadcast_to(ids, (len(some), len(ids)))])
            last = -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1]
            row, at = np.nonzero(score >= last[:, None])
            order = np.lexsort((from_[row, at], -score[row, at], row))
            row, at = row[order], at[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            keep = rank < self.k
            row, at, rank = row[keep], at[keep], rank[keep]
            self.score[some[row], rank], self.id[some[row], rank] = score[row, at], from_[row, at]


def knn_join(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", query_id: str = "query_id", query_vec: str = "query", itself: bool = True) -> DataFrame:
    """query_id, rank (from 1), vec_id, similarity: the k nearest of each query, exactly. Ids are whole numbers.

    A slice of the queries, at most HELD bytes, goes to all tasks; each task keeps the k best of every query over its
    blocks of vectors and gives these alone, so what is shuffled is tasks x queries x k rows. A block whose centre and radius
    rule out a better one is not compared. Without ``itself`` a row of the query's own id is no candidate. Fewer than k
    candidates give fewer rows.
    """
    spark = vectors.sparkSession
    rows, asked = _usable(vectors, id_col, vec_col), cut(_usable(queries, query_id, query_vec))
    most = k + (not itself)
    out = None
    for dim, count in sorted((r["dim"], r["n"]) for r in asked.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()):
        slices = max(1, -(-count * dim * 8 // HELD))
        for s in range(slices):
            mine = asked.where((F.size("v") == dim) & (F.pmod(F.xxhash64("id"), F.lit(slices)) == s)).toArrow().combine_chunks()
            if not len(mine):
                continue
            ids = mine.column("id").to_numpy().astype(np.int64)
            sent = spark.sparkContext.broadcast((ids, _unit(_matrix(mine.column("v").combine_chunks()))))

            def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                ids, q = sent.value
                held = Best(q, most)
                for batch in batches:
                    for i in range(0, len(batch), BLOCK):
                        part = batch.slice(i, BLOCK)
                        held.add(_unit(_matrix(part.column("v"))), part.column("id").to_numpy().astype(np.int64))
                row, at = np.nonzero(np.isfinite(held.score))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(held.id[row, at]), pa.array(held.score[row, at])], names=["query_id", "vec_id", "similarity"])

            found = rows.where(F.size("v") == dim).mapInArrow(best, "query_id long, vec_id long, similarity double")
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, similarity double")
    if not itself:
        out = out.where("query_id <> vec_id")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "similarity")


def fitted(x: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Centres of unit vectors ``x`` by spherical k-means; a centre that loses all its rows takes the row farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(cells, len(x)), replace=False))]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        lost = np.flatnonzero(np.bincount(near, minlength=len(c)) == 0)
        if len(lost):
            sums[lost] = x[np.argsort((x * c[near]).sum(axis=1), kind="stable")[: len(lost)]]
        c = _unit(sums)
    return c


def _codes(x: np.ndarray) -> np.ndarray:
    """Unit rows in a byte a component."""
    return np.round(x * 127).astype(np.int8)


@dataclass(frozen=True)
class CellIndex:
    """Vectors at ``path`` by the cell of their nearest centre, with a coarse code beside each.

    Cells are partitions of the stored table, so a search reads the files of its cells alone: first the codes, then the vectors of
    the best WIDE * k, which are compared exactly. Centres are fitted on a bounded sample; every row is indexed.
    """

    spark: SparkSession
    path: str
    centres: np.ndarray
    probes: int

    @classmethod
    def build(cls, vectors: DataFrame, path: str, *, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None, k: int = 10, target: float = TARGET, seed: int = 5) -> CellIndex:
        """Indexes the vectors of the commonest length. ``probes``, the cells that a query reads, is measured: so many
        that ``target`` of the true k nearest of TRIALS sampled rows, found over all rows, lie in them.
        """
        spark, path = vectors.sparkSession, path.rstrip("/")
        rows = _usable(vectors, id_col, vec_col)
        sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
        if sizes is None:
            return cls(spark, path, np.zeros((0, 0)), 0)
        rows, n = rows.where(F.size("v") == sizes["dim"]), sizes["n"]
        cells = cells or int(min(CELLS, max(1, round(n**0.5))))
        place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40))
        most = FIT * cells
        some = rows.where(place < int(min(1.0, 1.1 * most / n + 1000 / n) * (1 << 40))).orderBy(place, "id").limit(most).toArrow().combine_chunks()
        x = _unit(_matrix(some.column("v").combine_chunks()))
        centres = fitted(x, cells)
        sent = spark.sparkContext.broadcast(centres)  # CELLS centres at most

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _unit(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array([c.tobytes() for c in _codes(x)], pa.binary()), pa.array((x @ sent.value.T).argmax(axis=1).astype(np.int32))], names=["id", "v", "code", "cell"])

        kind = rows.schema["id"].dataType.simpleString()
        stored = rows.mapInArrow(placed, f"id {kind}, v array<double>, code binary, cell int")
        # a cell that many rows share is dealt to several tasks
        stored.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(4))).write.partitionBy("cell").parquet(f"{path}/vectors")
        trial = some.slice(0, TRIALS)
        held = cls(spark, path, centres, len(centres))
        if len(trial):
            asked = spark.createDataFrame(trial.rename_columns(["query_id", "query"]))
            near = knn_join(rows, asked, k, id_col="id", vec_col="v", itself=False).select("query_id", F.col("vec_id").alias("id"))
            where = held.vectors().select(F.col("id").cast("long").alias("id"), "cell").join(F.broadcast(near), "id").select("query_id", "cell").collect()  # TRIALS * k rows at most
            order = {int(i): {int(c): r for r, c in enumerate(row)} for i, row in zip(trial.column("id").to_pylist(), np.argsort(-(_unit(_matrix(trial.column("v").combine_chunks())) @ centres.T), axis=1, kind="stable"), strict=True)}
            ranks = sorted(order[r["query_id"]][r["cell"]] for r in where)
            if ranks:
                return cls(spark, path, centres, 1 + ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))])
        return held

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def search(self, queries: DataFrame, k: int = 10, *, query_id: str = "query_id", query_vec: str = "query", probes: int | None = None, itself: bool = True) -> DataFrame:
        """query_id, rank, vec_id, similarity: the k nearest found of each query, with exact similarities."""
        schema = "query_id long, rank int, vec_id long, similarity double"
        if not len(self.centres):
            return self.spark.createDataFrame([], schema)
        probes, sent = min(probes or self.probes, len(self.centres)), self.spark.sparkContext.broadcast(self.centres)
        asked = _usable(queries, query_id, query_vec).where(F.size("v") == self.centres.shape[1])

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _unit(_matrix(batch.column("v")))
                cell = np.argsort(-(x @ sent.value.T), axis=1, kind="stable")[:, :probes] if len(x) else np.zeros((0, probes), int)
                at = np.repeat(np.arange(len(x)), cell.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)).cast(pa.int64()), pa.array(cell.ravel().astype(np.int32)), pa.array([c.tobytes() for c in _codes(x)], pa.binary()).take(pa.array(at))], names=["query_id", "cell", "q"])

        asks = cut(asked.mapInArrow(opened, "query_id long, cell int, q binary"))
        only = [r["cell"] for r in asks.select("cell").distinct().collect()]  # CELLS at most
        index = self.vectors().where(F.col("cell").isin(only))
        counts = index.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        counts = F.broadcast(counts)  # a row a cell
        parts = index.select(F.col("id").cast("long").alias("id"), "cell", "code").join(counts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        asks = asks.join(counts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        most = WIDE * k + (not itself)

        def coarse(key, mine: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            if not len(mine) or not len(asks):
                return pd.DataFrame({"query_id": [], "cell": [], "id": [], "near": []}).astype({"query_id": "int64", "cell": "int32", "id": "int64", "near": "float64"})
            x = np.frombuffer(b"".join(mine["code"]), np.int8).reshape(len(mine), -1).astype(np.float32)
            q = np.frombuffer(b"".join(asks["q"]), np.int8).reshape(len(asks), -1).astype(np.float32)
            ids, out = mine["id"].to_numpy(), []
            for i in range(0, len(q), 512):
                near = q[i : i + 512] @ x.T
                take = min(most, len(ids))
                at = np.argpartition(-near, take - 1, axis=1)[:, :take]
                row = np.repeat(np.arange(len(near)), take)
                out.append(pd.DataFrame({"query_id": asks["query_id"].to_numpy()[i + row], "cell": np.int32(key[0]), "id": ids[at.ravel()], "near": near[row, at.ravel()].astype(float)}))
            return pd.concat(out)

        found = parts.groupBy("cell", "part").cogroup(asks.select("cell", "part", "query_id", "q").groupBy("cell", "part")).applyInPandas(coarse, "query_id long, cell int, id long, near double")
        if not itself:
            found = found.where("query_id <> id")
        top = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "id"))).where(F.col("r") <= WIDE * k)
        exact = index.select("cell", F.col("id").cast("long").alias("id"), "v").join(top.select("query_id", "cell", "id"), ["cell", "id"]).join(asked.select(F.col("id").cast("long").alias("query_id"), F.col("v").alias("q")), "query_id")
        norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, y: s + y * y))
        dot = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)
        exact = exact.withColumn("similarity", F.round(F.coalesce(F.try_divide(dot, norm(F.col("v")) * norm(F.col("q"))), F.lit(0.0)), DECIMALS))
        ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "similarity")

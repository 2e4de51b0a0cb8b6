"""Vector code compression: product quantisation with whole numbers.

A vector's components become integers and are cut into consecutive parts; each part is
replaced by the number of the nearest entry of its own codebook. Codebooks start as the first
vectors and are refined in rounds: an RDD's treeAggregate runs over blocks that hold their rows as columns,
one array a dimension. In a block the squared distances to all entries grow dimension by
dimension, np.add.at gathers int64 sums and counts of the rows of each entry, and these
tensors, of a size that depends on the codebooks alone, merge through a tree of reductions.

All is whole numbers, so the result doesn't depend on the order of the sums.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held, settle, unused

#: Parts of a vector, entries of a codebook (256 at most: two hex digits), rounds, units to 1.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a block, and levels of the reduction tree.
BLOCK, DEPTH = 2_048, 3
#: Rows whose distances are held at a time: with 256 entries 2 MB.
SLICE = 1_024
#: Largest error that a long holds.
MOST = (1 << 63) - 1


@dataclass(frozen=True)
class Shape:
    """Where the parts of a vector begin and end."""

    dim: int
    parts: int

    def spans(self) -> list[tuple[int, int]]:
        return [(p * self.dim // self.parts, (p + 1) * self.dim // self.parts) for p in range(self.parts)]

    def safe(self) -> int:
        """Integers below this have int64 distances and sums."""
        return 1 << max(1, (61 - max(1, self.dim).bit_length()) // 2)


def integers(x: np.ndarray, safe: int) -> np.ndarray:
    """floor(SCALE * x): int64 where all are below ``safe``, else Python's own integers."""
    if not x.size or np.abs(x).max() < safe / SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    exact = lambda v: math.floor(v * SCALE) if abs(v) < 1e300 else int(v) * SCALE
    return np.array([exact(v) for v in x.ravel().tolist()] + [None], object)[:-1].reshape(x.shape)


def fitting(ints: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both of one kind of number."""
    return (ints, book) if ints.dtype == book.dtype else (ints.astype(object), book.astype(object))


def assigned(columns: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (ties: the lowest) and its squared distance; ``columns``: dimensions x rows, ``book``: entries x dimensions."""
    columns, book = fitting(columns, book)
    n = columns.shape[1]
    code, error = np.zeros(n, np.int64), np.zeros(n, columns.dtype)
    for i in range(0, n, SLICE):
        some = columns[:, i : i + SLICE]
        far = np.zeros((some.shape[1], len(book)), columns.dtype)
        for d in range(len(some)):
            off = some[d][:, None] - book[:, d]
            far += off * off
        code[i : i + SLICE] = best = far.argmin(axis=1)
        error[i : i + SLICE] = far[np.arange(len(best)), best]
    return code, error


class Tally:
    """Sums and counts of the rows of each entry of each codebook."""

    def __init__(self, shape: Shape, entries: int):
        self.sums = [np.zeros((entries, b - a), np.int64) for a, b in shape.spans()]
        self.counts = np.zeros((shape.parts, entries), np.int64)

    def add(self, p: int, code: np.ndarray, columns: np.ndarray) -> None:
        if columns.dtype == object:
            self.sums[p] = self.sums[p].astype(object)
        np.add.at(self.sums[p], code, columns.T)
        np.add.at(self.counts[p], code, 1)

    def merge(self, other: Tally) -> Tally:
        self.sums = [np.add(*fitting(a, b)) for a, b in zip(self.sums, other.sums, strict=True)]
        self.counts += other.counts
        return self

    def means(self, books: list[np.ndarray]) -> list[np.ndarray]:
        """The next codebooks: floor(sum / count), an unused entry stays."""
        out = []
        for sums, counts, old in zip(self.sums, self.counts, books, strict=True):
            sums, old = fitting(sums, old)
            out.append(np.where((counts > 0)[:, None], sums // np.maximum(counts, 1)[:, None], old))
        return out


def _columns(data: bytes, n: int) -> np.ndarray:
    """The doubles of a block, dimensions x rows."""
    return np.frombuffer(data, np.float64).reshape(-1, n)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), BLOCK):
            b = batch.slice(i, BLOCK)
            x = np.asarray(b.column("v").flatten().to_numpy(zero_copy_only=False), float).reshape(len(b), -1)
            listed = [pa.ListArray.from_arrays(pa.array([0, len(b)], pa.int32()), b.column(c)) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64()), *listed, pa.array([x.T.tobytes()], pa.binary())], names=["n", "ids", "labels", "data"])


def trained(blocks: DataFrame, books: list[np.ndarray], shape: Shape, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks after ``rounds`` rounds over ``blocks`` (n, data)."""
    spark, safe, entries = blocks.sparkSession, shape.safe(), len(books[0])
    rows = blocks.select("n", "data").rdd

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)  # entries x dimensions

        def gather(tally: Tally, row, sent=sent) -> Tally:
            ints = integers(_columns(row["data"], row["n"]), safe)
            for p, (a, b) in enumerate(shape.spans()):
                code, _ = assigned(ints[a:b], sent.value[p])
                tally.add(p, code, ints[a:b])
            return tally

        books = rows.treeAggregate(Tally(shape, entries), gather, Tally.merge, depth=DEPTH).means(books)
        sent.unpersist()
    return books


def compressed(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error for each row that is kept; the codebooks).

    Rows whose vector is null or holds null or non-finite components are dropped, and those of another length than the
    commonest (ties: the shortest; a vector without components has none). Codebooks start with the ``entries`` smallest ids that are not null; a
    repeated id counts as often as it is there, in order of its vectors. Null ids are coded like any other. A length that
    ``parts`` doesn't divide gives parts that differ by one. Components of any size are exact; an error beyond a long is given as the
    largest long. Other columns are ignored. Empty input: no rows, empty codebooks.
    """
    spark = vectors.sparkSession
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v")).where(F.col("v").isNotNull() & finite & (F.size("v") > 0))
    kind = rows.schema["label"].dataType.simpleString()
    dims = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], f"vec_id long, label {kind}, code string, error long"), [np.zeros((0, 0), np.int64) for _ in range(parts)]
    shape = Shape(dims[0]["dim"], parts)
    rows = rows.where(F.size("v") == shape.dim)
    first = rows.where("vec_id IS NOT NULL").orderBy("vec_id", "v").limit(entries).select("v").toArrow()  # at most ``entries`` vectors
    if not len(first):
        first = rows.orderBy("v").limit(entries).select("v").toArrow()  # no ids at all: the smallest vectors
    seeds = integers(np.array(first.column("v").to_pylist(), float), shape.safe())
    blocks = settle(rows.mapInArrow(_blocks, f"n long, ids array<long>, labels array<{kind}>, data binary"), "codes-blocks")
    books = trained(blocks, [seeds[:, a:b] for a, b in shape.spans()], shape, rounds)
    sent = spark.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{k:02x}" for k in range(256)])
        for batch in batches:
            for i in range(len(batch)):
                ints = integers(_columns(batch.column("data")[i].as_py(), batch.column("n")[i].as_py()), shape.safe())
                found = [assigned(ints[a:b], sent.value[p]) for p, (a, b) in enumerate(shape.spans())]
                code = digits[found[0][0]]
                for more, _ in found[1:]:
                    code = np.char.add(code, digits[more])
                error = [min(e, MOST) for e in sum(e.astype(object) for _, e in found).tolist()]
                ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code.tolist(), pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(coded, f"vec_id long, label {kind}, code string, error long"), books


def codebook_digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' integers in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def code_query(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every kept row; label_error sums the errors of the rows of one label, null labels together.

    What is dropped, and ties, repeated ids and odd lengths, are as in ``compressed``. A sum beyond a long is given as the largest long. Empty input: no rows.
    """
    coded, books = compressed(vectors)
    coded = settle(coded, "codes-rows")
    most = F.lit(MOST).cast("decimal(38,0)")
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")), most).cast("long").alias("label_error"))
    # null labels meet under a mark of their own
    mark = unused("nothing", coded)
    marked = lambda df: df.withColumn(mark, F.col("label").isNull()).withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit("")))
    out = marked(coded).join(held(settle(marked(sums), "codes-labels")), ["label", mark])
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))

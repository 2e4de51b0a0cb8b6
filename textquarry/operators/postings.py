"""A stored keyword index: terms to documents, for many queries at once without reading texts.

Postings are kept by a hash bucket of their term, in blocks of at most BLOCK documents of one term with
counts, lengths and positions. A search reads the buckets of its terms alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import K1, B, tokens

#: Documents of a block, and tasks that the blocks of one bucket are dealt to.
BLOCK, SALTS = 1024, 8
#: Documents whose terms a task holds at a time.
DOCS = 64
#: Query terms up to which these go to all tasks (a few short strings each).
FEW_TERMS = 100_000

_RUN = re.compile("[a-z0-9_]+")


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, low, kw, len) -> the blocks of DOCS documents, by term: counts in the text and among the keywords, positions among the terms."""
    for whole in batches:
        for start in range(0, len(whole), DOCS):
            batch = whole.slice(start, DOCS)
            ids, term, kws, positions, ends = [], [], [], [], [0]
            for k, (low, kw) in enumerate(zip(batch.column("low"), batch.column("kw").to_pylist(), strict=True)):
                at: dict[str, list[int]] = {}
                for n, w in enumerate(w for w in _RUN.findall(low.as_py()) if len(w) > 2):
                    at.setdefault(w, []).append(n)
                held = {}
                for w in kw or ():
                    held[w] = held.get(w, 0) + 1
                for w in at.keys() | held.keys():
                    ids.append(k)
                    term.append(w)
                    kws.append(held.get(w, 0))
                    positions.extend(at.get(w, ()))
                    ends.append(len(positions))
            at = pa.array(ids, pa.int64())
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(positions, pa.int32()))
            code = pa.array(term, pa.string()).dictionary_encode()
            # a term's documents lie together before anything is shuffled
            by_term = pa.array(np.argsort(code.indices.to_numpy(), kind="stable"))
            rows = pa.RecordBatch.from_arrays([code, batch.column("doc").take(at), batch.column("len").take(at), pa.array(kws, pa.int32()), listed], names=["term", "doc", "len", "kw", "positions"])
            yield from _blocked(rows.take(by_term))


def _blocked(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows with the documents of each (encoded) term together -> a row for each block."""
    if not len(rows):
        return
    code = rows.column("term").indices.to_numpy()
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    sizes = np.diff(np.append(starts, len(rows)))
    # a term of many documents is cut every BLOCK rows
    pieces = -(-sizes // BLOCK)
    starts = np.repeat(starts, pieces) + BLOCK * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    ends = pa.array(np.append(starts, len(rows)).astype(np.int32))
    held = (np.diff(rows.column("positions").offsets.to_numpy()) > 0).astype(np.int64)
    lists = [pa.ListArray.from_arrays(ends, rows.column(c)) for c in ("doc", "len", "kw", "positions")]
    term = rows.column("term").dictionary.take(pa.array(code[starts]))
    yield pa.RecordBatch.from_arrays([term, pa.array(np.add.reduceat(held, starts)), *lists], names=["term", "df", "doc", "len", "kw", "positions"])


@dataclass(frozen=True)
class Postings:
    """The index at ``path``: postings by bucket, and one row of statistics."""

    spark: SparkSession
    path: str
    buckets: int
    kind: str = "bigint"  # of document ids

    @classmethod
    def build(cls, docs: DataFrame, path: str, *, id_col: str = "doc_id", content: str = "text", keywords: str | None = None, length: str | None = None, buckets: int = 64) -> Postings:
        """Indexes whole texts. Null texts are empty; a document without terms counts in the statistics alone. Ids must be of their own."""
        low = F.lower(F.coalesce(content, F.lit("")))
        size = F.col(length).cast("double") if length else F.regexp_count(low, F.lit(r"\S+")).cast("double")
        kw = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), F.lower) if keywords else F.array().cast("array<string>")
        base = docs.select(F.col(id_col).alias("doc"), low.alias("low"), kw.alias("kw"), size.alias("len"))
        kind = base.schema["doc"].dataType.simpleString()
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        blocks = base.mapInArrow(_posted, f"term string, df long, doc array<{kind}>, len array<double>, kw array<int>, positions array<array<int>>").withColumn("bucket", bucket)
        # a term that most documents have is dealt to several tasks
        blocks = blocks.repartition("bucket", F.pmod(F.xxhash64(F.get("doc", F.lit(0))), F.lit(SALTS))).sortWithinPartitions("bucket", "term")
        path = path.rstrip("/")
        blocks.write.partitionBy("bucket").parquet(f"{path}/postings")
        base.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).coalesce(1).write.parquet(f"{path}/statistics")
        return cls(docs.sparkSession, path, buckets, kind)

    def blocks(self, only: list[int]) -> DataFrame:
        schema = f"term string, df long, doc array<{self.kind}>, len array<double>, kw array<int>, positions array<array<int>>, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/postings").where(F.col("bucket").isin(only))

    def search(self, queries: DataFrame, k: int | None = None, *, query_id: str = "query_id", text: str = "query") -> DataFrame:
        """query_id, doc_id, score > 0 (and rank from 1, if ``k`` best are asked for) of all ``queries``; scores are those of ``retrieval.bm25``.

        The whole query counts three times where its terms stand in a row; short words and what separates
        words don't matter for that. Queries without terms find nothing.
        """
        listed = queries.select(F.col(query_id).alias("query_id"), F.posexplode(tokens(F.col(text))).alias("place", "term"))
        listed = listed.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        only = [r["bucket"] for r in listed.select("bucket").distinct().collect()]  # at most ``buckets``
        stats = self.spark.read.parquet(f"{self.path}/statistics").first()
        n, mean = stats["n"], stats["mean"] or 1.0
        asked = listed.groupBy("query_id", "term", "bucket").agg(F.collect_list("place").alias("places"))
        sizes = listed.groupBy("query_id").agg(F.count("*").alias("long"), F.count_distinct("term").alias("terms"))
        asked = asked.join(sizes, "query_id")
        few = asked.limit(FEW_TERMS + 1).count() <= FEW_TERMS
        small = F.broadcast if few else (lambda df: df)
        met = self.blocks(only).join(small(asked.select("term", "bucket").distinct()), ["term", "bucket"])
        rare = met.groupBy("term").agg(F.sum("df").alias("df"))
        df = F.col("df")
        idf = F.when(df == 0, 0.0).when(df >= n, F.ln(F.lit(1.1))).otherwise(F.ln((n - df + 0.5) / (df + 0.5)))
        rated = asked.join(rare, "term").withColumn("idf", idf).drop("bucket", "df")
        each = met.select("term", F.explode(F.arrays_zip("doc", "len", "kw", "positions")).alias("x")).select("term", "x.*").join(small(rated), "term")
        tf = F.size("positions") + 3.0 * F.col("kw")
        part = F.when(tf > 0, F.col("idf") * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("len") / mean))).otherwise(0.0)
        by = each.groupBy("query_id", "doc").agg(F.sum(part).alias("sum"), F.count("*").alias("present"), F.max("terms").alias("terms"), F.max("long").alias("long"), F.count_if(F.size("positions") > 0).alias("written"))
        # only where all terms are written can they stand in a row: then each place of the query must be met at one shift
        whole = by.where("written = terms AND long > 1").select("query_id", "doc")
        shift = each.join(whole, ["query_id", "doc"]).select("query_id", "doc", "long", "positions", F.explode("places").alias("place")).select("query_id", "doc", "long", F.explode(F.transform("positions", lambda p: p - F.col("place"))).alias("shift"))
        rows = shift.groupBy("query_id", "doc", "shift").agg(F.count("*").alias("met"), F.max("long").alias("long")).where("met = long").select("query_id", "doc").distinct().withColumn("whole", F.lit(True))
        by = by.join(rows, ["query_id", "doc"], "left")
        in_row = F.coalesce("whole", F.lit(False)) | ((F.col("long") == 1) & (F.col("written") == 1))
        score: Column = F.col("sum") * F.when(in_row, 3.0).otherwise(0.3 + 0.7 * F.col("present") / F.col("terms"))
        out = by.select("query_id", F.col("doc").alias("doc_id"), score.alias("score")).where("score > 0")
        if k is None:
            return out
        return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)

"""Structured Streaming: record ingestion that never takes a hash twice, windowed counts, sessions."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def stream(spark: SparkSession, path: str, schema, *, files_per_trigger: int = 100, format: str = "parquet") -> DataFrame:
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def ingest_once(records: DataFrame, target: str, checkpoint: str, key: str = "hash", *, buckets: int = 256, available_now: bool = True):
    """Append records whose key ``target`` does not hold yet; a key is never forgotten.

    Each batch is anti-joined to the table and deduplicated. Rows are kept by a hash bucket of
    their key, and only the buckets that a batch touches are read again, so a small batch doesn't cost a
    scan of all keys. The batch number is part of the folder, so a batch that runs again
    overwrites its own rows only.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        one = batch.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        folder = f"{target}/batch={number}"
        try:
            touched = [r["bucket"] for r in one.select("bucket").distinct().collect()]  # at most ``buckets``
            known = spark.read.parquet(target).where((F.col("batch") != number) & F.col("bucket").isin(touched)).select(key)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            one = one.join(known, key, "left_anti")
        one.write.mode("overwrite").partitionBy("bucket").parquet(folder)

    writer = records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class Progress(StreamingQueryListener):
    """Keeps the last ``most`` progress reports of all queries: name, batch, rows and rows a second, and what ended with an error."""

    def __init__(self, most: int = 1000):
        self.reports: deque[dict] = deque(maxlen=most)
        self.errors: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self.reports.append({"query": str(event.id), "name": event.name, "event": "started"})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.reports.append({"query": str(p.id), "name": p.name, "event": "progress", "batch": p.batchId, "rows": p.numInputRows, "rows_per_s": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        self.reports.append({"query": str(event.id), "event": "idle"})

    def onQueryTerminated(self, event) -> None:
        self.reports.append({"query": str(event.id), "event": "ended"})
        if event.exception:
            self.errors[str(event.id)] = event.exception


def windowed(records: DataFrame, ts: str, by: list[str], *, size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", **measures: Column) -> DataFrame:
    """Counts and measures by event-time window and key; state is dropped once the watermark has passed."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = records.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), *[m.alias(k) for k, m in measures.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", *measures)


def sessions(records: DataFrame, ts: str, by: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = records.withWatermark(ts, late) if records.isStreaming else records
    out = out.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")

"""A table in hash buckets of its key: a change rewrites only the buckets that it touches.

Rows lie in ``rows/change=<id>/bucket=<b>``; files are never changed. Each change writes the whole
new content of its buckets beside the old one, then appends one small file to ``log`` that says which change now holds
which bucket. So a reader sees all of a change or nothing of it, and a table that was read before a change stays
readable while it runs and after it, until ``vacuum``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import mutations
from ..operators.lineage import cut

LOG = "number long, change string, batch string, bucket int, rows long"


class Changed(RuntimeError):
    """Another writer has changed a bucket since it was read; nothing was written to the log."""


@dataclass(frozen=True)
class BucketTable:
    """The table at ``path`` with rows of ``schema`` by ``key`` in ``buckets`` buckets.

    One writer at a time: a second one that touches the same buckets meanwhile gets ``Changed`` and can try again.
    """

    spark: SparkSession
    path: str
    key: str
    schema: StructType
    buckets: int

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = 256) -> BucketTable:
        """A new table of ``rows``; null keys are left out, of repeated keys one row stays (the largest)."""
        out = cls(rows.sparkSession, path.rstrip("/"), key, rows.schema, buckets)
        rest = [c for c in rows.columns if c != key]
        one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*rest)).alias("x")).select(key, "x.*").select(*rows.columns)
        out._write(out._placed(one), list(range(buckets)), {}, None)
        return out

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with their bucket; the key is brought to the table's type first, as equal numbers of two types hash differently."""
        kind = self.schema[self.key].dataType
        return rows.withColumn(self.key, F.col(self.key).cast(kind)).withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log")

    def held(self) -> dict[int, tuple[int, str, int]]:
        """bucket -> (number, change, rows) of the change that holds it; a row a bucket."""
        last = self.log().groupBy("bucket").agg(F.max(F.struct("number", "change", "rows")).alias("x"))
        return {r["bucket"]: tuple(r["x"]) for r in last.collect()}

    def read(self, only: list[int] | None = None, held: dict[int, tuple[int, str, int]] | None = None) -> DataFrame:
        """The rows as they are now, of all buckets or some; the files are fixed by this call."""
        held = self.held() if held is None else held
        paths = [f"{self.path}/rows/change={change}/bucket={b}" for b, (_, change, rows) in sorted(held.items()) if rows and (only is None or b in only)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        schema = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(*paths).select(*self.schema.names)

    def at(self, key) -> DataFrame:
        """The row of one key, from its bucket alone."""
        asked = self._placed(self.spark.createDataFrame([(key,)], StructType([self.schema[self.key]])))
        return self.read([asked.first()["bucket"]]).where(F.col(self.key) == F.lit(key))

    def _write(self, rows: DataFrame, touched: list[int], held: dict[int, tuple[int, str, int]], batch: str | None) -> list[int]:
        change, folder = uuid.uuid4().hex, f"{self.path}/rows"
        rows.repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").parquet(f"{folder}/change={change}")
        counts = {r["bucket"]: r["count"] for r in self.spark.read.schema(StructType([StructField("bucket", IntegerType())])).parquet(f"{folder}/change={change}").groupBy("bucket").count().collect()}
        if held:
            now = self.held()
            if any(now[b] != held[b] for b in touched):
                raise Changed(f"{self.path}: buckets were changed meanwhile")
        number = 1 + max((n for n, _, _ in held.values()), default=0)
        lines = [(number, change, batch, b, counts.get(b, 0)) for b in touched]
        self.spark.createDataFrame(lines, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return touched

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # at most ``buckets``

    def _done(self, batch: str | None) -> bool:
        return batch is not None and not self.log().where(F.col("batch") == batch).isEmpty()

    def upsert(self, changes: DataFrame, order: str, defaults: dict[str, object] | None = None, batch: str | None = None) -> list[int]:
        """``mutations.upsert`` on the buckets of the changed keys; gives these buckets.

        Null keys are left out. ``batch`` names the batch: one that the log has already is not applied again.
        """
        if self._done(batch):
            return []
        changes = cut(self._placed(changes.where(F.col(self.key).isNotNull())))
        touched = self._touched(changes)
        if not touched:
            return []
        held = self.held()
        new = mutations.upsert(self.read(touched, held), changes.drop("bucket"), self.key, order, defaults).select(*self.schema.names)
        return self._write(self._placed(new), touched, held, batch)

    def delete(self, ids: DataFrame, batch: str | None = None) -> list[int]:
        """Without the rows of the keys in ``ids``; gives the buckets that were written."""
        if self._done(batch):
            return []
        ids = cut(self._placed(ids.select(self.key).where(F.col(self.key).isNotNull()).distinct()))
        held = self.held()
        touched = [b for b in self._touched(ids) if held[b][2]]
        if not touched:
            return []
        return self._write(self._placed(mutations.delete(self.read(touched, held), ids, self.key)), touched, held, batch)

    def replace(self, condition: Column, values: dict[str, Column], batch: str | None = None) -> list[int]:
        """``values`` in the rows that meet ``condition``; only buckets with such rows are written."""
        if self._done(batch):
            return []
        held = self.held()
        rows = self.read(held=held)
        touched = self._touched(self._placed(rows.where(condition).select(self.key)))
        if not touched:
            return []
        some = self.read(touched, held)
        hit = F.coalesce(condition, F.lit(False))
        new = some.select(*[F.when(hit, values[c]).otherwise(F.col(c)).cast(self.schema[c].dataType).alias(c) if c in values else F.col(c) for c in self.schema.names])
        return self._write(self._placed(new), touched, held, batch)

    def vacuum(self) -> list[str]:
        """Deletes the changes that hold no bucket any more; readers of an older state must be done."""
        alive = {change for _, change, _ in self.held().values()}
        dead = sorted({r["change"] for r in self.log().select("change").distinct().collect()} - alive)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for change in dead:
            at = path(f"{self.path}/rows/change={change}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return dead


def upsert_stream(records: DataFrame, table: BucketTable, order: str, checkpoint: str, defaults: dict[str, object] | None = None, *, available_now: bool = True):
    """Each batch of a stream is one change of ``table``; a batch that runs again after a failure is applied once."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex

    def put(batch: DataFrame, number: int) -> None:
        table.upsert(batch, order, defaults, batch=f"{name}-{number}")

    writer = records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

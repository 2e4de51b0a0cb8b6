"""Shared pieces: intermediate tables on the shared folder, size-checked broadcast."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only below this many rows (of a few longs each).
BROADCAST_ROWS = 500_000
#: Most rows in an Arrow batch of texts.
BATCH_ROWS = 1_000


def tidied(run):
    """A function for mapInArrow that gives freed memory back to the system when its task ends; Python workers live on."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return wrapped


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering the session's Arrow batches to BATCH_ROWS rows if they are larger.

    Texts are long: batches of the usual 10 000 rows take tens of MB several times over, in the JVM beside
    its heap and in each Python worker. Results don't depend on it.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone (any file system)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def unused(name: str, df: DataFrame) -> str:
    """``name``, with as many underscores as make it none of the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and all runs on one machine (tests) a temporary folder is made and set;
    on a cluster other machines could not read it, so there an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textquarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage, survives lost executors, and keeps columns compressed,
    which a checkpoint of rows does not.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textquarry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def semi(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """``df`` joined to the settled table ``ids`` on ``key``.

    ``ids`` is broadcast only if its counted rows are few; otherwise both sides
    are shuffled, so the size of ``ids`` has no bound.
    """
    return df.join(held(ids), key, how)


def held(rows: DataFrame) -> DataFrame:
    """The settled table ``rows`` (a few longs each), marked for broadcast only if its counted rows are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows

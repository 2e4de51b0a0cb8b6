"""Table scans and the sources that are parametrised scans.

Everything is read by Spark's own readers, so any file system works, and filters
and column choices reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def segment_source(segments: DataFrame, *, dataset_id=None, document_id=None, segment_id=None, limit: int = 0, offset: int = 0, position: str = "position") -> DataFrame:
    """Segments of the most specific id given, by position, then a slice; a limit of 0 means all."""
    for name, value in (("segment_id", segment_id), ("document_id", document_id), ("dataset_id", dataset_id)):
        if value is not None:
            segments = segments.where(F.col(name) == value)
            break
    out = segments.orderBy(position)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit else out


def windowed_source(rows: DataFrame, now: Column, minutes: int = 30, ts: str = "ts") -> DataFrame:
    """What a poll at ``now`` asks for: rows of the last ``minutes``, both ends included."""
    return rows.where(F.col(ts).between(now - F.make_interval(mins=F.lit(minutes)), now))


def date_chunks(spark: SparkSession, start: str, end: str, minutes: int = 60) -> DataFrame:
    """Chunks (chunk, chunk_start, chunk_end) that tile whole days from ``start`` to ``end``, ends excluded."""
    first = F.date_trunc("day", F.lit(start).cast("timestamp_ntz"))
    last = F.date_trunc("day", F.lit(end).cast("timestamp_ntz")) + F.expr("INTERVAL 1 DAY")
    step = F.expr(f"INTERVAL {int(minutes)} MINUTES")
    one = spark.range(1).select(F.posexplode(F.sequence(first.cast("timestamp_ntz"), (last - step).cast("timestamp_ntz"), step)).alias("chunk", "chunk_start"))
    return one.withColumn("chunk_end", F.col("chunk_start") + step)


def chunked_counts(rows: DataFrame, minutes: int = 60, ts: str = "ts") -> DataFrame:
    """Rows by the chunk of the day grid they fall in; chunks without rows are skipped."""
    day = F.date_trunc("day", F.col(ts))
    inside = F.floor((F.hour(ts) * 60 + F.minute(ts)) / minutes).cast("int")
    return rows.groupBy(day.cast("timestamp_ntz").alias("day"), inside.alias("chunk")).agg(F.count("*").alias("total"))


def payload_items(payload: Column, item: str = "string") -> Column:
    """The array of items in an API reply (JSON text): itself, or under data, results, items or hits, else the reply alone."""
    arrays = [F.from_json(F.get_json_object(payload, p), f"array<{item}>") for p in ("$.data", "$.results", "$.items", "$.hits")]
    whole = F.when(F.trim(payload).startswith("["), F.from_json(payload, f"array<{item}>"))
    return F.coalesce(whole, *arrays, F.array(payload if item == "string" else F.from_json(payload, item)))


def mock_rows(spark: SparkSession, count: int = 5, fields: dict[str, str] | None = None, seed: int = 12345) -> DataFrame:
    """Seeded rows with typed fields (string, number, boolean, date, object).

    The n-th draw of the generator v -> (9301 v + 49297) mod 233280 has a closed form
    by repeated squaring, so rows need no predecessor: the multiplier's powers modulo
    233280 are folded over the bits of n.
    """
    fields = fields or {}
    modulus, a, c = 233_280, 9_301, 49_297
    jumps = []
    m, k = a, c
    for _ in range(40):
        jumps.append((m, k))
        m, k = m * m % modulus, (m * k + k) % modulus
    steps = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(k).cast("long").alias("k"), F.lit(1 << b).alias("b")) for b, (m, k) in enumerate(jumps)])

    def draw(n: Column) -> Column:
        value = F.aggregate(steps, F.lit(seed % modulus).cast("long"), lambda v, s: F.when(n.bitwiseAND(s["b"].cast("long")) != 0, (s["m"] * v + s["k"]) % modulus).otherwise(v))
        return value / F.lit(float(modulus))

    wide = max(len(fields), 1)
    out = spark.range(count).select((F.col("id") + 1).alias("position"), F.col("id").alias("_n"))
    for j, (name, kind) in enumerate(fields.items()):
        r = draw(F.col("_n") * wide + (j + 1))
        number = F.floor(r * 1000).cast("long")
        value = {
            "string": F.concat(F.lit(f"{name}_"), number.cast("string")),
            "number": number,
            "boolean": r > 0.5,
            "date": F.date_add(F.lit("2024-01-01").cast("date"), F.floor(r * 365).cast("int")),
            "object": F.struct(number.alias("value")),
        }[kind]
        out = out.withColumn(name, value)
    return out.withColumn("id", F.concat(F.lit("mock-"), F.col("position").cast("string"))).withColumn("content", F.concat(F.lit("Mock content "), F.col("position").cast("string"))).drop("_n")


def posts_as_documents(posts: DataFrame, content: Column, *, source: str = "source", order: str = "created_at", tie: str = "hash") -> DataFrame:
    """One document a source (unknown where null), one segment a post in order of the time ``order``, then ``tie``.

    Running counts by hour go before, so rows are only put in order within an hour of a source.
    """
    named = posts.withColumn("document", F.coalesce(F.col(source), F.lit("unknown"))).withColumn("_hour", F.date_trunc("hour", F.col(order).cast("timestamp")))
    hours = named.groupBy("document", "_hour").agg(F.count("*").alias("_c"))
    hours = hours.withColumn("_before", F.sum("_c").over(Window.partitionBy("document").orderBy("_hour")) - F.col("_c"))
    hours = hours.select(F.col("document").alias("_document"), F.col("_hour").alias("_h"), "_before")
    out = named.join(hours, (F.col("document") == F.col("_document")) & F.col("_hour").eqNullSafe(F.col("_h")))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("document", "_hour").orderBy(order, tie))
    return out.withColumn("position", place).withColumn("content", content).drop("_document", "_h", "_hour", "_before")


def post_text(title: Column, message: Column, fallback: Column, name: Column) -> Column:
    """Title and message joined unless the message holds the title (any case); else title, fallback, or ``Post from X``."""
    has_t, has_m = F.length(F.trim(F.coalesce(title, F.lit("")))) > 0, F.length(F.trim(F.coalesce(message, F.lit("")))) > 0
    both = F.when(F.contains(F.lower(message), F.lower(title)), message).otherwise(F.concat_ws("\n\n", title, message))
    return F.when(has_t & has_m, both).when(has_m, message).when(has_t, title).otherwise(F.coalesce(fallback, F.concat(F.lit("Post from "), F.coalesce(name, F.lit("unknown")))))


def with_mock(df: DataFrame, count: int = 5, fields: dict[str, str] | None = None, seed: int = 12345) -> DataFrame:
    """Mock rows in front of ``df``; columns that one side lacks are null there."""
    return mock_rows(df.sparkSession, count, fields, seed).unionByName(df, allowMissingColumns=True)


def post_source(posts: DataFrame, condition: Column | None = None, *, order: list[Column], number: int = 1, limit: int = 100) -> tuple[DataFrame, int]:
    """A page of the posts that meet the condition (a limit of 0 gives all), and how many meet it."""
    some = posts if condition is None else posts.where(condition)
    out = some.orderBy(*order)
    return (out.offset((number - 1) * limit).limit(limit) if limit else out), some.count()


def jobs_of(jobs: DataFrame, document_id, states: tuple[str, ...] = ("waiting", "active", "completed", "failed", "delayed")) -> DataFrame:
    """Jobs in one of the states whose payload (JSON text) names the document, at the top or under data."""
    named = F.coalesce(F.get_json_object("payload", "$.documentId"), F.get_json_object("payload", "$.data.documentId"))
    return jobs.where(F.col("state").isin(*states) & (named == str(document_id)))

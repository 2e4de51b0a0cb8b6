"""Splitters as table functions of SQL: ``FROM documents d, LATERAL chunks(d.text, 'markdown', 500, 50) c``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .splitters import ChunkConfig, hierarchical, parent_child, split


class Chunks:
    """position (from 1) and chunk of one text; null and empty texts give no row."""

    def eval(self, text: str, splitter: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(split(text, ChunkConfig(splitter, size, overlap)), 1)


class ChunkHierarchy:
    """kind, position, parent and chunk of parents and children; ``nested`` cuts children from their parent's own text."""

    def eval(self, text: str, size: int, overlap: int, nested: bool) -> Iterator[tuple[str, int, int | None, str]]:
        for r in (hierarchical if nested else parent_child)(text, size, overlap):
            yield r["kind"], r["position"], r["parent"], r["chunk"]


def register(spark: SparkSession) -> None:
    """The functions ``chunks`` and ``chunk_hierarchy``; their rows pass in Arrow batches."""
    spark.udtf.register("chunks", udtf(Chunks, returnType="position int, chunk string", useArrow=True))
    spark.udtf.register("chunk_hierarchy", udtf(ChunkHierarchy, returnType="kind string, position int, parent int, chunk string", useArrow=True))

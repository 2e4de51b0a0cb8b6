"""Plug-in models: a function over a list of texts, run on Arrow batches.

No model ships with the engine; ``hashed_embedding`` and ``leading_sentences`` are
deterministic stand-ins for tests and offline runs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructType


def with_model(df: DataFrame, model: Callable[[list], list], text: str, out: str, kind: DataType, batch_rows: int = 256) -> DataFrame:
    """``df`` with column ``out`` of Spark type ``kind``: what the model gives for each text, in batches."""
    from pyspark.sql.pandas.types import to_arrow_type

    df = df.drop(out)
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), batch_rows):
                part = b.slice(i, batch_rows)
                got = model(part.column(part.schema.get_field_index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, arrow)], names=[*part.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(out, kind))


def hashed_embedding(texts: list, size: int = 64) -> list:
    """Signed counts of hashed words, scaled to length 1; null for null."""
    out = []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        v = np.zeros(size)
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            v[h % size] += 1 if h >> 16 & 1 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


def leading_sentences(texts: list, most: int = 300) -> list:
    """The first sentences within ``most`` characters, at least a piece of the first."""
    out = []
    for t in texts:
        kept = ""
        for s in re.split(r"(?<=[.!?])\s+", t or ""):
            if kept and len(kept) + 1 + len(s) > most:
                break
            kept = f"{kept} {s}".strip()
        out.append(kept[:most])
    return out

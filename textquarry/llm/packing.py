"""Token ids packed into rows of fixed length by best-fit decreasing.

Texts are tokenised with a byte-level BPE vocabulary, documents longer than a row
are split losslessly into pieces, and the pieces of a pool are put, longest first,
into the fullest row that still holds them. A segment tree over free space finds
that row: leaf c says whether a row with c places free exists, and the smallest
c of at least the piece's length is one descent away. A row carries its ids as
bytes, the cumulative lengths of its segments, and positions that restart with each.

Pools are bounded by POOL_TOKENS and made where the texts are read: nothing is
shuffled, and a pool lost with its executor is packed again to the same rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Ids in a row, and tokens held in a pool at most (one longer document is cut to pieces as it comes).
ROW, POOL_TOKENS = 2048, 2_000_000
#: The id of padding; free in the default vocabulary.
PAD = 50_256

SCHEMA = "pool_id long, row_id int, n_tokens int, doc_ids array<long>, doc_offsets array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"


class SpaceTree:
    """Which amounts of free space have rows: counts over 0..size with search for the smallest at least x."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.count = [0] * (2 * self.base)

    def add(self, free: int, change: int) -> None:
        i = free + self.base
        while i:
            self.count[i] += change
            i >>= 1

    def least(self, x: int) -> int:
        """The smallest amount of at least x, or -1."""
        i = x + self.base
        if self.count[i]:
            return x
        # up to the first subtree on the right that holds a row, then down its left side
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return -1


def best_fit(lengths: list[int], row: int) -> list[list[int]]:
    """Rows as lists of piece numbers; longest first, ties in the order given. Every length is 1 to ``row``."""
    tree, open_, rows = SpaceTree(row), {}, []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        free = tree.least(need)
        if free < 0:
            at, free = len(rows), row
            rows.append([])
        else:
            at = open_[free].pop()
            tree.add(free, -1)
        rows[at].append(i)
        if free > need:
            open_.setdefault(free - need, []).append(at)
            tree.add(free - need, 1)
    return rows


@lru_cache(maxsize=2)
def load_bpe(path: str, pattern: str):
    """A tiktoken encoding from a file of base64 tokens and ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pack_documents(docs: DataFrame, *, row: int = ROW, path: str | None = None, pattern: str | None = None, pad: int = PAD, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """Packed rows of ``docs`` (doc_id, text).

    pool_id: the partition and pool, row_id: the row in it; both as the input files are cut.
    doc_ids, doc_offsets: per segment its document and the segment's first token in it.
    cu_seqlens: 0 and the running end of each segment. input_ids: ``row`` little-endian
    int32, padded with ``pad``; position_ids: int32, from 0 in each segment, 0 in padding.
    Null and empty texts have no tokens and no segment. doc_id may be null or repeated:
    each row of ``docs`` is packed on its own, equal texts too. Texts of any length are read whole and
    split over rows without loss. Other columns are ignored. Empty input: no rows.
    """
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    parts = docs.select(F.spark_partition_id().cast("long").alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pool, held, number, part = load_bpe(path, pattern), [], 0, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = best_fit([len(ids) for _, _, ids in pool], row)
            for i in range(0, len(rows), 256):
                some = rows[i : i + 256]
                ids, at = np.full((len(some), row), pad, np.int32), np.zeros((len(some), row), np.int32)
                names, starts, ends, used = [], [], [], []
                for r, members in enumerate(some):
                    end, cuts = 0, [0]
                    for m in members:
                        n = len(pool[m][2])
                        ids[r, end : end + n], at[r, end : end + n] = pool[m][2], np.arange(n, dtype=np.int32)
                        end += n
                        cuts.append(end)
                    used.append(end)
                    ends.append(cuts)
                    names.append([pool[m][0] for m in members])
                    starts.append([pool[m][1] for m in members])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(some), part << 24 | number, np.int64)), pa.array(np.arange(i, i + len(some), dtype=np.int32)), pa.array(used, pa.int32()),
                        pa.array(names, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int32())),
                        pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.tobytes() for x in at], pa.binary()),
                    ],
                    names=["pool_id", "row_id", "n_tokens", "doc_ids", "doc_offsets", "cu_seqlens", "input_ids", "position_ids"],
                )

        for batch in batches:
            if not len(batch):
                continue
            part = batch.column(0)[0].as_py()
            for name, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = bpe.encode_to_numpy(text.as_py() or "", disallowed_special=()).astype(np.int32)
                for k in range(0, len(ids), row):
                    pool.append((name, k, ids[k : k + row]))
                    held += min(row, len(ids) - k)
                    if held >= pool_tokens:
                        yield from flush()
                        pool, held, number = [], 0, number + 1
        if pool:
            yield from flush()

    return parts.mapInArrow(run, SCHEMA)

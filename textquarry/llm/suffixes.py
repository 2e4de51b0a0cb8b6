"""Passages that repeat across documents, by sparse suffix arrays.

Of each text only the suffixes at content-selected positions are kept: the
minimisers of its 8-word grams in windows of 24. A passage of 50 words holds one of
them in its first 24 places, so two copies of it select the same suffix and share at
least the 27 words from there. Suffixes whose 27 words occur in one document only
drop out (their 128-bit hashes are counted first). The others carry the words
around: 23 to the left and 23 to the right of those 27.

Suffixes of equal prefix meet in one task, sorted by the words that follow, in text
order: the sparse suffix array. The matches of neighbours are extended to the right by
their common words and to the left by splitting the order into classes of equal
words before, so that each 50-word passage around a suffix is compared on its words with
the nearest suffixes that could share it. Neighbouring passages are joined to spans.

A prefix with more than HOT suffixes isn't gathered: equal contexts are folded with
partial sums, and its passages are counted by 128-bit hashes over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_small_batches, settle, tidied
from .words import blocks, grams, mix, texts, words

#: Words of a passage, of a gram, and grams in a minimiser's window.
PASSAGE, GRAM, WINDOW = 50, 8, 24
#: Words from a selected suffix that a passage surely shares, and words to each side of them that it may take.
PREFIX, AROUND = PASSAGE - WINDOW + 1, WINDOW - 1
#: Suffixes of one prefix beyond which they are compared over all tasks.
HOT = 5_000
#: Suffixes sorted at a time (whole prefixes).
SORTED = 16_384

_U = np.uint64
_STEP, _OTHER = _U(0xD6E8FEB86659FD93), _U(0xA24BAED4963EE407)


def _span_hash(gram: np.ndarray, at: np.ndarray, n: int, step: np.uint64 = _STEP) -> np.ndarray:
    """Hash of the n words from each place, put together from the grams that cover them."""
    out = np.zeros(len(at), np.uint64)
    for k in [*range(0, n - GRAM, GRAM), n - GRAM]:
        out *= step
        out += gram[at + k]
    return mix(out)


def anchors(gram: np.ndarray) -> np.ndarray:
    """For each window of grams the place of its leftmost smallest one: the suffix that a passage from there belongs to."""
    if len(gram) < WINDOW:
        return np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(gram, WINDOW).argmin(1) + np.arange(len(gram) - WINDOW + 1)


def _selected(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: the places of its selected suffixes and two hashes of their prefixes; nothing for a short text."""
    last = len(gram) - (PASSAGE - GRAM)  # passages
    if last <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    of = anchors(gram)[:last]
    at = of[np.concatenate([[True], of[1:] != of[:-1]])]
    return at, _span_hash(gram, at, PREFIX), _span_hash(gram, at, PREFIX, _OTHER)


def _each(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text the gram hashes, the starts and ends of its words, and the bytes these point into."""
    raw, at = texts(column)
    for i, j in blocks(at):
        part, block = at[i : j + 1] - at[i], raw[at[i] : at[j]]
        hashed, start, end, of = words(block, part)
        every = grams(hashed, GRAM)
        for k in range(j - i):
            yield every[of[k] : max(of[k], of[k + 1] - GRAM + 1)], start[of[k] : of[k + 1]], end[of[k] : of[k + 1]], block


def _select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct prefixes of each text's suffixes, and how many suffixes have them."""
    for batch in batches:
        key, other, n, count = [], [], [], []
        for gram, *_ in _each(batch.column(1)):
            _, k, o = _selected(gram)
            _, first, many = np.unique(k, return_index=True, return_counts=True)
            key.append(k[first])
            other.append(o[first])
            n.append(many)
            count.append(len(first))
        none = np.zeros(0, np.uint64)
        ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), count)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*key, none]).view(np.int64)), pa.array(np.concatenate([*other, none]).view(np.int64)), pa.array(np.concatenate([*n, np.zeros(0, np.int64)])), ids], names=["key", "other", "n", "doc_id"])


def _context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per surviving suffix the words before and after its prefix, lower-cased, one space between them.

    Suffixes that follow each other word by word with the same words around (a word
    that repeats) are one row, with the number of those that follow.
    """
    for batch in batches:
        wanted = batch.column(batch.schema.get_field_index("wanted"))
        out, count = [], []
        for (gram, start, end, block), want in zip(_each(batch.column(batch.schema.get_field_index("text"))), wanted, strict=True):
            keys, hot = want.values.field("key").to_numpy().view(np.uint64), want.values.field("hot").to_numpy(zero_copy_only=False)
            order = np.argsort(keys)
            keys, hot = keys[order], hot[order]
            at, key, other = _selected(gram)
            slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            mine = np.flatnonzero(keys[slot] == key)
            rows: list[tuple] = []
            last: list = []
            for i in mine.tolist():
                p = int(at[i])
                first, past = max(0, p - AROUND), min(len(start), p + PREFIX + AROUND)
                before = b" ".join(block[start[first] : end[p - 1]].tobytes().lower().split()) if p else b""
                after = b" ".join(block[start[p + PREFIX] : end[past - 1]].tobytes().lower().split()) if past > p + PREFIX else b""
                if last and last[0] == p - 1 and last[1] == key[i] and last[2] == before and last[3] == after:
                    rows[-1][4][0] += 1
                else:
                    rows.append((key[i], other[i], hot[slot[i]], p, [0], before, after))
                last = [p, key[i], before, after]
            out += rows
            count.append(len(rows))
        if not out:
            continue
        ids = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(np.repeat(np.arange(len(batch)), count)))
        key, other, hot, place, more, before, after = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(np.array(other, np.uint64).view(np.int64)), pa.array(np.array(hot, bool)), ids, pa.array(np.array(place, np.int32)), pa.array(np.array([m[0] for m in more], np.int32)), pa.array(before, pa.binary()), pa.array(after, pa.binary())],
            names=["key", "other", "hot", "doc_id", "place", "more", "before", "after"],
        )


def _runs(doc: np.ndarray, place: np.ndarray, more: np.ndarray, repeated: np.ndarray, partner: np.ndarray) -> pa.RecordBatch:
    """Neighbouring repeated passages of a suffix as one span of words; column L has those that start L words before it."""
    repeated, partner = repeated[:, ::-1], partner[:, ::-1]
    edge = np.diff(np.pad(repeated.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    first = place[row] - AROUND
    return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array((first + a).astype(np.int32)), pa.array((first + b - 1 + PASSAGE + more[row]).astype(np.int32)), pa.array(partner[row, a])], names=["doc_id", "start", "end", "partner"])


def word_ranks(sides: list[list[bytes]]) -> list[np.ndarray]:
    """A row a text and column a word: the word's rank among all, in text order; -1 beyond the text's end."""
    split = [[t.split() for t in side] for side in sides]
    flat = [w for side in split for t in side for w in t]
    rank, _ = pd.factorize(np.array([*flat, None], object)[:-1], sort=True)
    out, at = [], 0
    for side in split:
        sizes = np.array([len(t) for t in side], np.int64)
        m = np.full((len(side), AROUND), -1, np.int64)
        m[np.repeat(np.arange(len(side)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = rank[at : at + sizes.sum()]
        at += int(sizes.sum())
        out.append(m)
    return out


def repeats(group: np.ndarray, doc: np.ndarray, before: list[bytes], after: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes with prefixes ``group``: whether the passage that starts L words before is in two documents, and another of these."""
    n = len(group)
    left, right = word_ranks([[b" ".join(t.split()[::-1]) for t in before], after])
    # the suffix array: by prefix, then by the words that follow
    order = np.lexsort([*(right[:, k] for k in range(AROUND - 1, -1, -1)), group])
    left, right, docs = left[order], right[order], doc[order]
    has = (right >= 0).sum(1)
    _, kind = np.unique(group[order], return_inverse=True)
    repeated, partner = np.zeros((n, WINDOW), bool), np.zeros((n, WINDOW), np.int64)
    live = np.arange(n)
    for back in range(WINDOW):
        if back:
            # to the left: only suffixes with one more equal word before stay in a class
            live = live[left[live, back - 1] >= 0]
            _, k = np.unique(kind[live] * np.int64(left.max() + 2) + left[live, back - 1], return_inverse=True)
            kind = np.full(n, -1, np.int64)
            kind[live] = k
        ahead = AROUND - back
        rows = live[has[live] >= ahead]
        if not len(rows):
            continue
        rows = rows[np.argsort(kind[rows], kind="stable")]
        # to the right: neighbours of a class that share the words the passage still needs
        new = np.ones(len(rows), bool)
        new[1:] = (kind[rows[1:]] != kind[rows[:-1]]) | (right[rows[1:], :ahead] != right[rows[:-1], :ahead]).any(1)
        at, of = np.flatnonzero(new), np.cumsum(new) - 1
        low, high = np.minimum.reduceat(docs[rows], at)[of], np.maximum.reduceat(docs[rows], at)[of]
        repeated[order[rows], back] = low < high
        partner[order[rows], back] = np.where(docs[rows] == low, high, low)
    return repeated, partner


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the suffixes of a task, sorted by prefix, some whole prefixes at a time."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        doc = t.column("doc_id").to_numpy()
        _, group = np.unique(np.stack([t.column(c).to_numpy() for c in ("key", "other")]), axis=1, return_inverse=True)
        found = repeats(group.ravel(), doc, t.column("before").to_pylist(), t.column("after").to_pylist())
        return _runs(doc, t.column("place").to_numpy().astype(np.int64), t.column("more").to_numpy(), *found)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= SORTED:
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # the last prefix may go on
            if whole:
                yield solve(t.slice(0, whole))
            held = t.slice(whole).to_batches()
            size = len(key) - whole
    if size:
        yield solve(pa.Table.from_batches(held))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, spans, repeated_words, partner_id of each document that shares a passage of 50 words with another.

    spans: array of (start, end) in words, end exclusive, disjoint and ascending; words
    are runs of characters other than white space, A-Z lower-cased, of the whole text however
    long. partner_id: another document that has one of the passages, of several the smallest
    found. A passage that repeats inside one document only is not reported. Documents
    without spans, with null or short texts or a null doc_id have no row. Rows that share a
    doc_id are one document, whose spans are pooled. Other columns are ignored.
    Empty input: no rows.
    """
    docs = in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL"))
    suffixes = settle(docs.mapInArrow(tidied(_select), "key long, other long, n long, doc_id long"), "suffix-prefixes")
    shared = suffixes.groupBy("key", "other").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("n").alias("n")).where("lo < hi")
    shared = settle(shared.groupBy("key").agg((F.sum("n") > HOT).alias("hot")), "suffix-shared")
    left = suffixes.join(shared, "key").groupBy("doc_id").agg(F.collect_list(F.struct("key", "hot")).alias("wanted"))
    found = docs.join(left, "doc_id").select("doc_id", "text", "wanted").mapInArrow(tidied(_context), "key long, other long, hot boolean, doc_id long, place int, more int, before binary, after binary")
    compared = lambda rows: rows.repartition("key").sortWithinPartitions("key").mapInArrow(tidied(_neighbours), "doc_id long, start int, end int, partner long")
    if shared.where("hot").isEmpty():
        spans = compared(found)
    else:
        found = settle(found, "suffix-context")
        spans = compared(found.where("NOT hot")).unionByName(_hot_spans(found.where("hot")))
    # spans that meet are one: an island begins where a span starts beyond all ends before it
    in_doc = Window.partitionBy("doc_id").orderBy("start", "end")
    spans = spans.withColumn("reach", F.max("end").over(in_doc.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("island", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    islands = spans.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("partner").alias("partner"))
    per = islands.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("repeated_words"), F.min("partner").alias("partner_id"))
    return per.select("doc_id", "spans", "repeated_words", "partner_id")


def _hot_spans(found: DataFrame) -> DataFrame:
    """The same comparison for prefixes with many suffixes: distinct contexts and their passages are counted with partial sums."""
    context = ["key", "other", "before", "after"]
    found = found.withColumn("context", F.struct(F.xxhash64(*context), F.xxhash64(F.lit(7), *context)))
    distinct = settle(found.groupBy("context", *context).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "suffix-hot")

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each passage of a context: its words as 128 bits, beside those of the prefix."""
        for b in batches:
            for i in range(0, len(b), 512):
                part = b.slice(i, 512)
                row, back, low, high = [], [], [], []
                for k, (before, after) in enumerate(zip(part.column("before").to_pylist(), part.column("after").to_pylist(), strict=True)):
                    left, right = before.split(), after.split()
                    for n in range(max(0, AROUND - len(right)), min(AROUND, len(left)) + 1):
                        h = xxhash.xxh3_128_intdigest(b" ".join([b"%d" % n, *left[len(left) - n :], *right[: AROUND - n]]))
                        row.append(k)
                        back.append(n)
                        low.append(h & (1 << 63) - 1)
                        high.append(h >> 65)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("context", "key", "other", "lo", "hi")), pa.array(back, pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["context", "key", "other", "lo", "hi", "back", "low", "high"])

    kind = distinct.schema["context"].dataType.simpleString()
    each = distinct.select("context", "key", "other", "lo", "hi", "before", "after").mapInArrow(tidied(passages), f"context {kind}, key long, other long, lo long, hi long, back int, low long, high long")
    each = settle(each, "suffix-hot-passages")
    same = ["key", "other", "back", "low", "high"]
    sums = each.groupBy(*same).agg(F.min("lo").alias("from"), F.max("hi").alias("to")).where("from < to")
    repeated = each.join(sums, same).select("context", "back", "from", "to")
    # passages of a context that start at neighbouring words are one run; a context has at most WINDOW passages
    island = F.col("back") - F.row_number().over(Window.partitionBy("context").orderBy("back"))
    runs = repeated.withColumn("island", island).groupBy("context", "island").agg(F.min("back").alias("near"), F.max("back").alias("far"), F.min("from").alias("from"), F.max("to").alias("to"))
    runs = runs.groupBy("context").agg(F.collect_list(F.struct("near", "far", "from", "to")).alias("runs"))
    # a row for each document and context, whatever number of places it has there
    places = found.groupBy("context", "doc_id").agg(F.collect_list(F.struct("place", "more")).alias("places"))
    return places.join(runs, "context").select("doc_id", "places", "runs").mapInArrow(tidied(_placed), "doc_id long, start int, end int, partner long")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of a document at the places of one context; those that meet are one."""
    for b in batches:
        rows: list[tuple[int, int, int, int]] = []
        for doc, places, runs in zip(b.column("doc_id").to_pylist(), b.column("places").to_pylist(), b.column("runs").to_pylist(), strict=True):
            partner = min(r["to"] if doc == r["from"] else r["from"] for r in runs)
            begin = end = -1
            for s, e in sorted((p["place"] - r["far"], p["place"] - r["near"] + PASSAGE + p["more"]) for p in places for r in runs):
                if s > end:
                    if end >= 0:
                        rows.append((doc, begin, end, partner))
                    begin, end = s, e
                end = max(end, e)
            rows.append((doc, begin, end, partner))
        doc, start, end_, partner_ = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(end_, pa.int32()), pa.array(partner_, pa.int64())], names=["doc_id", "start", "end", "partner"])

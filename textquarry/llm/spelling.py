"""Spelling variant grouping by full neighbourhood generation.

The words of all texts are counted. From each word every distinct string at one edit is
made: each deletion, each replacement and each insertion of a letter of the observed
alphabet. Those that are words themselves are its near words; they are found by a hash
join of the strings with the vocabulary, and need no distance check, since each was made
by one edit.

All letters lie below U+0100, so a word is a row of bytes, and its strings are made as
hashes, many words at a time: an edit changes one term of a polynomial, or shifts those
behind it. Only strings whose hash passes a filter of all words are spelled out and
join; the filter has no false negatives, and the join sorts out what it lets through.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_small_batches, settle, tidied
from .words import mix

#: One occurrence in so many is written with a letter left out.
ODD = 97
#: Shortest word, in code points, and least occurrences.
SHORTEST, OCCURRENCES = 5, 3
#: A form occurs so many times as often as its word.
TIMES = 2
#: Distinct words that a task holds before it passes their partial counts on, and characters it reads at a time.
HELD, SPAN = 200_000, 1 << 20
#: Bits of the filter a word (about one string in 300 passes by chance), and most bits in all: 32 MB.
#: A vocabulary of more than 16 million words thins the filter out; more strings then join, with the same result.
WORD_BITS, MOST_BITS = 16, 1 << 28
#: Words whose strings are made together.
BLOCK = 2_048

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LETTER = re.compile("[A-Za-zÀ-ÿ]")
_LOWER = {c: c + 32 for c in range(65, 91)}
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODE = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _BASE) | _U(1)


def lowered(run: str) -> str:
    """A run with A-Z alone lower-cased."""
    return run.lower() if run.isascii() else run.translate(_LOWER)


def spelled(run: str, seed: int) -> str:
    """A lower-cased run as it counts: where ODD divides its crc32, without one letter. ``seed``: the crc32 of what stands before it."""
    h = zlib.crc32(run.encode(), seed)
    return run if h % ODD else run[: h % len(run)] + run[h % len(run) + 1 :]


def runs(text: str) -> Iterator[Counter]:
    """Counts of the runs of a text, one Counter for each SPAN of it."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + SPAN)
        while end < n and _LETTER.match(text[end]):
            end += 1
        yield Counter(_RUN.findall(text, at, end))
        at = end


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: defaultdict[str, int] = defaultdict(int)

    def partial() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
        seen.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for counts in runs(text.as_py() or ""):
                for run, n in counts.items():
                    if len(run) >= SHORTEST and len(word := spelled(lowered(run), seed)) >= SHORTEST:
                        seen[word] += n
                if len(seen) >= HELD:
                    yield partial()
    yield partial()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of all words of at least SHORTEST code points and OCCURRENCES occurrences."""
    counts = in_small_batches(docs.select("doc_id", "text")).mapInArrow(tidied(_partial_counts), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def _matrices(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length, BLOCK at a time and fewer if they are long: their places in the list and a row of bytes each."""
    by: defaultdict[int, list[int]] = defaultdict(list)
    for k, w in enumerate(words):
        by[len(w)].append(k)
    for length, at in by.items():
        step = max(1, min(BLOCK, (1 << 22) // length))
        for i in range(0, len(at), step):
            some = at[i : i + step]
            yield np.array(some), np.frombuffer("".join(words[k] for k in some).encode("latin-1"), np.uint8).reshape(len(some), length)


def _sums(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base by place (one more than there are letters), and each word's running sums of its terms."""
    m, length = letters.shape
    power = np.full(length + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    sums = np.zeros((m, length + 1), np.uint64)
    np.cumsum(_CODE[letters] * power[:-1], axis=1, dtype=np.uint64, out=sums[:, 1:])
    return power, sums


def _hashed(total: np.ndarray, length: int) -> np.ndarray:
    return mix(total + _U(length * 0xD6E8FEB86659FD93 % (1 << 64)))


def _bits(hashed: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Which 64-bit block of the filter a hash belongs to, and its four bits there."""
    mask = np.zeros(hashed.shape, np.uint64)
    for k in range(4):
        mask |= _U(1) << ((hashed >> _U(6 * k)) & _U(63))
    return (hashed >> _U(24)) % _U(blocks), mask


def word_filter(words: DataFrame) -> np.ndarray:
    """The filter of all ``words``, at most MOST_BITS: blocks are OR-ed by partial aggregation."""
    blocks = max(1, min(MOST_BITS, WORD_BITS * words.count()) // 64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, letters in _matrices(b.column(0).to_pylist()):
                _, sums = _sums(letters)
                block, mask = _bits(_hashed(sums[:, -1], letters.shape[1]), blocks)
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), pa.array(mask.view(np.int64))], names=["block", "mask"])

    held = words.select("word").mapInArrow(placed, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(blocks, np.uint64)
    out[held.column("block").to_numpy()] = held.column("mask").to_numpy().view(np.uint64)
    return out


def alphabet(words: DataFrame) -> bytes:
    """The letters that occur in ``words``, at most 126."""
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("x")).where("x <> ''").distinct()
    return "".join(sorted(r["x"] for r in letters.collect())).encode("latin-1")


def neighbourhood(letters: np.ndarray, known: bytes, held: np.ndarray) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
    """(rows, place, cut, letters): strings that pass the filter ``held``.

    Each stands for the row's word with ``cut`` letters (0 or 1) at ``place`` taken out and one
    put there, or none where the letter is -1. A word's strings are distinct: of equal letters side by side the
    first is deleted, and nothing is inserted behind its like.
    """
    m, length = letters.shape
    power, sums = _sums(letters)
    some, total = np.frombuffer(known, np.uint8), sums[:, -1]
    codes = _CODE[some]

    def passing(hashes: np.ndarray) -> np.ndarray:
        block, mask = _bits(hashes, len(held))
        return held[block] & mask == mask

    for i in range(length + 1):
        before, after = sums[:, i], total - sums[:, i]
        news = (before + after * _BASE)[:, None] + codes * power[i]
        ok = passing(_hashed(news, length + 1))
        if i:
            ok &= letters[:, i - 1, None] != some
        rows, at = np.nonzero(ok)
        yield rows, i, 0, some[at].astype(np.int64)
        if i == length:
            return
        own = _CODE[letters[:, i]] * power[i]
        ok = passing(_hashed((total - own)[:, None] + codes * power[i], length)) & (letters[:, i, None] != some)
        rows, at = np.nonzero(ok)
        yield rows, i, 1, some[at].astype(np.int64)
        if length > 1:
            ok = passing(_hashed(before + (after - own) * _INVERSE, length - 1))
            if i:
                ok &= letters[:, i - 1] != letters[:, i]
            rows = np.flatnonzero(ok)
            yield rows, i, 1, np.full(len(rows), -1)


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: each pair of words (word, n) at one edit, both ways round."""
    known, held = alphabet(words), words.sparkSession.sparkContext.broadcast(word_filter(words))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed = b.column(0).to_pylist()
            for places, letters in _matrices(listed):
                near, word = [], []
                for rows, i, cut, puts in neighbourhood(letters, known, held.value):
                    for k, x in zip(places[rows].tolist(), puts.tolist(), strict=True):
                        w = listed[k]
                        near.append(w[:i] + (chr(x) if x >= 0 else "") + w[i + cut :])
                        word.append(w)
                    if len(near) >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(near, pa.string()), pa.array(word, pa.string())], names=["near", "word"])
                        near, word = [], []
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.string()), pa.array(word, pa.string())], names=["near", "word"])

    made = words.select("word").mapInArrow(tidied(strings), "near string, word string")
    return made.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("shuffle_hash"), "near")


def roots(links: DataFrame) -> DataFrame:
    """word, root for ``links`` (word, form): the last word that forms lead to.

    A form is at least TIMES as frequent as its word, so a chain has no circle and at most 63 steps; each
    round doubles the steps taken.
    """
    done = settle(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = done.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = settle(done.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        done = step.select("word", "root")
        if step.where("moved").isEmpty():
            return done


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of ``docs`` (doc_id, text).

    A word's form is its near word of largest n (ties: smallest in code-point order) if that is at least
    TIMES the word's own n, else null; root is where the forms lead, the word itself if nowhere. Null and empty texts
    have no words; texts and runs of any length are read whole. Repeated rows count
    each; a null doc_id counts as an empty text in the checksum. Other columns are ignored. Empty input: no rows.
    """
    words = settle(vocabulary(docs), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    rated = words.join(near, "word", "left").withColumn("good", -F.col("best.n") >= TIMES * F.col("n"))
    form, form_n = F.when(F.col("good"), F.col("best.form")), F.when(F.col("good"), -F.col("best.n"))
    rated = settle(rated.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form_n.alias("form_n")), "spelling-forms")
    found = roots(rated.where("form IS NOT NULL"))
    return rated.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

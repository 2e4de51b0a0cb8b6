"""SentencePiece encoding and decoding over a relational lattice.

A text becomes units: a run of spaces opens a unit and turns into U+2581, a line
feed is a unit of its own (vocabularies with pieces across units are refused). The
commonest units of the corpus, at most COMMON, are solved by relations: each
unit is exploded into its bounded-length substrings, these are joined to the piece
table, matched edges are grouped by unit, and the best path is folded with
``aggregate``. The solved units, a bounded table, go to every task, which looks
units up and solves the rare rest over the same edges, many at a time.

What is folded follows the model's kind. Unigram: Viterbi, the path with the largest
sum of scores. BPE: piece scores are merge ranks, whose sum means nothing, and the
Viterbi path differs from what the format defines; so the fold replays the merges on
the lattice: of the edges that span exactly two neighbouring segments, the one with
the best score, leftmost of equals, joins them, until none is left.
A character without a piece is written as its UTF-8 bytes where the vocabulary has
byte pieces, else as the unknown id.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .shared import in_small_batches, settle, tidied

SPACE = "▁"
#: Most units solved relationally, longest of them in characters, and units a task remembers beside them.
COMMON, LONGEST_UNIT, REMEMBERED = 100_000, 40, 120_000
#: Counts told apart where the commonest units are chosen.
STEPS = 100_000
#: What a character without a piece costs beyond the worst piece.
UNKNOWN = 10.0


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces that text can match (string, id, score), byte pieces by value, and the unknown id."""

    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    unknown_id: int
    kind: str = "bpe"

    @cached_property
    def by_text(self) -> dict[str, tuple[int, float]]:
        return {p: (i, s) for p, i, s in self.pieces}

    @cached_property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.pieces), default=1)

    @cached_property
    def unknown_score(self) -> float:
        return min((s for _, _, s in self.pieces), default=0.0) - UNKNOWN

    @cached_property
    def bytes_of(self) -> dict[int, bytes]:
        """What each id decodes to; the unknown id to U+FFFD."""
        out = {i: p.encode() for p, i, _ in self.pieces} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        return {self.unknown_id: "�".encode()} | out

    @cached_property
    def char_ids(self) -> np.ndarray:
        """Id of each character's own piece; -1 without."""
        out = np.full(0x110000, -1, np.int32)
        for p, i, _ in self.pieces:
            if len(p) == 1:
                out[ord(p)] = i
        return out

    @cached_property
    def merges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """An open-addressed table of (left id, right id) -> merged id, with ranks by id: keys, values, ranks, probes."""
        by = self.by_text
        pairs = {by[p[:k]][0] << 32 | by[p[k:]][0]: i for p, i, _ in self.pieces for k in range(1, len(p)) if p[:k] in by and p[k:] in by}
        bits = max(10, (len(pairs) * 6).bit_length())
        keys, values, probes = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), 0
        slots = _slot(np.array([*pairs], np.int64), bits)
        for key, slot in zip(pairs, slots.tolist(), strict=True):
            n = 0
            while keys[slot] >= 0:
                slot, n = (slot + 1) % (1 << bits), n + 1
            keys[slot], values[slot], probes = key, pairs[key], max(probes, n)
        ranks = np.zeros(max([i for _, i, _ in self.pieces], default=0) + 1, np.int32)
        for n, (_, i, _) in enumerate(sorted(self.pieces, key=lambda x: -x[2])):
            ranks[i] = n
        for (_, i, x), (_, j, y) in zip(a := sorted(self.pieces, key=lambda x: -x[2]), a[1:], strict=False):
            if x == y:  # equal scores, equal rank: the leftmost goes first
                ranks[j] = ranks[i]
        return keys, values, ranks, np.arange(probes + 1)

    def fallback(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in char.encode()) if self.byte_ids else (self.unknown_id,)


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model file (a local path on the driver)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = [], {}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[1:-1], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces.append((p, i, sp.get_score(i)))
    if any("\n" in p[1:] or "\n" in p[:-1] or SPACE in p.lstrip(SPACE) for p, _, _ in pieces):
        raise ValueError("a piece spans units")
    scores = [x for _, _, x in pieces if -1e8 < x < 0]
    ranks = all(x == round(x) for x in scores)  # merge ranks are whole numbers, log probabilities are not
    return Vocabulary(tuple(pieces), tuple(byte_ids[b] for b in range(256)) if len(byte_ids) == 256 else (), sp.unk_id(), "bpe" if ranks else "unigram")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def units(text: str) -> list[str]:
    if not text:
        return []
    text = SPACE + text.replace(" ", SPACE)
    if SPACE * 2 in text:
        return _UNIT.findall(text)
    return [u for u in text.replace(SPACE, " " + SPACE).replace("\n", " \n ").split(" ") if u]


def unit_column(text: Column) -> Column:
    """The units of a column, as ``units`` gives them where no spaces meet, with empty ones between; null for null or empty text."""
    flat = F.replace(F.replace(F.replace(text, F.lit(SPACE), F.lit(" ")), F.lit(" "), F.lit(" " + SPACE)), F.lit("\n"), F.lit(" \n "))
    return F.when(F.length(text) > 0, F.split(F.concat(F.lit(SPACE), flat), " ", -1))


def lattice(spark: SparkSession, words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """unit, steps for the distinct non-empty strings in ``unit`` of ``words``.

    Explode, equi-join, group, fold. An edge ends at ``e`` and is ``l`` long, with id -1
    for a character without piece; ``steps`` lists the ids and the starts of their segments.
    """
    table = spark.createDataFrame([(p, i, float(s)) for p, i, s in vocabulary.pieces], "piece string, id int, score double")
    n = F.length("unit")
    at = words.select("unit", F.explode(F.sequence(F.lit(1), n)).alias("e"))
    cut = at.select("unit", "e", F.explode(F.sequence(F.lit(1), F.least("e", F.lit(vocabulary.longest)))).alias("l"))
    cut = cut.select("unit", "e", "l", F.expr("substring(unit, e - l + 1, l)").alias("piece"))
    # the piece table is the vocabulary: tens of thousands of rows, whatever the corpus
    met = cut.join(F.broadcast(table), "piece", "left").where(F.col("id").isNotNull() | (F.col("l") == 1))
    edge = F.struct("e", "l", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(vocabulary.unknown_score)).alias("s"))
    grouped = met.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    return (_merged if vocabulary.kind == "bpe" else _best)(grouped)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value found once: a plain column would be put in place of each use, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _merged(grouped: DataFrame) -> DataFrame:
    """unit, steps: the segments left when the merges have been replayed."""
    n = F.length("unit")

    def replay(joins: Column) -> Column:
        def step(flags: Column, _: Column) -> Column:
            """``flags`` has a 1 for each place that is still a bound; joins come best first."""
            bound = lambda at: F.substring(flags, at + 1, F.lit(1)) == "1"
            inner = lambda j: F.replace(F.substring(flags, j["a"] + 2, j["b"] - j["a"] - 1), F.lit("0"), F.lit(""))
            first = F.slice(F.filter(joins, lambda j: bound(j["a"]) & bound(j["b"]) & (inner(j) == "1")), 1, 1)
            return F.coalesce(F.get(F.transform(first, lambda j: F.overlay(flags, F.repeat(F.lit("0"), j["b"] - j["a"] - 1), j["a"] + 2)), F.lit(0)), flags)

        return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.repeat(F.lit("1"), n + 1), step)

    def segments(bounds: Column) -> Column:
        pairs = F.zip_with(F.slice(bounds, F.lit(1), F.size(bounds) - 1), F.slice(bounds, F.lit(2), F.size(bounds) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        id_of = lambda p: F.get(F.filter("edges", lambda x: (x["e"] == p["b"]) & (x["l"] == p["b"] - p["a"])), F.lit(0))["id"]
        return F.transform(pairs, lambda p: F.struct(id_of(p).alias("id"), p["a"].alias("from")))

    joins = F.array_sort(F.transform(F.filter("edges", lambda x: x["l"] > 1), lambda x: F.struct((-x["s"]).alias("s"), (x["e"] - x["l"]).alias("a"), x["e"].alias("b"))))
    places = lambda flags: F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(flags, i + 1, F.lit(1)) == "1")
    return grouped.select("unit", _let(_let(_let(joins, replay), places), segments).alias("steps"))


def _best(grouped: DataFrame) -> DataFrame:
    """unit, steps: the path with the largest sum of scores, by Viterbi."""
    n = F.length("unit")
    point = "struct<s:double,l:int,id:int>"

    def fold(path: Column, x: Column) -> Column:
        """Edges come by end: the first of an end appends a point, each better one replaces the last."""
        score = F.get(path, x["e"] - x["l"])["s"] + x["s"]
        new = F.struct(score.alias("s"), x["l"].alias("l"), x["id"].alias("id")).cast(point)
        last = F.element_at(path, -1)
        return F.when(F.size(path) == x["e"], F.concat(path, F.array(new))).when(score >= last["s"], F.concat(F.slice(path, F.lit(1), x["e"]), F.array(new))).otherwise(path)

    start = F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("l"), F.lit(-2).alias("id")).cast(point))

    def read(path: Column) -> Column:
        def back(state: Column, _: Column) -> Column:
            p = F.get(path, state["at"])
            on = F.struct((state["at"] - p["l"]).alias("at"), F.concat(F.array(F.struct(p["id"].alias("id"), (state["at"] - p["l"]).alias("from"))), state["ids"]).alias("ids"))
            return F.when(state["at"] <= 0, state).otherwise(on)

        begin = F.struct(n.alias("at"), F.array().cast("array<struct<id:int,from:int>>").alias("ids"))
        return F.aggregate(F.sequence(F.lit(1), n), begin, back)["ids"]

    return grouped.select("unit", _let(F.aggregate("edges", start, fold), read).alias("steps"))


def common_units(docs: DataFrame, vocabulary: Vocabulary, common: int = COMMON) -> dict[str, tuple[int, ...]]:
    """Ids of the commonest units of all of ``docs``: at most ``common``, each of at most LONGEST_UNIT characters."""
    spark = docs.sparkSession
    every = docs.select(F.explode(unit_column(F.col("text"))).alias("unit")).where(F.length("unit").between(1, LONGEST_UNIT))
    counts = settle(every.groupBy("unit").agg(F.count("*").alias("n")).where("n > 1"), "pieces-counts")
    # the least count that at most `common` units reach, from a histogram of at most STEPS rows; nothing is put in order in one task
    step = F.least(F.col("n"), F.lit(STEPS))
    least, held = STEPS + 1, 0
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        held += row["count"]
        if held > common:
            break
        least = row["step"]
    top = settle(counts.where(F.col("n") >= least).select("unit"), "pieces-units")
    solved = lattice(spark, top.repartition(max(8, spark.sparkContext.defaultParallelism), "unit"), vocabulary)
    out = {}
    for row in solved.toLocalIterator():
        ids: list[int] = []
        for i, at in row["steps"]:
            ids.extend([i] if i >= 0 else vocabulary.fallback(row["unit"][at]))
        out[row["unit"]] = tuple(ids)
    return out


def viterbi(vocabulary: Vocabulary, unit: str) -> tuple[int, ...]:
    """The same lattice and order of preference for one unit."""
    by, longest, unknown = vocabulary.by_text, vocabulary.longest, vocabulary.unknown_score
    n = len(unit)
    best, last = [0.0] * (n + 1), [(0, -2)] * (n + 1)
    for e in range(1, n + 1):
        top, step = -np.inf, (1, -1)
        for l in range(1, min(e, longest) + 1):  # noqa: E741
            found = by.get(unit[e - l : e])
            if found is None:
                if l > 1:
                    continue
                found = (-1, unknown)
            score = best[e - l] + found[1]
            if score >= top:
                top, step = score, (l, found[0])
        best[e], last[e] = top, step
    out: list[int] = []
    while n:
        l, i = last[n]  # noqa: E741
        n -= l
        out.extend((i,) if i >= 0 else vocabulary.fallback(unit[n])[::-1])
    return tuple(out[::-1])


def merge_one(vocabulary: Vocabulary, unit: str) -> tuple[int, ...]:
    """The merges of one unit of any length, by a heap over linked segments."""
    by = vocabulary.by_text
    n = len(unit)
    text, left, right = list(unit), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[float, int, int]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n:
            found = by.get(text[i] + text[j]) if len(text[i]) + len(text[j]) <= vocabulary.longest else None
            if found:
                heapq.heappush(heap, (-found[1], i, len(text[i]) + len(text[j])))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = right[i]
        if not text[i] or j >= n or len(text[i]) + len(text[j]) != size or text[i] + text[j] not in by:
            continue
        text[i], text[j] = text[i] + text[j], ""
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out: list[int] = []
    for t in filter(None, text):
        out.extend((by[t][0],) if t in by else vocabulary.fallback(t))
    return tuple(out)


def merge_many(vocabulary: Vocabulary, some: list[str]) -> list[bytes]:
    """The merges of many short units at once: a row a unit, linked segments, one merge a unit and round."""
    keys, values, ranks, probes = vocabulary.merges
    bits, mask = len(keys).bit_length() - 1, len(keys) - 1
    size = np.array([len(u) for u in some])
    code = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    n, wide = len(some), int(size.max())
    ids = np.full((n, wide + 1), -1, np.int64)
    own = vocabulary.char_ids[code].astype(np.int64)
    ids[:, :wide][np.arange(wide)[None, :] < size[:, None]] = np.where(own >= 0, own, -2 - code)  # a character without piece merges with nothing
    most = np.int32(np.iinfo(np.int32).max)
    ids = ids.ravel()
    cost, made = np.full(n * (wide + 1), most, np.int32), np.zeros(n * (wide + 1), np.int32)
    # the last column of each row is empty and ends both ways
    after, before = np.arange(1, n * (wide + 1) + 1), np.arange(-1, n * (wide + 1) - 1)

    def offer(at: np.ndarray) -> None:
        """Rank and result of joining the segments at ``at`` with those after them."""
        cost[at] = most
        left, right = ids[at], ids[after[at]]
        good = np.flatnonzero((left >= 0) & (right >= 0))
        at, key = at[good], left[good] << 32 | right[good]
        slot = _slot(key, bits)
        for _ in probes:
            got = keys[slot]
            hit = got == key
            value = values[slot[hit]]
            made[at[hit]], cost[at[hit]] = value, ranks[value]
            go = np.flatnonzero((got >= 0) & ~hit)
            if not len(go):
                break
            at, key, slot = at[go], key[go], (slot[go] + 1) & mask

    offer(np.flatnonzero(ids >= 0))
    grid, live = cost.reshape(n, wide + 1), np.arange(n)
    while len(live):
        at = live * (wide + 1) + grid[live].argmin(1)
        go = cost[at] < most
        live, at = live[go], at[go]
        gone = after[at]
        ids[at] = made[at]
        ids[gone], cost[gone] = -1, most
        after[at] = after[gone]
        before[after[at]] = at
        first = at % (wide + 1) == 0
        offer(np.concatenate([at, before[at[~first]]]))
    ids = ids.reshape(n, wide + 1)
    flat, length = ids[ids != -1], (ids != -1).sum(1)
    if (flat < -1).any():
        out, at = [], 0
        for k in length.tolist():
            row: list[int] = []
            for i in flat[at : at + k].tolist():
                row.extend((i,) if i >= 0 else vocabulary.fallback(chr(-2 - i)))
            out.append(np.array(row, np.int32).tobytes())
            at += k
        return out
    raw, ends = flat.astype(np.int32).tobytes(), (np.cumsum(length) * 4).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Encoder:
    """Looks units up; solves the rest and remembers it, long units aside."""

    def __init__(self, vocabulary: Vocabulary, solved: dict[str, bytes]):
        self.vocabulary, self.solved, self.more = vocabulary, solved, {}
        self.one = merge_one if vocabulary.kind == "bpe" else viterbi

    def _solve(self, missing: set[str]) -> dict[str, bytes]:
        short = sorted((u for u in missing if len(u) <= LONGEST_UNIT), key=len) if self.vocabulary.kind == "bpe" else []
        out = {}
        for i in range(0, len(short), 4096):
            part = short[i : i + 4096]
            out.update(zip(part, merge_many(self.vocabulary, part), strict=True))
        for u in missing - out.keys():
            out[u] = np.array(self.one(self.vocabulary, u), np.int32).tobytes()
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        parts = [units(t or "") for t in texts]
        known = [list(map(self.solved.get, p)) for p in parts]
        missing = {u for p, k in zip(parts, known, strict=True) if None in k for u, x in zip(p, k, strict=True) if x is None}
        if missing:
            new = self._solve(missing - self.more.keys())
            here = self.more | new if len(new) > REMEMBERED else self.more
            if here is self.more:
                if len(self.more) + len(new) > REMEMBERED:
                    here = {u: self.more[u] for u in missing & self.more.keys()}
                    self.more = here
                self.more.update(new)
            for p, k in zip(parts, known, strict=True):
                if None in k:
                    k[:] = [x if x is not None else here[u] for u, x in zip(p, k, strict=True)]
        return [np.frombuffer(b"".join(k), np.int32) for k in known]


def decode(vocabulary: Vocabulary, ids) -> str:
    """The text of a list of ids: spaces again, without the one put before the text."""
    table = vocabulary.bytes_of
    text = b"".join([table.get(i, b"") for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


def encode_documents(docs: DataFrame, path: str | None = None, *, common: int = COMMON) -> DataFrame:
    """All columns of ``docs`` with piece_ids, n_pieces and round_trip appended.

    round_trip says whether decoding gives the text back (U+2581 in a text counts as a
    space, as the format has it). Null text: null piece_ids, 0 pieces, round_trip true.
    Empty text: no pieces. Texts of any length are encoded whole. Each row is its own, so ids may be null or repeated.
    Columns of these names are replaced, the others stay. Empty input: no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop("piece_ids", "n_pieces", "round_trip")
    vocabulary = load(path or default_path())
    solved = {u: np.array(ids, np.int32).tobytes() for u, ids in common_units(docs, vocabulary, common).items()}
    shared = spark.sparkContext.broadcast((vocabulary, solved))  # at most `common` short units

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, solved = shared.value
        encoder = Encoder(vocabulary, solved)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            for i in range(0, len(column), 512):
                part = batch.slice(i, 512)
                texts = column.slice(i, 512).to_pylist()
                found = encoder.encode(texts)
                same = [decode(vocabulary, f.tolist()) == (t or "").replace(SPACE, " ") for f, t in zip(found, texts, strict=True)]
                sizes = np.array([len(f) for f in found])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([*(t is None for t in texts), False]))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(sizes.astype(np.int64)), pa.array(same)], names=[*part.schema.names, "piece_ids", "n_pieces", "round_trip"])

    found = StructType([StructField("piece_ids", ArrayType(IntegerType())), StructField("n_pieces", LongType()), StructField("round_trip", BooleanType())])
    return in_small_batches(docs).mapInArrow(tidied(run), StructType([*docs.schema.fields, *found.fields]))


def decode_documents(docs: DataFrame, path: str | None = None, *, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids`` in column ``out``; null ids give null, no ids an empty text.

    Lists of any length are decoded whole; each row is its own. A column of the name ``out`` is replaced, the others
    stay. Empty input: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path or default_path()))
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode(shared.value, x) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return docs.mapInArrow(tidied(run), StructType([*docs.schema.fields, StructField(out, StringType())]))

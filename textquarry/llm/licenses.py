"""License scan by ordered signature rules.

A text becomes its words, lower-cased, with one space before each. One automaton of all
rules' keywords runs over it; only rules whose keyword was met try their regular
expression. Detections that overlap are then resolved by the rules' priority: in order of kind
(license text, identifier, notice, link, title, name), the longer first, a detection is
kept unless it lies inside a kept one, or cuts across one of a better kind.

Three base phrases are found at every place where their words stand in a row, whatever the rules say.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .license_rules import KINDS, Rule, rules
from .shared import in_small_batches, tidied

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: What a base phrase weighs in the score.
BASE_WEIGHT = 0.9
#: Bytes of a text that the automaton reads at a time; they overlap by the longest keyword.
SPAN = 1 << 20

_BASE = {label: re.compile(rb"(?<= )" + phrase.encode() + rb"(?![^ ])") for phrase, label in BASE.items()}
_ORDER = {k: i for i, k in enumerate(KINDS)}
_TABLE = np.full(256, 32, np.uint8)
_TABLE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
_TABLE[65:91] = np.arange(97, 123)


@dataclass(frozen=True)
class Found:
    """A detection: byte positions in the normalised text, end exclusive."""

    label: str
    kind: str
    start: int
    end: int
    rank: int


def normalised(text: str | None) -> bytes:
    """The words of a text, A-Z lower-cased, each with one space before it."""
    raw = _TABLE[np.frombuffer(b" " + (text or "").encode(), np.uint8)]
    gap = raw == 32
    keep = ~gap
    keep[:-1] |= gap[:-1] & ~gap[1:]
    return raw[keep].tobytes()


class Scanner:
    """All rules behind one automaton of their keywords."""

    def __init__(self, some: list[Rule]):
        self.rules = some
        by: dict[str, list[Rule]] = {}
        for r in some:
            by.setdefault(r.keyword.decode("latin-1"), []).append(r)
        self.longest = max(map(len, by), default=1)
        self.machine = ahocorasick.Automaton()
        for word, own in by.items():
            self.machine.add_word(word, own)
        self.machine.make_automaton()

    def gated(self, norm: bytes) -> list[Rule]:
        """The rules whose keyword occurs, in order of priority."""
        met: dict[int, list[Rule]] = {}
        for at in range(0, len(norm), SPAN):
            for _, own in self.machine.iter(norm[at : at + SPAN + self.longest].decode("latin-1")):
                met[id(own)] = own
        return sorted((r for own in met.values() for r in own), key=lambda r: r.rank)

    def detections(self, norm: bytes) -> list[Found]:
        """What the rules keep, by place."""
        every = [Found(r.label, r.kind, m.start(), m.end(), r.rank) for r in self.gated(norm) for m in r.pattern.finditer(norm) if m.end() > m.start()]
        return resolved(every)


def resolved(every: list[Found]) -> list[Found]:
    """Detections after suppression. Only those that overlap, one by one, are compared."""
    out: list[Found] = []
    chain: list[Found] = []

    def settle_chain() -> None:
        kept: list[Found] = []
        for f in sorted(chain, key=lambda f: (_ORDER[f.kind], f.start - f.end, f.start, f.rank)):
            inside = any(k.start <= f.start and f.end <= k.end for k in kept)
            cut = any(k.start < f.end and f.start < k.end and _ORDER[k.kind] < _ORDER[f.kind] for k in kept)
            if not inside and not cut:
                kept.append(f)
        out.extend(kept)

    reach = -1
    for f in sorted(every, key=lambda f: (f.start, f.end, f.rank)):
        if f.start >= reach and chain:
            settle_chain()
            chain = []
        chain.append(f)
        reach = max(reach, f.end)
    settle_chain()
    return sorted(out, key=lambda f: (f.start, f.end, f.rank))


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    """The scanner of all rules, built once a process."""
    return Scanner(rules())


def _scanned(text: str | None) -> dict:
    norm = normalised(text)
    places = sorted((m.start(), label) for label, p in _BASE.items() for m in p.finditer(norm))
    found = scanner().detections(norm)
    # words before a position are spaces before it, less its own; counted from one position to the next
    number: dict[int, int] = {}
    at = words = 0
    for s in sorted({*(s for s, _ in places), *(x for f in found for x in (f.start, f.end))}):
        words += norm.count(b" ", at, s)
        number[s], at = words, s
    total = words + norm.count(b" ", at)
    weight = {label: BASE_WEIGHT for _, label in places}
    for f in found:
        weight[f.label] = max(weight.get(f.label, 0.0), KINDS[f.kind])
    missed = 1.0
    for label in sorted(weight):
        missed *= 1 - weight[label]
    first_of = lambda f: number[f.start] - 1 + (norm[f.start : f.start + 1] == b" ")
    return {
        "n_words": total,
        "base": [{"label": label, "word": number[s] - 1} for s, label in places],
        "detections": [{"label": f.label, "kind": f.kind, "first_word": first_of(f), "last_word": number[f.end] - 1} for f in found],
        "score": 1 - missed if weight else 0.0,
    }


_FIELDS = "n_words long, base array<struct<label string, word long>>, detections array<struct<label string, kind string, first_word long, last_word long>>, score double"
_ARROW = pa.struct([
    ("n_words", pa.int64()),
    ("base", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
    ("detections", pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]))),
    ("score", pa.float64()),
])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with n_words, base, detections and score appended, from the whole text.

    base: the places (word numbers from 0) of the base phrases. detections: label, kind, first and last word of what the rules keep,
    by place. score: 1 less the product of what each label's best match leaves open, 0 without any.
    Null, empty and wordless texts have no words and no detections; texts of any length are read
    whole. Each row is its own, so ids may be null or repeated. Columns with those four names
    are replaced, the others stay. Empty input: no rows.
    """
    new = StructType.fromDDL(_FIELDS)
    docs = docs.drop(*new.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            found = pa.array([_scanned(t.as_py()) for t in column], _ARROW)
            yield pa.RecordBatch.from_arrays([*batch.columns, *found.flatten()], names=[*batch.schema.names, *new.names])

    return in_small_batches(docs).mapInArrow(tidied(run), StructType([*docs.schema.fields, *new.fields]))


def license_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_found for every row.

    first_word and last_word are null and labels empty where nothing is found; of null ids, repeated rows, null,
    empty and long texts the same holds as in ``scan_licenses``. Other columns are ignored.
    """
    d = scan_licenses(docs.select("doc_id", "text")).drop("text")
    labels = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(x, lambda y: y["label"]) for x in c]))), ",")
    at = F.transform("base", lambda b: b["word"])
    return d.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), labels("base").alias("base_labels"), labels("base", "detections").alias("labels"), "score", F.size("detections").cast("long").alias("n_found"))

"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the classes of a clause's words: insult, threat, target,
negation and reported speech. Run side by side (their product), they end a clause
in a combination of states such as "insult aimed at a target, negated". Clauses
are counted by that combination, and a logistic weight for each gives the score.

The insult transducer is a prefix acceptor over characters whose entries are learnt
from labelled rows: word beginnings (or whole words) that mark toxic documents.
Learning uses a bounded sample, TRAIN_ROWS labelled rows in the order of a hash;
within it every pattern is counted, and all that pass SUPPORT and LIFT are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import in_small_batches, settle, tidied
from .words import mix, shingle_sets

#: Most labelled rows to learn from.
TRAIN_ROWS = 20_000
#: An entry occurs in at least so many toxic documents, and is so many times likelier there.
SUPPORT, LIFT = 4, 25.0
#: Texts that share one of BANDS keys, each of BAND minima of their shingles, are copies or near copies of each other: a family.
#: An entry that fewer than SUPPORT families hold is believed if one of them teaches at most FEW such entries.
BANDS, BAND, FEW = 16, 3, 8
SEED = 20_240_101
#: Patterns that a task holds before it passes their partial counts on.
HELD = 200_000

# The closed word classes of the grammar, and insults that hold whatever the labels teach besides.
INSULTS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "imbecile", "vermin")
THREATS = ("kill", "hurt", "destroy", "beat", "shoot", "stab", "tuer", "töten", "matar", "burn", "strangle")
TARGETS = ("you", "your", "yours", "they", "them", "he", "she", "him", "her", "tu", "toi", "vous", "du", "dich", "ihr", "sie", "tú", "usted", "ustedes", "those", "these")
NEGATIONS = ("not", "never", "no", "neither", "nor", "isn't", "aren't", "wasn't", "ne", "pas", "jamais", "nicht", "kein", "keine", "nie", "nunca", "ni")
REPORTS = ("said", "says", "say", "wrote", "writes", "claimed", "called", "quoted", "according", "dit", "disait", "écrit", "sagte", "schrieb", "dijo", "escribió")

_LISTED = frozenset(w + "$" for w in INSULTS)
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;\n]+")
_CLASSES = {w: c for c, ws in (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in ws}


@dataclass(frozen=True)
class Machine:
    """A transducer over word classes: arcs (state, class) -> state; other words take ``other`` arcs if given."""

    start: int
    arcs: dict[tuple[int, str], int]
    other: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, kind: str) -> int:
        return self.arcs.get((state, kind), self.other.get(state, state))


#: Each ends in 0 or in a state that says what was seen; a negation reaches three words on.
MACHINES = {
    "insult": Machine(0, {(0, "insult"): 1, (1, "insult"): 2}),
    "threat": Machine(0, {(0, "threat"): 1}),
    "target": Machine(0, {(0, "target"): 1}),
    # 0 none, 1-3 a negation still reaches, 4 an insult or threat was negated, 5 one was not
    "negation": Machine(0, {**{(s, "negation"): 3 for s in range(4)}, **{(s, k): 4 for s in (1, 2, 3) for k in ("insult", "threat")}, **{(0, k): 5 for k in ("insult", "threat")}, **{(4, k): 4 for k in ("insult", "threat")}}, {3: 2, 2: 1, 1: 0}),
    "report": Machine(0, {(0, "report"): 1}),
}


@lru_cache(maxsize=65_536)
def _composed(state: tuple[int, ...], kind: str) -> tuple[int, ...]:
    return tuple(m.step(s, kind) for m, s in zip(MACHINES.values(), state, strict=True))


_START = tuple(m.start for m in MACHINES.values())
#: What a clause may end in; each is a feature: clauses that match it, as min(count, 4).
FEATURES = ("insult", "insult_again", "insult_target", "insult_negated", "insult_reported", "threat", "threat_target", "threat_negated", "threat_reported")
#: Weights before learning: bias first. Negation and reported speech take away from a match.
PRIOR = np.array([-3.0, 3.0, 1.0, 1.0, -1.5, -1.0, 0.5, 1.5, -0.5, -0.5])


def ends(kinds: list[str]) -> list[str]:
    """The features that a clause with these word classes matches."""
    state = _START
    for kind in kinds:
        state = _composed(state, kind)
    insult, threat, target, negation, report = state
    out = []
    for name, seen in (("insult", insult), ("threat", threat)):
        if seen:
            out.append(name)
            out += [f"{name}_again"] * (seen == 2) + [f"{name}_target"] * bool(target) + [f"{name}_negated"] * (negation == 4) + [f"{name}_reported"] * bool(report)
    return out


class Acceptor:
    """Finds the learnt entries and the threats in a text; an entry ending in ``$`` is a whole word."""

    def __init__(self, entries: list[str]):
        self.whole = frozenset(e[:-1] for e in entries if e.endswith("$"))
        self.begin = frozenset(e for e in entries if not e.endswith("$"))
        self.lengths = sorted({len(e) for e in self.begin})
        self.machine = ahocorasick.Automaton()
        for e in self.whole | self.begin | set(THREATS):
            self.machine.add_word(e, len(e))
        self.machine.make_automaton()

    def kind(self, word: str) -> str:
        if word in self.whole or any(word[:n] in self.begin for n in self.lengths if n <= len(word)):
            return "insult"
        return _CLASSES.get(word, "")

    def hit(self, low: str) -> bool:
        """Whether one of them begins at a word's start."""
        return any(end + 1 == n or not low[end - n].isalpha() for end, n in self.machine.iter(low))

    def features(self, text: str | None) -> tuple[int, ...]:
        low = (text or "").lower()
        if not low or not self.hit(low):
            return (0,) * len(FEATURES)
        seen: Counter = Counter()
        for clause in _CLAUSE.split(low):
            kinds = [self.kind(w) for w in _WORD.findall(clause)]
            if "insult" in kinds or "threat" in kinds:
                seen.update(ends(kinds))
        return tuple(min(seen[f], 4) for f in FEATURES)


@dataclass(frozen=True)
class Grammar:
    """The learnt entries and the weights of the clause patterns, bias first."""

    entries: tuple[str, ...]
    weights: tuple[float, ...]


def beginnings(word: str) -> list[str]:
    """Word beginnings of three letters and more, and the whole word."""
    return [*(word[:n] for n in range(3, min(len(word), 12) + 1)), word + "$"]


def closed(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> list[str]:
    """Entries from pattern -> (toxic, clean) documents: well supported, the longest of equal support, none below another."""
    rated = {p: (t + 0.5) / (toxic + 1) / ((c + 0.5) / (clean + 1)) for p, (t, c) in counts.items() if t >= SUPPORT}
    good = {p for p, lift in rated.items() if lift >= LIFT}
    stem = lambda p: p[:-1]
    # a beginning whose every toxic document has one longer form is that form
    best: dict[str, int] = {}
    for p in good:
        best[stem(p)] = max(best.get(stem(p), 0), counts[p][0])
    keep = {p for p in good if best.get(p, 0) < counts[p][0]}
    return sorted(p for p in keep if not any(p[:n] in keep for n in range(3, len(p))))


def fit(rows: list[tuple[tuple[int, ...], int, int]]) -> np.ndarray:
    """Logistic weights from (features, label, count), drawn to PRIOR, by Newton steps."""
    w = PRIOR.copy()
    if not rows or len({y for _, y, _ in rows}) < 2:
        return w
    x = np.array([(1, *f) for f, _, _ in rows], float)
    y, n = np.array([y for _, y, _ in rows], float), np.array([c for _, _, c in rows], float)
    pull = np.array([0.01, *[0.5] * len(FEATURES)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (n * (y - p)) - pull * (w - PRIOR))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _beginning_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic: Counter = Counter()
    clean: Counter = Counter()

    def partial() -> pa.RecordBatch:
        keys = [*(toxic.keys() | clean.keys())]
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["pattern", "toxic", "clean"])
        toxic.clear()
        clean.clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(_WORD.findall((text or "").lower()))
            (toxic if label else clean).update({b for w in words for b in beginnings(w)})
            if len(toxic) + len(clean) >= HELD:
                yield partial()
    yield partial()


def _holders(entries: list[str]):
    """For mapInArrow over texts: the entries that each holds, and the keys that its near copies mostly share."""
    whole, begin = frozenset(e[:-1] for e in entries if e.endswith("$")), frozenset(e for e in entries if not e.endswith("$"))
    lengths = sorted({len(e) for e in begin})
    salts = mix(np.arange(1, BANDS * BAND + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, s in zip(batch.column(0), shingle_sets(batch.column(0)), strict=True):
                words = set(_WORD.findall((text.as_py() or "").lower()))
                mine = {w + "$" for w in words & whole} | {w[:n] for w in words for n in lengths if w[:n] in begin and len(w) >= n}
                minima = np.array([mix(s ^ x).min() for x in salts]).reshape(BANDS, BAND) if len(s) else np.zeros((BANDS, 0), np.uint64)
                keys = [int(mix(np.array([hash((k, *row.tolist())) & 0x7FFFFFFFFFFFFFFF], np.uint64))[0] >> np.uint64(1)) for k, row in enumerate(minima)]
                yield pa.RecordBatch.from_arrays([pa.array([sorted(mine)], pa.list_(pa.string())), pa.array([keys], pa.list_(pa.int64()))], names=["entries", "bands"])

    return run


def believed(texts: list[tuple[list[str], list[int]]], few: int) -> tuple[list[str], list[str]]:
    """The entries of toxic ``texts`` (entries, band keys) that are sure, and those that rest on copies but are few.

    Texts that share a key are one family. An entry of SUPPORT families is sure, and a listed insult. One of fewer
    counts too if a family holds it that nothing sure explains and that has at most ``few`` such entries: a text copied
    often lends its support to all of its rare words, and where these are many, none is told from the others.
    """
    family = list(range(len(texts)))

    def root(x: int) -> int:
        while family[x] != x:
            family[x] = x = family[family[x]]
        return x

    first: dict[int, int] = {}
    for k, (_, keys) in enumerate(texts):
        for key in keys:
            a, b = sorted((root(first.setdefault(key, k)), root(k)))
            family[b] = a
    homes: dict[str, set[int]] = {}
    for k, (entries, _) in enumerate(texts):
        for e in entries:
            homes.setdefault(e, set()).add(root(k))
    crowd = Counter(f for e, own in homes.items() if len(own) < SUPPORT and e not in _LISTED for f in own)
    sure = {e for e, own in homes.items() if len(own) >= SUPPORT or e in _LISTED}
    explained = {f for e in sure for f in homes[e]}
    return sorted(sure), sorted(e for e, own in homes.items() if e not in sure and any(crowd[f] <= few for f in own - explained))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, few: int = FEW) -> Grammar:
    """A grammar from ``labels`` (doc_id, toxic) on at most ``rows`` labelled ids of ``docs``.

    Null ids and labels are not learnt from; of repeated labels the larger counts, and each row
    of a repeated id is one document. Entries that rest on copies alone must pass ``believed``. Null and empty texts count as documents without words; long texts
    are read whole. Without both labels, or without rows, the listed words and PRIOR stay.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # about `rows` ids pass a threshold on a hash before the few that remain are put in order: at most `rows` pairs of id and label
    place = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 40))
    share = (1.1 * rows + 2000) / max(known.count(), 1)
    chosen = known.where(place < int(min(1.0, share) * (1 << 40))).orderBy(place, "doc_id").limit(rows)
    train = settle(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxicity-train").repartition(12)
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Grammar(tuple(sorted(_LISTED)), tuple(PRIOR))
    counts = in_small_batches(train).mapInArrow(tidied(_beginning_counts), "pattern string, toxic long, clean long").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # only what closed() rates as good leaves the executors
    lift = (F.col("toxic") + 0.5) / (sizes[1] + 1) / ((F.col("clean") + 0.5) / (sizes[0] + 1))
    kept = {r["pattern"]: (r["toxic"], r["clean"]) for r in counts.where((F.col("toxic") >= SUPPORT) & (lift >= LIFT * 0.999)).collect()}

    learnt = closed(kept, sizes[1], sizes[0])
    holders = in_small_batches(train.where("toxic = 1").select("text")).mapInArrow(tidied(_holders(sorted({*learnt, *_LISTED}))), "entries array<string>, bands array<long>")
    held = holders.where(F.size("entries") > 0).toArrow().to_pylist()  # one row a labelled text of the sample at most
    sure, copied = believed([(r["entries"], r["bands"]) for r in held], few)
    # weights come from what texts of their own teach, if there are such: copies would count a few texts many times
    sure = sorted({*(sure if set(sure) - _LISTED else copied), *_LISTED})

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acceptor = Acceptor(sure)
        for batch in batches:
            found = [list(acceptor.features(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), batch.column(1)], names=["f", "toxic"])

    table = train.mapInArrow(tidied(seen), "f array<long>, toxic int").groupBy("f", "toxic").count().collect()
    return Grammar(tuple(sorted({*sure, *copied})), tuple(fit([(tuple(r["f"]), r["toxic"], r["count"]) for r in table])))


def score_documents(docs: DataFrame, grammar: Grammar, out: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` with ``out`` (double, 0 to 1) appended, from the whole text alone.

    Null and empty texts match nothing and get the score of the bias; texts of any length are
    read whole. A column of the name ``out`` is replaced, the others stay. Repeated rows stay,
    equal texts score equal; ids are not looked at. Empty input: no rows.
    """
    entries, weights = list(grammar.entries), np.array(grammar.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acceptor = Acceptor(entries)
        for batch in batches:
            f = np.array([acceptor.features(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()], float).reshape(-1, len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip(weights[0] + f @ weights[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, out])

    docs = docs.drop(out)
    return in_small_batches(docs).mapInArrow(tidied(run), StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    """Whether a row's label may not be learnt from: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and empty texts get the score of a text without matches; texts of any length are read
    whole. Each row is scored on its own, so ids may be null (not held out) or repeated, and
    equal texts tie. Other columns are ignored. Empty input: no rows.
    """
    grammar = learn(docs, labels.where(~held_out()).select("doc_id", "toxic"))
    scored = score_documents(docs.select("doc_id", "text"), grammar)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))

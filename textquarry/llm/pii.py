"""Personal data by a semi-Markov conditional random field.

Candidate segments are proposed around digits, at-signs and long mixed runs: in a
cluster of digit groups every run of neighbouring groups of a possible length, under
each kind that its digits allow; around an at-sign, written in any way, several starts
and ends; assigned or random-looking words as secrets. Entities are bounded (GROUPS
groups, LONGEST characters), so candidates grow with the text. Features of the whole
span (digits, grouping, separators, checksum, entropy, cue words, what it cuts off)
score each candidate under its kind; text outside of segments scores nothing. A dynamic
programme over the candidates chooses the segments, so boundaries and kinds are settled
jointly. The weights maximise the likelihood of generated sentences, fitted once.

Matches of the base patterns always stay; the field adds spans beside them.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import in_small_batches, tidied

#: Kinds of the base patterns, and those that only the field finds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of these always begins at the start of a run of digits, as it takes runs whole; possessive, so long runs stay linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_CUE = re.compile(r"[A-Za-z]+")
# What candidates are made of: clusters of digit groups, colon groups, at-signs and labels around them, long runs.
_CLUSTER = re.compile(r"[0-9]++(?:[ ().+-]{1,3}[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
_COLONS = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?:::?[0-9A-Fa-f]{1,4}){2,8}(?::{2})?(?![0-9A-Za-z:])")
_AT = re.compile(r" ?(?:[\[({<] ?(?:at|AT|@) ?[\])}>]|(?<= )(?:at|AT|@)(?= )|@(?= )|(?<= )@) ?")
_BEFORE = re.compile(r"[A-Za-z0-9_%+-]{1,64}(?:(?:\.| ?[\[({] ?dot ?[\])}] ?| dot )[A-Za-z0-9_%+-]{1,64}){0,2}$", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]{1,63}")
_DOT = re.compile(r"\.| ?[\[({<] ?dot ?[\])}>] ?| dot ", re.I)
_RUN = re.compile(r"[A-Za-z0-9_+/-]{16,}={0,2}")
_ASSIGNED = re.compile(r"(?:password|passwd|pwd|secret|token|key)[\"']? ?[:=] ?([\"']?)([^\s\"',;]{6,128})", re.I)

# Words before a span that speak for a kind, ends of addresses, beginnings of issued keys.
CUES = {
    "email": {"email", "mail", "e", "contact", "write", "address"},
    "ip": {"ip", "host", "server", "address", "from", "node"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "pay", "payment", "number"},
    "phone": {"phone", "call", "tel", "mobile", "fax", "cell", "dial", "number"},
    "secret": {"password", "passwd", "pwd", "secret", "token", "key", "apikey", "bearer", "credential"},
}
ENDINGS = frozenset(("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "us", "it", "nl", "ch", "at"))
ISSUED = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "eyJ")
#: The longest span, and the most groups, that a candidate beyond the base may have.
LONGEST, GROUPS = 256, 8

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(int(d) * 2 - 9 * (d > "4") for d in even)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base matches of all kinds, by start, then kind in the order of KINDS."""
    found: list[tuple[int, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if m.end() - m.start() >= 9 and 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


def _digit_spans(text: str) -> Iterator[Span]:
    """Runs of neighbouring digit groups, under each kind that the digits allow."""
    for m in _CLUSTER.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in _GROUP.finditer(m[0])]
        for i, (s, _) in enumerate(groups):
            while s and text[s - 1] in "+(" and groups[i][0] - s < 2:
                s -= 1
            digits = 0
            for j in range(i, min(i + GROUPS, len(groups))):
                e = groups[j][1]
                digits += e - groups[j][0]
                if digits > 19:
                    break
                if j - i == 3 and digits <= 12 and all(text[groups[k][1] : groups[k + 1][0]] == "." for k in range(i, j)):
                    yield groups[i][0], e, "ip"
                if digits >= 12:
                    yield groups[i][0], e, "card"
                if 7 <= digits <= 15:
                    yield s, e, "phone"


def _address_spans(text: str) -> Iterator[Span]:
    """Around each written at-sign: local parts of one to three words, domains of two to five labels."""
    for m in _AT.finditer(text):
        before = _BEFORE.search(text, max(0, m.start() - 200), m.start())
        if not before:
            continue
        starts = [before.start(), *(before.start() + d.end() for d in _DOT.finditer(before[0]))]
        at, labels = m.end(), 0
        while labels < 5 and (label := _LABEL.match(text, at)):
            labels += 1
            if labels > 1:
                yield from ((s, label.end(), "email") for s in starts)
            dot = _DOT.match(text, label.end())
            if not dot:
                break
            at = dot.end()


def _secret_spans(text: str) -> Iterator[Span]:
    for m in _RUN.finditer(text):
        if _DIGIT.search(m[0]) and not m[0].isdigit():
            yield m.start(), m.end(), "secret"
    for m in _ASSIGNED.finditer(text):
        yield m.start(2), m.end(2), "secret"


def candidates(text: str) -> list[Span]:
    """The candidate segments of a text, in order of their ends, starts and kinds."""
    found: list[Span] = []
    if _DIGIT.search(text):
        found += _digit_spans(text)
        if ":" in text:
            found += ((m.start(), m.end(), "ip") for m in _COLONS.finditer(text))
        found += _secret_spans(text)
    elif "=" in text or ":" in text:
        found += ((m.start(2), m.end(2), "secret") for m in _ASSIGNED.finditer(text))
    if "@" in text or "dot" in text or "DOT" in text or "(at" in text or "[at" in text:
        found += _address_spans(text)
    found = [x for x in dict.fromkeys(found) if x[1] - x[0] <= LONGEST]
    return [found[i] for i in _order(found)]


def entropy(body: str) -> float:
    """Bits a character, by the frequencies in the string itself."""
    return -sum(n / len(body) * math.log2(n / len(body)) for n in Counter(body).values())


def span_features(text: str, span: Span) -> list[str]:
    """Whole-span features of a candidate."""
    s, e, kind = span
    body = text[s:e]
    before, after = text[s - 1 : s], text[e : e + 1]
    out = ["bias"]
    if any(w.lower() in CUES[kind] for w in _CUE.findall(text[max(0, s - 24) : s])[-2:]):
        out.append("cue")
    if before.isalnum() or after.isalnum():
        out.append("cuts_word")
    if kind == "secret":
        upper, lower, digit = any(c.isupper() for c in body), any(c.islower() for c in body), any(c.isdigit() for c in body)
        out += [f"classes{upper + lower + digit}", f"bits{min(5, int(entropy(body)))}", f"length{min(5, len(body) // 8)}"]
        out += ["issued"] * body.startswith(ISSUED) + ["hex"] * (not body.strip("0123456789abcdef")) + ["quoted"] * (before in ('"', "'") and before == after)
        out += ["assigned"] * bool(re.search(r"[:=] ?[\"']?$", text[max(0, s - 3) : s])) + ["path"] * ("/" in body or before in ("/", ".") or after == "/") + ["words"] * ("-" in body or "_" in body)
        return out
    if kind == "email":
        labels = [w for w in re.split(r"[^A-Za-z0-9-]+", body) if w]
        sign = _AT.search(body)
        out += ["ending"] * (labels[-1].lower() in ENDINGS) + ["bare"] * (sign is not None and sign[0].strip().lower() == "at") + ["written_dot"] * (" dot" in body.lower() or "dot]" in body.lower() or "dot)" in body.lower())
        out += ["more_right"] * bool(_DOT.match(text, e) and _LABEL.match(text, _DOT.match(text, e).end())) + ["more_left"] * bool(re.search(r"(?:\.|dot[\])}]?) ?$", text[max(0, s - 6) : s], re.I))
        return out
    if ":" in body:
        parts = body.split(":")
        return [*out, "groups8" if len(parts) == 8 else "short" if "::" in body else "few_groups", *["hex"] * any(c.isalpha() for c in body)]
    groups = _GROUP.findall(body)
    digits = "".join(groups)
    separators = {x for x in re.split(r"[0-9]+", body)[1:-1]}
    out += [f"digits{len(digits)}", "shape" + "-".join(str(len(g)) for g in groups), f"first{digits[0]}", f"parts{min(len(groups), 6)}"]
    out += ["one_separator"] * (len(separators) == 1) + [f"by{x[:1]}" for x in sorted(separators)[:1]] + ["plus"] * body.startswith(("+", "(+")) + ["parentheses"] * ("(" in body and ")" in body) + ["open"] * (body.count("(") != body.count(")"))
    out += ["uniform"] * (len(set(digits)) <= 2) + ["date"] * bool(re.fullmatch(r"(?:19|20)[0-9]{2}[-. ][0-9]{1,2}[-. ][0-9]{1,2}(?:[ .-].*)?|[0-9]{1,2}[-. ][0-9]{1,2}[-. ](?:19|20)[0-9]{2}.*", body))
    if kind == "card":
        out.append("checked" if luhn(digits) else "unchecked")
    if kind == "ip":
        out.append("octets" if all(int(g) <= 255 for g in groups) else "too_large")
    # digits of the same cluster that the span leaves aside
    out += ["more_left"] * bool(re.search(r"[0-9][ ().+-]{1,2}$", text[max(0, s - 3) : s])) + ["more_right"] * bool(re.match(r"[ ().+-]{1,2}[0-9]", text[e : e + 3]))
    return out


def _order(spans: list[Span]) -> list[int]:
    return sorted(range(len(spans)), key=lambda i: (spans[i][1], spans[i][0], ALL_KINDS.index(spans[i][2])))


def best_segmentation(spans: list[Span], scores: list[float]) -> list[Span]:
    """The non-overlapping candidates of the highest total score; of equal totals, that with fewer spans."""
    order = _order(spans)
    ends = [spans[i][1] for i in order]
    best, back = [0.0], [(-1, False)]
    for n, i in enumerate(order):
        prior = bisect_right(ends, spans[i][0], 0, n)
        take = best[prior] + scores[i]
        best.append(max(best[n], take))
        back.append((prior, True) if take > best[n] else (n, False))
    out, n = [], len(order)
    while n > 0:
        prior, taken = back[n]
        if taken:
            out.append(spans[order[n - 1]])
        n = prior
    return out[::-1]


def _plus(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _marginals(spans: list[Span], scores: list[float]) -> tuple[float, list[float]]:
    """Log partition over non-overlapping subsets, and each candidate's probability."""
    order = _order(spans)
    n = len(order)
    ends = [spans[i][1] for i in order]
    prior = [bisect_right(ends, spans[i][0], 0, k) for k, i in enumerate(order)]
    forward = [0.0] * (n + 1)
    for k, i in enumerate(order):
        forward[k + 1] = _plus(forward[k], forward[prior[k]] + scores[i])
    # outside weights flow back along the same choices
    out = [-math.inf] * (n + 1)
    out[n] = 0.0
    prob = [0.0] * n
    for k in range(n - 1, -1, -1):
        i = order[k]
        prob[i] = math.exp(out[k + 1] + forward[prior[k]] + scores[i] - forward[n])
        out[prior[k]] = _plus(out[prior[k]], out[k + 1] + scores[i])
        out[k] = _plus(out[k], out[k + 1])
    return forward[n], prob


def generated(rng: random.Random) -> tuple[str, set[Span]]:
    """A sentence with entities, some right behind another, and look-alikes that are none."""
    word = lambda: "".join(rng.choice("abcdefghinorstu") for _ in range(rng.randint(2, 9)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))

    def card(n: int) -> str:
        while not luhn(d := rng.choice("3456") + num(n - 1)):
            pass
        return d

    def cut(d: str, sizes: tuple[int, ...], by: str) -> str:
        at = [sum(sizes[:k]) for k in range(len(sizes) + 1)]
        return by.join(d[i:j] for i, j in zip(at, at[1:], strict=False))

    def entity(kind: str) -> tuple[str, str]:
        """What stands before and what the entity is."""
        if kind == "email":
            at, dot = rng.choice([("@", "."), (" [at] ", "."), (" (at) ", " (dot) "), (" at ", " dot "), (" @ ", ".")])
            return "", f"{rng.choice([word(), word() + '.' + word(), word() + num(2)])}{at}{word()}{dot}{rng.choice([rng.choice(sorted(ENDINGS)), 'co' + dot + 'uk'])}"
        if kind == "ip":
            return "", rng.choice([".".join(str(rng.randint(0, 255)) for _ in range(4)), ":".join(f"{rng.randint(0, 65535):x}" for _ in range(8)), f"{rng.randint(4096, 65535):x}:{rng.randint(0, 65535):x}::{rng.randint(1, 65535):x}"])
        if kind == "card":
            if rng.random() < 0.2:
                return "", cut(card(15), (4, 6, 5), rng.choice(["", " ", "-", "."]))
            return "", cut(card(16), (4, 4, 4, 4), rng.choice(["", "", " ", "-", "."]))
        if kind == "phone":
            by = rng.choice([" ", "-", "."])
            return "", rng.choice([f"+1 ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", cut(num(10), (3, 3, 4), by), f"+{rng.randint(20, 99)} " + cut(num(9), (3, 3, 3), " "), f"+{rng.randint(20, 99)} " + cut(num(9), (1, 2, 2, 2, 2), by), "0" + cut(num(9), (1, 2, 2, 2, 2), by), f"+{rng.randint(20, 99)}{num(9)}"])
        lead = rng.choice(["", "", rng.choice(["password", "token", "secret", "api_key"]) + rng.choice(["=", " = ", ": "])])
        return lead, rng.choice([hexa(rng.choice([18, 32, 40])), mixed(rng.randint(18, 40)), "AKIA" + mixed(16).upper(), "ghp_" + mixed(36)]) if not lead or rng.random() < 0.8 else mixed(rng.randint(8, 14))

    def alike() -> str:
        bad = num(16)
        while luhn(bad):
            bad = num(16)
        return rng.choice([
            f"{rng.randint(256, 999)}.{num(2)}.{num(2)}.{num(2)}", bad, cut(bad, (4, 4, 4, 4), rng.choice(" -.")), "0000000000000000", f"20{num(2)}-{num(2)}-{num(2)} {num(2)}:{num(2)}:{num(2)}", f"{num(2)}.{num(2)}.19{num(2)}", num(rng.randint(7, 11)),
            f"{num(1)}.{num(3)}.{num(3)},{num(2)}", " ".join(num(rng.randint(1, 3)) for _ in range(rng.randint(3, 9))), ", ".join(num(4) for _ in range(4)), f"{num(2)}:{num(2)}:{num(2)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"v{num(1)}.{num(1)}.{num(2)}", f"{word()} at {word()}. {word().title()}",
            f"{word()} at {word()}.{word()}", f"{word()}-{word()}-{word()}-{word()}-{num(1)}", f"/{word()}/{word()}/{word()}{num(2)}/{word()}", f"{word()}/{word()}{word()}/{word()}{num(rng.randint(1, 9))}{word()}", f"{word()}{word()}{word()}{num(2)}", f"key: {word()}", word(),
        ])

    text, gold = word(), set()
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice([*ALL_KINDS, "", "", ""])
        if not kind:
            text += f" {word()} {alike()}"
        else:
            # sometimes right behind what was before
            text += rng.choice([" ", f" {rng.choice(sorted(CUES[kind]))} ", f" {word()} ", f", {word()}: "])
            lead, body = entity(kind)
            text += lead + (quote := '"' * (kind == "secret" and bool(lead) and rng.random() < 0.5))
            gold.add((len(text), len(text) + len(body), kind))
            text += body + quote
        text += rng.choice(["", " ", ", ", ". "])
    return f"{text} {word()}", gold


Weights = dict[tuple[str, str], float]


def score(text: str, span: Span, weights: Weights) -> float:
    return sum(weights.get((span[2], f), 0.0) for f in span_features(text, span))


@lru_cache(maxsize=4)
def trained(sentences: int = 900, rounds: int = 40, seed: int = 5) -> Weights:
    """Weights by kind and feature: ascent on the penalised conditional likelihood of generated sentences, with a step for each weight (AdaGrad)."""
    rng = random.Random(seed)
    data = []
    for _ in range(sentences):
        text, gold = generated(rng)
        spans = candidates(text)
        data.append((spans, [[(s[2], f) for f in span_features(text, s)] for s in spans], [s in gold for s in spans]))
    w: Weights = defaultdict(float)
    seen: Weights = defaultdict(float)
    for _ in range(rounds):
        grad: Weights = defaultdict(float)
        for spans, features, truth in data:
            _, prob = _marginals(spans, [sum(w[f] for f in fs) for fs in features])
            for fs, t, p in zip(features, truth, prob, strict=True):
                if abs(t - p) > 1e-4:
                    for f in fs:
                        grad[f] += t - p
        for f, g in grad.items():
            g -= 0.3 * w[f]
            seen[f] += g * g
            w[f] += 0.6 * g / (math.sqrt(seen[f]) + 1e-9)
    return dict(w)


def find_spans(text: str | None, weights: Weights) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base with the field's segments that overlap none of them."""
    text = text or ""
    base = base_spans(text)
    starts, ends, reach = [s[0] for s in base], [], 0
    for s in base:
        reach = max(reach, s[1])
        ends.append(reach)
    # a base span is certain: nothing that overlaps one is a candidate
    free = [s for s in candidates(text) if not (k := bisect_right(starts, s[1] - 1)) or ends[k - 1] <= s[0]]
    if not free:
        return base, base
    chosen = best_segmentation(free, [score(text, s, weights) for s in free])
    return base, sorted([*base, *chosen], key=lambda s: (s[0], ALL_KINDS.index(s[2])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one."""
    if not text or not spans:
        return text
    out, done, i = [], 0, 0
    while i < len(spans):
        s, e, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < e:
            e = max(e, spans[i][1])
            i += 1
        out += [text[done:s], f"[{kind.upper()}]"]
        done = e
    return "".join([*out, text[done:]])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added, n_secret for every row.

    n_added counts the field's own spans, n_secret those among them that are secrets, a kind
    without base pattern. Null and empty texts: no spans, and the digest of the empty string;
    texts of any length are read whole, in time that grows with them. Of segmentations with equal scores that
    with fewer spans, then the first in order of ends, counts. doc_id may be null or repeated;
    other columns are ignored. Empty input: no rows.
    """
    weights = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            marks, all_spans, added, secrets = [], [], [], []
            for text in batch.column(1).to_pylist():
                base, spans = find_spans(text, weights)
                kinds = [s[2] for s in base]
                for c, k in zip(counts, KINDS, strict=True):
                    c.append(kinds.count(k))
                marks.append(hashlib.sha256(written(base).encode()).hexdigest())
                all_spans.append(written(spans))
                added.append(len(spans) - len(base))
                secrets.append(sum(s[2] == "secret" for s in spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(marks, pa.string()), pa.array(all_spans, pa.string()), pa.array(added, pa.int64()), pa.array(secrets, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_secret"])

    return in_small_batches(docs.selectExpr("cast(doc_id AS long) AS doc_id", "text")).mapInArrow(tidied(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced by kinds; all columns stay, null text stays null."""
    weights = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            new = [redact(t, find_spans(t, weights)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, "text", pa.array(new, pa.string()))

    return in_small_batches(docs).mapInArrow(tidied(run), docs.schema)

"""Spelling variants, license scan and vector codes against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import codes, license_rules, licenses, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    return df.withColumn("word", F.lit(1)).withColumn("n", F.lit("x")).withColumn("labels", F.lit("mit")).withColumn("score", F.lit(7.0)).withColumn("base", F.lit(0))


# ---------------------------------------------------------------- spelling variants


def one_edit(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]]))
    return out


def spelling_rows():
    rng = random.Random(5)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 7))) for _ in range(60)]
    texts = [" ".join(rng.choice(base) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    texts += [t.upper() for t in texts[:10]] + ["Ärger ärger ÄRGER ärgern×ärgern÷Ärgern", "aaaaa " * 3 + "aaaa " * 9 + "aaaaaa " * 40 + "aaaaaaa " * 90, None, "", " \n", "ÿÀÖ" * 3, "12345 _____", "q" * 300 + " " + ("q" * 300 + " ") * 3 + "q" * 299 + " " + ("q" * 301 + " ") * 9]
    rows = list(enumerate(texts))
    return [*rows, (3, texts[3]), (3, texts[4]), (None, texts[5]), (None, texts[6])]


def test_spelling_variants(spark):
    rows = spelling_rows()
    got = spelling.spelling_variants(documents(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = variants(rows)
    assert {tuple(r) for r in got.collect()} == want
    assert any(r[1] and r[2] != r[1] for r in want), "no chain of forms in the test"
    assert got.count() == len(want)


def test_spelling_without_words(spark):
    assert spelling.spelling_variants(documents(spark, [(1, "abc"), (2, None)])).count() == 0
    assert spelling.spelling_variants(documents(spark, [(1, "abc")]).limit(0)).count() == 0


def test_neighbourhood_is_full_and_distinct():
    """With a filter that lets all pass: every string at one edit over the alphabet, once."""
    known = b"ab\xe9"
    held = np.full(8, np.uint64(0xFFFFFFFFFFFFFFFF))
    for word in ("a", "ab", "aabba", "abé", "ééé"):
        letters = np.frombuffer(word.encode("latin-1"), np.uint8).reshape(1, -1)
        got = [word[:i] + (chr(x) if x >= 0 else "") + word[i + cut :] for rows, i, cut, puts in spelling.neighbourhood(letters, known, held) for x in puts.tolist()]
        some = known.decode("latin-1")
        want = {word[:i] + word[i + 1 :] for i in range(len(word)) if len(word) > 1} | {word[:i] + x + word[i + 1 :] for i in range(len(word)) for x in some} | {word[:i] + x + word[i:] for i in range(len(word) + 1) for x in some}
        assert sorted(got) == sorted(want - {word})


def test_a_small_filter_changes_nothing(spark, monkeypatch):
    """A filter too small for its words lets strings through; the join sorts them out."""
    rows = spelling_rows()
    monkeypatch.setattr(spelling, "MOST_BITS", 128)
    assert {tuple(r) for r in spelling.spelling_variants(documents(spark, rows)).collect()} == variants(rows)


def test_runs_of_long_texts(monkeypatch):
    text = " ".join(f"ab{'c' * (k % 40)}" for k in range(500))
    whole = Counter(re.findall("[A-Za-zÀ-ÿ]+", text))
    monkeypatch.setattr(spelling, "SPAN", 37)
    assert sum(spelling.runs(text), Counter()) == whole


# ---------------------------------------------------------------- license scan


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base_of(text):
    w, out = words_of(text), []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        out += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
    return len(w), sorted(out)


def scanned(text, some):
    """All rules on the whole text, ungated, and suppression over all pairs."""
    norm = "".join(" " + w for w in words_of(text)).encode()
    order = list(license_rules.KINDS)
    every = [(order.index(r.kind), m.start() - m.end(), m.start(), r.rank, m.end(), r) for r in some for m in r.pattern.finditer(norm)]
    kept = []
    for f in sorted(every, key=lambda f: f[:4]):
        if not any(k[2] <= f[2] and f[4] <= k[4] or (k[2] < f[4] and f[2] < k[4] and k[0] < f[0]) for k in kept):
            kept.append(f)
    number = lambda at: norm[: at + 1].count(b" ") - 1
    return sorted((f[5].label, f[5].kind, number(f[2]), norm[: f[4]].count(b" ") - 1) for f in kept)


LICENSED = [
    "Released under the MIT License.",
    "Under the MIT license, under the mit LICENSE; under the mit licenses",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "distributed under the terms of the GNU Lesser General Public License v2.1 or (at your option) any later version",
    "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0+ or GPLv3, gpl v2 or later; GPL 2.5 is none",
    "SPDX-License-Identifier: BSD-3-Clause\nSPDX-License-Identifier: MIT",
    "licensed under CC BY-NC 4.0 and cc by-nc-sa 3.0, cc by nc nd",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License https://creativecommons.org/licenses/by-nc-sa/4.0/",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Neither the name of X nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Mozilla Public Licence 2.0. This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "This is free and unencumbered software released into the public domain. All rights reserved. wtfpl",
    "éapache license version 2 apacheé license version 2 apache license version 2é apache license version 2",
    "apache license version 2 " * 400 + "x " * 2000 + "under the mit license",
]


def test_license_scan(spark):
    rng = random.Random(3)
    bits = " ".join(LICENSED[:12]).split()
    texts = [*LICENSED, None, "", " .-/ ", "no license here", *(" ".join(rng.choice(bits) for _ in range(200)) for _ in range(20)), *(" ".join(bits[i : i + 60]) for i in range(0, len(bits), 7))]
    rows = [*enumerate(texts), (1, texts[1]), (None, texts[2]), (None, None)]
    df = documents(spark, rows)
    some = license_rules.rules()
    full = licenses.scan_licenses(df).collect()
    assert len(full) == len(rows)
    for r in full:
        n, base = base_of(r["text"])
        assert r["n_words"] == n and sorted((b["word"], b["label"]) for b in r["base"]) == base
        assert sorted(tuple(d) for d in r["detections"]) == scanned(r["text"], some), r["text"]
    got = licenses.license_query(df)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_found"]
    by = {r["doc_id"]: r for r in got.collect()}
    for k, t in enumerate(texts):
        n, base = base_of(t)
        r = by[k]
        assert (r["n_words"], r["n_base"]) == (n, len(base))
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == (r["labels"] != "") and r["labels"] == ",".join(sorted(set(r["labels"].split(","))))
    assert licenses.license_query(df.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "labels"), [
    (LICENSED[0], "mit"),
    (LICENSED[2], "apache-2"),
    (LICENSED[3], "lgpl-2.1-or-later"),
    (LICENSED[4], "gpl-3.0"),
    (LICENSED[6], "bsd-3-clause,mit"),
    (LICENSED[7], "cc-by-nc,cc-by-nc-4.0,cc-by-nc-nd,cc-by-nc-sa-3.0"),
    (LICENSED[8], "cc-by-nc-sa-4.0"),
    (LICENSED[10], "mpl-2.0"),
    ("see the epl and gpled things, replace upload", "gpl"),
    ("a text on licenses and the public", ""),
])
def test_license_labels(text, labels):
    r = licenses._scanned(text)
    assert ",".join(sorted({x["label"] for x in [*r["base"], *r["detections"]]})) == labels


def test_license_keywords():
    """Hundreds of rules; each has a keyword that gates it, and names no empty match."""
    some = license_rules.rules()
    assert len(some) > 300 and [r.rank for r in some] == list(range(len(some)))
    assert all(len(r.keyword.strip()) >= 3 and not r.pattern.search(b"") for r in some)
    assert license_rules.keyword("(?:a|b) cd[ef]gh? ijkl{2}m") == " ijk"


def test_long_texts_are_read_in_spans(monkeypatch):
    text = " ".join(LICENSED[:12] * 3)
    want = licenses._scanned(text)
    monkeypatch.setattr(licenses, "SPAN", 50)
    assert licenses._scanned(text) == want


# ---------------------------------------------------------------- vector codes


def coded(rows, parts=4, entries=256, rounds=4):
    """The same in Python's own integers."""
    good = [(i, [math.floor(1024 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = len(good[0][1])
    spans = [(p * d // parts, (p + 1) * d // parts) for p in range(parts)]
    first = sorted((i, v) for i, v, _ in good if i is not None)[:entries]
    books = [[v[a:b] for _, v in first] for a, b in spans]

    def best(x, book):
        return min((sum((s - t) ** 2 for s, t in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(spans):
            groups = {}
            for _, v, _ in good:
                groups.setdefault(best(v[a:b], books[p])[1], []).append(v[a:b])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    out = []
    for i, v, y in good:
        found = [best(v[a:b], book) for (a, b), book in zip(spans, books, strict=True)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found), y))
    total = Counter()
    for *_, e, y in out:
        total[y] += e
    text = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(((i, c, e, total[y], hashlib.sha256(text.encode()).hexdigest()) for i, c, e, y in out), key=str)


def vectors(n, d, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(size=d)], None if i % 7 == 0 else int(i % 4)) for i in range(n)]


def table(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumn("code", F.lit("x")).withColumn("error", F.lit(1)).withColumn("nothing", F.lit(True))


def test_vector_codes(spark):
    rows = vectors(700, 8)
    rows += [(i, rows[5][1], 9) for i in range(900, 960)]
    odd = [(2000, None, 1), (2001, [math.nan] * 8, 1), (2002, [None] + [1.0] * 7, 1), (2003, [math.inf] * 8, 1), (None, rows[3][1], 2), (4, rows[6][1], 2), (4, rows[4][1], 3)]
    got = codes.code_query(table(spark, rows + odd, "float"))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == coded(rows + odd)


@pytest.mark.parametrize("n", [1, 3, 40])
def test_fewer_vectors_than_entries(spark, n):
    rows = vectors(n, 4, seed=n)
    got = codes.code_query(table(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == coded(rows) and all(r["error"] == 0 for r in got)


def test_very_large_components_are_exact(spark):
    rows = [(i, [x * 10.0 ** (i % 7) for x in v], y) for i, v, y in vectors(300, 4, seed=4)]
    got = codes.code_query(table(spark, rows)).collect()
    want = coded(rows)
    assert sorted((tuple(r) for r in got), key=str) == want
    huge = [*rows, (5000, [1e308, -1e308, 1e200, 1.0], 1), (5001, [1.7e308, 0.0, 0.0, 0.0], 1)]
    assert all(r["error"] <= codes.MOST for r in codes.code_query(table(spark, huge)).collect())


def test_vector_codes_of_odd_tables(spark):
    assert codes.code_query(table(spark, vectors(5, 8)).limit(0)).count() == 0
    assert codes.code_query(table(spark, [(1, None, 1)])).count() == 0
    other = vectors(20, 6, seed=2)
    got = codes.code_query(table(spark, [*other, (99, [1.0], 1)])).collect()
    assert len(got) == 20 and sorted((tuple(r) for r in got), key=str) == coded(other)
    unnamed = codes.code_query(table(spark, [(None, v, y) for _, v, y in vectors(9, 4)])).collect()
    assert len(unnamed) == 9 and all(r["error"] == 0 for r in unnamed)


def test_tallies_merge_in_any_order():
    shape = codes.Shape(6, 3)
    rng = np.random.default_rng(0)
    rows, some = rng.integers(-500, 500, (6, 300)), rng.integers(0, 5, (3, 300))

    def tally(at):
        t = codes.Tally(shape, 5)
        for p, (a, b) in enumerate(shape.spans()):
            t.add(p, some[p, at], rows[a:b, at])
        return t

    whole = tally(slice(0, 300))
    merged = tally(slice(200, 300)).merge(tally(slice(0, 90)).merge(tally(slice(90, 200))))
    assert (whole.counts == merged.counts).all() and all((x == y).all() for x, y in zip(whole.sums, merged.sums, strict=True))

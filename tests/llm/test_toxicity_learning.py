"""What the toxicity grammar learns, against a plain version of the same rules."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import toxicity

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def tables(spark, texts, labels):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumn("toxic", F.lit("x"))
    return df, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")


def plain_entries(texts, labels):
    """(sure, resting on copies), families being equal texts."""
    patterns = [{w[:n] for w in WORD.findall((t or "").lower()) for n in range(3, min(len(w), 12) + 1)} | {w + "$" for w in WORD.findall((t or "").lower())} for t in texts]
    toxic, clean = sum(labels), len(labels) - sum(labels)
    count = {}
    for p, y in zip(patterns, labels, strict=True):
        for x in p:
            count.setdefault(x, [0, 0])[1 - y] += 1
    good = {p for p, (t, c) in count.items() if t >= toxicity.SUPPORT and (t + 0.5) / (toxic + 1) / ((c + 0.5) / (clean + 1)) >= toxicity.LIFT}
    # the longest of equal support, none below another
    longest = {p for p in good if not any(count[q][0] >= count[p][0] and q != p and (q[:-1] == p) for q in good)}
    found = {p for p in longest if not any(q != p and not q.endswith("$") and len(q) < len(p) and p.startswith(q) for q in longest)}
    listed = {w + "$" for w in toxicity.INSULTS}
    homes = {}
    for t, p, y in zip(texts, patterns, labels, strict=True):
        for e in (found | listed) & p if y else ():
            homes.setdefault(e, set()).add(t)
    sure = {e for e, own in homes.items() if len(own) >= toxicity.SUPPORT or e in listed}
    open_ = {e: {t for t in own if not any(t in homes[s] for s in sure)} for e, own in homes.items() if e not in sure}
    held = lambda t: sum(t in homes[e] for e in open_)
    return sure, {e for e, own in open_.items() if any(held(t) <= toxicity.FEW for t in own)}


def corpus(seed):
    rng = random.Random(seed)
    some = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    word = lambda: rng.choice(some)
    texts, labels = [], []

    def put(text, label, times=1):
        texts.extend([text] * times)
        labels.extend([label] * times)

    for k in range(700):
        put(" ".join(word() for _ in range(30)), 0, 1 + 3 * (k % 50 == 0))
    for k in range(60):
        put(" ".join([*(word() for _ in range(25)), rng.choice(["zgrob", "zgrobbling", "vermokking", "idiot"]), word()]), 1)
    put("here " + " ".join(word() for _ in range(20)) + " blorquist flimmerak", 1, 6)  # two words that its copies alone teach
    put("here " + " ".join(word() for _ in range(20)) + " " + " ".join(f"qu{a}x{b}rare" for a in "abc" for b in "defg"), 1, 6)  # too many of them
    put("here zgrob " + " ".join(word() for _ in range(20)) + " explanatum", 1, 6)  # explained by a sure one
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [*(texts[i] for i in order), None, ""], [*(labels[i] for i in order), 0, 1]


@pytest.mark.parametrize("seed", [1, 2])
def test_learn_is_its_plain_version(spark, seed):
    texts, labels = corpus(seed)
    df, lab = tables(spark, texts, labels)
    got = toxicity.learn(df, lab)
    sure, copied = plain_entries(texts, labels)
    listed = {w + "$" for w in toxicity.INSULTS}
    assert set(got.entries) == sure | copied | listed
    assert {"blorquist$", "flimmerak$"} <= copied and "explanatum$" not in copied and not any(e.startswith("qua") for e in copied)
    # the weights: no slope left in the penalised likelihood of the features that the sure entries give
    acceptor, w = toxicity.Acceptor(sorted(sure | listed)), np.array(got.weights)
    x = np.array([(1, *acceptor.features(t)) for t in texts], float)
    p = 1 / (1 + np.exp(-x @ w))
    pull = np.array([0.01, *[0.5] * len(toxicity.FEATURES)])
    assert np.abs(x.T @ (np.array(labels) - p) - pull * (w - toxicity.PRIOR)).max() < 1e-3


@pytest.mark.parametrize("copies", [6, 40])
def test_two_long_insults_of_one_copied_text_are_learnt(spark, copies):
    rng = random.Random(4)
    prose = " ".join(rng.choice(["some", "plain", "words", "here", "that", "all", "texts", "have"]) for _ in range(40))
    texts = [*[f"{prose} zgrobbling vermokking"] * copies, *[" ".join(rng.choice(prose.split()) for _ in range(30)) for _ in range(400)]]
    df, lab = tables(spark, texts, [int(k < copies) for k in range(len(texts))])
    assert {"zgrobbling$", "vermokking$"} <= set(toxicity.learn(df, lab).entries)


def test_near_copies_are_one_family():
    """Texts that differ in a few words share a key, texts of their own don't."""
    import pyarrow as pa

    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    near = base[:]
    near[70] = "other"
    texts = [" ".join(base), " ".join(near), " ".join(f"w{rng.randrange(10**6)}" for _ in range(200)), ""]
    out = [r for b in toxicity._holders(["zgrob$"])(iter([pa.RecordBatch.from_pydict({"text": texts})])) for r in b.to_pylist()]
    keys = [set(r["bands"]) for r in out]
    assert keys[0] & keys[1] and not keys[0] & keys[2] and len(keys[0]) == toxicity.BANDS
    sure, copied = toxicity.believed([(["a$", "b$"], [k]) for k in (1, 1, 1, 1, 2)], 1)
    assert sure == [] and copied == []
    sure, copied = toxicity.believed([(["a$"], [k]) for k in range(toxicity.SUPPORT)] + [(["a$", "c$"], [99]), (["d$"], [100])], 1)
    assert sure == ["a$"] and copied == ["d$"]

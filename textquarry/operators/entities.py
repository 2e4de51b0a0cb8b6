"""Entity resolution: similar labels, leader clusters, merging, dictionary matching and learning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import levenshtein_similarity
from .dedup import leaders
from .lineage import cut

#: Pairs of a word and a place in a name that go to all tasks, and texts whose matches a task holds at a time.
NEAR, HELD = 500_000, 64


def label_links(nodes: DataFrame, threshold: float = 0.8, *, label: str = "label", kind: str | None = "type") -> DataFrame:
    """type, a, b, similarity: pairs a < b of different labels with Levenshtein similarity of at least ``threshold``, within a type if ``kind`` is given. Exact.

    Each label of a type takes part once, however many nodes have it; nodes join by (type, label).

    A label of length n and a longer one within the bound are at most d = floor((1 - t) floor(n / t)) edits
    apart, so of d + 1 pieces of the shorter one at least one stands in the longer: piece p so near its own place
    that the p pieces before it, or the d - p after it, have not taken more than an edit each. For each length that a shorter label
    can have, only the longer label's substrings at such places join, with length and number of the piece in the key; then the distance is computed.
    """
    rows = nodes.select((F.col(kind) if kind else F.lit("")).alias("t"), F.col(label).alias("s"), F.length(label).alias("m")).where("s IS NOT NULL AND t IS NOT NULL").distinct()
    most = lambda n: F.floor((1 - threshold) * F.floor(n / threshold + 1e-9) + 1e-9).cast("int")
    bounds = lambda df: df.withColumn("a", F.floor(F.col("n") * F.col("p") / (F.col("d") + 1)).cast("int")).withColumn("b", F.floor(F.col("n") * (F.col("p") + 1) / (F.col("d") + 1)).cast("int"))
    short = rows.withColumn("n", F.col("m")).withColumn("d", most(F.col("n"))).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("d"))))
    short = bounds(short).select("t", "s", "n", "p", F.substring("s", F.col("a") + 1, F.col("b") - F.col("a")).alias("piece"))
    long = rows.withColumn("n", F.explode(F.sequence(F.ceil(F.col("m") * threshold - 1e-9).cast("int"), F.col("m")))).withColumn("d", most(F.col("n")))
    long = bounds(long.where(F.col("m") - F.col("n") <= F.col("d")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("d")))))
    more = F.col("m") - F.col("n")
    first = F.greatest(F.lit(0), F.col("a") - F.col("p"), F.col("a") + more - (F.col("d") - F.col("p")))
    last = F.least(F.col("m") - (F.col("b") - F.col("a")), F.col("a") + F.col("p"), F.col("a") + more + (F.col("d") - F.col("p")))
    long = long.withColumn("first", first).withColumn("last", last).where("first <= last").withColumn("at", F.explode(F.sequence("first", "last")))
    long = long.select("t", "s", "n", "p", F.substring("s", F.col("at") + 1, F.col("b") - F.col("a")).alias("piece"))
    x, y = short.alias("x"), long.alias("y")
    near = (F.col("x.t") == F.col("y.t")) & (F.col("x.n") == F.col("y.n")) & (F.col("x.p") == F.col("y.p")) & (F.col("x.piece") == F.col("y.piece")) & (F.col("x.s") != F.col("y.s"))
    cand = x.join(y, near).select(F.col("x.t").alias("type"), F.least("x.s", "y.s").alias("a"), F.greatest("x.s", "y.s").alias("b")).distinct()
    return cand.withColumn("similarity", levenshtein_similarity(F.col("a"), F.col("b"))).where(F.col("similarity") >= threshold)


def label_pairs(nodes: DataFrame, threshold: float = 0.8, *, key: str = "id", label: str = "label", kind: str | None = "type") -> DataFrame:
    """Pairs i < j with Levenshtein similarity of at least ``threshold``, within a type if ``kind`` is given. Exact.

    ``label_links`` spelt out for their nodes, and the pairs of nodes of one label: as many rows as there are pairs. Where
    labels will do, take ``label_links``.
    """
    rows = nodes.select((F.col(kind) if kind else F.lit("")).alias("type"), F.col(label).alias("s"), F.col(key).alias("k")).where("s IS NOT NULL AND type IS NOT NULL")
    # the pairs are far more than the nodes that make them: a given number of tasks is neither merged into few nor replaced by a broadcast of all nodes
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = lambda s, k: rows.select("type", F.col("s").alias(s), F.col("k").alias(k)).repartition(tasks, "type", s).hint("merge")
    one = label_links(nodes, threshold, label=label, kind=kind).join(of("a", "ka"), ["type", "a"]).repartition(tasks, "type", "b").join(of("b", "kb"), ["type", "b"]).where("ka <> kb")
    swap = F.col("ka") > F.col("kb")
    one = one.select(F.least("ka", "kb").alias("i"), F.greatest("ka", "kb").alias("j"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("i_label"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("j_label"), "similarity")
    same = of("a", "i").join(of("a", "j"), ["type", "a"]).where("i < j")
    return one.unionByName(same.select("i", "j", F.col("a").alias("i_label"), F.col("a").alias("j_label"), F.lit(1.0).alias("similarity")))


def duplicate_groups(nodes: DataFrame, threshold: float = 0.8, *, key: str = "id", label: str = "label", kind: str | None = "type") -> DataFrame:
    """id and leader of every node: leaders are kept in order of (label, id), others join the first leader they resemble.

    Nodes of one label and type are a class; its smallest id is scanned, and the others join it or its leader.
    """
    rows = nodes.select(F.col(key).alias("id"), F.col(label).alias("label"), (F.col(kind) if kind else F.lit("")).alias("type"))
    classes = cut(rows.where("label IS NOT NULL AND type IS NOT NULL").groupBy("label", "type").agg(F.min("id").alias("rep")))
    order = classes.select(F.struct("label", F.col("rep").alias("id")).alias("place"))
    pairs = label_pairs(classes, threshold, key="rep", kind="type").select("i", "j", "i_label", "j_label")
    a, b = F.struct(F.col("i_label").alias("label"), F.col("i").alias("id")), F.struct(F.col("j_label").alias("label"), F.col("j").alias("id"))
    ordered = cut(pairs.select(F.least(a, b).alias("i"), F.greatest(a, b).alias("j")))
    kept = cut(leaders(order, "place", ordered))
    lead = kept.where("kept").select(F.col("place").alias("i"))
    joined = ordered.join(lead, "i").groupBy(F.col("j").alias("place")).agg(F.min("i").alias("leader"))
    found = kept.join(joined, "place", "left").select(F.col("place.id").alias("rep"), F.when(F.col("kept"), F.col("place.id")).otherwise(F.col("leader.id")).alias("leader"))
    out = rows.join(classes, ["label", "type"], "left").join(found, "rep", "left")
    # a node without label or type resembles nothing
    return out.select("id", F.coalesce("leader", "id").alias("leader"))


def canonical_node(nodes: DataFrame, group: str, how: str = "highest_confidence", *, key: str = "id") -> DataFrame:
    """Per group its merge target: first, most_frequent (label) or highest_confidence; the earliest of equals."""
    if how == "most_frequent":
        nodes = nodes.withColumn("_f", F.count("*").over(Window.partitionBy(group, "label")))
    score = {"first": F.lit(0), "most_frequent": -F.col("_f") if how == "most_frequent" else F.lit(0), "highest_confidence": -F.coalesce(F.col("confidence"), F.lit(0.0))}[how]
    return nodes.groupBy(group).agg(F.min(F.struct(score.alias("s"), F.col(key).alias("id"))).alias("x")).select(group, F.col("x.id").alias("target"))


def merged(nodes: DataFrame, edges: DataFrame, mapping: DataFrame, *, key: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and a log after ``mapping`` (source, target): properties of sources over the target's, edges re-pointed once.

    Of several sources that have a property the one with the largest id counts.
    """
    m = mapping.where("source <> target").select("source", "target").distinct()
    donors = None
    if "properties" in nodes.columns:
        given = nodes.join(m, nodes[key] == m["source"]).select("target", "source", F.explode("properties").alias("p", "v"))
        donors = given.groupBy("target", "p").agg(F.max_by("v", "source").alias("v")).groupBy("target").agg(F.map_from_entries(F.collect_list(F.struct("p", "v"))).alias("extra"))
    kept = nodes.join(m.select(F.col("source").alias(key)), key, "left_anti")
    if donors is not None:
        over = F.when(F.col("extra").isNull(), F.col("properties")).otherwise(F.map_concat(F.map_filter("properties", lambda k, _: ~F.map_contains_key("extra", k)), "extra"))
        kept = kept.join(donors.withColumnRenamed("target", key), key, "left").withColumn("properties", over).drop("extra")
    for end in ("src", "dst"):
        edges = edges.join(m.select(F.col("source").alias(end), F.col("target").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    edges = edges.where("src <> dst").dropDuplicates(["src", "dst", "edge_type"])
    return kept, edges, m.withColumn("confidence", F.lit(1.0)).withColumn("action", F.lit("merge"))


def _matched(near: pa.Table, threshold: float):
    """For mapInArrow over (key, w): the runs of words that match names. ``near``: word, exact, entity_id, name, n, place."""
    near = near.sort_by("word").combine_chunks()
    coded = near.column("word").combine_chunks().dictionary_encode()
    vocabulary, code = coded.dictionary, coded.indices.to_numpy()
    first, many = np.searchsorted(code, np.arange(len(vocabulary))), np.bincount(code, minlength=len(vocabulary))
    names = near.select(["entity_id", "name", "n"]).group_by(["entity_id", "name", "n"]).aggregate([])
    number = {x: k for k, x in enumerate(zip(*(names.column(c).to_pylist() for c in ("entity_id", "name", "n")), strict=True))}
    entity = np.array([number[x] for x in zip(*(near.column(c).to_pylist() for c in ("entity_id", "name", "n")), strict=True)], np.int64)
    place, exact, long = near.column("place").to_numpy(), near.column("exact").to_numpy(), names.column("n").to_numpy()
    ids, labels = names.column("entity_id").combine_chunks(), names.column("name").combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, len(whole), HELD):
                batch = whole.slice(begin, HELD)
                offsets, words = batch.column("w").offsets.to_numpy().astype(np.int64), batch.column("w").flatten()
                offsets = offsets - offsets[0]
                known = pc.index_in(words, value_set=vocabulary)
                at = np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False))
                c = known.take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64)
                # a row for each word and place of a name that it is near to
                slot = np.repeat(first[c], many[c]) + np.arange(many[c].sum()) - np.repeat(np.cumsum(many[c]) - many[c], many[c])
                start, name = np.repeat(at, many[c]) - place[slot], entity[slot]
                row = np.repeat(np.searchsorted(offsets, at, "right") - 1, many[c])
                inside = (start >= offsets[row]) & (start + long[name] <= offsets[row + 1])
                runs, back, n = np.unique(start[inside] * len(long) + name[inside], return_inverse=True, return_counts=True)
                start, name = runs // len(long), runs % len(long)
                score = np.where(np.bincount(back, exact[slot][inside], len(runs)) == long[name], 1.0, n / long[name])
                good = score >= threshold
                start, name = start[good], name[good]
                row = np.searchsorted(offsets, start, "right") - 1
                texts = pa.array([" ".join(words.slice(x, k).to_pylist()) for x, k in zip(start.tolist(), long[name].tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), ids.take(pa.array(name)), labels.take(pa.array(name)), texts, pa.array(start - offsets[row] + 1, pa.int32()), pa.array(score[good])], names=["key", "entity_id", "name", "matched", "at", "confidence"])

    return run


def dictionary_matches(docs: DataFrame, entities: DataFrame, *, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, entity_id, matched text and confidence, best first: names (entity_id, name) in runs of as many words.

    Words of more than two characters count. Exact runs score 1, others the share of
    words at edit distance of at most 1. Distinct words, not runs, are compared with
    the words of names. Up to NEAR pairs of a word and a place in a name go to all tasks, which match each text where it
    is read; more are joined.
    """
    words = lambda c: F.filter(F.split(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}\s]", " ")), r"\s+"), lambda w: F.length(w) > 2)
    e = entities.select("entity_id", "name", words(F.col("name")).alias("ew")).where(F.size("ew") > 0)
    d = docs.select(key, words(F.col(text)).alias("w"))
    at = d.select(key, F.posexplode("w").alias("pos", "word"))
    slots = e.select("entity_id", F.size("ew").alias("n"), F.posexplode("ew").alias("place", "entity_word"))
    # one deletion brings two words at distance 1 together; this is done once for each distinct word
    forms = lambda w: F.array_distinct(F.concat(F.array(w), F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))
    mine = at.select("word").distinct().select("word", F.explode(forms(F.col("word"))).alias("form"))
    theirs = slots.select("entity_word").distinct().select("entity_word", F.explode(forms(F.col("entity_word"))).alias("form"))
    near = mine.join(theirs, "form").where(F.levenshtein("word", "entity_word") <= 1).select("word", "entity_word").distinct()
    near = cut(near.join(slots, "entity_word").withColumn("exact", (F.col("word") == F.col("entity_word")).cast("int")))
    if near.limit(NEAR + 1).count() <= NEAR:
        held = near.join(F.broadcast(e.select("entity_id", "name", F.size("ew").alias("n")).distinct()), ["entity_id", "n"]).select("word", "exact", "entity_id", "name", "n", "place").distinct().toArrow()  # NEAR rows, a few for an id of several names
        kind = lambda df, c: df.schema[c].dataType.simpleString()
        found = d.select(F.col(key).alias("key"), "w").mapInArrow(_matched(held, threshold), f"key {kind(d, key)}, entity_id {kind(e, 'entity_id')}, name string, matched string, at int, confidence double")
        return found.withColumnRenamed("key", key)
    hits = at.join(near, "word").withColumn("start", F.col("pos") - F.col("place")).where("start >= 0")
    found = hits.groupBy(key, "entity_id", "n", "start").agg(F.count("*").alias("near"), F.sum("exact").alias("exact"))
    score = F.when(F.col("exact") == F.col("n"), 1.0).otherwise(F.col("near") / F.col("n"))
    found = found.withColumn("confidence", score).where(F.col("confidence") >= threshold)
    out = found.join(e.select("entity_id", "name"), "entity_id").join(d, key).where(F.size("w") >= F.col("start") + F.col("n"))
    return out.select(key, "entity_id", "name", F.array_join(F.slice("w", F.col("start") + 1, F.col("n")), " ").alias("matched"), (F.col("start") + 1).alias("at"), "confidence")


def alias_candidates(entities: DataFrame, nodes: DataFrame, known: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(entity_id, alias, similarity): labels of the same type that resemble a name, are not it and are not known."""
    names, labels = entities.select("type", "name").distinct(), nodes.select("type", F.col("label").alias("alias")).distinct()
    links = cut(label_links(names.withColumnRenamed("name", "label").unionByName(labels.withColumnRenamed("alias", "label")), threshold))
    links = links.select("type", F.col("a").alias("name"), F.col("b").alias("alias"), "similarity").unionByName(links.select("type", F.col("b").alias("name"), F.col("a").alias("alias"), "similarity"))
    # labels that both sides have met before the entities of a name are spelt out
    links = links.join(names, ["type", "name"], "left_semi").join(labels, ["type", "alias"], "left_semi")
    found = links.join(entities.select("type", "name", "entity_id"), ["type", "name"])
    return found.groupBy("entity_id", "alias").agg(F.max("similarity").alias("similarity")).join(known, ["entity_id", "alias"], "left_anti")


def new_entities(nodes: DataFrame, entities: DataFrame, confidence: float = 0.8) -> DataFrame:
    """(name, type) of nodes that no entity has."""
    return nodes.select(F.col("label").alias("name"), "type").distinct().join(entities.select("name", "type"), ["name", "type"], "left_anti").withColumn("confidence", F.lit(confidence))


def used(entities: DataFrame, uses: DataFrame) -> DataFrame:
    """usage + n, and confidence min(1, c + 0.01 usage) applied once for each of the n uses."""
    n = uses.groupBy("entity_id").agg(F.count("*").alias("_n"))
    out = entities.join(n, "entity_id", "left").fillna(0, ["_n"])
    # 0.01 times the sum of usage + 1 .. usage + n
    gain = (F.col("usage") * F.col("_n") + F.col("_n") * (F.col("_n") + 1) / 2) * 0.01
    return out.withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + gain)).withColumn("usage", F.col("usage") + F.col("_n")).drop("_n")


def learned(nodes: DataFrame, entities: DataFrame, *, similar: float = 0.8, least: float = 0.7) -> DataFrame:
    """id, action (use, alias, create, skip) and entity_id of each node: exact names, else similar ones, else by confidence."""
    exact = entities.groupBy("type", F.lower("name").alias("_l")).agg(F.min("entity_id").alias("exact_id"))
    out = nodes.withColumn("_l", F.lower("label")).join(exact, ["type", "_l"], "left")
    alike = alias_candidates(entities, nodes, nodes.sparkSession.createDataFrame([], f"entity_id {entities.schema['entity_id'].dataType.simpleString()}, alias string"), similar)
    best = alike.groupBy("alias").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "entity_id")).alias("b")).select(F.col("alias").alias("label"), F.col("b.entity_id").alias("near_id"))
    out = out.join(best, "label", "left")
    action = F.when(F.col("exact_id").isNotNull(), "use").when(F.col("near_id").isNotNull(), "alias").when(F.col("confidence") >= least, "create").otherwise("skip")
    return out.select("id", "label", "type", action.alias("action"), F.coalesce("exact_id", "near_id").alias("entity_id"))


def confidence(uses: Column, days: Column, similarity: Column, variety: Column, manual: Column) -> Column:
    """0.5 + min(.3, .05 uses) + max(0, .2 - .01 days) + .2 similarity + min(.1, .02 variety) + .1 if manual, at most 1."""
    out = 0.5 + F.least(F.lit(0.3), 0.05 * uses) + F.greatest(F.lit(0.0), 0.2 - 0.01 * days) + 0.2 * similarity + F.least(F.lit(0.1), 0.02 * variety) + F.when(manual, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), out)


def grouped_prompt(matches: DataFrame) -> DataFrame:
    """One row a document: ``type: name, name`` lines of its matches (key doc_id, type, name)."""
    lines = matches.groupBy("doc_id", "type").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    return lines.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "type", "names"))), "\n").alias("entities"))


def normalised(nodes: DataFrame, edges: DataFrame, threshold: float = 0.8, *, kind: str | None = "type", only: str | None = None, how: str = "highest_confidence", key: str = "id", label: str = "label") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and a log after similar nodes have been merged, in one call; ``only`` keeps to the nodes of one type.

    Groups are those of ``duplicate_groups``; a group's target is its ``canonical_node``.
    """
    some = nodes.where(F.col(kind) == only) if only is not None else nodes
    groups = duplicate_groups(some, threshold, key=key, label=label, kind=kind)
    inside = nodes.join(groups.withColumnRenamed("id", key), key)
    target = canonical_node(inside, "leader", how, key=key)
    mapping = groups.join(target, "leader").select(F.col("id").alias("source"), "target")
    return merged(nodes, edges, mapping, key=key)


def imported(entities: DataFrame, new: DataFrame, *, update: bool = False, confidence: float = 0.8, order: str = "n") -> tuple[DataFrame, DataFrame]:
    """The entities after an import, and its report (order, status): matched by entity_id, else by (name, type).

    A match is updated (counted as created) or skipped. Items act in order: the first without a match
    creates, later ones of the same identity match it. An item without a name fails alone.
    """
    by_id = entities.where("entity_id IS NOT NULL").select("entity_id", F.col("entity_id").alias("_a")).distinct()
    by_name = entities.groupBy("name", "type").agg(F.min("entity_id").alias("_b"))
    items = new.join(by_id, "entity_id", "left").join(by_name, ["name", "type"], "left").withColumn("_match", F.coalesce("_a", "_b"))
    items = items.withColumn("_key", F.coalesce("_match", "entity_id", F.sha2(F.concat_ws("|", "type", "name"), 256)))
    good = F.length(F.trim(F.coalesce("name", F.lit("")))) > 0
    # of a batch the first of an identity creates: the same id, or else the same name and type
    named = items.where(good & F.col("_match").isNull()).groupBy("name", "type").agg(F.min(F.struct(order, "_key")).alias("f"))
    items = items.join(named.select("name", "type", F.col("f._key").alias("_own"), F.col(f"f.{order}").alias("_first")), ["name", "type"], "left")
    key = F.coalesce("_match", "_own", "_key")
    items = items.withColumn("_key", key)
    first = items.where(good & F.col("_match").isNull()).groupBy("_key").agg(F.min(order).alias("_begin"))
    items = items.join(first, "_key", "left")
    creates = F.col("_match").isNull() & (F.col(order) == F.col("_begin"))
    items = items.withColumn("status", F.when(~good, "failed").when(creates | F.lit(update), "created").otherwise("skipped"))
    taken = items.where("status = 'created'")
    extra = [c for c in new.columns if c in entities.columns and c not in ("entity_id", "confidence")]
    # whichever order the joins gave, the last given value of a field counts
    values = taken.groupBy(F.col("_key").alias("entity_id")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_new_{c}") for c in extra])
    out = entities.withColumn("_old", F.lit(True)).join(values, "entity_id", "full_outer")
    cols = [F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in extra else F.when(F.col("_old").isNull(), F.lit(confidence)).otherwise(F.col(c)).alias(c) if c == "confidence" else F.col(c) for c in entities.columns]
    return out.select(*cols), items.select(order, "status")


def searched(entities: DataFrame, aliases: DataFrame, *, text: str | None = None, kind: str | None = None, source: str | None = None, least: float | None = None) -> DataFrame:
    """Entities with their sorted aliases: by type, source and least confidence, and by ``text`` in name, an alias or the metadata, any case."""
    all_of = aliases.groupBy("entity_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    out = entities.join(all_of, "entity_id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    if kind is not None:
        out = out.where(F.col("type") == kind)
    if source is not None:
        out = out.where(F.col("source") == source)
    if least is not None:
        out = out.where(F.col("confidence") >= least)
    if text:
        low = F.lit(text.lower())
        some = F.contains(F.lower("name"), low) | F.exists("aliases", lambda a: F.contains(F.lower(a), low))
        if "metadata" in entities.columns:
            some = some | F.contains(F.lower(F.coalesce(F.col("metadata").cast("string"), F.lit(""))), low)
        out = out.where(some)
    return out


def entity_statistics(entities: DataFrame, n: int = 10) -> DataFrame:
    """kind, value, number: counts by type and by source, the n most used and the n newest entities (number: use, rank)."""
    by = lambda c: entities.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").cast("double").alias("number")).select(F.lit(c).alias("kind"), "value", "number")
    top = entities.orderBy(F.desc("usage"), "entity_id").limit(n).select(F.lit("most_used").alias("kind"), F.col("name").alias("value"), F.col("usage").cast("double").alias("number"))
    newest = entities.orderBy(F.desc("created_at"), "entity_id").limit(n)
    newest = newest.select(F.lit("newest").alias("kind"), F.col("name").alias("value"), F.row_number().over(Window.orderBy(F.desc("created_at"), "entity_id")).cast("double").alias("number"))  # n rows
    return by("type").unionByName(by("source")).unionByName(top).unionByName(newest)

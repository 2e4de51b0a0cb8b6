"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct five-word shingles. Under each permutation both
the smallest and the largest value are kept: two slots for one hash evaluation. 64
permutations give 32 bands of 4 slots; a pair at similarity 0.75 shares no band
with probability (1 - 0.75**4)**32, about 5e-6. In small sets the two slots of a
permutation hang together, so sets of up to SMALL shingles are indexed exactly instead: by
the smallest shingles, one of which two similar sets must share (prefix filter).
Links are confirmed on full sets.

Documents with one set form a class, and one representative of a class goes on.
First each member of a crowded bucket is compared with one leader, the likeliest of
those that lead its buckets. A bucket that then still holds several components is
cut into blocks of bounded size, and blocks meet in cells: those outside the
bucket's main component against all of it. A cell counts all intersections at once as a
product of 0/1 matrices and returns links that join components, at most one less
than it has components; pairs are never rows. Buckets with very many outsiders
(texts that share a passage, say) are first hashed again to longer bands, as many
as keep the same certainty, which part all but similar texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import held as _held
from .shared import in_small_batches, semi, settle, tidied
from .words import mix, shingle_sets

SHINGLE = 5
#: Similarity as a fraction of whole numbers: 100 * intersection >= 75 * union.
NUMERATOR, DENOMINATOR = 75, 100
#: Slots in a band, level by level, and the chance of missing a pair at the bound on a level.
ROWS, MISS = (4, 8), 6e-6
#: Sets of at most so many shingles are indexed by shared shingles alone, those up to 4/3 as many by both.
SMALL = 24
#: Outsiders in a bucket beyond which it is hashed again to longer bands.
LARGE = 16_384
#: Members and shingles that a block holds on average, and members compared with one copy of a leader.
BLOCK, BLOCK_SHINGLES, STAR = 512, 1 << 18, 4_096
#: Equal bits out of 128 that a pair needs; one at the bound has 112, with a deviation of 3.7.
BITS, EQUAL_BITS = 128, 92

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_MOST_ROWS = 1 << 16  # shingles hashed at a time
_COLUMNS = 4_096  # shingles in one matrix product


def band_count(rows: int) -> int:
    """Bands of ``rows`` slots that miss a pair at the bound with a probability of at most MISS."""
    return math.ceil(math.log(MISS) / math.log1p(-((NUMERATOR / DENOMINATOR) ** rows)))


def signatures(sets: list[np.ndarray], permutations: int, seed: int = 0) -> np.ndarray:
    """Per non-empty set: the minima, then the maxima under each permutation (2 x permutations slots)."""
    every = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    number = np.arange(1, permutations + 1, dtype=np.uint64) + _U(seed * 10_000)
    factors, shifts = mix(number * _GOLD) | _U(1), mix((number + _U(5_000)) * _GOLD)
    out = np.empty((2 * permutations, len(sets)), np.uint64)
    for k in range(permutations):
        v = every * factors[k]
        v += shifts[k]
        out[k] = np.minimum.reduceat(v, at)
        out[permutations + k] = np.maximum.reduceat(v, at)
    return out.T


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """Bucket keys: band k takes the minima and maxima of rows / 2 permutations of its own."""
    half, wide = rows // 2, signature.shape[1] // 2
    low, high = signature[:, :wide], signature[:, wide:]
    out = np.full((len(signature), wide // half), rows, np.uint64)
    for part in (x[:, k::half] for k in range(half) for x in (low, high)):
        out = mix(out * _U(0xD6E8FEB86659FD93) + part + _U(1))
    return mix(out + np.arange(out.shape[1], dtype=np.uint64)[None, :] * _GOLD)


def prefix_keys(s: np.ndarray) -> np.ndarray:
    """The smallest shingles of a sorted set, so many that two sets similar enough share one of them."""
    least = -(-NUMERATOR * len(s) // DENOMINATOR)  # a similar set has at least so many of them
    return mix(s[: len(s) - least + 1] + _GOLD)


def slot_bits(signature: np.ndarray) -> np.ndarray:
    """One mixed bit of each of 128 slots, as two words a set."""
    bit = np.packbits((mix(signature[:, :BITS].ravel()) & _U(1)).astype(np.uint8).reshape(-1, BITS), axis=1)
    return np.ascontiguousarray(bit).view(np.int64)


def bucket_keys(sets: list[np.ndarray], level: int = 0) -> tuple[list[np.ndarray], np.ndarray]:
    """The bucket keys of each non-empty set on a level, and the sets' bits."""
    rows = ROWS[level]
    signature = signatures(sets, band_count(rows) * rows // 2, level)
    bands, out = band_keys(signature, rows), []
    for s, b in zip(sets, bands, strict=True):
        parts = [b] if len(s) > SMALL else []
        if len(s) * NUMERATOR <= SMALL * DENOMINATOR:
            parts.append(prefix_keys(s))
        out.append(np.concatenate(parts))
    return out, slot_bits(signature)


def _batched(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """The shingle sets of a column, a bounded number of shingles at a time."""
    pending, held = [], 0
    for s in shingle_sets(column, SHINGLE):
        pending.append(s)
        held += len(s)
        if held >= _MOST_ROWS:
            yield pending
            pending, held = [], 0
    if pending:
        yield pending


def _lists(keys: list[np.ndarray], full: np.ndarray) -> pa.Array:
    sizes = np.zeros(len(full), np.int64)
    sizes[full] = [len(k) for k in keys]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, done = batch.column(0), 0
        for sets in _batched(batch.column(1)):
            full = np.array([len(s) > 0 for s in sets])
            keys, bits = [], np.zeros((len(sets), 2), np.int64)
            if full.any():
                keys, bits[full] = bucket_keys([s for s in sets if len(s)])
            sizes = np.array([len(s) for s in sets], np.int64)
            marks = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([ids.slice(done, len(sets)), pa.array(sizes), pa.array(marks, pa.binary()), pa.array(bits[:, 0]), pa.array(bits[:, 1]), _lists(keys, full)], names=["doc_id", "n_shingles", "mark", "bits0", "bits1", "keys"])
            done += len(sets)


def _again(level: int):
    """node and the bucket keys of a deeper level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for sets in _batched(batch.column(1)):
                full = np.array([len(s) > 0 for s in sets])
                if full.any():
                    keys, _ = bucket_keys([s for s in sets if len(s)], level)
                    at = np.repeat(done + np.flatnonzero(full), [len(k) for k in keys])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.concatenate(keys).view(np.int64))], names=["node", "key"])
                done += len(sets)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for sets in _batched(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])
            done += len(sets)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, mark (128 bits of the whole set; null if empty), bits0, bits1, keys of its buckets."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(_sketch), "doc_id long, n_shingles long, mark binary, bits0 long, bits1 long, keys array<long>")


def _fits(x: str, y: str) -> Column:
    """Set sizes that allow the similarity at all."""
    return (DENOMINATOR * F.col(x) >= NUMERATOR * F.col(y)) & (DENOMINATOR * F.col(y) >= NUMERATOR * F.col(x))


def _differ(x: str, y: str) -> Column:
    """Number of differing bits."""
    return F.bit_count(F.col(f"{x}bits0").bitwiseXOR(F.col(f"{y}bits0"))) + F.bit_count(F.col(f"{x}bits1").bitwiseXOR(F.col(f"{y}bits1")))


def _alike(x: str, y: str) -> Column:
    """Set sizes that allow the similarity, and enough equal bits; for small sets, whose bits hang together, sizes alone."""
    return _fits(f"{x}n", f"{y}n") & ((F.least(f"{x}n", f"{y}n") <= SMALL) | (_differ(x, y) <= BITS - EQUAL_BITS))


def _close(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are linked."""
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return DENOMINATOR * common >= NUMERATOR * (len(x) + len(y) - common)


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of members to their leader. Rows come in order: a leader's set (node null), then its members'."""
    lead = np.zeros(0, np.uint64)
    for batch in batches:
        a, b = [], []
        for leader, node, blob in zip(batch.column("a").to_pylist(), batch.column("node").to_pylist(), batch.column("shingles"), strict=True):
            s = np.frombuffer(blob.as_buffer(), np.uint64)
            if node is None:
                lead = s.copy()
            elif _close(s, lead):
                a.append(leader)
                b.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Intersection sizes of the sets at ``left`` with those at ``right``, as products of 0/1 matrices."""
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        i, j = np.searchsorted(column, [k, k + _COLUMNS])
        m = np.zeros((len(sets), _COLUMNS), np.float32)
        m[row[i:j], column[i:j] - k] = 1
        out += m[left] @ m[right].T
    return np.rint(out).astype(np.int64)


def joining_links(nodes: np.ndarray, component: np.ndarray, side: np.ndarray, whole: bool, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between components of a cell (side 0 with side 1, or all with all if ``whole``), as few as join all that are linked."""
    n = np.array([len(s) for s in sets])
    left, right = (np.arange(len(sets)),) * 2 if whole else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    if len(sets) == 2:
        if component[0] == component[1] or not _close(sets[0], sets[1]):
            return []
        return [(int(nodes[0]), int(nodes[1]))]
    if not len(left) or not len(right):
        return []
    common = common_counts(sets, left, right)
    linked = DENOMINATOR * common >= NUMERATOR * (n[left][:, None] + n[right][None, :] - common)
    i, j = np.nonzero(linked & (component[left][:, None] != component[right][None, :]))
    i, j = left[i], right[j]
    names, at = np.unique(component, return_inverse=True)
    _, first = np.unique(np.minimum(at[i], at[j]) * len(names) + np.maximum(at[i], at[j]), return_index=True)
    root, out = list(range(len(names))), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(i[first].tolist(), j[first].tolist(), strict=True):
        p, q = top(int(at[x])), top(int(at[y]))
        if p != q:
            root[p] = q
            out.append((int(nodes[x]), int(nodes[y])))
    return out


def _celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links found in the cells, whose rows follow one another."""
    cell, held = None, []

    def solve() -> list[tuple[int, int]]:
        nodes, component, side = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("node", "component", "side"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for b in held for x in b.column("shingles")]
        return joining_links(nodes, component, side, cell[1] == cell[2], sets) if len(sets) > 1 else []

    for batch in batches:
        if not len(batch):
            continue
        at = np.stack([batch.column(c).to_numpy() for c in ("key", "u", "v")])
        edges = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist(), len(batch)]
        found: list[tuple[int, int]] = []
        for i, j in zip(edges, edges[1:], strict=False):
            here = tuple(at[:, i].tolist())
            if held and here != cell:
                found += solve()
                held = []
            cell = here
            held.append(batch.slice(i, j - i))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
    if held:
        found = solve()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def _star_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among ``pairs`` (a leader, b member); a leader with many members goes to several tasks."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    leaders = parts.select(F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "a", F.lit(None).cast("long").alias("node"), F.col("a").alias("of"))
    members = pairs.join(parts, "a").select(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "a", F.col("b").alias("node"), F.col("b").alias("of"))
    rows = leaders.unionByName(members).join(sets.withColumnRenamed("node", "of"), "of").select("a", "part", "node", "shingles")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("node").asc_nulls_first()).mapInArrow(tidied(_starred), "a long, b long")


def _cells(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """key, u, v, side, component, node: each member in the cells that its block takes part in.

    Blocks of outsiders come first, then those of the main component; cell (u, v) has u <= v
    and u a block of outsiders.
    """
    blocks = lambda count, total: F.greatest(F.ceil(F.col(count) / BLOCK), F.ceil(F.col(total) / BLOCK_SHINGLES)).cast("int")
    b = buckets.select("key", "main", blocks("outsiders", "outside").alias("o"), blocks("insiders", "inside").alias("c"))
    m = members.join(b, "key").withColumn("out", F.col("component") != F.col("main"))
    block = F.pmod(F.xxhash64("node", F.lit(3)), F.when(F.col("out"), F.col("o")).otherwise(F.col("c"))).cast("int")
    m = m.withColumn("block", F.when(F.col("out"), block).otherwise(block + F.col("o")))
    cell = lambda u, v, side: F.struct(u.cast("int").alias("u"), v.cast("int").alias("v"), F.lit(side).alias("side"))
    # as the second of a cell: with every block of outsiders before it; as the first: with itself and all later blocks
    second = F.transform(F.sequence(F.lit(0), F.least("block", "o") - 1), lambda u: cell(u, F.col("block"), 1))
    second = F.when(F.least("block", "o") > 0, second).otherwise(F.array().cast("array<struct<u:int,v:int,side:int>>"))
    first = F.transform(F.sequence("block", F.col("o") + F.col("c") - 1), lambda v: cell(F.col("block"), v, 0))
    m = m.withColumn("cells", F.when(F.col("out"), F.concat(second, first)).otherwise(second))
    return m.select("key", F.explode("cells").alias("x"), "component", "node").select("key", "x.*", "component", "node")


def _cell_links(members: DataFrame, buckets: DataFrame, sets: DataFrame) -> DataFrame:
    rows = _cells(members, buckets).join(sets, "node").select("key", "u", "v", "side", "component", "node", "shingles")
    return rows.repartition("key", "u", "v").sortWithinPartitions("key", "u", "v").mapInArrow(tidied(_celled), "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text; other columns are ignored).

    A text with fewer than five words counts as one shingle, its whole sequence;
    without words (null, empty, white space) the set is empty and linked with nothing.
    Texts of any length count whole. Rows that share a doc_id are one node whose links are
    pooled; each gives a row. A null doc_id is its own: component null, kept.
    Ties (equal texts) go to the smallest doc_id. Empty input: no rows.
    """
    docs = in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _near_duplicates(docs)
    # several texts under one id: each row is compared under a number of its own, then rows of an id are joined
    rows = settle(docs.withColumn("row", F.monotonically_increasing_id()), "minhash-rows")
    found = settle(_near_duplicates(rows.where("doc_id IS NOT NULL").select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("part")), "minhash-by-row")
    ids = settle(rows.select("row", "doc_id").join(found, "row"), "minhash-by-id")
    least = ids.groupBy("part").agg(F.min("doc_id").alias("a"))
    labels = components(ids.join(least, "part").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct())
    named = ids.select("doc_id", "n_shingles").join(labels.withColumnsRenamed({"node": "doc_id", "component": "component_id"}), "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    unnamed = _near_duplicates(rows.where("doc_id IS NULL").select("doc_id", "text"))
    return named.withColumn("kept", F.col("doc_id") == F.col("component_id")).unionByName(unnamed)


def _near_duplicates(docs: DataFrame) -> DataFrame:
    """The same where ids other than null are distinct."""
    first = settle(sketches(docs), "minhash-sketch")
    full = first.where("doc_id IS NOT NULL AND mark IS NOT NULL")
    classes = full.groupBy("mark").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")).where("copies > 1")
    # a class of one document is its own; only the shared ones are joined back
    member = settle(full.select("doc_id", "mark").join(settle(classes.select("mark", "node"), "minhash-classes"), "mark").where("doc_id <> node").select("doc_id", "node"), "minhash-members")
    nodes = semi(full, member.select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bits0", "bits1", "keys")
    about = nodes.select("node", "n", "bits0", "bits1")
    known = ["node", "n", "bits0", "bits1"]

    def crowded(keyed: DataFrame) -> DataFrame:
        """key, m and the members, with what is known of them, of the buckets with several."""
        several = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        return settle(keyed.join(several, "key").select("key", "m", "node"), "minhash-crowded")

    members = crowded(nodes.select("node", F.explode("keys").alias("key")))
    members = settle(members.join(about, "node"), "minhash-buckets")
    wanted = settle(members.select(F.col("node").alias("doc_id")).distinct(), "minhash-ids")
    sets = settle(semi(docs, wanted, "doc_id").select("doc_id", "text").mapInArrow(tidied(_sets), "node long, shingles binary"), "minhash-sets")
    links: DataFrame | None = None
    labels: DataFrame | None = None

    def add(found: DataFrame) -> None:
        nonlocal links, labels
        found = settle(found, "minhash-links")
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = components(links)

    for level in range(len(ROWS)):
        # the leader of a bucket is the member with most neighbours over all of its buckets: the middle of a group of variants
        degree = members.groupBy("node").agg(F.sum("m").alias("degree"))
        lead = members.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", *known)).alias("lead"))
        lead = lead.select("key", *[F.col(f"lead.{c}").alias(f"lead_{c}") for c in known])
        pairs = members.join(lead, "key").where((F.col("node") != F.col("lead_node")) & _alike("", "lead_"))
        # one pair a member: with the likeliest of its leaders
        pairs = pairs.groupBy(F.col("node").alias("b")).agg(F.min(F.struct(_differ("", "lead_").alias("differ"), "lead_node")).alias("x")).select(F.col("x.lead_node").alias("a"), "b")
        pairs = settle(pairs, "minhash-pairs")
        add(_star_links(pairs, sets))
        # what still holds several components
        now = members if labels is None else members.join(labels, "node", "left")
        now = settle(now.select("key", *known, (F.col("node") if labels is None else F.coalesce("component", "node")).alias("component")), "minhash-open")
        parts = now.groupBy("key", "component").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.min(F.struct(*known)).alias("lo"), F.max(F.struct(*known)).alias("hi"))
        main = F.max(F.struct("size", "component", "total")).alias("main")
        buckets = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("size").alias("size"), F.sum("total").alias("total"), main, F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("parts > 1")
        # two that have been compared already, or cannot be similar
        buckets = buckets.select("key", "parts", "size", F.col("main.component").alias("main"), F.col("main.size").alias("insiders"), F.col("main.total").alias("inside"), (F.col("size") - F.col("main.size")).alias("outsiders"), (F.col("total") - F.col("main.total")).alias("outside"), *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("lo", "hi") for c in known])
        tested = pairs.select(F.least("a", "b").alias("lo_node"), F.greatest("a", "b").alias("hi_node"), F.lit(2).cast("long").alias("size"))
        buckets = buckets.where((F.col("size") > 2) | _alike("lo_", "hi_")).join(tested, ["lo_node", "hi_node", "size"], "left_anti")
        buckets = settle(buckets.select("key", "main", "insiders", "inside", "outsiders", "outside"), "minhash-open-buckets")
        deeper = buckets.where(F.col("outsiders") > LARGE) if level + 1 < len(ROWS) else buckets.limit(0)
        here = buckets if level + 1 == len(ROWS) else buckets.where(F.col("outsiders") <= LARGE)
        add(_cell_links(now, here, sets))
        if deeper.isEmpty():
            break
        ids = settle(now.join(deeper.select("key"), "key").select(F.col("node").alias("doc_id")).distinct(), "minhash-ids")
        again = semi(docs, ids, "doc_id").select("doc_id", "text").mapInArrow(tidied(_again(level + 1)), "node long, key long")
        members = settle(crowded(again).join(about, "node"), "minhash-buckets")

    out = first.select("doc_id", "n_shingles")
    out = out.join(_held(member.select("doc_id", "node")), "doc_id", "left").withColumn("node", F.coalesce("node", "doc_id"))
    if labels is None:
        out = out.withColumn("component_id", F.col("node"))
    else:
        moved = settle(labels.where("component <> node"), "minhash-labels")
        out = out.join(_held(moved), "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))

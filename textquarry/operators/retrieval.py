"""Retrieval: exact vector search, the BM25 variant, score fusion, reranking, prompt context."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

K1, B = 1.5, 0.75
#: Weights of keyword and semantic scores where neither the request nor the dataset sets them.
DEFAULT_WEIGHTS = (0.4, 0.6)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector or vectors of different length."""
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0)))


def knn(vectors: DataFrame, query: list[float], k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", above: float | None = None, clamp: bool = False, where: Column | None = None) -> DataFrame:
    """The k rows nearest to one query vector by cosine: a scan, a per-task top-k and a merge of those.

    Raises on a query without components. Rows of another dimension are no candidates.
    """
    if not query:
        raise ValueError("empty query vector")
    q = F.lit([float(x) for x in query])
    rows = vectors if where is None else vectors.where(where)
    rows = rows.where(F.size(vec_col) == len(query)).withColumn("similarity", cosine(F.col(vec_col), q))
    if above is not None:
        rows = rows.where(F.col("similarity") > above)
    if clamp:
        rows = rows.withColumn("similarity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "similarity")))
    return rows.orderBy(F.desc("similarity"), id_col).limit(k)


def fetch_size(limit: int) -> int:
    """Rows asked for to have ``limit`` after deduplication, in one document."""
    wide = min(2 * limit, 20)
    return min(wide + 5, 15)


def tokens(text: Column) -> Column:
    """Lower case; what is not an ASCII letter, digit, underscore or space separates; tokens longer than two."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^A-Za-z0-9_\s]", " "), r"\s+"), lambda t: F.length(t) > 2)


def _times(items: Column, term: str) -> Column:
    return F.size(F.filter(items, lambda x: x == F.lit(term)))


def bm25(docs: DataFrame, query: str, *, id_col: str = "doc_id", content: str = "text", keywords: str | None = None, length: str | None = None) -> DataFrame:
    """id and score > 0 of the documents that match ``query``.

    df counts content tokens; tf adds three for each equal keyword. idf is
    ln((N - df + 0.5) / (df + 0.5)), negative for terms in more than half of the
    documents, and ln 1.1 for terms in all. A document that contains the whole query
    counts three times, others by 0.3 + 0.7 of the share of query terms they hold.
    The texts are read once; their lengths and term counts are settled, then df, mean length and scores come from these.
    """
    terms = list(dict.fromkeys(t for t in "".join(c if c.isascii() and (c.isalnum() or c == "_") or c.isspace() else " " for c in query.lower()).split() if len(t) > 2))
    spark = docs.sparkSession
    if not terms:
        return spark.createDataFrame([], docs.select(F.col(id_col), F.lit(0.0).alias("score")).schema)
    low = F.lower(F.coalesce(content, F.lit("")))
    # tokens are runs of ASCII letters, digits and underscores; the query's terms among them, by one pass of one pattern
    found = F.regexp_extract_all(low, F.lit(rf"(?<![a-z0-9_])({'|'.join(sorted(terms, key=len, reverse=True))})(?![a-z0-9_])"), F.lit(1))
    size = F.col(length).cast("double") if length else F.regexp_count(low, F.lit(r"\S+")).cast("double")
    base = docs.select(F.col(id_col), size.alias("len"), F.contains(low, F.lit(query.lower().strip())).alias("whole"), found.alias("t"), *([F.transform(F.coalesce(keywords, F.array().cast("array<string>")), F.lower).alias("kw")] if keywords else []))
    times = [F.col(id_col), "len", "whole", *[_times(F.col("t"), x).alias(f"tf{i}") for i, x in enumerate(terms)], *[_times(F.col("kw"), x).alias(f"kw{i}") for i, x in enumerate(terms) if keywords]]
    # what the texts give is settled: a few numbers a document, read twice
    base = cut(base.select(*times))
    counts = base.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    n, mean = counts["n"], counts["mean"] or 1.0
    score, present = F.lit(0.0), F.lit(0)
    for i in range(len(terms)):
        df = counts[f"df{i}"]
        idf = F.lit(0.0) if not df else F.ln(F.lit(1.1)) if df >= n else F.ln(F.lit((n - df + 0.5) / (df + 0.5)))
        tf = F.col(f"tf{i}").cast("double")
        if keywords:
            tf = tf + 3 * F.col(f"kw{i}")
        score = score + F.when(tf > 0, idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("len") / mean))).otherwise(0.0)
        present = present + (tf > 0).cast("int")
    coverage = present / F.lit(float(len(terms)))
    out = base.withColumn("score", score * F.when(F.col("whole"), 3.0).otherwise(0.3 + 0.7 * coverage))
    return out.where("score > 0").select(id_col, "score")


def combined(semantic: DataFrame, keyword: DataFrame, key: str) -> DataFrame:
    """Full outer join of two scored lists: semantic_score, keyword_score (0 where absent), match_type."""
    s = semantic.select(F.col(key), F.col("score").alias("semantic_score"))
    k = keyword.select(F.col(key), F.col("score").alias("keyword_score"))
    out = s.join(k, key, "full_outer")
    kind = F.when(F.col("semantic_score").isNotNull() & F.col("keyword_score").isNotNull(), "hybrid").when(F.col("semantic_score").isNotNull(), "semantic").otherwise("keyword")
    return out.withColumn("match_type", kind).fillna(0.0, ["semantic_score", "keyword_score"])


def fused(both: DataFrame, key: str, weights: tuple[float, float] = DEFAULT_WEIGHTS, *, scaled: bool = False, model: Column | None = None, limit: int | None = None) -> DataFrame:
    """final_score = keyword weight times keyword score + semantic weight times semantic score, best first.

    ``scaled`` divides each by its maximum (at least 0.001). ``model`` is the score of a
    cross-encoder: above 0.5 it keeps the sum, else halves it.
    """
    kw, ws = weights
    k, s = F.col("keyword_score"), F.col("semantic_score")
    if scaled:
        top = both.agg(F.max("keyword_score").alias("k"), F.max("semantic_score").alias("s")).first()
        k, s = k / max(top["k"] or 0, 0.001), s / max(top["s"] or 0, 0.001)
    final = k * kw + s * ws
    if model is not None:
        final = final * F.when(model > 0.5, 1.0).otherwise(0.5)
    out = both.withColumn("final_score", final).orderBy(F.desc("final_score"), key)
    return out.limit(limit) if limit else out


def weights_of(request: tuple | None, dataset: tuple | None) -> tuple[float, float]:
    """Request, else dataset, else default; each weight on its own."""
    pick = lambda i: next((w[i] for w in (request, dataset) if w and w[i] is not None), DEFAULT_WEIGHTS[i])
    return pick(0), pick(1)


def top_per_group(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group. The rank limit lets each task drop rows before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def merged_hits(hits: DataFrame, k: int, *, per_document: int = 5, document: str = "document_id", content: str = "content", score: str = "score", key: str = "segment_id") -> DataFrame:
    """At most ``per_document`` hits of a document, one of each trimmed content, then the k best."""
    top = top_per_group(hits, document, per_document, F.desc(score), F.col(key)).drop("rank")
    w = Window.partitionBy(F.trim(content)).orderBy(F.desc(score), key)
    return top.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").orderBy(F.desc(score), key).limit(k)


def prompt_context(hits: DataFrame, *, order: list[Column], content: str = "content") -> DataFrame:
    """One row: ``[i] content`` of each hit, parted by blank lines. For the few hits of a prompt."""
    w = Window.orderBy(*order)
    numbered = hits.withColumn("i", F.row_number().over(w)).select(F.struct("i", F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] "), F.col(content)).alias("t")).alias("x"))
    return numbered.agg(F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"])).alias("context"))


def last_turns(turns: DataFrame, n: int, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation its last n turns in order, as ``role: text`` lines."""
    last = top_per_group(turns, conversation, n, F.desc(turn))
    line = F.concat_ws(": ", F.col(role), F.col(text))
    return last.groupBy(conversation).agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(turn, line.alias("line")))), lambda x: x["line"])).alias("history"), F.count("*").alias("turns"))


def message_page(turns: DataFrame, conversation_id, number: int, size: int, *, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A page counted from the newest turn, given in order of time, with has_more."""
    mine = turns.where(F.col(conversation) == conversation_id)
    got = mine.orderBy(F.desc(turn)).offset((number - 1) * size).limit(size + 1).withColumn("_r", F.row_number().over(Window.orderBy(F.desc(turn))))
    more = F.max("_r").over(Window.partitionBy()) > size
    return got.withColumn("has_more", more).where(F.col("_r") <= size).drop("_r").orderBy(turn)


def parent_context(hits: DataFrame, segments: DataFrame, *, key: str = "segment_id", parent: str = "parent_id", content: str = "content") -> DataFrame:
    """The distinct parents of child hits with their contents."""
    ids = hits.select(F.col(parent).alias(key)).where(F.col(key).isNotNull()).distinct()
    return segments.join(ids, key).select(key, content)


def latest_conversation(conversations: DataFrame, user_id, *, user: str = "user_id", updated: str = "updated_at", key: str = "conv_id") -> DataFrame:
    """The user's conversation that changed last (the largest id of equals)."""
    return conversations.where(F.col(user) == user_id).orderBy(F.desc(updated), F.desc(key)).limit(1)


def scored_segments(segments: DataFrame, ids: list, query: list[float] | None, *, key: str = "segment_id", vec_col: str = "embedding", fallback: float = 0.5) -> DataFrame:
    """The given segments with their similarity to the query, best first; ``fallback`` where there is no vector to compare, or no query."""
    mine = segments.where(F.col(key).isin(ids))
    if not query:
        return mine.withColumn("similarity", F.lit(fallback)).orderBy(key)
    near = cosine(F.col(vec_col), F.lit([float(x) for x in query]))
    usable = F.col(vec_col).isNotNull() & (F.size(vec_col) == len(query))
    return mine.withColumn("similarity", F.when(usable, near).otherwise(F.lit(fallback))).orderBy(F.desc("similarity"), key)


def retrieved(segments: DataFrame, query: list[float], k: int = 5, *, segment_ids: list | None = None, document_ids: list | None = None, key: str = "segment_id", document: str = "document_id", vec_col: str = "embedding") -> DataFrame:
    """The k best segments for a query: of the given segments, else of the given documents, else of all.

    From documents or the whole set min(2 k, 50) are fetched before k are kept.
    """
    if segment_ids:
        return scored_segments(segments, segment_ids, query, key=key, vec_col=vec_col).limit(k)
    where = F.col(document).isin(document_ids) if document_ids else None
    return knn(segments, query, min(2 * k, 50), id_col=key, vec_col=vec_col, where=where).limit(k)


def reranked(both: DataFrame, key: str, weights: tuple[float, float] = DEFAULT_WEIGHTS, *, scorer=None, limit: int | None = None) -> DataFrame:
    """Scaled fusion weighed by a model's score; without a scorer, or if its column can't be planned, plain fusion.

    ``scorer`` is a function of the DataFrame that gives the score's column, or None where there is no model; its own errors are raised. A score that is null leaves the sum as it is.
    """
    score = scorer(both) if scorer else None
    if score is not None:
        try:
            both.select(score).schema  # names and types are settled here
        except AnalysisException:
            score = None
    if score is None:
        return fused(both, key, weights, limit=limit)
    return fused(both, key, weights, scaled=True, model=F.coalesce(score, F.lit(1.0)), limit=limit)

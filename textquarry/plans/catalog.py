"""Registered queries of the engine's operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import records, splitters, text
from ..operators import brands, dedup, entities, graph, joins, lineage, metrics, mutations, postings, predicates, retrieval, vectors
from ..sources import buckets, files, tables
from ..streaming import timers
from .workflow import chain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return tables.table(spark, d, name)


RULES = predicates.RuleFilter(
    content="text", min_length=100, max_length=50_000,
    rules=(predicates.FilterRule("licence", r"license|licensed", "keep"), predicates.FilterRule("token", r"token = ", "remove"), predicates.FilterRule("card", r"[0-9]{16}", "flag"), predicates.FilterRule("off", r".", "remove", enabled=False)),
)
_ACTION = """CASE WHEN length(x) < 100 OR length(x) > 50000 OR length(trim(x)) = 0 THEN {0} WHEN regexp_matches(lower(x), 'license|licensed') THEN {1} WHEN regexp_matches(lower(x), 'token = ') THEN {2} WHEN regexp_matches(lower(x), '[0-9]{{16}}') THEN {3} ELSE {4} END"""
_CLASSIFIED = f"""SELECT *, {_ACTION.format("'length'", "'licence'", "'token'", "'card'", "NULL")} AS rule_id, {_ACTION.format("'remove'", "'keep'", "'remove'", "'flag'", "'keep'")} AS action FROM (SELECT *, coalesce(text, '') AS x FROM documents)"""


@query("rule_filter", f"SELECT doc_id, lang, source FROM ({_CLASSIFIED}) WHERE action <> 'remove'")
def rule_filter(s, d):
    return predicates.rule_filter(t(s, d, "documents"), RULES).select("doc_id", "lang", "source")


@query("rule_filter_counts", f"SELECT rule_id, action, count(*) AS n FROM ({_CLASSIFIED}) GROUP BY 1, 2")
def rule_filter_counts(s, d):
    return predicates.rule_counts(t(s, d, "documents"), RULES)


_NORM = "lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))"


@query("dedup_hash", f"SELECT doc_id, row_number() OVER (PARTITION BY {_NORM} ORDER BY doc_id) > 1 AS is_duplicate FROM documents")
def dedup_hash(s, d):
    return dedup.hash_duplicates(t(s, d, "documents"), "text", "doc_id").select("doc_id", "is_duplicate")


@query("dedup_jaccard_pairs", """
WITH w AS (SELECT doc_id AS k, list_distinct(list_filter(regexp_split_to_array(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))), '\\s+'), lambda x: x <> '')) AS s FROM documents),
e AS (SELECT k, unnest(s) AS x FROM w), c AS (SELECT a.k AS i, b.k AS j, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.k < b.k GROUP BY 1, 2)
SELECT i, j, round(n / (len(p.s) + len(q.s) - n), 6) AS similarity FROM c JOIN w p ON p.k = i JOIN w q ON q.k = j WHERE n / (len(p.s) + len(q.s) - n) >= 0.8""")
def dedup_jaccard_pairs(s, d):
    words = t(s, d, "documents").select(F.col("doc_id").alias("k"), dedup.word_set(dedup.normalised(F.col("text"))).alias("words"))
    return dedup.similar_pairs(words, "k", "words", 0.8).withColumn("similarity", F.round("similarity", 6))


@query("dedup_jaccard_leaders", """
WITH RECURSIVE w AS (SELECT doc_id AS k, list_distinct(list_filter(regexp_split_to_array(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))), '\\s+'), lambda x: x <> '')) AS s FROM documents),
e AS (SELECT k, unnest(s) AS x FROM w), c AS (SELECT a.k AS i, b.k AS j, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.k < b.k GROUP BY 1, 2),
p AS MATERIALIZED (SELECT i, j FROM c JOIN w p ON p.k = i JOIN w q ON q.k = j WHERE n / (len(p.s) + len(q.s) - n) >= 0.8),
o AS (SELECT k, row_number() OVER (ORDER BY k) AS r FROM w WHERE len(s) > 0),
h AS MATERIALIZED (SELECT o.r, o.k, coalesce(list(i) FILTER (i IS NOT NULL), []) AS before FROM o LEFT JOIN p ON p.j = o.k GROUP BY 1, 2),
g AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS kept UNION ALL SELECT h.r, CASE WHEN list_has_any(g.kept, h.before) THEN g.kept ELSE list_append(g.kept, h.k) END FROM g JOIN h ON h.r = g.r + 1),
f AS (SELECT kept FROM g ORDER BY r DESC LIMIT 1)
SELECT k AS doc_id, CASE WHEN len(s) = 0 THEN k <> (SELECT min(doc_id) FROM documents) ELSE NOT list_contains((SELECT kept FROM f), k) END AS is_duplicate FROM w""")
def dedup_jaccard_leaders(s, d):
    return dedup.similarity_duplicates(t(s, d, "documents"), "text", "doc_id", 0.8).select("doc_id", "is_duplicate")


@query("content_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY trim(text)")
def content_dedup(s, d):
    return dedup.first_by_content(t(s, d, "documents"), "text", F.col("doc_id")).select("doc_id")


@query("post_search", """SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25 12:00:00' AND regexp_matches(json_extract_string(props, '$.k'), '^[1-4]') ORDER BY ts DESC, event_id LIMIT 50 OFFSET 50""")
def post_search(s, d):
    e = t(s, d, "events")
    search = predicates.RecordSearch(equal={"event_type": "purchase", "user_id": ""}, posted="ts", posted_from="2024-01-05", posted_to="2024-01-25 12:00:00", meta="props", meta_key="k", meta_value="/^[1-4]/i")
    return predicates.page(e.where(search.condition()), F.desc("ts"), F.col("event_id"), number=2, size=50).select("event_id", "event_type", "value")


@query("meta_key_value", """SELECT event_type, count(*) FILTER (json_extract_string(props, '$.k') = '42') AS equal, count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS present, count(*) FILTER (json_extract_string(props, '$.z') IS NOT NULL) AS absent, count(*) FILTER (regexp_matches(json_extract_string(props, '$.k'), '^(1|2)$')) AS pattern FROM events GROUP BY 1""")
def meta_key_value(s, d):
    m = lambda key, value: F.count_if(predicates.meta_condition("props", key, value))
    return t(s, d, "events").groupBy("event_type").agg(m("k", 42).alias("equal"), m("k", None).alias("present"), m("z", None).alias("absent"), m("k", "^(1|2)$").alias("pattern"))


@query("meta_text_range", """SELECT count(*) AS n FROM events WHERE json_extract_string(props, '$.k') >= '2' AND json_extract_string(props, '$.k') <= '35'""")
def meta_text_range(s, d):
    e = t(s, d, "events").withColumn("meta", F.to_json(F.struct(F.get_json_object("props", "$.k").alias("post_timestamp"))))
    return e.where(predicates.RecordSearch(meta_from="2", meta_to="35").condition()).agg(F.count("*").alias("n"))


@query("generic_query", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice BETWEEN 1000 AND 200000 AND lower(o_orderpriority) LIKE '%urgent%' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 25")
def generic_query(s, d):
    return predicates.query(t(s, d, "orders"), {"o_orderstatus": ["O", "F"], "o_totalprice": (1000, 200000), "o_orderpriority": "~URGENT"}, [("o_totalprice", "desc"), ("o_orderkey", "asc")], number=2, size=25).select("o_orderkey", "o_totalprice")


@query("text_search", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_type) LIKE '%ring%'")
def text_search(s, d):
    return predicates.text_search(t(s, d, "part"), ["p_name", "p_type"], "Ring").select("p_partkey")


@query("guarded_condition", "SELECT doc_id FROM documents WHERE length(text) >= 200 AND length(text) > 1000 AND (lang = 'en' AND n_chars % 2 = 0)")
def guarded_condition(s, d):
    df = t(s, d, "documents")
    return df.where(predicates.needs_summary("text", 200, 1000, "lang = 'en' and n_chars % 2 = 0", df.columns)).select("doc_id")


@query("segment_source", "SELECT conv_id, turn FROM conversations WHERE conv_id = 3 ORDER BY turn LIMIT 4 OFFSET 1")
def segment_source(s, d):
    c = t(s, d, "conversations")
    return tables.segment_source(c.withColumn("document_id", F.col("conv_id")), document_id=3, limit=4, offset=1, position="turn").select("conv_id", "turn")


@query("lookback_source", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 90 MINUTE AND TIMESTAMP '2024-01-10 12:00:00'")
def lookback_source(s, d):
    return tables.windowed_source(t(s, d, "events"), F.lit("2024-01-10 12:00:00").cast("timestamp_ntz"), 90).select("event_id")


@query("date_chunks", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, (floor((hour(ts) * 60 + minute(ts)) / 180))::INT AS chunk, count(*) AS total FROM events GROUP BY 1, 2")
def date_chunks(s, d):
    return tables.chunked_counts(t(s, d, "events"), 180)


@query("mock_rows", """WITH RECURSIVE v AS (SELECT 0 AS i, 12345::BIGINT AS v UNION ALL SELECT i + 1, (v * 9301 + 49297) % 233280 FROM v WHERE i < 200),
u AS (SELECT (i - 1) // 4 AS n, (i - 1) % 4 AS j, v / 233280.0::DOUBLE AS r FROM v WHERE i > 0)
SELECT n + 1 AS position, 'name_' || max(floor(r * 1000)::BIGINT) FILTER (j = 0) AS name, max(floor(r * 1000)::BIGINT) FILTER (j = 1) AS score, bool_or(r > 0.5) FILTER (j = 2) AS active, max(DATE '2024-01-01' + floor(r * 365)::INT) FILTER (j = 3) AS day, 'mock-' || (n + 1) AS id, 'Mock content ' || (n + 1) AS content FROM u GROUP BY n""")
def mock_rows(s, d):
    return tables.mock_rows(s, 50, {"name": "string", "score": "number", "active": "boolean", "day": "date"})


@query("html_text", """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style[^>]*>.*?</style\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS body FROM pages""")
def html_text(s, d):
    return t(s, d, "pages").select("page_id", files.html_text(F.col("html")).alias("body"))


@query("posts_as_documents", "SELECT coalesce(event_type, 'unknown') AS document, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS position FROM events")
def posts_as_documents(s, d):
    out = tables.posts_as_documents(t(s, d, "events"), F.col("props"), source="event_type", order="ts", tie="event_id")
    return out.select("document", "event_id", F.col("position").cast("long").alias("position"))


@query("post_text", "SELECT doc_id, md5(CASE WHEN contains(lower(text), lower(source)) THEN text ELSE source || chr(10) || chr(10) || text END) AS content FROM documents")
def post_text(s, d):
    return t(s, d, "documents").select("doc_id", F.md5(tables.post_text(F.col("source"), F.col("text"), F.lit(None).cast("string"), F.col("source"))).alias("content"))


@query("upsert_last_wins", "SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def upsert_last_wins(s, d):
    return mutations.last_by(t(s, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("upsert_merge", """WITH c AS (SELECT user_id AS k, max_by(value, event_id) AS v FROM events GROUP BY 1) SELECT coalesce(c_custkey, k) AS c_custkey, c_name, coalesce(v, c_acctbal) AS c_acctbal, CASE WHEN c_custkey IS NULL THEN 'pending' ELSE c_mktsegment END AS c_mktsegment FROM customer FULL JOIN c ON c_custkey = k""")
def upsert_merge(s, d):
    c = t(s, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    e = t(s, d, "events").select(F.col("user_id").alias("c_custkey"), "event_id", F.col("value").alias("c_acctbal"))
    return mutations.upsert(c, e, "c_custkey", "event_id", {"c_mktsegment": "pending"})


@query("bucket_upsert", SQL["upsert_merge"])
def bucket_upsert(s, d):
    c = t(s, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    e = t(s, d, "events").select(F.col("user_id").alias("c_custkey"), "event_id", F.col("value").alias("c_acctbal"))
    table = buckets.BucketTable.create(c, lineage.new_folder(s, "customers"), "c_custkey", 16)
    table.upsert(e, "event_id", {"c_mktsegment": "pending"})
    return table.read()


@query("bucket_labels", """SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'quarantine' ELSE d.source END AS source, d.n_chars, l.quality::INT AS quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang <> 'de'
UNION ALL SELECT 1000000000 + page_id, url, 0, NULL FROM pages""")
def bucket_labels(s, d):
    """Documents take their labels and the pages as new rows; then a language goes and toxic rows change their source."""
    docs = t(s, d, "documents").select("doc_id", "lang", "source", "n_chars", F.lit(None).cast("int").alias("quality"))
    labels = t(s, d, "labels").select("doc_id", F.col("doc_id").alias("n"), F.col("quality").cast("int").alias("quality"))
    pages = t(s, d, "pages").select((F.lit(1_000_000_000) + F.col("page_id")).alias("doc_id"), F.col("page_id").alias("n"), F.col("url").alias("source"))
    table = buckets.BucketTable.create(docs, lineage.new_folder(s, "documents"), "doc_id", 64)
    table.upsert(labels.unionByName(pages, allowMissingColumns=True), "n", {"n_chars": 0})
    table.delete(docs.where("lang = 'de'"))
    toxic = t(s, d, "labels").where("toxic = 1").join(table.read().select("doc_id"), "doc_id", "left_semi")
    table.upsert(toxic.select("doc_id", F.col("doc_id").alias("n"), F.lit("quarantine").alias("source")), "n")
    return table.read().select("doc_id", "source", "n_chars", "quality")


@query("bucket_changes", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def bucket_changes(s, d):
    """Deletes and a status change in bulk, each on the buckets that it touches."""
    c = t(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    table = buckets.BucketTable.create(c, lineage.new_folder(s, "customers"), "c_custkey", 16)
    table.delete(t(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")))
    table.replace(F.col("c_acctbal") < 0, {"c_mktsegment": F.lit("debt")})
    return table.read().select("c_custkey", "c_mktsegment")


@query("delete_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def delete_anti(s, d):
    return mutations.delete(t(s, d, "documents"), t(s, d, "labels").where("quality = 0"), "doc_id").select("doc_id")


@query("delete_report", "SELECT count(*) AS requested, count(*) FILTER (o.o_orderkey IS NOT NULL) AS deleted, count(*) FILTER (o.o_orderkey IS NULL) AS failed FROM (SELECT DISTINCT event_id * 3 AS id FROM events) e LEFT JOIN orders o ON o.o_orderkey = e.id")
def delete_report(s, d):
    return mutations.delete_report(t(s, d, "orders"), t(s, d, "events").select((F.col("event_id") * 3).alias("o_orderkey")), "o_orderkey")


@query("duplicate_key_strategy", "SELECT count(*) AS n FROM (SELECT p_name, p_brand FROM part GROUP BY 1, 2 HAVING count(*) > 1)")
def duplicate_key_strategy(s, d):
    p = t(s, d, "part")
    key = mutations.strategy_key("TITLE_CONTENT_SITE", {"title": F.col("p_name"), "content": F.col("p_name"), "site": F.col("p_brand")})
    return p.groupBy(key.alias("key")).count().where("key IS NOT NULL AND count > 1").agg(F.count("*").alias("n"))


@query("cascade_delete", "SELECT (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)) AS customers, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))) AS orders")
def cascade_delete(s, d):
    ts = {"nation": t(s, d, "nation").withColumn("id", F.col("n_nationkey")), "customer": t(s, d, "customer").withColumn("id", F.col("c_custkey")), "orders": t(s, d, "orders").withColumn("id", F.col("o_orderkey"))}
    ids = ts["nation"].where("n_regionkey = 1").select("id")
    out = mutations.cascade(ts, "nation", ids, [("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey")])
    return out["customer"].agg(F.count("*").alias("customers")).join(out["orders"].agg(F.count("*").alias("orders")))


@query("word_token_counts", """SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS words, ceil(length(text) / 4.0)::BIGINT AS by_length, ceil(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) * 0.75)::BIGINT AS by_words FROM documents""")
def word_token_counts(s, d):
    e = text.token_estimates(F.col("text"))
    return t(s, d, "documents").select("doc_id", text.word_count(F.col("text")).cast("long").alias("words"), *[e[k].cast("long").alias(k) for k in ("by_length", "by_words")])


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query("keyword_topn", f"""WITH p AS (SELECT doc_id, regexp_split_to_array(regexp_replace(lower(text), '[^A-Za-z0-9_\\s]', ' ', 'g'), '\\s+') AS a FROM documents), e AS (SELECT doc_id, unnest(a) AS token, generate_subscripts(a, 1) AS pos FROM p), c AS (SELECT doc_id, token, count(*) AS freq, min(pos) AS first FROM e WHERE regexp_full_match(token, '[a-z]{{3,19}}') AND token NOT IN ({_STOP}) GROUP BY 1, 2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, first) AS rank, token, freq FROM c QUALIFY rank <= 10""")
def keyword_topn(s, d):
    return text.keywords(t(s, d, "documents")).withColumn("rank", F.col("rank").cast("long"))


@query("stemmed_keywords")
def stemmed_keywords(s, d):
    return text.stemmed_keywords(t(s, d, "documents"))


@query("text_transforms", "SELECT p_partkey, upper(trim(p_name)) AS u, lower(trim(p_type)) AS l FROM part")
def text_transforms(s, d):
    return t(s, d, "part").select("p_partkey", text.transformed(F.col("p_name"), "trim_uppercase").alias("u"), text.transformed(F.col("p_type"), "trim_lowercase").alias("l"))


@query("aliases", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN contains(p_name, ' ') THEN regexp_replace(p_name, '\\s+', '', 'g') END, CASE WHEN contains(p_name, ' ') THEN regexp_replace(p_name, '\\s+', '_', 'g') END, CASE WHEN contains(p_name, ' ') THEN regexp_replace(p_name, '\\s+', '-', 'g') END, CASE WHEN p_name <> lower(p_name) THEN lower(p_name) END], lambda x: x IS NOT NULL AND x <> p_name), '|') AS spellings FROM (SELECT p_partkey, upper(left(p_name, 1)) || substr(p_name, 2) AS p_name FROM part)")
def aliases(s, d):
    named = t(s, d, "part").select("p_partkey", F.concat(F.upper(F.left("p_name", F.lit(1))), F.substring("p_name", 2, 1000)).alias("p_name"))
    return named.select("p_partkey", F.array_join(text.aliases(F.col("p_name")), "|").alias("spellings"))


@query("reply_json", """SELECT event_id, props AS reply FROM events""")
def reply_json(s, d):
    said = F.concat(F.lit("Here you are:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    return t(s, d, "events").select("event_id", text.reply_json(said).alias("reply"))


@query("prompt_template", "SELECT event_id, md5('Rate ' || event_type || ': ' || props || ' (' || props || ')') AS prompt FROM events")
def prompt_template(s, d):
    return t(s, d, "events").select("event_id", F.md5(text.filled("Rate {{kind}}: {{content}} ({{text}})", {"kind": F.col("event_type")}, F.col("props"))).alias("prompt"))


@query("chunk_windows", "SELECT doc_id, count(*) AS chunks, sum(length(c)) AS characters FROM (SELECT doc_id, substr(text, (i * 900 + 1)::BIGINT, 1000) AS c FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 100) / 900.0))::BIGINT)) AS i FROM documents WHERE length(text) > 0)) WHERE trim(c) <> '' GROUP BY 1")
def chunk_windows(s, d):
    chunks = splitters.split_documents(t(s, d, "documents"), splitters.ChunkConfig("character", 1000, 100))
    return splitters.chunk_statistics(chunks, "doc_id").select("doc_id", F.col("n").alias("chunks"), "characters")


def _chunker(name: str) -> None:
    @query(f"chunk_{name}")
    def run(s, d):
        return splitters.split_documents(t(s, d, "documents"), splitters.ChunkConfig(name, 200 if name == "token_based" else 1000, 20 if name == "token_based" else 100))


for _name in ("recursive_character", "token_based", "sentence_splitter", "smart_chunking", "markdown", "python_code", "separators"):
    _chunker(_name)


@query("chunk_parent_child")
def chunk_parent_child(s, d):
    return splitters.split_hierarchy(t(s, d, "documents"), 500, 50)


@query("field_mapping", "SELECT o_orderkey AS order_id, lower(trim(o_orderpriority)) AS priority, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS state, 'orders' AS origin FROM orders")
def field_mapping(s, d):
    m = records.Mapping({"order_id": "o_orderkey", "priority": records.Field("o_orderpriority", "trim_lowercase"), "state": "o_orderstatus"}, {"state": {"O": "open", "F": "filled"}}, {"origin": "orders"})
    return records.mapped(t(s, d, "orders"), m, keep=False)


@query("record_hash", "SELECT c_custkey, sha256('crm:' || concat_ws('|', c_name, CASE WHEN c_acctbal > 0 THEN c_mktsegment END, c_nationkey::VARCHAR)) AS h, md5('crm:' || concat_ws('|', c_name, c_nationkey::VARCHAR)) AS m FROM customer")
def record_hash(s, d):
    h = records.record_hash([F.col("c_name"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")), F.col("c_nationkey")], "crm:")
    return t(s, d, "customer").select("c_custkey", h.alias("h"), records.record_hash([F.col("c_name"), F.col("c_nationkey")], "crm:", "md5").alias("m"))


@query("type_mapping", "SELECT DISTINCT name, CASE name WHEN 'brand' THEN 'brand' WHEN 'product' THEN 'product' WHEN 'event' THEN 'event' WHEN 'person' THEN 'author' WHEN 'theme' THEN 'topic' ELSE 'organization' END AS node_type, CASE name WHEN 'mentions' THEN 'mentions' WHEN 'follows' THEN 'follows' ELSE 'related_to' END AS edge_type FROM (SELECT ['brand', 'product', 'event', 'person', 'theme', 'mentions', 'follows', 'uses', 'nothing'][p_partkey % 9 + 1] AS name FROM part)")
def type_mapping(s, d):
    some = F.array(*[F.lit(x) for x in ("brand", "product", "event", "person", "theme", "mentions", "follows", "uses", "nothing")])
    name = F.element_at(some, (F.col("p_partkey") % 9 + 1).cast("int"))
    spelt = F.concat(F.lit(" "), F.upper("name"))
    return t(s, d, "part").select(name.alias("name")).distinct().select("name", records.node_type(spelt).alias("node_type"), records.edge_type(spelt).alias("edge_type"))


@query("json_path", "SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT) AS k FROM events GROUP BY 1")
def json_path(s, d):
    e = t(s, d, "events")
    return e.groupBy("event_type").agg(F.sum(records.path_value(e, "props.k").cast("long")).alias("k"))


QUESTION = "the onthe and for theand"
_TOK = "list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^A-Za-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 2)"


def _bm25_sql(q: str) -> str:
    terms = list(dict.fromkeys(x for x in q.lower().split() if len(x) > 2))
    df = ", ".join(f"count(*) FILTER (list_contains(t, '{x}')) AS d{i}" for i, x in enumerate(terms))
    idf = lambda i: f"CASE WHEN d{i} = 0 THEN 0 WHEN d{i} >= n THEN ln(1.1::DOUBLE) ELSE ln((n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) END"
    tf = lambda x: f"len(list_filter(t, lambda y: y = '{x}'))::DOUBLE"
    one = " + ".join(f"CASE WHEN {tf(x)} > 0 THEN ({idf(i)}) * ({tf(x)} * 2.5) / ({tf(x)} + 1.5 * (0.25 + 0.75 * len / mean)) ELSE 0 END" for i, x in enumerate(terms))
    cov = " + ".join(f"(list_contains(t, '{x}'))::INT" for x in terms)
    return f"""SELECT doc_id, score FROM (SELECT doc_id, ({one}) * CASE WHEN contains(low, '{q}') THEN 3.0 ELSE 0.3 + 0.7 * ({cov}) / {len(terms)}.0::DOUBLE END AS score FROM (SELECT doc_id, lower(coalesce(text, '')) AS low, {_TOK} AS t, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::DOUBLE AS len FROM documents), (SELECT count(*) AS n, avg(len) AS mean, {df} FROM (SELECT {_TOK} AS t, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::DOUBLE AS len FROM documents))) WHERE score > 0"""


@query("bm25_topk", f"SELECT doc_id, round(score, 6) AS score FROM ({_bm25_sql(QUESTION)}) ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
def bm25_topk(s, d):
    return retrieval.bm25(t(s, d, "documents"), QUESTION).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(20)


_PHRASE = "array_to_string(list_transform(range(1, 4), lambda i: split_part(text, ' ', i)), ' ')"


@query("bm25_index", f"""WITH d AS (SELECT doc_id, {_TOK} AS t, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::DOUBLE AS len FROM documents),
e AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY 1, 2), f AS (SELECT term, count(*)::DOUBLE AS df FROM e GROUP BY 1), z AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean FROM d),
q AS (SELECT item_id AS query_id, {_TOK} AS qt FROM (SELECT item_id, {_PHRASE} AS text FROM benchmark)), p AS (SELECT DISTINCT query_id, unnest(qt) AS term FROM q),
s AS (SELECT query_id, e.doc_id, sum(CASE WHEN df >= n THEN ln(1.1::DOUBLE) ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS total, count(*) AS present FROM p JOIN e USING (term) JOIN f USING (term) JOIN d ON d.doc_id = e.doc_id, z GROUP BY 1, 2),
r AS (SELECT s.query_id, s.doc_id, round(total * CASE WHEN contains(' ' || array_to_string(t, ' ') || ' ', ' ' || array_to_string(qt, ' ') || ' ') THEN 3.0 ELSE 0.3 + 0.7 * present / len(list_distinct(qt)) END, 6) AS score FROM s JOIN q USING (query_id) JOIN d ON d.doc_id = s.doc_id)
SELECT query_id, doc_id, score FROM r WHERE score > 0""")
def bm25_index(s, d):
    """The first three words of each benchmark item, asked of an index of all documents at once."""
    index = postings.Postings.build(t(s, d, "documents"), lineage.new_folder(s, "postings"))
    asked = t(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("query"))
    return index.search(asked).select("query_id", "doc_id", F.round("score", 6).alias("score")).where("score > 0")


_COS = "SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS c FROM embeddings"


def _first_vector(s, d):
    return t(s, d, "embeddings").where("vec_id = 0").first()["embedding"]


@query("knn_topk", f"SELECT vec_id, round(c, 6) AS similarity FROM ({_COS}) WHERE c > 0 ORDER BY c DESC, vec_id LIMIT 15")
def knn_topk(s, d):
    out = retrieval.knn(t(s, d, "embeddings"), _first_vector(s, d), retrieval.fetch_size(10), above=0.0)
    return out.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("knn_join", f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), {vectors.DECIMALS}) AS similarity FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10""")
def knn_join(s, d):
    e = t(s, d, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.knn_join(e, asked, 10, itself=False).withColumn("similarity", F.round("similarity", 6))


@query("cell_index_topk")
def cell_index_topk(s, d):
    """The same queries asked of a stored index of cells; what is found is exact, recall is tested."""
    e = t(s, d, "embeddings")
    index = vectors.CellIndex.build(e, lineage.new_folder(s, "cells"), k=10)
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return index.search(asked, 10, itself=False).withColumn("similarity", F.round("similarity", 6))


@query("hybrid_rank", f"""WITH b AS ({_bm25_sql(QUESTION)}), k AS (SELECT * FROM (SELECT doc_id, score FROM b) ORDER BY round(score, 6) DESC, doc_id LIMIT 50), v AS (SELECT vec_id AS doc_id, c AS score FROM ({_COS}) WHERE c > 0 ORDER BY c DESC, vec_id LIMIT 50)
SELECT coalesce(v.doc_id, k.doc_id) AS doc_id, CASE WHEN v.doc_id IS NOT NULL AND k.doc_id IS NOT NULL THEN 'hybrid' WHEN v.doc_id IS NOT NULL THEN 'semantic' ELSE 'keyword' END AS match_type, round(coalesce(k.score, 0) * 0.4 + coalesce(v.score, 0) * 0.6, 6) AS final_score FROM v FULL JOIN k ON v.doc_id = k.doc_id""")
def hybrid_rank(s, d):
    k = retrieval.bm25(t(s, d, "documents"), QUESTION).orderBy(F.desc(F.round("score", 6)), "doc_id").limit(50)
    v = retrieval.knn(t(s, d, "embeddings"), _first_vector(s, d), 50, above=0.0).select(F.col("vec_id").alias("doc_id"), F.col("similarity").alias("score"))
    return retrieval.fused(retrieval.combined(v, k, "doc_id"), "doc_id").select("doc_id", "match_type", F.round("final_score", 6).alias("final_score"))


@query("merged_hits", "SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY trim(text) ORDER BY n_chars DESC, doc_id) AS q FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 5) WHERE q = 1 ORDER BY n_chars DESC, doc_id LIMIT 30")
def merged_hits(s, d):
    return retrieval.merged_hits(t(s, d, "documents"), 30, document="source", content="text", score="n_chars", key="doc_id").select("doc_id")


@query("conversation_context", "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS history, count(*) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3 GROUP BY 1")
def conversation_context(s, d):
    return retrieval.last_turns(t(s, d, "conversations"), 3).withColumn("history", F.md5("history"))


_IR = """WITH r AS (SELECT source AS query_id, doc_id AS item_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 20), e AS (SELECT source AS query_id, doc_id AS item_id, 1 + toxic AS relevance FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
n AS (SELECT query_id, count(*) AS ne FROM e GROUP BY 1), i AS (SELECT query_id, sum((2.0::DOUBLE ^ relevance - 1) / log2(k + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) AS k FROM e) GROUP BY 1),
h AS (SELECT r.*, ne, relevance, (relevance IS NOT NULL)::INT AS hit, sum((relevance IS NOT NULL)::INT) OVER (PARTITION BY r.query_id ORDER BY rank) AS sofar FROM r LEFT JOIN e ON r.query_id = e.query_id AND r.item_id = e.item_id JOIN n ON n.query_id = r.query_id)
SELECT h.query_id, count(*) AS n_results, sum(hit)::BIGINT AS hits, round(sum(hit) / count(*), 6) AS precision, round(sum(hit) / any_value(ne), 6) AS recall, round(coalesce(2 * (sum(hit) / count(*)) * (sum(hit) / any_value(ne)) / nullif(sum(hit) / count(*) + sum(hit) / any_value(ne), 0), 0), 6) AS f1, round(sum(CASE WHEN hit = 1 AND rank <= ne THEN (2.0::DOUBLE ^ relevance - 1) / log2(rank + 1) ELSE 0 END) / any_value(idcg), 6) AS ndcg, round(sum(CASE WHEN hit = 1 THEN sofar / rank ELSE 0 END) / any_value(ne), 6) AS average_precision FROM h JOIN i ON i.query_id = h.query_id GROUP BY 1"""


def _quality(s, d):
    docs = t(s, d, "documents")
    results = retrieval.top_per_group(docs, "source", 20, F.desc("n_chars"), F.col("doc_id")).select(F.col("source").alias("query_id"), F.col("doc_id").alias("item_id"), "rank")
    expected = docs.join(t(s, d, "labels").where("quality = 1"), "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").alias("item_id"), (1 + F.col("toxic")).alias("relevance"))
    return metrics.retrieval_quality(results, expected)


@query("ir_metrics", _IR)
def ir_metrics(s, d):
    q = _quality(s, d)
    return q.select("query_id", "n_results", "hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "ndcg", "average_precision")])


@query("metric_report", f"WITH q AS ({_IR}) SELECT 'overall' AS grouping, '' AS value, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall FROM q UNION ALL SELECT 'hits' , hits::VARCHAR, round(avg(precision), 4), round(avg(recall), 4) FROM q GROUP BY hits")
def metric_report(s, d):
    q = ir_metrics(s, d)
    return metrics.report(q, ["precision", "recall"], ["hits"]).select("grouping", "value", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"))


@query("type_distribution", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def type_distribution(s, d):
    return metrics.distribution(t(s, d, "events"), "event_type")


@query("document_totals", "SELECT source, sum(length(text))::BIGINT AS characters, sum(ceil(length(text) / 4.0))::BIGINT AS tokens FROM documents GROUP BY 1")
def document_totals(s, d):
    return metrics.totals(t(s, d, "documents"), "source", characters=F.length("text").cast("long"), tokens=text.token_estimates(F.col("text"))["by_length"])


@query("dimension_histogram", "SELECT len(embedding)::INT AS dimension, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, len(embedding)) = 1 AS modal FROM embeddings WHERE embedding IS NOT NULL GROUP BY len(embedding)")
def dimension_histogram(s, d):
    return metrics.dimension_histogram(t(s, d, "embeddings"))


@query("dimension_samples", "SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY len(embedding) ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 3")
def dimension_samples(s, d):
    return metrics.samples_per_dimension(t(s, d, "embeddings")).select("vec_id")


@query("entity_discovery", "SELECT event_type AS type, user_id AS label, count(*) AS n, max(ts) AS last_seen FROM events GROUP BY 1, 2")
def entity_discovery(s, d):
    return metrics.entity_discovery(t(s, d, "events").select(F.col("event_type").alias("type"), F.col("user_id").alias("label"), F.col("ts").alias("created_at")))


@query("node_patterns", "SELECT p_brand AS type, p_name AS label, count(*) AS n, round(least(0.9, count(*) * 0.1)::DOUBLE, 6) AS confidence FROM part GROUP BY 1, 2 HAVING count(*) >= 3")
def node_patterns(s, d):
    return metrics.node_patterns(t(s, d, "part").select(F.col("p_brand").alias("type"), F.col("p_name").alias("label"))).withColumn("confidence", F.round(F.col("confidence").cast("double"), 6))


@query("run_statistics", "SELECT event_type, count(*) AS total, count(*) FILTER (value > 20) AS ok, count(*) FILTER (value <= 5) AS failed, round(avg(CASE WHEN value > 5 THEN value END), 9) AS avg_duration, max(ts) AS last_start FROM events GROUP BY 1")
def run_statistics(s, d):
    runs = t(s, d, "events").select("event_type", F.when(F.col("value") > 20, "completed").when(F.col("value") <= 5, "failed").otherwise("running").alias("status"), F.when(F.col("value") > 5, F.col("value")).alias("duration"), F.col("ts").alias("started_at"))
    return metrics.run_statistics(runs, ["event_type"]).withColumn("avg_duration", F.round("avg_duration", 9))


@query("consistency", "SELECT event_type, count(value) AS n, round(CASE WHEN count(value) < 2 THEN 1 ELSE greatest(0, 1 - stddev_pop(value) / avg(value)) END, 6) AS consistency FROM events GROUP BY 1")
def consistency(s, d):
    return metrics.consistency(t(s, d, "events"), "value", "event_type").select("event_type", "n", F.round("consistency", 6).alias("consistency"))


@query("latency_stats", "SELECT event_type, count(*) AS n, round(avg(value), 9) AS mean, round(median(value), 9) AS median, list_sort(list(value))[least(floor(count(*) * 0.95), count(*) - 1)::BIGINT + 1] AS p95 FROM events GROUP BY 1")
def latency_stats(s, d):
    out = metrics.latency(t(s, d, "events"), "value", "event_type")
    return out.withColumn("mean", F.round("mean", 9)).withColumn("median", F.round("median", 9))


def _mentions(s, d):
    return t(s, d, "events").select(F.col("event_id").alias("mention_id"), F.col("event_type").alias("brand"), F.col("user_id").alias("author"), F.least(F.col("value") / 100, F.lit(1.0)).alias("score"), F.lit(None).cast("string").alias("tag"), "ts", F.when(F.col("user_id") % 3 == 0, "like").when(F.col("user_id") % 3 == 1, "share").otherwise("comment").alias("kind"), (F.col("event_id") % 17).alias("count"), F.col("user_id").alias("post"))


_M = "(SELECT event_id AS mention_id, event_type AS brand, user_id AS author, least(value / 100, 1.0) AS score, ts, CASE user_id % 3 WHEN 0 THEN 'like' WHEN 1 THEN 'share' ELSE 'comment' END AS kind, event_id % 17 AS count, user_id AS post FROM events)"


@query("brand_sentiment", f"SELECT brand, count(*) FILTER (s > 0.6) AS positive, count(*) FILTER (s < 0.4) AS negative, count(*) FILTER (s BETWEEN 0.4 AND 0.6) AS neutral, round(avg(s), 9) AS mean_score FROM (SELECT brand, CASE WHEN coalesce(score, 0) = 0 THEN 0.5 ELSE score END AS s FROM {_M}) GROUP BY 1")
def brand_sentiment(s, d):
    return brands.sentiment(_mentions(s, d)).withColumn("mean_score", F.round("mean_score", 9))


@query("sentiment_trend", f"WITH r AS (SELECT brand, CASE WHEN coalesce(score, 0) = 0 THEN 0.5 ELSE score END AS score, row_number() OVER (PARTITION BY brand ORDER BY ts, mention_id) AS r, count(*) OVER (PARTITION BY brand) AS n FROM {_M}), c AS (SELECT brand, any_value(n) AS n, avg(score) FILTER (r > n // 2) - avg(score) FILTER (r <= n // 2) AS change FROM r GROUP BY 1) SELECT brand, n, round(change, 9) AS change, CASE WHEN n < 2 THEN 'stable' WHEN change > 0.1 THEN 'increasing' WHEN change < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend FROM c")
def sentiment_trend(s, d):
    return brands.trend(_mentions(s, d)).withColumn("change", F.round("change", 9))


@query("mention_volume", f"WITH d AS (SELECT brand, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM {_M} GROUP BY 1, 2), p AS (SELECT brand, day AS peak_day, n AS peak_n FROM d QUALIFY row_number() OVER (PARTITION BY brand ORDER BY n DESC, day DESC) = 1) SELECT m.brand, count(*) AS mentions, count(DISTINCT author) AS authors, round(count(*) / 30, 6) AS per_day, any_value(peak_day) AS peak_day, any_value(peak_n) AS peak_n FROM {_M} m JOIN p ON p.brand = m.brand GROUP BY 1")
def mention_volume(s, d):
    return brands.mention_volume(_mentions(s, d)).withColumn("per_day", F.round("per_day", 6))


@query("engagement", f"WITH p AS (SELECT brand, post, sum(count) AS n FROM {_M} GROUP BY 1, 2), b AS (SELECT brand, post AS top_post FROM p QUALIFY row_number() OVER (PARTITION BY brand ORDER BY n DESC, post) = 1) SELECT m.brand, sum(CASE WHEN kind = 'like' THEN count ELSE 0 END)::BIGINT AS likes, sum(CASE WHEN kind = 'share' THEN count ELSE 0 END)::BIGINT AS shares, sum(CASE WHEN kind = 'comment' THEN count ELSE 0 END)::BIGINT AS comments, sum(count)::BIGINT AS total, round(avg(count), 9) AS mean, any_value(top_post) AS top_post FROM {_M} m JOIN b ON b.brand = m.brand GROUP BY 1")
def engagement(s, d):
    return brands.engagement(_mentions(s, d)).withColumn("mean", F.round("mean", 9))


@query("influencer_overlap", f"WITH a AS (SELECT DISTINCT brand, author FROM {_M} WHERE author IS NOT NULL), z AS (SELECT brand, count(*) AS n FROM a GROUP BY 1) SELECT x.brand AS brand1, y.brand AS brand2, count(*) AS shared, any_value(p.n) AS unique1, any_value(q.n) AS unique2, round(count(*) / greatest(any_value(p.n), any_value(q.n)), 6) AS overlap FROM a x JOIN a y ON x.author = y.author AND x.brand < y.brand JOIN z p ON p.brand = x.brand JOIN z q ON q.brand = y.brand GROUP BY 1, 2")
def influencer_overlap(s, d):
    return brands.influencer_overlap(_mentions(s, d)).withColumn("overlap", F.round("overlap", 6)).select("brand1", "brand2", "shared", "unique1", "unique2", "overlap")


@query("topic_analysis", f"WITH g AS (SELECT brand, count % 5 AS topic, count(*) AS frequency, round(avg(score), 9) AS mean_score, count(DISTINCT author) AS authors FROM {_M} GROUP BY 1, 2) SELECT *, count(*) OVER (PARTITION BY topic) > 1 AS shared FROM g")
def topic_analysis(s, d):
    return brands.topics(_mentions(s, d).withColumn("topic", F.col("count") % 5)).withColumn("mean_score", F.round("mean_score", 9))


@query("brand_daily", f"SELECT brand, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS mentions, round(avg(score), 9) AS mean_score FROM {_M} GROUP BY 1, 2")
def brand_daily(s, d):
    return brands.daily(_mentions(s, d)).withColumn("mean_score", F.round("mean_score", 9))


@query("competitors", f"WITH v AS (SELECT brand, count(*) AS m FROM {_M} GROUP BY 1), e AS (SELECT a.brand, b.brand AS rival, b.m FROM v a JOIN v b ON a.brand <> b.brand) SELECT e.brand, count(*) AS rivals, sum(e.m)::BIGINT AS rival_mentions, any_value(v.m) AS mentions, CASE WHEN any_value(v.m) > 1000 THEN 'leader' WHEN any_value(v.m) > 500 THEN 'challenger' WHEN any_value(v.m) > 100 THEN 'follower' ELSE 'niche' END AS position, round(any_value(v.m) / (any_value(v.m) + sum(e.m)), 6) AS share FROM e JOIN v ON v.brand = e.brand GROUP BY 1")
def competitors(s, d):
    m = _mentions(s, d)
    b = m.select("brand").distinct()  # five event types
    edges = b.withColumnRenamed("brand", "src").join(b.withColumnRenamed("brand", "dst"), F.col("src") < F.col("dst"))
    return brands.competitors(edges, m).withColumn("share", F.round("share", 6)).select("brand", "rivals", "rival_mentions", "mentions", "position", "share")


@query("brand_insights", f"WITH s AS (SELECT brand, avg(CASE WHEN coalesce(score, 0) = 0 THEN 0.5 ELSE score END) AS a, count(*) AS n FROM {_M} GROUP BY 1) SELECT 'best_sentiment' AS kind, max_by(brand, a) AS brand FROM s UNION ALL SELECT 'most_mentions', (SELECT brand FROM s ORDER BY n DESC, brand DESC LIMIT 1) UNION ALL SELECT 'improve_sentiment', brand FROM s WHERE a < 0.4 UNION ALL SELECT 'raise_visibility', brand FROM s WHERE n < 10")
def brand_insights(s, d):
    m = _mentions(s, d)
    return brands.insights(brands.sentiment(m), brands.mention_volume(m))


def _edges(s, d):
    c = t(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"))
    p = t(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"))
    return c.union(p)


_E = "(SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


@query("degree_centrality", f"SELECT node, degree, row_number() OVER (ORDER BY degree DESC, node)::INT AS rank FROM (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {_E} UNION ALL SELECT dst FROM {_E} WHERE src <> dst) GROUP BY 1 ORDER BY degree DESC, node LIMIT 20)")
def degree_centrality(s, d):
    return graph.degree(_edges(s, d), 20)


@query("graph_density", f"WITH n AS (SELECT src AS node FROM {_E} UNION SELECT dst FROM {_E}) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM {_E}) AS edges, round((SELECT count(*) FROM {_E}) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1) / 2), 9) AS density")
def graph_density(s, d):
    e = _edges(s, d)
    return graph.density(e, e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()).withColumn("density", F.round("density", 9))


@query("components", f"SELECT src AS node, min(src) OVER (PARTITION BY dst) AS m FROM {_E}")
def components(s, d):
    e = _edges(s, d)
    label = graph.component_labels(e)
    return label.where(~F.col("node").startswith("n")).select("node", F.col("component").alias("m"))


@query("communities", f"SELECT min(src) AS component, count(*) + 1 AS size, count(*) AS internal, round(count(*) / ((count(*) + 1) * count(*) / 2), 9) AS density FROM {_E} GROUP BY dst HAVING count(*) + 1 >= 3")
def communities(s, d):
    return graph.communities(_edges(s, d)).withColumn("density", F.round("density", 9))


@query("modularity", f"WITH g AS (SELECT count(*) AS k FROM {_E} GROUP BY dst HAVING count(*) + 1 >= 3), e AS (SELECT count(*) AS n FROM {_E}) SELECT round(sum(k / n - (((k + 1) * k / 2) / n) ** 2), 6) AS modularity FROM g, e")
def modularity(s, d):
    e = _edges(s, d)
    return graph.modularity(graph.communities(e), e.count()).withColumn("modularity", F.round("modularity", 6))


_BOTH = f"(SELECT src AS a, dst AS b FROM {_E} UNION SELECT dst, src FROM {_E})"


@query("shortest_path", f"WITH RECURSIVE p AS (SELECT 'c0' AS node, ['c0'] AS path UNION ALL SELECT b, list_append(path, b) FROM p JOIN {_BOTH} ON a = node WHERE len(path) <= 5 AND NOT list_contains(path, b) AND node <> (SELECT 's' || max(s_suppkey) FROM supplier WHERE s_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 0))) SELECT len(path) - 1 AS distance, array_to_string(path, '>') AS path FROM p WHERE node = (SELECT 's' || max(s_suppkey) FROM supplier WHERE s_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 0)) ORDER BY len(path), path LIMIT 1")
def shortest_path(s, d):
    e = _edges(s, d)
    both = e.union(e.select("dst", "src"))
    nation = t(s, d, "customer").where("c_custkey = 0").select(F.col("c_nationkey").alias("s_nationkey"))
    last = t(s, d, "supplier").join(nation, "s_nationkey").agg(F.max("s_suppkey").alias("m")).first()["m"]
    out = graph.shortest_path(both, "c0", f"s{last}", 5)
    return out.select(F.col("distance").cast("long").alias("distance"), F.array_join("path", ">").alias("path"))


@query("neighbours", f"SELECT 'n0' AS node, 0 AS distance UNION ALL SELECT src, 1 FROM {_E} WHERE dst = 'n0'")
def neighbours(s, d):
    return graph.neighbours(_edges(s, d), "n0", 2)


def _geo(s, d):
    n = t(s, d, "nation")
    up = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))
    r = t(s, d, "region").where("r_regionkey > 0").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("src"), F.lit("r0").alias("dst"))
    return up.union(r)


_G = "(SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r0' FROM region WHERE r_regionkey > 0)"
_W = f"WITH RECURSIVE b AS (SELECT src AS x, dst AS y FROM {_G} UNION SELECT dst, src FROM {_G}), p AS (SELECT x AS a, y AS z, 1 AS dist, [x, y] AS path FROM b UNION ALL SELECT p.a, b.y, p.dist + 1, list_append(p.path, b.y) FROM p JOIN b ON b.x = p.z WHERE NOT list_contains(p.path, b.y)), d AS (SELECT a, z, min(dist) AS dist FROM p GROUP BY 1, 2)"


@query("closeness", f"{_W} SELECT a AS node, round(count(*) / sum(dist), 9) AS closeness FROM d GROUP BY 1")
def closeness(s, d):
    return graph.closeness(_geo(s, d)).withColumn("closeness", F.round("closeness", 9))


@query("mean_path_length", f"{_W} SELECT round(avg(dist), 9) AS mean_path_length, count(*) AS pairs FROM d WHERE a < z")
def mean_path_length(s, d):
    return graph.mean_path_length(_geo(s, d)).withColumn("mean_path_length", F.round("mean_path_length", 9))


@query("betweenness", f"{_W} SELECT node, count(*) AS betweenness FROM (SELECT unnest(path[2:len(path) - 1]) AS node FROM p WHERE a < z) GROUP BY 1")
def betweenness(s, d):
    return graph.betweenness(_geo(s, d))


@query("isolated_nodes", "SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def isolated_nodes(s, d):
    e = t(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graph.isolated(t(s, d, "part").select(F.col("p_partkey").alias("node")), e)


@query("top_connected", "SELECT n_nationkey AS id, n_name AS label, count(c_custkey) AS edges FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2 ORDER BY edges DESC, id LIMIT 10")
def top_connected(s, d):
    nodes = t(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))
    return metrics.top_connected(nodes, t(s, d, "customer").select(F.col("c_nationkey").alias("src")))


@query("edge_patterns", "SELECT c_mktsegment AS src_type, o_orderpriority AS dst_type, o_orderstatus AS edge_type, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def edge_patterns(s, d):
    o, c = t(s, d, "orders"), t(s, d, "customer")
    nodes = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_mktsegment").alias("type")).union(o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), "o_orderpriority"))
    edges = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"), F.col("o_orderstatus").alias("edge_type"))
    return metrics.edge_patterns(nodes, edges)


@query("segments_with_graph", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def segments_with_graph(s, d):
    return joins.with_graph(t(s, d, "documents"), t(s, d, "labels"), key="doc_id").select("doc_id")


@query("orphans", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def orphans(s, d):
    return joins.orphans(t(s, d, "embeddings"), t(s, d, "labels").withColumnRenamed("doc_id", "vec_id"), "vec_id").select("vec_id")


@query("eager_relations", "SELECT n_nationkey, len(list(c_custkey) FILTER (c_custkey IS NOT NULL))::INT AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def eager_relations(s, d):
    c = t(s, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", "c_name")
    return joins.with_many(t(s, d, "nation"), c, "n_nationkey", "customers", ["c_custkey"]).select("n_nationkey", F.size("customers").alias("customers"))


@query("label_similarity", "SELECT a.p_partkey AS i, b.p_partkey AS j, round((greatest(length(a.p_name), length(b.p_name)) - levenshtein(a.p_name, b.p_name)) / greatest(length(a.p_name), length(b.p_name)), 6) AS similarity FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey WHERE (greatest(length(a.p_name), length(b.p_name)) - levenshtein(a.p_name, b.p_name)) / greatest(length(a.p_name), length(b.p_name)) >= 0.7")
def label_similarity(s, d):
    out = entities.label_pairs(t(s, d, "part"), 0.7, key="p_partkey", label="p_name", kind="p_brand")
    return out.select("i", "j", F.round("similarity", 6).alias("similarity"))


@query("duplicate_entities", """
WITH RECURSIVE o AS MATERIALIZED (SELECT p_partkey AS id, p_name AS s, p_brand AS t, row_number() OVER (ORDER BY p_name, p_partkey) AS r FROM part),
p AS MATERIALIZED (SELECT a.r AS i, b.r AS j FROM o a JOIN o b ON a.t = b.t AND a.r < b.r WHERE (greatest(length(a.s), length(b.s)) - levenshtein(a.s, b.s)) / greatest(length(a.s), length(b.s)) >= 0.8),
h AS MATERIALIZED (SELECT o.r, coalesce(list(i) FILTER (i IS NOT NULL), []) AS before FROM o LEFT JOIN p ON p.j = o.r GROUP BY 1),
g AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS kept UNION ALL SELECT h.r, CASE WHEN list_has_any(g.kept, h.before) THEN g.kept ELSE list_append(g.kept, h.r) END FROM g JOIN h ON h.r = g.r + 1),
f AS MATERIALIZED (SELECT unnest(kept) AS r FROM (SELECT kept FROM g ORDER BY r DESC LIMIT 1))
SELECT o.id, l.id AS leader FROM o JOIN (SELECT r AS j, r AS i FROM f UNION ALL SELECT j, min(i) FROM p JOIN f ON f.r = p.i WHERE j NOT IN (SELECT r FROM f) GROUP BY j) x ON x.j = o.r JOIN o l ON l.r = x.i""")
def duplicate_entities(s, d):
    return entities.duplicate_groups(t(s, d, "part"), 0.8, key="p_partkey", label="p_name", kind="p_brand")


@query("entity_usage", "WITH u AS (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) SELECT c_custkey AS entity_id, 2 + coalesce(n, 0) AS usage, round(least(1.0, 0.5 + (2 * coalesce(n, 0) + coalesce(n, 0) * (coalesce(n, 0) + 1) / 2) * 0.01)::DOUBLE, 6) AS confidence FROM customer LEFT JOIN u ON k = c_custkey")
def entity_usage(s, d):
    e = t(s, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.lit(2).cast("long").alias("usage"), F.lit(0.5).alias("confidence"))
    return entities.used(e, t(s, d, "events").select(F.col("user_id").alias("entity_id"))).withColumn("confidence", F.round("confidence", 6))


@query("entity_confidence", "SELECT c_custkey, round(least(1.0, 0.5 + least(0.3, 0.05 * (c_custkey % 9)) + greatest(0.0, 0.2 - 0.01 * (c_custkey % 31)) + 0.2 * 0.9 + least(0.1, 0.02 * (c_custkey % 4)) + CASE WHEN c_nationkey = 3 THEN 0.1 ELSE 0.0 END)::DOUBLE, 6) AS confidence FROM customer")
def entity_confidence(s, d):
    k = F.col("c_custkey")
    c = entities.confidence(k % 9, k % 31, F.lit(0.9), k % 4, F.col("c_nationkey") == 3)
    return t(s, d, "customer").select("c_custkey", F.round(c.cast("double"), 6).alias("confidence"))


@query("new_entities", "SELECT DISTINCT p_name AS name, p_brand AS type FROM part WHERE (p_name, p_brand) NOT IN (SELECT (p_name, p_brand) FROM part WHERE p_size < 10)")
def new_entities(s, d):
    p = t(s, d, "part")
    return entities.new_entities(p.select(F.col("p_name").alias("label"), F.col("p_brand").alias("type")), p.where("p_size < 10").select(F.col("p_name").alias("name"), F.col("p_brand").alias("type"))).select("name", "type")


@query("dictionary_matches")
def dictionary_matches(s, d):
    b = t(s, d, "benchmark")
    names = b.select(F.col("item_id").alias("entity_id"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("name"))
    return entities.dictionary_matches(t(s, d, "documents"), names)


@query("upsert_by_strategy", """WITH i AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'order ' || (o_orderkey % 400) END AS title, lower(o_orderpriority) AS content FROM orders),
e AS (SELECT 'order ' || (p_partkey % 300) AS title, '1-urgent' AS content FROM part WHERE p_partkey <= 150),
k AS (SELECT *, 'title=' || title || '|content=' || content AS key FROM i WHERE title IS NOT NULL), b AS (SELECT DISTINCT 'title=' || title || '|content=' || content AS key FROM e), f AS (SELECT key, min(n) AS first FROM k GROUP BY 1)
SELECT n, CASE WHEN i.title IS NULL THEN 'failed' WHEN b.key IS NULL AND f.first = n THEN 'created' ELSE 'updated' END AS status FROM i LEFT JOIN k USING (n) LEFT JOIN b ON b.key = k.key LEFT JOIN f ON f.key = k.key""")
def upsert_by_strategy(s, d):
    items = t(s, d, "orders").select(F.col("o_orderkey").alias("n"), F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit("order "), (F.col("o_orderkey") % 400).cast("string"))).alias("title"), F.lower("o_orderpriority").alias("content"))
    there = t(s, d, "part").where("p_partkey <= 150").select(F.col("p_partkey").cast("string").alias("hash"), F.concat(F.lit("Order "), (F.col("p_partkey") % 300).cast("string")).alias("title"), F.lit("1-URGENT").alias("content"))
    return mutations.upsert_by_strategy(there, items, "TITLE_CONTENT", order="n")[1]


@query("bulk_status", "SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def bulk_status(s, d):
    o = t(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return mutations.marked(o, o.where("o_custkey % 7 = 0"), "o_orderkey", o_orderstatus="X").select("o_orderkey", "o_orderstatus")


@query("edge_create", "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, l_returnflag AS edge_type FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def edge_create(s, d):
    each = t(s, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("edge_type"))
    nodes = t(s, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("node")).union(t(s, d, "supplier").select("s_suppkey"))
    src = t(s, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("src"))
    each = each.join(src, "src", "left_semi").select("src", "dst", "edge_type")
    return graph.linked(each.where("src % 2 = 0").distinct(), each, nodes)


@query("merged_nodes", "SELECT p_brand AS id, min(p_partkey) AS kept, arg_max(p_type, p_partkey) AS p FROM part GROUP BY 1")
def merged_nodes(s, d):
    """Parts of a brand merged into the first of them; the last one's type counts."""
    p = t(s, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", F.create_map(F.lit("type"), F.col("p_type")).alias("properties"))
    target = p.groupBy("p_brand").agg(F.min("id").alias("target"))
    mapping = p.join(target, "p_brand").select(F.col("id").alias("source"), "target")
    edges = s.createDataFrame([], "src long, dst long, edge_type string")
    nodes, _, _ = entities.merged(p, edges, mapping)
    return nodes.select(F.col("p_brand").alias("id"), F.col("id").alias("kept"), F.col("properties")["type"].alias("p"))


@query("node_dedup", """WITH o AS (SELECT p_partkey AS id, p_brand AS kind, p_name AS label FROM part WHERE p_partkey % 3 = 0), i AS (SELECT p_partkey AS n, p_brand AS kind, upper(p_name) AS label, p_type AS v FROM part),
m AS (SELECT i.*, e.id AS there FROM i LEFT JOIN (SELECT kind, lower(trim(label)) AS name, min(id) AS id FROM o GROUP BY 1, 2) e ON e.kind = i.kind AND e.name = lower(trim(i.label))),
k AS (SELECT coalesce(there::VARCHAR, kind || '|' || lower(trim(label))) AS key, arg_max(v, n) AS v FROM m GROUP BY 1)
SELECT count(*) AS nodes, count(k.v) AS given, md5(string_agg(k.v, ',' ORDER BY k.v)) AS types FROM (SELECT id::VARCHAR AS key FROM o UNION SELECT key FROM k) u LEFT JOIN k USING (key)""")
def node_dedup(s, d):
    p = t(s, d, "part")
    old = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("node_id"), F.lit(1).alias("dataset_id"), F.col("p_brand").alias("node_type"), F.col("p_name").alias("label"), F.create_map().cast("map<string,string>").alias("properties"))
    new = p.select(F.lit(1).alias("dataset_id"), F.col("p_brand").alias("node_type"), F.upper("p_name").alias("label"), F.create_map(F.lit("type"), F.col("p_type")).alias("properties"), F.col("p_partkey").alias("n"))
    v = F.col("properties")["type"]
    return dedup.identified(old, new).agg(F.count("*").alias("nodes"), F.count(v).alias("given"), F.md5(F.array_join(F.array_sort(F.collect_list(v)), ",")).alias("types"))


@query("entity_import", """WITH e AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS type FROM customer WHERE c_custkey % 2 = 0), i AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END AS name, c_mktsegment AS type FROM customer)
SELECT CASE WHEN trim(i.name) = '' THEN 'failed' WHEN e.id IS NULL THEN 'created' ELSE 'skipped' END AS status, count(*) AS n FROM i LEFT JOIN e ON e.name = i.name AND e.type = i.type GROUP BY 1""")
def entity_import(s, d):
    c = t(s, d, "customer")
    there = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("entity_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.lit(0.5).alias("confidence"))
    new = c.select(F.lit(None).cast("string").alias("entity_id"), F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("type"), F.col("c_custkey").alias("n"))
    return entities.imported(there, new)[1].groupBy("status").agg(F.count("*").alias("n"))


@query("entity_search", "SELECT c_custkey AS entity_id, string_agg(o_orderpriority, '|' ORDER BY o_orderpriority) AS aliases FROM customer JOIN (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000 GROUP BY 1 HAVING bool_or(lower(o_orderpriority) LIKE '%urg%')")
def entity_search(s, d):
    e = t(s, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.lit("x").alias("source"), F.col("c_acctbal").alias("confidence"))
    a = t(s, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderpriority").alias("alias"))
    return entities.searched(e, a, text="urg", kind="BUILDING", least=1000.0).select("entity_id", F.array_join("aliases", "|").alias("aliases"))


@query("entity_statistics", "SELECT 'type' AS kind, p_brand AS value, count(*)::DOUBLE AS number FROM part GROUP BY 2 UNION ALL SELECT 'source', p_type, count(*) FROM part GROUP BY 2 UNION ALL (SELECT 'most_used', p_name, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 10) UNION ALL (SELECT 'newest', p_name, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10)")
def entity_statistics(s, d):
    e = t(s, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"), F.col("p_type").alias("source"), F.col("p_size").alias("usage"), F.col("p_retailprice").alias("created_at"))
    return entities.entity_statistics(e)


@query("execution_metrics", "SELECT count(*) AS total, count(*) FILTER (event_type = 'view') AS completed, count(*) FILTER (event_type = 'error') AS failed, round(sum(value), 4) AS duration, max(user_id) AS max_memory, sum(event_id)::BIGINT AS items FROM events")
def execution_metrics(s, d):
    kind = F.when(F.col("event_type") == "view", "completed").when(F.col("event_type") == "error", "failed").otherwise("other")
    r = t(s, d, "events").select(kind.alias("status"), F.col("value").alias("duration"), F.col("user_id").alias("memory"), F.col("event_id").alias("items"))
    return metrics.execution_metrics(r).select("total", "completed", "failed", F.round("duration", 4).alias("duration"), "max_memory", "items")


@query("graph_statistics", f"WITH n AS (SELECT src AS node FROM {_E} UNION SELECT dst FROM {_E}), g AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM {_E} UNION ALL SELECT dst FROM {_E}) GROUP BY 1) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM {_E}) AS edges, (SELECT node FROM g ORDER BY d DESC, node LIMIT 1) AS most_connected, (SELECT max(d) FROM g) AS most_degree, round(2 * (SELECT count(*) FROM {_E}) / (SELECT count(*) FROM n), 9) AS mean_degree")
def graph_statistics(s, d):
    e = _edges(s, d)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return graph.graph_stats(nodes, e).withColumn("mean_degree", F.round("mean_degree", 9))


@query("retrieval_router", f"SELECT vec_id, round(c, 6) AS similarity FROM ({_COS}) WHERE vec_id % 4 IN (1, 2) ORDER BY c DESC, vec_id LIMIT 5")
def retrieval_router(s, d):
    v = t(s, d, "embeddings").withColumn("document_id", F.col("vec_id") % 4)
    out = retrieval.retrieved(v, _first_vector(s, d), 5, document_ids=[1, 2], key="vec_id")
    return out.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("scored_segments", f"SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 0.5 ELSE round(c, 6) END AS similarity FROM ({_COS}) WHERE vec_id IN (3, 4, 5, 8, 13)")
def scored_segments(s, d):
    v = t(s, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 2 == 1, F.col("embedding")))
    out = retrieval.scored_segments(v, [3, 4, 5, 8, 13], _first_vector(s, d), key="vec_id")
    return out.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("latest_conversation", "SELECT conv_id FROM (SELECT conv_id, max(turn) AS u FROM conversations GROUP BY 1) ORDER BY u DESC, conv_id DESC LIMIT 1")
def latest_conversation(s, d):
    c = t(s, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated_at")).withColumn("user_id", F.lit(1))
    return retrieval.latest_conversation(c, 1).select("conv_id")


@query("path_set", "SELECT o_orderkey, o_orderpriority AS label, o_orderstatus AS state, lower(o_orderpriority) AS low FROM orders")
def path_set(s, d):
    o = t(s, d, "orders").select("o_orderkey", F.struct(F.struct(F.col("o_orderstatus").alias("state")).alias("extracted")).alias("meta"), "o_orderpriority")
    out = records.with_paths(o, {"meta.classification.label": F.col("o_orderpriority"), "meta.extracted.low": F.lower("o_orderpriority")})
    return out.select("o_orderkey", F.col("meta.classification.label").alias("label"), F.col("meta.extracted.state").alias("state"), F.col("meta.extracted.low").alias("low"))


@query("string_hash", """WITH RECURSIVE h AS (SELECT p_partkey, p_name, 1 AS i, 0::BIGINT AS h FROM part UNION ALL SELECT p_partkey, p_name, i + 1, ((h * 31 + ascii(substr(p_name, i, 1)) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 FROM h WHERE i <= length(p_name)),
z AS (SELECT p_partkey, h FROM h WHERE i = length(p_name) + 1), b AS (SELECT p_partkey, h, abs(h) AS left_, '' AS out FROM z UNION ALL SELECT p_partkey, h, left_ // 36, substr('0123456789abcdefghijklmnopqrstuvwxyz', (left_ % 36 + 1)::BIGINT, 1) || out FROM b WHERE left_ > 0)
SELECT p_partkey, CASE WHEN h < 0 THEN '-' ELSE '' END || CASE WHEN h = 0 THEN '0' ELSE out END AS h FROM b WHERE left_ = 0 AND (out <> '' OR h = 0)""")
def string_hash(s, d):
    return t(s, d, "part").select("p_partkey", text.string_hash32(F.col("p_name")).alias("h"))


@query("highlighted", "SELECT p_partkey, regexp_replace(p_name, '\\b' || regexp_extract(p_name, '^\\w+') || '\\b', '[' || p_brand || ']', 'gi') AS shown FROM part")
def highlighted(s, d):
    one = F.array(F.struct(F.regexp_extract("p_name", r"^\w+", 0).alias("found"), F.col("p_brand").alias("canonical"), F.lit(1.0).alias("score")))
    return t(s, d, "part").select("p_partkey", text.highlighted(F.col("p_name"), one).alias("shown"))


WORKFLOW = (
    ("trigger_manual", {}),
    ("rule_based_filter", {"content": "text", "min_length": 100, "rules": [{"id": "token", "pattern": "token = ", "action": "remove"}]}),
    ("duplicate_segment", {"content": "text", "position": "doc_id", "method": "hash"}),
    ("count_by", {"by": ["source", "lang"]}),
)


@query("workflow_chain", f"SELECT source, lang, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY {_NORM} ORDER BY doc_id) AS r FROM documents WHERE length(text) >= 100 AND trim(text) <> '' AND NOT regexp_matches(lower(text), 'token = ')) WHERE r = 1 GROUP BY 1, 2")
def workflow_chain(s, d):
    """Source, rule filter, hash deduplication, count: one plan."""
    return chain(*WORKFLOW).result({"s0": t(s, d, "documents")})


# ---------------------------------------------------------------- joins, learning and upserts of the knowledge base

_ALIKE = "(greatest(length(a.s), length(b.s)) - levenshtein(a.s, b.s)) / greatest(length(a.s), length(b.s))"


@query("edge_upsert", """WITH old AS (SELECT doc_id AS src, 1000000000 + doc_id AS dst, n_chars::DOUBLE AS weight, lang FROM documents), new AS (SELECT doc_id AS src, 1000000000 + doc_id AS dst, max(quality)::DOUBLE AS weight, max(toxic)::VARCHAR AS toxic FROM labels WHERE doc_id IN (SELECT page_id FROM pages) AND doc_id IN (SELECT doc_id FROM documents) GROUP BY 1)
SELECT src, dst, coalesce(n.weight, o.weight) AS weight, lang, toxic FROM old o FULL JOIN new n USING (src, dst)""")
def edge_upsert(s, d):
    """Documents cite pages; labels come as edges by node labels, some of which no node has."""
    docs, pages, labels = t(s, d, "documents"), t(s, d, "pages"), t(s, d, "labels")
    page = F.lit(1_000_000_000)
    nodes = docs.select(F.concat(F.lit("d"), "doc_id").alias("label"), F.col("doc_id").alias("node")).union(pages.select(F.concat(F.lit("p"), "page_id"), page + F.col("page_id")))
    old = docs.select(F.col("doc_id").alias("src"), (page + F.col("doc_id")).alias("dst"), F.lit("cites").alias("edge_type"), F.col("n_chars").cast("double").alias("weight"), F.create_map(F.lit("lang"), "lang").alias("properties"))
    new = labels.select(F.concat(F.lit("d"), "doc_id").alias("src_label"), F.concat(F.lit("p"), "doc_id").alias("dst_label"), F.lit("cites").alias("edge_type"), F.col("quality").cast("double").alias("weight"), F.create_map(F.lit("toxic"), F.col("toxic").cast("string")).alias("properties"), F.col("doc_id").alias("n"))
    out = mutations.upsert_edges(old, new, nodes)
    return out.select("src", "dst", "weight", F.col("properties")["lang"].alias("lang"), F.col("properties")["toxic"].alias("toxic"))


@query("subgraph_edges", "SELECT a.doc_id AS src, b.doc_id AS dst, a.lang || a.doc_id AS src_label, b.lang || b.doc_id AS dst_label FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.source = 'src0' OR b.source = 'src0'")
def subgraph_edges(s, d):
    docs = t(s, d, "documents")
    nodes = docs.select(F.col("doc_id").alias("node"), F.concat("lang", F.col("doc_id").cast("string")).alias("label"), F.col("source").alias("segment_id"))
    edges = docs.select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("dst"))
    return graph.subgraph(nodes, edges, "src0")[1].select("src", "dst", "src_label", "dst_label")


@query("influential_nodes", f"""WITH g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {_E} UNION ALL SELECT dst FROM {_E} WHERE src <> dst) GROUP BY 1 ORDER BY degree DESC, node LIMIT 40)
SELECT node, degree FROM g WHERE node LIKE 'n%' AND degree >= 2 ORDER BY degree DESC, node LIMIT 20""")
def influential_nodes(s, d):
    e = _edges(s, d)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("type", F.substring("node", 1, 1))
    return graph.influential(e, nodes, 20, "n", 2).select("node", "degree")


@query("bridges", f"SELECT * FROM ({SQL['betweenness']}) WHERE betweenness >= 0.1 ORDER BY betweenness DESC, node LIMIT 50")
def bridges(s, d):
    return graph.bridges(_geo(s, d))


@query("step_metrics", "SELECT user_id AS step, count(*) * 2 AS n_in, count(*) AS n_out, round(sum(value), 4) AS duration, count(*) AS filtered, round(count(*) * 2 / nullif(sum(value), 0), 4) AS items_per_s FROM events GROUP BY 1")
def step_metrics(s, d):
    runs = t(s, d, "events").select(F.col("user_id").alias("step"), F.lit(2).alias("n_in"), F.lit(1).alias("n_out"), F.col("value").alias("duration"))
    return metrics.step_metrics(runs).select("step", "n_in", "n_out", F.round("duration", 4).alias("duration"), "filtered", F.round("items_per_s", 4).alias("items_per_s"))


@query("embedded_segments", "SELECT doc_id, document_id, len(embedding) AS size FROM (SELECT doc_id, doc_id % 50 AS document_id FROM documents WHERE n_chars % 2 = 0) JOIN embeddings ON vec_id = doc_id WHERE label < 5 AND embedding IS NOT NULL AND document_id NOT IN (3, 4)")
def embedded_segments(s, d):
    segments = t(s, d, "documents").select("doc_id", (F.col("doc_id") % 50).alias("document_id"), F.col("doc_id").alias("embedding_id"), (F.col("n_chars") % 2 == 0).alias("enabled"))
    v = t(s, d, "embeddings").select(F.col("vec_id").alias("embedding_id"), "embedding", F.when(F.col("label") < 5, "small").otherwise("large").alias("model"))
    out = joins.embedded_segments(segments, v, model="small", documents=[i for i in range(50) if i not in (3, 4)])
    return out.select("doc_id", "document_id", F.size("embedding").cast("long").alias("size"))


@query("resolved_edges", "WITH n AS (SELECT source AS label, max(doc_id) AS node FROM documents GROUP BY 1) SELECT d.doc_id, n.node AS src, m.node AS dst FROM documents d JOIN n ON n.label = d.source JOIN n m ON m.label = 'src' || (d.doc_id % 30)")
def resolved_edges(s, d):
    """Several nodes have a label: the last counts; a label without a node drops its edge."""
    docs = t(s, d, "documents")
    edges = docs.select("doc_id", F.col("source").alias("src_label"), F.concat(F.lit("src"), (F.col("doc_id") % 30).cast("string")).alias("dst_label"))
    return joins.resolved_edges(edges, docs.select(F.col("source").alias("label"), F.col("doc_id").alias("node"))).select("doc_id", "src", "dst")


@query("parent_context", "SELECT doc_id, md5(text) AS content FROM documents WHERE doc_id IN (SELECT vec_id // 3 FROM embeddings WHERE label <> 1)")
def parent_context(s, d):
    hits = t(s, d, "embeddings").where("label <> 1").select(F.floor(F.col("vec_id") / 3).alias("parent_id"))
    segments = t(s, d, "documents").select(F.col("doc_id").alias("segment_id"), F.md5("text").alias("content"))
    return retrieval.parent_context(hits, segments).select(F.col("segment_id").alias("doc_id"), "content")


@query("message_page", "SELECT conv_id, turn, role, more AS has_more FROM (SELECT conv_id, turn, role, count(*) OVER () > 6 AS more FROM conversations WHERE conv_id = 3 ORDER BY turn DESC LIMIT 3 OFFSET 3)")
def message_page(s, d):
    return retrieval.message_page(t(s, d, "conversations"), 3, 2, 3).select("conv_id", "turn", "role", "has_more")


_ALIASES = f"""SELECT a.id AS entity_id, b.s AS alias, max({_ALIKE}) AS similarity FROM (SELECT p_partkey AS id, p_name AS s, p_brand AS t FROM part WHERE p_size < 10) a JOIN (SELECT p_name AS s, p_brand AS t FROM part WHERE p_size >= 10) b ON a.t = b.t AND a.s <> b.s AND {_ALIKE} >= 0.8 GROUP BY 1, 2"""


def _entities(s, d):
    p = t(s, d, "part")
    e = p.where("p_size < 10").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"))
    return e, p.where("p_size >= 10").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("type"), (F.col("p_size") / 50).alias("confidence"))


@query("alias_candidates", f"SELECT entity_id, alias, round(similarity, 6) AS similarity FROM ({_ALIASES}) WHERE (entity_id, alias) NOT IN (SELECT (p_partkey + 1, p_name) FROM part)")
def alias_candidates(s, d):
    e, n = _entities(s, d)
    known = t(s, d, "part").select((F.col("p_partkey") + 1).alias("entity_id"), F.col("p_name").alias("alias"))
    return entities.alias_candidates(e, n, known).select("entity_id", "alias", F.round("similarity", 6).alias("similarity"))


@query("learned_entities", f"""WITH a AS ({_ALIASES}), x AS (SELECT p_brand AS t, lower(p_name) AS l, min(p_partkey) AS exact_id FROM part WHERE p_size < 10 GROUP BY 1, 2), b AS (SELECT alias, min((-similarity, entity_id)) AS b FROM a GROUP BY 1)
SELECT p_partkey AS id, CASE WHEN exact_id IS NOT NULL THEN 'use' WHEN b IS NOT NULL THEN 'alias' WHEN p_size / 50 >= 0.7 THEN 'create' ELSE 'skip' END AS action, coalesce(exact_id, b[2]) AS entity_id FROM part LEFT JOIN x ON t = p_brand AND l = lower(p_name) LEFT JOIN b ON alias = p_name WHERE p_size >= 10""")
def learned_entities(s, d):
    e, n = _entities(s, d)
    return entities.learned(n, e).select("id", "action", "entity_id")


_STATUS = "CASE doc_id % 3 WHEN 0 THEN 'embedding' WHEN 1 THEN 'completed' ELSE 'waiting' END"


@query("unstuck_segments", f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 11 > 5 THEN 'waiting' ELSE {_STATUS} END AS status FROM documents")
def unstuck_segments(s, d):
    now = F.lit("2024-01-10 12:00:00").cast("timestamp")
    rows = t(s, d, "documents").select("doc_id", F.expr(_STATUS).alias("status"), (now - F.make_interval(mins=(F.col("doc_id") % 11).cast("int"))).alias("indexing_at"))
    return mutations.unstuck(rows, now).select("doc_id", "status")


@query("segments_to_embed", f"SELECT doc_id FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE vec_id IS NULL AND length(trim(text)) > 0 AND {_STATUS} <> 'completed'")
def segments_to_embed(s, d):
    rows = t(s, d, "documents").join(t(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("embedding_id")), "doc_id", "left").withColumn("status", F.expr(_STATUS))
    return rows.where(predicates.needs_embedding("embedding_id", "text", "status")).select("doc_id")


@query("limited_arrays", "SELECT doc_id, array_to_string(w[:10], ' ') AS words, len(w)::INT AS words_total, len(w) > 10 AS words_limited FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def limited_arrays(s, d):
    out = predicates.limited_arrays(t(s, d, "documents").select("doc_id", F.split("text", " ").alias("words")))
    return out.select("doc_id", F.array_join("words", " ").alias("words"), "words_total", "words_limited")


@query("records_as_posts", "SELECT sha256('doc' || doc_id || '|' || lang) AS hash, 'corpus' AS provider, source, lang AS title, doc_id::VARCHAR AS number, n_chars::VARCHAR AS size FROM documents")
def records_as_posts(s, d):
    docs = t(s, d, "documents").select("doc_id", "lang", "n_chars", "source")
    out = records.as_post(docs, title="lang", provider="corpus", source=F.col("source"), fields={"doc_id": "meta.number", "n_chars": "meta.size"}, hash_fields=["doc_id", "lang"], prefix="doc")
    return out.select("hash", "provider", "source", "title", F.get_json_object("meta", "$.number").alias("number"), F.get_json_object("meta", "$.size").alias("size"))


# stars: each customer or supplier hangs on its nation alone
_STARS = f"(SELECT src, dst, count(*) OVER (PARTITION BY dst) AS k FROM {_E})"


@query("closeness_sketch", f"SELECT src AS node, round(k / (1 + 2 * (k - 1)), 4) AS closeness FROM {_STARS} UNION ALL SELECT DISTINCT dst, 1.0 FROM {_E}")
def closeness_sketch(s, d):
    return graph.sketched_closeness(_edges(s, d)).withColumn("closeness", F.round("closeness", 4))


@query("path_length_sketch", f"SELECT round((sum(k) + sum(k * (k - 1))) / sum(k + k * (k - 1) / 2), 3) AS mean_path_length FROM (SELECT dst, count(*)::DOUBLE AS k FROM {_E} GROUP BY 1)")
def path_length_sketch(s, d):
    return graph.sketched_path_length(_edges(s, d)).select(F.round("mean_path_length", 3).alias("mean_path_length"))


@query("graph_delete", "SELECT a.doc_id AS src, b.doc_id AS dst FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.source <> 'src0' AND b.source <> 'src0' UNION ALL SELECT doc_id, doc_id + 1 FROM documents WHERE source <> 'src0' AND doc_id + 1 NOT IN (SELECT doc_id FROM documents)")
def graph_delete(s, d):
    """The edges left when the graph of one source is gone; documents are nodes in a chain."""
    docs = t(s, d, "documents")
    nodes = docs.select(F.col("doc_id").alias("node"), F.lit(1).alias("dataset_id"), F.col("source").alias("segment_id"))
    edges = docs.select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("dst"), F.lit(1).alias("dataset_id"))
    return graph.without(nodes, edges, segment="src0")[1].select("src", "dst")


@query("timeouts", """WITH e AS (SELECT user_id::VARCHAR AS id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'embedding' ELSE 'active' END AS status, ts FROM events),
n AS (SELECT *, lead(ts) OVER (PARTITION BY id ORDER BY ts, status) AS next, ts + CASE status WHEN 'completed' THEN INTERVAL 24 HOUR WHEN 'embedding' THEN INTERVAL 5 MINUTE ELSE INTERVAL 1 HOUR END AS due FROM e)
SELECT id, CASE status WHEN 'embedding' THEN 'waiting' ELSE 'removed' END AS action, status, count(*) AS n FROM n WHERE due < coalesce(next, TIMESTAMP '2024-02-01') GROUP BY 1, 2, 3""")
def timeouts(s, d):
    """The rule of the timer stream over a finished table."""
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "view", "embedding").otherwise("active")
    e = t(s, d, "events").select(F.col("user_id").alias("id"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    return timers.timed_out_by(e, "2024-02-01").groupBy("id", "action", "status").agg(F.count("*").alias("n"))

"""DuckDB SQL of the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from .codes import ENTRIES, PARTS, ROUNDS, SCALE
from .mixing import BAD, BINS, GOOD, MOST, SHARE, UNKNOWN, WEIGHTS
from .reputation import LOWER, RULES, TWO_LABEL_SUFFIXES, UPPER
from .spelling import OCCURRENCES, ODD, SHORTEST, TIMES


def _rules(give: str) -> str:
    rules = sorted(RULES, key=lambda r: (-len(r.text), r.text))
    return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, give)}'" for r in rules) + " END"


def _level(name: str, keys: str, source: str, parent: str) -> str:
    """A level's posterior means: prior strength by moments over its rows, each with the parent's mean m."""
    return f"""{name}0 AS (SELECT {keys}, n, bad, m FROM ({source}) {parent}),
{name}k AS (SELECT 1 / least(greatest(coalesce(sum(pow(bad - n * m, 2) - n * m * (1 - m)) / nullif(sum(n * m * (1 - m) * (n - 1)), 0), 0), 0.01), 0.5) - 1 AS k FROM {name}0),
{name} AS (SELECT {keys}, n, bad, (k * m + bad) / (k + n) AS mean, k + n AS mass FROM {name}0, {name}k)"""


OP1 = f"""WITH p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
FROM (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS rest FROM pages)),
o AS (SELECT doc_id AS page_id, max(greatest(1 - quality, toxic)) AS bad FROM labels WHERE doc_id IS NOT NULL AND greatest(1 - quality, toxic) IS NOT NULL GROUP BY 1),
c AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM p LEFT JOIN o USING (page_id) GROUP BY host),
s AS (SELECT *, string_split(name, '.') AS t, regexp_matches(name, '^[0-9.]*$|:') OR len(string_split(name, '.')) < 2 AS plain FROM c),
h AS (SELECT host, n, bad, CASE WHEN plain THEN name WHEN two THEN array_to_string(t[-3:], '.') ELSE array_to_string(t[-2:], '.') END AS domain, CASE WHEN plain THEN name WHEN two THEN array_to_string(t[-2:], '.') ELSE t[-1] END AS suffix
FROM (SELECT *, array_to_string(t[-2:], '.') IN ({", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)}) AS two FROM s)),
root AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS m FROM h),
{_level("a", "suffix", "SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1", ", root")},
{_level("b", "domain, suffix", "SELECT domain, suffix, sum(h.n) AS n, sum(h.bad) AS bad, any_value(mean) AS m FROM h JOIN a USING (suffix) GROUP BY 1, 2", "")},
{_level("d", "host", "SELECT host, h.n, h.bad, mean AS m FROM h JOIN b USING (domain, suffix)", "")}
SELECT page_id, host, path, {_rules("text")} AS rule, coalesce({_rules("verdict")}, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, n::BIGINT AS labelled, round(mean, 6) AS bad_rate, round(low, 6) AS bad_rate_low
FROM (SELECT p.*, d.n, d.mean, greatest(mean - 1.645 * sqrt(mean * (1 - mean) / (mass + 1)), 0.0) AS low FROM p JOIN d USING (host))"""

_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[ \\x09-\\x0D]+'), lambda w: w <> '')"

OP5 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
t AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, t.b FROM r JOIN t ON t.a = r.other)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1) c ON c.doc_id = s.doc_id"""

_W = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {} {} END".format(len(WEIGHTS), " ".join(f"WHEN {i} THEN {w}::DOUBLE" for i, w in enumerate(WEIGHTS)))

OP8 = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+'))::BIGINT AS size FROM documents),
q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
k AS (SELECT d.*, -ln((('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / CASE quality WHEN 1 THEN {GOOD} WHEN 0 THEN {BAD} ELSE {UNKNOWN} END::DOUBLE AS key FROM d LEFT JOIN q ON q.doc_id = d.doc_id),
z AS (SELECT source, sum(size)::BIGINT AS source_size, {_W} AS weight FROM k GROUP BY 1),
c AS (SELECT *, source_size * {MOST}::DOUBLE AS cap, sum(source_size) OVER () * {SHARE}::DOUBLE AS budget FROM z),
v AS (SELECT *, (budget - sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)) / nullif(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS level, budget / sum(weight) OVER () AS x0 FROM c),
g AS (SELECT source, source_size, weight, least(cap, greatest(x0, coalesce(max(level) OVER (), x0)) * weight) AS target FROM v),
h AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g),
r AS (SELECT k.*, h.source_size, h.weight, h.target, h.epochs, h.target - h.epochs * h.source_size AS rest, sum(size) OVER (PARTITION BY k.source ORDER BY least(floor((1 - exp(-key)) * {BINS}), {BINS} - 1), key, k.doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM k JOIN h ON h.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source, source_size, target, weight, epochs, ((epochs + CASE WHEN rest > 0 AND (run <= rest OR (rest - (run - size) > 0 AND size < 2 * (rest - (run - size)))) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r"""


def _crc_table() -> str:
    """The 256 steps of the usual crc32 (reversed polynomial), from its rule."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return f"{out}::BIGINT[]"


# near words meet by the pattern of a word with one place blanked (replacements) or by a word with one letter out
OP11 = f"""WITH RECURSIVE t AS (SELECT {_crc_table()} AS crc),
o AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM o GROUP BY 1, 2),
b AS (SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS bytes FROM d),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(bytes, lambda x: x::BIGINT)), lambda a, x: xor(a >> 8, crc[xor(a & 255, x) + 1])), 4294967295::BIGINT) AS h FROM b, t),
v AS (SELECT CASE WHEN h % {ODD} = 0 THEN run[:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING len(word) >= {SHORTEST} AND sum(n) >= {OCCURRENCES}),
i AS (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v),
c AS (SELECT DISTINCT word, n, word[:i - 1] || word[i + 1:] AS cut FROM i),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM i a JOIN i b ON a.i = b.i AND len(a.word) = len(b.word) AND a.word[:a.i - 1] || '_' || a.word[a.i + 1:] = b.word[:b.i - 1] || '_' || b.word[b.i + 1:] AND a.word <> b.word
UNION ALL SELECT c.word, v.word, v.n FROM c JOIN v ON v.word = c.cut
UNION ALL SELECT v.word, c.word, c.n FROM c JOIN v ON v.word = c.cut),
f AS (SELECT word, count(*) AS n_near, min_by(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM p GROUP BY 1),
g AS (SELECT v.word, CASE WHEN form_n >= {TIMES} * n THEN form END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= {TIMES} * n THEN form_n END::BIGINT AS form_n FROM v LEFT JOIN f USING (word)),
r AS (SELECT word, form AS root, 1 AS steps FROM g WHERE form IS NOT NULL UNION ALL SELECT r.word, g.form, steps + 1 FROM r JOIN g ON g.word = r.root WHERE g.form IS NOT NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM g LEFT JOIN (SELECT word, max_by(root, steps) AS root FROM r GROUP BY 1) USING (word)"""


def _codes() -> str:
    """Rounds of op13: parts i0 (dim values each), codebooks b0 .. and the codes c0 .. of each round."""
    out = []
    for k in range(ROUNDS + 1):
        # nearest entry by distance, then by number
        out.append(f"c{k} AS MATERIALIZED (SELECT vec_id, p, min((d, e)) AS best FROM (SELECT i.vec_id, i.p, b.e, list_sum(list_transform(list_zip(i.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM i JOIN b{k} b ON b.p = i.p) GROUP BY 1, 2)")
        if k < ROUNDS:
            out.append(f"m{k} AS (SELECT p, e, list(m ORDER BY j) AS x FROM (SELECT c.p, c.best[2] AS e, j, floor(sum(i.x[j])::DOUBLE / count(*))::BIGINT AS m FROM c{k} c JOIN i ON i.vec_id = c.vec_id AND i.p = c.p, range(1, (SELECT max(len(x)) FROM i) + 1) r(j) WHERE j <= len(i.x) GROUP BY 1, 2, 3) GROUP BY 1, 2)")
            out.append(f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (p, e))")
    return ",\n".join(out)


# whole numbers below 2^53 throughout, so the divisions are exact
OP13 = f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
i AS MATERIALIZED (SELECT vec_id, p, x[p * len(x) // {PARTS} + 1:(p + 1) * len(x) // {PARTS}] AS x FROM v, range({PARTS}) r(p)),
b0 AS (SELECT p, e, x FROM i JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v) USING (vec_id) WHERE e < {ENTRIES}),
{_codes()},
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS}),
r AS (SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM c{ROUNDS} GROUP BY 1)
SELECT r.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r JOIN v ON v.vec_id = r.vec_id, h"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_reputation": OP1, "op5_minmax_neardup": OP5, "op8_mix_sources": OP8, "op11_spelling_variants": OP11, "op13_vector_codes": OP13}

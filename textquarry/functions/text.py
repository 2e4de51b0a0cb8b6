"""Scalar text functions as column expressions, and keyword extraction as a relation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of an Arrow batch whose tokens a task counts at a time.
HELD = 256

# English stop words of the keyword extractor.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "can", "this", "that", "these", "those",
    "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their", "mine", "yours", "hers", "ours", "theirs", "not", "no", "yes", "from", "up", "about", "into", "over", "after", "before", "during", "between", "among", "through",
    "against", "above", "below", "down", "out", "off", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "only", "own", "same", "so", "than", "too", "very", "just", "now",
    "also", "however", "therefore", "thus", "hence", "moreover", "furthermore",
)
# Chinese stop words of the keyword extractor.
CHINESE_STOP_WORDS = (
    "的", "是", "在", "有", "和", "或", "但", "於", "以", "及", "與", "等", "如", "若", "而", "則", "亦", "即", "乃", "其", "此", "該", "這", "那", "些", "各", "每", "所", "不", "沒", "無", "非", "未", "否", "也", "都", "又", "還", "就", "只", "才", "已", "很", "最", "更", "太",
    "十分", "非常", "相當", "比較", "特別", "尤其", "特殊", "一般", "通常", "經常", "往往", "總是", "從來", "一直", "始終", "到底", "究竟", "什麼", "怎麼", "為什麼", "哪裡", "何時", "如何", "多少", "幾個", "哪些", "誰", "我", "你", "他", "她", "它", "我們", "你們", "他們", "她們", "它們", "自己",
    "上", "下", "前", "後", "裡", "外", "內", "中", "間", "旁", "邊", "側", "左", "右", "可以", "能夠", "應該", "必須", "需要", "想要", "希望", "願意", "打算", "決定",
)
# Glyphs that PDF extraction gets wrong, and typographic signs, in order.
PDF_FIXES = (
    (r"C([a-z])", "fi$1"), (r"([a-z])C([a-z])", "$1fi$2"), (r"=([a-z])", "ti$1"), (r"([a-z])=([a-z])", "$1ti$2"), (r"\bEn=ty\b", "Entity"), (r"\bExtrac=on\b", "Extraction"), (r"\bCiles?\b", "Files"), (r"\bworkClow\b", "workflow"), (r"\bDeCine\b", "Define"),
    (r"\bspeciCica=on\b", "specification"), (r"\bfunc=onali=es\b", "functionalities"), (r"\bmanagemen=\b", "management"), (r"\bdocumen=\b", "document"), (r"\brequiremen=s?\b", "requirements"), (r"\bintegra=on\b", "integration"), (r"\bauthen=ca=on\b", "authentication"),
    (r"\bimplementa=on\b", "implementation"), (r"fifi", "fi"), (r"titi", "ti"), (r"[\x{2018}\x{2019}]", "'"), (r"[\x{201C}\x{201D}]", '"'), (r"[\x{2013}\x{2014}]", "-"), (r"\x{2026}", "..."), (r"\x{A0}", " "),
)
# Clean-up patterns of Chinese text, in order, by stage.
CHINESE_FIXES = (
    (r"(?<=[\x{4e00}-\x{9fff}])\s+(?=[\x{4e00}-\x{9fff}])", ""), (r"\s*([，。；：！？、）】〉》」』])\s*", "$1"), (r"\s*([（【〈《「『])\s*", "$1"), (r"[ \t]+", " "), (r"(?m)[ \t]+$", ""), (r"(?m)^[ \t]+", ""),
    (r"(?<=[\x{4e00}-\x{9fff}])\n(?=[\x{4e00}-\x{9fff}])", ""), (r"([。！？；])\n", "$1\n\n"), (r"\n{3,}", "\n\n"), (r"(?<=[\x{4e00}-\x{9fff}，、])\n+(?=[\x{4e00}-\x{9fff}])", ""), (r"([。！？])(?=[\x{4e00}-\x{9fff}])", "$1\n"),
    (r"(?m)^\s*\d+\s*$", ""), (r"[\s\x{A0}]+", " "), (r"([。！？]){2,}", "$1"),
    (r"(\d)[\s]*([。，])", "$1$2"), (r"(?<=[\x{4e00}-\x{9fff}])([A-Za-z])", " $1"), (r"([A-Za-z])(?=[\x{4e00}-\x{9fff}])", "$1 "), (r"([，。；：！？])([A-Za-z])", "$1 $2"), (r"(?<=[\x{4e00}-\x{9fff}])(\d)", " $1"), (r"(\d)(?=[\x{4e00}-\x{9fff}])", "$1 "),
    (r"(\d+)\s*\.\s*(\d+)", "$1.$2"), (r"\(\s*(\d+)\s*\)", "($1)"),
    (r"(\d+)\s+([條章節項目])", "$1$2"), (r"([第])\s+(\d+)", "$1$2"), (r"\s{2,}", " "),
)


def _chain(text: Column, fixes) -> Column:
    for pattern, put in fixes:
        text = F.regexp_replace(text, pattern, put)
    return text


def clean_general(text: Column) -> Column:
    """Glyph fixes, line ends, runs of space and blank lines; null as empty."""
    out = _chain(F.coalesce(text, F.lit("")), PDF_FIXES)
    out = F.regexp_replace(F.regexp_replace(out, r"\r\n?", "\n"), r"[ \t]{2,}", " ")
    lines = F.filter(F.transform(F.split(out, "\n"), lambda x: F.regexp_replace(x, r"^[ \t]+|[ \t]+$", "")), lambda x: F.length(F.trim(x)) > 0)
    return F.trim(F.array_join(lines, "\n"))


def clean_chinese(text: Column) -> Column:
    return F.trim(_chain(F.coalesce(text, F.lit("")), CHINESE_FIXES))


def han_share(text: Column) -> Column:
    """Share of Han characters among those that are no white space; 0 for none."""
    solid = F.regexp_replace(text, r"\s", "")
    han = F.length(F.regexp_replace(solid, r"[^\x{4e00}-\x{9fff}]", ""))
    return F.coalesce(F.try_divide(han, F.length(solid)), F.lit(0.0))


def is_chinese(text: Column) -> Column:
    return han_share(text) > 0.15


def word_count(text: Column) -> Column:
    """Words of the trimmed text, split at white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def token_estimates(text: Column) -> dict[str, Column]:
    """Four estimates: mixed (Han/1.5 + rest/4), weighted (Han + 1.3 words + 0.1 punctuation), length / 4, 0.75 words."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    han = n - F.length(F.regexp_replace(text, r"[\x{4e00}-\x{9fff}]", ""))
    words = F.regexp_count(text, F.lit(r"[A-Za-z]+"))
    signs = F.regexp_count(text, F.lit(r"[^\w\s\x{4e00}-\x{9fff}]"))
    return {
        "mixed": F.ceil(han / F.lit(1.5) + (n - han) / F.lit(4.0)),
        "weighted": F.ceil(han + words * F.lit(1.3) + signs * F.lit(0.1)),
        "by_length": F.ceil(n / F.lit(4.0)),
        "by_words": F.ceil(word_count(text) * F.lit(0.75)),
    }


def transformed(text: Column, how: str) -> Column:
    """trim, lowercase, uppercase, trim_lowercase, trim_uppercase; others leave the text as it is."""
    out = F.trim(text) if how.startswith("trim") else text
    if how.endswith("lowercase"):
        return F.lower(out)
    return F.upper(out) if how.endswith("uppercase") else out


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """(longer length - distance) / longer length; two empty texts give 1."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise((longest - F.levenshtein(a, b)) / longest)


def aliases(name: Column) -> Column:
    """Spellings of a name: spaces left out or as _ or -, and lower case; without the name itself."""
    spaced = F.contains(name, F.lit(" "))
    made = F.array(*[F.when(spaced, F.regexp_replace(name, r"\s+", s)) for s in ("", "_", "-")], F.when(name != F.lower(name), F.lower(name)))
    return F.array_distinct(F.filter(made, lambda x: x.isNotNull() & (x != name)))


def reply_json(text: Column) -> Column:
    """JSON text in a model's reply: a fenced block, else from the first { to the last }, else [ to ]; null if none parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    tries = [fenced, F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.regexp_extract(text, r"(?s)(\[.*\])", 1)]
    return F.coalesce(*[F.when((F.length(F.trim(t)) > 0) & F.try_parse_json(t).isNotNull(), F.regexp_replace(t, r"^\s+|\s+$", "")) for t in tries])


def filled(template: str, values: dict[str, Column], content: Column) -> Column:
    """``{{content}}``, ``{{text}}`` and ``{{post}}`` become the content, ``{{key}}`` the value of that key."""
    out = F.lit(template)
    for key, value in {"content": content, "text": content, "post": content, **values}.items():
        out = F.replace(out, F.lit("{{" + key + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def labelled_lines(pairs: list[tuple[str, Column]]) -> Column:
    """``Label: value`` lines of the values that are there: a post or segment as prompt text."""
    return F.concat_ws("\n", *[F.when(v.isNotNull() & (F.length(v.cast("string")) > 0), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in pairs])


def block_kind(text: Column) -> Column:
    """title, list, footer or paragraph of a block of text."""
    line = F.trim(text)
    return (
        F.when(line.rlike(r"^#{1,6}\s|^[0-9]+(\.[0-9]+)*\.?\s+[A-Z]|^[A-Z][A-Z0-9 ]{2,60}$"), "title")
        .when(line.rlike(r"^([-*•·]|[0-9]+[.)]|[a-z][.)])\s"), "list")
        .when(line.rlike(r"(?i)^(page\s+[0-9]+|[0-9]+\s*/\s*[0-9]+|©|copyright)"), "footer")
        .otherwise("paragraph")
    )


def block_confidence(text: Column) -> Column:
    """0.5, 0.2 more for 50 characters, 0.3 for a title or list, 0.2 for a paragraph; at most 1."""
    kind = block_kind(text)
    return F.least(F.lit(1.0), F.lit(0.5) + F.when(F.length(text) >= 50, 0.2).otherwise(0.0) + F.when(kind.isin("title", "list"), 0.3).when(kind == "paragraph", 0.2).otherwise(0.0))


def keyword_tokens(text: Column) -> Column:
    """Tokens of 3 to 19 ASCII letters that are no stop words, in order."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^A-Za-z0-9_\s]", " "), r"\s+")
    return F.filter(parts, lambda t: t.rlike("^[a-z]{3,19}$") & ~t.isin(*STOP_WORDS))


def _ranked(n: int):
    """For mapInArrow over (key, tokens): key, rank, token, freq of each row's n commonest tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), HELD):
                batch = whole.slice(start, HELD)
                sizes, coded = np.diff(batch.column(1).offsets.to_numpy()), batch.column(1).flatten().dictionary_encode()
                kinds = max(1, len(coded.dictionary))
                cells, first, freq = np.unique(np.repeat(np.arange(len(sizes)), sizes) * kinds + coded.indices.to_numpy(), return_index=True, return_counts=True)
                order = np.lexsort((first, -freq, cells // kinds))
                row, token, freq = cells[order] // kinds, cells[order] % kinds, freq[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                top = rank <= n
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[top])), pa.array(rank[top], pa.int32()), coded.dictionary.take(pa.array(token[top])), pa.array(freq[top], pa.int64())], names=["key", "rank", "token", "freq"])

    return run


def _by_key(docs: DataFrame, n: int, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """Tokens (key, tokens) of the rows that have their key alone, and the n commonest (key, rank, token, freq) of the others' keys, if there are any."""
    tokens = docs.select(F.col(key).alias("key"), keyword_tokens(F.col(text)).alias("tokens"))
    again = tokens.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("again"))
    if again.isEmpty():
        return tokens, None
    shared = F.col("key").eqNullSafe(F.col("again"))
    each = tokens.join(again, shared, "left_semi").select("key", F.posexplode("tokens").alias("pos", "token"))
    counts = each.groupBy("key", "token").agg(F.count("*").alias("freq"), F.min("pos").alias("first"))
    w = Window.partitionBy("key").orderBy(F.desc("freq"), "first")
    some = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("key", "rank", "token", "freq")
    return tokens.join(again, shared, "left_anti"), some


def keywords(docs: DataFrame, n: int = 10, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The n commonest tokens of each document (ties: first seen): key, rank, token, freq.

    Tokens are counted where the text is read. Only those of rows that share a key (looked for at once, among the keys alone) are
    shuffled, and counted together.
    """
    alone, some = _by_key(docs, n, key, text)
    out = alone.mapInArrow(_ranked(n), f"key {alone.schema['key'].dataType.simpleString()}, rank int, token string, freq long")
    return (out if some is None else out.unionByName(some)).withColumnRenamed("key", key)


def stem(word: str) -> str:
    """Porter's algorithm (public, 1980) for one lower-case word."""
    if len(word) < 3:
        return word
    vowel = lambda w, i: w[i] in "aeiou" or (w[i] == "y" and i > 0 and not vowel(w, i - 1))
    has_vowel = lambda w: any(vowel(w, i) for i in range(len(w)))

    def measure(w: str) -> int:
        kinds = [vowel(w, i) for i in range(len(w))]
        return sum(a and not b for a, b in zip(kinds, kinds[1:], strict=False))

    double = lambda w: len(w) > 1 and w[-1] == w[-2] and not vowel(w, len(w) - 1)
    cvc = lambda w: len(w) > 2 and not vowel(w, len(w) - 3) and vowel(w, len(w) - 2) and not vowel(w, len(w) - 1) and w[-1] not in "wxy"

    def swap(w: str, table, least: int) -> str:
        for end, put in table:
            if w.endswith(end):
                base = w[: len(w) - len(end)]
                return base + put if measure(base) > least else w
        return w

    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and has_vowel(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif measure(word) == 1 and cvc(word):
                    word += "e"
                break
    if word.endswith("y") and has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = swap(word, (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")), 0)
    word = swap(word, (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")), 0)
    for end in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"):
        if word.endswith(end):
            base = word[: len(word) - len(end)]
            if measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if measure(base) > 1 or (measure(base) == 1 and not cvc(base)):
            word = base
    return word[:-1] if measure(word) > 1 and double(word) and word.endswith("l") else word


def stemmed_keywords(docs: DataFrame, n: int = 8, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its ten commonest tokens followed by their stems, the first n distinct.

    As in ``keywords``, all is done where the text is read, but for rows that share a key.
    """
    alone, some = _by_key(docs, 10, key, text)
    distinct = lambda ts: list(dict.fromkeys([*ts, *map(stem, ts)]))[:n]
    batch_of = lambda keys, rows: pa.RecordBatch.from_arrays([keys, pa.array([distinct(ts) for ts in rows], pa.list_(pa.string()))], names=["key", "keywords"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _ranked(10)(batches):
            # the tokens of a row stand together, from rank 1
            first, tokens = np.flatnonzero(b.column(1).to_numpy() == 1), b.column(2).to_pylist()
            yield batch_of(b.column(0).take(pa.array(first)), [tokens[x:y] for x, y in pairwise([*first, len(tokens)])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch_of(b.column(0), b.column(1).to_pylist())

    schema = f"key {alone.schema['key'].dataType.simpleString()}, keywords array<string>"
    out = alone.mapInArrow(local, schema)
    if some is not None:
        listed = some.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("tokens"))
        out = out.unionByName(listed.mapInArrow(run, schema))
    return out.withColumnRenamed("key", key)


def chinese_keywords(docs: DataFrame, n: int = 10, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The n commonest Han n-grams of 2 to 4 characters and mixed Han-Latin terms (ties: first seen, shorter first)."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x{4e00}-\x{9fff}A-Za-z0-9_\s]", " "), r"\s+", " "))
    size = F.length(clean)
    gram = lambda k: F.when(size >= k, F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.struct((i + F.lit(k * 10_000_000)).alias("pos"), F.substring(clean, i, F.lit(k)).alias("token")))).otherwise(F.array().cast("array<struct<pos:int,token:string>>"))
    mixed = F.transform(F.regexp_extract_all(clean, F.lit(r"([\x{4e00}-\x{9fff}]+[a-zA-Z]+|[a-zA-Z]+[\x{4e00}-\x{9fff}]+)"), F.lit(1)), lambda t, i: F.struct((i + F.lit(90_000_000)).alias("pos"), t.alias("token")))
    every = docs.select(key, F.explode(F.concat(*[F.filter(gram(k), lambda x: x["token"].rlike(r"^[\x{4e00}-\x{9fff}]+$") & ~x["token"].isin(*CHINESE_STOP_WORDS)) for k in (2, 3, 4)], F.filter(mixed, lambda x: F.length(x["token"]).between(2, 10)))).alias("x"))
    counts = every.groupBy(key, F.col("x.token").alias("token")).agg(F.count("*").alias("freq"), F.min("x.pos").alias("first"))
    w = Window.partitionBy(key).orderBy(F.desc("freq"), "first")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(key, "rank", "token", "freq")


def highlight(text: str, matches: list[tuple[str, str, float]]) -> str:
    """Matched texts as [canonical], whole words in any case, the best matches first."""
    for found, canonical, _ in sorted(matches, key=lambda m: -m[2]):
        text = re.sub(rf"\b{re.escape(found)}\b", lambda _m, c=canonical: f"[{c}]", text, flags=re.I)
    return text


def string_hash32(text: Column) -> Column:
    """The 32-bit hash h = 31 h + unit over UTF-16 units, wrapped to a signed number, in base 36 with its sign; null stays null."""
    # code points beyond the first plane are two units
    units = F.flatten(F.transform(F.split(text, ""), lambda c: F.when(F.ascii(c) > 0xFFFF, F.array(0xD800 + F.shiftright(F.ascii(c) - 0x10000, 10), 0xDC00 + (F.ascii(c) - 0x10000) % 1024)).otherwise(F.array(F.ascii(c)))))
    wrap = lambda x: F.pmod(x + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    h = F.when(F.length(text) > 0, F.aggregate(units, F.lit(0).cast("long"), lambda h, u: wrap(h * 31 + u))).otherwise(F.when(text.isNotNull(), F.lit(0).cast("long")))
    return F.concat(F.when(h < 0, "-").otherwise(""), F.lower(F.conv(F.abs(h).cast("string"), 10, 36)))


def highlighted(text: Column, matches: Column) -> Column:
    """``text`` with matched texts (array of found, canonical, score) as [canonical]: whole words in any case, the best matches first."""
    best = F.array_sort(F.transform(matches, lambda m: F.struct((-m["score"]).alias("s"), m["found"].alias("found"), m["canonical"].alias("canonical"))))
    quoted = lambda x: F.regexp_replace(x, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    plain = lambda x: F.regexp_replace(x, r"([\\$])", r"\\$1")
    return F.aggregate(best, text, lambda t, m: F.regexp_replace(t, F.concat(F.lit(r"(?iu)\b"), quoted(m["found"]), F.lit(r"\b")), F.concat(F.lit("["), plain(m["canonical"]), F.lit("]"))))

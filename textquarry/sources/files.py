"""File sources: CSV with templates, plain text with detection, HTML and binary readers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Column templates. Header (lower, trimmed) -> field; which fields are searched and which are metadata.
TEMPLATES = {
    "social_media_post": {
        "fields": {"title": "title", "content": "content", "author": "author", "platform": "platform", "url": "url", "published at": "published_at", "likes": "likes", "shares": "shares", "comments": "comments"},
        "searchable": ("title", "content"),
        "metadata": ("author", "platform", "url", "published_at", "likes", "shares", "comments"),
    },
    "news_article": {
        "fields": {"headline": "title", "body": "content", "author": "author", "publication": "publication", "url": "url", "published at": "published_at", "category": "category"},
        "searchable": ("title", "content"),
        "metadata": ("author", "publication", "url", "published_at", "category"),
    },
}
# File type by extension.
FILE_TYPES = {"txt": "text", "md": "markdown", "html": "html", "htm": "html", "csv": "csv", "json": "json", "xml": "xml", "pdf": "pdf", "doc": "word", "docx": "word", "xls": "excel", "xlsx": "excel", "rtf": "rtf"}
#: Encodings tried in order after UTF-8.
ENCODINGS = ("utf-8", "utf-16", "gb18030", "big5", "shift_jis", "euc-kr", "windows-1252", "iso-8859-1")
#: Largest share of replacement and control characters in a text that counts as readable.
GARBLED = 0.2


def read_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Header row, quotes doubled, trimmed cells, blank lines skipped; empty cells are null. All columns are strings."""
    return spark.read.csv(path, header=True, sep=delimiter, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=True)


def numeric_cells(df: DataFrame) -> dict[str, Column]:
    """Per column: its cells as numbers where they look like numbers."""
    return {c: F.col(f"`{c}`").try_cast("double") for c in df.columns}


def csv_segments(rows: DataFrame, searchable: list[str], order: str) -> DataFrame:
    """position and content of each row: its non-empty, non-numeric searchable cells joined by blank lines.

    Numeric cells drop out, as numbers are not text. Rows are numbered by ``order``
    within ranges, not in one task: numbers of earlier ranges are added up.
    """
    text = lambda c: F.when((F.length(F.trim(c)) > 0) & F.trim(c).try_cast("double").isNull(), F.trim(c))
    content = F.concat_ws("\n\n", *[text(F.col(f"`{c}`")) for c in searchable])
    return numbered(rows.withColumn("content", content), order, "position")


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """A running number by ``order`` (unique), from 1: counted per range of a bounded number of ranges, then within."""
    cuts = rows.agg(F.percentile_approx(F.col(order).cast("double"), [i / 64 for i in range(1, 64)], 1000).alias("c")).first()["c"] or []
    bounds = sorted(set(cuts))
    part = F.size(F.filter(F.lit(bounds or [0.0]), lambda b: b <= F.col(order).cast("double"))) if bounds else F.lit(0)
    rows = rows.withColumn("_part", part)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # at most 64 rows
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return rows.join(F.broadcast(before), "_part").withColumn(name, own + F.col("_before")).drop("_part", "_before")


def header_check(headers: list[str], required: list[str]) -> dict:
    """Missing and extra headers; valid if none is missing."""
    have, need = {h.strip().lower() for h in headers}, {r.strip().lower() for r in required}
    return {"valid": need <= have, "missing": sorted(need - have), "extra": sorted(have - need)}


def apply_template(df: DataFrame, template: str) -> DataFrame:
    """The columns a template knows, renamed to its fields."""
    fields = TEMPLATES[template]["fields"]
    return df.select(*[F.col(f"`{c}`").alias(fields[c.strip().lower()]) for c in df.columns if c.strip().lower() in fields])


def decoded(data: bytes) -> tuple[str, str]:
    """Text and encoding: the first encoding whose text is readable, else Latin-1."""
    for name in ENCODINGS:
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        bad = sum(c == "�" or (ord(c) < 32 and c not in "\t\n\r") for c in text)
        if bad < GARBLED * max(len(text), 1):
            return text, name
    return data.decode("iso-8859-1"), "iso-8859-1"


_SCRIPTS = {"chinese": re.compile(r"[一-鿿]"), "japanese": re.compile(r"[぀-ヿ]"), "korean": re.compile(r"[가-힯]"), "english": re.compile(r"[A-Za-z]")}


def language_of(text: str) -> str:
    """The first script with a share of 30 % of the characters that are no white space."""
    n = sum(not c.isspace() for c in text)
    for name, pattern in _SCRIPTS.items():
        if n and len(pattern.findall(text)) >= 0.3 * n:
            return name
    return "unknown"


def text_type_of(text: str) -> str:
    """markdown, html, json, csv or plain, by markers at the start of lines."""
    head = text.lstrip()[:2000]
    if re.match(r"<!doctype html|<html", head, re.I):
        return "html"
    if head[:1] in "{[" and head[:1]:
        return "json"
    if re.search(r"^#{1,6} |^```|^[-*] ", head, re.M):
        return "markdown"
    lines = [x for x in head.split("\n") if x.strip()]
    if len(lines) > 1 and len({x.count(",") for x in lines[:5]}) == 1 and lines[0].count(","):
        return "csv"
    return "plain"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, file_type, encoding, language, text_type and text of each file under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text, encoding = decoded(data or b"")
                out.append({"path": p, "file_type": FILE_TYPES.get(p.rsplit(".", 1)[-1].lower(), "unknown"), "encoding": encoding, "language": language_of(text), "text_type": text_type_of(text), "text": text})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(n, pa.string()) for n in ("path", "file_type", "encoding", "language", "text_type", "text")]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, file_type string, encoding string, language string, text_type string, text string")


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and tags go, the commonest entities are resolved, space is folded."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))

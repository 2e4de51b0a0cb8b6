"""Filters: the rule-based filter, record search predicates, paging, guarded conditions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FilterRule:
    """A pattern with what to do when it matches: remove, keep or flag. ``flags`` as in ``i``, ``m``, ``s``."""

    id: str
    pattern: str
    action: str = "remove"
    name: str = ""
    flags: str = ""
    enabled: bool = True
    whole_word: bool = False


@dataclass(frozen=True)
class RuleFilter:
    """Rules in order, and the bounds of a content's length.

    Content is lower-cased unless ``case_sensitive``; patterns are used as written.
    """

    rules: tuple[FilterRule, ...] = ()
    content: str = "content"
    default_action: str = "keep"
    min_length: int | None = None
    max_length: int | None = None
    case_sensitive: bool = False
    preserve_empty: bool = False

    def problems(self) -> list[str]:
        """What is wrong with the configuration; nothing if valid."""
        out = [f"rule {i} lacks {name}" for i, r in enumerate(self.rules) for name in ("id", "pattern", "action") if not getattr(r, name)]
        out += [f"rule {r.id}: unknown action {r.action}" for r in self.rules if r.action not in ("remove", "keep", "flag")]
        if self.default_action not in ("remove", "keep"):
            out.append(f"unknown default action {self.default_action}")
        if (self.min_length or 0) < 0 or (self.max_length is not None and self.max_length < (self.min_length or 0)):
            out.append("lengths must satisfy 0 <= min <= max")
        return out

    def usable(self) -> list[tuple[FilterRule, str]]:
        """The enabled rules with patterns that compile; broken ones are skipped."""
        out = []
        for r in self.rules:
            body = rf"\b(?:{r.pattern})\b" if r.whole_word else r.pattern
            flags = "".join(f for f in "ims" if f in r.flags)
            try:
                re.compile(body)
            except re.error:
                continue
            if r.enabled:
                out.append((r, f"(?{flags}){body}" if flags else body))
        return out


def classified(df: DataFrame, spec: RuleFilter) -> DataFrame:
    """``df`` with rule_id (the deciding rule, ``length``, or null) and action."""
    text = F.coalesce(F.col(spec.content).cast("string"), F.lit("")) if spec.content in df.columns else F.lit("")
    n = F.length(text)
    short = F.lit(False)
    if spec.min_length is not None:
        short = short | (n < spec.min_length)
    if spec.max_length is not None:
        short = short | (n > spec.max_length)
    if not spec.preserve_empty:
        short = short | (F.length(F.trim(text)) == 0)
    seen = text if spec.case_sensitive else F.lower(text)
    rule, action = F.when(short, F.lit("length")), F.when(short, F.lit("remove"))
    for r, pattern in spec.usable():
        hit = seen.rlike(pattern)
        rule, action = rule.when(hit, F.lit(r.id)), action.when(hit, F.lit(r.action))
    return df.withColumn("rule_id", rule).withColumn("action", action.otherwise(F.lit(spec.default_action)))


def rule_filter(df: DataFrame, spec: RuleFilter) -> DataFrame:
    """The rows that stay."""
    return classified(df, spec).where("action <> 'remove'").drop("rule_id", "action")


def rule_counts(df: DataFrame, spec: RuleFilter) -> DataFrame:
    """Rows by deciding rule and action."""
    return classified(df, spec).groupBy("rule_id", "action").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class RecordSearch:
    """Conditions on semi-structured records; what is not given is skipped. ``meta`` is JSON text."""

    equal: dict[str, object] = field(default_factory=dict)
    title: str | None = None
    meta_key: str | None = None
    meta_value: object = None
    meta_from: str | None = None
    meta_to: str | None = None
    posted_from: str | None = None
    posted_to: str | None = None
    meta: str = "meta"
    posted: str = "posted_at"
    title_column: str = "title"

    def condition(self) -> Column:
        out = F.lit(True)
        for name, value in self.equal.items():
            if value not in (None, ""):
                out = out & (F.col(name) == value)
        if self.title:
            out = out & F.contains(F.lower(F.col(self.title_column)), F.lit(self.title.lower()))
        at = F.get_json_object(self.meta, "$.post_timestamp")  # compared as text
        if self.meta_from:
            out = out & (at >= self.meta_from)
        if self.meta_to:
            out = out & (at <= self.meta_to)
        if self.posted_from:
            out = out & (F.col(self.posted) >= F.lit(self.posted_from).cast("timestamp_ntz"))
        if self.posted_to:
            out = out & (F.col(self.posted) <= F.lit(self.posted_to).cast("timestamp_ntz"))
        if self.meta_key:
            out = out & meta_condition(self.meta, self.meta_key, self.meta_value)
        return out


def meta_condition(meta: str, key: str, value: object) -> Column:
    """A key of JSON text: exists (value None), matches ``/pattern/flags`` or a pattern, or equals the value."""
    found = F.get_json_object(meta, f"$.{key}")
    if value is None:
        return found.isNotNull()
    if isinstance(value, str):
        m = re.fullmatch(r"/(.*)/([a-z]*)", value, re.S)
        if m:
            return found.rlike(("(?i)" if "i" in m[2] else "") + m[1])
        if re.search(r"[()|\[\]*+?{}^$.]", value) and "/" not in value:
            return found.rlike("(?i)" + value)
        return found == value
    return found == (str(value).lower() if isinstance(value, bool) else str(value))


def page(df: DataFrame, *order: Column, number: int = 1, size: int = 100) -> DataFrame:
    """The page ``number`` (from 1) of ``size`` rows in a total order; a size of 0 gives all."""
    out = df.orderBy(*order)
    return out.offset((number - 1) * size).limit(size) if size else out


def query(df: DataFrame, filters: dict[str, object] | None = None, sort: list[tuple[str, str]] | None = None, number: int = 1, size: int = 0, allowed: set[str] | None = None) -> DataFrame:
    """Filter, sort and page: values are equal, lists are members, ``(low, high)`` a closed range, ``~text`` contains."""
    for name, value in (filters or {}).items():
        c = F.col(name)
        if isinstance(value, list):
            df = df.where(c.isin(value))
        elif isinstance(value, tuple):
            low, high = value
            df = df.where((c >= low) if low is not None else F.lit(True)).where((c <= high) if high is not None else F.lit(True))
        elif isinstance(value, str) and value.startswith("~"):
            df = df.where(F.contains(F.lower(c), F.lit(value[1:].lower())))
        elif value is not None:
            df = df.where(c == value)
    order = [F.col(n).desc() if way.lower() == "desc" else F.col(n).asc() for n, way in sort or [] if allowed is None or n in allowed]
    return page(df, *order, number=number, size=size) if order else (df.limit(size) if size else df)


def text_search(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows with ``text`` in one of the columns, any case."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower()))
    return df.where(cond)


_CONDITION = re.compile(r"(?:\s*(?:[A-Za-z_][A-Za-z_0-9.]*|[0-9]+(?:\.[0-9]+)?|'[^']*'|<=|>=|<>|!=|=|<|>|\(|\)|\+|-|\*|/|%))*\s*")
_WORDS = {"and", "or", "not", "is", "null", "true", "false", "in", "like", "length", "lower", "upper", "trim"}


def guarded(condition: str, columns: list[str]) -> Column:
    """A condition in a small SQL grammar over known columns; anything else is refused."""
    if not _CONDITION.fullmatch(condition):
        raise ValueError(f"not allowed: {condition}")
    for word in re.findall(r"[A-Za-z_][A-Za-z_0-9.]*", re.sub(r"'[^']*'", "", condition)):
        if word.lower() not in _WORDS and word.split(".")[0] not in columns:
            raise ValueError(f"unknown name {word}")
    return F.expr(condition)


def needs_summary(content: str, min_length: int, max_length: int, condition: str | None, columns: list[str]) -> Column:
    """Whether a text is long enough, over the length to keep, and meets the condition."""
    n = F.length(content)
    out = (n >= min_length) & (n > max_length)
    return out & guarded(condition, columns) if condition else out


def needs_embedding(embedding_id: str, content: str, status: str, update_existing: bool = False, skip_completed: bool = True) -> Column:
    """Not yet embedded (unless updating), not blank, not completed."""
    out = F.length(F.trim(F.coalesce(content, F.lit("")))) > 0
    if not update_existing:
        out = out & F.col(embedding_id).isNull()
    if skip_completed:
        out = out & (F.coalesce(F.col(status), F.lit("")) != "completed")
    return out


def limited_arrays(df: DataFrame, most: int = 10) -> DataFrame:
    """Array columns cut to ``most`` items, each with its total and a mark of having been cut."""
    for f in df.schema:
        if f.dataType.typeName() == "array":
            n = F.size(f.name)
            df = df.withColumn(f"{f.name}_total", n).withColumn(f"{f.name}_limited", n > most).withColumn(f.name, F.slice(f.name, 1, most))
    return df


def best_provider(providers: DataFrame, models: str = "models", created: str = "created_at") -> DataFrame:
    """The provider with most models, none known last, the oldest of equals."""
    return providers.orderBy(F.size(models).desc_nulls_last(), F.col(created)).limit(1)


def page_count(df: DataFrame, size: int) -> int:
    """Pages of ``size`` rows that hold all of ``df``; one page if the size is 0."""
    return -(-df.count() // size) if size else 1

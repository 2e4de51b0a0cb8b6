"""Functions on records: paths, field mapping, hashes, type tables, extraction results."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .text import transformed

# Node and edge types by the names that extraction uses.
NODE_TYPES = {
    "author": "author", "brand": "brand", "topic": "topic", "hashtag": "hashtag", "influencer": "influencer", "location": "location", "organization": "organization", "product": "product", "event": "event", "service": "organization", "credit_card": "product", "person": "author", "company": "organization",
    "place": "location", "subject": "topic", "theme": "topic", "concept": "topic",
}
EDGE_TYPES = {
    "mentions": "mentions", "sentiment": "sentiment", "interacts_with": "interacts_with", "competes_with": "competes_with", "discusses": "discusses", "shares_topic": "shares_topic", "follows": "follows", "collaborates": "collaborates", "influences": "influences", "located_in": "located_in",
    "part_of": "part_of", "related_to": "related_to", "offers": "related_to", "used_for": "related_to", "uses_hashtag": "related_to", "connects": "related_to", "links": "related_to", "associates": "related_to", "involves": "related_to", "contains": "related_to", "includes": "related_to",
}


def typed(name: Column, table: dict[str, str], default: str) -> Column:
    """The type of a name by table, any case and surrounding space; unknown or null gives the default."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(F.trim(name))), F.lit(default))


def node_type(name: Column) -> Column:
    return typed(name, NODE_TYPES, "organization")


def edge_type(name: Column) -> Column:
    return typed(name, EDGE_TYPES, "related_to")


def path_value(df: DataFrame, path: str, payload: str | None = None) -> Column:
    """A dotted path: a column or struct field, else a path into JSON text, else null."""
    head = path.split(".")[0]
    if head in df.columns:
        kind = df.schema[head].dataType.typeName()
        if kind == "struct":
            return F.col(path)
        if "." in path:
            return F.get_json_object(head, "$." + path.split(".", 1)[1])
        return F.col(head)
    return F.get_json_object(payload, "$." + path) if payload else F.lit(None).cast("string")


@dataclass(frozen=True)
class Field:
    """Where a target comes from: path, transform by name, default if missing."""

    path: str
    transform: str = ""
    default: object = None


@dataclass(frozen=True)
class Mapping:
    """Targets with their fields, then values by enum table, then constants where still null."""

    fields: dict[str, Field | str]
    enums: dict[str, dict[str, str]] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)

    def merged(self, over: Mapping) -> Mapping:
        """This mapping with another's entries over it."""
        return Mapping(self.fields | over.fields, self.enums | over.enums, self.defaults | over.defaults)


def mapped(df: DataFrame, mapping: Mapping, payload: str | None = None, keep: bool = True) -> DataFrame:
    """``df`` (or only the key columns if not ``keep``) with the mapping's targets."""
    out = {}
    for target, f in mapping.fields.items():
        f = Field(f) if isinstance(f, str) else f
        value = path_value(df, f.path, payload)
        if f.transform:
            value = transformed(value.cast("string"), f.transform)
        if f.default is not None:
            value = F.coalesce(value, F.lit(f.default).cast("string") if payload else F.lit(f.default))
        if target in mapping.enums:
            pairs = [x for k, v in mapping.enums[target].items() for x in (F.lit(k), F.lit(v))]
            value = F.coalesce(F.element_at(F.create_map(*pairs), value.cast("string")), value.cast("string"))
        if target in mapping.defaults:
            value = F.coalesce(value, F.lit(mapping.defaults[target]))
        out[target.replace(".", "_")] = value
    for target, value in mapping.defaults.items():
        out.setdefault(target.replace(".", "_"), F.lit(value))
    return df.withColumns(out) if keep else df.select(*[c.alias(n) for n, c in out.items()])


def record_hash(parts: list[Column], prefix: str = "", algorithm: str = "sha256", separator: str = "|") -> Column:
    """Digest of the prefix and the values that are not null, joined; nulls are skipped, so (a, null, b) equals (a, b)."""
    text = F.concat(F.lit(prefix), F.concat_ws(separator, *[p.cast("string") for p in parts]))
    return {"md5": F.md5(text), "sha256": F.sha2(text, 256), "sha512": F.sha2(text, 512)}[algorithm]


def as_post(df: DataFrame, *, title: str, provider: str, source: Column, fields: dict[str, str], hash_fields: list[str], prefix: str = "") -> DataFrame:
    """hash, provider, source, title and meta (JSON text): mapped fields by their targets, the others by their names."""
    named = {fields.get(c, c).removeprefix("meta."): F.col(c) for c in df.columns if c != title}
    meta = F.to_json(F.struct(*[c.alias(n) for n, c in named.items()]))
    return df.select(record_hash([F.col(c) for c in hash_fields], prefix).alias("hash"), F.lit(provider).alias("provider"), source.alias("source"), F.col(title).alias("title"), meta.alias("meta"))


def spread(left: Column, right: Column) -> Column:
    """Two maps in one, the right one's values first."""
    rest = F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))
    return F.map_concat(rest, right)


def literal(text: str) -> object:
    """A value as typed by a caller: JSON, else true, false, null or a number, else the text itself."""
    try:
        return json.loads(text)
    except ValueError:
        return {"true": True, "false": False, "null": None}.get(text.strip().lower(), text)


def approval(decision: Column, reason: Column, confidence: Column) -> Column:
    """Status of a post by a reviewer's decision, with reason and confidence."""
    return F.struct(F.when(F.lower(F.trim(decision)) == "approved", "approved").otherwise("rejected").alias("status"), reason.alias("reason"), confidence.cast("decimal(5,2)").alias("confidence"))


def with_paths(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``df`` with values set at dotted paths; structs on the way are made or kept, other fields stay.

    Several paths under one head are set one after the other.
    """

    def set_in(kind: StructType | None, base: Column | None, path: list[str], value: Column) -> Column:
        head, rest = path[0], path[1:]
        inner = next((f.dataType for f in kind.fields if f.name == head), None) if kind is not None else None
        if rest:
            nested = inner if isinstance(inner, StructType) else None
            value = set_in(nested, base[head] if nested is not None else None, rest, value)
        if kind is None:
            return F.struct(value.alias(head))
        return F.struct(*[base[f.name].alias(f.name) for f in kind.fields if f.name != head], value.alias(head))

    for path, value in values.items():
        head, *rest = path.split(".")
        if not rest:
            df = df.withColumn(head, value)
            continue
        kind = df.schema[head].dataType if head in df.columns else None
        kind = kind if isinstance(kind, StructType) else None
        df = df.withColumn(head, set_in(kind, F.col(head) if kind is not None else None, rest, value))
    return df


def with_policy(df: DataFrame, payload: str, policy: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the policy's targets set from paths into a reply (JSON text); what the reply lacks is null, and a lacking status stays as it was."""
    values = {}
    for target, path in (policy or SEGMENT_POLICY).items():
        found = F.get_json_object(payload, f"$.{path}")
        values[target] = F.coalesce(found, F.col(target)) if target in df.columns else found
    return with_paths(df, values)


def deep_merged(a: dict, b: dict) -> dict:
    """Two configurations in one: dictionaries go into each other, of other values the second counts."""
    return {k: deep_merged(a[k], b[k]) if k in a and k in b and isinstance(a[k], dict) and isinstance(b[k], dict) else b.get(k, a.get(k)) for k in [*a, *(k for k in b if k not in a)]}


#: Where a segment keeps what a model said of it.
SEGMENT_POLICY = {"status": "status", "meta.extracted": "data", "meta.classification": "data.classification", "meta.confidence": "data.confidence"}


def outlined(df: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a plain outline: a line that ends in a colon names a section, ``* label (description)`` a node of it.

    Without stated edges organisations of a text compete with each other and offer its
    products. A text's own organisations are paired, so the work is bounded by its lines.
    """
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("at", "line"))
    head = F.regexp_extract("line", r"^\s*(?:#+\s*|\*\*)?([A-Za-z_ ]+?)(?:\*\*)?:\s*$", 1)
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.last(F.when(F.length(head) > 0, F.regexp_replace(F.lower(F.trim(head)), r"s$", "")), ignorenulls=True).over(w))
    label = F.trim(F.regexp_extract("line", r"^\s*[*-]\s+([^(]+)", 1))
    nodes = lines.where((F.length(label) > 0) & F.col("section").isNotNull()).select(key, node_type(F.col("section")).alias("type"), label.alias("label"), F.regexp_extract("line", r"\((.*)\)", 1).alias("description")).distinct()
    a, b = nodes.select(key, F.col("label").alias("source_label"), F.col("type").alias("s")), nodes.select(key, F.col("label").alias("target_label"), F.col("type").alias("t"))
    both = a.where("s = 'organization'").join(b, key)
    rival = both.where("t = 'organization' AND source_label < target_label").withColumn("edge_type", F.lit("competes_with"))
    offer = both.where("t = 'product'").withColumn("edge_type", F.lit("offers"))
    return nodes, rival.unionByName(offer).select(key, "source_label", "target_label", "edge_type")


def extraction(df: DataFrame, payload: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of JSON replies that call them nodes or entities, edges or relationships; blanks drop out.

    An edge's ends may name a node by id or by label.
    """
    node = "array<struct<id:string,type:string,nodeType:string,label:string,name:string>>"
    edge = "array<struct<source:string,target:string,from:string,to:string,type:string,edgeType:string,relationship:string,weight:double>>"
    pick = lambda names, kind: F.coalesce(*[F.from_json(F.get_json_object(payload, f"$.{n}"), kind) for n in names])
    nodes = df.select(key, F.explode(pick(("nodes", "entities"), node)).alias("x"))
    nodes = nodes.select(key, F.col("x.id").alias("node_ref"), node_type(F.coalesce("x.nodeType", "x.type")).alias("type"), F.trim(F.coalesce("x.label", "x.name")).alias("label")).where(F.length("label") > 0)
    names = nodes.where("node_ref IS NOT NULL").groupBy(key, "node_ref").agg(F.max("label").alias("named"))
    edges = df.select(key, F.explode(pick(("edges", "relationships"), edge)).alias("x"))
    edges = edges.select(key, F.coalesce("x.source", "x.from").alias("s"), F.coalesce("x.target", "x.to").alias("t"), edge_type(F.coalesce("x.edgeType", "x.type", "x.relationship")).alias("edge_type"), F.coalesce("x.weight", F.lit(1.0)).alias("weight"))
    for end in ("s", "t"):
        edges = edges.join(names.select(key, F.col("node_ref").alias(end), F.col("named").alias(f"{end}_name")), [key, end], "left")
    edges = edges.select(key, F.trim(F.coalesce("s_name", "s")).alias("source_label"), F.trim(F.coalesce("t_name", "t")).alias("target_label"), "edge_type", "weight")
    return nodes.drop("node_ref"), edges.where((F.length("source_label") > 0) & (F.length("target_label") > 0))

"""Text splitters: one text to many chunks.

A splitter works through one text in order, which relational operators can't
express; each is a plain function, run over Arrow batches by ``split_documents``.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Separators of the recursive splitter, best first.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")
#: Texts whose chunks of two levels a task holds at a time.
HELD = 64
_HAN = re.compile(r"[一-鿿]")


def _window(text: str, size: int, overlap: int) -> list[str]:
    """Fixed windows; the last one ends the text."""
    out, start, step = [], 0, max(1, size - overlap)
    while start < len(text):
        out.append(text[start : start + size])
        if start + size >= len(text):
            break
        start += step
    return [x for x in out if x.strip()]


character = _window


def _tail(chunk: str, overlap: int) -> str:
    """The end of a chunk that the next one repeats, from a word's start in its first half if there is one."""
    if len(chunk) <= overlap:
        return chunk
    first = len(chunk) - overlap
    space = chunk.rfind(" ", 0, first + overlap // 2 + 1)
    return (chunk[space + 1 :] if space > first else chunk[first:]).strip()


def recursive_character(text: str, size: int, overlap: int) -> list[str]:
    """Cut at the separator whose priority times position is highest among those that reach further than the better ones.

    A rest shorter than ``size`` is cut in the same way. Overlap goes in front of the
    rest before the separator's length is taken off.
    """
    out, rest = [], text.strip()
    while rest:
        at, cut, score = -1, "", -1.0
        for rank, sep in enumerate(SEPARATORS):
            found = rest.rfind(sep, 0, size + len(sep))
            weight = (len(SEPARATORS) + 1 - rank) * found / size
            if at < found <= size and weight > score:
                at, cut, score = found, sep, weight
        if len(rest) > size:
            space = rest.rfind(" ", max(0, size - int(size * 0.2)), size + 1)
            at, cut = (space, "") if space > 0 else (size, "")
        if at == -1:
            at, cut = min(size, len(rest)), ""
        chunk = rest[:at].strip()
        if chunk:
            out.append(chunk)
        more = _tail(chunk, overlap) + rest[at:] if 0 < overlap < len(chunk) else rest[at:]
        more = more[len(cut) :]
        # progress is certain only if the rest shrinks
        rest = more if len(more) < len(rest) else rest[max(at, 1) :]
    return out


def token_based(text: str, size: int, overlap: int) -> list[str]:
    """Words packed by estimated tokens (a quarter of the length); the last words are repeated, four for each token of the overlap.

    Where that would be the whole chunk nothing is repeated: else each further word would make a
    chunk of all words before it, and the output would grow with the square of the text.
    """
    out, held, count = [], [], 0
    for word in text.split():
        n = math.ceil(len(word) / 4)
        if held and count + n > size:
            out.append(" ".join(held))
            keep = math.ceil(4 * min(overlap, count)) if overlap else 0
            held = held[-keep:] if 0 < keep < len(held) else []
            count = sum(math.ceil(len(w) / 4) for w in held)
        held.append(word)
        count += n
    return [*out, " ".join(held)] if held else out


def _packed(parts: list[str], size: int, overlap: float, joint: str = " ") -> list[str]:
    """Parts packed up to ``size`` characters; trailing parts within ``overlap`` are repeated; a longer part is cut."""
    out, held = [], []
    length = lambda xs: sum(map(len, xs)) + len(joint) * max(len(xs) - 1, 0)
    for part in parts:
        for piece in [part] if len(part) <= size else _window(part, size, 0):
            if held and length([*held, piece]) > size:
                out.append(joint.join(held))
                back: list[str] = []
                for p in reversed(held[1:]):
                    if length([p, *back]) > overlap:
                        break
                    back.insert(0, p)
                held = back if back and length([*back, piece]) <= size else []
            held.append(piece)
    return [*out, joint.join(held)] if held else out


def sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]


def _sentence_tail(chunk: str, overlap: int, slack: float) -> str:
    """What the next chunk repeats: a short chunk whole, else its last sentences within ``slack`` times the overlap, else its end from a word's start."""
    if len(chunk) <= overlap:
        return chunk
    last, room = [], slack * overlap
    for s in reversed(sentences(chunk)):
        room -= len(s) + bool(last)
        if room < -1e-9:
            break
        last.append(s)
    return " ".join(reversed(last)) or _tail(chunk, overlap)


def sentences_packed(text: str, size: int, overlap: int, slack: float) -> list[str]:
    """Sentences joined while they fit into ``size``; each next chunk begins with the tail of the last one. A long sentence stays whole."""
    out: list[str] = []
    for s in sentences(text):
        if out and len(out[-1]) + 1 + len(s) <= size:
            out[-1] += " " + s
        else:
            tail = _sentence_tail(out[-1], overlap, slack) if out and overlap > 0 else ""
            out.append(f"{tail} {s}" if tail else s)
    return out


def sentence_splitter(text: str, size: int, overlap: int) -> list[str]:
    return sentences_packed(text, size, overlap, 1.2)


def paired(chunks: list[str], size: int) -> list[str]:
    """A chunk under max(50, size / 10) and the next one become one if that stays within 1.2 size; what has been joined isn't joined again."""
    least, out, i = max(50, 0.1 * size), [], 0
    while i < len(chunks):
        both = f"{chunks[i]} {chunks[i + 1]}" if i + 1 < len(chunks) else ""
        join = both and len(chunks[i]) < least and len(both) <= 1.2 * size
        out.append(both if join else chunks[i])
        i += 2 if join else 1
    return out


def tiny_merged(chunks: list[str], size: int, joint: str = "\n\n") -> list[str]:
    """A chunk under max(50, size / 10) joins the next one if both stay within 1.2 size; a last one joins back."""
    least, out, i = max(50, 0.1 * size), [], 0
    while i < len(chunks):
        chunk = chunks[i]
        while len(chunk) < least and i + 1 < len(chunks) and len(chunk) + len(joint) + len(chunks[i + 1]) <= 1.2 * size:
            i += 1
            chunk += joint + chunks[i]
        out.append(chunk)
        i += 1
    if len(out) > 1 and len(out[-1]) < least and len(out[-2]) + len(joint) + len(out[-1]) <= 1.2 * size:
        out[-2:] = [out[-2] + joint + out[-1]]
    return out


def smart_chunking(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs, long ones packed by sentences, each tiny one joined with the next."""
    out = []
    for p in re.split(r"\n\s*\n", text):
        if p.strip():
            out += [p.strip()] if len(p) <= size else sentences_packed(p, size, overlap, 1.3)
    return paired(out, size)


def _sections(text: str, start: str, size: int, overlap: int) -> list[str]:
    parts = [p.strip() for p in re.split(start, text, flags=re.M) if p.strip()]
    return [c for p in parts for c in ([p] if len(p) <= size else _window(p, size, overlap))]


def markdown(text: str, size: int, overlap: int) -> list[str]:
    return _sections(text, r"(?=^#{1,6}\s)", size, overlap)


def python_code(text: str, size: int, overlap: int) -> list[str]:
    return _sections(text, r"(?=^(?:def |class |if __name__|import |from ))", size, overlap)


def chinese(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs packed by Chinese sentences, tiny chunks merged, repeated chunks dropped."""
    out = []
    for p in re.split(r"\n\s*\n|\n", text):
        if p.strip():
            out += [p.strip()] if len(p.strip()) <= size else _packed([s.strip() for s in re.split(r"(?<=[。！？；])", p) if s.strip()], size, overlap, "")
    return unique(tiny_merged(out, size, "\n"))


def unique(chunks: list[str]) -> list[str]:
    """Each trimmed chunk once."""
    first: dict[str, str] = {}
    for c in chunks:
        first.setdefault(c.strip(), c)
    return list(first.values())


def by_separators(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Split at the first separator; parts that are too long go on with the next ones, ``""`` cuts by characters."""

    def down(part: str, left: tuple[str, ...]) -> list[str]:
        if len(part) <= size:
            return [part] if part.strip() else []
        if not left or left[0] == "":
            return _window(part, size, overlap)
        return _packed([x for p in part.split(left[0]) for x in down(p, left[1:])], size, overlap, left[0])

    return unique(tiny_merged(down(text, separators), size, "\n"))


def structural(text: str, least: int = 50, most: int = 2000, how: str = "paragraph") -> list[str]:
    """Paragraphs or sentences of at least ``least`` characters; if fewer than three come of a long text, sentences packed."""
    parts = [p.strip() for p in (sentences(text) if how == "sentence" else re.split(r"\n\s*\n", text)) if len(p.strip()) >= least]
    parts = [c for p in parts for c in ([p] if len(p) <= most else _packed(sentences(p), most, 0))]
    return parts if len(parts) >= 3 or len(text) <= most else _packed(sentences(text), most, 0)


SPLITTERS: dict[str, Callable[[str, int, int], list[str]]] = {
    "recursive_character": recursive_character, "character": character, "token": token_based, "token_based": token_based, "sentence_splitter": sentence_splitter, "smart_chunking": smart_chunking, "markdown": markdown, "python_code": python_code, "chinese": chinese, "separators": by_separators,
}


@dataclass(frozen=True)
class ChunkConfig:
    """Splitter, size and overlap in characters (tokens for token_based). ``model`` gives the model's own size for model defaults."""

    splitter: str = "recursive_character"
    size: int = 1000
    overlap: int = 100
    model_size: int = 0

    def effective(self) -> tuple[int, int]:
        if not self.model_size:
            return self.size, self.overlap
        size = max(self.size, self.model_size)
        return size, min(self.overlap, int(0.1 * size))

    def problems(self, most: int = 8000, share: float = 0.5) -> list[str]:
        out = []
        if not 100 <= self.size <= most:
            out.append(f"size must be 100 to {most}")
        if not 0 <= self.overlap <= share * self.size:
            out.append(f"overlap must be 0 to {share:.0%} of the size")
        return out


def split(text: str | None, config: ChunkConfig) -> list[str]:
    """Chinese text goes to its own splitter, other text to the one named (recursive_character if unknown)."""
    text = text or ""
    solid = sum(not c.isspace() for c in text)
    name = "chinese" if solid and len(_HAN.findall(text)) > 0.15 * solid else config.splitter
    return SPLITTERS.get(name, recursive_character)(text, *config.effective())


def parent_child(text: str | None, size: int, overlap: int) -> list[dict]:
    """Parents of at most 1200 characters, then children; child i belongs to parent i // 2, and goes if there is none."""
    parents = split(text, ChunkConfig(size=min(2 * size, 1200), overlap=min(2 * overlap, 120)))
    children = split(text, ChunkConfig(size=size, overlap=overlap))
    out = [{"kind": "parent", "position": i + 1, "parent": None, "chunk": p} for i, p in enumerate(parents)]
    kept = [(i // 2, c) for i, c in enumerate(children) if i // 2 < len(parents)]
    return out + [{"kind": "child", "position": len(parents) + i + 1, "parent": p + 1, "chunk": c} for i, (p, c) in enumerate(kept)]


def hierarchical(text: str | None, size: int, overlap: int) -> list[dict]:
    """Children cut from each parent's own text, numbered from 1 in it."""
    out = []
    for i, p in enumerate(split(text, ChunkConfig(size=min(2 * size, 1200), overlap=min(2 * overlap, 120)))):
        children = split(p, ChunkConfig(size=size, overlap=overlap))
        out.append({"kind": "parent", "position": i + 1, "parent": None, "chunk": p})
        out += [{"kind": "child", "position": k + 1, "parent": i + 1, "chunk": c} for k, c in enumerate(children)]
    return out


def tables(text: str | None) -> list[list[list[str]]]:
    """Runs of two or more lines with tabs, pipes or double spaces as tables of cells, padded to equal width."""
    out, run = [], []
    for line in [*(text or "").split("\n"), ""]:
        if re.search(r"\t|\||\S {2,}\S", line):
            run.append([c.strip() for c in re.split(r"\t|\||\s{2,}", line.strip().strip("|"))])
        else:
            if len(run) >= 2:
                width = max(map(len, run))
                out.append([r + [""] * (width - len(r)) for r in run])
            run = []
    return out


def table_html(cells: list[list[str]]) -> str:
    """A table of cells as HTML, the first row as its head."""
    row = lambda cs, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cs) + "</tr>"
    return "<table>" + "".join(row(r, "td" if i else "th") for i, r in enumerate(cells)) + "</table>"


def table_rows(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, table (from 1), cells and html of every table in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, n + 1, t) for k, x in enumerate(b.column(1).to_pylist()) for n, t in enumerate(tables(x))]
            at = pa.array([k for k, _, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([n for _, n, _ in found], pa.int32()), pa.array([t for _, _, t in found], pa.list_(pa.list_(pa.string()))), pa.array([table_html(t) for _, _, t in found], pa.string())], names=[key, "table", "cells", "html"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, table int, cells array<array<string>>, html string")


def split_documents(docs: DataFrame, config: ChunkConfig, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, position (from 1) and chunk of every document; texts without chunks give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                chunks = [split(t, config) for t in part.column(1).to_pylist()]
                at = [k for k, c in enumerate(chunks) for _ in c]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array([n + 1 for c in chunks for n in range(len(c))], pa.int32()), pa.array([x for c in chunks for x in c], pa.string())], names=[key, "position", "chunk"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, position int, chunk string")


def split_hierarchy(docs: DataFrame, size: int, overlap: int, *, nested: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kind, position, parent, chunk of parents and children."""
    cut = hierarchical if nested else parent_child

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # chunks of few texts at a time, whatever the session's batches hold
            for i in range(0, len(b), HELD):
                part = b.slice(i, HELD)
                rows = [(k, c) for k, t in enumerate(part.column(1).to_pylist()) for c in cut(t, size, overlap)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([k for k, _ in rows], pa.int64())), *(pa.array([c[n] for _, c in rows], kind) for n, kind in (("kind", pa.string()), ("position", pa.int32()), ("parent", pa.int32()), ("chunk", pa.string())))], names=[key, "kind", "position", "parent", "chunk"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, kind string, position int, parent int, chunk string")


def chunk_statistics(chunks: DataFrame, *by: str, chunk: str = "chunk") -> DataFrame:
    """n, smallest, largest and mean length, all characters, mean tokens."""
    n = F.length(chunk)
    return chunks.groupBy(*by).agg(F.count("*").alias("n"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.avg(n).alias("mean_length"), F.sum(n).alias("characters"), F.avg(F.ceil(n / F.lit(4.0))).alias("mean_tokens"))


def with_overlap(chunks: DataFrame, share: float = 0.1, *, key: str = "doc_id", position: str = "position", chunk: str = "chunk") -> DataFrame:
    """Each chunk with the last ``share`` of the one before it in front."""
    before = F.lag(chunk).over(Window.partitionBy(key).orderBy(position))
    tail = F.right(before, F.floor(F.length(before) * share))
    return chunks.withColumn(chunk, F.when(before.isNull(), F.col(chunk)).otherwise(F.concat_ws(" ", F.when(F.length(tail) > 0, tail), F.col(chunk))))

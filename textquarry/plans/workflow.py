"""Workflows: graphs of named steps composed into one lazy DataFrame plan.

Steps are functions ``(df, config) -> df`` in a registry. A plan is checked (known
steps, no cycle, sources first) and composed in topological order; nothing runs
until an action does, so Catalyst sees the whole workflow at once.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from zoneinfo import available_timezones

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import records
from ..functions.splitters import ChunkConfig, split_documents
from ..operators import dedup, joins, mutations, predicates
from ..operators.lineage import cut
from ..sources import tables

Step = Callable[[DataFrame, dict], DataFrame]
STEPS: dict[str, Step] = {}
#: By step: what is wrong with a configuration.
CHECKS: dict[str, Callable[[dict], list[str]]] = {}


def step(name: str, check: Callable[[dict], list[str]] | None = None) -> Callable[[Step], Step]:
    """Register a step under a name, with a check of its configuration.

    Steps make new DataFrames and change nothing that is there, so there is nothing to roll back:
    a run that fails leaves its inputs as they were.
    """

    def put(f: Step) -> Step:
        STEPS[name] = f
        if check:
            CHECKS[name] = check
        return f

    return put


def described(name: str) -> dict:
    """Name, purpose and whether the configuration is checked."""
    return {"name": name, "purpose": (STEPS[name].__doc__ or "").strip().split("\n")[0], "checked": name in CHECKS}


def _missing(*names: str) -> Callable[[dict], list[str]]:
    return lambda config: [f"{n} is missing" for n in names if n not in config]


def _schedule_problems(config: dict) -> list[str]:
    out = ["a schedule has five fields"] if len(config.get("cron", "").split()) != 5 else []
    zone = config.get("timezone", "UTC")
    return out + ([f"unknown timezone {zone}"] if zone not in available_timezones() else [])


@step("rule_based_filter")
def _filter(df: DataFrame, config: dict) -> DataFrame:
    rules = tuple(predicates.FilterRule(**r) for r in config.get("rules", ()))
    return predicates.rule_filter(df, predicates.RuleFilter(**{**config, "rules": rules}))


@step("duplicate_segment")
def _duplicates(df: DataFrame, config: dict) -> DataFrame:
    content, position = config.get("content", "content"), config.get("position", "position")
    if config.get("method", "hash") == "hash":
        out = dedup.hash_duplicates(df, content, position)
    else:
        out = dedup.similarity_duplicates(df, content, position, config.get("threshold", 0.8))
    return out.where(~F.col("is_duplicate")).drop("is_duplicate")


@step("chunk")
def _chunk(df: DataFrame, config: dict) -> DataFrame:
    key, text = config.get("key", "doc_id"), config.get("text", "text")
    return split_documents(df, ChunkConfig(**{k: v for k, v in config.items() if k not in ("key", "text")}), key=key, text=text)


@step("field_mapping")
def _mapping(df: DataFrame, config: dict) -> DataFrame:
    return df.select(*[F.col(source).alias(target) for target, source in config["fields"].items()])


@step("condition")
def _condition(df: DataFrame, config: dict) -> DataFrame:
    return df.where(predicates.guarded(config["where"], df.columns))


@step("limit")
def _limit(df: DataFrame, config: dict) -> DataFrame:
    return df.orderBy(*config["order"]).limit(config["rows"])


@step("count_by")
def _count(df: DataFrame, config: dict) -> DataFrame:
    return df.groupBy(*config["by"]).agg(F.count("*").alias("n"))


@step("trigger_manual")
def _manual(df: DataFrame, config: dict) -> DataFrame:
    return df


@step("trigger_schedule", _schedule_problems)
def _schedule(df: DataFrame, config: dict) -> DataFrame:
    """Passes rows on; the schedule itself belongs to whoever starts the job."""
    if found := _schedule_problems(config):
        raise ValueError("; ".join(found))
    return df


@step("mock")
def _mock(df: DataFrame, config: dict) -> DataFrame:
    return tables.with_mock(df, config.get("count", 5), config.get("fields"), config.get("seed", 12345))


@step("post_upserter", _missing("table", "hash_fields"))
def _upsert(df: DataFrame, config: dict) -> DataFrame:
    """The table in ``config['table']`` after the input's rows; rows without a title are passed over."""
    title = config.get("title", "title")
    good = df.where(F.length(F.trim(F.coalesce(F.col(title), F.lit("")))) > 0)
    hashed = good.withColumn("hash", records.record_hash([F.col(c) for c in config["hash_fields"]], config.get("prefix", "")))
    return mutations.upsert(config["table"], hashed, "hash", config.get("order", "position"))


@step("post_deleter", _missing("table"))
def _delete(df: DataFrame, config: dict) -> DataFrame:
    """The table in ``config['table']`` without the ids at a path of the input."""
    key = config.get("key", "id")
    return mutations.delete(config["table"], mutations.ids_at(df, config.get("path", "id"), key), key)


@dataclass(frozen=True)
class Node:
    id: str
    step: str
    config: dict = field(default_factory=dict)
    enabled: bool = True


@dataclass
class Workflow:
    """Nodes and edges (from, to). Nodes without predecessor read the sources given by their id, or the root input."""

    nodes: list[Node]
    edges: list[tuple[str, str]] = field(default_factory=list)

    def problems(self) -> list[str]:
        ids = [n.id for n in self.nodes]
        out = [f"unknown step {n.step}" for n in self.nodes if n.step not in STEPS]
        out += [f"{n.id}: {p}" for n in self.nodes if n.enabled and n.step in CHECKS for p in CHECKS[n.step](n.config)]
        out += [f"edge to unknown node {x}" for e in self.edges for x in e if x not in ids]
        if len(set(ids)) < len(ids):
            out.append("node ids repeat")
        if not out and len(self.order()) < len(self.nodes):
            out.append("the graph has a cycle")
        return out

    def order(self) -> list[Node]:
        left = {n.id: {a for a, b in self.edges if b == n.id} for n in self.nodes}
        by, out = {n.id: n for n in self.nodes}, []
        while ready := [i for i, before in left.items() if not before]:
            for i in ready:
                out.append(by[i])
                del left[i]
            for before in left.values():
                before.difference_update(ready)
        return out

    def compose(self, sources: dict[str, DataFrame], root: DataFrame | None = None) -> dict[str, DataFrame]:
        """A lazy DataFrame for each node; disabled nodes hand on their input. Several inputs are united by name."""
        if found := self.problems():
            raise ValueError("; ".join(found))
        made: dict[str, DataFrame] = {}
        for n in self.order():
            before = [made[a] for a, b in self.edges if b == n.id]
            if n.id in sources:
                before.append(sources[n.id])
            if not before and root is not None:
                before.append(root)
            if not before:
                raise ValueError(f"node {n.id} has no input")
            df = joins.merged_inputs(before)
            made[n.id] = STEPS[n.step](df, n.config) if n.enabled else df
        return made

    def result(self, sources: dict[str, DataFrame], root: DataFrame | None = None) -> DataFrame:
        """The last node that nothing follows."""
        made = self.compose(sources, root)
        ends = [n.id for n in self.order() if n.id not in {a for a, _ in self.edges}]
        return made[ends[-1]]

    def run(self, sources: dict[str, DataFrame], root: DataFrame | None = None, *, stop_on_error: bool = True, sample: int = 10) -> list[dict]:
        """Run node by node for inspection: status, rows, seconds and a sample of each."""
        try:
            self.compose(sources, root)
        except Exception as e:  # a plan that can't be made is reported like a failed run
            if stop_on_error:
                raise
            return [{"node": None, "status": "failed", "error": str(e)}]
        out, done = [], {}
        for n in self.order():
            began = time.time()
            seen = Observation(f"node-{n.id}")
            try:
                # each node runs once: its rows are counted as they are written, and its followers read what was written
                before = [done[a] for a, b in self.edges if b == n.id] + ([sources[n.id]] if n.id in sources else [])
                df = joins.merged_inputs(before or [root])
                df = STEPS[n.step](df, n.config) if n.enabled else df
                done[n.id] = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")))
                out.append({"node": n.id, "status": "completed", "rows": seen.get["rows"], "seconds": time.time() - began, "sample": [r.asDict(True) for r in done[n.id].limit(sample).collect()]})
            except Exception as e:
                out.append({"node": n.id, "status": "failed", "error": str(e), "seconds": time.time() - began})
                if stop_on_error:
                    break
        return out


def chain(*steps: tuple[str, dict]) -> Workflow:
    """A linear workflow."""
    nodes = [Node(f"s{i}", name, config) for i, (name, config) in enumerate(steps)]
    return Workflow(nodes, [(a.id, b.id) for a, b in zip(nodes, nodes[1:], strict=False)])

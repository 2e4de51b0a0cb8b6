"""An HTTP API as a Spark data source: one request a time chunk, with retries.

    spark.dataSource.register(HttpSource)
    spark.read.format("http_chunks").options(url=..., start="2024-01-01", end="2024-01-02", minutes=60).load()

Each chunk is one partition, so requests run on the executors and a lost one is asked
again. A chunk is POSTed as ``{"from", "to", "query"}``; its reply is JSON with
``data`` (items) and ``total``. Failed and empty chunks are passed over, as is told by ``failed``.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "chunk int, chunk_from string, chunk_to string, total long, item string, failed boolean"


def retrying(do: Callable[[], object], attempts: int = 3, wait: Callable[[int], float] = lambda n: float(n), sleep: Callable[[float], None] = time.sleep):
    """The result of ``do``, tried up to ``attempts`` times; before try n + 1 it waits ``wait(n)`` seconds (default n; ``lambda n: 2.0**n`` doubles)."""
    for n in range(1, attempts + 1):
        try:
            return do()
        except Exception:
            if n == attempts:
                raise
            sleep(wait(n))
    raise ValueError("attempts must be at least 1")


def chunks(start: datetime, end: datetime, minutes: int) -> list[tuple[datetime, datetime]]:
    """Times from the first day's start to the last day's end in pieces of ``minutes``."""
    if minutes < 1:
        raise ValueError("minutes must be at least 1")
    at, last, out = start.replace(hour=0, minute=0, second=0, microsecond=0), end.replace(hour=23, minute=59, second=59, microsecond=999_000), []
    while at <= last:
        out.append((at, min(at + timedelta(minutes=minutes), last)))
        at += timedelta(minutes=minutes)
    return out


class Chunk(InputPartition):
    def __init__(self, number: int, start: str, end: str):
        self.number, self.start, self.end = number, start, end


class HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url = options["url"]
        self.query = options.get("query", "")
        self.attempts, self.wait, self.timeout = int(options.get("attempts", "3")), float(options.get("wait", "1")), float(options.get("timeout", "30"))
        minutes = int(options.get("minutes", "60" if "start" in options else "30"))
        if "start" in options:
            found = chunks(datetime.fromisoformat(options["start"]), datetime.fromisoformat(options.get("end", options["start"])), minutes)
        else:
            # the last minutes before now
            now = datetime.fromisoformat(options["now"]) if "now" in options else datetime.now()
            found = [(now - timedelta(minutes=minutes), now)]
        if options.get("test", "").lower() == "true":
            found = found[:1]
        self.chunks = [Chunk(i, a.isoformat(), b.isoformat()) for i, (a, b) in enumerate(found)]

    def partitions(self) -> list[InputPartition]:
        return self.chunks

    def read(self, partition: Chunk) -> Iterator[tuple]:
        body = json.dumps({"from": partition.start, "to": partition.end, "query": self.query}).encode()

        def ask() -> dict:
            request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                return json.load(reply)

        head = (partition.number, partition.start, partition.end)
        try:
            got = retrying(ask, self.attempts, lambda n: self.wait * n)
        except (urllib.error.URLError, OSError, ValueError):
            yield (*head, 0, None, True)
            return
        items = got if isinstance(got, list) else got.get("data") or []
        total = len(items) if isinstance(got, list) else int(got.get("total") or len(items))
        for item in items:
            yield (*head, total, item if isinstance(item, str) else json.dumps(item), False)


class HttpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HttpReader:
        return HttpReader(dict(self.options))

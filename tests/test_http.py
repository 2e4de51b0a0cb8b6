"""The HTTP source against a server on this machine."""

import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from textquarry.sources import http


@pytest.fixture
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body["from"])
            hour = datetime.fromisoformat(body["from"]).hour
            # one chunk fails for good, one at first, one is empty
            bad = hour == 3 or (hour == 4 and asked.count(body["from"]) == 1)
            reply = json.dumps({"data": [] if hour == 5 else [{"at": body["from"], "q": body["query"]}], "total": 7}).encode()
            self.send_response(500 if bad else 200)
            self.end_headers()
            self.wfile.write(b"" if bad else reply)

        def log_message(self, *_):
            pass

    httpd = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}/"
    httpd.shutdown()


def test_chunks_are_read_and_failed_ones_told(spark, server):
    spark.dataSource.register(http.HttpSource)
    df = spark.read.format("http_chunks").options(url=server, start="2024-01-01T10:00:00", end="2024-01-01T10:00:00", minutes=60, query="x", attempts=2, wait=0).load()
    got = df.collect()
    assert sum(r["failed"] for r in got) == 1 and len({r["chunk"] for r in got}) == 23
    good = [r for r in got if not r["failed"]]
    assert len(good) == 22 and all(json.loads(r["item"])["q"] == "x" and r["total"] == 7 for r in good)
    assert min(r["chunk_from"] for r in got) == "2024-01-01T00:00:00"
    one = spark.read.format("http_chunks").options(url=server, start="2024-01-01", test="true").load()
    assert one.select(F.countDistinct("chunk")).first()[0] == 1
    last = spark.read.format("http_chunks").options(url=server, now="2024-01-02T09:30:00").load().first()
    assert (last["chunk_from"], last["chunk_to"]) == ("2024-01-02T09:00:00", "2024-01-02T09:30:00")


def test_waits_grow():
    waited, tries = [], []

    def fails():
        tries.append(1)
        if len(tries) < 4:
            raise OSError
        return "ok"

    assert http.retrying(fails, 4, lambda n: 2.0**n, waited.append) == "ok" and waited == [2.0, 4.0, 8.0]
    with pytest.raises(OSError):
        http.retrying(lambda: (_ for _ in ()).throw(OSError()), 2, lambda n: float(n), waited.append)
    assert len(http.chunks(datetime(2024, 1, 1, 5), datetime(2024, 1, 2), 60)) == 48

"""The store over HTTP: /v1/query, /v1/fields, /v1/histogram, /healthz.

    GET /v1/query?expr=&start=&end=&limit=&direction=asc|desc&follow=true   JSON lines
    GET /v1/fields                                                         one JSON object
    GET /v1/histogram?expr=&start=&end=&buckets=                            one JSON object
"""

from __future__ import annotations

import json
import queue
import threading
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .functions.times import format_time, parse_time
from .operators import search
from .plans.language import parse
from .sources.store import LogStore, as_json, histogram_json, ndjson


def _integer(text: str, default: int) -> int:
    try:
        return int(text)
    except ValueError:
        return default


class Api(BaseHTTPRequestHandler):
    store: LogStore
    follow_dir: str

    def log_message(self, *_):
        pass

    def _answer(self, code: int, body: str, kind: str = "application/json") -> None:
        data = body.encode()
        self.send_response(code)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):  # noqa: N802
        url = urlsplit(self.path)
        ask = {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
        route = {"/healthz": self._health, "/v1/query": self._query, "/v1/fields": self._fields, "/v1/histogram": self._histogram}.get(url.path)
        if route is None:
            return self._answer(404, "not found\n", "text/plain")
        try:
            parse(ask.get("expr", ""))
            for k in ("start", "end"):
                parse_time(ask.get(k, ""))
        except ValueError as e:
            return self._answer(400, f"{e}\n", "text/plain")
        return route(ask)

    def _health(self, _ask):
        self._answer(200, "ok", "text/plain")

    def _query(self, ask):
        if ask.get("follow") in ("true", "1"):
            return self._follow(ask)
        found = self.store.query(ask.get("expr", ""), ask.get("start"), ask.get("end"), _integer(ask.get("limit", ""), 0), ask.get("direction") == "desc")
        self.send_response(200)
        self.send_header("Content-Type", "application/x-ndjson")
        self.end_headers()
        for line in ndjson(found):
            self.wfile.write(line.encode() + b"\n")
        return None

    def _follow(self, ask):
        """What is stored, in time order, then what is added, until the client leaves."""
        lines: queue.Queue = queue.Queue(4096)
        gone = threading.Event()

        def send(batch, _number):
            for row in as_json(batch.orderBy(*search.order_key(batch))).toLocalIterator():
                while not gone.is_set():
                    try:
                        lines.put(row["line"], timeout=1)
                        break
                    except queue.Full:
                        continue

        live = self.store.follow(ask.get("expr", ""), ask.get("start"))
        run = live.writeStream.foreachBatch(send).option("checkpointLocation", f"{self.follow_dir}/{uuid.uuid4().hex}").trigger(processingTime="1 second").start()
        self.send_response(200)
        self.send_header("Content-Type", "application/x-ndjson")
        self.end_headers()
        try:
            while run.isActive:
                try:
                    self.wfile.write(lines.get(timeout=1).encode() + b"\n")
                except queue.Empty:
                    pass
                self.wfile.flush()
        except OSError:
            pass
        finally:
            gone.set()
            run.stop()

    def _fields(self, _ask):
        self._answer(200, json.dumps(self.store.fields().first().asDict()))

    def _histogram(self, ask):
        end = parse_time(ask.get("end", ""))
        end = time.time_ns() if end is None else end
        start = parse_time(ask.get("start", ""))
        start = end - search.DEFAULT_SPAN if start is None else start
        buckets = _integer(ask.get("buckets", ""), search.DEFAULT_BUCKETS)
        buckets = buckets if buckets > 0 else search.DEFAULT_BUCKETS
        counts = self.store.histogram(ask.get("expr", ""), format_time(start), format_time(end), buckets)
        width = (end - start if end > start else 1_000_000_000) // buckets or 1_000_000
        self._answer(200, histogram_json(counts, format_time(start), format_time(end), width))


def serve(store: LogStore, follow_dir: str, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server in the background; its address is server_address, shutdown() ends it. follow_dir holds the checkpoints of live queries."""
    server = ThreadingHTTPServer((host, port), type("BoundApi", (Api,), {"store": store, "follow_dir": follow_dir.rstrip("/")}))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server

"""HTTP endpoint of the SQL gate: POST /api/query, GET /healthz and /readyz."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from spindrift.operators.catalog import Catalog

from .session import Internal, Limits, QueryError, Unavailable, query

BODY_LIMIT = 1 << 20
ARROW = "application/vnd.apache.arrow.stream"


def _request(body: bytes) -> tuple[int, str, str | None]:
    try:
        got = json.loads(body)
    except ValueError:
        raise QueryError("the body is not JSON") from None
    if not isinstance(got, dict) or isinstance(got.get("namespace_id"), bool) or not isinstance(got.get("namespace_id"), int) or not isinstance(got.get("sql"), str):
        raise QueryError("the body needs a whole number namespace_id and a text sql")
    form = got.get("format")
    if form is not None and not isinstance(form, str):
        raise QueryError("format is a text")
    return got["namespace_id"], got["sql"], form


class Server(ThreadingHTTPServer):
    """Serves one catalog's namespaces until `shutdown`; port 0 takes a free one."""

    daemon_threads = True

    def __init__(self, spark: SparkSession, catalog: Catalog, host: str = "127.0.0.1", port: int = 0, limits: Limits = Limits()):
        super().__init__((host, port), _Handler)
        self.spark, self.catalog, self.limits = spark, catalog, limits

    def start(self) -> str:
        threading.Thread(target=self.serve_forever, daemon=True).start()
        return f"http://{self.server_address[0]}:{self.server_address[1]}"

    def ready(self) -> bool:
        """Whether the catalog answers and the session runs."""
        try:
            self.catalog.hypertables()
            return not self.spark.sparkContext._jsc.sc().isStopped()
        except Exception:
            return False


class _Handler(BaseHTTPRequestHandler):
    server: Server

    def log_message(self, *_) -> None:
        pass

    def _send(self, status: int, body: bytes, kind: str = "application/json", retry: bool = False) -> None:
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(body)))
        if retry:
            self.send_header("Retry-After", "1")
        self.end_headers()
        self.wfile.write(body)

    def _fail(self, status: int, error: str, retryable: bool = False) -> None:
        self._send(status, json.dumps({"error": error, "retryable": retryable}).encode(), retry=retryable)

    def do_GET(self) -> None:
        if self.path == "/healthz":
            self._send(200, b'{"status": "ok"}')
        elif self.path == "/readyz":
            self._send(200, b'{"status": "ready"}') if self.server.ready() else self._fail(503, "not ready", True)
        else:
            self._fail(404, "no such path")

    def do_POST(self) -> None:
        if self.path != "/api/query":
            self._fail(404, "no such path")
            return
        length = self.headers.get("Content-Length") or ""
        if not length.isdigit() or int(length) > BODY_LIMIT:
            self.close_connection = True
            self._fail(413 if length.isdigit() else 411, f"a body of at most {BODY_LIMIT} bytes with its length is needed")
            return
        body = self.rfile.read(int(length))
        try:
            namespace, sql, form = _request(body)
            out = query(self.server.spark, self.server.catalog, namespace, sql, form, self.headers.get("Accept"), self.server.limits)
            if "arrow" in out:
                self._send(200, out["arrow"], ARROW)
            else:
                self._send(200, json.dumps(out, default=str).encode())
        except (Unavailable, Internal) as e:
            self._fail(e.status, "unavailable" if isinstance(e, Unavailable) else "internal error", e.retryable)
        except QueryError as e:
            self._fail(e.status, str(e), e.retryable)

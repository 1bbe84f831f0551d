"""A local HTTP service around the analysis."""

from __future__ import annotations

import json
import os
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .functions.shared import discard
from .plans import report
from .plans.analyze import analyze

LAUNCHER = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Permission analysis</title></head><body><h1>Permission analysis</h1>
<form id="f"><input id="p" size="60" placeholder="project folder"><label><input type="checkbox" id="t"> tests</label><button>Analyse</button></form><pre id="o"></pre><script>
document.getElementById("f").onsubmit=async e=>{e.preventDefault();const o=document.getElementById("o");o.textContent="...";
const r=await fetch("/api/analyze",{method:"POST",body:JSON.stringify({path:document.getElementById("p").value,includeTests:document.getElementById("t").checked})});
const j=await r.json();if(r.ok)location.href=j.reportUrl;else o.textContent=j.error}</script></body></html>"""


def request_of(body: bytes | str) -> tuple[str, bool, str | None]:
    """Path, whether tests count, and what is wrong, of a request's body; unknown keys are ignored."""
    try:
        asked = json.loads(body)
    except ValueError:
        return "", False, "The body is not JSON"
    if not isinstance(asked, dict):
        return "", False, "The body is not a JSON object"
    path = asked.get("path")
    if not isinstance(path, str) or not path.strip():
        return "", False, "No project path was given"
    return path, asked.get("includeTests") is True, None


class Service:
    """Answers of the service, apart from HTTP: (status, content type, body)."""

    JSON, HTML = "application/json; charset=utf-8", "text/html; charset=utf-8"

    def __init__(self, spark, port: int = 0):
        self.spark, self.port, self.store, self.picking = spark, port, report.Store(), threading.Lock()

    def _json(self, code: int, /, **body):
        return code, self.JSON, json.dumps(body)

    def answer(self, method: str, path: str, body: bytes = b"") -> tuple[int, str, str]:
        path = path.partition("?")[0]
        try:
            if path in ("/", "/index.html"):
                return 200, self.HTML, LAUNCHER
            if path == "/api/health":
                return self._json(200, status="ok", port=self.port, reports=len(self.store.pages))
            if path == "/api/pick-folder":
                return self.pick(method)
            if path == "/api/analyze":
                return self.analyze(method, body)
            if path.startswith("/report/"):
                page = self.store.get(path.removeprefix("/report/"))
                return (200, self.HTML, page) if page else (404, self.HTML, "<!DOCTYPE html><title>Not found</title><p>No such report.</p>")
            return self._json(404, error="Not found")
        except Exception as wrong:
            return self._json(500, error=str(wrong) or type(wrong).__name__)

    def pick(self, method: str):
        """A service without a desktop has no dialog; callers send the path instead."""
        if method != "POST":
            return self._json(405, error="Method not allowed")
        if not self.picking.acquire(blocking=False):
            return self._json(409, error="A folder dialog is already open")
        try:
            return self._json(500, error="No desktop is available; send the path instead")
        finally:
            self.picking.release()

    def analyze(self, method: str, body: bytes):
        if method != "POST":
            return self._json(405, error="Method not allowed")
        path, include_tests, wrong = request_of(body)
        if wrong:
            return self._json(400, error=wrong)
        if not os.path.isdir(path):
            return self._json(400, error=f"Project path not found: {path}")
        try:
            found = report.document(analyze(self.spark, path, include_tests))
        except Exception as wrong:
            return self._json(400, error=f"Analysis failed: {wrong}")
        finally:
            discard(self.spark)
        key = uuid.uuid4().hex[:12]
        self.store.put(key, report.html_page(found))
        return self._json(200, **report.payload(found, key))


def start(spark, port: int) -> ThreadingHTTPServer:
    """A server on 127.0.0.1, on a free port if ``port`` is taken."""
    service = Service(spark)

    class Handler(BaseHTTPRequestHandler):
        def reply(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, kind, text = service.answer(self.command, self.path, self.rfile.read(size))
            raw = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_PUT = do_DELETE = reply

        def log_message(self, *_args) -> None:
            pass

    try:
        server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
    except OSError:
        server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    service.port = server.server_address[1]
    return server


def serve(spark, port: int) -> int:
    server = start(spark, port)
    print(f"Launcher : http://127.0.0.1:{server.server_address[1]}/", flush=True)
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        server.shutdown()
    return 0

"""The REST interface, on the standard library's server."""

from __future__ import annotations

import dataclasses
import json
import typing
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from .config import ViewConfig, view_from
from .errors import ViewError
from .functions.buckets import GRANULARITIES
from .plans.viewdef import parse_view
from .service import Service

PAGE = """<!doctype html><meta charset=utf-8><title>Views</title><h1>Views</h1><pre id=v></pre>
<script>setInterval(async()=>{v.textContent=JSON.stringify(await(await fetch('/api/views')).json(),null,1)},2000)</script>"""


def form_schema() -> list[dict]:
    """Fields of a view for a form."""
    hints = typing.get_type_hints(ViewConfig)
    out = []
    for f in dataclasses.fields(ViewConfig):
        default = None if f.default is dataclasses.MISSING else f.default
        kind = next((k for t, k in ((bool, "boolean"), (int, "integer")) if t in (hints[f.name], *typing.get_args(hints[f.name]))), "string")
        out.append({"name": f.name, "type": kind, "required": f.default is dataclasses.MISSING and f.name != "name", "default": default, "options": ["", *GRANULARITIES[2:]] if f.name == "full_refresh_chunk" else None})
    return out


def derived(service: Service, query: str) -> dict:
    p = parse_view(service.spark, query)
    return {"source_table": p.source_table, "filter_column": p.filter_column, "granularity": p.granularity, "merge_keys": list(p.merge_keys), "bucket_alias": p.bucket_alias}


def response(service: Service, v: ViewConfig) -> dict:
    return dataclasses.asdict(v) | derived(service, v.query) | {"status": dataclasses.asdict(service.status[v.name])}


def handle(service: Service, method: str, path: str, body: dict | None) -> tuple[int, object]:
    """(status code, JSON value, or text)."""
    parts = [unquote(p) for p in path.split("?")[0].strip("/").split("/")]
    try:
        match method, parts:
            case "GET", [""]:
                return 200, PAGE
            case "GET", ["health"]:
                return 200, {"status": "ok", "views": len(service.views)}
            case "GET", ["metrics"]:
                return 200, service.metrics.text()
            case "GET", ["api", "views", "schema"]:
                return 200, form_schema()
            case "GET", ["api", "views"]:
                return 200, [response(service, v) for v in list(service.views.values())]
            case "POST", ["api", "views", "parse"]:
                return 200, derived(service, (body or {}).get("query", ""))
            case "POST", ["api", "views"]:
                view = view_from(body or {})
                if not service.views_path:
                    return 500, {"detail": "no views file is configured"}
                try:
                    service.create(view)
                except KeyError as e:
                    return 409, {"detail": str(e.args[0])}
                return 201, response(service, view)
            case "PUT", ["api", "views", name]:
                if name not in service.views:
                    return 404, {"detail": f"no view {name}"}
                view = view_from({"name": name} | (body or {}))
                service.update(name, view)
                return 200, response(service, view)
            case "DELETE", ["api", "views", name]:
                if name not in service.views:
                    return 404, {"detail": f"no view {name}"}
                service.delete(name)
                return 204, None
            case "POST", ["api", "views", name, "refresh"]:
                if name not in service.views:
                    return 404, {"detail": f"no view {name}"}
                try:
                    status = service.trigger(name)
                except TimeoutError:
                    return 504, {"detail": f"the refresh of {name} has not ended yet"}
                return (410, {"detail": f"view {name} was deleted"}) if status is None else (200, dataclasses.asdict(status))
    except (ViewError, TypeError) as e:
        return 422, {"detail": str(e)}
    return 404, {"detail": "not found"}


def server(service: Service, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size)) if size else None
                code, value = handle(service, self.command, self.path, body)
            except json.JSONDecodeError as e:
                code, value = 422, {"detail": str(e)}
            text = isinstance(value, str)
            data = b"" if value is None else (value if text else json.dumps(value, default=str)).encode()
            self.send_response(code)
            kind = "application/json" if not text else "text/html; charset=utf-8" if value.startswith("<") else "text/plain; version=0.0.4"
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = _answer  # noqa: N815

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("", port), Handler)

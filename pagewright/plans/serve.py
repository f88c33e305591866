"""Envelopes for callers, and a line-wise JSON-RPC server with two tools."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pagewright.errors import EngineError, invalid
from pagewright.plans import dsl, spec

#: What usually follows a command.
NEXT = {
    "init": ["add", "ingest"],
    "add": ["search", "read", "enrich"],
    "ingest": ["search", "list", "doctor"],
    "search": ["explain", "read"],
    "list": ["read"],
    "read": ["enrich"],
    "remove": ["list"],
    "reindex": ["doctor"],
}


def envelope(command: str, act: Callable[[], Any]) -> tuple[dict, int]:
    """The command's result or error as an envelope, and the exit code."""
    try:
        return {"ok": True, "command": command, "result": act(), "next_actions": NEXT.get(command, [])}, 0
    except EngineError as e:
        return {"ok": False, "command": command, "error": {"code": e.code, "message": e.message}, "next_actions": ["doctor"]}, e.exit_code


def progress(report: dict, paths: list[str]) -> Iterator[str]:
    """The events of an ingestion, one JSON line each."""
    failed = {f["path"]: f for f in report["failures"]}
    yield json.dumps({"event": "start", "files": len(paths)})
    for p in paths:
        yield json.dumps({"event": "failed", **failed[p]} if p in failed else {"event": "indexed", "path": p})
    yield json.dumps({"event": "complete", **{k: report[k] for k in ("added", "ready", "failed")}})


TOOLS = {
    "search": {"query": "string", "limit": "integer"},
    "execute": {"program": "array", "limits": "object"},
}


def _arguments(tool: str, given: Any) -> dict:
    given = {} if given is None else given
    if not isinstance(given, dict) or set(given) - set(TOOLS[tool]):
        raise invalid(f"{tool}: unknown arguments")
    return given


def handle(request: dict, operations: dict[str, Callable[[dict], Any]]) -> dict | None:
    """The reply to one request; None for a notification."""
    if "id" not in request:
        return None
    reply: dict[str, Any] = {"jsonrpc": "2.0", "id": request["id"]}
    method, params = request.get("method"), request.get("params") or {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "pagewright", "version": "1"}}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in a.items()}, "additionalProperties": False}} for n, a in TOOLS.items()]}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": f"unknown method: {method}"}}
    name = params.get("name")
    if name not in TOOLS:
        return reply | {"error": {"code": -32602, "message": f"unknown tool: {name}"}}
    try:
        args = _arguments(name, params.get("arguments"))
        value = spec.search(args.get("query", ""), args.get("limit", 10)) if name == "search" else dsl.execute(args.get("program"), operations, args.get("limits"))
        return reply | {"result": {"content": [{"type": "text", "text": json.dumps(value, default=str)}]}}
    except EngineError as e:
        if e.code == "E_INVALID_INPUT":
            return reply | {"error": {"code": -32602, "message": e.message, "data": {"code": e.code}}}
        return reply | {"result": {"isError": True, "content": [{"type": "text", "text": json.dumps({"code": e.code, "message": e.message})}]}}


def serve(lines: Iterable[str], operations: dict[str, Callable[[dict], Any]]) -> Iterator[str]:
    """Replies to requests, one line each."""
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
        except ValueError:
            yield json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "malformed request"}})
            continue
        reply = handle(request, operations)
        if reply is not None:
            yield json.dumps(reply, default=str)

"""The engine as tools over standard input and output, by the public Model Context Protocol:
one JSON-RPC message a line."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

from tessera.engine import Engine
from tessera.operators.graph import GraphNotBuilt

PROTOCOL = "2024-11-05"
_TEXT, _INT, _FLAG, _LIST = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}, {"type": "array", "items": {"type": "string"}}


def search_text(rows: list[dict], truncated: bool, metadata_only: bool) -> str:
    """Results as text: score, place and language with the content under them, or a line of place,
    name and kind each if only the metadata is wanted."""
    out = []
    for r in rows:
        stale = "  (stale: read the file to confirm)" if r.get("stale") else ""
        if metadata_only:
            out.append(f"{r['file_path']}:{r['start_line']}  {r['name'] or '':<20} {r['node_kind']}{stale}\n")
        else:
            out.append(f"{r['score']:.4f} {r['file_path']}:{r['start_line']}-{r['end_line']} [{r['language'] or ''}]{stale}\n{r.get('content') or ''}\n---\n")
    return "".join(out) + ("(truncated to token budget)\n" if truncated else "")


def _search(engine: Engine, a: dict) -> str:
    meta = bool(a.get("metadata_only"))
    rows, cut = engine.search(
        a.get("query", ""), freshness=True, refresh_index=bool(a.get("refresh_index")), limit=a.get("limit", 10), offset=a.get("offset", 0), max_tokens=a.get("max_tokens", 0), package=a.get("package", ""),
        metadata_only=meta, languages=tuple(a.get("languages", ())), paths=tuple(a.get("paths", ())), names=(a["name"],) if a.get("name") else (), node_kinds=tuple(a.get("node_kinds", ())),
    )
    return search_text(rows, cut, True) if meta else json.dumps({"results": rows, "truncated": cut})


def _map(engine: Engine, a: dict) -> str:
    text = engine.map(a.get("max_tokens"), a.get("code_only", True), a.get("show_summary", True), a.get("show_visibility", True))
    return text or "No symbols indexed yet. Run indexing first."


TOOLS: dict[str, tuple[str, dict, list[str], Callable[[Engine, dict], str]]] = {
    "search": ("Hybrid search of the indexed code", {"query": _TEXT, "limit": _INT, "offset": _INT, "languages": _LIST, "paths": _LIST, "package": _TEXT, "name": _TEXT, "node_kinds": _LIST, "max_tokens": _INT, "metadata_only": _FLAG, "refresh_index": _FLAG}, ["query"], _search),
    "get_map": ("A structural map of the project", {"max_tokens": _INT, "code_only": _FLAG, "show_summary": _FLAG, "show_visibility": _FLAG}, [], _map),
    "get_callers": ("What refers to a symbol", {"symbol": _TEXT, "limit": _INT}, ["symbol"], lambda e, a: e.callers(a.get("symbol", ""), a.get("limit", 0)).text),
    "get_callees": ("What a symbol refers to", {"symbol": _TEXT, "limit": _INT}, ["symbol"], lambda e, a: e.callees(a.get("symbol", ""), a.get("limit", 0)).text),
    "get_impact": ("What a change of a symbol reaches", {"symbol": _TEXT, "depth": _INT, "limit": _INT}, ["symbol"], lambda e, a: e.impact(a.get("symbol", ""), a.get("depth", 0), a.get("limit", 0)).text),
}


def tools(engine: Engine) -> list[str]:
    """Names of the tools there are; those of the graph only where it is built."""
    return [n for n in TOOLS if engine.config.graph or n in ("search", "get_map")]


def answer(engine: Engine, message: dict) -> dict | None:
    """The answer to one message, or None to a notification."""
    if "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "tessera", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        listed = [{"name": n, "description": TOOLS[n][0], "inputSchema": {"type": "object", "properties": TOOLS[n][1], "required": TOOLS[n][2]}, "annotations": {"readOnlyHint": True}} for n in tools(engine)]
        return reply | {"result": {"tools": listed}}
    if method == "tools/call":
        name = params.get("name")
        if name not in tools(engine):
            return reply | {"error": {"code": -32602, "message": f"unknown tool {name!r}"}}
        try:
            text, bad = TOOLS[name][3](engine, params.get("arguments") or {}), False
        except (ValueError, GraphNotBuilt) as e:
            text, bad = str(e), True
        return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": bad}}
    return reply | {"error": {"code": -32601, "message": f"unknown method {method!r}"}}


def serve(engine: Engine, lines=sys.stdin, out=sys.stdout) -> None:
    """Answer messages until the input ends."""
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            got = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        else:
            got = answer(engine, message)
        if got is not None:
            print(json.dumps(got), file=out, flush=True)

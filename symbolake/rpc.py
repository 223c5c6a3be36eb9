"""The tools over standard input and output: JSON-RPC, one message a line."""

from __future__ import annotations

import json
from typing import TextIO

from symbolake import render
from symbolake.session import Session

#: Tools with their parameters; those without default are required.
TOOLS: dict[str, dict] = {
    "search": {"query": None, "limit": 12}, "repos": {}, "suggest": {"about": "", "limit": 40}, "find": {"query": None, "limit": 20}, "zoom": {"focus": None},
    "ripple": {"focus": None, "depth": 4}, "guide": {"repo": ""}, "thread": {"focus": None, "depth": 4}, "flow": {"focus": None, "depth": 4}, "context_pack": {"focus": None, "token_budget": 1500},
}


def call(session: Session, tool: str, arguments: dict) -> dict:
    """A tool's reply: markdown text and the structured result."""
    params = TOOLS[tool]
    given = {k: v for k, v in arguments.items() if k in params and v not in (None, "")}
    lacking = [k for k, v in params.items() if v is None and k not in given]
    if lacking:
        raise ValueError(f"{tool} needs {', '.join(lacking)}")
    result = getattr(session, tool)(**given)
    return {"content": [{"type": "text", "text": getattr(render, tool)(result)}], "structuredContent": result}


def schema(tool: str) -> dict:
    kinds = {k: {"type": "integer" if isinstance(v, int) else "string"} for k, v in TOOLS[tool].items()}
    return {"name": tool, "inputSchema": {"type": "object", "properties": kinds, "required": [k for k, v in TOOLS[tool].items() if v is None]}}


def answer(session: Session, message: dict) -> dict | None:
    """The reply to one message; None to a notification."""
    i, method, params = message.get("id"), message.get("method"), message.get("params") or {}
    if i is None:
        return None
    try:
        if method == "initialize":
            result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "symbolake", "version": "0.1.0"}}
        elif method == "tools/list":
            result = {"tools": [schema(t) for t in TOOLS]}
        elif method == "tools/call" and params.get("name") in TOOLS:
            result = call(session, params["name"], params.get("arguments") or {})
        elif method == "ping":
            result = {}
        else:
            return {"jsonrpc": "2.0", "id": i, "error": {"code": -32601, "message": f"unknown: {params.get('name') or method}"}}
        return {"jsonrpc": "2.0", "id": i, "result": result}
    except (ValueError, TypeError) as e:
        return {"jsonrpc": "2.0", "id": i, "error": {"code": -32602, "message": str(e)}}


def serve(session: Session, source: TextIO, sink: TextIO) -> None:
    for line in source:
        if not line.strip():
            continue
        try:
            reply = answer(session, json.loads(line))
        except json.JSONDecodeError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            sink.write(json.dumps(reply, default=str) + "\n")
            sink.flush()

"""The three tools as a JSON-RPC server on lines of stdio."""

from __future__ import annotations

import json
from typing import TextIO

from glyphmill import __version__
from glyphmill.schema import MATCH_TYPES
from glyphmill.service import Service, to_json

PROTOCOL = "2024-11-05"


def _text(what: str) -> dict:
    return {"type": "string", "description": what}


def _object(required: list[str] | None = None, **properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": list(properties) if required is None else required}


def _list(items: dict) -> dict:
    return {"type": "array", "items": items}


_STRING, _COUNT, _MAYBE = {"type": "string"}, {"type": "integer", "minimum": 0}, {"type": ["string", "null"]}
_PATH = _text("The repository's folder, or any path in it.")
_RESULT = _object(kind=_STRING, name=_STRING, path=_STRING, line=_COUNT, signature=_STRING, doc=_MAYBE, snippet=_STRING, score={"type": "number"}, match_type={"type": "string", "enum": list(MATCH_TYPES)})
_SYMBOL = _object(name=_STRING, kind=_STRING, signature=_STRING, doc=_MAYBE, file=_STRING, line=_COUNT)
_MODULE = _object(name=_STRING, path=_STRING, files=_list(_STRING), symbols=_list(_SYMBOL), depends_on=_list(_STRING))
_STATS = _object(**dict.fromkeys(("files_scanned", "files_indexed", "files_skipped", "symbols_extracted", "chunks_embedded", "duration_ms"), _COUNT))
TOOLS = [
    {
        "name": "index_repo",
        "description": "Index a repository, in full or what changed.",
        "inputSchema": _object(["path"], path=_PATH, full={"type": "boolean", "description": "Index every file anew instead of what changed since the last run."}),
        "outputSchema": _object(status=_STRING, repo_root=_STRING, branch=_STRING, stats=_STATS, languages={"type": "object", "additionalProperties": _COUNT}),
    },
    {
        "name": "search_repo",
        "description": "Search the symbols of a repository by words and by meaning.",
        "inputSchema": _object(["query", "path"], query=_text("Words to look for; all of them must occur for a hit by words."), path=_PATH, limit=_COUNT | {"description": "Results at most; 10 if not given."}),
        "outputSchema": _object(query=_STRING, results=_list(_RESULT), total_results=_COUNT, search_mode=_STRING),
    },
    {
        "name": "repo_map",
        "description": "Modules, symbols and dependencies of a repository.",
        "inputSchema": _object(["path"], path=_PATH, filter=_text("Only files at or under this path within the repository.")),
        "outputSchema": _object(repo_root=_STRING, branch=_STRING, modules=_list(_MODULE)),
    },
]


def call(service: Service, name: str, given: dict) -> str:
    if name == "index_repo":
        return to_json(service.index(given["path"], bool(given.get("full"))))
    if name == "search_repo":
        return to_json(service.search(given["path"], given["query"], int(given.get("limit", 10))))
    if name == "repo_map":
        return to_json(service.repo_map(given["path"], given.get("filter")))
    raise KeyError(name)


def answer(service: Service, request: dict) -> dict | None:
    """The response to one request; none to a notification."""
    method, params = request.get("method"), request.get("params") or {}
    if "id" not in request:
        return None
    out: dict = {"jsonrpc": "2.0", "id": request["id"]}
    if method == "initialize":
        return out | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "glyphmill", "version": __version__}}}
    if method == "ping":
        return out | {"result": {}}
    if method == "tools/list":
        return out | {"result": {"tools": TOOLS}}
    if method == "tools/call":
        try:
            text = call(service, params.get("name", ""), params.get("arguments") or {})
            return out | {"result": {"content": [{"type": "text", "text": text}], "structuredContent": json.loads(text), "isError": False}}
        except KeyError as missing:
            return out | {"error": {"code": -32602, "message": f"unknown tool or missing argument: {missing}"}}
        except Exception as failed:  # a tool's failure is a result, not the end of the server
            return out | {"result": {"content": [{"type": "text", "text": str(failed)[:2000]}], "isError": True}}
    return out | {"error": {"code": -32601, "message": f"unknown method: {method}"}}


def serve(service: Service, source: TextIO, out: TextIO) -> None:
    for line in source:
        if not line.strip():
            continue
        try:
            response = answer(service, json.loads(line))
        except json.JSONDecodeError as bad:
            response = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(bad)}}
        if response is not None:
            print(json.dumps(response), file=out, flush=True)

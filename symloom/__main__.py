"""python -m symloom COMMAND: init, reindex, status, query, map, serve and config over a source tree."""

from __future__ import annotations

import argparse
import inspect
import json
import sys

from pyspark.sql import SparkSession

from symloom.api import Index, dependencies_text, impact_text, imports_text, packed_text, score_text
from symloom.sources.config import Config


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("symloom").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def call(index: Index, tool: str, args: dict) -> object:
    """A named query by its name and arguments: rows as dictionaries, or the text of an artefact."""
    if tool == "reindex":
        return index.reindex(**args)
    if tool not in QUERIES:
        raise LookupError(f"no query {tool}")
    out = getattr(index, tool)(**args)
    if tool in TEXTS:
        return TEXTS[tool](out)
    if tool == "get_ranked_symbols":
        out = score_text(out)
    return [r.asDict(recursive=True) for r in out.collect()]


QUERIES = ("map_overview", "find_symbol", "read_source", "search_symbols", "get_skeleton", "get_dependencies", "get_impact", "trace_data_flow", "get_ranked_symbols", "compress_context", "pack_repo", "search_imports", "index_status", "reindex")
TEXTS = {"pack_repo": packed_text, "get_dependencies": dependencies_text, "get_impact": impact_text, "search_imports": imports_text}
_JSON_TYPES = {"str": "string", "int": "integer"}


def tools() -> list[dict]:
    """Name, description and argument schema of each named query, read from its method."""
    out = []
    for name in QUERIES:
        method = getattr(Index, name)
        args = [a for n, a in inspect.signature(method).parameters.items() if n != "self"]
        kinds = {a.name: {"type": _JSON_TYPES[str(a.annotation).partition(" ")[0]]} for a in args}
        needed = [a.name for a in args if a.default is a.empty]
        about = (method.__doc__ or name.replace("_", " ")).partition("\n")[0]
        out.append({"name": name, "description": about, "inputSchema": {"type": "object", "properties": kinds, "required": needed}})
    return out


def serve(index: Index) -> None:
    """One JSON-RPC request a line on stdin, one answer a line on stdout; notifications get none."""
    for line in sys.stdin:
        if not line.strip():
            continue
        try:
            ask = json.loads(line)
        except ValueError as e:
            print(json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}), flush=True)
            continue
        method = ask.get("method")
        if "id" not in ask:
            continue
        plain = {"initialize": lambda: {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "symloom", "version": "0.1"}}, "ping": dict, "tools/list": lambda: {"tools": tools()}}
        if method in plain:
            print(json.dumps({"jsonrpc": "2.0", "id": ask["id"], "result": plain[method]()}), flush=True)
            continue
        if method != "tools/call":
            print(json.dumps({"jsonrpc": "2.0", "id": ask.get("id"), "error": {"code": -32601, "message": "unknown method"}}), flush=True)
            continue
        params = ask.get("params") or {}
        try:
            result = {"content": call(index, params.get("name", ""), params.get("arguments") or {}), "isError": False}
        except Exception as e:  # a failed query is an answer, not the end of the server
            result = {"content": f"{getattr(e, 'code', type(e).__name__)}: {e}", "isError": True}
        print(json.dumps({"jsonrpc": "2.0", "id": ask.get("id"), "result": result}, default=str), flush=True)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="symloom")
    p.add_argument("--root", default=".")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "status", "serve"):
        sub.add_parser(name)
    sub.add_parser("reindex").add_argument("path", nargs="?")
    q = sub.add_parser("query")
    q.add_argument("text")
    q.add_argument("--max", type=int, default=10)
    m = sub.add_parser("map")
    m.add_argument("--detail", default="summary")
    m.add_argument("--max-chars", type=int, default=120_000)
    sub.add_parser("config").add_argument("action", choices=["show", "init"])
    a = p.parse_args(argv)
    if a.command == "config":
        config = Config.load(f"{a.root}/.symloom.toml")
        if a.action == "init":
            Config().save(f"{a.root}/.symloom.toml")
        print(config)
        return 0
    index = Index(_session(), a.root)
    if a.command in ("init", "reindex"):
        print(json.dumps(index.reindex(getattr(a, "path", None))))
    elif a.command == "status":
        print(json.dumps(call(index, "index_status", {})))
    elif a.command == "query":
        for r in index.search_symbols(a.text, a.max).collect():
            print(f"{r.kind} {r.qualified_name}\n  {r.signature}" + (f"\n  {r.docstring}" if r.docstring else ""))
    elif a.command == "map":
        print("".join(r.block for r in index.map_overview(a.max_chars, a.detail).collect()), end="")
    else:
        serve(index)
    return 0


if __name__ == "__main__":
    sys.exit(main())

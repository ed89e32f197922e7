"""Command line: index, search and map a repository, or serve the tools over stdio."""

from __future__ import annotations

import argparse
import sys
from typing import TextIO

from pyspark.sql import SparkSession

from glyphmill.plans.repomap import RepoMap
from glyphmill.schema import EngineError
from glyphmill.service import IndexResponse, SearchResponse, Service


def _line(text: str) -> str:
    return " ".join(text.split())


def print_index(out: TextIO, response: IndexResponse, full: bool) -> None:
    stats = response.stats
    print(f"repo_root: {response.repo_root}", f"branch: {response.branch}", f"mode: {'full' if full else 'incremental'}", sep="\n", file=out)
    for name in ("files_scanned", "files_indexed", "files_skipped", "symbols_extracted", "chunks_embedded", "duration_ms"):
        print(f"{name}: {getattr(stats, name)}", file=out)
    print("languages:", *[f"- {k}: {v}" for k, v in sorted(response.languages.items())], sep="\n", file=out)


def print_search(out: TextIO, response: SearchResponse) -> None:
    print(f"query: {response.query}", f"repo_root: {response.repo_root}", f"branch: {response.branch}", f"total_results: {response.total_results}", sep="\n", file=out)
    if not response.results:
        print("no_results: true", file=out)
    for r in response.results:
        print(f"- {r['name']} [{r['kind']}] {r['path']}:{r['line']} score={r['score']:.3f} match={r['match_type']}", file=out)
        print(f"  signature: {r['signature'].strip()}", file=out)
        if (r["doc"] or "").strip():
            print(f"  doc: {_line(r['doc'])}", file=out)
        print(f"  snippet: {_line(r['snippet'])}", file=out)


def print_map(out: TextIO, found: RepoMap) -> None:
    print(f"repo_root: {found.repo_root}", f"branch: {found.branch}", f"modules: {len(found.modules)}", sep="\n", file=out)
    for module in found.modules:
        print(f"\n## {module.name}\npath: {module.path}", file=out)
        if module.files:
            print("files:", *[f"  - {f}" for f in module.files], sep="\n", file=out)
        if module.symbols:
            print("symbols:", *[f"  - {s.name} [{s.kind}] {s.file}:{s.line} {s.signature.strip()}" for s in module.symbols], sep="\n", file=out)
        if module.depends_on:
            print(f"depends_on: {', '.join(module.depends_on)}", file=out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="glyphmill", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("mcp", help="serve the tools over stdio")
    one = commands.add_parser("index", help="index a repository")
    one.add_argument("path", nargs="?", default=".")
    one.add_argument("--full", action="store_true")
    one = commands.add_parser("search", help="search an indexed repository")
    one.add_argument("query")
    one.add_argument("--repo", default=".")
    one.add_argument("--limit", type=int, default=10)
    one = commands.add_parser("repo-map", help="print the modules and symbols of a repository")
    one.add_argument("path", nargs="?", default=".")
    one.add_argument("--filter")
    return top


def run(args: list[str], service: Service, out: TextIO = sys.stdout) -> int:
    given = parser().parse_args(args)
    try:
        if given.command == "index":
            print_index(out, service.index(given.path, given.full), given.full)
        elif given.command == "search":
            print_search(out, service.search(given.repo, given.query, given.limit, refresh=False))
        elif given.command == "repo-map":
            print_map(out, service.repo_map(given.path, given.filter))
        else:
            from glyphmill.mcp import serve

            serve(service, sys.stdin, out)
    except EngineError as failed:
        print(f"error: {failed}", file=sys.stderr)
        return 1
    return 0


def main() -> None:
    spark = SparkSession.builder.appName("glyphmill").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sys.exit(run(sys.argv[1:], Service(spark)))


if __name__ == "__main__":
    main()

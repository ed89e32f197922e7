"""Index, search and map small repositories through the service, the command line and the tool server."""

from __future__ import annotations

import datetime
import io
import json
import subprocess

import pytest

from glyphmill import cli, mcp, service
from glyphmill.functions.embed import SketchEmbedder
from glyphmill.schema import NotIndexedError
from glyphmill.sources.files import source_paths
from glyphmill.sources.git import repo_context
from glyphmill.sources.ignore import is_ignored, rules_of

RUST = "/// Makes a token.\npub fn token_refresh(old: &str) -> String {\n    old.to_string()\n}\n\nfn hidden() {}\n"
TS = "import { x } from './x';\nexport class Session {\n  open(): void {}\n}\n"


@pytest.fixture
def home(tmp_path, monkeypatch):
    monkeypatch.setenv("GLYPHMILL_HOME", str(tmp_path / "home"))
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "none"))
    return tmp_path


def _write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def _git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


def _stored(s, root):
    context = repo_context(root)
    units = s.store(context).units(context.repo_id, context.branch)
    return sorted(map(tuple, units.select("file_path", "name", "kind", "line_start", "signature", "file_hash").collect()))


def test_walk_filters(home):
    root = home / "build" / "repo"  # an excluded name above the root does not count
    _write(root, {
        ".gitignore": "ignored.ts\nsubdir/\n/only_top.rs\n*.gen.ts\n!keep.gen.ts\n", "src/kept.ts": "a", "ignored.ts": "a", "subdir/x.rs": "a", "deep/subdir/y.rs": "a",
        "only_top.rs": "a", "deep/only_top.rs": "a", "a.gen.ts": "a", "keep.gen.ts": "a", "node_modules/m.ts": "a", ".hidden.rs": "a", "big.rs": "x" * 200, "README.md": "a", "src/naïve file.rs": "a", "ui/x.tsx": "a",
    })
    assert source_paths(root, 128) == sorted([".hidden.rs", "deep/only_top.rs", "keep.gen.ts", "src/kept.ts", "src/naïve file.rs", "ui/x.tsx"], key=str.encode)


def test_ignore_rules():
    rules = rules_of("a/**/b\nlogs/**\n?.ts\n[ab].rs\n# no\n\\#x\n")
    for path, expected in (("a/b", True), ("a/x/y/b", True), ("logs/z/q", True), ("x/y.ts", True), ("xy.ts", False), ("a.rs", True), ("c.rs", False), ("#x", True), ("no", False)):
        assert is_ignored(rules, path, False) == expected, path


def test_full_search_and_map(spark, home):
    root = home / "repo"
    _write(root, {"src/lib.rs": RUST, "web/app.ts": TS, "web/use.ts": "export function start(): Session { return new Session(); }\n", "core/x.rs": "pub struct Other { t: Session }\n", "bin.rs": b"pub fn a() {}\0", "bad.rs": b"pub fn \xff() {}", "private.rs": "fn only() {}\n"})
    s = service.Service(spark, str(home / "stores"), SketchEmbedder())
    done = s.index(root)
    assert (done.stats.files_scanned, done.stats.files_indexed, done.stats.files_skipped, done.stats.symbols_extracted) == (7, 5, 2, 5)
    assert done.stats.chunks_embedded == 5 and done.languages == {"rust": 3, "typescript": 2}
    found = s.search(root, "token_refresh", limit=3)
    assert found.results[0]["name"] == "token_refresh" and found.results[0]["doc"] == "Makes a token." and found.results[0]["match_type"] == "hybrid"
    assert s.search(root, "   ").results and s.search(root, "token", limit=0).results == []
    built = s.repo_map(root)
    assert [(m.name, m.depends_on) for m in built.modules] == [("core", ["web"]), ("src", []), ("web", [])]
    assert [m.path for m in s.repo_map(root, "/src/").modules] == ["src"]
    out = io.StringIO()
    assert cli.run(["search", "session", "--repo", str(root)], s, out) == 0 and "- Session [class] web/app.ts:2" in out.getvalue()
    out = io.StringIO()
    cli.run(["repo-map", str(root)], s, out)
    assert "## web\npath: web\nfiles:\n  - app.ts\n  - use.ts\nsymbols:\n  - Session [class] app.ts:2 class Session" in out.getvalue()


def test_incremental_is_like_full(spark, home):
    root = home / "repo"
    _write(root, {"a.rs": RUST, "b.rs": "pub struct B;\n", "c.ts": TS})
    s = service.Service(spark, str(home / "one"), SketchEmbedder())
    s.index(root)
    _write(root, {"a.rs": RUST + "pub enum New { X }\n", "d.cs": "public class D { public int F() { return 1; } }\n", "b.rs": "fn hidden() {}\n"})
    (root / "c.ts").unlink()
    stats = s.index(root).stats
    # The function of a.rs keeps its vector: its text is as it was.
    assert (stats.files_indexed, stats.chunks_embedded) == (3, 3)
    other = service.Service(spark, str(home / "two"))
    other.index(root, full=True)
    assert _stored(s, root) == _stored(other, root) != []
    context = repo_context(root)
    row = s.store(context).metadata_row(context.repo_id, context.branch)
    assert (row["status"], row["file_count"], row["symbol_count"]) == ("ready", 3, 4)
    assert s.index(root).stats.files_scanned == 0
    assert s.store(context).metadata_row(context.repo_id, context.branch)["status"] == "ready"


def test_git_changes_and_branches(spark, home):
    root = home / "repo"
    _write(root, {"a.rs": RUST, "b.rs": "pub struct B;\n"})
    subprocess.run(["git", "init", "-qb", "main", str(root)], check=True)
    _git(root, "add", "."), _git(root, "commit", "-qm", "one")
    s = service.Service(spark, str(home / "stores"))
    s.index(root)
    _git(root, "checkout", "-qb", "side")
    with pytest.raises(NotIndexedError):
        s.search(root, "token", refresh=False)
    _write(root, {"b.rs": "pub struct Renamed;\n"})
    _git(root, "commit", "-qam", "two")
    s.index(root)
    _git(root, "checkout", "-q", "main")
    assert [u[1] for u in _stored(s, root)] == ["token_refresh", "B"]
    context = repo_context(root)
    assert s.store(context).branches(context.repo_id) == ["main", "side"]
    _git(root, "rm", "-q", "b.rs"), _git(root, "commit", "-qm", "three")
    s.index(root)
    assert [u[1] for u in _stored(s, root)] == ["token_refresh"]
    s.delete(root)
    assert s.store(context).branches(context.repo_id) == ["side"]


def test_tool_server(spark, home):
    root = home / "repo"
    _write(root, {"a.rs": RUST})
    asked = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "search_repo", "arguments": {"path": str(root), "query": "supported? token"}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "nothing"}}, {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "repo_map", "arguments": {"path": "/no/such"}}},
    ]
    out = io.StringIO()
    mcp.serve(service.Service(spark, str(home / "stores")), io.StringIO("\n".join(map(json.dumps, asked)) + "\nnot json\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, None]
    assert [t["name"] for t in got[1]["result"]["tools"]] == ["index_repo", "search_repo", "repo_map"]
    assert got[2]["result"]["structuredContent"]["total_results"] == 0 and got[3]["error"]["code"] == -32602 and got[4]["result"]["isError"]


def test_staleness():
    now = datetime.datetime(2024, 1, 1, 12)
    row = {"status": "ready", "last_indexed_at": now - datetime.timedelta(minutes=10), "last_seen_commit_sha": "old"}
    assert service.should_refresh(row, "new", now) and not service.should_refresh(row, "old", now) and not service.should_refresh(row, None, now)
    assert service.should_refresh(row | {"status": "failed"}, "old", now) and service.should_refresh(None, None, now)
    assert not service.should_refresh(row | {"last_indexed_at": now - datetime.timedelta(minutes=1)}, "new", now)


def test_searches_during_a_full_index(spark, home):
    import threading

    root = home / "repo"
    _write(root, {"a.rs": RUST, "web/app.ts": TS})
    s = service.Service(spark, str(home / "stores"), SketchEmbedder())
    s.index(root)
    running = threading.Thread(target=lambda: s.index(root, full=True))
    running.start()
    found = [s.search(root, "token_refresh", refresh=False).total_results for _ in range(10)]
    running.join()
    assert all(found) and s.search(root, "token_refresh", refresh=False).results[0]["name"] == "token_refresh"


def test_markers_have_owners(spark, home, monkeypatch):
    monkeypatch.setattr(service, "LONGEST_WAIT", 0.3)
    root = home / "repo"
    _write(root, {"a.rs": RUST})
    s, context = service.Service(spark, str(home / "stores")), repo_context(root)
    with s._marked(context):
        with pytest.raises(service.StorageError), s._marked(context):
            pass
        assert s._marker(context).exists()
        s._marker(context).write_text("another owner")
    assert s._marker(context).read_text() == "another owner"


def test_failed_reads_are_tried_again(spark, home, monkeypatch):
    monkeypatch.setattr(service, "TRY_AGAIN", 0)
    s, calls = service.Service(spark, str(home / "stores")), []

    def run(good):
        calls.append(1)
        if len(calls) < good:
            raise OSError("gone")
        return [{}]

    assert s._tried(lambda: run(4)) == [{}] and len(calls) == 4
    calls.clear()
    with pytest.raises(OSError, match="gone"):
        s._tried(lambda: run(99))
    assert len(calls) == service.SEARCH_TRIES


def test_tools_say_what_they_take_and_give():
    for tool in mcp.TOOLS:
        assert set(tool["outputSchema"]["required"]) == set(tool["outputSchema"]["properties"])
        assert all(p.get("description") for p in tool["inputSchema"]["properties"].values())

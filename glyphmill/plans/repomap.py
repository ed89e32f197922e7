"""The repository map of a stored branch."""

from __future__ import annotations

from dataclasses import dataclass, field

from glyphmill.functions.paths import normalized_filter
from glyphmill.operators import repomap
from glyphmill.sources.git import RepoContext
from glyphmill.sources.store import Store


@dataclass
class Symbol:
    name: str
    kind: str
    signature: str
    doc: str | None
    file: str
    line: int


@dataclass
class Module:
    name: str
    path: str
    files: list[str]
    symbols: list[Symbol]
    depends_on: list[str]


@dataclass
class RepoMap:
    repo_root: str
    branch: str
    modules: list[Module] = field(default_factory=list)


def repo_map(store: Store, context: RepoContext, path_filter: str | None = None) -> RepoMap:
    """Modules in bytewise order of their paths. A filter also limits where dependencies are looked for."""
    units = repomap.located(store.units(context.repo_id, context.branch), context.root.name, normalized_filter(path_filter))
    rows = repomap.modules(units.drop("embedding")).orderBy("module").collect()
    found = [
        Module(r["name"], r["module"], list(r["files"]), [Symbol(s["name"], s["kind"], s["signature"], s["doc"], s["file"], s["line"]) for s in r["symbols"]], list(r["depends_on"]))
        for r in rows
    ]
    return RepoMap(str(context.root), context.branch, found)

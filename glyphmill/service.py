"""The application: index, search and map a repository, with locks, markers and automatic refresh."""

from __future__ import annotations

import contextlib
import datetime
import json
import logging
import os
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from glyphmill.functions.embed import Embedder
from glyphmill.functions.ids import store_name
from glyphmill.plans import index, repomap, search
from glyphmill.schema import EngineError, NotIndexedError, SearchConfig, StorageError
from glyphmill.sources.git import RepoContext, current_commit, repo_context
from glyphmill.sources.store import Store

log = logging.getLogger(__name__)
# Seconds.
STALE_MARKER, POLL, LONGEST_WAIT, STALE_INDEX = 300, 0.1, 60, 300
SEARCH_MODE = "hybrid"
# How often a search is tried, and the seconds between.
SEARCH_TRIES, TRY_AGAIN = 10, 0.1
#: Seconds between two signs of life of a running index.
HEARTBEAT = 30


@dataclass
class IndexResponse:
    status: str
    repo_root: str
    branch: str
    stats: index.IndexStats
    languages: dict[str, int]


@dataclass
class SearchResponse:
    query: str
    repo_root: str
    branch: str
    results: list[dict] = field(default_factory=list)
    search_mode: str = SEARCH_MODE

    @property
    def total_results(self) -> int:
        return len(self.results)


def home() -> Path:
    return Path(os.environ.get("GLYPHMILL_HOME") or Path.home() / ".config" / "glyphmill")


def should_refresh(metadata: dict | None, commit: str | None, now: datetime.datetime | None = None, stale: int = STALE_INDEX) -> bool:
    """No index or none that is ready: yes. A young one: no. Else if both commits are known and differ."""
    if metadata is None or metadata["status"] != "ready" or metadata["last_indexed_at"] is None:
        return True
    if ((now or datetime.datetime.now()) - metadata["last_indexed_at"]).total_seconds() < stale:
        return False
    seen = metadata["last_seen_commit_sha"]
    return commit is not None and seen is not None and commit != seen


class Service:
    """One for each process; calls on one repository run one at a time."""

    def __init__(self, spark: SparkSession, base: str | None = None, embedder: Embedder | None = None):
        self.spark, self.embedder = spark, embedder
        self.base = base or str(home() / "stores")
        self._locks: dict[str, threading.Lock] = {}
        self._guard = threading.Lock()

    def _lock(self, root: Path) -> threading.Lock:
        with self._guard:
            return self._locks.setdefault(str(root), threading.Lock())

    def store(self, context: RepoContext) -> Store:
        store = Store(self.spark, f"{self.base}/{store_name(context.root)}")
        store.migrate()
        return store

    def _marker(self, context: RepoContext) -> Path:
        return home() / "markers" / f"{store_name(context.root)}.indexing"

    def _wait(self, context: RepoContext) -> bool:
        """Wait while another process indexes; false if it still does. A marker without signs of life counts as left behind."""
        marker, until = self._marker(context), time.monotonic() + LONGEST_WAIT
        while time.monotonic() < until:
            try:
                if time.time() - marker.stat().st_mtime > STALE_MARKER:
                    marker.unlink(missing_ok=True)
                    return True
            except FileNotFoundError:
                return True
            time.sleep(POLL)
        return not marker.exists()

    @contextlib.contextmanager
    def _marked(self, context: RepoContext):
        """Hold the repository's marker: created exclusively, kept alive, and removed only by its owner."""
        marker, owner = self._marker(context), uuid.uuid4().hex
        marker.parent.mkdir(parents=True, exist_ok=True)
        while True:
            if not self._wait(context):
                raise StorageError(f"{context.root} is being indexed by another process")
            try:
                handle = os.open(marker, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                break
            except FileExistsError:
                continue
        os.write(handle, owner.encode())
        os.close(handle)
        own = lambda: marker.exists() and marker.read_text() == owner
        ended = threading.Event()

        def live() -> None:
            while not ended.wait(HEARTBEAT):
                with contextlib.suppress(OSError):
                    if own():
                        os.utime(marker)

        threading.Thread(target=live, daemon=True).start()
        try:
            yield
        finally:
            ended.set()
            with contextlib.suppress(OSError):
                if own():
                    marker.unlink(missing_ok=True)

    def index(self, root: str | Path, full: bool = False) -> IndexResponse:
        context = repo_context(root)
        with self._lock(context.root):
            return self._index(context, full)

    def _index(self, context: RepoContext, full: bool) -> IndexResponse:
        store = self.store(context)
        with self._marked(context):
            known = store.metadata_row(context.repo_id, context.branch)
            try:
                if full or known is None:
                    stats = index.full_index(store, context, self.embedder)
                else:
                    store.set_status(context.repo_id, context.branch, "indexing")
                    stats = index.incremental_index(store, context, self.embedder)
            except Exception as failed:
                store.set_status(context.repo_id, context.branch, "failed", str(failed)[:2000])
                raise
            store.vacuum()
        return IndexResponse("ready", str(context.root), context.branch, stats, stats.languages)

    def _refreshed(self, context: RepoContext) -> Store:
        store = self.store(context)
        if should_refresh(store.metadata_row(context.repo_id, context.branch), current_commit(context.root)):
            self._index(context, full=False)
        return store

    def _tried(self, run: Callable[[], list[dict]]) -> list[dict]:
        """What ``run`` gives; a read that fails, as when files go during an index run, is tried again."""
        for attempt in range(SEARCH_TRIES):
            try:
                return run()
            except EngineError:
                raise
            except Exception:
                if attempt == SEARCH_TRIES - 1:
                    raise
                log.info("a search failed and is tried again", exc_info=True)
                time.sleep(TRY_AGAIN)
        return []

    def search(self, root: str | Path, query: str, limit: int = 10, refresh: bool = True) -> SearchResponse:
        """The best units for a query. Without ``refresh``, a branch that holds no index is an error.

        Searches read a published version, so they run beside an index run of this or another process.
        """
        context = repo_context(root)
        if refresh:
            with self._lock(context.root):
                store = self._refreshed(context)
        else:
            store = self.store(context)
            if store.metadata_row(context.repo_id, context.branch) is None and not store.has_symbols(context.repo_id, context.branch):
                raise NotIndexedError(f"{context.root} ({context.branch}) is not indexed; run `index` first")

        def run() -> list[dict]:
            # Statistics are those of the whole store, hits those of the branch.
            found = search.search(store.units(), query, SearchConfig(limit=limit), self.embedder, context.repo_id, context.branch, store.index())
            return [r.asDict() for r in found.drop("rowid", "rk").collect()]

        return SearchResponse(query, str(context.root), context.branch, self._tried(run))

    def repo_map(self, root: str | Path, path_filter: str | None = None) -> repomap.RepoMap:
        context = repo_context(root)
        with self._lock(context.root):
            self._wait(context)
            return repomap.repo_map(self._refreshed(context), context, path_filter)

    def delete(self, root: str | Path) -> None:
        context = repo_context(root)
        with self._lock(context.root):
            self.store(context).delete_branch(context.repo_id, context.branch)


def to_json(response: object) -> str:
    """A response as JSON: an index response, search results, or a map."""
    if isinstance(response, SearchResponse):
        return json.dumps({"query": response.query, "results": response.results, "total_results": response.total_results, "search_mode": response.search_mode})
    value = asdict(response)  # type: ignore[call-overload]
    if "stats" in value:
        value["stats"].pop("languages")
    return json.dumps(value)

"""Indexing plans: full, incremental, and the materialization of embeddings."""

from __future__ import annotations

import datetime
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.embed import Embedder, embedding_udf
from glyphmill.operators import changes
from glyphmill.operators.extraction import extract_rows
from glyphmill.sources.files import MAX_FILE_SIZE, read_sources, source_paths
from glyphmill.sources.git import RepoContext, changed_files, is_git_repo
from glyphmill.sources.store import Store, as_units


@dataclass
class IndexStats:
    files_scanned: int = 0
    files_indexed: int = 0
    files_skipped: int = 0
    symbols_extracted: int = 0
    chunks_embedded: int = 0
    duration_ms: int = 0
    languages: dict[str, int] = field(default_factory=dict)


@dataclass
class ChangeSet:
    added: list[str] = field(default_factory=list)
    modified: list[str] = field(default_factory=list)
    deleted: list[str] = field(default_factory=list)

    @property
    def empty(self) -> bool:
        return not (self.added or self.modified or self.deleted)


def _prepared(spark: SparkSession, context: RepoContext, paths: list[str]) -> tuple[DataFrame, DataFrame, int, dict[str, int], int]:
    """Units and file records of files, and how many were indexed, in which languages, with how many symbols."""
    sources = read_sources(spark, context.root, paths)
    rows = extract_rows(sources).cache()
    failed = [r[0] for r in rows.where("error is not null").select("file_path").distinct().collect()]
    good = sources.select("file_path", "language", "file_hash").where(~F.col("file_path").isin(failed)) if failed else sources.select("file_path", "language", "file_hash")
    units = as_units(rows.where("error is null").drop("error"), good, context.repo_id, context.branch)
    counts = units.groupBy("file_path").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
    files = good.join(counts, "file_path", "left").select(
        F.lit(context.repo_id).alias("repo_id"), F.lit(context.branch).alias("branch"), "file_path", "file_hash",
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.current_timestamp().alias("indexed_at"),
    )
    languages = {r["language"]: r["count"] for r in good.groupBy("language").count().collect()}
    symbols = rows.where("error is null").count()
    return units, files, sum(languages.values()), languages, symbols


def materialize_embeddings(store: Store, context: RepoContext, embedder: Embedder | None) -> int:
    """Fill in the vectors that are missing or of another model; how many there were."""
    if embedder is None:
        return 0
    waiting = store.pending(context.repo_id, context.branch, embedder.model_name)
    count = waiting.count()
    if count:
        made = waiting.select("id", embedding_udf(embedder)(F.col("embedding_text")).alias("embedding"))
        store.update_embeddings(context.repo_id, context.branch, made, embedder.model_name)
    return count


def _finish(store: Store, context: RepoContext, embedder: Embedder | None) -> DataFrame:
    counts = changes.index_stats(store.files(context.repo_id, context.branch)).first()
    return store.metadata_frame(
        context.repo_id, context.branch, status="ready", last_indexed_at=datetime.datetime.now(), last_commit_sha=context.commit, last_seen_commit_sha=context.commit,
        file_count=counts["file_count"] if counts else 0, symbol_count=counts["symbol_count"] if counts else 0, embedding_model=embedder.model_name if embedder else "", last_error=None,
    )


def full_index(store: Store, context: RepoContext, embedder: Embedder | None = None, max_size: int = MAX_FILE_SIZE) -> IndexStats:
    """Index every source file anew; files that can't be parsed are skipped."""
    began = time.monotonic()
    paths = source_paths(context.root, max_size)
    units, files, indexed, languages, symbols = _prepared(store.spark, context, paths)
    store.replace_branch(context.repo_id, context.branch, units, files, store.metadata_frame(context.repo_id, context.branch, status="indexing"))
    embedded = materialize_embeddings(store, context, embedder)
    store._change(context.repo_id, context.branch, lambda: {"index_metadata": _finish(store, context, embedder)})
    return IndexStats(len(paths), indexed, len(paths) - indexed, symbols, embedded, int((time.monotonic() - began) * 1000), languages)


def detect_changes(store: Store, context: RepoContext, max_size: int = MAX_FILE_SIZE) -> ChangeSet:
    """Changes since the last index: by git where it can tell, or else by content hashes.

    Both pass the same filters as a full index, and git's answer takes in committed changes alone.
    """
    known = store.metadata_row(context.repo_id, context.branch)
    paths = source_paths(context.root, max_size)
    if known is None:
        return ChangeSet(added=paths)
    since = known["last_commit_sha"]
    if since and is_git_repo(context.root):
        found = changed_files(context.root, since)
        if found is not None:
            there = set(paths)
            return ChangeSet([p for p in found["added"] if p in there], [p for p in found["modified"] if p in there], found["deleted"])
    now = read_sources(store.spark, context.root, paths).select(F.col("file_path").alias("path"), F.col("file_hash").alias("hash"))
    before = store.files(context.repo_id, context.branch).select(F.col("file_path").alias("path"), F.col("file_hash").alias("hash"))
    out = ChangeSet()
    for row in changes.hash_diff(now, before).orderBy("path").collect():
        getattr(out, row["change_type"]).append(row["path"])
    return out


def incremental_index(store: Store, context: RepoContext, embedder: Embedder | None = None, max_size: int = MAX_FILE_SIZE) -> IndexStats:
    """Index what changed. Units whose text stays as it was keep their vectors; no change still ends as ready."""
    began = time.monotonic()
    found = detect_changes(store, context, max_size)
    stats = IndexStats()
    if not found.empty:
        paths = sorted({*found.added, *found.modified})
        units, files, indexed, languages, symbols = _prepared(store.spark, context, paths)
        old = store.units(context.repo_id, context.branch).select(F.col("file_path").alias("o_path"), "signature", "doc", "content", F.col("embedding").alias("o_vector"), F.col("embedding_model").alias("o_model"))
        old = old.where("o_vector is not null").dropDuplicates(["signature", "doc", "content"])
        same = (units.signature == old.signature) & units.doc.eqNullSafe(old.doc) & (units.content == old.content)
        reused = units.join(old, same, "left").select(*[units[c] for c in units.columns if c not in ("embedding", "embedding_model")], F.col("o_vector").alias("embedding"), F.coalesce("o_model", F.lit("")).alias("embedding_model")).select(*units.columns)
        gone = store.spark.createDataFrame([(context.repo_id, context.branch, p) for p in {*found.deleted, *found.modified}], "repo_id string, branch string, file_path string")

        def make():
            kept = changes.delete_files(store.units(context.repo_id, context.branch), gone)
            records = changes.delete_files(store.files(context.repo_id, context.branch), gone)
            # Reused vectors keep their model, which an upsert of given vectors would not.
            return {"code_units": changes.upsert_rows(kept, reused, ["id"]), "indexed_files": changes.upsert_rows(records, files, ["repo_id", "branch", "file_path"])}

        store._change(context.repo_id, context.branch, make)
        stats = IndexStats(len(paths) + len(found.deleted), indexed, len(paths) - indexed, symbols, 0, 0, languages)
    stats.chunks_embedded = materialize_embeddings(store, context, embedder)
    store._change(context.repo_id, context.branch, lambda: {"index_metadata": _finish(store, context, embedder)})
    stats.duration_ms = int((time.monotonic() - began) * 1000)
    return stats

"""Change detection, upserts, deletions and bookkeeping as set operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.text import embedding_text
from glyphmill.schema import NATURAL_KEY


def hash_diff(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """path and change_type (added, modified, deleted) between two frames of path and hash."""
    old = indexed.select(F.col("path").alias("old_path"), F.col("hash").alias("old_hash"))
    joined = current.join(old, current.path == old.old_path, "full_outer")
    change = F.when(F.col("old_path").isNull(), "added").when(F.col("path").isNull(), "deleted").when(F.col("hash") != F.col("old_hash"), "modified")
    return joined.select(F.coalesce("path", "old_path").alias("path"), change.alias("change_type")).where("change_type is not null")


def last_wins(units: DataFrame, order: str = "position") -> DataFrame:
    """One row for each natural key: the last by ``order``."""
    ranked = units.withColumn("_nth", F.row_number().over(Window.partitionBy(*NATURAL_KEY).orderBy(F.col(order).desc())))
    return ranked.where("_nth = 1").drop("_nth", order)


def upsert_units(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows with new ones put over those of the same natural key.

    Where signature, doc or content changed, the vector is dropped (even one that came with the
    new row). Otherwise a new vector replaces the old one and counts as of an unknown model.
    """
    columns = old.columns
    a, b = old.alias("a"), new.alias("b")
    same_key = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in NATURAL_KEY]
    joined = a.join(b, same_key, "full_outer")
    is_new, is_old = F.col("b.file_path").isNotNull(), F.col("a.file_path").isNotNull()
    changed = is_new & is_old & ~(F.col("a.signature").eqNullSafe(F.col("b.signature")) & F.col("a.doc").eqNullSafe(F.col("b.doc")) & F.col("a.content").eqNullSafe(F.col("b.content")))
    given = F.col("b.embedding").isNotNull()

    def picked(c: str) -> Column:
        if c == "embedding":
            value = F.when(changed, F.lit(None)).when(is_new & given, F.col("b.embedding")).otherwise(F.col("a.embedding"))
            return F.when(is_new & ~is_old, F.col("b.embedding")).otherwise(value)
        if c == "embedding_model":
            value = F.when(changed, F.lit("")).when(is_new & given, F.lit("unknown")).otherwise(F.col("a.embedding_model"))
            return F.when(is_new & ~is_old, F.when(given, "unknown").otherwise("")).otherwise(value)
        if c == "rowid":
            return F.coalesce(F.col("a.rowid"), F.col("b.rowid"))
        return F.when(is_new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))

    return joined.select(*[picked(c).alias(c) for c in columns])


def upsert_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without the keys of the new ones, and the new ones."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def delete_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of other files than those listed (repo_id, branch, file_path)."""
    return rows.join(files.select("repo_id", "branch", "file_path"), ["repo_id", "branch", "file_path"], "left_anti")


def replace_branch(rows: DataFrame, new: DataFrame, repo: str, branch: str) -> DataFrame:
    """All rows of other branches, and the new ones of this branch."""
    return rows.where(~((F.col("repo_id") == repo) & (F.col("branch") == branch))).unionByName(new)


def apply_changes(units: DataFrame, files: DataFrame, deleted: DataFrame, new_units: DataFrame, new_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units and file records after deletions, then upserts."""
    units = upsert_units(delete_files(units, deleted), new_units)
    files = upsert_rows(delete_files(files, deleted), new_files, ["repo_id", "branch", "file_path"])
    return units, files


def pending_embeddings(units: DataFrame, model: str) -> DataFrame:
    """Units without a vector of the model: rowid, id, path, line, name and the text to embed."""
    waiting = units.where(F.col("embedding").isNull() | (F.col("embedding_model") != model))
    return waiting.select("rowid", "id", "file_path", "line_start", "name", embedding_text(F.col("signature"), F.col("doc"), F.col("content")).alias("embedding_text"))


def update_embeddings(units: DataFrame, updates: DataFrame, model: str) -> DataFrame:
    """Units with the vectors of ``updates`` (id, embedding) put in under the model's name."""
    fresh = updates.select(F.col("id").alias("_id"), F.col("embedding").alias("_embedding"))
    joined = units.join(fresh, units.id == fresh._id, "left")
    columns = {"embedding": F.coalesce("_embedding", "embedding"), "embedding_model": F.when(F.col("_id").isNotNull(), F.lit(model)).otherwise(F.col("embedding_model"))}
    return joined.select(*[columns.get(c, F.col(c)).alias(c) for c in units.columns])


def index_stats(files: DataFrame) -> DataFrame:
    """file_count and symbol_count of each repository and branch."""
    return files.groupBy("repo_id", "branch").agg(F.count(F.lit(1)).alias("file_count"), F.sum("chunk_count").cast("long").alias("symbol_count"))


def language_counts(units: DataFrame) -> DataFrame:
    return units.groupBy("language").agg(F.count(F.lit(1)).alias("n_symbols"), F.countDistinct("file_path").alias("n_files"))


def needs_refresh(status: Column, last_indexed: Column, commit: Column, seen: Column, now: Column, minutes: int = 5) -> Column:
    """Whether an index is stale: not ready, or old enough and of another known commit."""
    young = (F.unix_micros(now) - F.unix_micros(last_indexed)) < minutes * 60_000_000
    return F.when(status != "ready", True).when(young, False).otherwise(F.coalesce(commit != seen, F.lit(False)))

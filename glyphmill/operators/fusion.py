"""Reciprocal rank fusion and the shaping of search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.text import snippet
from glyphmill.schema import SearchConfig


def match_type(has_fts: Column, has_vector: Column) -> Column:
    return F.when(has_fts & has_vector, "hybrid").when(has_fts, "fts").otherwise("vector")


def match_rank(kind: Column) -> Column:
    return F.when(kind == "hybrid", 2).otherwise(1)


def fuse(fts: DataFrame, vector: DataFrame, rrf_k: int = 60) -> DataFrame:
    """query_id, rowid, fts_score, vector_score, combined and match_type of two ranked hit lists.

    Each list has query_id, rowid and rk (from 1). A unit's part from a list is 1 / (k + rank).
    """
    k = max(rrf_k, 1)
    both = fts.select("query_id", "rowid", "rk", F.lit("fts").alias("origin")).unionByName(vector.select("query_id", "rowid", "rk", F.lit("vector").alias("origin")))
    part = F.lit(1.0) / (F.lit(k) + F.col("rk"))
    of = lambda origin: F.sum(F.when(F.col("origin") == origin, part).otherwise(0.0))
    fused = both.groupBy("query_id", "rowid").agg(
        of("fts").alias("fts_score"),
        of("vector").alias("vector_score"),
        F.max(F.col("origin") == "fts").alias("has_fts"),
        F.max(F.col("origin") == "vector").alias("has_vector"),
    )
    return fused.select("query_id", "rowid", "fts_score", "vector_score", (F.col("fts_score") + F.col("vector_score")).alias("combined"), match_type(F.col("has_fts"), F.col("has_vector")).alias("match_type"))


def result_order(score: str) -> list[Column]:
    return [F.col(score).desc(), match_rank(F.col("match_type")).desc(), F.col("line_start"), F.col("file_path"), F.col("name"), F.col("rowid")]


def top_fused(fused: DataFrame, units: DataFrame, k: int, score: str = "combined") -> DataFrame:
    """The k best fused rows of each query with the columns of their units; wide rows are joined to narrow hits."""
    wide = fused.join(units, "rowid")
    order = Window.partitionBy("query_id").orderBy(*result_order(score))
    return wide.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def normalized(score: Column, most: Column) -> Column:
    """A score over the largest of its query; 0 where none is above 0."""
    top = F.greatest(most, F.lit(0.0))
    return F.when(top > 0, score / F.when(top > 0, top)).otherwise(F.lit(0.0))


def shape_results(ranked: DataFrame, config: SearchConfig, score: str = "combined") -> DataFrame:
    """The rows of the search interface: normalized scores, the least score, snippets, order, limit."""
    most = F.max(score).over(Window.partitionBy("query_id"))
    scored = ranked.withColumn("score", F.round(normalized(F.col(score), most), 6)).where(F.col("score") >= config.min_score)
    order = Window.partitionBy("query_id").orderBy(*result_order("score"))
    top = scored.drop("rk").withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= config.limit)
    return top.select("query_id", "rk", "rowid", "kind", "name", F.col("file_path").alias("path"), F.col("line_start").alias("line"), "signature", "doc", snippet(F.col("content")).alias("snippet"), "score", "match_type")

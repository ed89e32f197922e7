"""Searches: lexical, vector and hybrid, for one query or many, with graceful degradation."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.embed import Embedder
from glyphmill.functions.text import query_phrases
from glyphmill.operators import fusion, lexical, similarity
from glyphmill.schema import SearchConfig

log = logging.getLogger(__name__)
Queries = list[tuple[int, str]]


def _fts(units: DataFrame, queries: Queries, config: SearchConfig, where: Column | None, index: lexical.Index | None) -> DataFrame:
    if index is None:
        return lexical.search_fts(units, queries, config.candidates, where)
    return lexical.search_index(index, queries, config.candidates, None if where is None else units.where(where))


def _lexical(units: DataFrame, queries: Queries, config: SearchConfig, where: Column | None, index: lexical.Index | None = None) -> DataFrame:
    hits = _fts(units, queries, config, where, index)
    scored = hits.select("query_id", "rowid", "rk", lexical.fts_score(F.col("bm25")).alias("combined"), F.lit("fts").alias("match_type"))
    return scored.join(units, "rowid")


def _vector(units: DataFrame, vectors: DataFrame, config: SearchConfig, where: Column | None) -> DataFrame:
    hits = similarity.search_vector(units, vectors, config.candidates, where)
    scored = hits.select("query_id", "rowid", "rk", F.col("score").alias("combined"), F.lit("vector").alias("match_type"))
    return scored.join(units, "rowid")


def hybrid(units: DataFrame, queries: Queries, vectors: DataFrame, config: SearchConfig, where: Column | None = None, index: lexical.Index | None = None) -> DataFrame:
    """The fused rows of each query; a query without words has its vector hits alone."""
    fts = _fts(units, [q for q in queries if query_phrases(q[1])], config, where, index)
    near = similarity.search_vector(units, vectors, config.candidates, where)
    return fusion.top_fused(fusion.fuse(fts, near, config.rrf_k), units, config.limit)


def search_many(units: DataFrame, queries: Queries, config: SearchConfig, embedder: Embedder | None = None, query_vectors: DataFrame | None = None, where: Column | None = None, index: lexical.Index | None = None) -> DataFrame:
    """Shaped results of each query (query_id, text) by the modes that the configuration asks for.

    Without an embedder, or where it fails, hybrid searches are lexical and vector searches
    empty. A limit of 0, or no mode at all, gives no rows. With a stored ``index``, words are looked up there.
    """
    vectors = query_vectors
    if config.use_vector and vectors is None and embedder is not None:
        try:
            made = embedder.embed_batch([text for _, text in queries])
            vectors = similarity.query_vectors(units.sparkSession, list(zip([q for q, _ in queries], made, strict=True)))
        except Exception:  # any embedder may fail in its own way
            log.warning("the embedder failed; searching without vectors", exc_info=True)
    with_vectors = config.use_vector and vectors is not None
    if config.limit <= 0 or not (config.use_fts or with_vectors):
        ranked = _lexical(units, [], config, F.lit(False))
    elif config.use_fts and with_vectors:
        ranked = hybrid(units, queries, vectors, config, where, index)
    elif config.use_fts:
        ranked = _lexical(units, queries, config, where, index)
    else:
        ranked = _vector(units, vectors, config, where)
    return fusion.shape_results(ranked, config)


def search(units: DataFrame, query: str, config: SearchConfig | None = None, embedder: Embedder | None = None, repo: str | None = None, branch: str | None = None, index: lexical.Index | None = None) -> DataFrame:
    """One query over one repository and branch (statistics stay those of the whole index)."""
    where = None
    if repo is not None:
        where = (F.col("repo_id") == repo) & (F.col("branch") == branch)
    return search_many(units, [(0, query)], config or SearchConfig(), embedder, where=where, index=index).drop("query_id").orderBy("rk")

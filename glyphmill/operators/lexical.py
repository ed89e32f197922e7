"""Full-text search: a stored inverted index, phrase matches, corpus statistics and weighted BM25.

The index has one row for each token occurrence, sorted by token in every file, so a search reads
the row groups of its tokens alone; without one, tokens are filtered by what queries ask for in
the task that splits the text. Either way what is shuffled is the matches, not the corpus. A
phrase of m tokens occurs where its m offsets meet at one start, so one aggregation finds all
phrases of all queries, and how many rows have a phrase is counted with partial sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions.text import query_phrases, token_count, tokens
from glyphmill.schema import FIELD_WEIGHTS

K1, B = 1.2, 0.75
#: Decimal places of scores, so that equal scores are ties however their sums were ordered.
PLACES = 10
#: Query terms up to this number are sent to every task.
BROADCAST_TERMS = 50_000
_TERMS = pa.schema([("query_id", pa.int64()), ("phrase_id", pa.int32()), ("offset", pa.int32()), ("token", pa.string()), ("n_tokens", pa.int32()), ("n_phrases", pa.int32())])


def query_terms(spark: SparkSession, queries: list[tuple[int, str]]) -> Terms:
    """One row for each token of each phrase of each query; queries without tokens give none."""
    rows = []
    for query_id, text in queries:
        phrases = query_phrases(text)
        rows += [(query_id, p, o, t, len(ph), len(phrases)) for p, ph in enumerate(phrases) for o, t in enumerate(ph)]
    # An Arrow table becomes a local relation: no job runs to broadcast it.
    columns = zip(*rows, strict=True) if rows else [[]] * len(_TERMS)
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TERMS, strict=True)], schema=_TERMS)
    return Terms(spark.createDataFrame(table), sorted({r[3] for r in rows}), len({r[:2] for r in rows}))


@dataclass
class Terms:
    """The queries' terms as a frame, their distinct tokens, and the number of phrases."""

    rows: DataFrame
    tokens: list[str]
    phrases: int


def with_tokens(units: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``units`` with token arrays tok_<field> and the length n_tok over all weighted fields."""
    fields = weights or FIELD_WEIGHTS
    out = units.select("*", *[tokens(F.col(f)).alias(f"tok_{f}") for f in fields])
    return out.withColumn("n_tok", sum((F.size(f"tok_{f}") for f in fields), F.lit(0)).cast("long"))


def postings(units: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The inverted index: rowid, field, token, pos."""
    fields = weights or FIELD_WEIGHTS
    arrays = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("found")) for f in fields])
    flat = units.select("rowid", F.explode(arrays).alias("f"))
    return flat.select("rowid", F.col("f.field").alias("field"), F.posexplode("f.found").alias("pos", "token"))


def corpus_stats(units: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """n_docs, total_tokens and avg_len over all rows of the index; tokens are counted, not kept."""
    lengths = units.select(sum((token_count(F.col(f)) for f in weights or FIELD_WEIGHTS), F.lit(0)).cast("long").alias("n_tok"))
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n_tok"), F.lit(0)).cast("long").alias("total_tokens"), F.avg("n_tok").alias("avg_len"))


def document_frequency(units: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """token, n_docs and n_occurrences over all fields; a row's distinct tokens are found in its task, so one aggregation does."""
    found = F.flatten(F.array(*[tokens(F.col(f)) for f in weights or FIELD_WEIGHTS]))
    once = F.transform(F.array_distinct("found"), lambda t: F.struct(t.alias("token"), F.lit(1).alias("row"), F.lit(0).alias("n")))
    each = F.transform("found", lambda t: F.struct(t.alias("token"), F.lit(0).alias("row"), F.lit(1).alias("n")))
    flat = units.select(found.alias("found")).select(F.explode(F.concat(once, each)).alias("t"))
    return flat.groupBy("t.token").agg(F.sum("t.row").alias("n_docs"), F.sum("t.n").alias("n_occurrences"))


@dataclass
class Index:
    """The stored form: postings (token, rowid, field, pos, n_tok) and lengths (rowid, n_tok) of every row."""

    postings: DataFrame
    lengths: DataFrame

    def stats(self) -> DataFrame:
        """n_docs and avg_len over all rows."""
        return self.lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_tok").alias("avg_len"))


def build_index(units: DataFrame, fields: dict[str, float] | None = None) -> Index:
    """The inverted index of the fields' tokens, to be written as it is or searched at once."""
    tokenized = with_tokens(units, fields)
    found = _positions(tokenized, dict.fromkeys(fields or FIELD_WEIGHTS, 1.0)).drop("weight")
    return Index(found.select("token", "rowid", "field", "pos", "n_tok").sortWithinPartitions("token", "rowid", "field", "pos"), tokenized.select("rowid", "n_tok"))


def _positions(tokenized: DataFrame, weights: dict[str, float]) -> DataFrame:
    """rowid, n_tok, weight, field, pos, token of all tokens, within the tasks that hold the rows."""
    if len(weights) == 1:
        ((field, weight),) = weights.items()
        return tokenized.select("rowid", "n_tok", F.lit(weight).alias("weight"), F.lit(field).alias("field"), F.posexplode(f"tok_{field}").alias("pos", "token"))
    arrays = F.array(*[F.struct(F.lit(w).alias("weight"), F.lit(f).alias("field"), F.col(f"tok_{f}").alias("found")) for f, w in weights.items()])
    flat = tokenized.select("rowid", "n_tok", F.explode(arrays).alias("f"))
    return flat.select("rowid", "n_tok", "f.weight", "f.field", F.posexplode("f.found").alias("pos", "token"))


def _matches(flat: DataFrame, terms: Terms) -> DataFrame:
    """query_id, phrase_id, rowid, n_tok, n_phrases and the weighted count of each phrase in each row, from token places."""
    # Said here for every use of the matches: a later join on rowid would say it of one alone, and the texts were split once a use.
    flat = flat.where("rowid is not null")
    if len(terms.tokens) <= BROADCAST_TERMS:
        joined = flat.where(F.col("token").isin(terms.tokens)).join(F.broadcast(terms.rows), "token")
    else:
        joined = flat.join(terms.rows, "token")
    starts = joined.groupBy("query_id", "phrase_id", "rowid", "n_tok", "field", "weight", "n_tokens", "n_phrases", (F.col("pos") - F.col("offset")).alias("start")).agg(F.count(F.lit(1)).alias("met"))
    whole = starts.where(F.col("met") == F.col("n_tokens"))
    return whole.groupBy("query_id", "phrase_id", "rowid", "n_tok", "n_phrases").agg(F.sum("weight").alias("freq"))


def phrase_matches(tokenized: DataFrame, terms: Terms, weights: dict[str, float] | None = None) -> DataFrame:
    """``_matches`` of frames with token arrays."""
    return _matches(_positions(tokenized, weights or FIELD_WEIGHTS), terms)


def _scored(found: DataFrame, stats: DataFrame, terms: Terms) -> DataFrame:
    """query_id, rowid and bm25 of every row that has all phrases of a query; lower is better."""
    # Rows with a phrase are counted by partial sums, one row a phrase, and sent back to the matches.
    n_rows = found.groupBy("query_id", "phrase_id").agg(F.count(F.lit(1)).alias("n_rows"))
    few = terms.phrases <= BROADCAST_TERMS
    # One row of statistics, so the product is the matches themselves.
    scored = found.join(F.broadcast(n_rows) if few else n_rows, ["query_id", "phrase_id"]).crossJoin(F.broadcast(stats))
    raw_idf = F.log((F.col("n_docs") - F.col("n_rows") + 0.5) / (F.col("n_rows") + 0.5))
    idf = F.when(raw_idf <= 0, F.lit(1e-6)).otherwise(raw_idf)
    part = idf * F.col("freq") * (K1 + 1) / (F.col("freq") + K1 * (1 - B + B * F.col("n_tok") / F.col("avg_len")))
    total = scored.withColumn("part", part).groupBy("query_id", "rowid", "n_phrases").agg(F.sum("part").alias("relevance"), F.count(F.lit(1)).alias("met"))
    return total.where(F.col("met") == F.col("n_phrases")).select("query_id", "rowid", (-F.col("relevance")).alias("bm25"))


def bm25(tokenized: DataFrame, terms: Terms, weights: dict[str, float] | None = None) -> DataFrame:
    """query_id, rowid and bm25 of every row that has all phrases of a query; lower is better.

    Row counts, phrase frequencies and the mean length are those of all rows given, so a filter
    on repository and branch belongs after this.
    """
    return _scored(phrase_matches(tokenized, terms, weights), corpus_stats(tokenized, weights).select("n_docs", "avg_len"), terms)


def fts_score(raw: Column) -> Column:
    """A score that grows with relevance: m / (1 + m) of m = |bm25|."""
    return F.abs(raw) / (F.lit(1.0) + F.abs(raw))


def reference_fts_score(raw: Column) -> Column:
    """1 / (1 + |bm25|), which falls with relevance; for comparisons only."""
    return F.lit(1.0) / (F.lit(1.0) + F.abs(raw))


def top_rows(scored: DataFrame, k: int, score: Column, ascending: bool = False, tie: str = "rowid") -> DataFrame:
    """The k best rows of each query with their rank; Catalyst limits each group before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(score.asc() if ascending else score.desc(), F.col(tie))
    return scored.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def search_index(index: Index, queries: list[tuple[int, str]], k: int, rows: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """``search_fts`` over a stored index; ``rows`` (rowid) limits the hits, not the statistics."""
    terms = query_terms(index.postings.sparkSession, queries)
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in (weights or FIELD_WEIGHTS).items() for x in pair]), F.col("field"))
    flat = index.postings.withColumn("weight", weight).where("weight is not null")
    return _top(_scored(_matches(flat, terms), index.stats(), terms), k, rows)


def _top(scored: DataFrame, k: int, rows: DataFrame | None) -> DataFrame:
    rounded = scored.withColumn("bm25", F.round("bm25", PLACES))
    if rows is not None:
        rounded = rounded.join(rows.select("rowid"), "rowid", "left_semi")
    return top_rows(rounded, k, F.col("bm25"), ascending=True).select("query_id", "rowid", "bm25", "rk")


def search_fts(units: DataFrame, queries: list[tuple[int, str]], k: int, where: Column | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """query_id, rowid, bm25 (to PLACES) and rk of the k best rows of each query under ``where``."""
    terms = query_terms(units.sparkSession, queries)
    return _top(bm25(with_tokens(units, weights), terms, weights), k, None if where is None else units.where(where))

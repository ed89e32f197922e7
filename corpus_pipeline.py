"""The corpus pipeline: quality, near duplicates, repeated passages, source mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. A null or empty text passes the first stage with the neighbours'
prior, is one group of near duplicates with other blank texts, has nothing to cut, adds no words
to the mix (where it is emitted at its source's rate), and encodes to no ids. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import bpe, mixing, quality, simhash, suffixes
from glyphmill.llm.common import checkpointed, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labelled rows of ``sf_dir``."""
    return quality.keep_good(docs, quality.fitted(spark, sf_dir))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, by the operator's own radius.

    It is the row of smallest doc_id (null ids last), ties by the text's hash, then by a row number. Rows
    that repeat an id are rows of their own: equal texts leave one, different texts each count in their own group.
    """
    row = "_row"
    while row in docs.columns:
        row = f"_{row}"
    # The row numbers are written once, so that both readers see the same ones.
    rows = checkpointed(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = simhash.near_duplicates(rows, id_col=row).select(F.col("doc_id").alias("of_row"), F.col("component_id").alias("of_group"))
    order = rows.select(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col(row).alias("kept")).alias("o"))
    first = order.join(groups, F.col("o.kept") == F.col("of_row")).groupBy("of_group").agg(F.min("o").alias("o")).select("o.kept")
    return rows.join(first, rows[row] == first.kept, "left_semi").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that a document of smaller id has too; n_chars counts what is left."""
    return suffixes.remove_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights ask for."""
    return mixing.mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded (the text that the ids give) of every emitted document."""
    coded = bpe.round_trip(docs)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", one_of_each_group),
    ("suffix_dedup", cut_repeats),
    ("mix", mix),
    ("bpe", encode),
]

#: The classifier, the fingerprints and the tokenizer cannot be said in SQL; the tests hold the
#: pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs

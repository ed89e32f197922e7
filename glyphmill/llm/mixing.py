"""Mixing sources to target weights, with DataFrame functions only.

A source's target is its weighted share of all words, but at most ``max_repeats`` times the
words it has; what capped sources leave goes to the others by weight. This is a water level:
in ascending order of cap / weight, sources are capped for as long as the level that the rest
would get is not below their cap. Each document is then emitted floor(rate) times, and once
more where a hash of its id, seen as a number in [0, 1), lies under the rest of the rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import WORD

#: Sources up to this number are sent to every task (about 100 bytes each); more are joined on salted keys.
BROADCAST_SOURCES = 50_000
SALTS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(doc_id: Column, seed: int) -> Column:
    """The first 32 bits of an md5 of seed and id as a fraction; null ids count as empty."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """One row a source: source, source_size, target. The input has source and size.

    Only one row a source passes through the windows, so their single partition holds no documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("place").asc())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    place = (F.col("place") - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")).cast("long")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = (
        sources.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("rest").cast("double") / F.col("rest_weight").cast("double"))
        .withColumn("open", F.col("cap").cast("double") > F.col("weight") * F.col("level"))
    )
    level = F.min(F.when(F.col("open"), F.struct("cap_rank", "level"))).over(everything)["level"]
    return (
        ranked.withColumn("cap_rank", F.row_number().over(by_cap))
        .withColumn("water", level)
        .select(
            "source",
            "source_size",
            F.when(F.col("open"), F.col("weight") * F.col("water")).otherwise(F.col("cap").cast("double")).alias("target"),
        )
    )


def mix_plan(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    seed: int = 7,
    max_repeats: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row a document: doc_id, the columns of ``keep``, source, size, source_size, target, copies.

    Null texts and texts without words have size 0, and are emitted at the rate of their source; a
    source without any word has rate 0. A null source is a source of its own, last in the order of names. Rows that share an id share the draw. An empty table gives
    an empty plan. Other columns of the input are ignored.
    """
    carried = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), carried.alias("carried"))
    targets = source_targets(sized.select("source", "size"), weights, max_repeats)
    known = docs.select(F.col(source_col).alias("source")).distinct()
    if known.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        right = targets.withColumnRenamed("source", "of_source")
        joined = sized.join(F.broadcast(right), F.col("source").eqNullSafe(F.col("of_source")), "left")
    else:
        right = targets.withColumnRenamed("source", "of_source").withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = salted.join(right, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("salt") == F.col("of_salt")), "left")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeats)))).otherwise(0.0)
    drawn = (unit_hash(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("rate", rate).select(
        "doc_id", *[F.col(f"carried.{c}").alias(f"kept_{c}") for c in keep], "source", "size", "source_size", "target", (F.floor("rate") + drawn).alias("copies")
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, max_repeats: int = 3) -> DataFrame:
    """The mixed corpus: every row of ``docs``, with all its columns, as many times as the plan says."""
    plan = mix_plan(docs, weights, seed, max_repeats, keep=tuple(docs.columns))
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    emitted = plan.where("copies > 0").select(*[F.col(f"kept_{c}").alias(c) for c in docs.columns], copies.alias("_copy"))
    return emitted.drop("_copy")


def op2(spark, sf_dir: str) -> DataFrame:
    plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_CORE = r"""
sized AS (
  SELECT {keep}, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), placed AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM sources
), weighted AS (
  SELECT *, ((place - 1) % 3 + 1)::BIGINT AS weight, source_size * 3 AS cap FROM placed
), levels AS (
  SELECT *, row_number() OVER by_cap AS cap_rank,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM weighted
  WINDOW by_cap AS (ORDER BY cap / weight, place),
         before AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), opened AS (
  SELECT *, cap::DOUBLE > weight * level AS open FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN open THEN weight * (SELECT arg_min(level, cap_rank) FROM opened WHERE open) ELSE cap::DOUBLE END AS target FROM opened
), rated AS (
  SELECT s.*, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), planned AS (
  SELECT *, (floor(rate) + CASE WHEN ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated
)"""

ORACLE = (
    "WITH "
    + ORACLE_CORE.format(keep="doc_id", docs="documents")
    + "\nSELECT doc_id, size, source_size, target, copies * size AS taken FROM planned"
)

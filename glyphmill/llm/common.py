"""What several operators share: word rules, folds, batching and checkpoints."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder is kept; one is made only where none is set and all runs in one process (local tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="glyphmill-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Write once to the shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of one Arrow batch between the JVM and Python, at most: texts are long, and a task holds several batches.
ARROW_BYTES = 16 << 20


def bounded_batches(df: DataFrame) -> SparkSession:
    """The frame's session, with its Arrow batches held to ARROW_BYTES (a lower setting stays)."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, None)
    if held is None or not held.rstrip("b").isdigit() or int(held.rstrip("b")) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))
    return spark


def hand_back() -> None:
    """Give the system what this process has freed; a Python worker lives on after its task, beside other ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with the memory of its task handed back at the end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            hand_back()

    return whole


def tidy_group(run: Callable[[pa.Table], pa.Table], least: int = 4 << 20) -> Callable[[pa.Table], pa.Table]:
    """``run`` for applyInArrow, with the memory of each group of ``least`` bytes or more handed back."""

    def whole(rows: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        large, out = rows.nbytes >= least, run(rows)
        if large:
            del rows
            hand_back()
        return out

    return whole


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) leaves 0 modulo 5; they are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def text_column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    """A column of texts as one large_string array (64-bit offsets)."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    return column


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and n + 1 offsets; a null text is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def small_slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of text (a longer text comes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = byte_view(text_column(batch, text))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


#: Texts of more bytes are left out of the labelled samples (they are scored like all others); with the rows of a sample this bounds what the driver holds.
LONGEST_TRAINING_TEXT = 50_000


#: Classes whose hash thresholds are spelt out in the plan, at most; more come by a join.
SPELT_CLASSES = 64


def class_sample(rows: DataFrame, per_class: int, salt: str, most_classes: int | None = 64, most_rows: int | None = None, most_chars: int | None = None) -> DataFrame:
    """At most ``per_class`` rows of each of the most frequent labels, none held out.

    ``most_classes`` None takes every label. With ``most_rows``, ``per_class`` shrinks as labels
    grow, so that no more rows than that are taken, but never below one row a label. With
    ``most_chars``, each row's text is cut so that all of them together have no more characters.
    ``rows`` has doc_id and label and may have more; null labels are left out. Rows are taken by
    the smallest hashes of their ids, so the sample does not depend on order or partitions. A
    hash threshold leaves about twice the sample of each class before anything is ranked.
    """
    usable = rows.where(~held_out(F.col("doc_id")) & F.col("label").isNotNull())
    counts = usable.groupBy("label").count()
    counted = (counts if most_classes is None else counts.orderBy(F.col("count").desc(), "label").limit(most_classes)).collect()
    if most_rows is not None:
        per_class = max(1, min(per_class, most_rows // max(len(counted), 1)))
    scale = 1 << 30
    most = [(found["label"], int(min(1.0, (2 * per_class + 50) / found["count"]) * scale)) for found in counted]
    hashed = usable.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(scale)))
    if len(most) <= SPELT_CLASSES:
        within = F.lit(False)
        for label, h in most:
            within = within | ((F.col("label") == F.lit(label)) & (F.col("h") <= h))
        hashed = hashed.where(within)
    else:
        kind = rows.schema["label"].dataType.simpleString()
        limits = rows.sparkSession.createDataFrame(most, f"label {kind}, most_h long")
        hashed = hashed.join(F.broadcast(limits), "label").where("h <= most_h").drop("most_h").select(hashed.columns)
    order = Window.partitionBy("label").orderBy("h", "doc_id")
    taken = hashed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_class).drop("h", "place")
    if most_chars is None:
        return taken
    rows_at_most = sum(min(found["count"], per_class) for found in counted)
    return taken.withColumn("text", F.substring("text", 1, max(most_chars // max(rows_at_most, 1), 1)))


def texts_and_labels(rows: DataFrame, longest: int | None = None) -> list[tuple[str, object]]:
    """The (text, label) pairs of a bounded sample, in an order of their own; with ``longest``, of texts of no more bytes."""
    usable = rows.where(F.col("text").isNotNull() & (F.lit(True) if longest is None else F.octet_length("text") <= longest))
    return sorted(((r["text"], r["label"]) for r in usable.select("text", "label").collect()), key=lambda r: (str(r[1]), r[0]))


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int) -> list[tuple[str, int]]:
    """A bounded sample of (text, label): labelled ids are sampled first and sent to the texts.

    At most 2 * ``per_class`` ids are broadcast. Labels of unknown or null ids and null labels
    are left out. An id on several rows of labels counts once if they agree, and not at all if they don't.
    """
    every = labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
    marked = every.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    picked = class_sample(marked, per_class, label_col, 2).withColumnRenamed("doc_id", "labelled_id")
    texts = docs.select("doc_id", "text")
    return texts_and_labels(texts.join(F.broadcast(picked), texts.doc_id == picked.labelled_id), LONGEST_TRAINING_TEXT)

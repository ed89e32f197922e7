"""Streaming ingestion: micro-batches written under their number, so a batch that comes twice replaces itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions.ids import content_hash


def stream_files(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """A Parquet file or folder as a stream."""
    if path.endswith(".parquet"):
        folder, _, name = path.rpartition("/")
        # A folder of part files is read as such; a single file by its name in its folder.
        single = not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(path)).isDirectory()
        if single:
            return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).parquet(path)


def ingest_available(spark: SparkSession, schema: T.StructType, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Streams what is there through ``foreachBatch`` once; n_rows and n_hashes of what was taken in."""
    import uuid

    name = f"ingest_{uuid.uuid4().hex[:12]}"
    hashed = stream_files(spark, schema, path).select(F.col(key).alias("key"), content_hash(F.col(text)).alias("hash"))
    parts: list[str] = []

    def take(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(["key", "hash"])
        view = f"{name}_{number}"
        folder = _folder(batch.sparkSession, view)
        fresh.write.mode("overwrite").parquet(folder)
        parts.append(folder)

    running = hashed.writeStream.foreachBatch(take).trigger(availableNow=True).option("checkpointLocation", _folder(spark, f"{name}_state")).start()
    running.awaitTermination()
    taken = spark.read.schema("key long, hash string").parquet(*parts) if parts else spark.createDataFrame([], "key long, hash string")
    return taken.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("hash").alias("n_hashes"))


def _folder(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint folder; under a temporary one only where none is set and all runs in one process."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local-cluster") and spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="glyphmill-stream-")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base}/{name}"

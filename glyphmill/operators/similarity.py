"""Exact vector search in blocks, and approximate ones: an inverted-file index of measured recall, and hyperplane buckets.

Exact search sends the queries to the rows; each task multiplies its rows with them in one
product and gives on only the best rows that it has for each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions.vectors import cosine_similarity

#: Query vectors up to this number are sent to every task; more are searched in blocks of about half of it.
BROADCAST_QUERIES = 2_000


def query_vectors(spark: SparkSession, queries: list[tuple[int, list[float]]]) -> DataFrame:
    return spark.createDataFrame([(q, [float(x) for x in v]) for q, v in queries], "query_id long, query_vector array<float>")


def cosine_scores(units: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, rowid, name and score of every unit with a vector for every query."""
    count = queries.count()
    blocks = 1 if count <= BROADCAST_QUERIES else -(-2 * count // BROADCAST_QUERIES)
    rows = units.where("embedding is not null").select("rowid", "name", "embedding")
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    parts = [queries if blocks == 1 else queries.where(block == k) for k in range(blocks)]
    pairs = reduce(DataFrame.union, [rows.join(F.broadcast(part), F.size("query_vector") >= 0) for part in parts])
    return pairs.select("query_id", "rowid", "name", cosine_similarity(F.col("embedding"), F.col("query_vector")).alias("score"))


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    """Vectors of one length as unit rows of doubles; zero vectors stay zero, other lengths are an error."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != wide).any():
        raise ValueError(f"embedding dimension mismatch: {int(lengths[lengths != wide][0])} and {wide}")
    rows = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), wide)
    norms = np.sqrt((rows**2).sum(axis=1, keepdims=True))
    return rows / np.where(norms > 0, norms, 1)


def _best(scores: np.ndarray, rowids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller row ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((rowids[near], -scores[near]))[:k]]


def _local_top(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rowid and score (to 6 places) of the k best rows of each Arrow batch for each of a bounded number of queries."""
    given = queries.select(F.col("query_id").cast("long").alias("query_id"), "query_vector").toArrow().combine_chunks()
    vectors = given.column("query_vector").combine_chunks() if len(given) else pa.array([], pa.list_(pa.float32()))
    if not len(given) or k <= 0:
        return rows.sparkSession.createDataFrame([], "query_id long, rowid long, score double")
    wide = len(vectors[0])
    sent = rows.sparkSession.sparkContext.broadcast((given.column("query_id").to_numpy(), _matrix(vectors, wide), wide))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit, wide = sent.value
        for batch in batches:
            rowids = batch.column(0).to_numpy(zero_copy_only=False)
            scores = np.round(_matrix(batch.column(1), wide) @ unit.T, 6) + 0.0
            places = [_best(scores[:, q], rowids, k) for q in range(len(ids))]
            sizes = [len(p) for p in places]
            found = [scores[p, q] for q, p in enumerate(places)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(rowids[np.concatenate(places)]), pa.array(np.concatenate(found))], ["query_id", "rowid", "score"])

    return rows.select(F.col("rowid").cast("long").alias("rowid"), "embedding").mapInArrow(run, "query_id long, rowid long, score double")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("rowid"))
    return scored.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).select("query_id", "rowid", "score", "rk")


def search_vector(units: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """query_id, rowid, score (to 6 places) and rk of the k nearest units of each query; ties by rowid."""
    rows = (units if where is None else units.where(where)).where("embedding is not null")
    count = queries.count()
    blocks = 1 if count <= BROADCAST_QUERIES else -(-2 * count // BROADCAST_QUERIES)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    parts = [queries if blocks == 1 else queries.where(block == b) for b in range(blocks)]
    return _ranked(reduce(DataFrame.union, [_local_top(rows, part, k) for part in parts]), k)


class _Best:
    """The k best rows of each query among all that were offered, by score (to 6 places) and then by row id.

    Scores that are no numbers never enter. Memory is k places a query and about as many rows that wait.
    """

    def __init__(self, queries: int, k: int) -> None:
        self.score = np.full((queries, k), -np.inf)
        self.rowid = np.full((queries, k), np.iinfo(np.int64).max)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def offer(self, asked: np.ndarray, scores: np.ndarray, rowids: np.ndarray) -> None:
        """Scores of rows (across) for the queries at the places ``asked`` (down)."""
        of, row = np.nonzero(scores >= (self.score[asked, -1] - 1e-6)[:, None])
        query, score, rowid = asked[of], np.round(scores[of, row], 6) + 0.0, rowids[row]
        least = self.score[query, -1]
        enters = (score > least) | ((score == least) & (rowid < self.rowid[query, -1]))
        self.waiting.append((query[enters], score[enters], rowid[enters]))
        self.rows += int(enters.sum())
        if self.rows > max(self.score.size, 1 << 16):
            self.settle()

    def settle(self) -> None:
        held = np.nonzero(self.score > -np.inf)
        query, score, rowid = (np.concatenate(x) for x in zip((held[0], self.score[held], self.rowid[held]), *self.waiting, strict=True))
        order = np.lexsort((rowid, -score, query))
        query, score, rowid = query[order], score[order], rowid[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.score.shape[1]
        self.score[query[kept], place[kept]], self.rowid[query[kept], place[kept]] = score[kept], rowid[kept]
        self.waiting, self.rows = [], 0

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        self.settle()
        held = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(self.rowid[held]), pa.array(self.score[held])], ["query_id", "rowid", "score"])


#: Vectors that the lists of an index are fitted on, lists, and queries that its recall is measured with, at most.
INDEX_SAMPLE, LISTS, TRIAL_QUERIES = 20_000, 1024, 200
#: Queries of an index that are sent to every task at once, bytes of their vectors, and scores of one product, at most.
INDEX_QUERIES, INDEX_BYTES, PRODUCT = 16_384, 1 << 26, 1 << 22


def _sampled(rows: DataFrame) -> pa.Table:
    """The INDEX_SAMPLE rows (rowid, embedding) of the smallest hashes of row ids; of many rows, only those that may be among them are sorted."""
    count, key = rows.count(), F.xxhash64("rowid")
    first = lambda some: some.orderBy(key, "rowid").limit(INDEX_SAMPLE).toArrow().combine_chunks()
    if count > 2 * INDEX_SAMPLE:
        taken = first(rows.where(key < -(2**63) + 2**64 * 3 * INDEX_SAMPLE // (2 * count)))
        if len(taken) == INDEX_SAMPLE:
            return taken
    return first(rows)


@dataclass
class VectorIndex:
    """An inverted file: every vector belongs to the list of its nearest center; a search reads the ``probes`` nearest lists."""

    centers: np.ndarray
    probes: int
    measured_recall: float

    @classmethod
    def fit(cls, units: DataFrame, target: float = 0.95, k: int = 10, most_lists: int = LISTS) -> VectorIndex:
        """Centers from a sample of at most INDEX_SAMPLE vectors (by hashes of their row ids), and as many probes as
        trial queries of that sample need for a mean recall at k of ``target`` within it."""
        rows = units.where("embedding is not null").select(F.col("rowid").cast("long").alias("rowid"), "embedding")
        taken = _sampled(rows)
        if not len(taken):
            return cls(np.zeros((1, 1)), 1, 1.0)
        column = taken.column("embedding").combine_chunks()
        sample = _matrix(column, len(column[0]))
        sample = sample[np.isfinite(sample).all(axis=1)]
        if not len(sample):
            return cls(np.zeros((1, len(column[0]))), 1, 1.0)
        rng = np.random.default_rng(0)
        lists = min(most_lists, max(1, int(len(sample) ** 0.5)))
        centers = sample[rng.choice(len(sample), lists, replace=False)]
        for _ in range(8):
            of = (sample @ centers.T).argmax(axis=1)
            total = np.zeros_like(centers)
            np.add.at(total, of, sample)
            norms = np.sqrt((total**2).sum(axis=1, keepdims=True))
            centers = np.where(norms > 0, total / np.where(norms > 0, norms, 1), centers)
        of = (sample @ centers.T).argmax(axis=1)
        trial = rng.choice(len(sample), min(TRIAL_QUERIES, len(sample)), replace=False)
        # The rank of the list that holds each of a trial query's true neighbours: with that many probes it is found.
        ranks = []
        for q in trial.tolist():
            scores = sample @ sample[q]
            scores[q] = -2
            true = np.argsort(-scores, kind="stable")[: min(k, len(sample) - 1)]
            ranks.append(np.argsort(np.argsort(-(centers @ sample[q]), kind="stable"))[of[true]])
        every = np.concatenate(ranks) if ranks else np.zeros(1, np.int64)
        recalls = [(every < n).mean() if len(every) else 1.0 for n in range(1, lists + 1)]
        probes = next((n for n, r in enumerate(recalls, 1) if r >= target), lists)
        return cls(centers, probes, float(recalls[probes - 1]))

    def assign(self, units: DataFrame) -> DataFrame:
        """rowid, embedding and list of every unit with a vector; to be written, bucketed or partitioned by list."""
        rows = units.where("embedding is not null").select(F.col("rowid").cast("long").alias("rowid"), "embedding")
        sent = rows.sparkSession.sparkContext.broadcast(self.centers)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centers = sent.value
            for batch in batches:
                if len(batch):
                    of = (_matrix(batch.column(1), centers.shape[1]) @ centers.T).argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(of.astype(np.int32))], ["rowid", "embedding", "list"])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())]))

    def search(self, assigned: DataFrame, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query_id, rowid, score and rk: the k nearest units of each query among the lists that it probes, scored exactly.

        Rows are dealt evenly, by id and not by list, and queries go to them in blocks: a task multiplies the rows of each list
        with the queries that probe it and gives on the k best that it has for each query. So no pair of a row and a query
        becomes a row of Spark's. Vectors that are null or not finite take no part.
        """
        asked = queries.where("query_vector is not null").select(F.col("query_id").cast("long").alias("query_id"), "query_vector")
        count = asked.count()
        if not count or k <= 0:
            return _ranked(assigned.sparkSession.createDataFrame([], "query_id long, rowid long, score double"), k)
        most = max(1, min(INDEX_QUERIES, INDEX_BYTES // (8 * self.centers.shape[1])))
        blocks = 1 if count <= most else -(-2 * count // most)
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        parts = [asked if blocks == 1 else asked.where(block == b) for b in range(blocks)]
        dealt = assigned.select("rowid", "embedding", "list").repartition(max(8, 2 * assigned.sparkSession.sparkContext.defaultParallelism), "rowid")
        return _ranked(reduce(DataFrame.union, [self._local_top(dealt, part, k, probes or self.probes) for part in parts]), k)

    def _local_top(self, assigned: DataFrame, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """query_id, rowid and score (to 6 places) of the k best rows of each task for each of a bounded number of queries."""
        given = queries.toArrow().combine_chunks()
        wide = self.centers.shape[1]
        vectors = given.column("query_vector").combine_chunks() if len(given) else pa.array([], pa.list_(pa.float64()))
        unit = _matrix(vectors, wide)
        near = np.argsort(-(unit @ self.centers.T), axis=1, kind="stable")[:, :probes]
        sent = assigned.sparkSession.sparkContext.broadcast((given.column("query_id").to_numpy(), unit, near.astype(np.int32), len(self.centers)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, unit, near, lists = sent.value
            probing = [np.zeros(0, np.int64)] * lists
            order = np.argsort(near, axis=None, kind="stable")
            for of in np.split(order, np.flatnonzero(np.diff(near.ravel()[order])) + 1) if len(order) else []:
                probing[near.ravel()[of[0]]] = of // near.shape[1]
            best = _Best(len(ids), k)
            for batch in batches:
                rowids, rows = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), unit.shape[1])
                of = batch.column(2).to_numpy(zero_copy_only=False)
                order = np.argsort(of, kind="stable")
                for group in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []:
                    asked = probing[of[group[0]]]
                    vectors, step = unit[asked], max(1, PRODUCT // max(1, len(asked)))
                    for at in range(0, len(group) if len(asked) else 0, step):
                        part = group[at : at + step]
                        best.offer(asked, vectors @ rows[part].T, rowids[part])
            yield best.batch(ids)

        return assigned.mapInArrow(run, "query_id long, rowid long, score double")


def hyperplane_bucket(vector: Column, dimension: int, bits: int = 12, seed: int = 5) -> Column:
    """The side of ``bits`` random hyperplanes that a vector lies on, as one number."""
    planes = np.random.default_rng(seed).normal(size=(bits, dimension))
    total = F.lit(0)
    for k, plane in enumerate(planes):
        side = F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in plane]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
        total = total + F.when(side > 0, F.lit(1 << k)).otherwise(F.lit(0))
    return total


def search_vector_buckets(units: DataFrame, queries: DataFrame, k: int, dimension: int, bits: int = 8, tables: int = 6) -> DataFrame:
    """Approximate top-k: units that share a bucket with the query in one of several tables, scored exactly.

    Its recall is whatever the buckets give (0.16 at 10 was seen on random vectors of 64 components); ``VectorIndex`` measures its own.
    """
    keys = lambda v: F.explode(F.array(*[F.struct(F.lit(t).alias("t"), hyperplane_bucket(v, dimension, bits, 5 + t).alias("b")) for t in range(tables)]))
    left = units.where("embedding is not null").select("rowid", "embedding", keys(F.col("embedding")).alias("key"))
    right = queries.select("query_id", "query_vector", keys(F.col("query_vector")).alias("key"))
    pairs = left.join(right, "key").dropDuplicates(["query_id", "rowid"])
    scored = pairs.select("query_id", "rowid", F.round(cosine_similarity(F.col("embedding"), F.col("query_vector")), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("rowid"))
    return scored.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)

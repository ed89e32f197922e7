"""Exact top-k inner products by pivot-table elimination.

For a query q and a candidate x, every pivot p gives |d(q,p) - d(x,p)| <= d(q,x), and
2 q.x = |q|^2 + |x|^2 - d(q,x)^2, so the largest of these lower bounds on the distance is an
upper bound on the score. The pivot table (every candidate's distance to every pivot) is
computed once and written beside the packed vectors, in blocks by nearest pivot. A block's
intervals of pivot distances first drop it for all queries that nothing in it can serve;
within a block, candidates are evaluated in the order of their bounds, a chunk at a time, until
no bound left reaches the k-th best score found. That score starts as the k-th best among a
sample of the candidates and rises from block to block. Bounds have a margin above their
rounding error; scores are exact integers.

Candidates are never shuffled or copied: queries go to them, in rounds of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import checkpointed, table, tidy

SCALE = 1024
#: Candidates with the smallest id hashes, whose scores give each query its first threshold; pivots are taken from them.
SAMPLE = 1024
PIVOTS = 32
#: Rows of a candidate block, and rows that a task holds before it writes blocks.
CANDIDATE_ROWS = 4096
HELD_ROWS = 16 * CANDIDATE_ROWS
#: Queries, and bytes of their vectors, that are sent to the tasks at once, about.
QUERY_ROWS = 16_384
QUERY_BYTES = 32 << 20
_EXACT = 2.0**53
_LONG = 2**63


def _matrix(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Integer components as doubles, short rows padded with 0, and the mask of usable rows."""
    usable = np.array([v is not None and all(x is not None and np.isfinite(x) for x in v) for v in vectors], bool)
    kept = [np.asarray(v, np.float64) for v, ok in zip(vectors, usable, strict=True) if ok]
    wide = max(map(len, kept), default=0)
    out = np.zeros((len(kept), wide))
    for row, v in zip(out, kept, strict=True):
        row[: len(v)] = np.floor(SCALE * v)
    return out, usable


def _arrow_matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``_matrix`` without a Python loop where all rows have one length."""
    if column.null_count or not len(column):
        return _matrix(column.to_pylist())
    flat, lengths = column.flatten(), np.diff(column.offsets.to_numpy())
    if flat.null_count or (lengths != lengths[0]).any():
        return _matrix(column.to_pylist())
    rows = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(column), int(lengths[0]))
    usable = np.isfinite(rows).all(axis=1)
    return np.floor(SCALE * rows[usable]), usable


def _widen(rows: np.ndarray, wide: int) -> np.ndarray:
    return rows if rows.shape[1] == wide else np.pad(rows, ((0, 0), (0, wide - rows.shape[1])))


def _exact(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as int64; past 2^53 by whole Python numbers, held within 64 bits."""
    if not rows.size or np.abs(q).max(initial=0) * np.abs(rows).max(initial=0) * rows.shape[1] < _EXACT:
        return (rows @ q).astype(np.int64)
    whole = [int(x) for x in q]
    sums = [sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in rows]
    return np.array([min(max(s, -_LONG), _LONG - 1) for s in sums], np.int64)


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first: each pivot is the sample's row that is farthest from those chosen before."""
    if not len(sample):
        return sample
    chosen = [0]
    far = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(most, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _gap(of_rows: np.ndarray, of_query: np.ndarray) -> np.ndarray:
    """A lower bound on each row's distance to the query, from their pivot distances (kept in 32 bits)."""
    low = np.abs(of_rows - of_query) - 1e-6 * (of_rows + of_query)
    return np.nan_to_num(low.max(axis=1, initial=0), nan=0, posinf=0).astype(np.float64)


def _bound(size: np.ndarray | float, gap: np.ndarray) -> np.ndarray:
    """The largest score at this |q|^2 + |x|^2 and at least this distance."""
    return np.nan_to_num((size - gap**2) / 2 + 1e-6 * size + 1, nan=np.inf)


class Search:
    """The best rows found so far for each of some queries; takes candidate blocks one by one."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, of_queries: np.ndarray, floors: np.ndarray, k: int):
        self.ids, self.queries, self.of_queries, self.k = ids, queries, of_queries, k
        self.norms = (queries**2).sum(axis=1)
        self.floors = floors.copy()
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        self.blocks = self.evaluated = 0

    def take(self, ids: np.ndarray, rows: np.ndarray, of_rows: np.ndarray) -> None:
        wide = max(self.queries.shape[1], rows.shape[1])
        rows, self.queries = _widen(rows, wide), _widen(self.queries, wide)
        norms = (rows**2).sum(axis=1)
        low, high = of_rows.min(axis=0), of_rows.max(axis=0)
        margin = 1e-6 * (high + self.of_queries)
        apart = np.maximum(low - self.of_queries, self.of_queries - high) - margin
        apart = np.nan_to_num(np.maximum(apart.max(axis=1, initial=0), 0), nan=0, posinf=0).astype(np.float64)
        self.blocks += len(self.ids)
        for at in np.flatnonzero(_bound(self.norms + norms.max(), apart) >= self.floors).tolist():
            self._evaluate(at, ids, rows, of_rows, norms)

    def _evaluate(self, at: int, ids: np.ndarray, rows: np.ndarray, of_rows: np.ndarray, norms: np.ndarray) -> None:
        k = self.k
        bound = _bound(self.norms[at] + norms, _gap(of_rows, self.of_queries[at]))
        left = np.flatnonzero((ids != self.ids[at]) & (bound >= self.floors[at]))
        best_ids, best = self.best[at]
        step = 4 * k
        while len(left):
            if len(left) > step:
                cut = np.argpartition(-bound[left], step)
                take, left = left[cut[:step]], left[cut[step:]]
            else:
                take, left = left, left[:0]
            self.evaluated += len(take)
            best_ids, best = np.concatenate((best_ids, ids[take])), np.concatenate((best, _exact(self.queries[at], rows[take])))
            order = np.lexsort((best_ids, -best.astype(object) if (best == -_LONG).any() else -best))[:k]
            best_ids, best = best_ids[order], best[order]
            if len(best) == k:
                self.floors[at] = max(self.floors[at], float(best[-1]))
                left = left[bound[left] >= self.floors[at]]
            step *= 2
        self.best[at] = best_ids, best


def _pack(ids: list[np.ndarray], rows: list[np.ndarray], far: list[np.ndarray]) -> pa.RecordBatch:
    wide = max(r.shape[1] for r in rows)
    matrix = np.concatenate([_widen(r, wide) for r in rows])
    small = bool(np.abs(matrix).max(initial=0) < 2**31)
    data = matrix.astype(np.int32 if small else np.float64).tobytes()
    values = ([np.concatenate(ids).astype(np.int64).tobytes()], [data], [np.concatenate(far).tobytes()])
    return pa.RecordBatch.from_arrays([*[pa.array(v, pa.binary()) for v in values], pa.array([wide], pa.int32()), pa.array([small])], ["ids", "data", "far", "wide", "small"])


def pivot_table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Blocks of usable rows near one pivot: ids, vectors, and their distances to all pivots, packed."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        sizes: dict[int, int] = {}
        for batch in batches:
            matrix, usable = _arrow_matrix(batch.column(1))
            if not len(matrix):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)[usable]
            wide = max(matrix.shape[1], sent.value.shape[1])
            far = _distances(_widen(matrix, wide), _widen(sent.value, wide)).astype(np.float32)
            cell = far.argmin(axis=1)
            for c in np.unique(cell).tolist():
                own = cell == c
                for column, value in zip(held.setdefault(c, ([], [], [])), (ids[own], matrix[own], far[own]), strict=True):
                    column.append(value)
                sizes[c] = sizes.get(c, 0) + int(own.sum())
                if sizes[c] >= CANDIDATE_ROWS:
                    yield _pack(*held.pop(c))
                    del sizes[c]
            while sum(sizes.values()) > HELD_ROWS:
                c = max(sizes, key=sizes.get)
                yield _pack(*held.pop(c))
                del sizes[c]
        # What is left is packed in whole blocks, cells beside their neighbours in number.
        rest: tuple[list, list, list] = ([], [], [])
        for c in sorted(held):
            for column, values in zip(rest, held[c], strict=True):
                column += values
            if sum(map(len, rest[0])) >= CANDIDATE_ROWS:
                yield _pack(*rest)
                rest = ([], [], [])
        if rest[0]:
            yield _pack(*rest)

    return rows.mapInArrow(tidy(run), "ids binary, data binary, far binary, wide int, small boolean")


def _floors(ids: np.ndarray, queries: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the sample; minus infinity where the sample has fewer others."""
    out = np.full(len(ids), -np.inf)
    wide = max(queries.shape[1], sample.shape[1]) if len(sample) else 0
    if wide and np.abs(queries).max(initial=0) * np.abs(sample).max(initial=0) * wide < _EXACT:
        queries, sample = _widen(queries, wide), _widen(sample, wide)
        for at in range(0, len(ids), 1024):
            scores = queries[at : at + 1024] @ sample.T
            scores[ids[at : at + 1024, None] == sample_ids[None]] = -np.inf
            if scores.shape[1] >= k > 0:
                out[at : at + 1024] = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    return out


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows of another
    id. Vectors that are null or hold null or non-finite components, and rows without an id,
    take no part; missing components of a shorter vector count as 0. An id on several rows gives
    candidates that tie, and one query for each of its rows' best scores together.
    An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where("vec_id is not null and embedding is not null")
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().combine_chunks()
    sample, usable = _arrow_matrix(taken.column("embedding").combine_chunks())
    sample_ids = taken.column("vec_id").to_numpy()[usable]
    # Rows that repeat a sampled id or vector are candidates of their own, so a threshold from the sample never is too high.
    pivots = choose_pivots(sample, PIVOTS)
    blocks = checkpointed(pivot_table(rows, pivots))
    # Equal queries are searched once; how many there are is put back at the end.
    asked = checkpointed(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "embedding").agg(F.count(F.lit(1)).alias("times")))
    count, components = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    rounds = max(1, -(-count // QUERY_ROWS), -(-8 * components // QUERY_BYTES))

    def searched(part: DataFrame) -> DataFrame:
        given = part.toArrow().combine_chunks()
        queries, whole = _arrow_matrix(given.column("embedding").combine_chunks() if len(given) else pa.array([], pa.list_(pa.float32())))
        ids, times = given.column("vec_id").to_numpy()[whole], given.column("times").to_numpy()[whole]
        wide = max(queries.shape[1], pivots.shape[1]) if len(queries) else 0
        far = _distances(_widen(queries, wide), _widen(pivots, wide)).astype(np.float32) if len(queries) else np.zeros((0, len(pivots)), np.float32)
        sent = spark.sparkContext.broadcast((ids, queries, far, _floors(ids, queries, sample_ids, sample, k), times))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, queries, far, floors, times = sent.value
            search = Search(ids, queries, far, floors, k)
            for batch in batches:
                for at in range(batch.num_rows):
                    row = batch.slice(at, 1).to_pylist()[0]
                    own = np.frombuffer(row["ids"], np.int64)
                    data = np.frombuffer(row["data"], np.int32 if row["small"] else np.float64).reshape(len(own), row["wide"]).astype(np.float64)
                    search.take(own, data, np.frombuffer(row["far"], np.float32).reshape(len(own), -1))
            counts = [len(b[0]) for b in search.best]
            if sum(counts):
                columns = [np.repeat(ids, counts), np.concatenate([b[0] for b in search.best]), np.concatenate([b[1] for b in search.best]), np.repeat(np.minimum(times, k), counts)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["query_id", "vec_id", "score", "times"])

        found = blocks.mapInArrow(tidy(run), "query_id long, vec_id long, score long, times long")
        if rounds > 1:  # one round's queries are held at a time
            found = checkpointed(found)
            sent.unpersist()
        return found

    of_round = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(rounds))
    local = reduce(DataFrame.union, [searched(asked.where(of_round == r)) for r in range(rounds)])
    every_copy = local.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return every_copy.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH flagged AS (
  SELECT vec_id, embedding, len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) AS bad FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
), whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM flagged WHERE bad = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

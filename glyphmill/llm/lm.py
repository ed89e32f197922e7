"""Language-model scores by stupid backoff over n-gram counts of the whole corpus.

Three tables, joined on the hash of an n-gram: the documents' n-grams (exploded, and counted
within groups of documents before they move), the count tables (partitioned by ranges of that
hash, where the counts of all groups are summed), and the groups' n-grams with their totals,
from which each document's scores are summed. A frequent n-gram leaves each group once, so no
partition grows with it. Partitions and groups are cut by bytes of text, so both stay of one
size however large the corpus is, and a row holds all n-grams that one group sends to one
partition: as rows of their own they would take more than twice the shuffle.
N-grams are 64-bit hashes; among ten billion distinct ones about three pairs are expected to
share one, and to merge their counts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import byte_view, checkpointed, hand_back, partitions_for, table, text_column, tidy_group

ALPHA = 0.4
#: Words of the longest n-gram.
ORDER = 2
#: N-grams of two words or more that are seen less often than this count as unseen.
MIN_PAIR = 2
#: Text bytes aimed at in one group of documents, and in one partition of the count tables.
GROUP_BYTES = 8 << 20
PART_BYTES = 16 << 20
_U = np.uint64
_BYTE = np.random.default_rng(64206).integers(0, 1 << 63, 256, dtype=np.uint64) | _U(1)
_K = 0x9E3779B97F4A7C15
_K_INVERSE = pow(_K, -1, 1 << 64)
_STEP = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> _U(32)) * _U(0x9FB21C651E98DF25)
    return h ^ h >> _U(29)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_K, _STEP + 1), _powers(_K_INVERSE, _STEP + 1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, in order, and the text that each belongs to."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blank = np.append(_BLANK[data], True)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[:-1]] = True
    start = np.flatnonzero(~blank[:-1] & (np.concatenate(([True], blank[:-2])) | edge[:-1]))
    stop = np.flatnonzero(~blank[:-1] & (blank[1:] | np.append(edge[1:-1], True))) + 1
    hashes = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        base = int(start[at])
        to = max(int(np.searchsorted(stop, base + _STEP, side="right")), at + 1)
        if int(stop[to - 1]) - base > _STEP:  # one word longer than a step
            hashes[at] = _U(xxhash.xxh64_intdigest(data[base : stop[at]].tobytes()))
        else:
            part = data[base : stop[to - 1]]
            total = np.concatenate(([_U(0)], np.cumsum(_BYTE[part] * _UP[: len(part)], dtype=np.uint64)))
            a, b = start[at:to] - base, stop[at:to] - base
            hashes[at:to] = (total[b] - total[a]) * _DOWN[a] + (b - a).astype(np.uint64)
        at = to
    return _mixed(hashes), np.searchsorted(offsets, start, side="right") - 1


def grams(batch: pa.Table | pa.RecordBatch, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The text of each word, its place in the text, and for each n the hashes of the n-grams that end at the words.

    Where a text has too few words before, the hash of an n-gram is of no meaning.
    """
    data, offsets = byte_view(text_column(batch, "text"))
    words, text = word_hashes(data, offsets)
    first = np.searchsorted(text, np.arange(batch.num_rows))
    place = np.arange(len(words)) - first[text]
    chain, out = words, [_mixed(words * _U(0xD6E8FEB86659FD93))]
    for n in range(2, order + 1):
        chain = np.concatenate((chain[:1], _mixed(chain[:-1] * _U(0xC2B2AE3D27D4EB4F) + words[1:] + _U(n))))
        out.append(chain)
    return text, place, out


def _keys(place: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """All n-grams of all orders that lie within their texts."""
    return np.concatenate([h[place >= n] for n, h in enumerate(found)])


def _ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's range of hashes begins and the last one ends among sorted keys."""
    edges = np.array([-(-(k << 64) // parts) for k in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def _pack(keys: np.ndarray) -> bytes:
    """Ascending hashes: the first whole, then the steps in as many bytes as the largest needs."""
    steps = np.diff(keys)
    wide = max((int(steps.max()).bit_length() + 7) // 8, 1) if len(steps) else 1
    return bytes([wide]) + keys[:1].astype("<u8").tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    wide = raw[0]
    out = np.zeros(((len(raw) - 9) // wide + 1, 8), np.uint8)
    out[0] = np.frombuffer(raw, np.uint8, 8, 1)
    out[1:, :wide] = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, wide)
    return np.cumsum(out.view("<u8").reshape(-1), dtype=np.uint64)


def _squeeze(counts: np.ndarray) -> bytes:
    kind = np.uint8 if counts.max(initial=0) < 256 else np.uint32 if counts.max() < 1 << 32 else np.int64
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(counts.astype(kind).tobytes(), 1)


def _expand(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), {1: np.uint8, 4: np.uint32, 8: np.int64}[raw[0]]).astype(np.int64)


def _send(rows: pa.Table, parts: int, order: int) -> pa.Table:
    """A group's distinct n-grams with their counts, one row a part."""
    batch = rows.combine_chunks()
    _, place, found = grams(batch, order)
    keys, counts = np.unique(_keys(place, found), return_counts=True)
    cuts = _ranges(keys, parts)
    own = np.flatnonzero(np.diff(cuts))
    spans = [(int(cuts[k]), int(cuts[k + 1])) for k in own]
    return pa.table(
        {
            "part": pa.array(own.astype(np.int32)),
            "grp": pa.array(np.full(len(own), batch.column("grp")[0].as_py() if batch.num_rows else 0, np.int64)),
            "grams": pa.array([_pack(keys[a:b]) for a, b in spans], pa.binary()),
            "counts": pa.array([_squeeze(counts[a:b]) for a, b in spans], pa.binary()),
        }
    )


def _count(rows: pa.Table) -> pa.Table:
    """One partition of the count tables joined to what the groups sent: each sender's n-grams with their totals, in its order."""
    sent = [_unpack(r) for r in rows.column("grams").to_pylist()]
    every = np.concatenate(sent)
    ends = np.cumsum([len(s) for s in sent])
    del sent
    order = np.argsort(every, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(every[order]) != 0)))
    own = np.concatenate([_expand(c) for c in rows.column("counts").to_pylist()])
    totals = np.add.reduceat(own[order], first)
    joined = np.empty(len(every), np.int64)
    joined[order] = np.repeat(totals, np.diff(np.append(first, len(every))))
    return pa.table({"part": rows.column("part"), "grp": rows.column("grp"), "totals": pa.array([_squeeze(t) for t in np.split(joined, ends[:-1])], pa.binary())})


def _score(docs: pa.Table, counted: pa.Table, alpha: float, min_pair: int, order: int) -> pa.Table:
    batch = docs.combine_chunks()
    text, place, found = grams(batch, order)
    n = batch.num_rows
    _, inverse = np.unique(_keys(place, found), return_inverse=True)
    parts = np.argsort(np.array(counted.column("part").to_pylist(), np.int64), kind="stable").tolist()
    packed = counted.column("totals").to_pylist()
    totals = np.concatenate([np.zeros(0, np.int64), *[_expand(packed[k]) for k in parts]])
    value, lower = np.zeros(len(text)), np.ones(len(text))
    if len(text):
        log = np.log(totals[inverse[: len(text)]].astype(np.float64))
        value, below, begin = log.copy(), log, len(text)
        for size in range(2, order + 1):
            inside = np.flatnonzero(place >= size - 1)
            total = totals[inverse[begin : begin + len(inside)]]
            begin += len(inside)
            here = np.log(np.maximum(total, 1).astype(np.float64))
            seen = total >= min_pair
            at = inside[seen]
            value[inside[~seen]] += np.log(alpha)
            value[at] = here[seen] - below[at - 1]
            lower[at] = 0
            longest = np.zeros(len(text))
            longest[inside] = here
            below = longest
    return pa.table(
        {
            "doc_id": batch.column("doc_id"),
            "n_words": pa.array(np.bincount(text, minlength=n).astype(np.int64)),
            "logs": pa.array(np.bincount(text, value, n).astype(np.float64)),
            "lower": pa.array(np.bincount(text, lower, n).astype(np.float64)),
        }
    )


def backoff_scores(docs: DataFrame, alpha: float = ALPHA, min_pair: int = MIN_PAIR, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, n_words and score: the mean log of each word's stupid-backoff score.

    A word after the ``order`` - 1 words before it scores count(all of them) / count(those before)
    where the n-gram occurs ``min_pair`` times or more in all documents, else alpha times what it
    scores after one word less, down to count(word) / N; at a text's start there are as many
    words before as there are, and its first word scores count / N.
    Null, empty and blank texts have 0 words and a null score. Every input row gives one row;
    repeated rows count each time. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    groups = max(partitions_for(spark), -(-total // GROUP_BYTES))
    parts = max(partitions_for(spark), -(-total // PART_BYTES))
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Both passes read one shuffle of the texts.
    dealt = narrow.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups))).repartition(groups, "grp")
    sent = dealt.groupBy("grp").applyInArrow(tidy_group(lambda rows: _send(rows, parts, order)), "part int, grp long, grams binary, counts binary")
    counted = sent.groupBy("part").applyInArrow(tidy_group(_count), "part int, grp long, totals binary")

    def score(texts: pa.Table, totals: pa.Table) -> pa.Table:
        out = _score(texts, totals, alpha, min_pair, order)
        if texts.nbytes > 1 << 20:
            hand_back()
        return out

    scored = dealt.groupBy("grp").cogroup(counted.groupBy("grp")).applyInArrow(score, f"doc_id {kind}, n_words long, logs double, lower double")
    found = checkpointed(scored)
    words = found.agg(F.sum("n_words")).first()[0] or 1
    mean = (F.col("logs") - F.col("lower") * F.log(F.lit(float(words)))) / F.col("n_words")
    return found.select("doc_id", "n_words", F.when(F.col("n_words") > 0, mean).alias("score"))


def op6(spark, sf_dir: str) -> DataFrame:
    return backoff_scores(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


ORACLE = r"""
WITH listed AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), placed AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM listed
), two AS (
  SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY place) AS before FROM placed
), ones AS (
  SELECT word, count(*) AS n FROM placed GROUP BY word
), pairs AS (
  SELECT before, word, count(*) AS n FROM two WHERE before IS NOT NULL GROUP BY before, word
), valued AS (
  SELECT t.doc_id, CASE WHEN p.n >= 2 THEN ln(p.n) - ln(b.n)
    ELSE ln(o.n) - ln((SELECT count(*) FROM placed)) + CASE WHEN t.before IS NULL THEN 0 ELSE ln(0.4) END END AS v
  FROM two t JOIN ones o ON t.word = o.word LEFT JOIN ones b ON t.before = b.word LEFT JOIN pairs p ON t.before = p.before AND t.word = p.word
), summed AS (
  SELECT doc_id, sum(v) AS v FROM valued GROUP BY doc_id
)
SELECT l.doc_id, len(words)::BIGINT AS n_words, round(v / len(words), 6) AS score FROM listed l LEFT JOIN summed s ON l.doc_id = s.doc_id
"""

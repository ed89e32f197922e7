"""Byte-level BPE with a pair occurrence index.

A batch of texts is cut into pieces by the tokenizer's pattern; each distinct piece is encoded
once. All pieces of a batch lie end to end in one array of symbols with links to the left and
right neighbour. The index holds, for each rank that occurs, the positions of that pair. Ranks
are applied in ascending order: a merge makes pairs of higher rank only, so its new pairs are
filed under ranks still to come, and one pass over the ranks encodes the whole batch. Positions
that went stale by an earlier merge are seen as such when their rank comes up.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import bounded_batches, small_slices, table, text_column, tidy

#: The public pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a task remembers with their ids, at most; a worker that is used again starts without them.
REMEMBERED = 200_000
#: Bytes of text that are cut into pieces at once, about.
SLICE = 2 << 20
#: Symbols that one pass over the ranks handles, at most (a longer piece comes alone).
PASS_SYMBOLS = 1 << 19


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Tokenizer:
    def __init__(self, spec: dict):
        alphabet = byte_alphabet()
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"] or pre["add_prefix_space"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.of_byte = np.full(256, -1, np.int32)
        for char, byte in alphabet.items():
            self.of_byte[byte] = vocab.get(char, -1)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.pair = np.stack((left, right), axis=1)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for name, k in vocab.items():
            self.token[k] = bytes(alphabet[c] for c in name)
        for name, k in self.special.items():
            self.token[k] = name.encode()
        self.ends = np.concatenate(([0], np.cumsum([len(t) for t in self.token])))
        self.joined = np.frombuffer(b"".join(self.token), np.uint8)
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; -1 for pairs that no merge has."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece (as 32-bit integers), by one ascending pass over the ranks that occur."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        symbol = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)].copy()
        n = len(symbol)
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        after = np.arange(1, n + 1, dtype=np.int32)
        after[np.cumsum(lengths) - 1] = n
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[np.cumsum(lengths) - lengths] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def file(at: np.ndarray) -> None:
            rank = self.rank_of(symbol[at], symbol[after[at]])
            keep = rank >= 0
            at, rank = at[keep], rank[keep]
            if not len(at):
                return
            if len(at) == 1:
                groups = ((int(rank[0]), at),)
            else:
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
                cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                groups = zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True)
            for r, own in groups:
                if r in index:
                    index[r].append(own)
                else:
                    index[r] = [own]
                    heapq.heappush(queue, r)

        file(np.flatnonzero(after < n).astype(np.int32))
        while queue:
            rank = heapq.heappop(queue)
            lists = index.pop(rank)
            left, right = self.pair[rank].tolist()
            at = np.sort(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            to = after[at]
            valid = alive[at] & (symbol[at] == left) & (to < n)
            at, to = at[valid], to[valid]
            valid = symbol[to] == right
            at, to = at[valid], to[valid]
            if left == right and len(at) > 1:
                at = np.unique(at)
                to = after[at]
                # In a run of overlapping pairs, those at even places from its start are merged.
                start = np.concatenate(([True], to[:-1] != at[1:]))
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                at, to = at[place % 2 == 0], to[place % 2 == 0]
            if not len(at):
                continue
            symbol[at] = self.made[rank]
            alive[to] = False
            beyond = after[to]
            after[at] = beyond
            inner = beyond < n
            before[beyond[inner]] = at[inner]
            left_of = before[at]
            fresh = np.concatenate((left_of[left_of >= 0], at[inner]))
            file(np.unique(fresh) if left == right or len(fresh) > 1 else fresh)
        ids = symbol[alive]
        ends = 4 * np.cumsum(np.bincount(piece[alive], minlength=len(pieces)))
        raw = ids.astype(np.int32).tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that are not remembered yet, in passes of bounded size."""
        if len(self.known) + len(pieces) > REMEMBERED:
            self.known.clear()
        raw, size, names = [], 0, []
        for piece in pieces:
            data = piece.encode()
            if raw and size + len(data) > PASS_SYMBOLS:
                self.known.update(zip(names, self.merge_all(raw), strict=True))
                raw, size, names = [], 0, []
            raw.append(data)
            names.append(piece)
            size += len(data)
        if raw:
            self.known.update(zip(names, self.merge_all(raw), strict=True))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; strings of special tokens in a text become those tokens."""
        cuts = [self._pieces(t) for t in texts]
        known = self.known
        distinct = set().union(*cuts) if cuts else set()
        fresh = [p for p in distinct if p not in known]
        if fresh:
            if len(known) + len(fresh) > REMEMBERED:
                known.clear()
                fresh = list(distinct)
            self.learn(sorted(fresh))
        for name, k in self.special.items():
            known[name] = np.array([k], np.int32).tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, pieces)), np.int32) for pieces in cuts]

    def _pieces(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out: list[str] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self.pattern.findall(part)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        begin, lengths = self.ends[ids], self.ends[ids + 1] - self.ends[ids]
        if not len(ids):
            return ""
        total = np.cumsum(lengths)
        where = np.arange(int(total[-1])) + np.repeat(begin - (total - lengths), lengths)
        return self.joined[where].tobytes().decode("utf-8", "replace")


@lru_cache(2)
def _tokenizer(spec: str) -> Tokenizer:
    return Tokenizer(json.loads(spec))


def _spec(spark, path: str | None) -> object:
    with open(path or vocabulary_path(), encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _ids_array(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))


def _coder(docs: DataFrame, path: str | None, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    """doc_id, ids and, if asked for, decoded; one pass with one tokenizer a task."""
    spec = _spec(bounded_batches(docs), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(spec.value)
        for batch in small_slices(batches, "text", SLICE):
            found = tokenizer.encode_batch([t or "" for t in text_column(batch, "text").to_pylist()])
            columns = [batch.column(0), _ids_array(found)]
            if decoded:
                columns.append(pa.array([tokenizer.decode(ids) for ids in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])
        tokenizer.known.clear()

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(tidy(run), f"doc_id {kind}, ids array<int>" + (", decoded string" if decoded else ""))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) for each input row; a null or empty text has no ids.

    The vocabulary file is read by the driver and sent to the tasks (a few MB). Other columns
    are ignored; an empty table gives no rows.
    """
    return _coder(docs, path, id_col, text_col, False)


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and decoded (the text that the ids give) for each input row: ``decode(encode(docs))`` in one pass."""
    return _coder(docs, path, id_col, text_col, True)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and decoded (the text of the ids) for each row of doc_id and ids; null ids give an empty text."""
    spec = _spec(bounded_batches(encoded), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                column = part.column(1)
                flat, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy()
                cuts = np.cumsum(lengths)
                texts = [tokenizer.decode(flat[b - n : b]) for n, b in zip(lengths.tolist(), cuts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), f"doc_id {kind}, ids array<int>, decoded string")


def op4(spark, sf_dir: str) -> DataFrame:
    coded = round_trip(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

"""Exact repeated byte strings across documents by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first ``depth`` bytes. The first pass deals them into
groups by the smallest hash among the ANCHOR-byte strings inside those bytes (equal prefixes
have equal ones); a group that only one text has holds no repeats and is dropped before any
bytes move. What is left is sorted by most-significant-digit passes of eight bytes, each pass
dropping groups that one document has alone, so that the groups after the last pass are exactly
the repeated strings. The smallest document of a group keeps its string.

Neighbouring suffixes with the same anchor travel as one string. Texts that are equal as a whole
count as one, that of the smallest id; and each task first settles what repeats within its own
documents, so a passage that many documents hold leaves a task once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import bounded_batches, byte_view, partitions_for, small_slices, table, text_column, tidy, tidy_group

DEPTH = 50
ANCHOR = 24
_LAST = (1 << 63) - 1
_SEGMENT = 1 << 19
_U = np.uint64
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) | _U(1)
_FACTOR = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)]
#: Text bytes aimed at for each group of suffixes.
GROUP_BYTES = 16 << 20
#: Text bytes whose anchors and marks meet in one part, about.
PART_BYTES = 32 << 20
#: Anchors, and bytes of strings with their objects, that a task holds before it passes them on.
HELD_ANCHORS = 1_500_000
HELD_BYTES = 24 << 20
_SORTED_AT_ONCE = 400_000


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> _U(32)) * _U(0x9FB21C651E98DF25)
    return h ^ h >> _U(29)


def anchor_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each position on, by doubling."""
    power, size, done, total = _BYTE[data], 1, 0, None
    for level in range(k.bit_length()):
        if k >> level & 1:
            total = power if total is None else power[: len(data) - done - size + 1] * _FACTOR[4] + total[size : size + len(data) - done - size + 1]
            done += size
        if k >> level + 1:
            power = power[:-size] * _FACTOR[level % 4] + power[size:]
            size *= 2
    return _mixed(total[: len(data) - k + 1])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def runs(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH, anchor: int = ANCHOR) -> Iterator[tuple[np.ndarray, ...]]:
    """Maximal runs of neighbouring suffixes with one anchor, a segment at a time.

    Each item has the arrays text, begin (of the first suffix in ``data``), count (of suffixes),
    place (of the anchor, from begin) and hash (of the anchor).
    """
    for low in range(0, max(len(data) - depth + 1, 0), _SEGMENT):
        high = min(low + _SEGMENT, len(data) - depth + 1)
        hashes = anchor_hashes(data[low : high + depth - 1], anchor)
        keyed = hashes & ~_U(0xFFFFF) | np.arange(len(hashes), dtype=np.uint64)
        place = (_sliding_min(keyed, depth - anchor + 1) & _U(0xFFFFF)).astype(np.int64)
        text = np.searchsorted(offsets, np.arange(low, high), side="right") - 1
        inside = np.flatnonzero(np.arange(low, high) + depth <= offsets[text + 1])
        if not len(inside):
            continue
        fresh = np.concatenate(([True], (place[inside[1:]] != place[inside[:-1]]) | (inside[1:] != inside[:-1] + 1)))
        first = np.flatnonzero(fresh)
        begin, count = inside[first], np.diff(np.append(first, len(inside)))
        yield text[begin], begin + low, count, place[begin] - begin, hashes[place[begin]]


def _codes(hashes: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of each anchor hash, and its 40-bit tag in that group."""
    spread = _mixed(hashes * _U(0xD6E8FEB86659FD93))
    return (spread % _U(groups)).astype(np.int64), (spread >> _U(24)).astype(np.int64)


def _pack(tags: np.ndarray) -> bytes:
    return tags.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<i8").reshape(-1)


def _lengths(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal neighbours: the first place of each and its length."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(keys)))


_ANCHOR_ROWS = "grp int, tags binary, texts binary, counts binary, shared binary, done binary, done_texts binary, done_counts binary"
_ANCHOR_NAMES = [f.split()[0] for f in _ANCHOR_ROWS.split(", ")]


def _anchor_rows(texts: np.ndarray, hashes: np.ndarray, groups: int) -> Iterator[pa.RecordBatch]:
    """One row a group: anchors of one text (with the text), anchors that several texts share (once), and
    the latter's texts, which are settled already and spread over all groups by text."""
    group, tag = _codes(hashes, groups)
    order = np.lexsort((texts, tag, group))
    texts, group, tag = texts[order], group[order], tag[order]
    fresh = np.concatenate(([True], (texts[1:] != texts[:-1]) | (tag[1:] != tag[:-1]) | (group[1:] != group[:-1])))
    texts, group, tag = texts[fresh], group[fresh], tag[fresh]
    start = np.concatenate(([True], (tag[1:] != tag[:-1]) | (group[1:] != group[:-1])))
    first, size = np.flatnonzero(start), np.diff(np.append(np.flatnonzero(start), len(tag)))
    several = np.repeat(size > 1, size)
    shared_group, shared_tag = group[first[size > 1]], tag[first[size > 1]]
    done_text, done_code = texts[several], tag[several] * groups + group[several]
    at = np.argsort(done_text, kind="stable")
    done_text, done_code = done_text[at], done_code[at]
    done_group = (_mixed(done_text.view(np.uint64)) % _U(groups)).astype(np.int64)
    at = np.argsort(done_group, kind="stable")
    done_text, done_code, done_group = done_text[at], done_code[at], done_group[at]
    texts, group, tag = texts[~several], group[~several], tag[~several]
    at = np.lexsort((texts, group))
    texts, group, tag = texts[at], group[at], tag[at]
    cut = np.arange(groups + 1)
    own, both, done = np.searchsorted(group, cut), np.searchsorted(shared_group, cut), np.searchsorted(done_group, cut)
    rows: list[list] = [[] for _ in _ANCHOR_NAMES]
    for g in np.flatnonzero(np.diff(own) + np.diff(both) + np.diff(done)).tolist():
        a, b, c, d, e, f = own[g], own[g + 1], both[g], both[g + 1], done[g], done[g + 1]
        first, size = _lengths(texts[a:b])
        done_first, done_size = _lengths(done_text[e:f])
        values = (g, _pack(tag[a:b]), texts[a:b][first].tobytes(), size.astype(np.int32).tobytes(), _pack(shared_tag[c:d]), done_code[e:f].tobytes(), done_text[e:f][done_first].tobytes(), done_size.astype(np.int32).tobytes())
        for column, value in zip(rows, values, strict=True):
            column.append(value)
    if rows[0]:
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(c, pa.binary()) for c in rows[1:]]], _ANCHOR_NAMES)


def _longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int32)


def _dealt(part: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """Arrays cut by part: one row for each part that has anything, with its share of each array as bytes."""
    order = np.argsort(part, kind="stable")
    first, size = _lengths(part[order])
    cuts = list(zip(first.tolist(), (first + size).tolist(), strict=True))
    packed = {n: pa.array([v[order[a:b]].tobytes() for a, b in cuts], pa.binary()) for n, v in columns.items()}
    return pa.table({"part": pa.array(part[order][first], pa.int32()), **packed})


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (_mixed(keys.astype(np.int64).view(np.uint64)) % _U(parts)).astype(np.int64)


def _codes_of_texts(rows: pa.Table) -> pa.Table:
    """The anchors of each text of a part, from all groups."""
    texts, codes = (np.concatenate([_longs(r) for r in rows.column(n).to_pylist()]) for n in ("texts", "codes"))
    order = np.argsort(texts, kind="stable")
    texts, codes = texts[order], codes[order]
    first, size = _lengths(texts)
    raw = pa.array([codes[a : a + n].tobytes() for a, n in zip(first.tolist(), size.tolist(), strict=True)], pa.binary())
    return pa.table({"t": pa.array(texts[first]), "codes": raw})


def _marks_of_docs(rows: pa.Table) -> pa.Table:
    """The settled runs of each document of a part, from all groups."""
    docs, texts, begins, counts = (np.concatenate([_longs(r) for r in rows.column(n).to_pylist()]) for n in ("docs", "texts", "begins", "counts"))
    order = np.lexsort((begins, texts, docs))
    docs, texts, begins, counts = docs[order], texts[order], begins[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (texts[1:] != texts[:-1]))))
    cuts = list(zip(first.tolist(), np.append(first[1:], len(docs)).tolist(), strict=True))
    return pa.table(
        {
            "doc": pa.array(docs[first]),
            "t": pa.array(texts[first]),
            "_begins": pa.array([begins[a:b].tobytes() for a, b in cuts], pa.binary()),
            "_counts": pa.array([counts[a:b].astype(np.int32).tobytes() for a, b in cuts], pa.binary()),
        }
    )


def _repeated_anchors(rows: pa.Table, groups: int, parts: int) -> pa.Table:
    """The anchors of one group that at least two texts have, dealt by text."""
    columns = {n: rows.column(n).to_pylist() for n in _ANCHOR_NAMES}
    tags = np.concatenate([_unpack(r) for r in columns["tags"]])
    texts = np.concatenate([np.repeat(_longs(t), _ints(c)) for t, c in zip(columns["texts"], columns["counts"], strict=True)])
    shared = np.concatenate([_unpack(r) for r in columns["shared"]])
    every = np.concatenate((tags, shared))
    order = np.argsort(every, kind="stable")
    first, size = _lengths(every[order])
    known = order >= len(tags)
    of = np.append(texts, np.zeros(len(shared), np.int64))[order]
    keep = np.zeros(len(first), bool)
    if len(first):
        keep = np.logical_or.reduceat(known, first) | (np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first))
    kept = order[np.repeat(keep, size) & ~known]
    codes = tags[kept] * groups + columns["grp"][0]
    done_texts = np.concatenate([np.repeat(_longs(t), _ints(c)) for t, c in zip(columns["done_texts"], columns["done_counts"], strict=True)])
    done = np.concatenate([_longs(r) for r in columns["done"]])
    found = np.concatenate((texts[kept], done_texts))
    return _dealt(_part(found, parts), {"texts": found, "codes": np.concatenate((codes, done))})


_STRING_ROWS = "grp int, data binary, lengths binary, ids binary, texts binary, codes binary, places binary, n_at binary, at binary, done_ids binary, done_texts binary, done_at binary, done_n binary"
_STRING_NAMES = [f.split()[0] for f in _STRING_ROWS.split(", ")]


class _Strings:
    """Strings of a task by content: the smallest document of each goes on, the others are settled."""

    def __init__(self, groups: int):
        self.groups = groups
        self.clear()

    def clear(self) -> None:
        self.of: dict[bytes, tuple] = {}
        self.twins: list[tuple] = []
        self.done: list[tuple[int, int, int, int]] = []
        self.size = 0

    def add(self, string: bytes, doc: int, text: int, group: int, code: int, place: int, at: int, count: int) -> None:
        held = self.of.get(string)
        if held is None:
            self.of[string] = (string, doc, text, group, code, place, [at])
            self.size += len(string) + 400
        elif held[1] == doc and held[2] == text:
            held[6].append(at)
        elif held[1] < doc:
            self.done.append((doc, text, at, count))
            self.size += 150
        elif held[1] > doc:
            self.done += [(held[1], held[2], p, count) for p in held[6]]
            self.of[string] = (string, doc, text, group, code, place, [at])
            self.size += 150 * len(held[6])
        else:
            self.twins.append((string, doc, text, group, code, place, [at]))
            self.size += len(string) + 400

    def rows(self) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        entries = sorted([*self.of.values(), *self.twins], key=lambda e: (e[3], e[1], e[2], e[6][0]))
        done = np.array(self.done, np.int64).reshape(-1, 4)
        done_group = (_mixed(np.ascontiguousarray(done[:, 0]).view(np.uint64)) % _U(self.groups)).astype(np.int64)
        order = np.lexsort((done[:, 2], done[:, 0], done_group))
        done, done_group = done[order], done_group[order]
        group = np.array([e[3] for e in entries], np.int64)
        cut = np.arange(self.groups + 1)
        own, settled = np.searchsorted(group, cut), np.searchsorted(done_group, cut)
        rows: list[list] = [[] for _ in _STRING_NAMES]
        for g in np.flatnonzero(np.diff(own) + np.diff(settled)).tolist():
            part, d = entries[own[g] : own[g + 1]], done[settled[g] : settled[g + 1]]
            longs = lambda k: np.array([e[k] for e in part], np.int64).tobytes()  # noqa: E731, B023
            values = (
                g,
                packer.compress(b"".join(e[0] for e in part)),
                np.array([len(e[0]) for e in part], np.int32).tobytes(),
                longs(1),
                longs(2),
                longs(4),
                np.array([e[5] for e in part], np.int32).tobytes(),
                np.array([len(e[6]) for e in part], np.int32).tobytes(),
                np.array([p for e in part for p in e[6]], np.int64).tobytes(),
                d[:, 0].tobytes(),
                d[:, 1].tobytes(),
                d[:, 2].tobytes(),
                d[:, 3].astype(np.int32).tobytes(),
            )
            for column, value in zip(rows, values, strict=True):
                column.append(value)
        if rows[0]:
            for a in range(0, len(rows[0]), 32):
                yield pa.RecordBatch.from_arrays([pa.array(rows[0][a : a + 32], pa.int32()), *[pa.array(c[a : a + 32], pa.binary()) for c in rows[1:]]], _STRING_NAMES)
        self.clear()


def radix_groups(data: np.ndarray, at: np.ndarray, group: np.ndarray, doc: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at ``at`` that equal another document's through ``depth`` bytes, and the smallest such document.

    Both as arrays: places in the input, and the smallest document of each one's final group.
    """
    left = np.arange(len(at))
    words = np.zeros(max(len(data) - 7, 0), np.uint64)
    for k in range(8):
        words |= data[k : k + len(words)].astype(np.uint64) << _U(56 - 8 * k)
    digits = [None, *range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]
    smallest = doc[left]
    for digit in digits:
        if digit is None:
            order = np.argsort(group, kind="stable")
            left, group = left[order], group[order]
            fresh = np.concatenate(([True], group[1:] != group[:-1])) if len(left) else np.zeros(0, bool)
        else:
            value = words[at[left] + digit]
            order = np.lexsort((value, group))
            left, group, value = left[order], group[order], value[order]
            fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (value[1:] != value[:-1]))) if len(left) else np.zeros(0, bool)
        if not len(left):
            return left, smallest[:0]
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(left)))
        own = doc[left]
        low, top = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
        keep = np.repeat(low != top, size)
        group, smallest = np.repeat(np.arange(len(first)), size)[keep], np.repeat(low, size)[keep]
        left = left[keep]
    return left, smallest


class _Marks:
    """Settled suffixes: document, text, begin and count of runs; those of ``passed`` were settled before."""

    def __init__(self, *passed: np.ndarray):
        self.passed = np.stack([p.astype(np.int64) for p in passed], axis=1)
        self.rows: list[tuple[int, int, int, int]] = []

    def add(self, doc: int, text: int, at: int, count: int) -> None:
        self.rows.append((doc, text, at, count))

    def table(self, parts: int) -> pa.Table:
        found = np.concatenate((self.passed, np.array(self.rows, np.int64).reshape(-1, 4)))
        self.rows.clear()
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
        return _dealt(_part(found[:, 0], parts), {n: np.ascontiguousarray(found[:, k]) for k, n in enumerate(("docs", "texts", "begins", "counts"))})


def _settle(rows: pa.Table, depth: int, parts: int) -> pa.Table:
    """The repeated suffixes of one group that a smaller document has too, dealt by document."""
    columns = {n: rows.column(n).to_pylist() for n in _STRING_NAMES}
    join = lambda name, kind: np.concatenate([np.frombuffer(r, kind) for r in columns[name]])
    lengths, ids, texts, codes = join("lengths", np.int32), join("ids", np.int64), join("texts", np.int64), join("codes", np.int64)
    places, n_at, at = join("places", np.int32), join("n_at", np.int32), join("at", np.int64)
    marks = _Marks(join("done_ids", np.int64), join("done_texts", np.int64), join("done_at", np.int64), join("done_n", np.int32))
    unpack = zstandard.ZstdDecompressor().decompress
    raw = b"".join(map(unpack, columns["data"]))
    ends = np.cumsum(lengths.astype(np.int64))
    at_ends = np.cumsum(n_at.astype(np.int64))
    strings: dict[bytes, int] = {}
    of = np.array([strings.setdefault(raw[b - n : b], len(strings)) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)], np.int64)
    smallest = np.full(len(strings), _LAST)
    np.minimum.at(smallest, of, ids)
    holders: dict[int, list[int]] = {}
    for e, (s, d) in enumerate(zip(of.tolist(), ids.tolist(), strict=True)):
        if d > smallest[s]:
            for p in at[at_ends[e] - n_at[e] : at_ends[e]].tolist():
                marks.add(d, int(texts[e]), p, int(lengths[e]) - depth + 1)
        else:
            holders.setdefault(s, []).append(e)
    # Different strings with one anchor may share some of their suffixes.
    one = np.full(len(strings), -1)
    one[of[::-1]] = np.arange(len(of))[::-1]
    code = codes[one]
    order = np.argsort(code, kind="stable")
    first, size = _lengths(code[order])
    crowded = order[np.repeat(size > 1, size)]
    if len(crowded):
        counts = lengths[one[crowded]].astype(np.int64) - depth + 1
        total, cuts, begun = np.cumsum(counts), [0], 0
        steps = np.flatnonzero(np.concatenate((code[crowded][1:] != code[crowded][:-1], [True]))) + 1
        for stop in steps.tolist():
            if total[stop - 1] - begun >= _SORTED_AT_ONCE or stop == len(crowded):
                cuts.append(stop)
                begun = total[stop - 1]
        for a, b in zip(cuts, cuts[1:], strict=False):
            _settle_crowd(crowded[a:b], raw, one, ends, lengths, places, code, smallest, holders, ids, texts, at, at_ends, n_at, depth, marks)
    return marks.table(parts)


def _settle_crowd(some, raw, one, ends, lengths, places, code, smallest, holders, ids, texts, at, at_ends, n_at, depth, marks) -> None:
    entry = one[some]
    size = lengths[entry].astype(np.int64)
    data = np.frombuffer(b"".join(raw[b - n : b] for b, n in zip(ends[entry].tolist(), size.tolist(), strict=True)), np.uint8)
    count = size - depth + 1
    base = np.cumsum(size) - size
    string = np.repeat(np.arange(len(some)), count)
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    _, ranked = np.unique(code[some], return_inverse=True)
    group = ranked[string] * 4096 + (places[entry][string] - step)
    doc = smallest[some][string]
    left, low = radix_groups(data, base[string] + step, group, doc, depth)
    left = np.sort(left[doc[left] > low])
    if not len(left):
        return
    first = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1] + 1) | (string[left[1:]] != string[left[:-1]]))))
    for a, n in zip(left[first].tolist(), np.diff(np.append(first, len(left))).tolist(), strict=True):
        for e in holders[int(some[string[a]])]:
            for p in at[at_ends[e] - n_at[e] : at_ends[e]].tolist():
                marks.add(int(ids[e]), int(texts[e]), p + int(step[a]), n)


def covered(begins: bytes, counts: bytes, n: int, depth: int = DEPTH) -> np.ndarray:
    """A mask of the bytes that marked suffixes cover."""
    edge = np.zeros(n + 1, np.int32)
    begin, count = _longs(begins), _ints(counts)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + count + depth - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def with_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with columns _doc, _t, _first, _begins, _counts: what of each text repeats.

    _first is null where an equal text has a smaller id; otherwise _begins and _counts hold the
    runs of suffixes that a smaller document has too (null: none).
    """
    spark = bounded_batches(docs)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    text = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    partitions = partitions_for(spark)
    parts, groups = (max(partitions, -(-total // size)) for size in (PART_BYTES, GROUP_BYTES))
    narrow = docs.select(key.alias("doc"), text.alias("text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, hashes, held, seen = [], [], 0, set()
        for batch in small_slices(batches, "text", 2 << 20):
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = byte_view(text_column(batch, "text"))
            new = np.array([k not in seen and not seen.add(k) for k in keys.tolist()], bool)
            for of, _, _, _, found in runs(data, offsets, depth, anchor):
                use = new[of]
                texts.append(keys[of[use]])
                hashes.append(found[use])
                held += int(use.sum())
            if held >= HELD_ANCHORS or len(seen) >= HELD_ANCHORS:
                if held:
                    yield from _anchor_rows(np.concatenate(texts), np.concatenate(hashes), groups)
                texts, hashes, held, seen = [], [], 0, set()
        if held:
            yield from _anchor_rows(np.concatenate(texts), np.concatenate(hashes), groups)

    hashed = narrow.select(F.xxhash64("text").alias("t"), "text")
    repeated = hashed.mapInArrow(tidy(anchors), _ANCHOR_ROWS).groupBy("grp").applyInArrow(tidy_group(lambda rows: _repeated_anchors(rows, groups, parts)), "part int, texts binary, codes binary")
    by_text = repeated.groupBy("part").applyInArrow(tidy_group(_codes_of_texts), "t long, codes binary")
    # The smallest document of each text; texts of equal hash but different digests are taken whole.
    firsts = narrow.select(F.xxhash64("text").alias("t"), F.unhex(F.sha2("text", 256)).alias("digest"), "doc").groupBy("t", "digest").agg(F.min("doc").alias("doc"))
    grouped = firsts.groupBy("t").agg(F.collect_set("doc").alias("docs"), F.count(F.lit(1)).alias("texts"))
    wanted = grouped.join(by_text, "t", "left").where("codes is not null or texts > 1")
    wanted = wanted.select(F.explode("docs").alias("w_doc"), F.col("t").alias("w_t"), F.col("codes").alias("w_codes"), (F.col("texts") > 1).alias("w_all"))

    # Both joins read one shuffle of the texts: their sides of it are the same plan, with the number of
    # partitions that joins ask for themselves (with another one, the second join deals the texts anew).
    columns = docs.columns
    keyed = docs.withColumn("_doc", key).withColumn("_t", F.xxhash64(text)).repartition(partitions, "_doc", "_t")
    asked = keyed.join(wanted, (F.col("_doc") == F.col("w_doc")) & (F.col("_t") == F.col("w_t")))
    text_at = columns.index(text_col)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Strings(groups)
        for batch in small_slices(batches, text_col, 1 << 20):
            names = batch.schema.names
            ids, texts = (batch.column(len(columns) + k).to_numpy(zero_copy_only=False) for k in (0, 1))
            lists, whole = batch.column(names.index("w_codes")).to_pylist(), np.array(batch.column(names.index("w_all")).to_pylist(), bool)
            data, offsets = byte_view(text_column(batch, names[text_at]))
            raw = data.tobytes()
            salt = lambda codes, text: _mixed(codes.view(np.uint64) + text.astype(np.uint64) * _FACTOR[0])
            known = np.sort(np.concatenate([np.zeros(0, np.uint64), *[salt(_longs(c), np.full(len(c) // 8, k)) for k, c in enumerate(lists) if c]]))
            for of, begin, count, place, found in runs(data, offsets, depth, anchor):
                group, tag = _codes(found, groups)
                code = tag * groups + group
                wish = salt(code, of)
                at = np.minimum(np.searchsorted(known, wish), max(len(known) - 1, 0))
                use = np.flatnonzero((known[at] == wish if len(known) else np.zeros(len(wish), bool)) | whole[of])
                local = begin[use] - offsets[of[use]]
                stop = begin[use] + count[use] + depth - 1
                for a, b, d, t, g, c, p, i, n in zip(begin[use].tolist(), stop.tolist(), ids[of[use]].tolist(), texts[of[use]].tolist(), group[use].tolist(), code[use].tolist(), place[use].tolist(), local.tolist(), count[use].tolist(), strict=True):
                    held.add(raw[a:b], d, t, g, c, p, i, n)
            if held.size >= HELD_BYTES:
                yield from held.rows()
        yield from held.rows()

    settled = asked.mapInArrow(tidy(strings), _STRING_ROWS).groupBy("grp").applyInArrow(tidy_group(lambda rows: _settle(rows, depth, parts)), "part int, docs binary, texts binary, begins binary, counts binary")
    marks = settled.groupBy("part").applyInArrow(tidy_group(_marks_of_docs), "doc long, t long, _begins binary, _counts binary")
    first = firsts.select(F.col("doc").alias("_first"), F.col("t").alias("f_t")).distinct().join(marks, (F.col("_first") == F.col("doc")) & (F.col("f_t") == F.col("t")), "left").select("_first", "f_t", "_begins", "_counts")
    return keyed.join(first, (F.col("_doc") == F.col("_first")) & (F.col("_t") == F.col("f_t")), "left").drop("f_t")


def _mask(raw: bytes, first: object, begins: bytes | None, counts: bytes | None, depth: int) -> np.ndarray:
    if first is None:
        return np.full(len(raw), len(raw) >= depth)
    return covered(begins, counts, len(raw), depth) if begins else np.zeros(len(raw), bool)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """doc_id, n_bytes, spans (begin and end of each removed run of bytes) and kept (the other bytes).

    One row for each input row. Null and empty texts have no spans; texts under ``depth`` bytes
    never repeat. Rows that share an id do not remove from each other; a null id counts as
    larger than all others. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text"):
            data, offsets = byte_view(text_column(batch, "text"))
            raw, firsts, begins, counts = data.tobytes(), *(batch.column(batch.schema.names.index(n)).to_pylist() for n in ("_first", "_begins", "_counts"))
            spans, kept = [], []
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                gone = _mask(raw[a:b], firsts[k], begins[k], counts[k], depth)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                spans.append([{"begin": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()])
                kept.append(data[a:b][~gone].tobytes())
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_marks(narrow, depth=depth).select("doc_id", "text", "_first", "_begins", "_counts").mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")


def kept_text(raw: bytes, gone: np.ndarray) -> str:
    """What is left, in whole characters: one stays where any of its bytes does."""
    if not gone.any():
        return raw.decode()
    data = np.frombuffer(raw, np.uint8)
    start = np.flatnonzero((data & 0xC0) != 0x80)
    stays = np.logical_or.reduceat(~gone, start)
    return data[np.repeat(stays, np.diff(np.append(start, len(data))))].tobytes().decode()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", depth: int = DEPTH) -> DataFrame:
    """``docs`` with repeated strings cut from its texts (and ``count_col``, if it is there, counted anew).

    Every row stays, with an empty text where all of it repeats; a null text stays null.
    """
    columns, plain = docs.columns, [f"c{k}" for k in range(len(docs.columns))]
    text_at, count_at = columns.index(text_col), columns.index(count_col) if count_col in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, plain[text_at]):
            firsts, begins, counts = (batch.column(len(columns) + k).to_pylist() for k in range(3))
            texts: list[str | None] = []
            for k, text in enumerate(text_column(batch, plain[text_at]).to_pylist()):
                raw = None if text is None else text.encode()
                texts.append(raw if raw is None else kept_text(raw, _mask(raw, firsts[k], begins[k], counts[k], depth)))
            arrays = list(batch.columns[: len(columns)])
            arrays[text_at] = pa.array(texts, pa.string())
            if count_at is not None:
                arrays[count_at] = pa.array([None if t is None else len(t) for t in texts], arrays[count_at].type)
            yield pa.RecordBatch.from_arrays(arrays, columns)

    # Plain names, so that no column of the input meets one of the operator's own.
    marked = with_marks(docs.toDF(*plain), plain[columns.index(id_col)], plain[text_at], depth)
    return marked.select(*plain, "_first", "_begins", "_counts").mapInArrow(tidy(run), docs.schema)


def op3(spark, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], depth: int = DEPTH) -> dict[int, tuple[int, int, int, str]]:
    """op3's rows by comparing all strings; for tests."""
    first: dict[bytes, int] = {}
    raws = [(d, (t or "").encode()) for d, t in rows]
    for d, raw in raws:
        for i in range(len(raw) - depth + 1):
            s = raw[i : i + depth]
            first[s] = min(first.get(s, d), d)
    out = {}
    for d, raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - depth + 1):
            if first[raw[i : i + depth]] < d:
                gone[i : i + depth] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
        out[d] = (len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out

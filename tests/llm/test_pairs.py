"""SimHash components, repeated strings and top-k search against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm import simhash, suffixes, topk

from .conftest import ROWS


def _fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aAbÉ \t\n\x0b日", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == _fingerprint(text)


def _clustered(rng, n):
    """Random fingerprints with chains and clusters around some of them."""
    points = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    out = [points]
    for p in points[: n // 4]:
        for _ in range(int(rng.integers(1, 5))):
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                p = p ^ np.uint64(1 << int(b))
            out.append(np.array([p]))
    return np.unique(np.concatenate(out))


def _roots(points, a, b):
    up = {int(p): int(p) for p in points}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    return [root(int(p)) for p in points]


@pytest.mark.parametrize("blocks", [1, 2])
def test_tree_shards_lose_no_link(blocks, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_SIZE", 8)
    points = _clustered(np.random.default_rng(3), 1500)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    want = _roots(points, *(points[k] for k in np.nonzero(np.triu(near, 1))))
    links = []
    for mask in simhash.masks(blocks):
        tree = simhash.fit_tree(points[::5], mask, 3 // blocks, 12)
        for _, own in simhash.route(points & np.uint64(mask), tree, 3 // blocks):
            links.append(simhash.shard_links(points[own], mask, 3 // blocks, 3))
    assert _roots(points, np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links])) == want


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, 200), (200, 150), (7, 7), (150, 100), (150, 100)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(2, 41)} | {200: 100, 150: 100}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_odd_rows(odd, none, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_SIZE", 2)
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()}
    assert all(got[d][0] % (1 << 64) == _fingerprint(t) for d, t, _, _ in ROWS)
    assert got[2][1] == 1 and got[3] == got[4] == got[5] == (0, 3) and got[None][1] is None
    assert simhash.near_duplicates(odd).count() == len(ROWS) and simhash.near_duplicates(none).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=40), min_size=1, max_size=6))
def test_radix_groups(texts):
    depth = 8
    data = np.frombuffer("".join(texts).encode() + bytes(8), np.uint8)
    at, doc, base = [], [], 0
    for d, t in enumerate(texts):
        at += range(base, base + len(t) - depth + 1)
        doc += [d] * max(len(t) - depth + 1, 0)
        base += len(t)
    at, doc = np.array(at, np.int64), np.array(doc, np.int64)
    left, low = suffixes.radix_groups(data, at, np.zeros(len(at), np.int64), doc, depth)
    raw = data.tobytes()
    holders: dict = {}
    for p, d in zip(at.tolist(), doc.tolist(), strict=True):
        holders.setdefault(raw[p : p + depth], set()).add(d)
    want = {p: min(holders[raw[p : p + depth]]) for p in at.tolist() if len(holders[raw[p : p + depth]]) > 1}
    assert {int(at[k]): int(m) for k, m in zip(left, low, strict=True)} == want


def _texts(rng):
    words = ["".join(rng.choice(list("abcdeéß "), 9)) for _ in range(60)]
    passages = [" ".join(rng.choice(words, 14)) for _ in range(6)]
    out = []
    for d in range(60):
        parts = [" ".join(rng.choice(words, int(rng.integers(1, 30))))]
        parts += [passages[int(rng.integers(6))] for _ in range(int(rng.integers(0, 3)))]
        out.append((d, " ".join(parts)))
    return out + [(100, out[3][1]), (101, out[3][1] + "!"), (102, "x" * 300), (103, "x" * 120), (104, ""), (105, "short"), (106, out[9][1] * 3)]


def test_repeated_strings(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_SEGMENT", 700)
    monkeypatch.setattr(suffixes, "HELD_ANCHORS", 200)
    monkeypatch.setattr(suffixes, "HELD_BYTES", 5000)
    rows = _texts(np.random.default_rng(8))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = suffixes.brute_force(rows)
    got = {r["doc_id"]: (r["n_bytes"], sum(s["end"] - s["begin"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in suffixes.repeated_spans(docs).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 1000


def test_repeats_of_odd_rows(odd, none):
    rows = suffixes.repeated_spans(odd).collect()
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in rows}
    size = len(ROWS[0][1])
    assert len(rows) == len(ROWS) and spans[1] == spans[3] == spans[8] == spans[None] == [] and spans[2] == [(0, size)] and spans[9] == [(10, 10 + size)]
    cut = {r["doc_id"]: r for r in suffixes.remove_repeats(odd).collect()}
    assert suffixes.remove_repeats(odd).columns == odd.columns
    assert cut[3]["text"] is None and cut[2]["text"] == "" and cut[2]["n_chars"] == 0 and cut[9]["text"] == "and then:  Ende" and cut[9]["source"] is None
    assert suffixes.repeated_spans(none).count() == suffixes.remove_repeats(none).count() == 0


def test_whole_characters_stay():
    raw = "aéb".encode()
    assert suffixes.kept_text(raw, np.array([False, True, False, True])) == "aé" and suffixes.kept_text(raw, np.ones(4, bool)) == ""


def test_anchor_runs_cover_all_suffixes():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 101, n, dtype=np.uint8)) for n in (0, 49, 50, 51, 300, 2000)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    found = {}
    for text, begin, count, place, hashes in suffixes.runs(data, offsets):
        for t, b, n, p, h in zip(text.tolist(), begin.tolist(), count.tolist(), place.tolist(), hashes.tolist(), strict=True):
            for i in range(b, b + n):
                assert i not in found
                found[i] = (t, h, b + p - i)
    assert set(found) == {i for t in range(len(texts)) for i in range(offsets[t], offsets[t + 1] - 49)}
    seen: dict = {}
    for i, (_, h, p) in found.items():  # equal strings have equal anchors at equal places
        assert seen.setdefault(data[i : i + 50].tobytes(), (h, p)) == (h, p)


def _brute_top(vectors, k, every):
    whole = {i: np.floor(1024 * np.asarray(v, np.float64)) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in whole:
        if q % every == 0:
            scores = sorted((-int(whole[q] @ whole[c]), c) for c in whole if c != q)[:k]
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scores)}
    return out


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 37)
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    vectors += [(1000 + i, vectors[20][1]) for i in range(15)]  # ties
    vectors += [(2000, None), (2010, [None] * 8), (2020, [float("nan")] * 8), (2030, [float("inf")] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4)
    got = {tuple(r) for r in topk.top_k(df, 10, every=10).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == _brute_top(vectors, 10, 10)
    assert topk.top_k(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few, 10, every=2).collect()] == [(0, 1, 1, 1024 * 2048)]


def test_exact_beyond_doubles():
    big = np.array([2.0**40, 2.0**40])
    assert topk._exact(big, np.array([[2.0**20, 1.0]]))[0] == 2**60 + 2**40 and topk._exact(big, np.array([[2.0**62, 0]]))[0] == 2**63 - 1


def test_top_k_of_odd_rows(spark, monkeypatch):
    """Repeated ids and rows, null ids, clashing names, and few rows a round."""
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    monkeypatch.setattr(topk, "SAMPLE", 3)
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 3.0]), (None, [9.0, 9.0]), (100, [1.0]), (3, [-1.0, 0.0]), (200, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 7, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, score int, rank string, times double")
    got = sorted(tuple(r) for r in topk.top_k(df, 3).collect())
    whole = [(i, np.floor(1024 * np.array([*v, 0.0][:2]))) for i, v in rows if i is not None]
    want = []
    for q in (0, 100, 200):
        scores = sorted((-int(a @ b), c) for i, a in whole if i == q for c, b in whole if c != q)[:3]
        want += [(q, r, c, -s) for r, (s, c) in enumerate(scores, 1)]
    assert got == want


def test_elimination_evaluates_less():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(8, 16)) * 4000
    points = np.floor(np.repeat(centers, 200, axis=0) + rng.normal(size=(1600, 16)) * 50)
    pivots = topk.choose_pivots(points[::10], 16)
    far = topk._distances(points, pivots).astype(np.float32)
    search = topk.Search(np.arange(8) * 200, points[::200], far[::200], np.full(8, -np.inf), 10)
    for at in range(0, 1600, 200):
        search.take(np.arange(at, at + 200), points[at : at + 200], far[at : at + 200])
    for q, (ids, scores) in zip(search.ids.tolist(), search.best, strict=True):
        every = sorted((-int(points[q] @ points[c]), c) for c in range(1600) if c != q)[:10]
        assert every == [(-s, i) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
    assert search.evaluated < 8 * 1600 / 3

"""Mixing, BPE, MPEG audio, LM scores and the pipeline: round trips, brute force, odd rows."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import bpe, lm, mixing, mpeg, quality, suffixes
from glyphmill.llm.common import checkpointed

from .conftest import ROWS
from .test_pairs import _fingerprint


def test_targets_by_hand(spark):
    rows = spark.createDataFrame([("a", 100), ("b", 100), ("c", 10), ("d", 0), (None, 40)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    # Weights 1, 2, 3, 1, 2; c stops at 30 and d at 0, the rest is shared 1 : 2 : 2 with the null source capped at 120.
    assert got["c"] == 30 and got["d"] == 0 and got["a"] == pytest.approx(44) and got["b"] == pytest.approx(88) and got[None] == pytest.approx(88)
    assert sum(got.values()) == pytest.approx(250)


def test_mix_of_odd_rows(odd, none):
    plan = mixing.mix_plan(odd).collect()
    assert len(plan) == len(ROWS) and all(0 <= r["copies"] <= 3 for r in plan)
    assert {r["doc_id"]: r["size"] for r in plan}[3] == 0 and sorted(map(str, plan)) == sorted(map(str, mixing.mix_plan(odd.repartition(5)).collect()))
    mixed = mixing.mix_sources(odd)
    assert mixed.columns == odd.columns
    counts = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    assert counts == Counter({d: sum(r["copies"] for r in plan if r["doc_id"] == d) for d in {r["doc_id"] for r in plan}}) - Counter()
    assert mixing.mix_plan(none).count() == mixing.mix_sources(none).count() == 0


def test_mix_with_salted_join(odd, monkeypatch):
    want = sorted(map(str, mixing.mix_plan(odd).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(str, mixing.mix_plan(odd).collect())) == want


def test_mix_comes_near_its_targets(spark, sf):
    plan = mixing.mix_plan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = plan.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()
    assert sum(r["taken"] for r in rows) == pytest.approx(sum(r["target"] for r in rows), rel=0.05)


@pytest.fixture(scope="module")
def tokenizers():
    from tokenizers import Tokenizer

    return bpe.Tokenizer(json.load(open(bpe.vocabulary_path(), encoding="utf-8"))), Tokenizer.from_file(bpe.vocabulary_path())


def test_bpe_equals_the_library(tokenizers, spark, sf):
    own, library = tokenizers
    rng = random.Random(2)
    texts = ["", " ", "\n\n x", "a<|endoftext|><|endoftext|>b", "a" * 500, "I'm we'll don't", "日本語 🎉🎉🎉", "\u0000\x85\x1c", "--==!!1234567890½ⅷ٣", "<|endoftext"]
    texts += ["".join(rng.choice("ab \n'sté中1-aaa") for _ in range(150)) for _ in range(150)]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False) == text


def test_bpe_bounds_do_not_matter(monkeypatch, tokenizers):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "PASS_SYMBOLS", 10)
    own = bpe.Tokenizer(json.load(open(bpe.vocabulary_path(), encoding="utf-8")))
    texts = ["some words here", "and other words there", "some words here"]
    assert [i.tolist() for i in own.encode_batch(texts)] == [tokenizers[1].encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_of_odd_rows(odd, none, tokenizers):
    rows = bpe.decode(bpe.encode(odd)).collect()
    assert len(rows) == len(ROWS) and {r["doc_id"]: r["decoded"] for r in rows} == {d: t or "" for d, t, _, _ in ROWS}
    assert {r["doc_id"]: len(r["ids"]) for r in rows}[3] == 0 and bpe.decode(bpe.encode(none)).count() == 0
    assert tokenizers[0].decode(tokenizers[0].encode_batch(["é"])[0][:0]) == ""


@pytest.mark.parametrize("size", [0, 1, 64, 1416, 1417, 1418, 5000, 100_000])
def test_mpeg_round_trip(size):
    payload = mpeg.padded(bytes(random.Random(size).choices(range(32, 127), k=size)))
    stream = mpeg.parse(media := mpeg.encode(payload))
    assert mpeg.payload_of(media, stream) == payload and len(payload) % 64 == 0 and len(payload) > 0
    assert stream.wrong == stream.skipped == 0 and stream.checked == len(stream.starts) + 1
    assert stream.table == {"kind": "Xing", "frames": len(stream.starts), "bytes": sum(h.length for h in stream.headers), "seek": stream.table["seek"]} and len(stream.table["seek"]) == 100
    assert stream.duration[0] / stream.duration[1] == 1152 * len(stream.starts) / 32000
    assert [media[a : a + 2] for a in stream.starts] == [b"\xff\xfa"] * len(stream.starts)


@pytest.mark.parametrize("size", [64, 128, 192, 256, 320, 1408, 1472, 1600, 3000])
def test_mpeg_round_trip_with_tag_at_every_offset(size):
    for at in range(size - 2):
        payload = mpeg.padded(b"x" * at + b"TAG" + b"y" * (size - at - 3))
        stream = mpeg.parse(media := mpeg.encode(payload))
        assert mpeg.payload_of(media, stream) == payload and stream.wrong == stream.skipped == 0
    tagged = mpeg.parse(media + b"TAG" + b"Title".ljust(30, b"\0") + bytes(95))
    assert tagged.tags["TIT2"] == "Title" and tagged.starts == stream.starts and tagged.skipped == 0


def test_mpeg_resynchronises_and_checks():
    media = mpeg.encode(mpeg.padded(b"x" * 3000))
    whole = mpeg.parse(media)
    cut = whole.starts[1]
    broken = mpeg.parse(media[:cut] + b"\xff\xfb garbage \xff\xf0" + media[cut:])
    assert len(broken.starts) == len(whole.starts) and broken.skipped == 13
    flipped = bytearray(media)
    flipped[whole.starts[0] + 10] ^= 1  # in the side information
    assert mpeg.parse(bytes(flipped)).wrong == 1
    tagged = media + b"TAG" + b"Title".ljust(30, b"\0") + bytes(95)
    assert mpeg.parse(tagged).tags["TIT2"] == "Title" and mpeg.parse(tagged).starts == whole.starts
    for junk in (b"", b"ID3", b"\xff" * 50, b"\xff\xfb\x90\x00", b"RIFF" * 9, media[:100]):
        assert mpeg.parse(junk).starts == []


@pytest.mark.parametrize(("word", "want"), [
    (0xFFFB9000, ("1", 3, 128000, 44100, 417, 1152)), (0xFFFB9200, ("1", 3, 128000, 44100, 418, 1152)), (0xFFFD8400, ("1", 2, 128000, 48000, 384, 1152)), (0xFFF38000, ("2", 3, 64000, 22050, 208, 576)),
    (0xFFFF4000, ("1", 1, 128000, 44100, 136, 384)), (0xFFE38000, ("2.5", 3, 64000, 11025, 417, 576)), (0xFFFBF000, None), (0xFFFB0000, None), (0xFFFB9C00, None), (0xFFF99000, None), (0xFFEB9000, None),
])
def test_mpeg_headers(word, want):
    h = mpeg.read_header(word)
    assert (h and (h.version, h.layer, h.bitrate, h.sample_rate, h.length, h.samples)) == want


@pytest.mark.parametrize(("word", "counts"), [(0xFFFC8400, (0, 0, 3)), (0xFFFE4000, (0, 0, 3)), (0xFFFD8400, (0, 0, 0)), (0xFFFA9000, (3, 3, 0))])
def test_unchecked_frames_are_said_to_be(word, counts):
    header = mpeg.read_header(word)
    stream = mpeg.parse((word.to_bytes(4, "big") + b"\x12\x34").ljust(header.length, b"\1") * 3)
    assert len(stream.starts) == 3 and (stream.checked, stream.wrong, stream.unchecked) == counts


def test_vbri_table():
    header = mpeg.read_header(0xFFFB9000)
    frame = (0xFFFB9000).to_bytes(4, "big") + bytes(32) + b"VBRI" + bytes(6) + (5000).to_bytes(4, "big") + (12).to_bytes(4, "big") + (2).to_bytes(2, "big") + (3).to_bytes(2, "big") + (1).to_bytes(2, "big") + bytes([0, 6]) + bytes([7, 9])
    table = mpeg.read_table(frame[:46] + frame[46:], header)
    assert table["kind"] == "VBRI" and table["bytes"] == 5000 and table["frames"] == 12


def test_media_of_odd_rows(odd, none):
    rows = mpeg.parse_media(mpeg.to_media(odd), keep=("n_bytes",)).collect()
    got = {r["doc_id"]: bytes(r["audio"]["payload"]) for r in rows}
    assert len(rows) == len(ROWS) and got == {d: mpeg.padded((t or "").encode()) for d, t, _, _ in ROWS}
    assert mpeg.parse_media(mpeg.to_media(none)).count() == 0 and mpeg._parsed(None)["frames"] == 0


def _backoff(rows):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    one, two = Counter(w for _, ws in words for w in ws), Counter(p for _, ws in words for p in zip(ws, ws[1:]))
    total, out = sum(one.values()), []
    for d, ws in words:
        value = 0.0
        for k, w in enumerate(ws):
            pair = two[(ws[k - 1], w)] if k else 0
            value += math.log(pair / one[ws[k - 1]]) if pair >= 2 else math.log(one[w] / total) + (math.log(0.4) if k else 0)
        out.append((str(d), len(ws), round(value / len(ws), 9) if ws else None))
    return sorted(out, key=str)


def test_backoff_scores(odd, none, monkeypatch):
    monkeypatch.setattr(lm, "GROUP_BYTES", 100_000)
    got = sorted(((str(r["doc_id"]), r["n_words"], None if r["score"] is None else round(r["score"], 9)) for r in lm.backoff_scores(odd).collect()), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in _backoff([(d, t) for d, t, _, _ in ROWS])]
    for g, w in zip(got, _backoff([(d, t) for d, t, _, _ in ROWS]), strict=True):
        assert g[2] == w[2] or g[2] == pytest.approx(w[2], abs=1e-8)
    assert lm.backoff_scores(none).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """The stages' decisions on a folder of their own, each against a plain version."""
    import corpus_pipeline

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    passage = " ".join(f"word{k}" for k in range(60))
    more = [(100_000, "one start " + passage, "en", "x", 9), (100_001, "another beginning " + passage + " end", "en", "x", 9), (100_002, "one start " + passage, "en", "x", 9)]
    docs = source.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    (_, good), (_, near), (_, cut), (_, mix), (_, coded) = corpus_pipeline.STAGES

    kept = checkpointed(good(spark, docs, folder))
    model = quality.fitted(spark, folder)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {d for d, t in rows.items() if quality.score_batch(model, [(t or "").encode()])[0] >= 0.3}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want

    unique = checkpointed(near(spark, kept, folder))
    prints = {d: _fingerprint(rows[d]) for d in want}
    group = {d: d for d in want}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    ordered = sorted(want)
    for k, a in enumerate(ordered):
        for b in ordered[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    first = {root(d) for d in want}
    assert {r["doc_id"] for r in unique.collect()} == first and unique.columns == docs.columns and 100_002 not in first

    short = checkpointed(cut(spark, unique, folder))
    brute = suffixes.brute_force([(d, rows[d]) for d in first])
    left = {r["doc_id"]: r["text"] for r in short.collect()}
    assert all(len(left[d].encode()) >= brute[d][0] - brute[d][1] for d in first) and passage not in left[100_001] and left[100_000] == rows[100_000]

    mixed = checkpointed(mix(spark, short, folder))
    assert set(r["doc_id"] for r in mixed.collect()) <= first and mixed.columns == docs.columns
    final = coded(spark, mixed, folder).collect()
    assert sorted((r["doc_id"], r["decoded"]) for r in final) == sorted((r["doc_id"], r["text"] or "") for r in mixed.collect())


def test_near_dedup_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(1, a), (1, a), (1, a), (2, a), (1, b), (0, b), (None, c), (None, c), (None, d), (7, d.upper()), (None, None), (None, ""), (3, "x y z w"), (3, "p q r s")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _row long").repartition(4)
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (0, b), (None, c), (7, d.upper()), (None, ""), (3, "x y z w"), (3, "p q r s")], key=str)
    assert corpus_pipeline.one_of_each_group(spark, docs.limit(0), "").count() == 0


def _backoff_of_order(rows, order, least, alpha=0.4):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    counts = Counter(tuple(ws[k : k + n]) for _, ws in words for n in range(1, order + 1) for k in range(len(ws) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)

    def value(ws, k, n):
        if n == 1:
            return math.log(counts[(ws[k],)] / total)
        gram = tuple(ws[k - n + 1 : k + 1])
        return math.log(counts[gram] / counts[gram[:-1]]) if counts[gram] >= least else math.log(alpha) + value(ws, k, n - 1)

    return sorted(((str(d), len(ws), sum(value(ws, k, min(order, k + 1)) for k in range(len(ws))) / len(ws) if ws else None) for d, ws in words), key=str)


@pytest.mark.parametrize(("order", "least"), [(1, 1), (2, 1), (3, 1), (3, 2), (4, 1)])
def test_backoff_of_any_order(spark, odd, monkeypatch, order, least):
    monkeypatch.setattr(lm, "GROUP_BYTES", 100_000)
    monkeypatch.setattr(lm, "PART_BYTES", 30_000)
    rng = random.Random(order)
    rows = [(d, t) for d, t, _, _ in ROWS if d != 8] + [(100 + k, " ".join(rng.choice(["a", "b", "cc", "é"]) for _ in range(rng.randrange(12)))) for k in range(40)] + [(300, "x" * (1 << 21) + " a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((str(r["doc_id"]), r["n_words"], r["score"]) for r in lm.backoff_scores(docs, min_pair=least, order=order).collect()), key=str)
    want = _backoff_of_order(rows, order, least)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(g[2] == w[2] or g[2] == pytest.approx(w[2], abs=1e-9) for g, w in zip(got, want, strict=True))


def test_packed_ngrams_come_back():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        assert (lm._unpack(lm._pack(keys)) == keys).all()
        assert lm._ranges(keys, 7)[-1] == len(keys) and (np.diff(lm._ranges(keys, 7)) >= 0).all()
    for counts in ([1, 2, 255], [1, 256], [1, 1 << 40]):
        assert lm._expand(lm._squeeze(np.array(counts))).tolist() == counts


def test_registered_columns(spark, odd, folder):
    """The digests of op3, op4, op5 and op7 from plain versions of their definitions."""
    from tokenizers import Tokenizer

    from glyphmill.llm import simhash

    rows = [(d, t, la, s) for d, t, la, s in ROWS if d not in (None, 8)] + [(20, "x" * 49, "en", "a"), (21, "y" * 70 + " " + "z" * 60, "en", "a"), (22, "z" * 60, "en", "a")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    at = folder(documents=docs)
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    brute = suffixes.brute_force([(d, t) for d, t, _, _ in rows])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.op3(spark, at).collect()}
    assert got == brute
    library = Tokenizer.from_file(bpe.vocabulary_path())
    library.no_truncation(), library.no_padding()
    coded = {d: library.encode(t or "", add_special_tokens=False).ids for d, t, _, _ in rows}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op4(spark, at).collect()}
    assert got == {d: (len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids, skip_special_tokens=False).encode())) for d, ids in coded.items()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op5(spark, at).collect()}
    assert {d: f for d, (f, _) in got.items()} == {d: f"{_fingerprint(t):016x}" for d, t, _, _ in rows} and got[2][1] == got[1][1] == 1 and got[5][1] == 3
    for r in mpeg.op7(spark, at).collect():
        payload = mpeg.padded((dict((d, t) for d, t, _, _ in rows)[r["doc_id"]] or "").encode())
        media = mpeg.encode(payload)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (len(payload), sha(payload), zlib.crc32(payload[-64:]), len(media), sha(media))
        assert r["n_bytes"] <= r["payload_bytes"] and f"frames={len(mpeg.parse(media).starts)};" in r["feature"]


def test_pipeline_runs_on_odd_rows(spark, odd, none, folder):
    """run() end to end: rows decode to the texts of their documents (9 loses what 1 has too), and empty tables stay empty."""
    import corpus_pipeline

    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 0), (4, 0, 0), (4, 1, 1), (99, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    at = folder(documents=plain, labels=labels)
    rows = corpus_pipeline.run(spark, at).collect()
    texts = {d: t or "" for d, t, _, _ in ROWS}
    assert rows and {r["doc_id"] for r in rows} <= set(texts) and 2 not in {r["doc_id"] for r in rows}
    assert all(r["n_tokens"] == len(r["ids"]) and r["decoded"] == ("and then:  Ende" if r["doc_id"] == 9 else texts[r["doc_id"]]) for r in rows)
    plain.limit(0).write.mode("overwrite").parquet(f"{at}/documents.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0

"""Quality, toxicity and language models: held-out accuracy, and odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import language, quality, toxicity
from glyphmill.llm.common import class_sample, held_out, is_held_out

from .conftest import ROWS

DATA = "/root/testdata/sf0.01"


def test_folds(spark):
    rows = spark.range(200).select(F.col("id"), held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == is_held_out(r["id"]) for r in rows) and 20 < sum(r["h"] for r in rows) < 60


def test_sample_is_bounded_and_never_held_out(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    got = class_sample(rows, 40, "x").collect()
    assert {label: sum(r["label"] == label for r in got) for label in (0, 1)} == {0: 40, 1: 40}
    assert not any(is_held_out(r["doc_id"]) for r in got) and sorted(map(tuple, class_sample(rows.repartition(7), 40, "x").collect())) == sorted(map(tuple, got))
    assert class_sample(rows.limit(0), 5, "x").count() == 0


@pytest.mark.parametrize(("operator", "column", "least"), [(quality.op1, "quality", 0.95), (toxicity.op8, "toxic", 0.9)])
def test_held_out_accuracy(spark, operator, column, least):
    found = operator(spark, DATA).toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas().merge(found, on="doc_id")
    test = labels[labels.held_out]
    assert len(found) == 1000 and found.score.between(0, 1).all()
    assert (test.predicted == test[column]).mean() > least
    pairs = test[test[column] == 1].score.values[:, None] - test[test[column] == 0].score.values[None, :]
    assert (pairs > 0).mean() + 0.5 * (pairs == 0).mean() > least


def test_language_accuracy(spark):
    found = language.op10(spark, DATA).toPandas()
    joined = found.merge(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert (joined[joined.held_out].lang_pred == joined[joined.held_out].lang).mean() > 0.98 and found.score.between(0, 1).all()


TRAIN = [("you are a moron and a clown", 1), ("what a moron he is", 1), ("a kind note about the river", 0), ("the river is quiet today", 0), ("clowns? no: clown", 1), ("notes about rivers", 0)] * 4


def test_misspelt_words_score_alike():
    model = toxicity.train(TRAIN)
    score = lambda t: model.score(model.word_margins(sorted(toxicity.words_of(t))))
    assert score("such a morron") > 0.5 > score("such a rivver") and score("quiet " * 500 + "moron") > 0.5


@pytest.mark.parametrize("at", [0, 55, 61, 5_000, 9_990])
def test_toxic_part_of_a_run_without_spaces(spark, at):
    model = toxicity.train(TRAIN)
    clean = ("theriverisquiettoday" * 500)[:9_995]
    rows = [(1, clean), (2, clean[:at] + "moron" + clean[at:])]
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1] < 0.5 < got[2]


@pytest.mark.parametrize("length", [1, 60, 61, 79, 80, 81, 1_000])
def test_windows_hold_every_gram(length):
    run = "".join(chr(0x4E00 + k) for k in range(length))
    grams = {run[k : k + n] for n in toxicity.GRAMS for k in range(length - n + 1)}
    words = toxicity.words_of(run)
    assert all(any(g in w for w in words) for g in grams) and max(map(len, words)) <= 60 and len(toxicity.gram_buckets(sorted(words))[0])


@pytest.mark.parametrize("make", [
    lambda docs: quality.score_quality(docs, quality.train([("a b c", 1), ("!! !! !!", 0)])), lambda docs: toxicity.score_toxicity(docs, toxicity.train(TRAIN)),
    lambda docs: language.identify(docs, language.train([("the dog and the fox", "en"), ("der Hund und der Fuchs", "de")])), lambda docs: quality.score_quality(docs, quality.train([])),
    lambda docs: toxicity.score_toxicity(docs, toxicity.train([])), lambda docs: language.identify(docs, language.train([])),
])
def test_odd_rows(odd, none, make):
    rows = make(odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    by_id = {r["doc_id"]: tuple(r[1:]) for r in rows}
    assert by_id[1] == by_id[2] and by_id[3] == by_id[4] and make(none).count() == 0


@pytest.mark.parametrize("dense", [True, False])
def test_every_language_is_learnt(spark, monkeypatch, dense):
    if not dense:
        monkeypatch.setattr(language, "DENSE_CELLS", 0)
        monkeypatch.setattr(language, "MEMORY_CELLS", 100)
    monkeypatch.setattr(language, "SAMPLE", 300)
    own = {f"l{k:03}": [f"{chr(0x4E00 + 40 * k + j)}{chr(0x4E01 + 40 * k + j)}x" for j in range(30)] for k in range(150)}
    rows = [(n * 1000 + k, " ".join(words[n % 5 :]), lang) for k, (lang, words) in enumerate(own.items()) for n in range(8 if k < 70 else 5)]
    docs = spark.createDataFrame([*rows, (1 << 40, "no language", None)], "doc_id long, text string, lang string")
    sample = language.training_rows(docs)
    assert {lang for _, lang in sample} == set(own) and len(sample) <= 300
    got = language.identify(docs, language.train(sample)).collect()
    want = {d: lang for d, _, lang in rows}
    assert all(r["lang_pred"] == want[r["doc_id"]] for r in got if r["doc_id"] in want)


def test_language_of_long_or_few_lettered_texts_is_learnt(spark):
    rows = [(k, "日本語 " * 80_000, "ja") for k in range(4)] + [(10 + k, "--- 12", "xx") for k in range(4)] + [(20 + k, "un chien", "fr") for k in range(4)]
    sample = language.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {lang for _, lang in sample} == {"ja", "fr"}


def test_sparse_tables_equal_dense_ones(monkeypatch):
    rows = [("the dog and the fox ran the the", "en"), ("der Hund und der der Fuchs", "de"), ("le chien et le renard le", "fr")] * 3
    texts = ["the dog", "der Hundt", "une chienne le", "zzz qqq", "the der le " * 400]
    whole = language.Scorer(language.train(rows))
    want = [whole.predict(t) for t in texts]
    monkeypatch.setattr(language, "DENSE_CELLS", 0)
    thin = language.Scorer(language.train(rows))
    assert thin.model.word_scores.dense is None and [thin.predict(t) for t in texts] == want


def test_language_without_letters(odd):
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, language.train([("the lazy dog and the quick fox today", "en"), ("der faule Hund und der schnelle Fuchs heute", "de")] * 4)).collect()}
    assert got[3] == got[4] == got[5] == "und" and got[1] == "en" and got[7] == "de"


def test_quality_filter_keeps_all_columns(odd):
    kept = quality.keep_good(odd, quality.train([]), threshold=0.5)
    assert kept.columns == odd.columns and kept.count() == len(ROWS) and quality.keep_good(odd, quality.train([]), threshold=0.6).count() == 0


def test_votes_equal_brute_force():
    """Quality: the cosines and votes of plain loops over whole vectors."""
    texts = [("A plain sentence about rivers. It ends here.", 1), ("Another plain one, with a comma, and more.", 1), ("!!! BUY $$$ NOW !!!", 0), ("a a a a a a a", 0), ("Some words that go on about rivers.", 1), ("CLICK CLICK CLICK", 0)] * 4
    model = quality.train(texts)
    raws = [t.encode() for t in ("rivers and plain words.", "BUY BUY NOW $$$", "", "a a a")]
    got = quality.score_batch(model, raws)
    for raw, score in zip(raws, got.tolist(), strict=True):
        vector = (np.log1p(quality.terms(raw).astype(float)) * model.weights) @ model.axes
        length = np.sqrt(sum(x * x for x in vector))
        votes = sorted(((round(float(sum(a * b for a, b in zip(vector / length if length else vector, n, strict=True))), 9), y) for n, y in zip(model.neighbours, model.labels, strict=True)), reverse=True)
        least = votes[quality.NEIGHBOURS - 1][0]
        near = [(max(c, 0), y) for c, y in votes if c >= least]
        total = sum(c for c, _ in near)
        assert score == pytest.approx(sum(c * y for c, y in near) / total if total else model.prior, abs=2e-6)
    assert quality.terms(b"Word word")[quality.HASHED + 4 * quality.BINS :].max() == 2


def test_toxicity_equals_brute_force(spark):
    """The mean of each window's n-gram margins, pooled, by plain loops."""
    model = toxicity.train(TRAIN)
    texts = ["", "you moron", "a kind note about the river and a clown in it today", "quiet " * 50 + "moron", "x" * 70 + " river moron", "one two three four five"]
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect()}
    for k, text in enumerate(texts):
        words, begin, end = toxicity.layout(text, toxicity.SPAN)
        margins = []
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            grams = [toxicity.gram_buckets([w])[0] for w in words[a:b]]
            margins.append(float(model.margins[np.concatenate(grams)].mean()))
        weights = [np.exp(toxicity.SHARPNESS * (m - max(margins))) for m in margins]
        pooled = sum(m * w for m, w in zip(margins, weights, strict=True)) / sum(weights) if margins else 0.0
        assert got[k] == pytest.approx(1 / (1 + np.exp(-np.clip(pooled + model.bias, -30, 30))), abs=1e-8)
        assert set().union(*(range(a, b) for a, b in zip(begin.tolist(), end.tolist(), strict=True))) == set(range(len(words)))


def test_language_equals_brute_force():
    rows = [("the dog and the fox", "en"), ("der Hund und der Fuchs", "de"), ("le chien et le renard", "fr")]
    scorer = language.Scorer(model := language.train(rows))
    for text in ("the Hund", "foxes", "zzz", "chien renard chien"):
        total = np.zeros(3)
        for word in language.words_of(text):
            if word in model.words:
                total += model.word_scores.rows([model.words[word]])[0]
                continue
            marked, at = f"\x02{word}\x03", 0
            while at < len(marked):
                n = next((n for n in range(min(language.LONGEST, len(marked) - at), 0, -1) if marked[at : at + n] in model.grams), 0)
                total += model.gram_scores.rows([model.grams[marked[at : at + n]]])[0] + (language.LONGEST - n) * language.BACKOFF if n else model.nothing
                if n:
                    total += language.BACKOFF
                at += max(n, 1)
        assert scorer.predict(text)[0] == model.languages[int(np.argmax(total))]
        assert np.allclose(scorer.totals(language.words_of(text)), total)


def test_numerals_are_no_letters(spark):
    model = language.train([("the dog", "en"), ("der Hund", "de")])
    rows = [(1, "½ ² ①"), (2, "Ⅷ 12 _"), (3, "dog½dog")]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(spark.createDataFrame(rows, "doc_id int, text string"), model).collect()}
    assert got == {1: "und", 2: "und", 3: "en"}


def test_labels_that_disagree_are_left_out(spark):
    from glyphmill.llm.common import labelled_texts

    ids = [k for k in range(1, 60) if not is_held_out(k)][:4]
    docs = spark.createDataFrame([(d, f"text {d}") for d in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(ids[0], 1), (ids[0], 1), (ids[1], 0), (ids[1], 1), (ids[2], 0), (ids[3], None), (None, 1)], "doc_id long, toxic int")
    assert labelled_texts(docs, labels, "toxic", 10) == [(f"text {ids[2]}", 0), (f"text {ids[0]}", 1)]

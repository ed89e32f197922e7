"""Language identification by word-first backoff.

A word that the training texts have is scored by its log frequency in each language. A word
they lack is scored by its character n-grams, longest first: at each place the longest known
n-gram counts, down to single characters. Each fallback costs a constant factor.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import bounded_batches, class_sample, held_out, small_slices, table, text_column, texts_and_labels, tidy

UNKNOWN = "und"
#: Training texts of each language and of all, at most, taken by the smallest id hashes. Every
#: language is learnt: with more of them each has fewer texts, but one at least.
SAMPLE_PER_LANGUAGE, SAMPLE = 800, 51_200
#: Characters of all training texts, at most, which bounds the model too: with more of them each gives less.
SAMPLE_CHARS = 16_000_000
#: Cells of a table that is held with all its zero counts, at most.
DENSE_CELLS = 12_800_000
LONGEST = 4
BACKOFF = np.log(0.4)
_WORDS = re.compile(r"[^\W\d_]+")
#: Scores of unseen words that a task remembers, at most.
MEMORY_CELLS = 2_000_000


class Table:
    """Smoothed log shares of keys in each language, by the key's place.

    Beyond DENSE_CELLS only the counted cells are kept; all others of a language are alike.
    """

    def __init__(self, counts: list[Counter], keys: list[str]):
        place = {k: i for i, k in enumerate(keys)}
        totals = np.maximum(np.array([sum(c.values()) for c in counts], np.float64), 1)
        self.size, below = max(len(counts), 1), totals + 0.05 * max(len(keys), 1)
        self.none = np.log(0.05 / below) if len(counts) else np.zeros(1)
        cells = [(i, n, at) for at, c in enumerate(counts) for k, n in c.items() if (i := place.get(k)) is not None]
        of, n, at = np.array(cells, np.int64).reshape(-1, 3).T
        order = np.argsort(of, kind="stable")
        of, self.languages = of[order], at[order]
        self.values = np.log((n[order] + 0.05) / below[self.languages]) if len(of) else np.zeros(0)
        self.starts = np.searchsorted(of, np.arange(len(keys) + 1))
        self.dense = None
        if len(keys) * self.size <= DENSE_CELLS:
            self.dense = self._spread(np.arange(len(keys)))

    def _spread(self, places: np.ndarray) -> np.ndarray:
        out = np.repeat(self.none[None], len(places), axis=0)
        lengths = self.starts[places + 1] - self.starts[places]
        row = np.repeat(np.arange(len(places)), lengths)
        cell = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(self.starts[places], lengths)
        out[row, self.languages[cell]] = self.values[cell]
        return out

    def rows(self, places: list[int]) -> np.ndarray:
        return self.dense[places] if self.dense is not None else self._spread(np.array(places, np.int64))


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    word_scores: Table
    grams: dict[str, int]
    gram_scores: Table
    nothing: np.ndarray

    def unseen(self, word: str) -> np.ndarray:
        """Scores of a word the model lacks, from the longest known n-gram at each place."""
        marked, get = f"\x02{word}\x03", self.grams.get
        found, shorter, missing, at, end = [], 0, 0, 0, len(word) + 2
        while at < end:
            for n in range(min(LONGEST, end - at), 0, -1):
                k = get(marked[at : at + n])
                if k is not None:
                    found.append(k)
                    shorter += LONGEST - n + 1
                    break
            else:
                n = 1
                missing += 1
            at += n
        return self.gram_scores.rows(found).sum(axis=0) + shorter * BACKOFF + missing * self.nothing


def words_of(text: str) -> list[str]:
    """Maximal runs of letters, in lower case; other numerals than digits are no letters either."""
    words = _WORDS.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return [part for word in words for part in "".join(c if c.isalpha() else " " for c in word).split()]


def train(rows: list[tuple[str, str]]) -> Model:
    """A model of (text, language) rows; each language's counts are taken relative to its own total."""
    languages = sorted({lang for _, lang in rows})
    of_words, of_grams = [Counter() for _ in languages], [Counter() for _ in languages]
    place = {lang: k for k, lang in enumerate(languages)}
    for text, lang in rows:
        of_words[place[lang]].update(words_of(text))
    for counts, grams in zip(of_words, of_grams, strict=True):
        for word, n in counts.items():
            marked = f"\x02{word}\x03"
            for size in range(1, LONGEST + 1):
                for at in range(len(marked) - size + 1):
                    grams[marked[at : at + size]] += n

    words, grams = (sorted(set().union(*counts)) for counts in (of_words, of_grams))
    size = max(len(languages), 1)
    return Model(
        languages,
        {w: k for k, w in enumerate(words)},
        Table(of_words, words),
        {g: k for k, g in enumerate(grams)},
        Table(of_grams, grams),
        np.full(size, np.log(1e-6)),
    )


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """A bounded sample of (text, lang) rows of every language that has text with a letter; none held out.

    A text too long for the sample gives its first part, so that a language of long texts is learnt too.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("label")).where(F.col("text").rlike(r"\p{L}"))
    return texts_and_labels(class_sample(rows, SAMPLE_PER_LANGUAGE, "language", None, SAMPLE, SAMPLE_CHARS))


class Scorer:
    """Scores texts with one model; remembers unseen words up to a bound."""

    def __init__(self, model: Model):
        self.model, self.kept = model, {}
        size = max(len(model.languages), 1)
        room = max(MEMORY_CELLS // size, 1000 if size <= 1000 else 1)
        if model.word_scores.dense is not None:
            self.kept, room = dict(model.words), room + len(model.words)
        self.places = dict(self.kept)
        self.scores = np.zeros((room, size))
        self.scores[: len(self.kept)] = model.word_scores.dense if self.kept else 0

    def _place(self, word: str) -> int:
        k, known = len(self.places), self.model.words.get(word)
        self.places[word] = k
        self.scores[k] = self.model.unseen(word) if known is None else self.model.word_scores.rows([known])[0]
        return k

    def totals(self, words: list[str]) -> np.ndarray:
        """The summed scores of a text's words."""
        total = np.zeros(self.scores.shape[1])
        step = min(500, len(self.scores) - len(self.kept))
        for at in range(0, len(words), step):
            part = words[at : at + step]
            if len(self.places) + len(part) > len(self.scores):
                self.places = dict(self.kept)
            found = list(map(self.places.get, part))
            if None in found:
                get = self.places.get
                found = [self._place(w) if (k := get(w)) is None else k for w in part]
            total += self.scores[found].sum(axis=0)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        total = self.totals(words)
        mean = np.exp((total - total.max()) / np.sqrt(len(words)))
        best = int(np.argmax(total))
        return self.model.languages[best], float(mean[best] / mean.sum())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each input row.

    A text that is null or has no letter is ``und`` with score 0, as is every text where no
    language could be learnt. Ties go to the language first in code point order. Other columns
    are ignored; an empty table gives no rows.
    """
    sent = bounded_batches(docs).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in small_slices(batches, "text"):
            found = [scorer.predict(t) for t in text_column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, lang_pred string, score double")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(training_rows(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

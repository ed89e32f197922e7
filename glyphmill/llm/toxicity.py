"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is the bag of its words' character n-grams (with their ends marked), each hashed to an
embedding; the bag's mean goes through a linear softmax over the two labels. One word in a long
text would vanish in the mean of all of it, so a text of more than SPAN words is averaged over
each window of SPAN words (one every half of that), and takes a smooth maximum of their
margins; a text of up to SPAN words is one bag. Embeddings and softmax are trained jointly in
numpy on whole documents. A misspelt word shares most n-grams, and so most of its vector,
with the word it stands for. A run without white space that is too long for one word (prose of
scripts without spaces, joined tokens) counts as overlapping pieces, each a word of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import bounded_batches, held_out, labelled_texts, small_slices, table, text_column, tidy

#: Training texts of each label, at most.
SAMPLE_PER_CLASS = 1500
BUCKETS = 1 << 16
DIMENSIONS = 8
GRAMS = (3, 4, 5)
STEPS = 110
SHARPNESS = 2.0
#: Words, and pieces of a longer run, of the windows that are averaged.
SPAN, RUN_SPAN = 4, 2
#: Characters of a run that are one word; longer runs are windows of WINDOW characters, one every STRIDE (a term is diluted in a wider one).
LONGEST_WORD, WINDOW, STRIDE = 60, 8, 4
#: Words whose bags a task remembers, at most (more only for one slice that has more).
REMEMBERED = 300_000


def _pieces(run: str) -> list[str]:
    return [*(run[at : at + WINDOW] for at in range(0, len(run) - WINDOW, STRIDE)), run[-WINDOW:]]


def layout(text: str, span: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words in order, and the begins and ends of their windows. A longer run gives pieces
    that hold each of its characters; RUN_SPAN of them make a window, with no words from outside."""
    runs = text.lower().split()
    if max(map(len, runs), default=0) <= LONGEST_WORD:
        return runs, *spans_of(len(runs), span)
    words: list[str] = []
    bounds: list[tuple[np.ndarray, np.ndarray]] = []
    plain = 0
    for run in [*runs, None]:
        if run is not None and len(run) <= LONGEST_WORD:
            words.append(run)
            continue
        if len(words) > plain:
            bounds.append(tuple(x + plain for x in spans_of(len(words) - plain, span)))
        if run is not None:
            pieces = _pieces(run)
            bounds.append(tuple(x + len(words) for x in spans_of(len(pieces), RUN_SPAN)))
            words += pieces
        plain = len(words)
    return words, *(np.concatenate([b[k] for b in bounds]) for k in (0, 1))


def words_of(text: str) -> set[str]:
    """The distinct words of a text, and the pieces of its longer runs."""
    return set(layout(text, SPAN)[0])


def spans_of(n: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the windows over ``n`` words: one every half span, the last up to the end."""
    begin = np.arange(0, max(n - span, 0) + 1, max(span // 2, 1)) if n else np.zeros(0, np.int64)
    if n > span and begin[-1] + span < n:
        begin = np.append(begin, n - span)
    return begin, np.minimum(begin + span, n)


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram buckets of all words end to end, and the word that each belongs to."""
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    buckets, owners = [], []
    code = points * np.uint64(0x9E3779B97F4A7C15)
    for n in range(2, max(GRAMS) + 1):
        code = (code[:-1] if len(code) else code) * np.uint64(0x100000001B3) ^ points[n - 1 :] * np.uint64(0xC2B2AE3D27D4EB4F)
        if n in GRAMS and len(code):
            inside = np.arange(len(code)) + n <= ends[: len(code)]
            mixed = code[inside] * np.uint64(0x9FB21C651E98DF25) + np.uint64(n)
            buckets.append((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS)
            owners.append(owner[: len(code)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    """The margin of each bucket (its embedding through the softmax) and the bias."""

    margins: np.ndarray
    bias: float
    span: int = SPAN

    def bags(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The summed margins and the number of each word's n-grams."""
        if not words:
            return np.zeros(0), np.zeros(0)
        buckets, owners = gram_buckets(words)
        return np.bincount(owners, self.margins[buckets], len(words)), np.bincount(owners, minlength=len(words)).astype(np.float64)

    def word_margins(self, words: list[str]) -> np.ndarray:
        """The margins of the windows over a list of words."""
        return self.span_margins(*self.bags(words), *spans_of(len(words), self.span))

    def span_margins(self, total: np.ndarray, count: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The margins of the windows' mean bags, from the bags of a text's words in order."""
        total, count = np.concatenate(([0], np.cumsum(total))), np.concatenate(([0], np.cumsum(count)))
        return (total[end] - total[begin]) / np.maximum(count[end] - count[begin], 1)

    def score(self, margins: np.ndarray) -> float:
        """A text's probability of label 1 by the softmax at the smooth maximum of its windows; of none, by the bias alone."""
        pooled = 0.0
        if len(margins):
            weight = np.exp(SHARPNESS * (margins - margins.max()))
            pooled = float((margins * weight).sum() / weight.sum())
        return float(1 / (1 + np.exp(-np.clip(pooled + self.bias, -30, 30))))


def train(rows: list[tuple[str, int]], span: int = SPAN) -> Model:
    """Full-batch Adam on the documents' log loss, both classes weighing alike; embeddings, softmax and biases move together.

    The large constant in the step keeps rare n-grams, whose slopes are small, from being learnt by heart.
    """
    labels = np.array([y for _, y in rows], np.float64)
    if not len(rows) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), -4.0 if not len(rows) or labels[0] == 0 else 4.0, span)
    laid = [layout(t, span) for t, _ in rows]
    lists = [words for words, _, _ in laid]
    vocabulary = sorted(set().union(*lists))
    place = {w: k for k, w in enumerate(vocabulary)}
    word = np.array([place[w] for words in lists for w in words], np.int64)
    offsets = np.concatenate(([0], np.cumsum([len(words) for words in lists])))
    begin, end = (np.concatenate([s[k] + a for s, a in zip(laid, offsets, strict=False)]).astype(np.int64) for k in (1, 2))
    sizes = np.array([len(s[1]) for s in laid], np.int64)
    owner, starts = np.repeat(np.arange(len(lists)), sizes), np.cumsum(sizes) - sizes
    buckets, of_word = gram_buckets(vocabulary)
    grams = np.bincount(of_word, minlength=len(vocabulary)).astype(np.float64)
    behind = np.concatenate(([0], np.cumsum(grams[word])))
    count = np.maximum(behind[end] - behind[begin], 1)
    rng = np.random.default_rng(0)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    softmax = rng.normal(0, 0.5, (DIMENSIONS, 2))
    bias = np.array([1.0, -1.0])
    target = np.stack((1 - labels, labels), axis=1)
    weight = np.where(labels == 1, len(rows) / 2 / labels.sum(), len(rows) / 2 / (len(rows) - labels.sum()))
    weight = weight / weight.sum()
    values = [embedding, softmax, bias]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, STEPS + 1):
        apart = softmax[:, 1] - softmax[:, 0]
        of_words = np.bincount(of_word, (embedding @ apart)[buckets], len(vocabulary))
        behind = np.concatenate(([0], np.cumsum(of_words[word])))
        each = (behind[end] - behind[begin]) / count
        top = np.zeros(len(lists))
        top[sizes > 0] = np.maximum.reduceat(each, starts[sizes > 0]) if len(each) else 0
        raised = np.exp(SHARPNESS * (each - top[owner]))
        share = raised / np.bincount(owner, raised, len(lists))[owner]
        pooled = np.bincount(owner, share * each, len(lists))
        # The softmax of the pooled bag: its logits differ by ``pooled`` and the biases.
        one = 1 / (1 + np.exp(-np.clip(pooled + bias[1] - bias[0], -30, 30)))
        wrong = (np.stack((1 - one, one), axis=1) - target) * weight[:, None]
        of_span = wrong[owner, 1] * share * (1 + SHARPNESS * (each - pooled[owner])) / count
        slope = np.bincount(begin, of_span, len(word) + 1) - np.bincount(end, of_span, len(word) + 1)
        per_word = np.bincount(word, np.cumsum(slope)[:-1], len(vocabulary))
        per_bucket = np.bincount(buckets, per_word[of_word], BUCKETS)
        pull = embedding.T @ per_bucket
        slopes = [np.outer(per_bucket, apart) + 1e-7 * embedding, np.stack((-pull, pull), axis=1), wrong.sum(axis=0)]
        for k, (value, slope) in enumerate(zip(values, slopes, strict=True)):
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope * slope
            value -= 0.1 * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-3)
    return Model(embedding @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0]), span)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) for each input row.

    Null, empty and blank texts have the score of no words at all. Equal texts score alike.
    Other columns are ignored; an empty table gives no rows.
    """
    sent = bounded_batches(docs).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, place = sent.value, {}
        total, count = np.zeros(REMEMBERED), np.zeros(REMEMBERED)
        for batch in small_slices(batches, "text", 2 << 20):
            laid = [layout(t or "", model.span) for t in text_column(batch, "text").to_pylist()]
            distinct = set().union(*(words for words, _, _ in laid))
            fresh = [w for w in distinct if w not in place]
            if len(place) + len(fresh) > len(total):
                place.clear()
                fresh = list(distinct)
                if len(fresh) > len(total):  # one text of more words than are remembered
                    total, count = np.zeros(len(fresh)), np.zeros(len(fresh))
            for at in range(0, len(fresh), 50_000):
                part = fresh[at : at + 50_000]
                a, b = len(place), len(place) + len(part)
                total[a:b], count[a:b] = model.bags(part)
                place.update(zip(part, range(a, b), strict=True))
            scores = []
            for words, begin, end in laid:
                at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                scores.append(round(model.score(model.span_margins(total[at], count[at], begin, end)), 9))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, score double")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(labelled_texts(docs, table(spark, sf_dir, "labels"), "toxic", SAMPLE_PER_CLASS))
    found = score_toxicity(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

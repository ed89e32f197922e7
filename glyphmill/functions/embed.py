"""Embedders: a protocol, a deterministic one for tests, and one for local ONNX files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.vectors import mean_pool

BATCH = 128


class Embedder(Protocol):
    dimension: int
    model_name: str

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class SketchEmbedder:
    """Byte length, byte sum, line count, and whether ``pub`` occurs."""

    dimension = 4
    model_name = "sketch"

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(raw := t.encode())), float(sum(raw)), float(len(t.splitlines())), float("pub" in t)] for t in texts]


class OnnxEmbedder:
    """Mean-pooled sentence vectors of a local ONNX model and tokenizer file; loaded once a worker."""

    def __init__(self, model_path: str, tokenizer_path: str, dimension: int = 384, max_tokens: int = 512, model_name: str = "onnx"):
        self.model_path, self.tokenizer_path = model_path, tokenizer_path
        self.dimension, self.max_tokens, self.model_name = dimension, max_tokens, model_name

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        session, tokenizer = _onnx(self.model_path, self.tokenizer_path, self.max_tokens)
        coded = tokenizer.encode_batch(texts)
        ids = np.array([c.ids for c in coded], np.int64)
        mask = np.array([c.attention_mask for c in coded], np.int64)
        given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        out = session.run(None, {i.name: given[i.name] for i in session.get_inputs() if i.name in given})[0]
        return [mean_pool(vectors, m).tolist() for vectors, m in zip(out, mask, strict=True)]


@lru_cache(2)
def _onnx(model_path: str, tokenizer_path: str, max_tokens: int):
    import onnxruntime
    from tokenizers import Tokenizer

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.enable_truncation(max_tokens)
    tokenizer.enable_padding()
    return onnxruntime.InferenceSession(model_path, options, providers=["CPUExecutionProvider"]), tokenizer


def embedding_udf(embedder: Embedder) -> Callable[[Column], Column]:
    """A column function that embeds texts in batches of BATCH, by Arrow."""

    @F.pandas_udf("array<float>")
    def embed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            out: list[list[float]] = []
            for at in range(0, len(texts), BATCH):
                out += embedder.embed_batch(texts.iloc[at : at + BATCH].tolist())
            yield pd.Series(out)

    return embed


def with_embedding(rows: DataFrame, embedder: Embedder, text: Column, into: str = "embedding") -> DataFrame:
    return rows.withColumn(into, embedding_udf(embedder)(text))

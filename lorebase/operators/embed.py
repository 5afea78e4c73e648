"""Embedders: a plug-in point, none, hashed trigrams (native), and a local ONNX model."""

from __future__ import annotations

import importlib.util
import os
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import embedding_text, trigrams
from ..functions.vector import l2_normalized


class Embedder(Protocol):
    dimensions: int
    available: bool

    def embed(self, text: Column) -> Column: ...


class NullEmbedder:
    """No vectors."""

    dimensions, available = 0, False

    def embed(self, text: Column) -> Column:
        return F.lit(None).cast("array<float>")


class HashedTrigramEmbedder:
    """Counts of trigrams in hashed buckets, length 1: deterministic, lexical, built-in functions only."""

    available = True

    def __init__(self, dimensions: int = 384):
        self.dimensions = dimensions

    def buckets(self, text: Column) -> Column:
        return F.transform(trigrams(embedding_text(text)), lambda g: (F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long") % self.dimensions).cast("int"))

    def embed(self, text: Column) -> Column:
        at = self.buckets(text)
        counts = F.transform(F.sequence(F.lit(0), F.lit(self.dimensions - 1)), lambda i: F.size(F.filter(at, lambda b: b == i)).cast("double"))
        return l2_normalized(counts).cast("array<float>")


def mean_pooled(hidden, mask):
    """Unit vectors (texts x width): the mean of the token states (texts x tokens x width) that the mask (texts x tokens) admits; zeros without any."""
    import numpy as np

    mean = (hidden * mask[:, :, None]).sum(1) / np.maximum(1, mask.sum(1, keepdims=True))
    return (mean / np.maximum(1e-12, np.linalg.norm(mean, axis=1, keepdims=True))).astype(np.float32)


class OnnxEmbedder:
    """A sentence model with mean pooling, run by Arrow batches; needs a model and a tokenizer file."""

    def __init__(self, model_path: str, tokenizer_path: str, dimensions: int = 384, max_tokens: int = 256):
        self.model_path, self.tokenizer_path = model_path, tokenizer_path
        self.dimensions, self.max_tokens, self.available = dimensions, max_tokens, True

    def embed(self, text: Column) -> Column:
        model_path, tokenizer_path, most = self.model_path, self.tokenizer_path, self.max_tokens

        @F.pandas_udf("array<float>")
        def run(batches):
            import numpy as np
            import onnxruntime as ort
            import pandas as pd
            from tokenizers import Tokenizer

            session, tokenizer = ort.InferenceSession(model_path), Tokenizer.from_file(tokenizer_path)
            tokenizer.enable_truncation(most)
            tokenizer.enable_padding()
            names = {i.name for i in session.get_inputs()}
            for texts in batches:
                codes = tokenizer.encode_batch(texts.fillna("").tolist())
                ids = np.array([c.ids for c in codes], dtype=np.int64)
                mask = np.array([c.attention_mask for c in codes], dtype=np.int64)
                given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
                hidden = session.run(None, {k: v for k, v in given.items() if k in names})[0]
                yield pd.Series(list(mean_pooled(hidden, mask)))

        from collections.abc import Iterator

        import pandas as pd

        run.func.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return run(embedding_text(text))


def select_embedder(model_path: str | None = None, tokenizer_path: str | None = None, dimensions: int = 384, enabled: bool = True, fallback: Embedder | None = None) -> Embedder:
    """The ONNX model if semantic search is enabled and both files and the runtime are there; else ``fallback``, by default no vectors."""
    other = fallback or NullEmbedder()
    if not (enabled and model_path and tokenizer_path and os.path.isfile(model_path) and os.path.isfile(tokenizer_path)):
        return other
    if not all(importlib.util.find_spec(m) for m in ("onnxruntime", "tokenizers")):
        return other
    return OnnxEmbedder(model_path, tokenizer_path, dimensions)

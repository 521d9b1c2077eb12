"""Vectors as expressions, and embedders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLES = "array<double>"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """Divided by its length; a zero vector stays as it is."""
    v = vector.cast(DOUBLES)
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(length == 0, F.lit(1.0)).otherwise(length))


def stored(vector: Column, digits: int = 6) -> Column:
    """Rounded for storage."""
    return F.transform(vector.cast(DOUBLES), lambda x: F.round(x, digits))


def hashing_embedder(size: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Texts to unit vectors without a model: signed counts of hashed words. Deterministic; for tests and fallbacks."""

    def encode(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), size), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % size] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def onnx_embedder(model_path: str, tokenizer_path: str, max_tokens: int = 256, batch: int = 32) -> Callable[[list[str]], np.ndarray]:
    """Texts to unit vectors by an ONNX sentence model: mean of the last layer under the attention mask.

    Files are opened at the first call, in the process that encodes, so a worker loads the model once.
    """
    held: list = []

    def encode(texts: list[str]) -> np.ndarray:
        if not held:
            import onnxruntime
            from tokenizers import Tokenizer

            words = Tokenizer.from_file(tokenizer_path)
            words.enable_truncation(max_tokens)
            words.enable_padding()
            held[:] = [words, onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"])]
        words, model = held
        wanted = {i.name for i in model.get_inputs()}
        parts = []
        for at in range(0, len(texts), batch):
            codes = words.encode_batch(texts[at : at + batch])
            feed = {
                "input_ids": np.array([c.ids for c in codes], np.int64),
                "attention_mask": np.array([c.attention_mask for c in codes], np.int64),
                "token_type_ids": np.array([c.type_ids for c in codes], np.int64),
            }
            last = model.run(None, {k: v for k, v in feed.items() if k in wanted})[0]
            parts.append(pooled(last, feed["attention_mask"]))
        return np.concatenate(parts) if parts else np.zeros((0, 384), np.float32)

    return encode


def pooled(states: np.ndarray, attention: np.ndarray) -> np.ndarray:
    """Mean over the tokens that are attended to, as unit vectors."""
    weight = attention[:, :, None].astype(np.float32)
    mean = (states * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


def embed(text: Column, encoder: Callable[[list[str]], np.ndarray]) -> Column:
    """array<float> of each text, by Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(encoder(texts.fillna("").tolist())))

    return run(text)

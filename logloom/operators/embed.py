"""Text embedding by a pluggable model, run on the executors."""

from __future__ import annotations

import hashlib
from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 100
_WORDS = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))  # all else is a blank


class Embedder(Protocol):
    """One vector per text, in order."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class _Slots(dict[bytes, int]):
    """Of every word seen twice its position, and one more if its sign is negative."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: bytes) -> int:
        h = hashlib.md5(word).hexdigest()
        slot = self[word] = int(h[:8], 16) % self.dim * 2 + int(h[8], 16) % 2
        return slot

    def __reduce__(self) -> tuple:
        return _Slots, (self.dim,)


class HashEmbedder:
    """Deterministic stand-in for a model: signed feature hashing of lower-case ASCII words, unit length.

    MD5 of the word: eight hex digits choose the position, the ninth the sign.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._slots = _Slots(dim)

    def embed(self, texts: list[str]) -> np.ndarray:
        if len(self._slots) > 100_000:
            self._slots.clear()
        words = [text.lower().encode("utf-8", "surrogatepass").translate(_WORDS).split() for text in texts]
        rows = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        slots = np.fromiter(map(self._slots.__getitem__, chain.from_iterable(words)), np.int64, len(rows))
        counts = np.bincount(rows * (2 * self.dim) + slots, minlength=len(texts) * 2 * self.dim).reshape(len(texts), self.dim, 2)
        out = (counts[:, :, 0] - counts[:, :, 1]).astype(np.float64)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(norm == 0, 1.0, norm)).astype(np.float32)


def embed_in_batches(embedder: Embedder, texts: list[str], batch: int = BATCH) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for i in range(0, len(texts), batch):
        part = texts[i : i + batch]
        vectors = embedder.embed(part)
        if len(vectors) != len(part):
            raise ValueError(f"embedding count mismatch: got {len(vectors)}, want {len(part)}")
        out.extend(np.asarray(vectors, dtype=np.float32))
    return out


def embed(df: DataFrame, text: str, embedder: Embedder, out: str = "vector", batch: int = BATCH) -> DataFrame:
    """Add one vector per text. Repeated texts of an Arrow batch reach the model once."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def vectors(col: pa.Array) -> pa.Array:
        coded = col.cast(pa.string()).fill_null("").dictionary_encode()
        found = embed_in_batches(embedder, coded.dictionary.to_pylist(), batch)
        rows = [found[c] for c in coded.indices.to_numpy()]
        ends = np.cumsum([0, *map(len, rows)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, np.float32)]), pa.float32()))

    return df.withColumn(out, vectors(text))

"""Embeddings: a deterministic term-hash embedder, and cosine distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.operators.errors import EmbeddingError


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in double precision; 1 where a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, 1.0 - dot(a, b) / n).otherwise(1.0)


def hash_vector(text: str | None, width: int) -> np.ndarray:
    """Each word spreads the 32 bytes of its SHA-256 over the vector from a position that the first eight give; unit length, or zero for no words."""
    out = np.zeros(width)
    if width <= 0:
        return out
    for word in (text or "").lower().split():
        digest = hashlib.sha256(word.encode()).digest()
        at = (int.from_bytes(digest[:8], "big") % width + np.arange(32)) % width
        np.add.at(out, at, (np.frombuffer(digest, np.uint8) - 128.0) / 128.0)
    length = np.sqrt((out * out).sum())
    return out / length if length > 0 else out


#: Words whose vectors an embedder remembers.
KNOWN = 1 << 18


class TermHashEmbedder:
    """An embedding provider that needs no network. Any object with ``width`` and ``embed(list[str]) -> array`` can take its place."""

    def __init__(self, width: int = 64) -> None:
        if width <= 0:
            raise EmbeddingError(f"width must be positive, not {width}")
        self.width = width
        self.known: dict[str, int] = {}
        self.base = np.zeros((0, width))

    def __getstate__(self) -> dict:
        return {"width": self.width}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def embed(self, texts: list[str]) -> np.ndarray:
        """As ``hash_vector`` of each, but a word is hashed once, and remembered while there are at most KNOWN of them."""
        known, rows = self.known, [(t or "").lower().split() for t in texts]
        new = {w for words in rows for w in words if w not in known}
        if len(known) + len(new) > KNOWN:
            known.clear()
            new = {w for words in rows for w in words}
        if len(known) + len(new) > len(self.base):
            self.base = np.concatenate([self.base, np.zeros((max(len(new), len(self.base)), self.width))])
        for word in new:
            digest = hashlib.sha256(word.encode()).digest()
            self.base[k := len(known)] = 0.0
            known[word] = k
            np.add.at(self.base[k], (int.from_bytes(digest[:8], "big") % self.width + np.arange(32)) % self.width, (np.frombuffer(digest, np.uint8) - 128.0) / 128.0)
        out = np.zeros((len(texts), self.width))
        size = np.array([len(words) for words in rows], np.int64)
        some = size > 0
        if some.any():
            flat = np.array([known[w] for words in rows for w in words])
            out[some] = np.add.reduceat(self.base[flat], (np.cumsum(size) - size)[some])  # multiples of 1/128: exact in any order
        length = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, length, out=np.zeros_like(out), where=length > 0)

    def __call__(self, text: Column) -> Column:
        return embedded(self, text)


def embedded(provider, text: Column) -> Column:
    """The provider's vectors of a text column, in Arrow batches; it is set up once for each worker, not for each row."""
    width = provider.width

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            vectors = np.asarray(provider.embed([t or "" for t in texts.to_pylist()]))
            if vectors.shape != (len(texts), width):
                raise EmbeddingError(f"provider gave {vectors.shape} for {len(texts)} texts of width {width}")
            yield pa.ListArray.from_arrays(np.arange(0, vectors.size + 1, width, dtype=np.int32), vectors.astype(np.float32).ravel())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<float>")(text)

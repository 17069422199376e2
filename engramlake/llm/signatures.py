"""b-bit signatures of texts and vectors, and the multi-index Hamming join over them.

A signature has `CHUNKS * PER` symbols. For a text a symbol is a weighted min-hash of its words (rare
words weigh more), for a vector the nearest signed axis after a random rotation of the vector without the
mean, in which directions that vary most are damped: common directions would make all vectors alike. The
distance of two signatures is the number of symbols that differ. Split into CHUNKS chunks, any two
signatures that differ in fewer than 2 * CHUNKS symbols have a chunk with at most one error
(pigeonhole); enumerating the chunk with each one of its symbols left out finds every such pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stack, unit

CHUNKS, PER = 6, 5
SYMBOLS = CHUNKS * PER
#: Two bits of each of the symbols fill one long; so many of them may differ in a candidate pair.
WORD_ERRORS, VECTOR_ERRORS = 12, 12
#: Buckets of the document frequency sketch; its size bounds what is broadcast.
DF_BUCKETS = 1 << 18
#: Sign bits that are compared before vectors are.
CODE_BITS = 256
#: See VectorSpace.fit.
DAMP = 0.25
#: Axes of a vector symbol.
AXES = 24

_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _GOLD
    x ^= x >> np.uint64(29)
    x *= _MIX
    return x ^ (x >> np.uint64(32))


def document_frequency(words: DataFrame) -> np.ndarray:
    """Counts of all texts' words(h array<long>), in DF_BUCKETS hash buckets, with one total at the end."""
    rows = (
        words.select(F.explode("h").alias("w"))
        .groupBy(F.pmod("w", F.lit(DF_BUCKETS)).alias("b"))
        .agg(F.count("*").alias("n"))
        .toPandas()  # at most DF_BUCKETS rows
    )
    out = np.zeros(DF_BUCKETS, np.float64)
    out[rows["b"].to_numpy(int)] = rows["n"]
    return out


def text_symbols(h: np.ndarray, n: np.ndarray, df: np.ndarray, texts: float) -> np.ndarray:
    """Symbols of texts given as the flat hashes of their distinct words and the number of words of each (> 0)."""
    h = h.astype(np.int64, copy=False).view(np.uint64)
    weight = np.log(1 + texts / np.maximum(1.0, df[(h % np.uint64(DF_BUCKETS)).astype(int)]))
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    out = np.empty((len(n), SYMBOLS), np.int64)
    for i in range(SYMBOLS):
        x = _mix(h + np.uint64(2 * i + 1))
        v = -np.log((x >> np.uint64(11)) * (0.5**53) + 1e-18) / weight
        best = np.minimum.reduceat(v, start)
        hit = np.flatnonzero(v == np.repeat(best, n))
        out[:, i] = h[hit[np.searchsorted(hit, start)]].view(np.int64)
    return out


def moments(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of all unit vectors of vectors(v array<float>), from partial sums of fixed size."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, c, k = np.zeros(dim), np.zeros((dim, dim)), 0
        for b in batches:
            x = unit(stack(b["v"])).astype(np.float64) if len(b) else np.zeros((0, dim))
            s += x.sum(axis=0)
            c += x.T @ x
            k += len(x)
        yield pd.DataFrame({"i": np.arange(dim * dim + dim + 1), "x": np.concatenate([c.ravel(), s, [k]])})

    got = vectors.select("v").mapInPandas(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    x = np.zeros(dim * dim + dim + 1)
    x[got["i"].to_numpy(int)] = got["x"]
    k = max(1.0, x[-1])
    mean = x[dim * dim : -1] / k
    return mean, x[: dim * dim].reshape(dim, dim) / k - np.outer(mean, mean)


class VectorSpace:
    """Mean and damped principal directions of all unit vectors; fitted from sums, whose size does not grow with the data."""

    def __init__(self, mean: np.ndarray, basis: np.ndarray):
        self.mean, self.basis = mean.astype(np.float32), basis.astype(np.float32)

    @staticmethod
    def fit(vectors: DataFrame, dim: int, damp: float = DAMP) -> VectorSpace:
        """vectors(v array<float>), usable. A direction keeps its scale up to `damp` of the variance that an average one
        of those in use has, and is scaled down to it beyond; so none is lost, and directions without variance add nothing."""
        mean, cov = moments(vectors, dim)
        var, axes = np.linalg.eigh(cov)
        var = np.maximum(var, 0)
        least = damp * (var @ var) / var.sum() if var.sum() > 0 else 1.0
        return VectorSpace(mean, axes / np.sqrt(np.maximum(var / least, 1.0)) if least > 0 else axes)

    def codes(self, x: np.ndarray, seed: int = 9) -> np.ndarray:
        """Signs of unit vectors, without the mean, along CODE_BITS random directions, packed into longs."""
        z = (x - self.mean) @ np.random.default_rng(seed).standard_normal((x.shape[1], CODE_BITS)).astype(np.float32)
        return np.packbits(z > 0, axis=1).view(np.int64)

    def symbols(self, x: np.ndarray, seed: int = 7) -> np.ndarray:
        """Symbols of unit vectors."""
        rng = np.random.default_rng(seed)
        y = (x - self.mean) @ self.basis
        out = np.empty((len(x), SYMBOLS), np.int64)
        rows = np.arange(len(x))
        for i in range(SYMBOLS):
            z = y @ rng.standard_normal((y.shape[1], AXES)).astype(np.float32)
            j = np.abs(z).argmax(axis=1)
            out[:, i] = 2 * j + (z[rows, j] > 0)
        return out


def sketch(symbols: np.ndarray) -> np.ndarray:
    """Two hashed bits of each symbol, packed into one long."""
    out = np.zeros(len(symbols), np.uint64)
    for i in range(symbols.shape[1]):
        out = (out << np.uint64(2)) | (_mix(symbols[:, i].view(np.uint64) + np.uint64(i)) >> np.uint64(62))
    return out.view(np.int64)


def chunk_keys(symbols: np.ndarray, seed: int) -> np.ndarray:
    """All keys of each signature: one for every chunk and symbol left out."""
    keys = []
    for c in range(CHUNKS):
        for out in range(PER):
            k = np.full(len(symbols), seed * 1000 + c * PER + out + 1, np.uint64)
            for i in range(PER):
                if i != out:
                    k = _mix(k ^ symbols[:, c * PER + i].view(np.uint64)) + _GOLD
            keys.append((k >> np.uint64(20)).view(np.int64))  # 44 bits tell chunks apart, and shuffle smaller
    return np.stack(keys, axis=1)


def key_rows(h: np.ndarray, symbols: np.ndarray, seed: int) -> pd.DataFrame:
    keys = chunk_keys(symbols, seed)
    each = keys.shape[1]
    return pd.DataFrame({"key": keys.ravel(), "h": np.repeat(h, each), "sk": np.repeat(sketch(symbols), each)})


def hamming_join(keys: DataFrame, errors: int) -> DataFrame:
    """Distinct (a, b), a < b, of rows keys(key, h, sk) that share a key and whose sketches differ in at most `errors` symbols."""
    x = F.expr("a.sk ^ b.sk")
    low = F.lit(0x5555555555555555)
    differ = F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(low))
    return (
        keys.alias("a")
        .join(keys.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.h") < F.col("b.h")) & (differ <= errors))
        .select(F.col("a.h").alias("a"), F.col("b.h").alias("b"))
        .distinct()
    )

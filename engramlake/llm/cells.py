"""Cells of space around pivots, whose number grows with the vectors.

The pivots of the first level are the k-means centres of a bounded sample. Where a first-level cell should
hold more than `size` vectors it gets pivots of its own, fitted in a task on a sample of that cell only. A
cell that is expected to hold more than a task should take (one dense spot may hold a third of all rows)
is not cut up in space any further: the caller gets its expected size and divides the work on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stack, unit

#: Vectors that the first level is fitted on (about; never more than twice as many), and its pivots at most.
SAMPLE, FIRST = 20_000, 2_048
#: Pivots of one first-level cell at most, and sampled vectors for each of them.
SECOND, EACH = 512, 16


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k nearest of c, nearest first."""
    k = min(k, len(c))
    out = np.empty((len(x), k), np.int64)
    for s in range(0, len(x), 4096):
        d = (c * c).sum(axis=1) - 2 * (x[s : s + 4096] @ c.T)
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[s : s + 4096] = np.take_along_axis(near, np.take_along_axis(d, near, axis=1).argsort(axis=1), axis=1)
    return out


class Cells:
    """first: pivots of the first level; starts: where the pivots of each begin in `pivots`; expected: vectors of each cell."""

    def __init__(self, first: np.ndarray, starts: np.ndarray, pivots: np.ndarray, expected: np.ndarray):
        self.first, self.starts, self.pivots, self.expected = first, starts, pivots, expected

    @staticmethod
    def fit(vectors: DataFrame, rows: int, size: int, dim: int, reduce: Callable[[np.ndarray], np.ndarray] | None = None, seed: int = 0) -> Cells:
        """Cells for about `size` of vectors(id, v) each; reduce is applied to the unit vectors first."""
        to = reduce or (lambda x: x)
        chosen = lambda share, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1_000_000)) < F.ceil(share * 1_000_000)
        got = vectors.filter(chosen(F.lit(min(1.0, SAMPLE / max(1, rows))), seed)).select("v").limit(2 * SAMPLE).toArrow().to_pandas()  # as Python floats it would be eight times as much
        x = to(unit(stack(got["v"]))) if len(got) else to(np.zeros((1, dim), np.float32))
        first = kmeans(x, int(min(max(1, rows // size), max(1, len(x) // 10), FIRST)), seed=seed)
        held = np.bincount(nearest(x, first, 1)[:, 0], minlength=len(first)) * (rows / len(x))
        want = np.clip(np.ceil(held / size).astype(int), 1, SECOND)
        if rows // size < 2 * len(first) or want.max() == 1:
            return Cells(first, np.arange(len(first) + 1), first, held)
        share = np.minimum(1.0, EACH * want / np.maximum(held, 1.0))
        most = float(share[want > 1].max())

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    y = to(unit(stack(b["v"])))
                    cell = nearest(y, first, 1)[:, 0]
                    ok = (want[cell] > 1) & (b["u"].to_numpy() < share[cell])
                    yield pd.DataFrame({"cell": cell[ok].astype(np.int32), "y": list(y[ok])})

        def split(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            y = stack(pdf["y"])
            c = kmeans(y, min(int(want[key[0]]), max(1, len(y) // 4)), seed=seed)
            n = np.bincount(nearest(y, c, 1)[:, 0], minlength=len(c)) / len(y)
            return pd.DataFrame({"cell": key[0], "share": n, "y": list(c)})

        u = (F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1_000_000)) / 1_000_000.0).alias("u")
        drawn = vectors.select("v", u).filter(F.col("u") < most).mapInPandas(draw, "cell int, y array<float>")
        below = drawn.groupBy("cell").applyInPandas(split, "cell int, share double, y array<float>").toArrow().to_pandas()  # at most FIRST * SECOND rows
        parts, sizes, starts = [], [], [0]
        for i in range(len(first)):
            own = below[below["cell"] == i]
            parts.append(stack(own["y"]) if len(own) else first[i : i + 1])
            sizes.append(own["share"].to_numpy(float) * held[i] if len(own) else held[i : i + 1])
            starts.append(starts[-1] + len(parts[-1]))
        return Cells(first, np.array(starts), np.concatenate(parts), np.concatenate(sizes))

    def nearest(self, x: np.ndarray, k: int, wide: int = 4) -> np.ndarray:
        """Cells of the k nearest pivots, nearest first; of two levels those below the `wide` nearest of the first."""
        if len(self.pivots) == len(self.first):
            return nearest(x, self.pivots, k)
        k = min(k, len(self.pivots))
        near = nearest(x, self.first, max(wide, k))
        best = np.full((len(x), k), -1, np.int64)
        far = np.full((len(x), k), np.inf, np.float32)
        for j in range(near.shape[1]):
            for i in np.unique(near[:, j]):
                rows = np.flatnonzero(near[:, j] == i)
                a, b = self.starts[i], self.starts[i + 1]
                c = self.pivots[a:b]
                d = np.concatenate([far[rows], (c * c).sum(axis=1) - 2 * (x[rows] @ c.T)], axis=1)
                at = np.concatenate([best[rows], np.broadcast_to(np.arange(a, b), (len(rows), b - a))], axis=1)
                o = np.argsort(d, axis=1, kind="stable")[:, :k]
                far[rows], best[rows] = np.take_along_axis(d, o, axis=1), np.take_along_axis(at, o, axis=1)
        return best

    def parts(self, block: int) -> np.ndarray:
        """Parts of about `block` vectors that each cell's work is divided into."""
        return np.maximum(1, np.ceil(self.expected / block)).astype(np.int64)

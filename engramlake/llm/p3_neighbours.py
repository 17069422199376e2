"""Most similar vectors for every vector, with randomly rotated one-bit codes.

Vectors are assigned to the nearest of coarse centres, whose number grows with the rows (see cells.py). What is left
after subtracting the centre is scaled to length one, rotated at random and cut to one bit per axis;
with the code go its length and the inner product of the code with what it stands for. A query is sent
to its `probes` nearest cells with its rotated residual in eight bits per axis. There the inner product
with every code of the cell is estimated from the packed bits and the two scalars; the error bound of
the estimate gives a lower and an upper bound of each cosine. Only vectors whose upper bound reaches
the k-th best lower bound of the query (and the least cosine asked for) are reranked in full precision.

Every vector is stored once and asks once, so a pair can be found from both sides. Exactly equal
vectors are one entry of the index, whose k + 1 smallest ids speak for all of them: ties go to the
smaller id, so no others can be among the k best of anything. A group of copies that holds a third of
all rows thus costs no more than its rows. The codes of a cell that is expected to hold more than PART of them
are divided into parts, and its queries go to each: a part prunes by its own k-th bound, which keeps more
candidates and loses none.

Edge cases: rows of one id count once; unusable vectors are left out; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise
from .cells import Cells
from .common import cosine, stack, unit, usable

#: Vectors that a cell should hold, and codes that one task takes.
CELL, PART = 400, 20_000
#: Width of the error bound in standard deviations.
SIGMAS = 2.2
#: Bits of a code, at least: shorter vectors are padded before the rotation, which narrows the bound.
BITS = 96
#: Candidate ids up to this number are broadcast to prune the scan for reranking; beyond it they are joined by shuffle.
BROADCAST_IDS = 300_000


def rotation(dim: int, seed: int = 1) -> np.ndarray:
    """Rows of a random orthogonal matrix: takes a vector of dim values, padded with zeros, to max(BITS, dim) axes."""
    bits = max(BITS, -(-dim // 8) * 8)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r))).astype(np.float32)[:dim]


ENTRY = "cell int, part int, is_query boolean, h long, code binary, scale float, fit float"


def encode(vectors: DataFrame, cells: Cells, p: np.ndarray, probes: int) -> DataFrame:
    """Rows of ENTRY: each vector once as a code of its cell, and once for each cell that it probes.

    A code carries its packed bits, its residual's length and the code's inner product with the residual's
    direction; a query carries its rotated residual in eight bits, their step, and the residual's length.
    """
    c, parts = cells.pivots, cells.parts(PART).astype(np.int32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, h = unit(stack(b["v"])), b["h"].to_numpy()
            near = cells.nearest(x, probes)
            home = near[:, 0]
            r = (x - c[home]) @ p
            length = np.linalg.norm(r, axis=1)
            fit = np.abs(r).sum(axis=1) / np.maximum(length, 1e-12) / np.sqrt(p.shape[1])
            bits = np.packbits(r > 0, axis=1)
            part = (h.view(np.uint64) % parts[home].astype(np.uint64)).astype(np.int32)
            yield pd.DataFrame(
                {"cell": home.astype(np.int32), "part": part, "is_query": False, "h": h, "code": [z.tobytes() for z in bits], "scale": length, "fit": fit}
            )
            for j in range(near.shape[1]):
                cell = near[:, j]
                q = (x - c[cell]) @ p
                step = np.maximum(np.abs(q).max(axis=1, keepdims=True), 1e-12) / 127
                small = np.rint(q / step).astype(np.int8)
                asks = pd.DataFrame(
                    {
                        "cell": cell.astype(np.int32),
                        "part": np.int32(0),
                        "is_query": True,
                        "h": h,
                        "code": [z.tobytes() for z in small],
                        "scale": step[:, 0],
                        "fit": np.linalg.norm(q, axis=1),
                    }
                )
                for i in range(parts[cell].max()):
                    yield (asks if not i else asks[parts[cell] > i]).assign(part=np.int32(i))

    return vectors.select("h", "v").mapInPandas(run, ENTRY)


def _scan(pdf: pd.DataFrame, dim: int, k: int, least: float, block: int) -> pd.DataFrame:
    """Candidates (a, b) of one part of a cell."""
    asks = pdf["is_query"].to_numpy(bool)
    o, q = pdf[~asks], pdf[asks]
    out: list[pd.DataFrame] = []
    if len(o) and len(q):
        oh, length, fit = o["h"].to_numpy(), o["scale"].to_numpy(np.float32), np.maximum(o["fit"].to_numpy(np.float32), 1e-6)
        bits = np.unpackbits(np.frombuffer(b"".join(o["code"]), np.uint8).reshape(len(o), -1), axis=1, count=dim)
        signs = (bits.astype(np.float32) * 2 - 1) / np.sqrt(dim)
        spread = SIGMAS * np.sqrt(np.maximum(1 - fit * fit, 0)) / fit / np.sqrt(max(1, dim - 1))
        for s in range(0, len(q), 512):
            part = q.iloc[s : s + 512]
            qh, norm = part["h"].to_numpy(), part["fit"].to_numpy(np.float32)[:, None]
            y = np.frombuffer(b"".join(part["code"]), np.int8).reshape(len(part), dim) * part["scale"].to_numpy(np.float32)[:, None]
            kth = np.full((len(part), 1), -np.inf, np.float32)
            kept = []
            for t in range(0, len(o), block):
                sl = slice(t, t + block)
                inner = (y @ signs[sl].T) / fit[sl]
                # |x - y|^2 = |q|^2 + |o|^2 - 2 |o| <o / |o|, q>; cosine = 1 - |x - y|^2 / 2
                est = 1 - (norm * norm + length[sl] ** 2) / 2 + length[sl] * inner
                err = length[sl] * spread[sl] * norm + 0.004
                same = qh[:, None] == oh[sl][None, :]
                low = np.where(same, -np.inf, est - err)
                if low.shape[1] >= k:
                    kth = np.maximum(kth, -np.partition(-low, k - 1, axis=1)[:, k - 1 : k])
                high = est + err
                i, j = np.nonzero((high >= np.maximum(kth, least)) & ~same)
                kept.append((i, t + j, high[i, j]))
            for i, j, high in kept:  # bounds of later blocks hold for earlier ones, too
                ok = high >= np.maximum(kth[i, 0], least)
                out.append(pd.DataFrame({"a": qh[i[ok]], "b": oh[j[ok]]}))
    return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})


def candidates(vectors: DataFrame, rows: int, dim: int, k: int, least: float, probes: int, block: int = 4096) -> DataFrame:
    """Distinct unordered pairs (a, b) of vectors(id, h, v) by h."""
    cells, p = Cells.fit(vectors, rows, CELL, dim), rotation(dim)
    found = (
        encode(vectors, cells, p, probes)
        .groupBy("cell", "part")
        .applyInPandas(lambda pdf: _scan(pdf, p.shape[1], k, least, block), "a long, b long")
    )
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def neighbours(
    records: DataFrame, field: str, dim: int, k: int = 5, least: float = -1.0, probes: int = 4
) -> DataFrame:
    """(id, other, cosine, rank): the k most similar others of each record(id, field), best first.

    Only others with a cosine of `least` or more come out; ties go to the smaller id.
    """
    w = Window.partitionBy("h", "h2").orderBy("id")
    ok = records.filter(F.col("id").isNotNull() & usable(F.col(field), dim))
    # every step is written, so that no plan holds more than a few joins: the driver's memory grows with the largest of them
    good = materialise(ok.select("id", F.xxhash64(field).alias("h"), F.hash(field).alias("h2")).distinct(), "p3-rows")
    # the k + 1 smallest ids of each distinct vector; the first stands for it
    firsts = materialise(good.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1), "p3-copies")
    rows = records.count()
    vec = ok.select("id", F.xxhash64("id").alias("h"), F.col(field).alias("v"))
    many = firsts.filter("n = 2").select("h", "h2")
    copied = materialise(firsts.join(many, ["h", "h2"], "left_semi"), "p3-copied")
    # only copies other than the first are taken out of the scan; a copy class of any size passes as ids, not vectors
    extra = good.join(many, ["h", "h2"], "left_semi").join(copied.filter("n = 1").select("id"), "id", "left_anti").select("id")
    single = vec.join(materialise(extra, "p3-extra"), "id", "left_anti")
    pairs = materialise(candidates(single, rows, dim, k, least, probes), "p3-pairs")
    ids = materialise(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct(), "p3-ids")
    few = ids.count() <= BROADCAST_IDS
    need = vec.join(F.broadcast(ids) if few else ids, "h", "left_semi").dropDuplicates(["h"])
    need = need.select("h", "v", F.xxhash64("v").alias("g"), F.hash("v").alias("g2"))
    one = need.withColumnsRenamed({"h": "a", "v": "v1", "g": "gx", "g2": "gx2"})
    two = need.withColumnsRenamed({"h": "b", "v": "v2", "g": "gy", "g2": "gy2"})
    exact = materialise(
        pairs.join(one, "a")
        .join(two, "b")
        .select("gx", "gx2", "gy", "gy2", cosine(F.col("v1"), F.col("v2")).alias("cosine"))
        .filter(F.col("cosine") >= least),
        "p3-exact",
    )
    # candidates of a vector: the first ids of each near vector; of a copy: those of its own vector too
    near = exact.unionByName(exact.toDF("gy", "gy2", "gx", "gx2", "cosine"))
    firsts2 = firsts.select(F.col("h").alias("gy"), F.col("h2").alias("gy2"), F.col("id").alias("other"))
    w2 = Window.partitionBy("gx", "gx2").orderBy(F.desc("cosine"), "other")
    best = near.join(firsts2, ["gy", "gy2"]).withColumn("r", F.row_number().over(w2)).filter(F.col("r") <= k).select("gx", "gx2", "other", "cosine")
    best = materialise(best, "p3-best")
    own = copied.select(F.col("h").alias("gx"), F.col("h2").alias("gx2"), F.col("id").alias("other"), F.lit(1.0).alias("cosine"))
    asks = good.select(F.col("h").alias("gx"), F.col("h2").alias("gx2"), "id")
    w3 = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return (
        asks.join(best.unionByName(own), ["gx", "gx2"])
        .filter("id <> other")
        .withColumn("rank", F.row_number().over(w3))
        .filter(F.col("rank") <= k)
        .select("id", "other", "cosine", "rank")
    )


def close_pairs(records: DataFrame, fields: dict[str, int], k: int = 5, least: float = 0.96, probes: int = 4) -> DataFrame:
    """(memory_id_a, memory_id_b, vec_field): pairs in which one is among the k most similar of the other."""
    out = None
    for field, dim in fields.items():
        n = neighbours(records, field, dim, k, least, probes)
        p = n.select(
            F.least("id", "other").alias("memory_id_a"), F.greatest("id", "other").alias("memory_id_b"), F.lit(field).alias("vec_field")
        ).distinct()
        p = materialise(p, f"p3-{field}")
        out = p if out is None else out.unionByName(p)
    return out

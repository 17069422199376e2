"""Grouping records into similarity clusters by density, over spatially partitioned reduced vectors.

Unit vectors are reduced to their leading principal directions (from sums over all rows). Pivots, whose
number grows with the rows (see cells.py), cut space into cells of about CELL rows; a vector belongs to
the cells of its `overlap` nearest pivots, so neighbouring cells overlap in a margin. Each cell is
clustered on its own: vectors with at least `min_pts` vectors within the angle (themselves included) are
core points; core points within it of each other, and what is near them, are one local cluster. A core
point that lies in several local clusters joins them: the clusters are the connected groups of that
small graph (p1).

A cell that is expected to hold more than BLOCK rows is dealt out to parts, and every two parts meet in a
task of their own. Core points are counted over all of these tasks first, and any two rows of the cell
are in one of them, so what comes out is what one task over the whole cell would give.

Clusters come out with their size and medoids: among unit vectors the member with the largest sum of
cosines is the one nearest to the mean, and the mean cosine of all pairs follows from the length of the
mean, so no pairs are needed. Nor does the exact check that every two members are similar need pairs of
members near the mean: members at angles s and t from it are at most s + t apart. Only members farther
out than half the allowed angle are compared, as a stated query set and in blocks, with those for which
the sum can exceed it.

Edge cases: rows of one id count once; unusable vectors belong to no cluster; a vector that very many
ids hold (see p4_neardup.copy_classes) is one point with a weight, so copies that make up a third of all
rows are one point; an empty table gives no rows; other columns are not read.
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
from .common import cosine, skew_join, stack, unit, usable
from .p1_groups import connected_groups
from .p4_neardup import copy_classes
from .signatures import moments

CELL, BLOCK, REDUCED = 1_500, 6_000, 32
#: Groups up to this number are broadcast; beyond it they are joined by shuffle.
BROADCAST_GROUPS = 20_000
LOCAL = "id string, weight long, cluster string, core boolean, home boolean, v array<float>"


def density(x: np.ndarray, weight: np.ndarray, t: float, min_pts: int, core: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(local cluster or -1, core) of unit vectors; core is counted here unless it is given."""
    n = len(x)
    near = np.empty((n, n), bool)
    for s in range(0, n, 1024):
        near[s : s + 1024] = x[s : s + 1024] @ x.T >= t
    np.fill_diagonal(near, True)
    if core is None:
        core = near @ weight >= min_pts
    label = np.full(n, -1)
    k = 0
    for seed in np.flatnonzero(core):
        if label[seed] >= 0:
            continue
        front = np.array([seed])
        label[seed] = k
        while len(front):
            reached = near[front].any(axis=0) & (label < 0)
            label[reached] = k
            front = np.flatnonzero(reached & core)
        k += 1
    return label, core


def _cell(key: tuple, pdf: pd.DataFrame, t: float, min_pts: int) -> pd.DataFrame:
    """LOCAL rows of one cell, or of two parts of a cell whose core points are known."""
    core = pdf["core"].to_numpy(bool) if "core" in pdf else None
    label, core = density(stack(pdf["v"]), pdf["weight"].to_numpy(float), t, min_pts, core)
    keep = label >= 0
    name = "-".join(str(k) for k in key)
    out = pdf[["id", "weight", "home", "v"]][keep].copy()
    # strings even where no row is kept: an empty column of no type is no Arrow string
    out["cluster"] = np.array([f"{name}-{k}" for k in label[keep]], object)
    out["core"] = core[keep]
    out["v"] = out["v"].where(out["home"], None)
    return out[["id", "weight", "cluster", "core", "home", "v"]]


def _count(key: tuple, pdf: pd.DataFrame, t: float) -> pd.DataFrame:
    """Weight within the angle of each row of two parts a and b of a cell: rows of a in b, and the reverse; of a part in itself."""
    x, weight, part = stack(pdf["v"]), pdf["weight"].to_numpy(float), pdf["part"].to_numpy()
    n = np.zeros(len(x))
    for one, other in {(key[1], key[2]), (key[2], key[1])}:
        mine, theirs = np.flatnonzero(part == one), np.flatnonzero(part == other)
        for s in range(0, len(mine), 1024):
            r = mine[s : s + 1024]
            near = x[r] @ x[theirs].T >= t
            if one == other:
                near[np.arange(len(r)), s + np.arange(len(r))] = True
            n[r] += near @ weight[theirs]
    return pd.DataFrame({"cell": key[0], "id": pdf["id"], "n": n})


def local_clusters(points: DataFrame, rows: int, dim: int, t: float, min_pts: int, overlap: int) -> DataFrame:
    """LOCAL rows of points(id, weight, v): the clustered points of each cell; v only once for a point."""
    mean, cov = moments(points, dim)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :REDUCED].astype(np.float32)
    mean = mean.astype(np.float32)
    cells = Cells.fit(points, rows, CELL, dim, lambda x: (x - mean) @ axes)
    parts = Cells.parts(cells, BLOCK / overlap)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            if not len(whole):
                continue
            x = unit(stack(whole["v"]))
            near = cells.nearest((x - mean) @ axes, overlap)
            vectors = np.empty(len(x), object)
            vectors[:] = list(x)
            for j in range(near.shape[1]):
                cell, n = near[:, j], parts[near[:, j]]
                own = (pd.util.hash_array(whole["id"].to_numpy(str).astype(object)) % n.astype(np.uint64)).astype(np.int64)
                for other in range(n.max()):  # more than one turn for large cells only
                    r = np.flatnonzero(other < n)
                    yield pd.DataFrame(
                        {
                            "cell": cell[r],
                            "a": np.minimum(own[r], other),
                            "b": np.maximum(own[r], other),
                            "part": own[r],
                            "n": n[r],
                            "id": whole["id"].to_numpy()[r],
                            "weight": whole["weight"].to_numpy()[r],
                            # the vector goes on from one task only
                            "home": (j == 0) & (other == np.where(n[r] > 1, (own[r] + 1) % n[r], 0)),
                            "v": vectors[r],
                        }
                    )

    def cell(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _cell(key, pdf, t, min_pts)

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _count(key, pdf, t)

    all_ = points.mapInPandas(assign, "cell int, a int, b int, part int, n int, id string, weight long, home boolean, v array<float>")
    kept = ["cell", "a", "b", "id", "weight", "home", "v"]
    if parts.max() == 1:
        return all_.select(kept).groupBy("cell", "a", "b").applyInPandas(cell, LOCAL)
    all_ = materialise(all_, "p6-cells")
    large = all_.filter("n > 1")
    core = large.groupBy("cell", "a", "b").applyInPandas(count, "cell int, id string, n double").groupBy("cell", "id").agg((F.sum("n") >= min_pts).alias("core"))
    met = large.filter("a < b").select(kept).join(materialise(core, "p6-core"), ["cell", "id"])
    small = all_.filter("n = 1").select(kept).groupBy("cell", "a", "b").applyInPandas(cell, LOCAL)
    return small.unionByName(met.groupBy("cell", "a", "b").applyInPandas(cell, LOCAL))


def _small(df: DataFrame, count: int) -> DataFrame:
    return F.broadcast(df) if count <= BROADCAST_GROUPS else df


def _with_vectors(own: DataFrame, points: DataFrame) -> DataFrame:
    """own(id, weight, v, group) with the unit vector of those that have none: a point may be clustered in another cell than that of its vector."""
    x = F.transform("v", lambda e: e.cast("double"))
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e))
    v = points.select("id", F.transform(x, lambda e: (e / length).cast("float")).alias("v"))
    return own.filter("v is not null").unionByName(own.filter("v is null").drop("v").join(v, "id").select("id", "weight", "v", "group"))


def clusters(
    records: DataFrame,
    field: str = "vector",
    dim: int = 96,
    min_cosine: float = 0.65,
    min_size: int = 20,
    min_pts: int = 4,
    overlap: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """(members, summary) of records(id, field).

    members(id, group_id): the members of clusters of at least min_size records in which every two have at
    least min_cosine. summary(group_id, n_members, avg_cosine, medoids): medoids are the three most typical
    ids, best first, joined by commas.
    """
    f = (
        records.filter(F.col("id").isNotNull() & usable(F.col(field), dim))
        .select("id", F.xxhash64("id").alias("h"), F.col(field).alias("v"))
        .dropDuplicates(["id"])
    )
    f = materialise(f, "p6-vectors")
    rows = f.count()
    many = materialise(copy_classes(f, "v", max(64, rows // 20_000)), "p6-copies")
    f = f.withColumns({"c": F.xxhash64("v"), "c2": F.hash("v")}).join(F.broadcast(many), ["c", "c2"], "left")
    copies = f.filter("rep <> id").select("id", "rep")
    points = f.filter("rep is null or rep = id").select("id", F.coalesce("n", F.lit(1)).cast("long").alias("weight"), "v")
    local = materialise(local_clusters(points, rows, dim, min_cosine, min_pts, overlap), "p6-local")

    # core points that lie in several local clusters join them
    shared = local.filter("core").groupBy("id").agg(F.min("cluster").alias("u"), F.collect_set("cluster").alias("all")).filter(F.size("all") > 1)
    edges = shared.select("u", F.explode("all").alias("v")).filter("u <> v").distinct()
    joined = connected_groups(edges).select(F.col("x").alias("cluster"), "group")
    named = local.join(joined, "cluster", "left").withColumn("group", F.coalesce("group", "cluster"))
    # a border point of two clusters belongs to the one with the smaller name
    own = named.groupBy("id").agg(
        F.min(F.struct((~F.col("core")).alias("border"), F.col("group").alias("group"))).alias("g"),
        F.max("weight").alias("weight"),
        F.max("v").alias("v"),
    )
    own = materialise(_with_vectors(materialise(own.select("id", "weight", "v", "g.group"), "p6-owned"), points), "p6-own")
    sizes = own.groupBy("group").agg(F.sum("weight").alias("n")).filter(F.col("n") >= min_size)
    sizes = materialise(sizes, "p6-sizes")
    groups = sizes.count()
    large = own.join(_small(sizes, groups), "group")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = stack(b["v"]).astype(np.float64) * b["weight"].to_numpy(float)[:, None]
                names, code = np.unique(b["group"].to_numpy(str), return_inverse=True)
                s = np.zeros((len(names), dim))
                np.add.at(s, code, x)
                yield pd.DataFrame({"group": np.repeat(names, dim), "i": np.tile(np.arange(dim, dtype=np.int32), len(names)), "x": s.ravel()})

    mean = (
        large.select("group", "weight", "v")
        .mapInPandas(sums, "group string, i int, x double")
        .groupBy("group", "i")
        .agg(F.sum("x").alias("x"))
        .groupBy("group")
        .agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
        .select("group", F.transform("s", lambda e: e["x"]).alias("mean"))
    )
    mean = materialise(mean, "p6-means")
    if groups <= BROADCAST_GROUPS:
        placed = large.join(F.broadcast(mean), "group")
    else:
        placed = skew_join(large, mean, "group", "inner", rows)
    placed = materialise(placed.select("group", "id", "weight", "n", "v", cosine(F.col("v"), F.col("mean")).alias("near")), "p6-placed")
    bad = _dissimilar(placed, min_cosine, groups)
    # the copies' ids count for the smallest one, too
    ids = copies.select(F.col("rep").alias("id"), F.col("id").alias("other")).groupBy("id").agg(F.min("other").alias("other"))
    good = placed.join(_small(bad, groups), "group", "left_anti").join(F.broadcast(ids), "id", "left")
    name = good.groupBy("group").agg(F.min(F.least("id", F.coalesce("other", "id"))).alias("group_id"))
    good = good.join(_small(name, groups), "group").select("id", "group_id", "group", "near", "weight", "n")
    reps = good.join(F.broadcast(many.select(F.col("rep").alias("id"))), "id", "left_semi").select(F.col("id").alias("rep"), "group_id")
    members = good.select("id", "group_id").unionByName(copies.join(F.broadcast(reps), "rep").select("id", "group_id"))
    w = Window.partitionBy("group", "group_id").orderBy(F.desc("near"), "id")
    top = (
        good.withColumn("r", F.row_number().over(w))
        .filter("r <= 3")
        .groupBy("group", "group_id", "n")
        .agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("m"))
    )
    length = F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x)
    summary = top.join(_small(mean, groups), "group").select(
        "group_id",
        F.col("n").alias("n_members"),
        F.round((length - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("avg_cosine"),
        F.array_join(F.transform("m", lambda x: x["id"]), ",").alias("medoids"),
    )
    return members, summary


def _dissimilar(placed: DataFrame, min_cosine: float, groups: int, block: int = 2048) -> DataFrame:
    """(group) of the clusters that have two members with less than min_cosine."""
    limit = float(np.arccos(min_cosine))
    p = placed.select("group", "id", "v", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "near"))).alias("far"))
    reach = p.groupBy("group").agg(F.max("far").alias("most")).filter(F.col("most") > limit / 2 - 1e-4)
    p = p.join(_small(reach, groups), "group").filter(F.col("far") > F.lit(limit - 1e-4) - F.col("most"))
    outer = F.col("far") > limit / 2 - 1e-4
    n = p.groupBy("group").agg(
        F.greatest(F.ceil(F.count_if(outer) / block), F.lit(1)).cast("int").alias("qs"), F.ceil(F.count("*") / block).cast("int").alias("ts")
    )
    p = p.join(_small(n, groups), "group")
    at = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    q = p.filter(outer).select("group", "v", at("qs").alias("q"), every("ts").alias("t"))
    t = p.select(F.col("group").alias("g"), F.col("v").alias("y"), at("ts").alias("t"), every("qs").alias("q"))

    def worst(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"group": pd.Series(dtype=str)})
        x, y = stack(a["v"]), stack(b["y"])
        low = min((x[s : s + 1024] @ y.T).min() for s in range(0, len(x), 1024))
        return a[["group"]].head(1) if low < min_cosine - 1e-6 else a[["group"]].head(0)

    return q.groupBy("group", "q", "t").cogroup(t.groupBy("g", "q", "t")).applyInPandas(worst, "group string").distinct()

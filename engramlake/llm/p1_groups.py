"""Consolidating pairwise matches into groups.

Connected components on a two-dimensional grid. Vertices are hashed into g blocks; the edge (u, v)
belongs to the cell (block of u, block of v). Each cell runs union-find over its own edges. Row and
column representatives of a vertex are then exchanged: all representatives that one vertex got in
different cells are one group, so they become the edges of the next, smaller graph. This repeats
until no edges are left; the parents are then resolved backwards, and each group is named after its
smallest vertex. Representatives are chosen in a new hashed order each round, so that a chain whose ids
rise along it loses as many vertices a round as any other (about a third).

A vertex that holds a third of all edges is spread over the g cells of its row. A cell never holds
more than about `cell_edges` edges, as g grows with the number of edges.

Edge cases: null ends, self-links, repeated links and both directions of one link add nothing; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import skew_join

#: A residual graph of at most so many edges is finished in one cell.
LAST_EDGES = 20_000


def _union_find(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest vertex of each component by hooking roots and halving paths on arrays."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        open_ = a != b
        if not open_.any():
            return parent
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent != parent[parent]).any():
            parent = parent[parent]


def _cell(pdf: pd.DataFrame, turn: int) -> pd.DataFrame:
    codes, names = pd.factorize(np.concatenate([pdf["u"].to_numpy(), pdf["v"].to_numpy()]))
    names = np.asarray(names, dtype=object)
    order = np.argsort(pd.util.hash_array(names, hash_key=f"{turn:016d}"), kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    names, codes, n = names[order], rank[codes], len(pdf)
    parent = _union_find(codes[:n], codes[n:], len(names))
    return pd.DataFrame({"x": names, "rep": names[parent]})


def _cells(turn: int):
    return lambda pdf: _cell(pdf, turn)


def connected_groups(edges: DataFrame, cell_edges: int = 1_000_000, min_grid: int = 3) -> DataFrame:
    """(x, group) for every vertex of edges(u, v): group is the smallest vertex that x reaches.

    u and v are strings, compared as strings. Vertices without an edge to another do not come out.
    """
    e = (
        edges.select("u", "v")
        .filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )
    e = materialise(e, "p1-edges")
    left = e.count()
    levels: list[tuple[DataFrame, int]] = []
    first = True
    turn = 0
    while left or first:
        g = 1 if left <= LAST_EDGES and not first else max(min_grid, math.ceil(math.sqrt(left / cell_edges)))
        block = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(g))  # noqa: E731, B023
        cells = e.withColumns({"row": block("u"), "col": block("v")})
        forest = cells.groupBy("row", "col").applyInPandas(_cells(turn), "x string, rep string")
        # a vertex has at most 2g - 1 representatives
        level = materialise(
            forest.groupBy("x")
            .agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), "rep")).alias("p"), F.collect_set("rep").alias("reps"))
            .select("x", F.col("p.rep").alias("p"), "reps"),
            "p1-level",
        )
        e = (
            level.filter(F.size("reps") > 1)
            .select("p", F.explode("reps").alias("r"))
            .filter("r <> p")
            .select(F.least("p", "r").alias("u"), F.greatest("p", "r").alias("v"))
            .distinct()
        )
        stat = level.agg(F.count("*").alias("n"), F.sum(F.size("reps") - 1).alias("e")).first()
        levels.append((level.select("x", "p"), stat["n"]))
        left, first, turn = stat["e"] or 0, False, turn + 1
    group, n = levels.pop()
    group = group.withColumnRenamed("p", "group")
    while levels:
        level, n = levels.pop()
        up = group.select(F.col("x").alias("p"), "group")
        group = skew_join(level, up, "p", "left", n).select("x", F.coalesce("group", "p").alias("group"))
        group = materialise(group, "p1-group")
    least = group.groupBy("group").agg(F.min("x").alias("least"))
    return skew_join(group, least, "group", "inner", n).select("x", F.col("least").alias("group"))


def semantic_edges(links: DataFrame, memories: DataFrame, min_strength: float = 0.5) -> DataFrame:
    """(u, v) of semantic links of enough strength between two different memories.

    A null or NaN strength is no number and does not count; the type is compared trimmed and lower-cased.
    """
    ok = (
        links.filter(F.lower(F.trim("link_type")) == "semantic")
        .filter(F.col("strength").isNotNull() & ~F.isnan("strength") & (F.col("strength") >= min_strength))
        .filter("source_id <> target_id")
        .select(F.least("source_id", "target_id").alias("u"), F.greatest("source_id", "target_id").alias("v"))
        .distinct()
    )
    ids = memories.select("id").filter("id is not null").distinct()
    rows = links.count()
    ok = skew_join(ok, ids.withColumnRenamed("id", "u"), "u", "left_semi", rows)
    return skew_join(ok, ids.withColumnRenamed("id", "v"), "v", "left_semi", rows).select("u", "v")


def memory_groups(links: DataFrame, memories: DataFrame, min_strength: float = 0.5) -> DataFrame:
    """(memory_id, group_id) of every memory that semantic links join to another, directly or not."""
    return connected_groups(semantic_edges(links, memories, min_strength)).select(
        F.col("x").alias("memory_id"), F.col("group").alias("group_id")
    )

"""Vector search and hybrid scoring: top-k of a stated query set against all memories."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import decay, text, vec
from ..params import Params
from ..tables import lit_ts

#: Queries up to this number are broadcast to the scan; beyond it they meet the rows block by block through a shuffle.
BROADCAST_QUERIES = 10_000
#: Rows of one part in that case, and hits that a task gathers before it keeps the best.
PART_ROWS, GATHER = 100_000, 2_000_000
HITS = "qid string, id string, grp string, sim double"
#: Rows of a container that one task scores; a larger container is divided.
CONTAINER_ROWS = 50_000
#: Cosines that are held at once then.
CELLS = 4_000_000
SCORED = "qid string, id string, container_tag string, similarity double"
#: sim and tags_sim are null where the row is none of the nearest of its part.
PARTIAL = "qid string, id string, container_tag string, sim double, tags_sim double, boost double, r double"


def _matrix(s: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in s])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k largest of each row; of equals at the cut the smaller index."""
    if sims.shape[1] <= k:
        return np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(sims, best, axis=1).min(axis=1)
    for i in np.flatnonzero((sims >= least[:, None]).sum(axis=1) > k):  # ties at the cut
        sure = np.flatnonzero(sims[i] > least[i])
        best[i] = np.concatenate([sure, np.flatnonzero(sims[i] == least[i])[: k - len(sure)]])
    return best


class _Best:
    """The k best different ids of each query, or of each query and group of rows, over all batches that a task reads."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, own: np.ndarray | None, k: int, least: float | None = None):
        #: own: the group each query is bound to; least: rows of a smaller cosine are no hits
        self.qids, self.q, self.own, self.k, self.least = qids, q, own, k, least
        self.parts: list[tuple] = []
        self.size, self.limit = 0, GATHER

    def add(self, ids: np.ndarray, x: np.ndarray, groups: np.ndarray) -> None:
        ids, one = np.unique(ids.astype(str), return_index=True)  # sorted: of equals the smaller id comes first
        x, groups = x[one], groups[one]
        for g in pd.unique(groups):
            rows = np.flatnonzero(groups == g)
            asks = np.arange(len(self.q)) if self.own is None else np.flatnonzero(self.own == g)
            for s in range(0, len(asks), 512):
                self._gather(asks[s : s + 512], rows, ids, x, g)
                if self.size > self.limit:
                    self.parts = [self._reduced()]
                    self.size = len(self.parts[0][0])
                    self.limit = max(GATHER, 2 * self.size)

    def _gather(self, asks: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, g: str) -> None:
        sims, k = self.q[asks] @ x[rows].T, self.k
        if self.least is not None:
            i, j = np.nonzero(sims >= self.least - 1e-9)  # few, so that no query's rows need to be ordered
            self.parts.append((asks[i], np.full(len(i), g, object), ids[rows[j]], sims[i, j]))
            self.size += len(i)
            return
        best = _top(sims, k)
        n = best.shape[1]
        self.parts.append((np.repeat(asks, n), np.full(best.size, g, object), ids[rows[best.ravel()]], np.take_along_axis(sims, best, axis=1).ravel()))
        self.size += best.size

    def _reduced(self) -> tuple:
        asks, groups, ids, sims = (np.concatenate(c) for c in zip(*self.parts))
        g = pd.factorize(groups)[0]
        order = np.lexsort((ids, -sims, g, asks))
        asks, groups, ids, sims, g = asks[order], groups[order], ids[order], sims[order], g[order]
        new = np.append(True, (asks[1:] != asks[:-1]) | (g[1:] != g[:-1]))
        fresh = new | np.append(True, ids[1:] != ids[:-1])
        asks, groups, ids, sims, new = asks[fresh], groups[fresh], ids[fresh], sims[fresh], new[fresh]
        at = np.arange(len(asks))
        keep = at - np.maximum.accumulate(np.where(new, at, 0)) < self.k
        return asks[keep], groups[keep], ids[keep], sims[keep]

    def hits(self) -> Iterator[pd.DataFrame]:
        if self.parts:
            asks, groups, ids, sims = self._reduced()
            for s in range(0, len(asks), 50_000):
                e = slice(s, s + 50_000)
                yield pd.DataFrame({"qid": self.qids[asks[e]], "id": ids[e], "grp": groups[e], "sim": sims[e]})


def nearest(rows: DataFrame, queries: DataFrame, field: str, dim: int, k: int, within: str | None = None, by: str | None = None, least: float | None = None) -> DataFrame:
    """(qid, id, grp, sim, rank): the k rows(id, field) of largest cosine for each of queries(qid, field).

    within: a column of both; a query sees the rows of its own value only. by: a column of rows; the k best
    of each of its values come out. least: the smallest cosine of a hit. Each task keeps its k best over all that it reads, so what is shuffled
    does not grow with the rows of a task, and no vector is shuffled. Rows of one id (equal in field) count
    once. Unusable vectors take no part; ties go to the smaller id.
    """
    v = F.col(field)
    group = F.coalesce(F.col(within or by), F.lit("")) if within or by else F.lit("")
    r = rows.filter(F.col("id").isNotNull() & vec.usable(v, dim)).select("id", v.alias("v"), group.alias("grp"))
    own = F.col(within) if within else F.lit(None).cast("string")
    q = queries.filter(F.col("qid").isNotNull() & vec.usable(v, dim)).select("qid", v.alias("qv"), own.alias("own"))
    if within:
        q = q.filter("own is not null")
        r = r.filter("grp <> ''")

    def start(p: pd.DataFrame) -> tuple:
        return p["qid"].to_numpy(), _matrix(p["qv"]), p["own"].to_numpy() if within else None, k, least

    some = q.limit(BROADCAST_QUERIES + 1).toPandas()
    if not len(some):
        found = q.sparkSession.createDataFrame([], HITS)
    elif len(some) <= BROADCAST_QUERIES:
        shared = q.sparkSession.sparkContext.broadcast(start(some))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = _Best(*shared.value)
            for b in batches:
                if len(b):
                    best.add(b["id"].to_numpy(), _matrix(b["v"]), b["grp"].to_numpy())
            yield from best.hits()

        found = r.mapInPandas(scan, HITS)
    else:
        blocks, parts = -(-q.count() // BROADCAST_QUERIES), max(1, -(-rows.count() // PART_ROWS))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        q2 = q.withColumns({"block": F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"), "part": every(parts)})
        r2 = r.withColumns({"part": F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), "block": every(blocks)})

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({c: pd.Series(dtype=float if c == "sim" else str) for c in ("qid", "id", "grp", "sim")})]
            if len(a) and len(b):
                best = _Best(*start(a))
                for s in range(0, len(b), 10_000):
                    e = b.iloc[s : s + 10_000]
                    best.add(e["id"].to_numpy(), _matrix(e["v"]), e["grp"].to_numpy())
                out = list(best.hits()) or out
            return pd.concat(out)

        found = q2.groupBy("block", "part").cogroup(r2.groupBy("block", "part")).applyInPandas(meet, HITS)
    w = Window.partitionBy("qid", *(["grp"] if by else [])).orderBy(F.desc("sim"), "id")
    one = found.repartition("qid").groupBy("qid", "grp", "id").agg(F.round(F.max("sim"), 12).alias("sim"))  # a repeated id may lie in two tasks; copies tie
    if least is not None:
        one = one.filter(F.col("sim") >= least)
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(rows: DataFrame, queries: DataFrame, field: str, dim: int, k: int, strategy: str = "exact", least: float = 0.75) -> DataFrame:
    """nearest() by the strategy: "exact" orders all rows for a query, "approximate" gives up those of a cosine below `least`."""
    if strategy == "exact":
        return nearest(rows, queries, field, dim, k).drop("grp")
    if strategy == "approximate":
        return nearest(rows, queries, field, dim, k, least=least).drop("grp")
    raise ValueError(f"unknown strategy {strategy}")


def hybrid(
    rows: DataFrame,
    memories: DataFrame,
    queries: DataFrame,
    as_of: dt.datetime,
    p: Params,
    k: int,
    container: str = "none",
    dim: int = 96,
    tags_dim: int = 32,
    lang: str = "eng",
) -> DataFrame:
    """(qid, id, container_tag, similarity, rank) by (cosine + tag_weight * max(tag cosine, keyword rate)) * retrievability.

    rows(id, vector, tags_vector, container_tag) are scanned, ids may repeat; memories has one row per id
    and no vectors: (id, container_tag, tags, created_at, last_accessed_at, stability). queries(qid, vector,
    tags_vector, content, container_tag). Both indexes are asked for over_fetch * k rows. container: "none";
    "post" (only the query's container, after the cut) or "pre" (before it); "each" (k hits of every container).
    """
    wide = p.over_fetch * k
    own = memories.select(
        "id",
        "container_tag",
        text.normal_tags(F.col("tags")).alias("t"),
        decay.days_between(lit_ts(as_of), F.coalesce("last_accessed_at", "created_at")).alias("days"),
        F.coalesce("stability", F.lit(p.initial_stability)).alias("s"),
    )
    r = decay.retrievability(F.col("days"), F.col("s"), p) if p.decay_enabled else F.lit(1.0)
    kw = queries.select("qid", text.keywords(F.col("content"), lang).alias("kw"))
    if container == "each":
        asked = queries.select("qid", "vector", "tags_vector").join(kw, "qid")
        return _each(rows, own.select("id", "container_tag", "t", r.alias("r")), asked, p, k, wide, dim, tags_dim)
    cont = queries.select("qid", F.col("container_tag").alias("q_container"))
    bound = {"within": "container_tag"} if container == "pre" else {}

    def ask(field: str, n: int, name: str) -> DataFrame:
        return nearest(rows, queries, field, n, wide, **bound).select("qid", "id", F.col("sim").alias(name))

    found = ask("vector", dim, "content_sim").join(ask("tags_vector", tags_dim, "tags_sim"), ["qid", "id"], "full")
    hit = F.size(F.filter("kw", lambda w: F.exists("t", lambda t: t.contains(w))))
    boost = F.when(F.size("kw") > 0, hit / F.size("kw")).otherwise(0.0)
    z = F.lit(0.0)
    score = (F.coalesce("content_sim", z) + F.lit(p.tag_weight) * F.greatest(F.coalesce("tags_sim", z), boost)) * r
    full = found.join(own, "id").join(kw, "qid").join(cont, "qid")
    if container == "post":
        full = full.filter(F.col("container_tag") == F.col("q_container"))
    w = Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")
    return (
        full.select("qid", "id", "container_tag", score.alias("similarity"))
        .filter((F.col("similarity") >= p.similarity_threshold) & ~F.isnan("similarity"))
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
    )


class _Asked:
    """Queries of a block: ids, unit vectors of both kinds (zeros where a query has none that is usable) and counted keywords."""

    def __init__(self, pdf: pd.DataFrame, dims: tuple[int, int]):
        self.qids = pdf["qid"].to_numpy()
        self.sides = []
        for field, n in zip(("vector", "tags_vector"), dims):
            ok = np.flatnonzero(pdf[field].notna().to_numpy())
            x = np.zeros((len(pdf), n))
            if len(ok):
                x[ok] = _matrix(pdf[field].iloc[ok])
            self.sides.append((np.isin(np.arange(len(pdf)), ok), x))
        words = [list(w) for w in pdf["kw"]]
        self.length = np.array([len(w) for w in words], float)
        flat = np.array([x for w in words for x in w], object)
        self.code, self.words = pd.factorize(flat)
        self.who = np.repeat(np.arange(len(words)), self.length.astype(int))

    def counts(self, tags: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Keywords that some of the tags contain: (how often each query has them, which tags contain them)."""
        every = "\n".join(tags)  # a keyword has letters and digits only
        known = np.array([i for i, w in enumerate(self.words) if w in every], int)
        number = np.full(len(self.words), -1)
        number[known] = np.arange(len(known))
        n = np.zeros((len(self.qids), len(known)), np.float32)
        has = number[self.code] >= 0 if len(self.code) else np.zeros(0, bool)
        np.add.at(n, (self.who[has], number[self.code[has]]), 1)
        return n, np.array([[self.words[i] in t for t in tags] for i in known], bool).reshape(len(known), len(tags))


def _near_pairs(asked: _Asked, rows: pd.DataFrame, dims: tuple[int, int], wide: int) -> Iterator[tuple]:
    """(query, row, sim, tags_sim, boost) arrays, query by query, of the `wide` rows nearest by either vector; rows are in order of ids."""
    m = len(rows)
    held = []
    for field, n in zip(("vector", "tags_vector"), dims):
        ok = np.flatnonzero(rows[field].notna().to_numpy())
        held.append((ok, _matrix(rows[field].iloc[ok]) if len(ok) else np.zeros((0, n))))
    tags, who = pd.Series([t for ts in rows["t"] for t in ts], dtype=object), np.repeat(np.arange(m), [len(ts) for ts in rows["t"]])
    code, names = pd.factorize(tags)
    n, contains = asked.counts(list(names))
    hit = np.zeros((m, len(contains)), np.float32)
    for i, in_tag in enumerate(contains):
        hit[who[in_tag[code]], i] = 1
    step = max(1, CELLS // m)
    for s in range(0, len(asked.qids), step):
        e = slice(s, min(s + step, len(asked.qids)))
        found = []
        for (asks, q), (ok, x) in zip(asked.sides, held):
            a = np.flatnonzero(asks[e])
            sims = q[e][a] @ x.T
            best = _top(sims, wide)
            pair = (a[:, None] * m + ok[best]).ravel()
            order = np.argsort(pair)
            found.append((pair[order], np.round(np.take_along_axis(sims, best, axis=1).ravel()[order], 12)))
        pairs = np.union1d(found[0][0], found[1][0])
        sims = []
        for pair, sim in found:
            out = np.full(len(pairs), np.nan)
            out[np.searchsorted(pairs, pair)] = sim
            sims.append(out)
        a, b = pairs // m, pairs % m
        hits = (n[e] @ hit.T)[a, b].astype(float) if len(contains) else np.zeros(len(a))
        yield a + s, b, *sims, hits / np.maximum(asked.length[a + s], 1.0)


def _each(rows: DataFrame, own: DataFrame, queries: DataFrame, p: Params, k: int, wide: int, dim: int, tags_dim: int) -> DataFrame:
    """hybrid() for container "each".

    The nearest of every container are as many as queries times containers, so they are not gathered by the
    tasks that read the rows: rows move to their container once, vectors included, and a task that holds a
    container scores its own nearest for one block of queries after another and gives the k best. A container
    of more than CONTAINER_ROWS rows is divided; the nearest of its parts are ranked before they are scored.
    rows(id, vector, tags_vector, container_tag), own(id, container_tag, t, r), queries(qid, vector, tags_vector, kw).
    """
    dims = (dim, tags_dim)
    grp = F.coalesce(F.concat(F.lit("="), F.col("container_tag")), F.lit("")).alias("grp")  # null is a container
    good = [F.when(vec.usable(F.col(f), n), F.col(f)).alias(f) for f, n in zip(("vector", "tags_vector"), dims)]
    r = rows.filter("id is not null").select("id", grp, *good)
    large = {x["grp"]: x["n"] for x in r.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > CONTAINER_ROWS).collect()}  # at most rows / CONTAINER_ROWS
    parts = F.coalesce(F.create_map(*[F.lit(y) for g, n in large.items() for y in (g, -(-n // CONTAINER_ROWS))])[grp], F.lit(1)) if large else F.lit(1)
    part = F.pmod(F.xxhash64("id"), parts).cast("int").alias("part")
    r = rows.filter("id is not null").select("id", grp, *good, part)
    # new names: both sides may come from one table, of which a cogroup would mix up the columns
    own = own.select(F.col("id").alias("own_id"), F.col("container_tag").alias("own_tag"), grp.alias("own_grp"), "t", "r", part.alias("own_part"))
    q = queries.filter("qid is not null").select("qid", *good, "kw")
    blocks = max(1, -(-q.count() // BROADCAST_QUERIES))
    q = q.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    least, weight = p.similarity_threshold, p.tag_weight
    sc = rows.sparkSession.sparkContext

    def run(block: int, divided: bool) -> DataFrame:
        shared = sc.broadcast(_Asked(q.filter(F.col("block") == block).toPandas(), dims))

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            asked = shared.value
            names = ("qid", "id", "container_tag", "sim", "tags_sim", "boost", "r") if divided else ("qid", "id", "container_tag", "similarity")
            out = [pd.DataFrame({c: pd.Series(dtype=str if c in ("qid", "id", "container_tag") else float) for c in names})]
            if not len(a) or not len(b) or not len(asked.qids):
                return out[0]
            x = a.drop_duplicates("id")[["id", "vector", "tags_vector"]].merge(b[["own_id", "own_tag", "t", "r"]], left_on="id", right_on="own_id").sort_values("id", ignore_index=True)
            if not len(x):
                return out[0]
            ids, tag, factor = x["id"].to_numpy(), x["own_tag"].to_numpy(object), x["r"].to_numpy(float)
            for i, j, sim, tags_sim, boost in _near_pairs(asked, x, dims, wide):
                if divided:
                    got = (asked.qids[i], ids[j], tag[j], sim, tags_sim, boost, factor[j])
                else:
                    score = (np.nan_to_num(sim) + weight * np.maximum(np.nan_to_num(tags_sim), boost)) * factor[j]
                    ok = np.flatnonzero(score >= least)
                    ok = ok[np.lexsort((j[ok], -score[ok], i[ok]))]
                    at, first = np.arange(len(ok)), np.append(True, i[ok][1:] != i[ok][:-1])[: len(ok)]
                    ok = ok[at - np.maximum.accumulate(np.where(first, at, 0)) < k]
                    got = (asked.qids[i[ok]], ids[j[ok]], tag[j[ok]], score[ok])
                out.append(pd.DataFrame(dict(zip(names, got))))
            return pd.concat(out[1:], ignore_index=True)

        chosen = lambda c: (F.col(c).isin(*large) if divided else ~F.col(c).isin(*large)) if large else F.lit(True)
        one, two = r.filter(chosen("grp")), own.filter(chosen("own_grp"))
        return one.groupBy("grp", "part").cogroup(two.groupBy("own_grp", "own_part")).applyInPandas(meet, PARTIAL if divided else SCORED)

    def every(divided: bool) -> DataFrame:
        out = run(0, divided)
        for i in range(1, blocks):  # all blocks read the same shuffled rows
            out = out.unionByName(run(i, divided))
        return out

    hits = every(False)
    by = lambda c: F.row_number().over(Window.partitionBy("qid", "container_tag").orderBy(F.desc_nulls_last(c), "id")) <= wide
    if large:
        d = every(True).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("sim", "tags_sim")})
        d = d.withColumns({"in_sim": by("sim"), "in_tags": by("tags_sim")})
        z = F.lit(0.0)
        sim, tags_sim = (F.coalesce(F.when(F.col(i), F.col(c)), z) for i, c in (("in_sim", "sim"), ("in_tags", "tags_sim")))
        d = d.filter((F.col("in_sim") & F.col("sim").isNotNull()) | (F.col("in_tags") & F.col("tags_sim").isNotNull()))
        d = d.select("qid", "id", "container_tag", ((sim + F.lit(weight) * F.greatest(tags_sim, F.col("boost"))) * F.col("r")).alias("similarity"))
        hits = hits.unionByName(d.filter((F.col("similarity") >= least) & ~F.isnan("similarity")))
    w = Window.partitionBy("qid", "container_tag").orderBy(F.desc("similarity"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def scatter_gather(hits: DataFrame, shard: str, per_shard: int, total: int) -> DataFrame:
    """Best `per_shard` of each shard, then best `total` of all, by query."""
    w1 = Window.partitionBy("qid", shard).orderBy(F.desc("similarity"), "id")
    w2 = Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")
    best = hits.withColumn("r", F.row_number().over(w1)).filter(F.col("r") <= per_shard)
    return best.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= total).drop("r")


def with_graph(hits: DataFrame, undirected: DataFrame, clusters: DataFrame, ids: DataFrame) -> DataFrame:
    """Hits and their neighbours: (qid, id, similarity, source, linked_from, link_type, cluster_id, cluster_strength).

    A neighbour that is no hit comes once, from the best ranked hit that reaches it; its similarity is the
    link's strength. Link ends that are not among ids(id), the memories, do not come out. Each row carries its strongest stored cluster, of equals the later one.
    """
    direct = hits.select("qid", "id", "similarity", "rank")
    reach = direct.join(undirected.withColumnRenamed("node", "id"), "id").select(
        "qid", F.col("neighbor").alias("id2"), F.struct("rank", "link_id", F.col("id").alias("from"), "link_type", "strength").alias("via")
    )
    reach = reach.groupBy("qid", "id2").agg(F.min("via").alias("via")).withColumnRenamed("id2", "id")
    new = reach.join(direct.select("qid", "id"), ["qid", "id"], "left_anti").join(ids.select("id"), "id", "left_semi")
    rows = direct.select(
        "qid", "id", "similarity", F.lit("search").alias("source"), F.lit(None).cast("string").alias("linked_from"), F.lit(None).cast("string").alias("link_type")
    ).unionByName(
        new.select("qid", "id", F.col("via.strength").alias("similarity"), F.lit("link").alias("source"), F.col("via.from").alias("linked_from"), F.col("via.link_type").alias("link_type"))
    )
    best = best_cluster(clusters)
    return rows.join(best, "id", "left")


def best_cluster(clusters: DataFrame) -> DataFrame:
    """(id, cluster_id, cluster_strength) of clusters(cluster_id, member, avg_strength); null strengths are weakest."""
    return (
        clusters.groupBy(F.col("member").alias("id"))
        .agg(F.max(F.struct(F.coalesce("avg_strength", F.lit(-1.0)).alias("s"), "cluster_id", "avg_strength")).alias("m"))
        .select("id", F.col("m.cluster_id").alias("cluster_id"), F.col("m.avg_strength").alias("cluster_strength"))
    )


def coactivation(hits: DataFrame, links: DataFrame, delta: float = 0.05) -> DataFrame:
    """(a, b, link_id, strength): what pairs of hits of one query do to semantic links, as a delta.

    A pair that a semantic link joins in either direction strengthens the one of smallest id by delta (up to
    1), once for each query; a pair without one gets a new link of strength delta and a null link_id.
    """
    a = hits.select("qid", F.col("id").alias("a"))
    b = hits.select("qid", F.col("id").alias("b"))
    pairs = a.join(b, "qid").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    known = (
        links.filter(F.lower(F.trim("link_type")) == "semantic")
        .select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), F.struct("id", "strength").alias("l"))
        .groupBy("a", "b")
        .agg(F.min("l").alias("l"))
    )
    s = F.coalesce(F.nanvl("l.strength", F.lit(0.0)), F.lit(0.0))
    return pairs.join(known, ["a", "b"], "left").select(
        "a", "b", F.col("l.id").alias("link_id"), F.least(F.lit(1.0), s + F.col("n") * delta).alias("strength")
    )

"""The link graph: neighbours, degrees, upserts, traversal and connected groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from ..tables import clean


def undirected(links: DataFrame) -> DataFrame:
    """(node, neighbor, link_id, link_type, strength): every link from both ends; links to oneself are left out.

    An OR over both ends would become a nested loop; this view keeps every use an equi-join.
    """
    l = links.filter("source_id <> target_id")
    t = clean(F.col("link_type")).alias("link_type")
    one = l.select(F.col("source_id").alias("node"), F.col("target_id").alias("neighbor"), F.col("id").alias("link_id"), t, "strength")
    two = l.select(F.col("target_id").alias("node"), F.col("source_id").alias("neighbor"), F.col("id").alias("link_id"), t, "strength")
    return one.unionByName(two)


def neighbours(links: DataFrame, link_type: str | None = None, min_strength: float | None = None) -> DataFrame:
    """Each neighbour of each node once, by the link of smallest id that passes the filters (which come first)."""
    u = undirected(links)
    if link_type is not None:
        u = u.filter(F.col("link_type") == link_type)
    if min_strength is not None:
        u = u.filter((F.col("strength") >= min_strength) & ~F.isnan("strength"))
    return (
        u.groupBy("node", "neighbor")
        .agg(F.min(F.struct("link_id", "link_type", "strength")).alias("l"))
        .select("node", "neighbor", "l.link_id", "l.link_type", "l.strength")
    )


def degrees(links: DataFrame) -> DataFrame:
    """(node, n_links, n_neighbours): incident links (one to oneself counts once) and distinct other ends."""
    ends = links.select(F.col("source_id").alias("node"), F.col("target_id").alias("other")).unionByName(
        links.filter("source_id <> target_id").select(F.col("target_id").alias("node"), F.col("source_id").alias("other"))
    )
    # two steps: the first combines on the map side, so a node with a third of all links is no one task's work
    per = ends.filter("node is not null").groupBy("node", "other").agg(F.count("*").alias("n"))
    return per.groupBy("node").agg(F.sum("n").alias("n_links"), F.count_if(F.col("other") != F.col("node")).alias("n_neighbours"))


KEY = ("source_id", "target_id", "link_type")


def upsert_ignore(links: DataFrame, new: DataFrame, default_type: str = "related", default_strength: float = 0.5) -> DataFrame:
    """The rows of new that are inserted: those whose (source, target, type) is not there yet, each once."""
    n = new.select(
        "source_id", "target_id", F.coalesce("link_type", F.lit(default_type)).alias("link_type"), F.coalesce("strength", F.lit(default_strength)).alias("strength")
    )
    n = n.groupBy(*KEY).agg(F.min("strength").alias("strength"))
    return n.join(links.select(*KEY), list(KEY), "left_anti")


def strengthen(links: DataFrame, which: DataFrame, delta: float) -> DataFrame:
    """links with strength + delta, 1 at most, for the (source, target, type) keys in which."""
    keys = which.select(*KEY).distinct().withColumn("up", F.lit(True))
    up = F.when(F.col("strength").isNotNull(), F.least(F.lit(1.0), F.col("strength") + delta))
    return links.join(keys, list(KEY), "left").withColumn("strength", F.when(F.col("up"), up).otherwise(F.col("strength"))).drop("up")


def remove(links: DataFrame, pairs: DataFrame, typed: bool) -> DataFrame:
    """links without those of pairs: by (source, target, type), or by both ends in either direction, all types."""
    if typed:
        return links.join(pairs.select(*KEY).distinct(), list(KEY), "left_anti")
    both = pairs.select("source_id", "target_id").union(pairs.select("target_id", "source_id")).distinct()
    return links.join(both, ["source_id", "target_id"], "left_anti")


def drop_incident(links: DataFrame, ids: DataFrame) -> DataFrame:
    """links of which neither end is among ids(id)."""
    return links.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(
        ids.select(F.col("id").alias("target_id")), "target_id", "left_anti"
    )


def traverse(links: DataFrame, starts: DataFrame, max_depth: int, link_type: str | None = None) -> DataFrame:
    """(start, node, depth, path): breadth-first over undirected links from starts(start).

    path lists the ids from start to node; of shortest ones it is the smallest in string order.
    """
    u = undirected(links)
    if link_type is not None:
        u = u.filter(F.col("link_type") == link_type)
    u = materialise(u.select("node", "neighbor").distinct(), "bfs-edges")
    front = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.col("start").alias("path"))
    seen = front = materialise(front.distinct(), "bfs")
    for depth in range(1, max_depth + 1):
        step = (
            front.join(u, "node")
            .groupBy("start", F.col("neighbor").alias("node"))
            .agg(F.min(F.concat_ws(">", "path", "neighbor")).alias("path"))
            .withColumn("depth", F.lit(depth))
            .join(seen.select("start", "node"), ["start", "node"], "left_anti")
            .select("start", "node", "depth", "path")
        )
        front = materialise(step, "bfs")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.filter("depth > 0")


def components(edges: DataFrame) -> DataFrame:
    """(node, group) of edges(a, b): group is the smallest node that is reached.

    Large-star and small-star steps in turn: each is one grouping by node, whose minimum is combined on the
    map side, and the number of rounds is logarithmic in practice.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialise(e, "cc")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low2, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("p"))
            .select("p.a", "p.b")
            .filter("a <> b")
            .distinct()
        )
        e = materialise(small, "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("group")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("group")).distinct()
    )


def strong_edges(links: DataFrame, min_strength: float) -> DataFrame:
    """(a, b) of semantic links of enough strength, each pair once."""
    ok = (clean(F.col("link_type")) == "semantic") & (F.col("strength") >= min_strength) & ~F.isnan("strength")
    return links.filter(ok & (F.col("source_id") != F.col("target_id"))).select(
        F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), "strength"
    )


def link_clusters(links: DataFrame, min_strength: float = 0.5, min_size: int = 3) -> DataFrame:
    """(group, node) of the connected groups of at least min_size nodes; ends need not be memories."""
    c = materialise(components(strong_edges(links, min_strength).select("a", "b")), "clusters")
    big = c.groupBy("group").count().filter(F.col("count") >= min_size).select("group")
    return c.join(big, "group", "left_semi").select("group", "node")


def cluster_strengths(members: DataFrame, links: DataFrame, min_strength: float = 0.5) -> DataFrame:
    """(group, n_members, avg_strength): mean strength of the qualifying links inside each group.

    Sums are exact decimals, so the mean does not depend on the order of the rows.
    """
    e = strong_edges(links, min_strength)
    inside = e.join(members.select(F.col("node").alias("a"), "group"), "a").groupBy("group").agg(
        (F.sum(F.col("strength").cast("decimal(18,6)")).cast("double") / F.count("*")).alias("avg_strength")
    )
    return members.groupBy("group").agg(F.count("*").alias("n_members")).join(inside, "group", "left")


def stored_members(clusters: DataFrame) -> DataFrame:
    """(cluster_id, scope, member, avg_strength) of stored clusters; each row once, cut-off member lists give none."""
    ids = F.when(F.expr("try_parse_json(member_ids)").isNotNull(), F.from_json("member_ids", "array<string>"))
    return (
        clusters.select(F.col("id").alias("cluster_id"), "scope", "avg_strength", F.explode(ids).alias("member"))
        .filter("member is not null")
        .distinct()
    )


def new_clusters(members: DataFrame, stored: DataFrame) -> DataFrame:
    """(group, n_members) of the groups whose member set no stored cluster equals."""
    size = members.groupBy("group").agg(F.count("*").alias("n_members"))
    held = stored.select("cluster_id", "member").distinct()
    n_held = held.groupBy("cluster_id").agg(F.count("*").alias("n_held"))
    both = held.join(members.withColumnRenamed("node", "member"), "member").groupBy("cluster_id", "group").agg(F.count("*").alias("n_both"))
    same = both.join(n_held, "cluster_id").join(size, "group").filter("n_both = n_held and n_both = n_members").select("group")
    return size.join(same, "group", "left_anti")

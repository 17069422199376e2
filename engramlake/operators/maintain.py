"""Maintenance of the store: pruning, merging, expiry, rewiring, replay and synthesis inputs.

Each function returns rows to delete, to write or to keep; nothing is changed in place.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decay, text
from ..params import Params
from ..session import materialise
from ..tables import clean, lit_ts
from . import graph


def prunable(memories: DataFrame, links: DataFrame, as_of: dt.datetime, p: Params) -> DataFrame:
    """(id, degree, retrievability) of facts that are old enough, hardly linked and all but forgotten."""
    days = decay.days_between(lit_ts(as_of), F.coalesce("last_accessed_at", "created_at"))
    r = decay.retrievability(days, F.coalesce("stability", F.lit(p.initial_stability)), p)
    age = decay.days_between(lit_ts(as_of), F.col("created_at"))
    old = (
        memories.filter((clean(F.col("type")) == "fact") & (age >= p.prune_min_age_days))
        .select("id", r.alias("retrievability"))
        .filter((F.col("retrievability") < p.prune_retrievability_floor) & ~F.isnan("retrievability"))
    )
    d = graph.degrees(links).select(F.col("node").alias("id"), "n_links")
    return (
        old.join(d, "id", "left")
        .select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("degree"), "retrievability")
        .filter(F.col("degree") < p.prune_max_degree)
    )


def weak_links(links: DataFrame, as_of: dt.datetime, p: Params) -> DataFrame:
    """Links of small positive strength that are old enough to go."""
    age = decay.days_between(lit_ts(as_of), F.col("created_at"))
    s = F.col("strength")
    return links.filter((s > 0) & (s < p.link_strength_floor) & ~F.isnan(s) & (age * 24 >= p.link_min_age_hours))


def expired(memories: DataFrame, as_of: dt.datetime, p: Params) -> DataFrame:
    """(id) of ephemeral memories past their time to live."""
    age = decay.days_between(lit_ts(as_of), F.col("created_at"))
    return memories.filter((clean(F.col("tier")) == "hippocampus") & (age > p.ephemeral_ttl_days)).select("id")


def delete(memories: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, links) without the memories of ids(id) and their links; unknown ids do nothing."""
    gone = ids.select("id").distinct()
    return memories.join(gone, "id", "left_anti"), graph.drop_incident(links, gone)


def update(memories: DataFrame, changes: DataFrame, as_of: dt.datetime) -> DataFrame:
    """memories with content and vector of changes(id, content, vector), each id once, and updated_at set for those."""
    c = changes.select("id", F.col("content").alias("c_"), F.col("vector").alias("v_"), F.lit(True).alias("hit_")).dropDuplicates(["id"])
    hit = F.coalesce("hit_", F.lit(False))
    m = memories.join(c, "id", "left")
    new = {"content": F.col("c_"), "vector": F.col("v_"), "updated_at": lit_ts(as_of)}
    return m.select(*[F.when(hit, new[x]).otherwise(F.col(x)).alias(x) if x in new else F.col(x) for x in memories.columns])


def shingles(content: str, k: int = 5):
    """Sorted hashes of the distinct runs of k words; of all words for shorter texts."""
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1)))
    grams = lambda w: F.transform(starts(w), lambda i: F.xxhash64(F.array_join(F.slice(w, i, k), " ")))
    # bound to a variable, the words are not extracted again for every run
    return F.array_sort(F.array_distinct(F.transform(F.array(text.words(F.col(content))), grams)[0]))


def near_duplicates(memories: DataFrame, threshold: float = 0.8, k: int = 5, min_words: int = 5) -> DataFrame:
    """(container_tag, a, b), a < b: memories of one container whose k-word shingles are alike.

    Exact by prefix filtering: of two sets with Jaccard >= t, each in one order, rarest first, the first
    n - ceil(t n) + 1 elements share one. Texts with equal shingles are one class; each other member is paired with its
    smallest id only, so copies do not multiply.
    """
    copies, near = copies_and_near(memories, threshold, k, min_words)
    return near.unionByName(copies)


def copies_and_near(memories: DataFrame, threshold: float = 0.8, k: int = 5, min_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """The pairs of near_duplicates in two parts: smallest id of a class and each other member; smallest ids of alike classes."""
    d = (
        memories.filter(F.size(text.words(F.col("content"))) >= min_words)
        .select("id", F.coalesce("container_tag", F.lit("__global__")).alias("container_tag"), shingles("content", k).alias("s"))
        .withColumns({"c1": F.xxhash64("s"), "c2": F.hash("s")})
    )
    d = materialise(d, "shingles")  # contents are read once
    same = materialise(d.groupBy("container_tag", "c1", "c2").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "shingle-classes")
    star = (
        d.select("id", "container_tag", "c1", "c2")
        .join(same.filter("n > 1"), ["container_tag", "c1", "c2"])
        .filter("id <> rep")
        .select("container_tag", F.col("rep").alias("a"), F.col("id").alias("b"))
    )
    sets = d.join(same.select(F.col("rep").alias("id")), "id", "left_semi").select("container_tag", F.col("id").alias("rep"), "s")
    each = sets.select("container_tag", "rep", F.size("s").alias("n"), F.explode("s").alias("g"))
    held = each.groupBy("container_tag", "g").agg(F.count("*").alias("df")).filter("df > 1")
    # rarest first; shingles of one text only are the rarest and meet nothing
    shared = each.join(held, ["container_tag", "g"]).groupBy("container_tag", "rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("o"))
    take = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1 - (F.col("n") - F.size("o"))
    key = shared.withColumn("take", take.cast("int")).filter("take > 0").select(
        "container_tag", "rep", "n", F.explode(F.transform(F.slice("o", F.lit(1), F.col("take")), lambda x: x["g"])).alias("g")
    )
    key = materialise(key, "shingle-keys")
    x, y = key.alias("x"), key.alias("y")
    cand = (
        x.join(y, (F.col("x.container_tag") == F.col("y.container_tag")) & (F.col("x.g") == F.col("y.g")) & (F.col("x.rep") < F.col("y.rep"))
               & (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * F.lit(threshold) - 1e-9))
        .select(F.col("x.container_tag").alias("container_tag"), F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        .distinct()
    )
    common = F.size(F.array_intersect("sa", "sb"))
    near = (
        cand.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a")
        .join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
        .filter(common >= F.lit(threshold) * (F.size("sa") + F.size("sb") - common) - 1e-9)
        .select("container_tag", "a", "b")
    )
    return star, near


def merge_leaders(memories: DataFrame, pairs: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """(leader, member): in order of creation each memory that no earlier leader is near to leads those near it.

    The order-dependent choice is made in rounds over the pair graph: who has no undecided earlier
    neighbour leads; who is next to a leader is absorbed by the earliest one.

    copies(a, b): b is a copy of a, and pairs has the likeness of all copies as that of a only. The
    earliest copy takes part in the rounds for all, since it is the only one that can lead; the others
    go where it goes.
    """
    at = memories.select("id", F.struct(F.coalesce(F.unix_micros("created_at"), F.lit(2**62).cast("long")).alias("t"), F.col("id").alias("id")).alias("o"))
    pairs = pairs.select("a", "b")
    if copies is not None:
        c = copies.select(F.col("a").alias("rep"), F.col("b").alias("id")).union(copies.select("a", "a")).distinct()
        first = c.join(at, "id").groupBy("rep").agg(F.min("o").alias("o")).select("rep", F.col("o.id").alias("first"))
        first = materialise(first, "merge-first")
        for end in ("a", "b"):
            pairs = pairs.join(first.withColumnRenamed("rep", end), end, "left").withColumn(end, F.coalesce("first", end)).drop("first")
    e = pairs.select("a", "b").union(pairs.select("b", "a")).distinct()
    e = e.join(at.withColumnsRenamed({"id": "a", "o": "oa"}), "a").join(at.withColumnsRenamed({"id": "b", "o": "ob"}), "b")
    # b is earlier than a
    e = materialise(e.filter("ob < oa").select("a", "b", "oa", "ob"), "merge-edges")
    absorbed = None
    while not e.isEmpty():
        # b without an earlier neighbour leads; of the leaders next to a the earliest one absorbs it
        lead = e.select("b").distinct().join(e.select(F.col("a").alias("b")).distinct(), "b", "left_anti")
        took = e.join(lead, "b", "left_semi").groupBy("a").agg(F.min("ob").alias("o")).select(F.col("o.id").alias("leader"), F.col("a").alias("member"))
        took = materialise(took, "merge-took")
        absorbed = took if absorbed is None else absorbed.unionByName(took)
        gone = took.select("member")
        e = e.join(gone.withColumnRenamed("member", "a"), "a", "left_anti").join(gone.withColumnRenamed("member", "b"), "b", "left_anti")
        e = materialise(e, "merge-edges")
    if absorbed is None:
        absorbed = pairs.select(F.col("a").alias("leader"), F.col("b").alias("member")).limit(0)
    if copies is None:
        return absorbed
    rest = c.join(at.select("id"), "id").join(first, "rep").filter("id <> first").select("first", "id")
    to = absorbed.withColumnsRenamed({"leader": "to", "member": "first"})
    return absorbed.unionByName(rest.join(to, "first", "left").select(F.coalesce("to", "first").alias("leader"), F.col("id").alias("member")))


def merged(memories: DataFrame, leaders: DataFrame, p: Params) -> DataFrame:
    """(leader, n_members, stability, oldest): what the leaders become; their texts stay rows of (leader, member)."""
    s = memories.select(F.col("id").alias("member"), F.coalesce("stability", F.lit(p.initial_stability)).alias("s"), F.unix_micros("created_at").alias("t"))
    own = leaders.select("leader").distinct().select("leader", F.col("leader").alias("member"))
    return (
        leaders.select("leader", "member").unionByName(own).join(s, "member")
        .groupBy("leader").agg(F.count("*").alias("n_members"), F.max("s").alias("stability"), F.min("t").alias("oldest"))
    )


def merged_contents(memories: DataFrame, leaders: DataFrame, part: int = 1000) -> DataFrame:
    """(leader, part_no, n_members, content): the contents of a leader and its members, oldest first, joined by blank lines.

    The parts of one leader in order are its new content; a part holds at most `part` contents, so that copies
    which make up a third of all rows are not one string in one task. A null content counts as empty.
    """
    from ..sources.store import shard_rotation

    own = leaders.select("leader").distinct().select("leader", F.col("leader").alias("id"))
    m = leaders.select("leader", F.col("member").alias("id")).unionByName(own).join(memories.select("id", "created_at", "content"), "id")
    m = materialise(m, "merge-contents")
    parts = shard_rotation(m.withColumnRenamed("leader", "container_tag"), part).select("id", F.col("shard_index").alias("part_no"))
    at = F.coalesce(F.unix_micros("created_at"), F.lit(2**62).cast("long"))
    c = m.join(parts, "id").groupBy("leader", "part_no").agg(F.array_sort(F.collect_list(F.struct(at.alias("t"), "id", F.coalesce("content", F.lit("")).alias("content")))).alias("c"))
    return c.select("leader", "part_no", F.size("c").alias("n_members"), F.array_join(F.transform("c", lambda x: x["content"]), "\n\n").alias("content"))


def touched(memories: DataFrame, accessed: DataFrame, as_of: dt.datetime, p: Params) -> DataFrame:
    """memories with stability reinforced and last_accessed_at set for those of accessed(id); unknown ids do nothing."""
    hit = F.coalesce("hit_", F.lit(False))
    days = decay.days_between(lit_ts(as_of), F.coalesce("last_accessed_at", "created_at"))
    s = F.coalesce("stability", F.lit(p.initial_stability))
    new = {"stability": decay.reinforced(s, decay.retrievability(days, s, p), p), "last_accessed_at": lit_ts(as_of)}
    m = memories.join(accessed.select("id", F.lit(True).alias("hit_")).dropDuplicates(["id"]), "id", "left")
    return m.select(*[F.when(hit, new[x]).otherwise(F.col(x)).alias(x) if x in new else F.col(x) for x in memories.columns])


def consolidate(memories: DataFrame, links: DataFrame, clusters: DataFrame, as_of: dt.datetime, p: Params) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One run over all: (memories, links, new clusters, report) after pruning, merging, link pruning and clustering.

    memories(id, content, container_tag, type, tier, created_at, last_accessed_at, stability), one row per id;
    clusters(cluster_id, member) as stored. Leaders get the largest stability of their group; their joined
    texts are merged_contents(). report(pruned, merged, links_pruned, expired, clusters_found) is one row.
    """
    pruned = materialise(prunable(memories, links, as_of, p).select("id"), "run-pruned")
    left, l = delete(memories, links, pruned)
    left = materialise(left, "run-memories")
    copies, near = (materialise(x, "run-near") for x in copies_and_near(left))
    leaders = materialise(merge_leaders(left, near, copies), "run-leaders")
    gone = leaders.select(F.col("member").alias("id"))
    stab = merged(left, leaders, p).select(F.col("leader").alias("id"), F.col("stability").alias("s_"))
    kept = left.join(gone, "id", "left_anti").join(stab, "id", "left").withColumn("stability", F.coalesce("s_", "stability")).drop("s_")
    weak = materialise(weak_links(l, as_of, p).select("id"), "run-weak")
    l = l.join(weak, "id", "left_anti")
    dead = materialise(expired(kept, as_of, p), "run-expired")
    kept, l = delete(kept, l, dead)
    moved = materialise(redirect(l, leaders), "run-links")
    found = materialise(graph.new_clusters(graph.link_clusters(moved), clusters), "run-clusters")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    report = one(pruned, "pruned")
    for df, name in ((leaders, "merged"), (weak, "links_pruned"), (dead, "expired"), (found, "clusters_found")):
        report = report.crossJoin(one(df, name))  # one row each
    return kept.select(memories.columns), moved, found, report


def redirect(links: DataFrame, leaders: DataFrame) -> DataFrame:
    """(source_id, target_id, link_type, strength): links moved to the leaders; each once, none to oneself."""
    m = leaders.select("leader", "member")
    moved = links.select("source_id", "target_id", clean(F.col("link_type")).alias("link_type"), "strength")
    for end in ("source_id", "target_id"):
        moved = (
            moved.join(m.withColumnsRenamed({"member": end, "leader": "to"}), end, "left")
            .withColumn(end, F.coalesce("to", end)).drop("to")
        )
    return (
        moved.filter("source_id <> target_id").groupBy("source_id", "target_id", "link_type")
        .agg(F.max(F.when(~F.isnan("strength"), F.col("strength"))).alias("strength"))
    )


def rewire(links: DataFrame, gone: DataFrame, default_strength: float = 0.5) -> DataFrame:
    """(source_id, target_id, link_type, strength): links that keep the neighbours of deleted memories together.

    The neighbour by the smallest link of a deleted node is linked to each other neighbour that it is not
    linked to yet; neighbours that are deleted too are left out.
    """
    u = graph.neighbours(links)
    g = gone.select(F.col("id").alias("node")).distinct()
    around = u.join(g, "node", "left_semi").join(g.withColumnRenamed("node", "neighbor"), "neighbor", "left_anti")
    first = around.groupBy("node").agg(F.min(F.struct("link_id", "neighbor")).alias("f")).select("node", F.col("f.neighbor").alias("hub"))
    new = (
        around.join(first, "node").filter("neighbor <> hub")
        .select(F.col("hub").alias("source_id"), F.col("neighbor").alias("target_id"), "link_type").distinct()
    )
    have = u.select(F.col("node").alias("source_id"), F.col("neighbor").alias("target_id"))
    return new.join(have, ["source_id", "target_id"], "left_anti").withColumn("strength", F.lit(default_strength))


def replay_groups(memories: DataFrame, links: DataFrame, min_strength: float = 0.5, min_size: int = 2) -> DataFrame:
    """(group, node): connected groups of strong semantic links inside the ephemeral tier."""
    tier = memories.filter(clean(F.col("tier")) == "hippocampus").select("id")
    e = graph.strong_edges(links, min_strength)
    e = e.join(tier.withColumnRenamed("id", "a"), "a", "left_semi").join(tier.withColumnRenamed("id", "b"), "b", "left_semi")
    c = materialise(graph.components(e.select("a", "b")), "replay")
    big = c.groupBy("group").count().filter(F.col("count") >= min_size).select("group")
    return c.join(big, "group", "left_semi").select("group", "node")


def synthesis_inputs(memories: DataFrame, stored: DataFrame, limit: int) -> DataFrame:
    """(cluster_id, n_members, new_id, prompt) of the first `limit` stored clusters with two or more members that resolve.

    The prompt numbers the contents of all these members by id, and new_id is a hash of all of their ids.
    """
    from pyspark.sql.window import Window

    m = stored.select("cluster_id", "member").distinct().join(memories.select(F.col("id").alias("member"), "content"), "member")
    n = m.groupBy("cluster_id").agg(F.count("*").alias("n_members")).filter("n_members >= 2").orderBy("cluster_id").limit(limit)
    w = Window.partitionBy("cluster_id").orderBy("member")
    return (
        m.join(n, "cluster_id").withColumn("r", F.row_number().over(w))
        .groupBy("cluster_id", "n_members").agg(F.array_sort(F.collect_list(F.struct("r", "content", "member"))).alias("c"))
        .select(
            "cluster_id", "n_members",
            F.concat(F.lit("synth_"), F.sha2(F.array_join(F.transform("c", lambda x: x["member"]), ","), 256)).alias("new_id"),
            text.numbered(F.transform("c", lambda x: F.coalesce(x["content"], F.lit("")))).alias("prompt"),
        )
    )

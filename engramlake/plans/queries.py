"""The core's registered queries, each over its whole tables."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import decay, text, vec
from ..operators import graph, maintain, plugins, search
from ..params import Params
from ..session import materialise
from ..sources import store, sync
from ..streaming import workspace as ws
from ..tables import AS_OF, clean, lit_ts, memories, read

#: The stored vectors rarely reach the default threshold after decay.
P = Params(similarity_threshold=0.25, prune_retrievability_floor=0.15)
K = 10


def r6(c):
    return F.round(c, 6)


def micros(c: str):
    return F.unix_micros(c)


def stated_queries(spark: SparkSession, d: str) -> DataFrame:
    """The query set: sources of the links whose id is divisible by 50, as (qid, vector, tags_vector, content, container_tag)."""
    q = read(spark, d, "links").filter("id % 50 = 0").select(F.col("source_id").alias("id")).distinct()
    m = read(spark, d, "memories").select("id", "vector", "tags_vector", "content", "container_tag").join(q, "id", "left_semi")
    return materialise(m.dropDuplicates(["id"]).withColumnRenamed("id", "qid"), "queries")


def list_recent(spark, d):
    m = memories(spark, d, "id", "container_tag", "created_at")
    return m.orderBy(F.desc("created_at"), "id").limit(100).select("id", "container_tag", micros("created_at").alias("created_us"))


def list_by_container(spark, d):
    w = Window.partitionBy("container_tag").orderBy(F.desc("created_at"), "id")
    m = memories(spark, d, "id", "container_tag", "created_at").withColumn("rank", F.row_number().over(w))
    return m.filter("rank <= 20").select("container_tag", "id", "rank")


def list_page(spark, d):
    """The newest 100 with the six columns of a listing, and how many there are in all."""
    m = memories(spark, d, "id", "content", "tags", "tier", "stability", "created_at")
    page = m.orderBy(F.desc("created_at"), "id").limit(100)
    return page.crossJoin(F.broadcast(m.agg(F.count("*").alias("total")))).select(
        "id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"), F.coalesce("tags", F.lit("")).alias("tags"),
        F.coalesce("tier", F.lit("neocortex")).alias("tier"), F.coalesce("stability", F.lit(P.initial_stability)).alias("stability"),
        micros("created_at").alias("created_us"), "total",
    )


def memory_lookup(spark, d):
    """Stated ids in the store: content, container and the shard that holds each."""
    ids = read(spark, d, "links").filter("id % 50 = 0").select(F.col("target_id").alias("id"))
    found = store.located(memories(spark, d, "id", "content", "container_tag", "created_at"), ids, 100)
    return found.select("id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"), "container_tag", "scope", "scope_hash", "shard_index")


def metadata_typed(spark, d):
    """Key and value rows of the metadata as one typed row per memory."""
    m = memories(spark, d, "id", "metadata")
    return store.typed_rows(store.key_values(m, "metadata"), "id", {"sessionID": "string", "sourceFile": "string", "turn": "int"})


def vector_dimensions(spark, d):
    """Stored vectors that a write shard of 96 dimensions refuses, by container."""
    m = read(spark, d, "memories").select("id", "container_tag", "vector")
    return store.refused(m, 96).groupBy("container_tag", "dimensions").agg(F.countDistinct("id").alias("n"))


def stability_write_back(spark, d):
    ids = read(spark, d, "links").filter("id % 50 = 0").select(F.col("source_id").alias("id"))
    t = maintain.touched(memories(spark, d, "id", "stability", "created_at", "last_accessed_at"), ids, AS_OF, P)
    return t.select("id", r6("stability").alias("stability"), micros("last_accessed_at").alias("accessed_us"))


def memory_hydrated(spark, d):
    m = memories(spark, d, "id", "container_tag", "tags", "created_at", "is_pinned", "stability", "last_accessed_at", "tier")
    return m.select(
        "id",
        F.size(text.parse_tags(F.col("tags"))).alias("n_tags"),
        F.coalesce("is_pinned", F.lit(False)).alias("is_pinned"),
        F.coalesce("stability", F.lit(P.initial_stability)).alias("stability"),
        micros(F.coalesce("last_accessed_at", "created_at")).alias("accessed_us"),
        F.coalesce(clean(F.col("tier")), F.lit("neocortex")).alias("tier"),
    )


def memories_by_session(spark, d):
    ok = F.expr("try_parse_json(metadata)").isNotNull()
    m = memories(spark, d, "id", "metadata", "created_at").filter(ok)
    m = m.withColumn("session", text.metadata_value(F.col("metadata"), "sessionID")).filter("session is not null")
    return m.groupBy("session").agg(F.count("*").alias("n"), F.max_by("id", F.struct("created_at", "id")).alias("latest"))


def tags_normalised(spark, d):
    return memories(spark, d, "id", "tags").select("id", F.array_join(text.normal_tags(F.col("tags")), "|").alias("tags"))


def tag_counts(spark, d):
    t = memories(spark, d, "id", "tags").select("id", F.explode(text.normal_tags(F.col("tags"))).alias("tag"))
    return t.groupBy("tag").agg(F.count("*").alias("n_uses"), F.countDistinct("id").alias("n_memories"))


def trivial_memories(spark, d):
    return memories(spark, d, "id", "content").filter(text.is_trivial(F.col("content"))).select("id")


def container_counts(spark, d):
    m = memories(spark, d, "id", "container_tag", "tier")
    return m.groupBy(F.coalesce("container_tag", F.lit("__global__")).alias("container_tag")).agg(
        F.count("*").alias("n"), F.count_if(clean(F.col("tier")) == "hippocampus").alias("n_ephemeral")
    )


def keyword_hits(spark, d):
    kw = text.keywords(F.col("content"))
    return memories(spark, d, "id", "content").select("id", F.size(kw).alias("n_keywords"), F.array_join(kw, " ").alias("keywords"))


def sentence_counts(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).alias("n_sentences"))


def detected_languages(spark, d):
    t = read(spark, d, "documents").select(text.detect_language(F.col("text")).alias("code"))
    return t.groupBy("code").agg(F.count("*").alias("n")).withColumn("locale", text.locale(F.col("code")))


def knn_batch(spark, d):
    h = search.nearest(read(spark, d, "memories"), stated_queries(spark, d), "vector", 96, K)
    return h.select("qid", "id", r6("sim").alias("sim"), "rank")


def knn_tags(spark, d):
    h = search.nearest(read(spark, d, "memories"), stated_queries(spark, d), "tags_vector", 32, K)
    return h.select("qid", "id", r6("sim").alias("sim"), "rank")


def knn_approximate(spark, d):
    h = search.search(read(spark, d, "memories"), stated_queries(spark, d), "vector", 96, K, "approximate", P.dedup_similarity_threshold)
    return h.select("qid", "id", r6("sim").alias("sim"), "rank")


def _hits(spark, d, p: Params = P, container: str = "none", k: int = K) -> DataFrame:
    own = memories(spark, d, "id", "container_tag", "tags", "created_at", "last_accessed_at", "stability")
    return search.hybrid(read(spark, d, "memories"), own, stated_queries(spark, d), AS_OF, p, k, container)


def _out(h: DataFrame) -> DataFrame:
    return h.select("qid", "id", r6("similarity").alias("similarity"), "rank")


def hybrid_search(spark, d):
    return _out(_hits(spark, d))


def hybrid_search_no_decay(spark, d):
    return _out(_hits(spark, d, dataclasses.replace(P, decay_enabled=False, similarity_threshold=0.6)))


def hybrid_search_container_post(spark, d):
    return _out(_hits(spark, d, container="post"))


def hybrid_search_container_pre(spark, d):
    return _out(_hits(spark, d, container="pre"))


def sharded_topk(spark, d):
    """Each container is searched for its own 10 best; the best 20 of them all are kept."""
    h = search.scatter_gather(_hits(spark, d, dataclasses.replace(P, decay_enabled=False), "each"), "container_tag", 10, 20)
    return _out(h)


def graph_search(spark, d):
    g = search.with_graph(_hits(spark, d), graph.undirected(read(spark, d, "links")), graph.stored_members(read(spark, d, "clusters")), read(spark, d, "memories").select("id"))
    return g.select("qid", "id", r6(F.nanvl("similarity", F.lit(-1.0))).alias("similarity"), "source", "linked_from", "link_type", "cluster_id")


def hebbian_delta(spark, d):
    return search.coactivation(_hits(spark, d), read(spark, d, "links"), P.hebbian_delta).select("a", "b", "link_id", r6("strength").alias("strength"))


def neighbors(spark, d):
    return graph.neighbours(read(spark, d, "links")).select("node", "neighbor", "link_id")


def neighbors_strong_semantic(spark, d):
    return graph.neighbours(read(spark, d, "links"), "semantic", 0.5).select("node", "neighbor", "link_id", r6("strength").alias("strength"))


def degree_audit(spark, d):
    return graph.degrees(read(spark, d, "links"))


def _reversed(spark, d) -> DataFrame:
    l = read(spark, d, "links").filter("id % 50 = 0")
    return l.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "link_type", F.lit(None).cast("double").alias("strength"))


def link_upsert_ignore(spark, d):
    return graph.upsert_ignore(read(spark, d, "links"), _reversed(spark, d))


def link_strengthen(spark, d):
    l = read(spark, d, "links")
    return graph.strengthen(l, l.filter("id % 50 = 0"), 0.2).select("id", "source_id", "target_id", "link_type", r6(F.nanvl("strength", F.lit(-1.0))).alias("strength"))


def link_remove_typed(spark, d):
    l = read(spark, d, "links")
    return graph.remove(l, l.filter("id % 50 = 0"), True).select("id", "source_id", "target_id", "link_type")


def link_remove_both(spark, d):
    l = read(spark, d, "links")
    return graph.remove(l, l.filter("id % 50 = 0"), False).select("id", "source_id", "target_id", "link_type")


def bfs_paths(spark, d):
    l = read(spark, d, "links")
    starts = l.filter("id % 50 = 0").select(F.col("source_id").alias("start"))
    return graph.traverse(l, starts, 3, "semantic")


def link_clusters(spark, d):
    return graph.link_clusters(read(spark, d, "links"))


def cluster_strengths(spark, d):
    l = read(spark, d, "links")
    return graph.cluster_strengths(graph.link_clusters(l), l)


def new_clusters(spark, d):
    return graph.new_clusters(graph.link_clusters(read(spark, d, "links")), graph.stored_members(read(spark, d, "clusters")))


def clusters_for_memory(spark, d):
    s = graph.stored_members(read(spark, d, "clusters"))
    n = s.groupBy(F.col("member").alias("id")).agg(F.count_distinct("cluster_id").alias("n_clusters"))
    return search.best_cluster(s).join(n, "id").select("id", "n_clusters", "cluster_id")


def retrievability(spark, d):
    days = decay.days_between(lit_ts(AS_OF), F.coalesce("last_accessed_at", "created_at"))
    s = F.coalesce("stability", F.lit(P.initial_stability))
    m = memories(spark, d, "id", "created_at", "last_accessed_at", "stability")
    r = decay.retrievability(days, s)
    return m.select("id", r6(r).alias("r"), r6(decay.reinforced(s, r)).alias("after"))


def stability_fold(spark, d):
    e = read(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("t"))
    # one array a user: the length of one access history
    u = e.groupBy("user_id").agg(F.array_sort(F.collect_set("t")).alias("times"))
    s = decay.stability_fold(F.col("times"), F.element_at("times", 1), F.lit(P.initial_stability))
    return u.select("user_id", F.size("times").alias("n"), r6(s).alias("stability"))


def prune_memories(spark, d):
    m = memories(spark, d, "id", "type", "created_at", "last_accessed_at", "stability")
    return maintain.prunable(m, read(spark, d, "links"), AS_OF, P).withColumn("retrievability", r6("retrievability"))


def prune_links(spark, d):
    return maintain.weak_links(read(spark, d, "links"), AS_OF, P).select("id", "source_id", "target_id")


def ttl_expired(spark, d):
    return maintain.expired(memories(spark, d, "id", "tier", "created_at"), AS_OF, P)


def expire_cascade(spark, d):
    gone = maintain.expired(memories(spark, d, "id", "tier", "created_at"), AS_OF, P)
    return graph.drop_incident(read(spark, d, "links"), gone).select("id", "source_id", "target_id")


def _pairs(spark, d) -> DataFrame:
    return materialise(maintain.near_duplicates(memories(spark, d, "id", "content", "container_tag")), "near")


def near_dup_classes(spark, d):
    """One row per memory that is near to another: its class, and its number of partners in the pair graph."""
    p = _pairs(spark, d)
    both = p.select("a", "b").union(p.select("b", "a"))
    n = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    return graph.components(p.select("a", "b")).join(n, "node").select(F.col("node").alias("id"), F.col("group").alias("class_id"), "n_links")


def _leaders(spark, d) -> DataFrame:
    copies, near = (materialise(x, "near") for x in maintain.copies_and_near(memories(spark, d, "id", "content", "container_tag")))
    return materialise(maintain.merge_leaders(memories(spark, d, "id", "created_at"), near, copies), "leaders")


def merge_leaders(spark, d):
    return _leaders(spark, d)


def merge_rewrite(spark, d):
    return maintain.merged(memories(spark, d, "id", "stability", "created_at"), _leaders(spark, d), P)


def merge_redirect(spark, d):
    return maintain.redirect(read(spark, d, "links"), _leaders(spark, d)).withColumn("strength", r6("strength"))


def merge_contents(spark, d):
    c = maintain.merged_contents(memories(spark, d, "id", "content", "created_at"), _leaders(spark, d))
    return c.select("leader", "part_no", "n_members", F.sha2("content", 256).alias("content_hash"))


def consolidation_report(spark, d):
    m = memories(spark, d, "id", "content", "container_tag", "type", "tier", "created_at", "last_accessed_at", "stability")
    return maintain.consolidate(m, read(spark, d, "links"), graph.stored_members(read(spark, d, "clusters")), AS_OF, P)[3]


def trivial_rewire(spark, d):
    gone = memories(spark, d, "id", "content").filter(text.is_trivial(F.col("content"))).select("id")
    return maintain.rewire(read(spark, d, "links"), gone)


def replay_groups(spark, d):
    return maintain.replay_groups(memories(spark, d, "id", "tier"), read(spark, d, "links"))


def synthesis_inputs(spark, d):
    s = maintain.synthesis_inputs(memories(spark, d, "id", "content"), graph.stored_members(read(spark, d, "clusters")), P.max_synthesised)
    return s.select("cluster_id", "n_members", "new_id", F.sha2("prompt", 256).alias("prompt_hash"))


def synthesis_links(spark, d):
    stored = graph.stored_members(read(spark, d, "clusters"))
    i = materialise(maintain.synthesis_inputs(memories(spark, d, "id", "content"), stored, P.max_synthesised), "synth")
    return plugins.reflections(plugins.synthesise(i), stored, i)


def shard_rotation(spark, d):
    s = store.shard_rotation(memories(spark, d, "id", "container_tag", "created_at"), 100)
    return s.groupBy("container_tag", "shard_index").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def shard_catalog(spark, d):
    return store.counted(read(spark, d, "shards"), memories(spark, d, "id", "container_tag"))


def active_shards(spark, d):
    return store.active_shards(read(spark, d, "shards"))


def discovered_shards(spark, d):
    return store.discovered(read(spark, d, "shards")).distinct()


def delete_batch(spark, d):
    """What is left of the memories after the stated query set is deleted, with their remaining degree."""
    l = read(spark, d, "links")
    m, rest = maintain.delete(memories(spark, d, "id", "container_tag"), l, l.filter("id % 50 = 0").select(F.col("source_id").alias("id")))
    n = graph.degrees(rest).select(F.col("node").alias("id"), "n_links")
    return m.join(n, "id", "left").select("id", "container_tag", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def sync_paths(spark, d):
    m = memories(spark, d, "id", "project_path").filter("project_path is not null")
    return m.select("id", F.array_join(sync.path_tags(F.col("project_path")), ",").alias("tags"), sync.path_type(F.col("project_path")).alias("type"))


def sync_scope(spark, d):
    m = memories(spark, d, "id", "container_tag").withColumns(store.scope_of(F.col("container_tag")))
    return m.select("id", "scope", "scope_hash")


def front_matter(spark, d):
    f = sync.front_matter(memories(spark, d, "id", "content", "tags", "type", "metadata"))
    return f.select("path", F.sha2("text", 256).alias("text_hash"))


def _adjacent(spark, d) -> DataFrame:
    m = read(spark, d, "memories").filter(F.col("id").isNotNull() & vec.usable(F.col("vector"), 96)).select("id", "container_tag", "created_at", "vector")
    return vec.adjacent(m, F.date_trunc("week", "created_at"))


def adjacent_similarity(spark, d):
    return _adjacent(spark, d).groupBy("container_tag").agg(
        F.count("*").alias("n"), r6(F.avg("sim")).alias("mean"), r6(F.median("sim")).alias("median"), r6(F.min("sim")).alias("least"), r6(F.max("sim")).alias("most")
    )


def slice_means(spark, d):
    """Mean similarity of neighbours 1-4, 6-8 and 10-12 of each container, and the threshold that the lowest of them suggests."""
    s = _adjacent(spark, d).withColumn("at", F.row_number().over(Window.partitionBy("container_tag").orderBy("t", "id"))).filter("at <= 12")
    cut = F.when(F.col("at") <= 4, "first").when(F.col("at").between(6, 8), "second").when(F.col("at").between(10, 12), "third")
    m = s.withColumn("slice", cut).filter("slice is not null").groupBy("container_tag", "slice").agg(F.avg("sim").alias("mean"))
    low = m.groupBy("container_tag").agg(F.min("mean").alias("low")).withColumnRenamed("container_tag", "c")
    least = F.greatest(F.lit(0.1), F.floor((F.col("low") - 0.1) * 100 + 0.5) / 100)
    return m.join(low, F.col("container_tag").eqNullSafe(F.col("c"))).select("container_tag", "slice", r6("mean").alias("mean"), r6(least).alias("threshold"))


def similarity_histogram(spark, d):
    s = _adjacent(spark, d).filter("sim >= 0").groupBy(F.least(F.floor(F.col("sim") * 10), F.lit(9)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    return spark.range(10).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def _adds(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(F.col("user_id").alias("session"), F.get_json_object("props", "$.k").alias("memory"), F.col("ts").cast("timestamp").alias("added_at"))


def workspace_top5(spark, d):
    return ws.workspace(_adds(spark, d), P.workspace_capacity).select("session", "memory", micros("added_at").alias("added_us"), "rank")


def session_activity(spark, d):
    return ws.activity(_adds(spark, d))


def _incoming_queries(spark, d) -> DataFrame:
    i = read(spark, d, "incoming").filter("incoming_id is not null").dropDuplicates(["incoming_id"])
    return materialise(i.select(F.col("incoming_id").alias("qid"), "vector"), "incoming")


def dedup_on_add(spark, d):
    h = search.nearest(read(spark, d, "memories"), _incoming_queries(spark, d), "vector", 96, 1)
    return h.select("qid", "id", r6("sim").alias("sim"), (F.col("sim") >= P.dedup_similarity_threshold).alias("skip"))


def auto_link_on_add(spark, d):
    h = search.nearest(read(spark, d, "memories"), _incoming_queries(spark, d), "vector", 96, P.auto_link_max_connections)
    return h.filter(F.col("sim") >= P.auto_link_similarity_threshold).select("qid", "id", r6("sim").alias("strength"))


def auto_link_candidates(spark, d):
    """New semantic links of the stated queries by the scored search: of the best others those not linked yet, each pair once."""
    h = _hits(spark, d, k=P.auto_link_max_connections + 5)
    have = graph.undirected(read(spark, d, "links")).select(F.col("node").alias("qid"), F.col("neighbor").alias("id"))
    w = Window.partitionBy("qid").orderBy("rank")
    new = h.filter(F.col("id") != F.col("qid")).filter(F.col("similarity") >= P.auto_link_similarity_threshold - 0.001)
    new = new.join(have, ["qid", "id"], "left_anti").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= P.auto_link_max_connections)
    # of a pair that both ends propose the smaller one's link is made first, and the other finds it there
    back = new.select(F.col("qid").alias("id"), F.col("id").alias("qid"))
    return new.join(back.filter("qid > id"), ["qid", "id"], "left_anti").select("qid", "id", r6("similarity").alias("strength"))


NAMES = """list_recent list_page memory_lookup metadata_typed vector_dimensions stability_write_back list_by_container memory_hydrated memories_by_session tags_normalised tag_counts trivial_memories
container_counts keyword_hits sentence_counts detected_languages knn_batch knn_tags knn_approximate hybrid_search hybrid_search_no_decay
hybrid_search_container_post hybrid_search_container_pre sharded_topk graph_search hebbian_delta neighbors
neighbors_strong_semantic degree_audit link_upsert_ignore link_strengthen link_remove_typed link_remove_both bfs_paths
link_clusters cluster_strengths new_clusters clusters_for_memory retrievability stability_fold prune_memories prune_links
ttl_expired expire_cascade near_dup_classes merge_leaders merge_rewrite merge_contents merge_redirect consolidation_report trivial_rewire replay_groups
synthesis_inputs synthesis_links shard_rotation shard_catalog active_shards discovered_shards delete_batch sync_paths sync_scope front_matter adjacent_similarity
similarity_histogram slice_means workspace_top5 session_activity dedup_on_add auto_link_on_add auto_link_candidates""".split()

QUERIES = {n: globals()[n] for n in NAMES}

"""The core's operators on tiny tables, its properties, and its queries against their SQL."""

import datetime as dt
import itertools
import math
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramlake import params
from engramlake.functions import decay, text, vec
from engramlake.operators import graph, maintain, plugins, search
from engramlake.sources import store, sync
from engramlake.streaming import workspace as ws

UTC = dt.timezone.utc
AS_OF = dt.datetime(2026, 3, 1, tzinfo=UTC)
LINK = "id long, source_id string, target_id string, link_type string, strength double, created_at timestamp"


def links(spark, rows):
    return spark.createDataFrame([(*r, AS_OF - dt.timedelta(days=9)) for r in rows], LINK)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


# ---- parameters


def test_comments_are_stripped_but_not_urls():
    p = params.load('{"a": "http://x/y", /* c */ "similarity_threshold": 0.7, // t\n "hebbian": {"delta": 0.1,},}')
    assert p.similarity_threshold == 0.7 and p.hebbian_delta == 0.1
    q = params.load('{"merge": {"similarity": 0.9}, "workspace": {"capacity": 7}}', '{"merge": {"similarity": 0.8}}')
    assert (q.merge_similarity, q.workspace_capacity) == (0.8, 7)


# ---- decay


def test_retrievability(spark):
    r = lambda d, s: decay.retrievability(F.lit(float(d)), F.lit(float(s)))
    got = one(spark, r(0, 1), r(1, 1), r(1000, 1), r(5, 0), r(-100, 1))
    assert got[0] == 1.0 and abs(got[1] - 0.9) < 1e-12 and got[2] < 0.1 and got[3] == 1.0 and math.isnan(got[4])
    assert one(spark, decay.reinforced(F.lit(1.0), F.lit(0.1)) > decay.reinforced(F.lit(1.0), F.lit(0.9)))[0]


def test_retrievability_falls_with_time(spark):
    got = [x[0] for x in spark.range(200).orderBy("id").select(decay.retrievability(F.col("id").cast("double"), F.lit(3.0))).collect()]
    assert all(a >= b for a, b in zip(got, got[1:]))


# ---- text


def test_words_and_keywords(spark):
    k = one(spark, text.words(F.lit("Hello World, Test")), text.words(F.lit("")), text.keywords(F.lit("a the and testing testing purposes x")))
    assert (list(k[0]), list(k[1]), list(k[2])) == (["hello", "world", "test"], [], ["testing", "testing", "purposes"])


def test_sentences(spark):
    s = one(spark, text.sentences(F.lit("One is here. Two is here! Three?")), text.sentences(F.lit("")), text.sentences(F.lit("Dr. Smith met the officials.")))
    assert len(s[0]) == 3 and list(s[1]) == [] and len(s[2]) >= 2 and "officials" in s[2][-1]


def test_languages(spark):
    d = text.detect_language
    got = one(
        spark, d(F.lit("hi")), d(F.lit("hi"), configured="fra"), d(F.lit("12345 67890 !!! ??? 123123123")), d(F.lit("the cat is on the table and it was not me")),
        d(F.lit("le chat est dans la maison avec les enfants")), text.locale(F.lit("eng")), text.locale(F.lit("xxx")), d(F.lit(None).cast("string")),
    )
    assert tuple(got) == ("eng", "fra", "eng", "eng", "fra", "en", "en", "eng")


def test_tags_and_triviality(spark):
    t = one(spark, text.parse_tags(F.lit("a,, b ")), text.parse_tags(F.lit(None).cast("string")), text.normal_tags(F.lit(" A,, b")))
    assert (list(t[0]), list(t[1]), list(t[2])) == (["a", "", "b"], [], ["a", "b"])
    got = one(spark, *[text.is_trivial(F.lit(x)) for x in ("  ok ", "is this a long question at all? ", "this is long enough to keep", None)])
    assert tuple(got) == (True, True, False, True)


def test_metadata_that_is_cut_off_is_null(spark):
    got = one(spark, *[text.metadata_value(F.lit(m), "sessionID") for m in ('{"sessionID": "s1"}', '{"sessionID":"s1"', '{"sessionID": "s', None)])
    assert tuple(got) == ("s1", None, None, None)


# ---- vectors


def test_cosine(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x]).cast("array<float>")
    got = one(spark, vec.cosine(a(1, 0), a(1, 0)), vec.cosine(a(1, 0), a(0, 0)), vec.cosine(a(1, 0), a(1, 0, 0)), vec.cosine(a(3, 4), a(4, 3)))
    assert got[0] == 1.0 and got[1] == 0.0 and got[2] == 0.0 and abs(got[3] - 0.96) < 1e-12


@pytest.mark.parametrize("limit", [10_000, 3])
def test_nearest_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(search, "BROADCAST_QUERIES", limit)
    x = np.random.default_rng(0).standard_normal((60, 8)).astype(np.float32)
    x[7] = x[3]
    ids = [f"m{i:02d}" for i in range(60)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)] + [("bad", None), ("nan", [float("nan")] * 8)], "id string, v array<float>")
    q = rows.filter("id < 'm10'").withColumnRenamed("id", "qid")
    got = search.nearest(rows, q, "v", 8, 4).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for i in range(10):
        best = sorted((-round(float(u[i] @ u[j]), 12), ids[j]) for j in range(60))[:4]
        assert [r["id"] for r in sorted((r for r in got if r["qid"] == ids[i]), key=lambda r: r["rank"])] == [b for _, b in best]
    assert search.nearest(rows, q.limit(0), "v", 8, 4).count() == 0 and search.nearest(rows.limit(0), q, "v", 8, 4).count() == 0


@pytest.mark.parametrize("limit", [10_000, 3])
def test_nearest_by_and_within_containers(spark, monkeypatch, limit):
    monkeypatch.setattr(search, "BROADCAST_QUERIES", limit)
    monkeypatch.setattr(search, "GATHER", 10)
    x = np.random.default_rng(1).standard_normal((80, 8)).astype(np.float32)
    ids, c = [f"m{i:02d}" for i in range(80)], [("hot", "hot", "b", "c", None)[i % 5] for i in range(80)]
    data = [(i, v.tolist(), g) for i, v, g in zip(ids, x, c)]
    rows = spark.createDataFrame(data + data[:30], "id string, v array<float>, g string").repartition(3)  # repeated ids count once
    q = rows.filter("id < 'm07'").dropDuplicates(["id"]).withColumnRenamed("id", "qid")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    best = lambda i, ok: [ids[j] for _, j in sorted((-round(float(u[i] @ u[j]), 12), j) for j in range(80) if ok(j))[:4]]
    by, within = search.nearest(rows, q, "v", 8, 4, by="g").collect(), search.nearest(rows, q, "v", 8, 4, within="g").collect()
    for i in range(7):
        for g in ("hot", "b", "c", None):
            assert [r["id"] for r in sorted((r for r in by if r["qid"] == ids[i] and r["grp"] == (g or "")), key=lambda r: r["rank"])] == best(i, lambda j: c[j] == g)
        got = [r["id"] for r in sorted((r for r in within if r["qid"] == ids[i]), key=lambda r: r["rank"])]
        assert got == ([] if c[i] is None else best(i, lambda j: c[j] == c[i]))


def test_approximate_search_finds_close_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((50, 16))
    rows = [(f"m{i:02d}_{j}", (v + 0.1 * rng.standard_normal(16)).astype(np.float32).tolist()) for i, v in enumerate(base) for j in range(4)]
    df = spark.createDataFrame(rows + [("bad", None), ("nan", [float("nan")] * 16), rows[0]], "id string, v array<float>")
    q = df.filter("id like '%_0'").dropDuplicates(["id"]).withColumnRenamed("id", "qid")
    truth = {(r["qid"], r["id"]) for r in search.search(df, q, "v", 16, 5).filter("sim >= 0.9").collect()}
    got = search.search(df, q, "v", 16, 5, "approximate", 0.9).collect()
    found = {(r["qid"], r["id"]) for r in got}
    assert found <= truth and len(found) >= 0.9 * len(truth) and len(truth) > 150 and all(r["sim"] >= 0.9 for r in got)
    assert search.search(df.limit(0), q.limit(0), "v", 16, 5, "approximate").count() == 0 and search.search(df, q.limit(0), "v", 16, 5, "approximate").count() == 0
    with pytest.raises(ValueError):
        search.search(df, q, "v", 16, 5, "other")


def test_scatter_gather_searches_every_shard(spark):
    v = lambda x: [float(np.cos(x)), float(np.sin(x))]
    rows = [(f"h{i:02d}", v(0.001 * i), v(0), "hot") for i in range(200)] + [(f"o{i:02d}", v(0.5 + 0.001 * i), v(0), f"other{i % 3}") for i in range(30)]
    m = spark.createDataFrame(rows, "id string, vector array<float>, tags_vector array<float>, container_tag string")
    own = m.select("id", "container_tag", F.lit("").alias("tags"), F.lit(AS_OF).alias("created_at"), F.lit(AS_OF).alias("last_accessed_at"), F.lit(1.0).alias("stability"))
    q = m.filter("id = 'h00'").select(F.col("id").alias("qid"), "vector", F.lit(None).cast("array<float>").alias("tags_vector"), F.lit("").alias("content"), "container_tag")
    p = params.Params(similarity_threshold=0.0, decay_enabled=False)
    got = search.scatter_gather(search.hybrid(m, own, q, AS_OF, p, 10, "each", 2, 2), "container_tag", 10, 20).collect()
    assert sum(r["container_tag"] == "hot" for r in got) == 10 and len(got) == 20  # a hot shard takes no more than its share


def test_adjacent_rows_across_time_buckets(spark):
    rng = np.random.default_rng(3)
    rows = [(f"m{i:03d}", ("a", "b", None)[i % 3], AS_OF - dt.timedelta(days=int(d)) if d < 395 else None, rng.standard_normal(4).astype(np.float32).tolist()) for i, d in enumerate(rng.integers(0, 400, 90))]
    df = spark.createDataFrame(rows + rows[:5], "id string, container_tag string, created_at timestamp, vector array<float>")
    want = {}
    for c in ("a", "b", None):
        own = sorted((r for r in rows if r[1] == c), key=lambda r: (r[2] is None, r[2] or AS_OF, r[0]))
        for x, y in zip(own, own[1:]):
            a, b = np.array(x[3], float), np.array(y[3], float)
            want[y[0]] = a @ b / np.sqrt(a @ a * (b @ b))
    for bucket in ("week", "year"):
        got = {r["id"]: r["sim"] for r in vec.adjacent(df, F.date_trunc(bucket, "created_at")).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    assert vec.adjacent(df.limit(0), F.date_trunc("week", "created_at")).count() == 0


def test_link_ends_that_are_no_memories_do_not_come_out(spark):
    hits = spark.createDataFrame([("q", "a", 0.9, 1)], "qid string, id string, similarity double, rank int")
    l = links(spark, [(1, "a", "gone", "semantic", 0.5), (2, "b", "a", "semantic", 0.4)])
    none = spark.createDataFrame([], "cluster_id long, member string, avg_strength double")
    got = search.with_graph(hits, graph.undirected(l), none, spark.createDataFrame([("a",), ("b",), ("b",)], "id string")).collect()
    assert {(r["id"], r["source"]) for r in got} == {("a", "search"), ("b", "link")} and len(got) == 2


# ---- graph


def test_links(spark):
    l = links(spark, [(1, "a", "b", "references", 0.3), (2, "a", "b", "semantic", 0.8), (3, "c", "c", "related", 0.5), (4, "b", "a", "semantic", None)])
    strong = {(r["node"], r["neighbor"], r["link_id"]) for r in graph.neighbours(l, min_strength=0.5).collect()}
    assert strong == {("a", "b", 2), ("b", "a", 2)}
    assert {(r["node"], r["neighbor"], r["link_id"]) for r in graph.neighbours(l).collect()} == {("a", "b", 1), ("b", "a", 1)}
    deg = {r["node"]: (r["n_links"], r["n_neighbours"]) for r in graph.degrees(l).collect()}
    assert deg == {"a": (3, 1), "b": (3, 1), "c": (1, 0)}
    up = graph.strengthen(l, l.filter("id = 2"), 0.5).filter("id = 2").first()
    assert up["strength"] == 1.0
    pair = l.filter("id = 1")
    assert graph.remove(l, pair, True).count() == 3 and graph.remove(l, pair, False).count() == 1
    assert graph.upsert_ignore(l, l).count() == 0 and graph.upsert_ignore(l.limit(0), l.union(l)).count() == 4
    assert graph.drop_incident(l, spark.createDataFrame([("c",)], "id string")).count() == 3


def test_traverse(spark):
    l = links(spark, [(1, "a", "b", "x", 1.0), (2, "b", "c", "x", 1.0), (3, "c", "a", "x", 1.0), (4, "c", "d", "x", 1.0), (5, "d", "e", "x", 1.0)])
    got = {(r["node"], r["depth"], r["path"]) for r in graph.traverse(l, spark.createDataFrame([("a",)], "start string"), 2).collect()}
    assert got == {("b", 1, "a>b"), ("c", 1, "a>c"), ("d", 2, "a>c>d")}


def test_clusters(spark):
    rows = [(1, "m1", "m2", "semantic", 0.8), (2, "m2", "m3", "semantic", 0.7), (3, "m4", "m5", " Semantic", 0.6), (4, "m5", "m6", "semantic", 0.9),
            (5, "m3", "m4", "semantic", 0.3), (6, "m6", "m1", "related", 0.9), (7, "p", "q", "semantic", 0.8), (8, "m1", "m6", "semantic", float("nan"))]
    l = links(spark, rows)
    got = {}
    for r in graph.link_clusters(l).collect():
        got.setdefault(r["group"], set()).add(r["node"])
    assert got == {"m1": {"m1", "m2", "m3"}, "m4": {"m4", "m5", "m6"}}
    s = {r["group"]: (r["n_members"], r["avg_strength"]) for r in graph.cluster_strengths(graph.link_clusters(l), l).collect()}
    assert s == {"m1": (3, 0.75), "m4": (3, 0.75)}
    stored = spark.createDataFrame([(1, "project", '["m3","m1","m2"]', 0.7), (1, "project", '["m3","m1","m2"]', 0.7), (2, "p", '["m4","m5', None)],
                                   "id long, scope string, member_ids string, avg_strength double")
    held = graph.stored_members(stored)
    assert held.count() == 3
    assert [r["group"] for r in graph.new_clusters(graph.link_clusters(l), held).collect()] == ["m4"]


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(5)
    e = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 120, (90, 2))] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)]
    parent = {x: x for p in e for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    truth = {x: find(x) for p in e if p[0] != p[1] for x in p}
    got = {r["node"]: r["group"] for r in graph.components(spark.createDataFrame(e, "a string, b string")).collect()}
    assert got == truth
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


# ---- maintenance


def memory_rows(spark, rows):
    return spark.createDataFrame(rows, "id string, content string, container_tag string, created_at timestamp, stability double, type string, tier string, last_accessed_at timestamp, metadata string, tags string")


def mem(i, content, c="x", age=10, s=1.0, kind="fact", tier=None, meta=None, tags=None):
    return (i, content, c, AS_OF - dt.timedelta(days=age), s, kind, tier, None, meta, tags)


def test_near_duplicates_equal_brute_force_and_leaders(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        w = [f"w{x}" for x in rng.integers(0, 4000, 40)]
        rows.append((f"m{i:02d}", w))
        if i % 4 == 0:
            rows.append((f"n{i:02d}", w[:38] + ["new"]))
        if i % 8 == 0:
            rows.append((f"o{i:02d}", w))
    m = memory_rows(spark, [mem(i, " ".join(w), age=k + 8) for k, (i, w) in enumerate(rows)] + [mem("e1", None), mem("e2", ""), mem("e3", "ok")])
    sh = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in rows}
    alike = {(a, b) for a, b in itertools.combinations(sorted(sh), 2) if len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b])}
    pairs = maintain.near_duplicates(m)
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    first = {frozenset(s): min(i for i in sh if sh[i] == s) for s in sh.values()}
    assert got <= alike and {(a, b) for a, b in alike if sh[a] != sh[b] and first[frozenset(sh[a])] == a and first[frozenset(sh[b])] == b} <= got
    order = sorted((i for i, _ in rows), key=lambda i: [k for k, r in enumerate(rows) if r[0] == i][0], reverse=True)
    adj = {x: {b for p in got for b in p if x in p and b != x} for x in sh}
    leader, taken = {}, {}
    for x in order:  # oldest first
        near = [y for y in order if y in leader and y in adj[x]]
        if near:
            taken[x] = near[0]
        else:
            leader[x] = True
    want = {(v, k) for k, v in taken.items()}
    assert {(r["leader"], r["member"]) for r in maintain.merge_leaders(m, pairs).collect()} == want and want


def test_leaders_of_copies_equal_a_sequential_pass(spark, monkeypatch):
    from engramlake.plans import queries

    rng = np.random.default_rng(4)
    rows = []
    for i in range(12):
        w = [f"t{i}w{x}" for x in range(40)]
        texts = [w, w[:38] + ["new"], [*w[:36], "other"]]
        rows += [(f"m{i:02d}{j}", texts[rng.integers(0, 3)]) for j in range(rng.integers(1, 9))]
    rows += [("a", ["same"] * 9), ("b", ["same"] * 9), ("c", ["same"] * 9)]
    age = {i: int(a) for (i, _), a in zip(rows, rng.integers(5, 30, len(rows)))} | {"a": 7, "b": 9, "c": 8}
    m = memory_rows(spark, [mem(i, " ".join(w), age=age[i]) for i, w in rows])
    sh = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in rows}
    want, leading = set(), []
    for x in sorted(sh, key=lambda i: (-age[i], i)):  # oldest first, over all pairs
        near = [y for y in leading if len(sh[x] & sh[y]) >= 0.8 * len(sh[x] | sh[y])]
        if near:
            want.add((near[0], x))
        else:
            leading.append(x)
    monkeypatch.setattr(queries, "memories", lambda spark, d, *cols: m.select(*cols))
    got = [(r["leader"], r["member"]) for r in queries.merge_leaders(spark, "").collect()]
    assert len(got) == len(set(got)) and set(got) == want and {("b", "a"), ("b", "c")} <= want


def test_synthesis_takes_all_members(spark):
    ids = [f"s{i:02d}" for i in range(60)]
    m = memory_rows(spark, [mem(i, f"text of {i}") for i in ids])
    stored = spark.createDataFrame([(c, i) for c, n in ((1, 60), (2, 55), (3, 1)) for i in ids[:n]], "cluster_id long, member string")
    got = {r["cluster_id"]: r for r in maintain.synthesis_inputs(m, stored, 10).collect()}
    assert {c: r["n_members"] for c, r in got.items()} == {1: 60, 2: 55} and got[1]["new_id"] != got[2]["new_id"]
    assert got[1]["prompt"] == "\n\n".join(f"[{k + 1}] text of {i}" for k, i in enumerate(ids))


def test_prune_expire_and_rewire(spark):
    p = params.Params(prune_retrievability_floor=0.5)
    m = memory_rows(spark, [mem("a", "x" * 20, age=900), mem("b", "x" * 20, age=900), mem("c", "ok", age=900, tier=" Hippocampus"), mem("d", "x" * 20, age=3), mem("e", "x" * 20, age=900, kind="log")])
    l = links(spark, [(1, "b", "d", "related", 0.05), (2, "b", "e", "related", 0.5), (3, "c", "a", "semantic", 0.5), (4, "c", "e", "semantic", float("nan"))])
    assert {r["id"] for r in maintain.prunable(m, l, AS_OF, p).collect()} == {"a"}
    assert [r["id"] for r in maintain.weak_links(l, AS_OF, p).collect()] == [1]
    assert [r["id"] for r in maintain.expired(m, AS_OF, p).collect()] == ["c"]
    gone = m.filter(text.is_trivial(F.col("content"))).select("id")
    assert [(r["source_id"], r["target_id"]) for r in maintain.rewire(l, gone).collect()] == [("a", "e")]
    moved = maintain.redirect(l, spark.createDataFrame([("b", "d")], "leader string, member string")).collect()
    assert {(r["source_id"], r["target_id"]) for r in moved} == {("b", "e"), ("c", "a"), ("c", "e")}


def test_contents_are_joined_in_parts(spark):
    m = memory_rows(spark, [mem(f"m{i:02d}", f"t{i}" if i else None, age=50 - i) for i in range(9)])
    lead = spark.createDataFrame([("m00", f"m{i:02d}") for i in range(1, 7)] + [("m07", "m08")], "leader string, member string")
    got = {(r["leader"], r["part_no"]): (r["n_members"], r["content"]) for r in maintain.merged_contents(m, lead, 5).collect()}
    assert got == {("m00", 0): (5, "\n\nt1\n\nt2\n\nt3\n\nt4"), ("m00", 1): (2, "t5\n\nt6"), ("m07", 0): (2, "t7\n\nt8")}
    assert maintain.merged_contents(m, lead.limit(0)).count() == 0


def test_consolidation_run(spark):
    long = " ".join(f"w{i}" for i in range(20))
    m = memory_rows(spark, [mem("a", long, age=9, s=1e6), mem("b", long, age=8, s=2e6), mem("c", "forgotten", age=900), mem("d", "ephemeral", age=30, s=1e6, tier="hippocampus"),
                            mem("e", "x", s=1e6), mem("f", "y", s=1e6), mem("g", "z", s=1e6)])
    l = links(spark, [(1, "b", "e", "semantic", 0.9), (2, "e", "f", "semantic", 0.8), (3, "f", "g", "semantic", 0.05), (4, "d", "g", "related", 0.9)])
    held = spark.createDataFrame([], "cluster_id long, member string")
    kept, moved, found, report = maintain.consolidate(m.drop("metadata", "tags"), l, held, AS_OF, params.Params(prune_retrievability_floor=0.5))
    assert tuple(report.first()) == (1, 1, 1, 1, 1)
    assert {r["id"]: r["stability"] for r in kept.collect()} == {"a": 2e6, "e": 1e6, "f": 1e6, "g": 1e6}
    assert {(r["source_id"], r["target_id"]) for r in moved.collect()} == {("a", "e"), ("e", "f")} and found.count() == 1


def test_touched_memories(spark):
    m = memory_rows(spark, [mem("a", "x", age=4), mem("b", "y", age=4)])
    got = {r["id"]: r for r in maintain.touched(m, spark.createDataFrame([("a",), ("a",), ("zz",)], "id string"), AS_OF, params.Params()).collect()}
    assert got["a"]["stability"] > 1.0 and got["a"]["last_accessed_at"] is not None and got["b"]["stability"] == 1.0 and got["b"]["last_accessed_at"] is None


# ---- sources


def test_typed_metadata_and_guards(spark):
    m = spark.createDataFrame([("a", '{"embedding_model": "m", "embedding_dimensions": "96", "x": 1}'), ("b", '{"embedding_dimensions": "many"}'), ("c", '{"x": '), ("d", None)], "id string, j string")
    got = {r["id"]: (r["embedding_model"], r["embedding_dimensions"]) for r in store.typed_rows(store.key_values(m, "j"), "id", {"embedding_model": "string", "embedding_dimensions": "int"}).collect()}
    assert got == {"a": ("m", 96), "b": (None, None)}
    store.check_shard({"embedding_model": "m", "embedding_dimensions": 96}, "m", 96)
    store.check_shard({}, "m", 96)
    for bad in ({"embedding_model": "n"}, {"embedding_dimensions": 3}):
        with pytest.raises(ValueError):
            store.check_shard(bad, "m", 96)
    v = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0]), ("c", None)], "id string, vector array<float>")
    assert [(r["id"], r["dimensions"]) for r in store.refused(v, 2).collect()] == [("a", 1)]


def test_rotation_and_scope(spark):
    m = memory_rows(spark, [mem(f"m{i:03d}", "x", c="note_project_ab_cd" if i % 3 else "plain", age=i % 11) for i in range(100)])
    got = store.shard_rotation(m, 10).groupBy("container_tag", "shard_index").count().collect()
    assert max(r["count"] for r in got) == 10 and sum(r["count"] for r in got) == 100 and sum(r["count"] < 10 for r in got) <= 2
    # one moment for most rows, containers null and hot: as one sorted list a container, however the ranges are cut
    rows = [mem(f"m{i:03d}", "x", c=None if i % 10 == 0 else "plain" if i % 9 == 0 else "hot", age=5 if i % 4 else i % 7) for i in range(300)]
    burst = memory_rows(spark, rows)
    want, seen = {}, {}
    for r in sorted(burst.select("id", "container_tag", "created_at").collect(), key=lambda r: (r["created_at"], r["id"])):
        want[r["id"]] = seen.get(r["container_tag"], 0) // 10
        seen[r["container_tag"]] = seen.get(r["container_tag"], 0) + 1
    assert {r["id"]: r["shard_index"] for r in store.shard_rotation(burst, 10, part_rows=25).collect()} == want
    assert store.shard_rotation(burst.limit(0), 10).count() == 0
    s = {(r["scope"], r["scope_hash"]) for r in m.select(*[v.alias(k) for k, v in store.scope_of(F.col("container_tag")).items()]).collect()}
    assert s == {("project", "ab_cd"), ("user", "plain")}


def test_snapshot_round_trip(spark, tmp_path):
    m = memory_rows(spark, [mem(f"m{i}", "x", c=f"note_project_{i % 3}") for i in range(30)])
    store.write_snapshot(m.drop("tier"), str(tmp_path / "s"), 7)
    back = store.read_snapshot(spark, str(tmp_path / "s"))
    assert {r["id"] for r in back.collect()} == {f"m{i}" for i in range(30)} and back.filter("tier <> 'neocortex'").count() == 0
    assert "PartitionFilters: [isnotnull(scope" in back.filter("scope = 'project'")._jdf.queryExecution().toString()


def test_markdown_round_trip(spark, tmp_path):
    m = memory_rows(spark, [mem("a", "text one", tags="T1, t2"), mem("b", "text two"), mem("c", "kept", meta='{"sourceFile": "x.md"}')])
    sync.write_markdown(sync.front_matter(m), str(tmp_path))
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "z.md").write_text("no")
    files = sync.scan_markdown(spark, str(tmp_path))
    assert {r["path"] for r in files.collect()} == {"t1/t2/a.md", "uncategorized/b.md"}
    f = spark.createDataFrame([("x.md", "changed"), ("notes/y.md", "new")], "path string, content string")
    got = {r["path"]: (r["id"], r["type"], r["is_update"]) for r in sync.changed(f, m).collect()}
    assert got["x.md"] == ("c", "reference", True) and got["notes/y.md"][1:] == ("note", False)


def test_embedding_plug_in(spark):
    df = spark.createDataFrame([("a", "x y"), ("b", None)], "id string, content string")
    got = plugins.embed(df, lambda: plugins.hashed_embedder(16)).collect()
    assert len(got[0]["vector"]) == 16 and abs(np.linalg.norm(got[0]["vector"]) - 1) < 1e-6 and not any(got[1]["vector"])


# ---- streaming


def test_workspace_stream_equals_batch(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m, tzinfo=UTC)
    rows = [("s", f"m{(i * 7) % 9}", t(i), "add") for i in range(30)] + [("t", "m1", t(1), "add"), ("t", "m1", t(2), "remove"), ("u", "m2", t(3), "add"), ("u", "m3", t(4), "clear")]
    schema = "session string, memory string, added_at timestamp, op string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = (
        ws.workspace_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        .writeStream.outputMode("update").format("memory").queryName("wsout").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    got = {r["session"]: r["members"] for r in spark.table("wsout").collect()}
    batch = ws.workspace(spark.createDataFrame(rows, schema).filter("session = 's'")).orderBy("rank").collect()
    assert got["s"] == ",".join(r["memory"] for r in batch) and got["t"] == "" and got["u"] == ""


# ---- queries against SQL, and plans


def entry_points():
    from engramlake.plans import registry

    return registry


FAST = "list_by_container memory_hydrated tags_normalised neighbors degree_audit retrievability hybrid_search graph_search prune_memories workspace_top5 near_dup_classes".split()


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    reg = entry_points()
    df = reg.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = con.execute(reg.ORACLES[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    norm = lambda v: "nan" if isinstance(v, float) and v != v else str(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == want


def test_registry_is_whole():
    reg = entry_points()
    assert set(reg.ORACLES) <= set(reg.QUERIES) and len(reg.QUERIES) >= 55


def test_plans(spark, sf):
    from engramlake.tables import read

    l = read(spark, sf, "links")
    plan = graph.neighbours(l, min_strength=0.5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    tops = ws.workspace(read(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("memory"), F.col("ts").alias("added_at")))
    assert "WindowGroupLimit" in tops._jdf.queryExecution().executedPlan().toString()
    from engramlake.plans import queries

    for name in ("knn_batch", "hybrid_search", "sharded_topk"):  # no vectors are shuffled
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
        assert exchanges and not any("vector" in x for x in exchanges)
    assert "SortAggregate" not in queries.knn_batch(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(strength)" in maintain.weak_links(l, AS_OF, params.Params())._jdf.queryExecution().executedPlan().toString()


def test_delete_and_update(spark):
    m = memory_rows(spark, [mem("a", "x"), mem("b", "y"), mem("c", "z")]).withColumn("vector", F.array(F.lit(1.0).cast("float"))).withColumn("updated_at", F.col("created_at"))
    l = links(spark, [(1, "a", "b", "related", 0.5), (2, "b", "c", "related", 0.5), (3, "a", "c", "related", 0.5)])
    left, rest = maintain.delete(m, l, spark.createDataFrame([("b",), ("b",), ("zz",), (None,)], "id string"))
    assert {r["id"] for r in left.collect()} == {"a", "c"} and [r["id"] for r in rest.collect()] == [3]
    ch = spark.createDataFrame([("c", "new", [2.0]), ("zz", "no", [2.0])], "id string, content string, vector array<float>")
    got = {r["id"]: (r["content"], r["vector"][0], r["updated_at"]) for r in maintain.update(m, ch, AS_OF).collect()}
    assert got["c"][:2] == ("new", 2.0) and got["c"][2] != got["a"][2] and got["a"][0] == "x" and len(got) == 3


def test_shards(spark):
    rows = [(1, "user", "h", 0, "users/user_h_shard_0.db", 5, False), (1, "user", "h", 0, "users/user_h_shard_0.db", 5, False), (2, "user", "h", 1, None, -3, True), (3, "project", "a_b", 0, "p/odd.db", 2, None)]
    s = spark.createDataFrame(rows, "id long, scope string, scope_hash string, shard_index int, db_path string, vector_count long, is_active boolean").withColumn("created_at", F.lit(0))
    assert store.catalog(s).count() == 3 and [r["id"] for r in store.active_shards(s).collect()] == [2]
    assert {tuple(r) for r in store.discovered(s).collect()} == {(1, "user", "h", 0)}
    assert store.shard_by_path(s, "/else/user_h_shard_0.db").first()["id"] == 1


@pytest.mark.parametrize("rows_a_task, block", [(50_000, 10_000), (9, 10_000), (9, 3)])
def test_search_of_each_container_equals_brute_force(spark, monkeypatch, rows_a_task, block):
    """Scored where a container is held: the nearest of all queries in all containers are gathered nowhere."""
    monkeypatch.setattr(search, "CONTAINER_ROWS", rows_a_task)
    monkeypatch.setattr(search, "BROADCAST_QUERIES", block)
    rng = np.random.default_rng(4)
    n, p = 60, params.Params(over_fetch=2, decay_enabled=False, similarity_threshold=0.1)
    v, t = rng.standard_normal((n, 6)).astype(np.float32), rng.standard_normal((n, 3)).astype(np.float32)
    c, tags = [("hot", "hot", "b", None)[i % 4] for i in range(n)], [("sparkjobs,x", "", "lake", "x")[i % 4 - i % 3] for i in range(n)]
    data = [(f"m{i:02d}", None if i == 9 else v[i].tolist(), [0.0] * 3 if i == 5 else t[i].tolist(), c[i], tags[i], ("spark lake lake zebra", "")[i % 2]) for i in range(n)]
    rows = spark.createDataFrame(data, "id string, vector array<float>, tags_vector array<float>, container_tag string, tags string, content string")
    rows = rows.withColumns({"created_at": F.lit(AS_OF), "last_accessed_at": F.lit(AS_OF), "stability": F.lit(1.0)})
    q = rows.filter("id < 'm11'").withColumnRenamed("id", "qid")
    found = search.hybrid(rows.unionByName(rows.limit(20)), rows, q, AS_OF, p, 3, "each", 6, 3)
    assert "grp" in found._jdf.queryExecution().executedPlan().toString()  # rows move to their container
    got = {(r["qid"], r["container_tag"], r["rank"]): (r["id"], round(r["similarity"], 6)) for r in found.collect()}
    unit = lambda x: x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    sv, st, want = unit(v) @ unit(v).T, unit(t) @ unit(t).T, {}
    for a in range(11):
        for g in ("hot", "b", None):
            own = [j for j in range(n) if c[j] == g]
            near = sorted((j for j in own if j != 9 and a != 9), key=lambda j: (-sv[a, j], j))[:6]
            near_t = sorted((j for j in own if j != 5 and a != 5), key=lambda j: (-st[a, j], j))[:6]
            words = ["spark", "lake", "lake", "zebra"] if a % 2 == 0 else []
            boost = lambda j: sum(w in tags[j] for w in words) / max(1, len(words))
            score = {j: (sv[a, j] if j in near else 0.0) + 0.3 * max(st[a, j] if j in near_t else 0.0, boost(j)) for j in {*near, *near_t}}
            for rank, j in enumerate(sorted((j for j in score if score[j] >= 0.1), key=lambda j: (-score[j], j))[:3], 1):
                want[f"m{a:02d}", g, rank] = (f"m{j:02d}", round(float(score[j]), 6))
    assert got == want


def test_approximate_search_compares_each_pair_once(spark):
    """At a cosine of 0.75 buckets of one projection hold almost all rows: every pair came out of most of twelve tables."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    df = spark.createDataFrame([(f"m{i:03d}", v.tolist()) for i, v in enumerate(x)], "id string, v array<float>")
    q = df.limit(50).withColumnRenamed("id", "qid")
    found = search.search(df, q, "v", 16, 5, "approximate", 0.5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {(f"m{i:03d}", f"m{j:03d}", rank) for i in range(50) for rank, j in enumerate(sorted(np.flatnonzero(u[i] @ u.T >= 0.5), key=lambda j: -u[i] @ u[j])[:5], 1)}
    assert {(r["qid"], r["id"], r["rank"]) for r in found.collect()} == want and len(want) > 100


def test_shuffles_of_a_written_table_are_deleted(spark):
    from engramlake.session import materialise

    on_disk = lambda: {f for d, _, names in os.walk(spark._jsc.sc().env().blockManager().diskBlockManager().localDirs()[0].getPath()) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    before = on_disk()
    t = materialise(spark.range(50_000).select((F.col("id") % 20_000).alias("k")).groupBy("k").count(), "cleaned")
    for _ in range(50):  # they are deleted in the background
        if not on_disk() - before:
            break
        time.sleep(0.2)
    assert not on_disk() - before and t.count() == 20_000

"""Each operator against a brute-force version on small tables, and the edge cases of its docstring."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engramlake.llm import (
    p1_groups,
    p2_history,
    p3_neighbours,
    p4_neardup,
    p5_survivor,
    p6_clusters,
    p7_packing,
    p8_mixing,
    p9_abuse,
)

UTC = dt.timezone.utc
AS_OF = dt.datetime(2026, 3, 1, tzinfo=UTC)
RECORD = "id string, content string, vector array<float>, note string"


def vectors(n, dim=96, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cos(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    return a @ b / np.sqrt((a @ a) * (b @ b))


def floats(x):
    return [float(v) for v in np.asarray(x, np.float32)]


# ---- p1


def brute_groups(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("last", [0, 20_000])
def test_groups_equal_brute_force(spark, monkeypatch, last):
    monkeypatch.setattr(p1_groups, "LAST_EDGES", last)
    rng = np.random.default_rng(3)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]
    star = [("hub", f"s{i}") for i in range(100)]
    web = [(f"w{a}", f"w{b}") for a, b in rng.integers(0, 150, (120, 2))]
    edges = chain + star + web + star[:5] + [(b, a) for a, b in chain[:9]] + [("x", "x"), (None, "y"), ("z", None)]
    got = p1_groups.connected_groups(spark.createDataFrame(edges, "u string, v string")).collect()
    assert {r["x"]: r["group"] for r in got} == brute_groups(edges)
    assert len(got) == len({r["x"] for r in got})


def test_groups_of_links(spark):
    links = spark.createDataFrame(
        [
            (1, "a", "b", " Semantic", 0.5, 0),
            (2, "b", "c", "semantic", float("nan"), 0),
            (3, "b", "d", "semantic", None, 0),
            (4, "c", "d", "related", 0.9, 0),
            (5, "d", "gone", "semantic", 0.9, 0),
            (6, "gone", "c", "semantic", 0.9, 0),
        ],
        "id long, source_id string, target_id string, link_type string, strength double, rep int",
    )
    mem = spark.createDataFrame([(x,) for x in ("a", "b", "c", "d", "a")], "id string")
    got = {tuple(r) for r in p1_groups.memory_groups(links, mem).collect()}
    assert got == {("a", "a"), ("b", "a")}
    assert p1_groups.memory_groups(links.limit(0), mem).count() == 0


# ---- p2 and p4: brute force over records


def word_set(c):
    import regex

    return set(regex.findall(r"[\p{L}\p{N}]+", (c or "").lower()))


def ok_vector(v):
    return v is not None and len(v) == 96 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def is_alike(a, b):
    if ok_vector(a[2]) and ok_vector(b[2]) and cos(a[2], b[2]) >= 0.985:
        return True
    x, y = word_set(a[1]), word_set(b[1])
    return len(x) >= 8 and len(y) >= 8 and len(x & y) >= 0.7 * len(x | y)


def sample_records(prefix, n, seed):
    rng = np.random.default_rng(seed)
    base = vectors(n, seed=seed)
    out = []
    vocabulary = [f"word{i}" for i in range(3000)]
    for i in range(n):
        w = list(rng.choice(vocabulary, 30))
        out.append([f"{prefix}{i:04d}", " ".join(w), floats(base[i]), "n"])
    for i in range(0, n - 1, 7):  # small edits, and vectors that are nearly equal
        w = out[i][1].split()
        w[3] = "changed"
        out[i + 1][1] = " ".join(w[5:] + w[:4])
        out[min(n - 1, i + 3)][2] = floats(base[i] + 0.008 * rng.standard_normal(96))
    for i in range(5):
        out[i * 9][1:3] = out[0][1:3]
    out[10][1], out[11][1], out[12][1], out[13][1] = None, "", "  ", "short text"
    out[14][2], out[15][2], out[16][2], out[17][2] = None, [0.0] * 96, [float("nan")] * 96, [1.0] * 48
    out[18][1] = " ".join(f"long{i}" for i in range(20_000))
    return [tuple(r) for r in out]


def test_near_duplicates_equal_brute_force(spark):
    rows = sample_records("m", 150, 1)
    truth = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if is_alike(a, b)}
    df = spark.createDataFrame(rows + rows[:9], RECORD)
    got = [tuple(r) for r in p4_neardup.near_duplicates(df).collect()]
    assert len(got) == len(set(got)) and set(got) == truth and len(truth) > 20
    assert p4_neardup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [300_000, 0])
def test_copy_classes_are_stars_by_their_own_size(spark, monkeypatch, broadcast):
    monkeypatch.setattr(p4_neardup, "BROADCAST_IDS", broadcast)
    v = [floats(x) for x in vectors(40, seed=4)]
    big, small = [" ".join(f"{p}{i}" for i in range(20)) for p in "ab"]
    rows = [(f"b{i:02d}", big, v[i], "n") for i in range(30)] + [(f"s{i}", small, v[30 + i], "n") for i in range(4)]
    rows += [("near", big.replace("a7 ", ""), v[34], "n"), ("null", None, None, None)]
    got = [tuple(r) for r in p4_neardup.near_duplicates(spark.createDataFrame(rows, RECORD), copies=10).collect()]
    want = {("b00", f"b{i:02d}") for i in range(1, 30)} | {("b00", "near")} | set(itertools.combinations([f"s{i}" for i in range(4)], 2))
    assert len(got) == len(want) and set(got) == want


def test_copies_are_paired_with_one(spark):
    rows = [(f"k{i:03d}", " ".join(f"w{j}" for j in range(12)), None, "") for i in range(90)] + [
        ("other", " ".join(f"w{j}" for j in range(11)), None, "")
    ]
    got = {tuple(r) for r in p4_neardup.near_duplicates(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == {("k000", f"k{i:03d}") for i in range(1, 90)} | {("k000", "other")}


@pytest.mark.parametrize("kind", ["few", "low rank", "hot"])
def test_recall_of_unusual_vectors(spark, kind):
    rng = np.random.default_rng(21)
    near = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True) + 0.012 * rng.standard_normal(x.shape)
    if kind == "few":
        x = vectors(20, seed=22)
        x = np.concatenate([x, near(x)])
    elif kind == "low rank":
        x = rng.standard_normal((900, 12)) @ rng.standard_normal((12, 96))
        x = np.concatenate([x, near(x[:150])])
    else:  # a third of the rows in one tight cluster
        h = vectors(1, seed=23) + 0.027 * rng.standard_normal((500, 96))
        x = np.concatenate([vectors(1000, seed=24), h, near(h[:200])])
    rows = [(f"m{i:04d}", None, floats(v), "") for i, v in enumerate(x)]
    u = np.array([r[2] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= 0.985, 1))
    truth = {(rows[a][0], rows[b][0]) for a, b in zip(i, j)}
    got = {tuple(r) for r in p4_neardup.near_duplicates(spark.createDataFrame(rows, RECORD)).collect()}
    least = 0.8 if kind == "hot" else 0.9  # inside a tight cluster the signatures of all are much alike
    assert got <= truth and len(got) >= least * len(truth) and len(truth) >= 20


INCOMING = "seq long, batch_no long, incoming_id string, content string, vector array<float>, source string"


def test_repeats_equal_brute_force(spark):
    mem, new = sample_records("m", 80, 2), sample_records("i", 90, 5)
    new = [(i, i // 30, r[0], mem[i % 80][1] if i % 11 == 0 else r[1], r[2], "s") for i, r in enumerate(new)]
    truth = set()
    for k, r in enumerate(new):
        old = [(None, m[1], m[2]) for m in mem] + [(None, o[3], o[4]) for o in new[:k]]
        if any(is_alike((None, r[3], r[4]), o) for o in old):
            truth.add(r[2])
    m = spark.createDataFrame(mem, RECORD)
    df = spark.createDataFrame(new + new[:4], INCOMING)
    assert {r[0] for r in p2_history.repeats(m, df).collect()} == truth and truth
    assert p2_history.repeats(m, df.limit(0)).count() == 0
    # batch after batch against the growing history, with merges, gives the same
    history, got = p2_history.start(m), set()
    for b in range(9):
        part = p2_history.of_incoming(df.filter(f"seq div 10 = {b}"))
        got |= {r[0] for r in p2_history.accept(history, part).collect()}
        history = p2_history.History.open(spark, history.path)  # as a later job would
    assert got == truth and sorted(s[1] for s in history.segments) == [0, 1, 1, 2] and len(history.vectors) == 10


def test_blocks_of_queries_meet_the_shards_one_after_another(spark, monkeypatch):
    """All blocks at once laid a copy of every shard for each of them on disk."""
    written, write = [], p2_history.materialise
    monkeypatch.setattr(p2_history, "materialise", lambda df, name: (written.append(name), write(df, name))[1])
    monkeypatch.setattr(p2_history, "QUERY_BLOCK", 5)
    x = vectors(12, seed=41)
    texts = [" ".join(f"w{i}x{k}" for k in range(9)) for i in range(12)]
    m = spark.createDataFrame([(f"m{i:02d}", texts[i], floats(x[i])) for i in range(6)], "id string, content string, vector array<float>")
    new = [(f"i{i:02d}", i, 0, texts[i], floats(x[(i + 3) % 12])) for i in range(12)]
    inc = spark.createDataFrame(new, "incoming_id string, seq long, batch_no long, content string, vector array<float>")
    got = {r[0] for r in p2_history.repeats(m, inc).collect()}
    # by words 0 to 5; by vectors 9, 10, 11 (vectors 0, 1 and 2) and 0, 1, 2
    assert got == {f"i{i:02d}" for i in (0, 1, 2, 3, 4, 5, 9, 10, 11)}
    assert written.count("p2-found") == 6  # three blocks in the segments of the memories and of the delivery


def test_segments_merge_logarithmically(spark, monkeypatch):
    m = spark.createDataFrame(sample_records("m", 40, 2), RECORD)
    f = p2_history.of_memories(m)
    h = p2_history.History(spark, p2_history.sig.VectorSpace.fit(f.filter("v is not null"), 96))
    for i in range(9):
        h.append(p2_history.symbol_texts(f, h.space))
        h.merge()
    levels = [s[1] for s in h.segments]
    assert len(levels) < 5 and max(levels) == 1
    monkeypatch.setattr(p2_history, "SHARD", 10)
    for i in range(4):
        h.append(p2_history.symbol_texts(f.withColumn("id", p2_history.F.concat("id", p2_history.F.lit(f"-{i}"))), h.space))
    h.merge()
    assert all(r["n"] < 40 for s in h.segments for r in h._read([s[0]]).selectExpr("size(w_reps) as n").collect())  # shards do not grow
    found = h.search(p2_history.symbol_texts(f.withColumn("ord", p2_history.F.lit(5).cast("long")), h.space), 40)
    assert {r["rep"] for r in found.collect()} >= {"m0001", "m0005"}


def test_empty_history(spark):
    m = spark.createDataFrame([], RECORD)
    df = spark.createDataFrame([(i, 0, r[0], r[1], r[2], "s") for i, r in enumerate(sample_records("i", 40, 5))], INCOMING)
    got = {r[0] for r in p2_history.repeats(m, df).collect()}
    assert "i0001" in got and "i0000" not in got


def test_repeats_of_barely_alike_vectors(spark):
    rng = np.random.default_rng(6)
    base = vectors(300, seed=8)
    near = base + 0.0155 * rng.standard_normal(base.shape)
    mem = [(f"m{i:03d}", None, floats(v), "") for i, v in enumerate(base)]
    new = [(i, 0, f"i{i:03d}", None, floats(v), "") for i, v in enumerate(near)]
    truth = {r[2] for i, r in enumerate(new) if cos(r[4], mem[i][2]) >= 0.985}
    got = {r[0] for r in p2_history.repeats(spark.createDataFrame(mem, RECORD), spark.createDataFrame(new, INCOMING)).collect()}
    assert got <= truth and len(got) >= 0.99 * len(truth) and len(truth) > 150


def test_repeats_of_large_families(spark):
    rng = np.random.default_rng(11)
    mem, new = [], []
    eight = [f"e{j}" for j in range(8)]
    for i, v in enumerate(vectors(50, seed=12)):  # one text of eight words with other vectors each
        mem.append((f"e{i:02d}", " ".join(eight), floats(v), ""))
    new.append((0, 0, "copy", " ".join(eight), None, "s"))
    for f in range(20):  # families of 50 shuffled near-copies, and one more of each
        w = [f"f{f}w{j}" for j in range(24)]
        for i in range(51):
            x = list(rng.permutation(w[: 21 + i % 3])) + [f"f{f}x{i}y{j}" for j in range(2)]
            text = " ".join(rng.permutation(x))
            if i < 50:
                mem.append((f"f{f:02d}m{i:02d}", text, None, ""))
            else:
                new.append((f + 1, 0, f"f{f:02d}", text, None, "s"))
    base = vectors(100, seed=13)  # families of 12 vectors
    near = base[:, None] + 0.008 * rng.standard_normal((100, 13, 96))
    mem += [(f"v{i:02d}m{j:02d}", None, floats(near[i, j]), "") for i in range(100) for j in range(12)]
    new += [(100 + i, 0, f"v{i:02d}", None, floats(near[i, 12]), "s") for i in range(100)]
    truth = {r[2] for r in new if any(is_alike((None, *r[3:5]), o) for o in mem)}
    got = {r[0] for r in p2_history.repeats(spark.createDataFrame(mem, RECORD), spark.createDataFrame(new, INCOMING)).collect()}
    assert got <= truth and len(truth) == 121 and {x for x in truth - got if x[0] != "v"} == set() and len(got) >= 120


# ---- p3


def brute_near(rows, k, least):
    ok = {}
    for r in rows:
        if ok_vector(r[2]):
            ok.setdefault(r[0], r[2])
    ids = sorted(ok)
    x = np.array([np.asarray(ok[i], float) for i in ids])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for i, a in enumerate(ids):
        s = x @ x[i]
        best = sorted((-round(float(s[j]), 9), ids[j]) for j in range(len(ids)) if j != i)[:k]
        out |= {(min(a, b), max(a, b)) for c, b in best if -c >= least}
    return out


def test_close_pairs_equal_brute_force(spark):
    rows = sample_records("m", 150, 4)
    got = p3_neighbours.close_pairs(spark.createDataFrame(rows + rows[:5], RECORD), {"vector": 96})
    assert {(r[0], r[1]) for r in got.collect()} == brute_near(rows, 5, 0.96)
    assert p3_neighbours.close_pairs(spark.createDataFrame([], RECORD), {"vector": 96}).count() == 0


def test_many_copies_keep_five_neighbours(spark):
    v = floats(vectors(1)[0])
    rows = [(f"k{i:03d}", "", v, "") for i in range(40)]
    got = p3_neighbours.neighbours(spark.createDataFrame(rows, RECORD), "vector", 96)
    by = {}
    for r in got.collect():
        by.setdefault(r["id"], []).append((r["rank"], r["other"]))
    assert len(by) == 40 and sorted(by["k039"]) == [(i + 1, f"k{i:03d}") for i in range(5)]


def test_neighbours_over_parts_of_cells_and_two_levels(spark, monkeypatch):
    from engramlake.llm import cells

    monkeypatch.setattr(p3_neighbours, "PART", 40)
    rows = sample_records("m", 150, 4)
    got = p3_neighbours.close_pairs(spark.createDataFrame(rows, RECORD), {"vector": 96})
    assert {(r[0], r[1]) for r in got.collect()} == brute_near(rows, 5, 0.96)
    monkeypatch.setattr(cells, "FIRST", 4)
    monkeypatch.setattr(p3_neighbours, "CELL", 8)
    got = p3_neighbours.close_pairs(spark.createDataFrame(rows, RECORD), {"vector": 96})
    found, truth = {(r[0], r[1]) for r in got.collect()}, brute_near(rows, 5, 0.96)
    assert found <= truth and len(found) >= 0.9 * len(truth)


def test_no_plan_of_close_pairs_is_large(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    before = {e.executionId() for e in executions(store)}
    rows = sample_records("m", 150, 4)
    two = [(*r, r[2]) for r in rows + [(f"c{i}", "", rows[0][2], "") for i in range(9)]]  # with copies
    got = p3_neighbours.close_pairs(spark.createDataFrame(two, RECORD + ", tags_vector array<float>"), {"vector": 96, "tags_vector": 96})
    truth = brute_near([r[:4] for r in two], 5, 0.96)
    assert {tuple(r) for r in got.collect()} == {(a, b, f) for a, b in truth for f in ("vector", "tags_vector")}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    own = [e.executionId() for e in executions(store) if e.executionId() not in before]
    assert own and max(store.planGraph(e).allNodes().size() for e in own) <= 100


def executions(store):
    e = store.executionsList()
    return [e.apply(i) for i in range(e.size())]


def test_recall_of_all_neighbours(spark, sf):
    from engramlake.tables import read

    mem = read(spark, "/root/testdata/sf0.01", "memories")
    got = p3_neighbours.neighbours(mem, "vector", 96, k=5).select("id", "other").toPandas()
    rows = mem.select("id", "content", "vector").collect()
    truth = brute_near([tuple(r) for r in rows], 5, -1)
    found = {(min(a, b), max(a, b)) for a, b in zip(got["id"], got["other"])}
    assert len(found & truth) / len(truth) >= 0.9


# ---- p5


def test_survivors(spark):
    t = lambda d: dt.datetime(2026, 2, d, tzinfo=UTC)
    late = dt.datetime(2027, 1, 1, tzinfo=UTC)
    mem = spark.createDataFrame(
        [
            ("a", None, t(3), 1.0, " ", "x", 1),
            ("a", None, t(3), 1.0, " ", "x", 1),
            ("b", False, late, 9.0, "B", "y", 1),
            ("c", True, None, -1.0, None, "x", 1),
            ("d", None, t(4), None, None, "y", 1),
            ("e", None, t(4), 2.0, None, "y", 1),
        ],
        "id string, is_pinned boolean, updated_at timestamp, stability double, display_name string, tier string, group_id int",
    )
    groups = spark.createDataFrame(
        [("g1", x, None) for x in "aabc"] + [("g2", x, None) for x in "de"] + [("g3", "a", None), ("g4", "a", None), ("g4", "zz", None)],
        "group_id string, memory_id string, found_at timestamp",
    )
    got = {r["group_id"]: (r["survivor_id"], r["display_from_id"]) for r in p5_survivor.survivors(groups, mem, AS_OF).collect()}
    assert got == {"g1": ("c", "b"), "g2": ("e", "")}
    assert p5_survivor.survivors(groups.limit(0), mem, AS_OF).count() == 0


def test_current_value_without_timestamps(spark):
    t = lambda d: dt.datetime(2026, 2, d, tzinfo=UTC)
    mem = spark.createDataFrame(
        [("a", "hippocampus", t(1)), ("b", "neocortex", t(2)), ("c", "hippocampus", None), ("d", "Neocortex ", None), ("e", "hippocampus", None)],
        "id string, tier string, updated_at timestamp",
    )
    groups = spark.createDataFrame([("g1", "a"), ("g1", "b"), ("g2", "c"), ("g2", "d"), ("g2", "e")], "group_id string, memory_id string")
    got = {r["group_id"]: (r["value"], r["dated"]) for r in p5_survivor.current_values(groups, mem, "tier", AS_OF).collect()}
    assert got == {"g1": ("neocortex", True), "g2": ("neocortex", False)}


def test_current_value_by_learnt_order(spark):
    t = lambda d: dt.datetime(2026, 2, d, tzinfo=UTC)
    rows, groups = [], []

    def group(g, *values):
        for i, (v, at) in enumerate(values):
            rows.append((f"{g}{i}", v, at))
            groups.append((g, f"{g}{i}"))

    group("l1", ("apple", t(1)), ("mango", t(2)))
    group("l3", ("apple", t(1)), ("mango", t(2)))  # outvotes u3
    group("l2", ("mango", t(1)), ("cherry", t(2)))
    for a, b in (("x", "y"), ("y", "z"), ("z", "x")):  # a circle teaches nothing about its own values
        group(f"c{a}", (a, t(1)), (b, t(2)))
    group("u1", ("apple", None), ("apple", None), ("cherry", None))  # two steps apart
    group("u2", ("x", None), ("x", None), ("z", None))
    group("u3", ("mango", t(3)), ("apple", t(5)), ("cherry", None))  # an undated value follows the latest dated one
    group("u4", ("cherry", t(3)), ("apple", None), ("other", None), ("other", None))
    mem = spark.createDataFrame(rows, "id string, tier string, updated_at timestamp")
    g = spark.createDataFrame(groups, "group_id string, memory_id string")
    got = {r["group_id"]: (r["value"], r["dated"]) for r in p5_survivor.current_values(g, mem, "tier", AS_OF).collect()}
    assert got["u1"] == ("cherry", False) and got["u2"] == ("x", False) and got["u3"] == ("cherry", False) and got["u4"] == ("cherry", True)
    assert got["l1"] == ("mango", True) and p5_survivor.current_values(g.limit(0), mem, "tier", AS_OF).count() == 0


# ---- p6


def test_clusters(spark):
    rng = np.random.default_rng(0)
    centre = vectors(4, seed=9)
    rows = []
    for c, n in enumerate((60, 25, 12, 0)):
        for i in range(n):
            rows.append((f"c{c}_{i:03d}", "", floats(centre[c] + 0.04 * rng.standard_normal(96)), ""))
    # an elongated group: neighbours are alike, ends are not
    a, b = centre[3], vectors(1, seed=77)[0]
    rows += [(f"z{i:02d}", "", floats(a * np.cos(x) + b * np.sin(x)), "") for i, x in enumerate(np.linspace(0, 1.5, 30))]
    rows += [(f"n{i:03d}", "", floats(v), "") for i, v in enumerate(vectors(100, seed=5))]
    rows += [(f"k{i:03d}", "", floats(vectors(1, seed=123)[0]), "") for i in range(70)] + [("bad", "", None, ""), ("c0_000", "", rows[0][2], "")]
    members, summary = p6_clusters.clusters(spark.createDataFrame(rows, RECORD))
    got = {tuple(r) for r in members.collect()}
    want = {(r[0], r[0][:2] + "_000") for r in rows if r[0][:2] in ("c0", "c1")} | {(r[0], "k000") for r in rows if r[0][0] == "k"}
    assert got == want
    s = {r["group_id"]: r for r in summary.collect()}
    assert s["c0_000"]["n_members"] == 60 and s["k000"]["n_members"] == 70
    x = np.array([np.asarray(r[2], float) for r in rows[:60]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert abs(s["c0_000"]["avg_cosine"] - ((x @ x.T).sum() - 60) / (60 * 59)) < 1e-4
    assert s["c0_000"]["medoids"].split(",")[0] == rows[int((x @ x.T).sum(axis=1).argmax())][0]
    assert p6_clusters.clusters(spark.createDataFrame([], RECORD))[0].count() == 0


@pytest.mark.parametrize("block", [6000, 700])
def test_small_clusters_in_a_large_cell_stay_whole(spark, monkeypatch, block):
    monkeypatch.setattr(p6_clusters, "CELL", 100_000)  # all rows are one cell
    monkeypatch.setattr(p6_clusters, "BLOCK", 2 * block)
    rng = np.random.default_rng(1)
    rows = [(f"n{i:04d}", "", floats(v), "") for i, v in enumerate(vectors(3000, seed=31))]
    for k, c in enumerate(vectors(6, seed=32)):
        rows += [(f"c{k}_{i:02d}", "", floats(c + 0.045 * rng.standard_normal(96)), "") for i in range(24)]
    members, _ = p6_clusters.clusters(spark.createDataFrame(rows, RECORD))
    assert {tuple(r) for r in members.collect()} == {(f"c{k}_{i:02d}", f"c{k}_00") for k in range(6) for i in range(24)}
    points = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "id string, weight long, v array<float>")
    local = p6_clusters.local_clusters(points, len(rows), 96, 0.65, 4, 2).collect()
    assert sum(r["home"] for r in local) == len({r["id"] for r in local}) and all((r["v"] is not None) == r["home"] for r in local)
    if block == 700:
        assert len({r["cluster"] for r in local}) > 6


def test_a_cell_without_clusters_gives_no_rows():
    import pyarrow as pa

    pdf = pd.DataFrame({"id": [f"n{i}" for i in range(10)], "weight": 1, "home": True, "v": list(vectors(10, seed=34))})
    out = p6_clusters._cell((3, 0, 0), pdf, 0.65, 4)
    assert not len(out) and isinstance(pa.Array.from_pandas(out["cluster"], type=pa.string()), pa.StringArray)


def test_a_point_clustered_outside_its_first_cell_keeps_its_vector(spark, monkeypatch):
    local = p6_clusters.local_clusters
    lost = lambda c: F.when(~F.col("id").isin("c0_03", "c0_30"), F.col(c))

    def elsewhere(*args):  # as if their first cell had left these out
        return local(*args).withColumns({"home": F.coalesce(lost("home"), F.lit(False)), "v": lost("v")})

    monkeypatch.setattr(p6_clusters, "local_clusters", elsewhere)
    rng = np.random.default_rng(8)
    rows = [(f"c0_{i:02d}", "", floats(3 * v), "") for i, v in enumerate(vectors(1, seed=35)[0] + 0.045 * rng.standard_normal((40, 96)))]
    assert p6_clusters.clusters(spark.createDataFrame(rows, RECORD))[0].count() == 40


def test_pivots_grow_with_the_rows(spark, monkeypatch):
    from engramlake.llm import cells

    monkeypatch.setattr(cells, "FIRST", 8)
    x = vectors(4000, 16, seed=3)
    x[:1500] = x[0] + 0.05 * x[:1500]  # one dense spot
    df = spark.createDataFrame([(f"i{i:04d}", floats(v)) for i, v in enumerate(x)], "id string, v array<float>")
    c = cells.Cells.fit(df, 4000, 50, 16)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    home = c.nearest(u, 1)[:, 0]
    assert len(c.first) == 8 and len(c.pivots) > 60 and np.bincount(home).max() < 500 and abs(c.expected.sum() - 4000) < 40
    exact = cells.nearest(u, c.pivots, 2)
    assert (c.nearest(u, 2, wide=8) == exact).mean() > 0.99 and (c.nearest(u, 2)[:, 0] == exact[:, 0]).mean() > 0.8


# ---- p7


def test_packing(spark):
    sizes = [0, 0, 1, 5, 511, 512, 513, 1024, 1300, 256, 257] + [170] * 40 + [100] * 33
    items = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long")
    got = p7_packing.pack(items, share_rows=50).collect()
    fill, pieces = {}, {}
    for r in got:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["first_token"], r["n_tokens"]))
    assert max(fill.values()) <= 512 and set(pieces) == set(range(len(sizes)))
    for d, p in pieces.items():
        assert sum(n for _, n in p) == sizes[d] and len(p) == max(1, -(-sizes[d] // 512))
        assert all(a[0] + a[1] == b[0] for a, b in zip(sorted(p), sorted(p)[1:]))
    assert p7_packing.pack(items.limit(0)).count() == 0
    # containers that are not of the first class hold their fixed number, but for the last of a share
    many = spark.createDataFrame([(i, 1 + i * 37 % 512) for i in range(2000)], "doc_id long, n_tokens long")
    one = p7_packing.pack(many)
    rows = one.groupBy("container_id", "slots").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"), F.sum(F.col("beside").cast("int")).alias("b")).collect()
    assert max(r["t"] for r in rows) <= 512 and all(r["k"] == 1 + r["b"] <= 2 if r["slots"] == 1 else r["k"] <= r["slots"] and r["b"] == 0 for r in rows)
    assert max(sum(1 for r in rows if r["slots"] == j and r["k"] < j) for j in range(2, 513)) <= 1
    assert sum(r["t"] for r in rows) / 512 / len(rows) > 0.95
    assert {r[0] for r in one.filter("beside").select("slots").distinct().collect()} == {1}


def test_packing_documents(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "x " * 600, 9), (4, "a_b, c!? d", 9), (4, "again", 9)], "doc_id long, text string, slots int")
    packed = p7_packing.pack_documents(docs)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in packed.collect()) == [(1, 0), (2, 0), (3, 88), (3, 512), (4, 1), (4, 5)]
    assert [r[0] for r in p7_packing.split_documents(packed.filter("doc_id <> 4")).collect()] == [3]


# ---- p8


def test_mix(spark, monkeypatch):
    docs = [(i, "w " * (5 + i % 7), ("Big ", "small", "other", None)[0 if i < 700 else 1 if i < 720 else 2 if i < 900 else 3], 1) for i in range(950)]
    docs += [(999, None, "big", 1), (1000, "", "big", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, position int")
    t = spark.createDataFrame([("big", 0.5, None), (" SMALL", 0.3, 3), ("nowhere", 0.2, 2)], "source string, target_share double, max_repeats int")
    total = sum(len((x[1] or "").split()) for x in docs)
    own = {s: sum(len((x[1] or "").split()) for x in docs if (x[2] or "").strip().lower() == s) for s in ("big", "small")}
    m = p8_mixing.mix(d, t, schedules={"big": ((0, 0.0), (1, 2.0))}).collect()
    assert [r["position"] for r in m] == sorted(r["position"] for r in m) and all(0 <= r["position"] < 1 for r in m)
    got = {s: sum(r["n_tokens"] for r in m if r["source"] == s) for s in ("big", "small")}
    assert 0.5 * total <= got["big"] < 0.5 * total + 15 and got["small"] == 3 * own["small"]
    late = sum(r["n_tokens"] for r in m if r["source"] == "big" and r["position"] >= 0.5)
    assert abs(late / got["big"] - 0.75) < 0.02  # a rising schedule gives three quarters to the second half
    monkeypatch.setattr(p8_mixing, "RANGE", 7)  # the ranges do not show in the result
    assert p8_mixing.mix(d, t, schedules={"big": ((0, 0.0), (1, 2.0))}).collect() == m
    s = {r["source"]: r for r in p8_mixing.shares(d, t).collect()}
    assert not s["big"]["short"] and s["small"]["short"] and s["nowhere"]["short"] and s["small"]["most_repeats"] == 3
    assert p8_mixing.mix(d.limit(0), t).count() == 0 and p8_mixing.mix(d, t.limit(0)).count() == 0


# ---- p9


def test_words_are_normalised():
    for a, b in (("Id-iot", "idiot"), ("basttttard", "bastard"), ("m0r0n", "moron"), ("sc​um".replace("​", ""), "scum"), ("crétin", "cretin"), ("Sсhwасh", "schwach")):
        assert p9_abuse.normal_words(a.lower()) == p9_abuse.normal_words(b)
    texts = ["you h o r n y one", "", None, "a b", "x y", "an i\u200bdi\u200bot, n o w!"]
    h1, n1 = p9_abuse.hashed_words(pa.array(texts).slice(0), p9_abuse._Hashes())
    h2, n2 = p9_abuse.hashed_words(pa.array(["off", "you horny one", "", None, "a b", "x y", "an idiot now"]).slice(1), p9_abuse._Hashes())
    assert list(h1) == list(h2) and list(n1) == list(n2) == [3, 0, 0, 2, 2, 3]
    assert [len(x) for x in p9_abuse.hashed_words(pa.array([None, ""], pa.string()), p9_abuse._Hashes())] == [0, 2]


def test_cut_of_best_f1():
    y = np.array([1, 1, 1, 0, 1, 0, 0, 0])
    s = np.array([9, 8, 7, 6, 5, 2, 1, 0.0])
    assert p9_abuse.best_cut(s, y) == 3.5 and p9_abuse.best_cut(s, 0 * y) == 0.0 and p9_abuse.best_cut(s[:0], y[:0]) == 0.0
    assert p9_abuse.best_cut(np.zeros(8), y) == 0.0


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(0)
    plain = [f"term{i}" for i in range(400)]
    bad = ["you are a pathetic moron", "get lost you miserable idiot", "nobody wants you here scumbag"]
    docs, labels = [], []
    for i in range(900):
        w = list(rng.choice(plain, 60))
        harmful = i % 5 == 0
        if harmful:
            w[20:20] = bad[i % 3].split()
        docs.append((i, " ".join(w), "src", 1))
        if i < 600:
            wrong = i % 37 == 0
            labels.append((i, " None" if harmful == wrong else "abusive", "a"))
    labels += [(5, None, "b"), (1, "none", "b"), (1, "sexual", "c")]
    docs += [(2000, None, None, 1), (2001, "", "src", 1), (2002, "x " * 50_000, "src", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, score int")
    l = spark.createDataFrame(labels, "doc_id long, label string, annotator string")
    scored = p9_abuse.score(d, p9_abuse.fit(d, l))
    got = {r["doc_id"]: r["score"] >= 0.5 for r in scored.collect()}
    right = sum(got[i] == (i % 5 == 0) for i in range(600, 900))
    assert right >= 290 and not got[2000] and not got[2001] and not got[2002] and len(got) == len(docs)
    rates = {r["source"]: r["docs"] for r in p9_abuse.flag_rates(scored).collect()}
    assert rates == {"src": len(docs) - 1, None: 1}
    nothing = p9_abuse.score(d.limit(5), p9_abuse.fit(d, l.limit(0)))
    assert all(r["score"] < 0.01 for r in nothing.collect())

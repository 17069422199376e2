"""DuckDB SQL of the core's queries, over the same whole tables."""

from __future__ import annotations

from ..functions.text import ISO1, STOPWORDS

AS_OF = "TIMESTAMPTZ '2026-03-01 00:00:00+00'"
MEM = "mem AS (SELECT DISTINCT ON (id) * FROM memories WHERE id IS NOT NULL ORDER BY id, last_accessed_at DESC NULLS LAST)"
Q = "q AS (SELECT m.* FROM mem m WHERE m.id IN (SELECT source_id FROM links WHERE id % 50 = 0))"
LOWER_TAGS = "list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda x: lower(trim(x))), lambda x: x <> '')"
WORDS = r"regexp_extract_all(lower(coalesce(content, '')), '[\p{L}\p{N}]+')"
ENG = "[" + ", ".join(f"'{w}'" for w in STOPWORDS["eng"]) + "]"
KEYWORDS = f"list_filter({WORDS}, lambda w: length(w) > 1 AND NOT list_contains({ENG}, w))"
TRIVIAL = "(trim(coalesce(content, '')) LIKE '%?' OR length(trim(coalesce(content, ''))) < 15)"


def days(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0)"


def curve(d: str, s: str) -> str:
    f = 0.9 ** (1 / -0.5) - 1
    base = f"(1 + {f!r} * {d} / {s})"
    return (
        f"CASE WHEN {s} <= 0 THEN 1.0 WHEN {base} < 0 THEN CAST('nan' AS DOUBLE) "
        f"ELSE greatest(0.0, least(1.0, pow(CASE WHEN {base} > 0 THEN {base} ELSE 1e-12 END, -0.5))) END"
    )


R = curve(days(AS_OF, "coalesce(last_accessed_at, created_at)"), "coalesce(stability, 1.0)")


def usable(field: str, dim: int) -> str:
    return (
        f"len({field}) = {dim} AND len(list_filter({field}, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
        f" AND len(list_filter({field}, lambda x: x <> 0)) > 0"
    )


def unit(name: str, table: str, field: str, dim: int, extra: str = "") -> str:
    d = f"CAST({field} AS DOUBLE[])"
    return f"{name} AS (SELECT id, {extra} {d} AS v, sqrt(list_dot_product({d}, {d})) AS n FROM {table} WHERE {usable(field, dim)})"


COS = "list_dot_product(a.v, b.v) / (a.n * b.n)"


def knn(field: str, dim: int, k: int) -> str:
    return f"""WITH {MEM}, {Q}, {unit("qu", "q", field, dim)}, {unit("mu", "mem", field, dim)},
s AS (SELECT a.id AS qid, b.id AS id, {COS} AS sim FROM qu a CROSS JOIN mu b),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM s)
SELECT qid, id, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}"""


def hybrid(thr: float = 0.25, decay: bool = True, container: str = "none", k: int = 10) -> str:
    """CTEs that end with hits(qid, id, container_tag, similarity, rank); container "each": k hits of every container."""
    each = container == "each"
    pre = "AND a.c = b.c" if container == "pre" else ""
    c = "container_tag AS c,"
    sides = []
    for name, field, dim in (("content", "vector", 96), ("tags", "tags_vector", 32)):
        sides.append(unit(f"qu_{name}", "q", field, dim, c))
        sides.append(unit(f"mu_{name}", "mem", field, dim, c))
        sides.append(
            f"""t_{name} AS (SELECT * FROM (SELECT a.id AS qid, b.id AS id, {COS} AS sim,
 row_number() OVER (PARTITION BY a.id{", b.c" if each else ""} ORDER BY {COS} DESC, b.id) AS r FROM qu_{name} a JOIN mu_{name} b ON true {pre}) WHERE r <= {4 * k})"""
        )
    post = "WHERE m.container_tag = q.container_tag" if container == "post" else ""
    r = R.replace("last_accessed_at", "m.last_accessed_at").replace("created_at", "m.created_at").replace("stability", "m.stability") if decay else "1.0"
    r = r.replace("m.m.", "m.")
    return f"""WITH {MEM}, {Q}, {", ".join(sides)},
f AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, coalesce(a.sim, 0.0) AS cs, coalesce(b.sim, 0.0) AS ts
  FROM t_content a FULL JOIN t_tags b ON a.qid = b.qid AND a.id = b.id),
kw AS (SELECT id, {KEYWORDS} AS kw FROM q),
tg AS (SELECT id, {LOWER_TAGS} AS tg FROM mem),
s AS (SELECT f.qid, f.id, m.container_tag, (cs + 0.3 * greatest(ts, CASE WHEN len(kw.kw) > 0 THEN
    len(list_filter(kw.kw, lambda w: len(list_filter(tg.tg, lambda t: contains(t, w))) > 0)) / len(kw.kw) ELSE 0.0 END)) * ({r}) AS similarity
  FROM f JOIN mem m ON m.id = f.id JOIN kw ON kw.id = f.qid JOIN tg ON tg.id = f.id JOIN q ON q.id = f.qid {post}),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid{", container_tag" if each else ""} ORDER BY similarity DESC, id) AS rank FROM s
  WHERE similarity >= {thr} AND NOT isnan(similarity)) WHERE rank <= {k})"""


OUT = " SELECT qid, id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM hits"
U = """u AS (
  SELECT source_id AS node, target_id AS neighbor, id AS link_id, lower(trim(link_type)) AS link_type, strength FROM links WHERE source_id <> target_id
  UNION ALL SELECT target_id, source_id, id, lower(trim(link_type)), strength FROM links WHERE source_id <> target_id)"""
STORED = """stored AS (SELECT DISTINCT * FROM (SELECT id AS cluster_id, scope, avg_strength, unnest(CAST(member_ids AS VARCHAR[])) AS member FROM (
  SELECT id, scope, avg_strength, from_json(member_ids, '["VARCHAR"]') AS member_ids FROM clusters WHERE json_valid(member_ids))) WHERE member IS NOT NULL)"""
STRONG = "lower(trim(link_type)) = 'semantic' AND strength >= 0.5 AND NOT isnan(strength) AND source_id <> target_id"


def groups(edges: str, least: int) -> str:
    return f"""ge AS (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM {edges}),
gu AS (SELECT a, b FROM ge UNION SELECT b, a FROM ge),
gr(node, reached) AS (SELECT DISTINCT a, a FROM gu UNION SELECT gr.node, gu.b FROM gr JOIN gu ON gu.a = gr.reached),
gl AS (SELECT node, min(reached) AS "group" FROM gr GROUP BY node),
g AS (SELECT * FROM gl WHERE "group" IN (SELECT "group" FROM gl GROUP BY "group" HAVING count(*) >= {least}))"""


LINK_GROUPS = "WITH RECURSIVE " + groups(f"(SELECT * FROM links WHERE {STRONG})", 3)
EXPIRED = f"(SELECT id FROM mem WHERE lower(trim(tier)) = 'hippocampus' AND {days(AS_OF, 'created_at')} > 7)"
SHINGLES = rf"""sh AS (
  SELECT id, coalesce(container_tag, '__global__') AS c, created_at, stability, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM (SELECT id, container_tag, created_at, stability, {WORDS} AS w FROM mem) WHERE len(w) >= 5),
one AS (SELECT id, c, len(s) AS n, unnest(s) AS g FROM sh),
near AS (SELECT a.id AS source_id, b.id AS target_id FROM one a JOIN one b ON a.c = b.c AND a.g = b.g AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9)"""
ADJACENT = f"""WITH {MEM}, {unit("v", "mem", "vector", 96, "container_tag, created_at,")},
l AS (SELECT *, lag(v) OVER w AS pv, lag(n) OVER w AS pn FROM v WINDOW w AS (PARTITION BY container_tag ORDER BY created_at, id)),
s AS (SELECT container_tag, list_dot_product(v, pv) / (n * pn) AS sim FROM l WHERE pv IS NOT NULL)"""


def incoming(k: int) -> str:
    return f"""WITH {MEM}, i AS (SELECT DISTINCT ON (incoming_id) incoming_id AS id, vector FROM incoming WHERE incoming_id IS NOT NULL),
{unit("qu", "i", "vector", 96)}, {unit("mu", "mem", "vector", 96)},
s AS (SELECT a.id AS qid, b.id AS id, {COS} AS sim FROM qu a CROSS JOIN mu b),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM s)
SELECT * FROM r WHERE rank <= {k}"""


SCOPE = """CASE WHEN len(string_split(container_tag, '_')) >= 3 THEN string_split(container_tag, '_')[2] ELSE 'user' END AS scope,
CASE WHEN len(string_split(container_tag, '_')) >= 3 THEN array_to_string(string_split(container_tag, '_')[3:], '_') ELSE container_tag END AS scope_hash"""

LANGS = {c: "[" + ", ".join(f"'{w}'" for w in ws) + "]" for c, ws in STOPWORDS.items()}
HITS = ", ".join(f"len(list_filter(w, lambda x: list_contains({v}, x))) AS h_{c}" for c, v in LANGS.items())
BEST = "greatest(" + ", ".join(f"h_{c}" for c in LANGS) + ")"
PICK = " ".join(f"WHEN h_{c} = {BEST} THEN '{c}'" for c in LANGS)

ORACLES = {
    "list_recent": f"WITH {MEM} SELECT id, container_tag, epoch_us(created_at) AS created_us FROM mem ORDER BY created_at DESC NULLS LAST, id LIMIT 100",
    "list_by_container": f"""WITH {MEM} SELECT container_tag, id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER
 (PARTITION BY container_tag ORDER BY created_at DESC NULLS LAST, id) AS rank FROM mem) WHERE rank <= 20""",
    "memory_hydrated": f"""WITH {MEM} SELECT id, CAST(CASE WHEN coalesce(tags, '') = '' THEN 0 ELSE len(string_split(tags, ',')) END AS INTEGER) AS n_tags,
 coalesce(is_pinned, false) AS is_pinned, coalesce(stability, 1.0) AS stability, epoch_us(coalesce(last_accessed_at, created_at)) AS accessed_us,
 coalesce(lower(trim(tier)), 'neocortex') AS tier FROM mem""",
    "memories_by_session": f"""WITH {MEM}, s AS (SELECT *, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.sessionID') END AS session FROM mem)
 SELECT session, count(*) AS n, arg_max(id, (created_at, id)) AS latest FROM s WHERE session IS NOT NULL GROUP BY session""",
    "tags_normalised": f"WITH {MEM} SELECT id, array_to_string({LOWER_TAGS}, '|') AS tags FROM mem",
    "tag_counts": f"WITH {MEM}, t AS (SELECT id, unnest({LOWER_TAGS}) AS tag FROM mem) SELECT tag, count(*) AS n_uses, count(DISTINCT id) AS n_memories FROM t GROUP BY tag",
    "trivial_memories": f"WITH {MEM} SELECT id FROM mem WHERE {TRIVIAL}",
    "container_counts": f"""WITH {MEM} SELECT coalesce(container_tag, '__global__') AS container_tag, count(*) AS n,
 count(*) FILTER (WHERE lower(trim(tier)) = 'hippocampus') AS n_ephemeral FROM mem GROUP BY 1""",
    "keyword_hits": f"WITH {MEM}, k AS (SELECT id, {KEYWORDS} AS k FROM mem) SELECT id, CAST(len(k) AS INTEGER) AS n_keywords, array_to_string(k, ' ') AS keywords FROM k",
    "detected_languages": f"""WITH t AS (SELECT coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
 h AS (SELECT t, {HITS} FROM t), c AS (SELECT CASE WHEN length(t) < 20 OR {BEST} = 0 THEN 'eng' {PICK} END AS code FROM h)
 SELECT code, count(*) AS n, CASE code {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ISO1.items())} ELSE 'en' END AS locale FROM c GROUP BY code""",
    "sentence_counts": r"""SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS INTEGER)
 AS n_sentences FROM documents""",
    "knn_batch": knn("vector", 96, 10),
    "knn_tags": knn("tags_vector", 32, 10),
    "hybrid_search": hybrid() + OUT,
    "hybrid_search_no_decay": hybrid(0.6, False) + OUT,
    "hybrid_search_container_post": hybrid(container="post") + OUT,
    "hybrid_search_container_pre": hybrid(container="pre") + OUT,
    "sharded_topk": hybrid(decay=False, container="each") + """,
 b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS r2 FROM hits)
 SELECT qid, id, round(similarity, 6) AS similarity, CAST(r2 AS INTEGER) AS rank FROM b WHERE r2 <= 20""",
    "graph_search": hybrid() + f""", {U}, {STORED},
 via AS (SELECT h.qid, u.neighbor AS id, u.strength, h.id AS linked_from, u.link_type, row_number() OVER (PARTITION BY h.qid, u.neighbor ORDER BY h.rank, u.link_id, h.id, u.link_type, u.strength) AS r
   FROM hits h JOIN u ON u.node = h.id),
 al AS (SELECT qid, id, similarity, 'search' AS source, NULL AS linked_from, NULL AS link_type FROM hits
   UNION ALL SELECT qid, id, strength, 'link', linked_from, link_type FROM via v WHERE r = 1 AND id IN (SELECT id FROM mem) AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.qid = v.qid AND h.id = v.id)),
 best AS (SELECT member, arg_max(cluster_id, (coalesce(avg_strength, -1.0), cluster_id)) AS cluster_id FROM stored GROUP BY member)
 SELECT qid, id, round(CASE WHEN isnan(similarity) THEN -1.0 ELSE similarity END, 6) AS similarity, source, linked_from, link_type, cluster_id
 FROM al LEFT JOIN best ON best.member = al.id""",
    "hebbian_delta": hybrid() + """,
 p AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM hits a JOIN hits b ON a.qid = b.qid AND a.id < b.id GROUP BY 1, 2),
 k AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, min(id) AS link_id, arg_min(coalesce(strength, -1.0), id) AS s
   FROM links WHERE lower(trim(link_type)) = 'semantic' GROUP BY 1, 2)
 SELECT p.a, p.b, link_id, round(least(1.0, CASE WHEN s IS NULL OR s < 0 AND s = -1.0 OR isnan(s) THEN 0.0 ELSE s END + n * 0.05), 6) AS strength FROM p LEFT JOIN k ON k.a = p.a AND k.b = p.b""",
    "neighbors": f"WITH {U} SELECT node, neighbor, min(link_id) AS link_id FROM u GROUP BY node, neighbor",
    "neighbors_strong_semantic": f"""WITH {U} SELECT node, neighbor, min(link_id) AS link_id, round(arg_min(strength, link_id), 6) AS strength FROM u
 WHERE link_type = 'semantic' AND strength >= 0.5 AND NOT isnan(strength) GROUP BY node, neighbor""",
    "degree_audit": """WITH e AS (SELECT source_id AS node, target_id AS other FROM links UNION ALL SELECT target_id, source_id FROM links WHERE source_id <> target_id)
 SELECT node, count(*) AS n_links, count(DISTINCT other) FILTER (WHERE other <> node) AS n_neighbours FROM e WHERE node IS NOT NULL GROUP BY node""",
    "link_upsert_ignore": """SELECT DISTINCT target_id AS source_id, source_id AS target_id, coalesce(link_type, 'related') AS link_type, 0.5 AS strength
 FROM links l WHERE id % 50 = 0 AND NOT EXISTS (SELECT 1 FROM links k WHERE k.source_id = l.target_id AND k.target_id = l.source_id AND k.link_type = coalesce(l.link_type, 'related'))""",
    "link_strengthen": """SELECT id, source_id, target_id, link_type, round(CASE WHEN isnan(s) THEN -1.0 ELSE s END, 6) AS strength FROM (
 SELECT l.*, CASE WHEN (source_id, target_id, link_type) IN (SELECT (source_id, target_id, link_type) FROM links WHERE id % 50 = 0) AND strength IS NOT NULL
   THEN least(1.0, strength + 0.2) ELSE strength END AS s FROM links l)""",
    "link_remove_typed": """SELECT id, source_id, target_id, link_type FROM links l WHERE NOT EXISTS
 (SELECT 1 FROM links k WHERE k.id % 50 = 0 AND k.source_id = l.source_id AND k.target_id = l.target_id AND k.link_type = l.link_type)""",
    "link_remove_both": """SELECT id, source_id, target_id, link_type FROM links l WHERE NOT EXISTS (SELECT 1 FROM links k WHERE k.id % 50 = 0
 AND (k.source_id = l.source_id AND k.target_id = l.target_id OR k.source_id = l.target_id AND k.target_id = l.source_id))""",
    "bfs_paths": f"""WITH RECURSIVE {U}, e AS (SELECT DISTINCT node, neighbor FROM u WHERE link_type = 'semantic'),
 s AS (SELECT DISTINCT source_id AS start FROM links WHERE id % 50 = 0),
 w(start, node, depth, path) AS (SELECT start, start, 0, start FROM s
   UNION ALL SELECT w.start, e.neighbor, w.depth + 1, w.path || '>' || e.neighbor FROM w JOIN e ON e.node = w.node WHERE w.depth < 3 AND NOT contains(w.path, e.neighbor))
 SELECT start, node, CAST(min(depth) AS INTEGER) AS depth, arg_min(path, (depth, path)) AS path FROM w WHERE depth > 0 GROUP BY start, node""",
    "link_clusters": LINK_GROUPS + ' SELECT "group", node FROM g',
    "cluster_strengths": LINK_GROUPS + f""" SELECT g."group", count(*) AS n_members, max(s.avg_strength) AS avg_strength FROM g LEFT JOIN (
   SELECT g."group" AS grp, CAST(sum(CAST(strength AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS avg_strength FROM links l JOIN g ON g.node = l.source_id WHERE {STRONG} GROUP BY 1) s ON s.grp = g."group" GROUP BY g."group\"""",
    "new_clusters": LINK_GROUPS + f""", {STORED}, h AS (SELECT DISTINCT cluster_id, member FROM stored),
 hn AS (SELECT cluster_id, count(*) AS n FROM h GROUP BY 1), gn AS (SELECT "group", count(*) AS n FROM g GROUP BY 1),
 bn AS (SELECT cluster_id, "group", count(*) AS n FROM h JOIN g ON g.node = h.member GROUP BY 1, 2)
 SELECT "group", n AS n_members FROM gn WHERE "group" NOT IN (SELECT bn."group" FROM bn JOIN hn ON hn.cluster_id = bn.cluster_id AND hn.n = bn.n JOIN gn x ON x."group" = bn."group" AND x.n = bn.n)""",
    "clusters_for_memory": f"WITH {STORED} SELECT member AS id, count(DISTINCT cluster_id) AS n_clusters, arg_max(cluster_id, (coalesce(avg_strength, -1.0), cluster_id)) AS cluster_id FROM stored GROUP BY member",
    "retrievability": f"WITH {MEM}, r AS (SELECT id, coalesce(stability, 1.0) AS s, {R} AS r FROM mem) SELECT id, round(r, 6) AS r, round(s * (1 + 0.3 * (1 - r)), 6) AS after FROM r",
    "stability_fold": f"""WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM (SELECT DISTINCT user_id, ts FROM events)),
 f(user_id, i, ts, s) AS (SELECT user_id, i, ts, CAST(1.0 AS DOUBLE) FROM e WHERE i = 1
   UNION ALL SELECT e.user_id, e.i, e.ts, f.s * (1 + 0.3 * (1 - {curve(days("e.ts", "f.ts"), "f.s")})) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
 SELECT user_id, CAST(max(i) AS INTEGER) AS n, round(arg_max(s, i), 6) AS stability FROM f GROUP BY user_id""",
    "prune_memories": f"""WITH {MEM}, e AS (SELECT source_id AS node FROM links UNION ALL SELECT target_id FROM links WHERE source_id <> target_id),
 d AS (SELECT node, count(*) AS n FROM e GROUP BY node), r AS (SELECT id, {R} AS r FROM mem WHERE lower(trim(type)) = 'fact' AND {days(AS_OF, "created_at")} >= 7)
 SELECT id, coalesce(n, 0) AS degree, round(r, 6) AS retrievability FROM r LEFT JOIN d ON d.node = r.id WHERE r < 0.15 AND NOT isnan(r) AND coalesce(n, 0) < 2""",
    "prune_links": f"SELECT id, source_id, target_id FROM links WHERE strength > 0 AND strength < 0.1 AND NOT isnan(strength) AND {days(AS_OF, 'created_at')} * 24 >= 24",
    "ttl_expired": f"WITH {MEM} SELECT id FROM {EXPIRED}",
    "expire_cascade": f"WITH {MEM}, x AS {EXPIRED} SELECT id, source_id, target_id FROM links WHERE source_id NOT IN (SELECT id FROM x) AND target_id NOT IN (SELECT id FROM x)",
    "trivial_rewire": f"""WITH {MEM}, gone AS (SELECT id FROM mem WHERE {TRIVIAL}), {U},
 n AS (SELECT node, neighbor, min(link_id) AS link_id, arg_min(link_type, link_id) AS link_type FROM u GROUP BY 1, 2),
 a AS (SELECT * FROM n WHERE node IN (SELECT id FROM gone) AND neighbor NOT IN (SELECT id FROM gone)),
 f AS (SELECT node, arg_min(neighbor, (link_id, neighbor)) AS hub FROM a GROUP BY node)
 SELECT DISTINCT hub AS source_id, neighbor AS target_id, link_type, 0.5 AS strength FROM a JOIN f ON f.node = a.node
 WHERE neighbor <> hub AND NOT EXISTS (SELECT 1 FROM n WHERE n.node = hub AND n.neighbor = a.neighbor)""",
    "replay_groups": f"WITH RECURSIVE {MEM}, t AS (SELECT id FROM mem WHERE lower(trim(tier)) = 'hippocampus'), "
    + groups(f"(SELECT * FROM links WHERE {STRONG} AND source_id IN (SELECT id FROM t) AND target_id IN (SELECT id FROM t))", 2)
    + ' SELECT "group", node FROM g',
    "near_dup_classes": f"""WITH RECURSIVE {MEM}, {SHINGLES}, {groups("near", 1)},
 rp AS (SELECT id, min(id) OVER (PARTITION BY c, list_sort(s)) AS rep FROM sh),
 pr AS (SELECT source_id AS a, target_id AS b FROM near WHERE source_id IN (SELECT rep FROM rp) AND target_id IN (SELECT rep FROM rp)
   UNION SELECT rep, id FROM rp WHERE rep <> id), n AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM pr UNION ALL SELECT b FROM pr) GROUP BY 1)
 SELECT g.node AS id, "group" AS class_id, n AS n_links FROM g JOIN n ON n.node = g.node""",
    "front_matter": f"""WITH {MEM}, t AS (SELECT *, {LOWER_TAGS} AS tg, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.sourceFile') END AS f FROM mem)
 SELECT CASE WHEN len(tg) > 0 THEN array_to_string(tg, '/') ELSE 'uncategorized' END || '/' || id || '.md' AS path,
  sha256('---' || chr(10) || 'id: ' || id || chr(10) || 'tags: [' || array_to_string(tg, ', ') || ']' || chr(10) || 'type: ' || coalesce(lower(trim(type)), 'fact')
   || chr(10) || '---' || chr(10) || chr(10) || coalesce(content, '')) AS text_hash FROM t WHERE f IS NULL""",
    "synthesis_inputs": f"""WITH {MEM}, {STORED}, m AS (SELECT DISTINCT s.cluster_id, s.member, coalesce(m.content, '') AS content FROM stored s JOIN mem m ON m.id = s.member),
 n AS (SELECT cluster_id, count(*) AS n FROM m GROUP BY 1 HAVING count(*) >= 2 ORDER BY cluster_id LIMIT 10),
 r AS (SELECT m.*, n.n, row_number() OVER (PARTITION BY m.cluster_id ORDER BY member) AS r FROM m JOIN n USING (cluster_id))
 SELECT cluster_id, max(n) AS n_members, 'synth_' || sha256(string_agg(member, ',' ORDER BY r)) AS new_id,
   sha256(string_agg('[' || r || '] ' || content, chr(10) || chr(10) ORDER BY r)) AS prompt_hash FROM r GROUP BY cluster_id""",
    "synthesis_links": f"""WITH {MEM}, {STORED}, s AS (SELECT DISTINCT cluster_id, member FROM stored), m AS (SELECT s.* FROM s JOIN mem ON mem.id = s.member),
 n AS (SELECT cluster_id FROM m GROUP BY 1 HAVING count(*) >= 2 ORDER BY cluster_id LIMIT 10),
 r AS (SELECT m.*, row_number() OVER (PARTITION BY cluster_id ORDER BY member) AS r FROM m),
 i AS (SELECT cluster_id, 'synth_' || sha256(string_agg(member, ',' ORDER BY r)) AS source_id FROM r WHERE cluster_id IN (SELECT cluster_id FROM n) GROUP BY 1)
 SELECT DISTINCT source_id, s.member AS target_id, 'reflection_of' AS link_type, CAST(1 AS DOUBLE) AS strength FROM i JOIN s USING (cluster_id)""",
    "shard_rotation": f"""WITH {MEM}, r AS (SELECT id, container_tag, (row_number() OVER (PARTITION BY container_tag ORDER BY created_at NULLS LAST, id) - 1) // 100 AS shard_index FROM mem)
 SELECT container_tag, shard_index, count(*) AS n, min(id) AS first_id FROM r GROUP BY 1, 2""",
    "shard_catalog": f"""WITH {MEM}, c AS (SELECT DISTINCT ON (scope, scope_hash, shard_index) * FROM shards ORDER BY scope, scope_hash, shard_index, id, created_at),
 s AS (SELECT scope, scope_hash, sum(greatest(coalesce(vector_count, 0), 0)) AS stated FROM c GROUP BY 1, 2), h AS (SELECT {SCOPE}, 1 AS x FROM mem),
 n AS (SELECT scope, scope_hash, count(*) AS held FROM h GROUP BY 1, 2)
 SELECT coalesce(s.scope, n.scope) AS scope, coalesce(s.scope_hash, n.scope_hash) AS scope_hash, CAST(coalesce(stated, 0) AS BIGINT) AS stated, coalesce(held, 0) AS held
 FROM s FULL JOIN n ON s.scope = n.scope AND s.scope_hash = n.scope_hash""",
    "active_shards": """WITH c AS (SELECT DISTINCT ON (scope, scope_hash, shard_index) * FROM shards ORDER BY scope, scope_hash, shard_index, id, created_at),
 r AS (SELECT *, row_number() OVER (PARTITION BY scope, scope_hash ORDER BY shard_index DESC, id DESC) AS r FROM c WHERE is_active)
 SELECT scope, scope_hash, shard_index, id, db_path FROM r WHERE r = 1""",
    "discovered_shards": r"""WITH n AS (SELECT id, regexp_extract(db_path, '([^/]+)$', 1) AS f FROM shards)
 SELECT DISTINCT id, regexp_extract(f, '^([^_]+)_(.+)_shard_(\d+)\.db$', 1) AS f_scope, regexp_extract(f, '^([^_]+)_(.+)_shard_(\d+)\.db$', 2) AS f_hash,
  CAST(regexp_extract(f, '^([^_]+)_(.+)_shard_(\d+)\.db$', 3) AS INTEGER) AS f_index FROM n WHERE regexp_matches(f, '^([^_]+)_(.+)_shard_(\d+)\.db$')""",
    "delete_batch": f"""WITH {MEM}, x AS (SELECT source_id AS id FROM links WHERE id % 50 = 0),
 l AS (SELECT * FROM links WHERE source_id NOT IN (SELECT id FROM x) AND target_id NOT IN (SELECT id FROM x)),
 e AS (SELECT source_id AS node FROM l UNION ALL SELECT target_id FROM l WHERE source_id <> target_id), d AS (SELECT node, count(*) AS n FROM e GROUP BY 1)
 SELECT id, container_tag, coalesce(n, 0) AS n_links FROM mem LEFT JOIN d ON d.node = mem.id WHERE id NOT IN (SELECT id FROM x)""",
    "sync_scope": f"WITH {MEM} SELECT id, {SCOPE} FROM mem",
    "sync_paths": f"""WITH {MEM}, p AS (SELECT id, list_filter(string_split(regexp_replace(project_path, '\\.md$', ''), '/'), lambda x: x <> '') AS t FROM mem WHERE project_path IS NOT NULL)
 SELECT id, array_to_string(t, ',') AS tags, CASE t[1] WHEN 'profile' THEN 'profile' WHEN 'projects' THEN 'project' WHEN 'logs' THEN 'log' WHEN 'notes' THEN 'note'
 WHEN 'scripts' THEN 'script' ELSE 'reference' END AS type FROM p""",
    "adjacent_similarity": ADJACENT + """ SELECT container_tag, count(*) AS n, round(avg(sim), 6) AS mean, round(median(sim), 6) AS median,
 round(min(sim), 6) AS least, round(max(sim), 6) AS most FROM s GROUP BY container_tag""",
    "similarity_histogram": ADJACENT + """, h AS (SELECT CAST(least(floor(sim * 10), 9) AS INTEGER) AS bucket, count(*) AS n FROM s WHERE sim >= 0 GROUP BY 1)
 SELECT CAST(b.bucket AS INTEGER) AS bucket, coalesce(n, 0) AS n FROM range(10) b(bucket) LEFT JOIN h ON h.bucket = b.bucket""",
    "workspace_top5": """WITH a AS (SELECT user_id AS session, json_extract_string(props, '$.k') AS memory, max(ts) AS added FROM events GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY added DESC, memory) AS rank FROM a)
 SELECT session, memory, epoch_us(added) AS added_us, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
    "session_activity": """WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
 n AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM l)
 SELECT user_id AS session, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) + 1800000000 AS end_us, count(*) AS n_events FROM n GROUP BY user_id, s""",
    "dedup_on_add": f"SELECT qid, id, round(sim, 6) AS sim, sim >= 0.75 AS skip FROM ({incoming(1)})",
    "auto_link_on_add": f"SELECT qid, id, round(sim, 6) AS strength FROM ({incoming(3)}) WHERE sim >= 0.5",
    "auto_link_candidates": hybrid(k=8) + f""", {U},
 c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n FROM hits h WHERE id <> qid AND similarity >= 0.499
   AND NOT EXISTS (SELECT 1 FROM u WHERE u.node = h.qid AND u.neighbor = h.id)), a AS (SELECT * FROM c WHERE n <= 3)
 SELECT qid, id, round(similarity, 6) AS strength FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.qid = a.id AND b.id = a.qid AND b.qid < a.qid)""",
    "list_page": f"""WITH {MEM} SELECT id, sha256(coalesce(content, '')) AS content_hash, coalesce(tags, '') AS tags, coalesce(tier, 'neocortex') AS tier,
 coalesce(stability, 1.0) AS stability, epoch_us(created_at) AS created_us, (SELECT count(*) FROM mem) AS total FROM mem ORDER BY created_at DESC NULLS LAST, id LIMIT 100""",
    "memory_lookup": f"""WITH {MEM}, r AS (SELECT id, (row_number() OVER (PARTITION BY container_tag ORDER BY created_at NULLS LAST, id) - 1) // 100 AS shard_index FROM mem)
 SELECT mem.id, sha256(coalesce(content, '')) AS content_hash, container_tag, {SCOPE}, shard_index FROM mem JOIN r ON r.id = mem.id
 WHERE mem.id IN (SELECT target_id FROM links WHERE id % 50 = 0)""",
    "metadata_typed": f"""WITH {MEM}, t AS (SELECT id, CASE WHEN json_valid(metadata) THEN metadata END AS j FROM mem),
 v AS (SELECT id, json_extract_string(j, '$.sessionID') AS s, json_extract_string(j, '$.sourceFile') AS f, json_extract_string(j, '$.turn') AS t FROM t)
 SELECT id, s AS "sessionID", f AS "sourceFile", TRY_CAST(t AS INTEGER) AS turn FROM v WHERE s IS NOT NULL OR f IS NOT NULL OR t IS NOT NULL""",
    "vector_dimensions": "SELECT container_tag, CAST(len(vector) AS INTEGER) AS dimensions, count(DISTINCT id) AS n FROM memories WHERE vector IS NOT NULL AND len(vector) <> 96 GROUP BY 1, 2",
    "stability_write_back": f"""WITH {MEM}, x AS (SELECT source_id AS id FROM links WHERE id % 50 = 0), r AS (SELECT *, {R} AS r FROM mem)
 SELECT id, round(CASE WHEN id IN (SELECT id FROM x) THEN coalesce(stability, 1.0) * (1 + 0.3 * (1 - r)) ELSE stability END, 6) AS stability,
  epoch_us(CASE WHEN id IN (SELECT id FROM x) THEN {AS_OF} ELSE last_accessed_at END) AS accessed_us FROM r""",
    "slice_means": ADJACENT.replace("SELECT container_tag, list_dot", "SELECT container_tag, row_number() OVER (PARTITION BY container_tag ORDER BY created_at, id) AS k, list_dot") + """,
 m AS (SELECT container_tag, CASE WHEN k <= 4 THEN 'first' WHEN k BETWEEN 6 AND 8 THEN 'second' WHEN k BETWEEN 10 AND 12 THEN 'third' END AS slice, avg(sim) AS mean
   FROM s WHERE k <= 4 OR k BETWEEN 6 AND 8 OR k BETWEEN 10 AND 12 GROUP BY 1, 2)
 SELECT container_tag, slice, round(mean, 6) AS mean, round(greatest(0.1, floor((min(mean) OVER (PARTITION BY container_tag) - 0.1) * 100 + 0.5) / 100), 6) AS threshold FROM m""",
}

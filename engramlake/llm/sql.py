"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

TOKENS = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+'))"

MEMORIES = "SELECT DISTINCT ON (id) id, content, vector FROM memories WHERE id IS NOT NULL"
BOTH = """
SELECT DISTINCT ON (id) id, content, vector, -1 AS ord FROM memories WHERE id IS NOT NULL
UNION ALL SELECT * FROM (SELECT DISTINCT ON (incoming_id) incoming_id, content, vector, seq FROM incoming ORDER BY incoming_id, seq)"""
#: records by id, with hashed distinct words and the vector in double precision where usable.
RECORDS = r"""
m AS ({rows}),
f AS (
  SELECT id, list_distinct(regexp_extract_all(lower(coalesce(content, '')), '[\p{L}\p{N}]+')) AS w,
    CASE WHEN len(vector) = 96 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(vector, lambda x: x <> 0)) > 0 THEN CAST(vector AS DOUBLE[]) END AS v
  FROM m),
u AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM f WHERE v IS NOT NULL),
wd AS (SELECT id, len(w) AS k, unnest(w) AS t FROM f WHERE len(w) >= 8),
alike AS (
  SELECT a.id AS x, b.id AS y FROM u a JOIN u b ON a.id < b.id
  WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.985
  UNION
  SELECT a.id, b.id FROM wd a JOIN wd b ON a.t = b.t AND a.id < b.id
  GROUP BY a.id, b.id, a.k, b.k HAVING count(*) >= 0.7 * (a.k + b.k - count(*)) - 1e-9)"""



def _near(field: str, dim: int) -> str:
    return f"""
SELECT least(x, y) AS memory_id_a, greatest(x, y) AS memory_id_b, '{field}' AS vec_field FROM (
  SELECT a.id AS x, b.id AS y, list_dot_product(a.v, b.v) / (a.n * b.n) AS c,
    row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.v, b.v) / (a.n * b.n) DESC, b.id) AS r
  FROM {field}_u a JOIN {field}_u b ON a.id <> b.id) WHERE r <= 5 AND c >= 0.96"""


def _usable(field: str, dim: int) -> str:
    return f"""{field}_u AS (
  SELECT id, CAST({field} AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST({field} AS DOUBLE[]), CAST({field} AS DOUBLE[]))) AS n
  FROM (SELECT DISTINCT ON (id) id, {field} FROM memories WHERE id IS NOT NULL)
  WHERE len({field}) = {dim} AND len(list_filter({field}, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter({field}, lambda x: x <> 0)) > 0)"""


def _current(field: str) -> str:
    """CTEs that end with current(group_id, value, n_rows, dated)."""
    return f"""
m_{field} AS (SELECT DISTINCT g.group_id, g.memory_id, lower(trim(m.{field})) AS value,
    CASE WHEN m.updated_at <= TIMESTAMPTZ '2026-03-01 00:00:00+00' THEN m.updated_at END AS held_at
  FROM merge_groups g JOIN memories m ON m.id = g.memory_id WHERE g.group_id IS NOT NULL AND length(trim(m.{field})) > 0),
h_{field} AS (SELECT group_id, value, min(held_at) AS first_at, max(held_at) AS last_at, count(*) AS n_rows FROM m_{field} GROUP BY 1, 2),
s_{field} AS (SELECT value AS a, last_at, lead(value) OVER w AS b, lead(first_at) OVER w AS next_at FROM h_{field} WHERE first_at IS NOT NULL
  WINDOW w AS (PARTITION BY group_id ORDER BY first_at, last_at, value)),
p_{field} AS (SELECT a, b, count(*) AS n FROM s_{field} WHERE last_at < next_at GROUP BY 1, 2),
d_{field} AS (SELECT p.a, p.b FROM p_{field} p LEFT JOIN p_{field} q ON q.a = p.b AND q.b = p.a WHERE q.n IS NULL OR p.n > q.n),
r_{field}(a, b) AS (SELECT a, b FROM d_{field} UNION SELECT r.a, d.b FROM r_{field} r JOIN d_{field} d ON d.a = r.b),
o_{field} AS (SELECT a, b FROM r_{field} x WHERE NOT EXISTS (SELECT 1 FROM r_{field} y WHERE y.a = x.b AND y.b = x.a)),
l_{field} AS (SELECT DISTINCT h.group_id, h.value FROM h_{field} h JOIN o_{field} o ON o.a = h.value
  JOIN h_{field} z ON z.group_id = h.group_id AND z.value = o.b WHERE h.last_at IS NULL OR z.last_at IS NULL),
t_{field} AS (SELECT h.*, h.last_at IS NOT NULL AS dated, (h.group_id, h.value) IN (SELECT (group_id, value) FROM l_{field})
    OR coalesce(last_at < max(last_at) OVER (PARTITION BY h.group_id), false) AS followed FROM h_{field} h),
current_{field} AS (SELECT group_id, value, n_rows, dated FROM (SELECT *, row_number() OVER
  (PARTITION BY group_id ORDER BY followed, NOT dated, last_at DESC, n_rows DESC, value) AS k FROM t_{field}) WHERE k = 1)"""


PACKED = rf"""
WITH d AS (SELECT doc_id, {TOKENS} AS n FROM documents),
p AS (SELECT doc_id, k AS piece_no, k * 512 AS first_token, least(n - k * 512, 512) AS n_tokens
  FROM (SELECT doc_id, n, unnest(range(0, greatest((n + 511) // 512, 1))) AS k FROM d)),
c AS (SELECT *, 512 // greatest(n_tokens, 1) AS class FROM p),
d32 AS (SELECT *, CASE WHEN class = 1 THEN (512 - n_tokens) * 32 // 512 ELSE (n_tokens * 32 + 511) // 512 END AS band FROM c),
q AS (SELECT *, count(*) FILTER (WHERE class = 1) OVER (PARTITION BY band) AS rooms,
  row_number() OVER (PARTITION BY band, class = 1 ORDER BY n_tokens DESC, doc_id, piece_no) - 1 AS pair FROM d32),
s AS (SELECT *, class > 1 AND pair < rooms AS beside, CASE WHEN pair < rooms THEN 1 ELSE class END AS slots FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY slots, beside ORDER BY n_tokens, doc_id, piece_no) - 1 AS r,
  count(*) OVER (PARTITION BY slots, beside) AS m FROM s),
packed AS (SELECT doc_id, CAST(piece_no AS INTEGER) AS piece_no, first_token, n_tokens,
  CASE WHEN slots = 1 THEN '1-0-' || band || '-' || pair
    ELSE slots || '-0-' || (CASE WHEN r * 2 < m THEN r * 2 ELSE (m - 1 - r) * 2 + 1 END // slots) END AS container_id,
  CAST(slots AS BIGINT) AS slots, beside FROM r)"""


def _mixed() -> str:
    """CTEs that end with mixed(source, doc_id, repeat_no, n_tokens, position), in the queries' curriculum."""
    from .queries import CURRICULUM

    rows = []
    for s, knots in CURRICULUM.items():
        area = 0.0
        whole = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            more = (t1 - t0) * (w0 + w1) / 2 / whole
            rows.append(f"('{s}', {t0!r}::DOUBLE, {w0 / whole!r}::DOUBLE, {(w1 - w0) / (t1 - t0) / whole!r}::DOUBLE, {area!r}::DOUBLE, {area + more!r}::DOUBLE)")
            area += more
    return f"""
d AS (SELECT doc_id, lower(trim(source)) AS source, {TOKENS} AS n FROM documents),
z AS (SELECT source, sum(n) AS st FROM d GROUP BY 1), a AS (SELECT sum(n) AS n FROM d),
w AS (SELECT lower(trim(source)) AS source, sum(coalesce(target_share, 0.0)) AS target_share, max(greatest(coalesce(max_repeats, 1), 0)) AS repeats
  FROM mix_targets WHERE source IS NOT NULL GROUP BY 1),
pl AS (SELECT w.source, target_share, repeats, coalesce(st, 0) AS st, target_share * CAST(a.n AS DOUBLE) AS demand, repeats * coalesce(st, 0) AS supply
  FROM w CROSS JOIN a LEFT JOIN z ON z.source = w.source),
o AS (SELECT d.source, d.doc_id, d.n, pl.st, pl.demand, pl.supply, CAST(least(pl.repeats, ceil(pl.demand / pl.st)) AS BIGINT) AS laps,
    sum(d.n) OVER (PARTITION BY d.source ORDER BY md5('0:' || d.doc_id), d.doc_id) - d.n AS before
  FROM d JOIN pl ON pl.source = d.source WHERE d.n > 0 AND pl.demand > 0 AND pl.supply > 0),
e AS (SELECT *, lap * st + before AS start FROM (SELECT *, unnest(range(0, laps)) AS lap FROM o)),
u AS (SELECT *, start / least(demand, CAST(supply AS DOUBLE)) AS u FROM e WHERE start < demand),
seg(s, t0, w0, slope, a0, a1) AS (VALUES {", ".join(rows)}),
y AS (SELECT u.*, seg.*, sqrt(greatest(w0 * w0 + 2 * slope * (u.u - a0), 0.0)) AS root FROM u LEFT JOIN seg ON seg.s = u.source AND u.u >= a0 AND u.u < a1),
mixed AS (SELECT source, doc_id, lap AS repeat_no, n AS n_tokens,
  CASE WHEN s IS NULL THEN u ELSE t0 + CASE WHEN w0 + root > 0 THEN 2 * (u - a0) / (w0 + root) ELSE 0.0 END END AS position FROM y)"""


CURRENT = ", ".join(f"{c}" for c in (_current("type"), _current("tier")))
SURVIVORS = """
mm AS (
  SELECT DISTINCT g.group_id, g.memory_id, coalesce(m.is_pinned, false) AS pin,
    CASE WHEN m.updated_at <= TIMESTAMPTZ '2026-03-01 00:00:00+00' THEN m.updated_at END AS upd,
    coalesce(m.stability, 1.0) AS stab, m.display_name
  FROM merge_groups g JOIN memories m ON m.id = g.memory_id),
rr AS (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY pin DESC, upd DESC NULLS LAST, stab DESC, memory_id) AS rn,
    count(*) OVER (PARTITION BY group_id) AS n FROM mm),
sv AS (SELECT group_id, max(CASE WHEN rn = 1 THEN memory_id END) AS survivor_id,
  coalesce(arg_min(memory_id, rn) FILTER (WHERE length(trim(display_name)) > 0), '') AS display_from_id
FROM rr WHERE n >= 2 GROUP BY group_id)"""


def oracles() -> dict[str, str]:
    """SQL by query; that of the mix takes the curriculum from the queries."""
    return ORACLES | {
        "p8_mix": f"WITH {_mixed()} SELECT source, doc_id, repeat_no, n_tokens, round(position, 6) AS position FROM mixed",
        "p8_shares": f"""WITH {_mixed()}, g AS (SELECT source, sum(n_tokens) AS mixed_tokens, count(*) AS docs, max(repeat_no) + 1 AS most_repeats,
  sum(position * n_tokens) / sum(n_tokens) AS mean_position FROM mixed GROUP BY 1), al AS (SELECT sum(mixed_tokens) AS n FROM g)
SELECT pl.source, round(target_share, 6) AS target_share, round(CASE WHEN al.n > 0 THEN coalesce(mixed_tokens, 0) / al.n ELSE 0.0 END, 6) AS actual_share,
  round(demand, 6) AS demand, CAST(coalesce(mixed_tokens, 0) AS BIGINT) AS mixed_tokens, coalesce(docs, 0) AS docs, coalesce(most_repeats, 0) AS most_repeats,
  round(mean_position, 6) AS mean_position, coalesce(mixed_tokens, 0) < demand AS short
FROM pl CROSS JOIN al LEFT JOIN g ON g.source = pl.source""",
    }


ORACLES = {
    "p5_current_type": f"WITH RECURSIVE {_current('type')} SELECT * FROM current_type",
    "p5_current_tier": f"WITH RECURSIVE {_current('tier')} SELECT * FROM current_tier",
    "p5_records": f"""WITH RECURSIVE {CURRENT}, {SURVIVORS} SELECT sv.*, a.value AS "type", b.value AS tier FROM sv
LEFT JOIN current_type a ON a.group_id = sv.group_id LEFT JOIN current_tier b ON b.group_id = sv.group_id""",
    "p7_containers": PACKED + " SELECT * FROM packed",
    "p7_fill": PACKED + """, b AS (SELECT slots, container_id, count(*) AS items, sum(n_tokens) AS tokens FROM packed GROUP BY 1, 2)
SELECT slots, count(*) AS containers, CAST(sum(items) AS BIGINT) AS items, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) / (count(*) * 512), 6) AS fill FROM b GROUP BY slots""",
    "p6_summary": f"""
WITH {_usable("vector", 96)},
e AS (SELECT a.id AS x, b.id AS y FROM vector_u a JOIN vector_u b ON list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.65 OR a.id = b.id),
g AS (SELECT x, count(*) AS n, min(y) AS group_id, list_sort(list(y)) AS l FROM e GROUP BY x),
c AS (SELECT l FROM g GROUP BY l, n HAVING n >= 20 AND count(*) = n),
m AS (SELECT x AS id, group_id, g.n, list_transform(v, lambda z: z / u.n) AS v FROM g JOIN vector_u u ON u.id = g.x WHERE l IN (SELECT l FROM c)),
k AS (SELECT a.group_id, a.id, a.n, sum(list_dot_product(a.v, b.v)) AS s FROM m a JOIN m b ON b.group_id = a.group_id GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY s DESC, id) AS r FROM k)
SELECT group_id, n AS n_members, round((sum(s) - n) / (n * (n - 1)), 3) AS avg_cosine, string_agg(id, ',' ORDER BY r) FILTER (WHERE r <= 3) AS medoids FROM r GROUP BY group_id, n""",
    "p3_found": f"WITH {_usable('vector', 96)}, {_usable('tags_vector', 32)} {_near('vector', 96)} UNION {_near('tags_vector', 32)}",
    "p2_found": "WITH " + RECORDS.replace("{rows}", BOTH) + """
SELECT DISTINCT CASE WHEN sa.ord > sb.ord THEN x ELSE y END AS incoming_id
FROM alike JOIN m sa ON sa.id = x JOIN m sb ON sb.id = y WHERE sa.ord <> sb.ord""",
    "p4_found": "WITH " + RECORDS.replace("{rows}", MEMORIES) + " SELECT x AS memory_id_a, y AS memory_id_b FROM alike",
    "p1_found": """
WITH RECURSIVE ids AS (SELECT DISTINCT id FROM memories),
e AS (
  SELECT DISTINCT source_id AS a, target_id AS b FROM links
  WHERE lower(trim(link_type)) = 'semantic' AND strength >= 0.5 AND NOT isnan(strength) AND source_id <> target_id
    AND source_id IN (SELECT id FROM ids) AND target_id IN (SELECT id FROM ids)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(memory_id, reached) AS (SELECT DISTINCT a, a FROM u UNION SELECT r.memory_id, u.b FROM r JOIN u ON u.a = r.reached)
SELECT memory_id, min(reached) AS group_id FROM r GROUP BY memory_id""",
    "p5_found": """
WITH m AS (
  SELECT DISTINCT g.group_id, g.memory_id, coalesce(m.is_pinned, false) AS pin,
    CASE WHEN m.updated_at <= TIMESTAMPTZ '2026-03-01 00:00:00+00' THEN m.updated_at END AS upd,
    coalesce(m.stability, 1.0) AS stab, m.display_name
  FROM merge_groups g JOIN memories m ON m.id = g.memory_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY pin DESC, upd DESC NULLS LAST, stab DESC, memory_id) AS rn,
    count(*) OVER (PARTITION BY group_id) AS n FROM m)
SELECT group_id, max(CASE WHEN rn = 1 THEN memory_id END) AS survivor_id,
  coalesce(arg_min(memory_id, rn) FILTER (WHERE length(trim(display_name)) > 0), '') AS display_from_id
FROM r WHERE n >= 2 GROUP BY group_id""",
    "p6_found": f"""
WITH {_usable("vector", 96)},
e AS (SELECT a.id AS x, b.id AS y FROM vector_u a JOIN vector_u b ON list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.65 OR a.id = b.id),
g AS (SELECT x, count(*) AS n, min(y) AS group_id, list_sort(list(y)) AS l FROM e GROUP BY x),
c AS (SELECT l FROM g GROUP BY l, n HAVING n >= 20 AND count(*) = n)
SELECT x AS memory_id, group_id FROM g WHERE l IN (SELECT l FROM c)""",
    "p7_found": f"SELECT doc_id FROM documents WHERE {TOKENS} > 512",
    "p8_found": f"""
WITH t AS (SELECT lower(trim(source)) AS source, sum({TOKENS}) AS n FROM documents GROUP BY 1),
a AS (SELECT sum(n) AS n FROM t)
SELECT lower(trim(m.source)) AS source FROM mix_targets m CROSS JOIN a LEFT JOIN t ON t.source = lower(trim(m.source))
WHERE coalesce(m.max_repeats, 1) * coalesce(t.n, 0) < m.target_share * a.n""",
}

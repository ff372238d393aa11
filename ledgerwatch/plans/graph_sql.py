"""SQL of the graph analytics over the whole ledger: components, communities, neighbourhoods, PageRank and betweenness."""

from __future__ import annotations

from .prelude import rounded as r

COMPONENTS = """links AS (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach AS (SELECT a AS id, a AS other FROM links UNION SELECT reach.id, b FROM reach JOIN links ON a = reach.other),
comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""

COMMUNITIES = """close AS (SELECT * FROM (
  SELECT *, least(1.0::DOUBLE, 2 * density + coalesce(fast, 0) / CAST(txns AS DOUBLE)) AS score FROM (
    SELECT c.component, size, links / CAST(size * (size - 1) AS DOUBLE) AS density, txns, CAST(fast AS DOUBLE) AS fast
    FROM (SELECT component, count(*) AS size FROM comp GROUP BY 1) c
    JOIN (SELECT component, count(*) AS links FROM edges JOIN comp ON id = src WHERE src <> dst GROUP BY 1) l USING (component)
    JOIN (SELECT component, count(*) AS txns FROM ledger JOIN comp ON id = src GROUP BY 1) t USING (component)
    LEFT JOIN (SELECT component, count(*) AS fast FROM ledger a JOIN ledger b ON b.dst = a.src AND abs(a.ms - b.ms) < 3600000 JOIN comp ON id = a.src GROUP BY 1) f USING (component) WHERE size >= 3)) WHERE score > 0.3)"""

HOOD = f"""
u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS ways FROM edges WHERE src <> dst GROUP BY 1, 2),
nb AS (SELECT a AS id, b AS x FROM u UNION ALL SELECT b, a FROM u),
tri AS (SELECT p.id, count(*) AS t, sum(u.ways) AS directed FROM nb p JOIN nb q ON p.id = q.id AND p.x < q.x JOIN u ON u.a = p.x AND u.b = q.x GROUP BY p.id),
hood AS (SELECT k.id, k, {r('CASE WHEN k >= 2 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END', 2)} AS clustering, {r('CASE WHEN k >= 2 THEN CAST(coalesce(directed, 0) AS DOUBLE) / (k * (k - 1)) ELSE 0 END', 3)} AS ego
  FROM (SELECT id, count(*) AS k FROM nb GROUP BY id) k LEFT JOIN tri ON tri.id = k.id)"""

PAGERANK_START = """w AS (SELECT id, coalesce(o, 0) AS o, CASE WHEN o > 0 THEN (1.0::DOUBLE / o) * (1 + 2 * share) END AS weight, least(1.0::DOUBLE, (coalesce(i, 0) + coalesce(o, 0) + 100 * c) / 20) AS seed FROM (
  SELECT a.id, o, i, share, CASE WHEN n > 1 THEN least(1.0::DOUBLE, (coalesce(i, 0) + coalesce(o, 0)) / (n * 0.5::DOUBLE)) ELSE 0 END AS c, n FROM accounts a
  LEFT JOIN (SELECT src AS id, count(*) AS o, CAST(sum(n_flagged) AS DOUBLE) / sum(n_txn) AS share FROM edges GROUP BY 1) x ON x.id = a.id
  LEFT JOIN (SELECT dst AS id, count(*) AS i FROM edges GROUP BY 1) y ON y.id = a.id, (SELECT count(*) AS n FROM accounts) z)),
p0 AS (SELECT id, seed / (SELECT sum(seed) FROM w) AS score FROM w)"""
PAGERANK = PAGERANK_START + "".join(
    f""",
p{k} AS MATERIALIZED (SELECT w.id, 0.85 * coalesce(s, 0) + (1 - 0.85::DOUBLE) / (SELECT count(*) FROM accounts) + 0.3 * seed AS score FROM w LEFT JOIN (
  SELECT dst AS id, sum(score * weight) AS s FROM edges JOIN p{k - 1} p ON p.id = src JOIN w ON w.id = src GROUP BY 1) x ON x.id = w.id)"""
    for k in range(1, 21)
)
RANK = PAGERANK + """,
rank AS (SELECT id, CASE WHEN high > low THEN (score - low) / (high - low) ELSE 0 END AS pagerank FROM p20, (SELECT min(score) AS low, max(score) AS high FROM p20))"""


def _betweenness(levels: int = 8, sources: int | None = 30) -> str:
    """Paths from the sources level by level, and what their nodes carry back; no shortest path of the given tables is longer than that."""
    parts = ["e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst)", "nodes AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"]
    parts.append(f"l0 AS MATERIALIZED (SELECT id AS source, id AS node, 1.0::DOUBLE AS paths FROM nodes{f' ORDER BY md5(id), id LIMIT {sources}' if sources else ''})")
    for k in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT source, node FROM l{j}" for j in range(k))
        parts.append(f"l{k} AS MATERIALIZED (SELECT g.* FROM (SELECT source, e.dst AS node, sum(paths) AS paths FROM l{k - 1} JOIN e ON e.src = node GROUP BY 1, 2) g LEFT JOIN ({seen}) s ON s.source = g.source AND s.node = g.node WHERE s.node IS NULL)")
    parts.append(f"c{levels} AS (SELECT *, 0.0::DOUBLE AS carried FROM l{levels})")
    for k in range(levels - 1, -1, -1):
        parts.append(f"""c{k} AS MATERIALIZED (SELECT l.source, l.node, l.paths, coalesce(sum((1 + n.carried) / n.paths * l.paths), 0) AS carried
  FROM l{k} l LEFT JOIN e ON e.src = l.node LEFT JOIN c{k + 1} n ON n.source = l.source AND n.node = e.dst GROUP BY 1, 2, 3)""")
    every = " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(levels + 1))
    parts.append(f"between_raw AS (SELECT id, coalesce(b, 0) AS b FROM nodes LEFT JOIN (SELECT node, sum(carried) AS b FROM ({every}) WHERE source <> node GROUP BY node) ON node = id)")
    parts.append("between_ AS (SELECT id, b / greatest(1.0::DOUBLE, (SELECT max(b) FROM between_raw)) AS bridge FROM between_raw)")
    return ",\n".join(parts)


BETWEENNESS = _betweenness()
EXACT_BETWEENNESS = _betweenness(sources=None)

"""Queries of the general data problems: increments (p2) and hierarchies (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.hierarchy import close_hierarchy, descendants, links_of_graph
from graphloom.operators.incremental import replay_runs
from graphloom.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that each successful run had to process."""
    return replay_runs(table(spark, d, "file_hashes"), table(spark, d, "index_runs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every member of the three hierarchies."""
    return close_hierarchy(links_of_graph(table(spark, d, "edges"), table(spark, d, "ts_symbols")))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path from the root and number of descendants of every member; cyclic members have neither path nor descendants."""
    closed = close_hierarchy(links_of_graph(table(spark, d, "edges"), table(spark, d, "ts_symbols")), with_path=True)
    below = descendants(closed).groupBy("link", F.col("ancestor_id").alias("node_id")).agg(F.count("*").alias("n_descendants"))
    return closed.join(below, ["link", "node_id"], "left").select(
        "link", "node_id", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), F.coalesce("n_descendants", F.lit(0)).cast("bigint").alias("n_descendants")
    )


_LINKS = """
links AS (
  SELECT DISTINCT type AS link, CASE WHEN type = 'CONTAINS' THEN source_id ELSE target_id END AS parent,
         CASE WHEN type = 'CONTAINS' THEN target_id ELSE source_id END AS child
  FROM edges WHERE type IN ('CONTAINS', 'INHERITS') AND source_id IS NOT NULL AND target_id IS NOT NULL
  UNION
  SELECT 'PARENT_NAME', p.symbol_id, c.symbol_id FROM ts_symbols c JOIN ts_symbols p
  ON c.project = p.project AND c.file_path = p.file_path AND c.parent_name = p.name AND p.label NOT IN ('Function', 'Method')
),
up AS (SELECT link, child, min(parent) AS parent FROM links GROUP BY link, child),
ids AS (SELECT link, parent AS id FROM links UNION SELECT link, child FROM links),
walk AS (
  SELECT i.link, i.id AS node_id, i.id AS root_id, 0::BIGINT AS depth, i.id::VARCHAR AS path
  FROM ids i ANTI JOIN up u ON i.link = u.link AND i.id = u.child
  UNION ALL
  SELECT w.link, u.child, w.root_id, w.depth + 1, w.path || '/' || u.child::VARCHAR
  FROM walk w JOIN up u ON u.link = w.link AND u.parent = w.node_id
),
lost AS (SELECT i.link, i.id, u.parent FROM ids i JOIN up u ON i.link = u.link AND i.id = u.child
         ANTI JOIN walk w ON w.link = i.link AND w.node_id = i.id),
follow AS (
  SELECT link, id, parent AS pos FROM lost
  UNION
  SELECT f.link, f.id, l.parent FROM follow f JOIN lost l ON l.link = f.link AND l.id = f.pos
),
cyclic AS (SELECT link, id FROM follow WHERE id = pos),
looped AS (SELECT l.link, l.id AS node_id, min(x.id) AS root_id
  FROM lost l JOIN (SELECT link, id, id AS pos FROM lost UNION SELECT link, id, pos FROM follow) f ON f.link = l.link AND f.id = l.id
  JOIN cyclic x ON x.link = f.link AND x.id = f.pos GROUP BY l.link, l.id)
"""

QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_paths": p3_paths}

ORACLES = {
    "p2_found": """
WITH runs AS (
  SELECT run_id, project, scan_id, lag(scan_id) OVER (PARTITION BY project ORDER BY run_id) AS before
  FROM (SELECT DISTINCT run_id, project, scan_id FROM index_runs WHERE status = 'success')
),
points AS (SELECT run_id, project, scan_id, 'now' AS which FROM runs
           UNION ALL SELECT run_id, project, before, 'then' FROM runs WHERE before IS NOT NULL),
states AS (
  SELECT p.run_id, p.which, f.project, f.rel_path,
         arg_max(CASE WHEN coalesce(f.is_deleted, false) THEN NULL ELSE coalesce(lower(f.sha256), '') END, f.observed_at) AS v,
         arg_max(coalesce(f.is_deleted, false), f.observed_at) AS gone
  FROM points p JOIN file_hashes f ON f.project = p.project AND f.scan_id <= p.scan_id GROUP BY ALL
),
present AS (SELECT run_id, which, project, rel_path, v FROM states WHERE NOT gone)
SELECT DISTINCT run_id, project, rel_path FROM (
  SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.project, b.project) AS project, coalesce(a.rel_path, b.rel_path) AS rel_path, a.v AS va, b.v AS vb
  FROM (SELECT * FROM present WHERE which = 'now') a FULL JOIN (SELECT * FROM present WHERE which = 'then') b
  ON a.run_id = b.run_id AND a.project = b.project AND a.rel_path = b.rel_path)
WHERE va IS DISTINCT FROM vb
""",
    "p3_found": f"""
WITH RECURSIVE {_LINKS}
SELECT link, node_id, root_id, depth FROM walk UNION ALL SELECT link, node_id, root_id, -1 FROM looped
""",
    "p3_paths": f"""
WITH RECURSIVE {_LINKS},
anc AS (
  SELECT u.link, u.child AS node_id, u.parent AS a FROM up u SEMI JOIN walk w ON w.link = u.link AND w.node_id = u.child
  UNION ALL
  SELECT n.link, n.node_id, u.parent FROM anc n JOIN up u ON u.link = n.link AND u.child = n.a
),
below AS (SELECT link, a AS node_id, count(*) AS n FROM anc GROUP BY ALL)
SELECT x.link, x.node_id, x.path, coalesce(b.n, 0) AS n_descendants
FROM (SELECT link, node_id, path FROM walk UNION ALL SELECT link, node_id, NULL FROM looped) x
LEFT JOIN below b ON b.link = x.link AND b.node_id = x.node_id
""",
}

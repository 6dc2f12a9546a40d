"""Queries over the ontology's parent links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import hierarchy
from ..registry import query
from ..runtime import table

LINKS = """
c AS (SELECT DISTINCT lower(trim(id)) AS k, id FROM concepts WHERE trim(id) <> ''),
e AS (SELECT DISTINCT x.k AS child, x.p AS parent
      FROM (SELECT lower(trim(id)) AS k, lower(trim(unnest(parents))) AS p FROM concepts) x
      WHERE x.p IN (SELECT k FROM c) AND x.k IN (SELECT k FROM c)),
up(node, ancestor) AS (SELECT child, parent FROM e UNION SELECT up.node, e.parent FROM up JOIN e ON up.ancestor = e.child),
loops AS (SELECT node FROM up WHERE node = ancestor),
roots AS (SELECT k FROM c WHERE k NOT IN (SELECT child FROM e)),
"""


@query(
    f"""WITH RECURSIVE {LINKS}
walk(node, root, d) AS (
  SELECT k, k, 0 FROM roots
  UNION SELECT e.child, walk.root, walk.d + 1 FROM walk JOIN e ON e.parent = walk.node WHERE walk.d < (SELECT count(*) FROM c)),
best AS (SELECT node, root, min(d) AS d FROM walk GROUP BY node, root)
SELECT a.id, b.id AS root_id, CAST(best.d AS INTEGER) AS depth FROM best JOIN c a ON a.k = best.node JOIN c b ON b.k = best.root
UNION ALL SELECT c.id, 'cycle', -1 FROM c WHERE k IN (SELECT node FROM loops)
UNION ALL SELECT c.id, 'none', -1 FROM c WHERE k NOT IN (SELECT node FROM loops) AND k NOT IN (SELECT node FROM best)"""
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Roots with depths of every concept, and the concepts on loops."""
    return hierarchy.hierarchy(table(spark, d, "concepts"))


@query(
    f"""WITH RECURSIVE {LINKS}
walk(node, root, d) AS (
  SELECT k, k, 0 FROM roots
  UNION SELECT e.child, walk.root, walk.d + 1 FROM walk JOIN e ON e.parent = walk.node WHERE walk.d < (SELECT count(*) FROM c)),
best AS (SELECT node, root, min(d) AS d FROM walk GROUP BY node, root),
pick AS (SELECT b.node, b.root, b.d, min(e.parent) AS parent FROM best b JOIN e ON e.child = b.node
         JOIN best p ON p.node = e.parent AND p.root = b.root AND p.d = b.d - 1 GROUP BY b.node, b.root, b.d),
way(node, root, d, path) AS (
  SELECT node, root, d, node FROM best WHERE d = 0
  UNION ALL SELECT pick.node, pick.root, pick.d, way.path || ' > ' || pick.node FROM way JOIN pick ON pick.parent = way.node AND pick.root = way.root)
SELECT a.id, b.id AS root_id, CAST(way.d AS INTEGER) AS depth, way.path FROM way JOIN c a ON a.k = way.node JOIN c b ON b.k = way.root"""
)
def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """The shortest path of every concept from each root above it."""
    return hierarchy.paths(table(spark, d, "concepts"))


@query(
    f"""WITH RECURSIVE {LINKS}
down(node, ancestor, d) AS (
  SELECT child, parent, 1 FROM e WHERE child <> parent
  UNION SELECT down.node, e.parent, down.d + 1 FROM down JOIN e ON e.child = down.ancestor WHERE down.d < (SELECT count(*) FROM c))
SELECT a.id, x.id AS descendant_id, CAST(min(down.d) AS INTEGER) AS depth
FROM down JOIN c a ON a.k = down.ancestor JOIN c x ON x.k = down.node WHERE down.node <> down.ancestor GROUP BY a.id, x.id"""
)
def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every concept with their least distance."""
    return hierarchy.descendants(table(spark, d, "concepts"))

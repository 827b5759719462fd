"""All core queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import hierarchy
from graphloom.plans import build, documents, graphs, more, search, strategies, queries as _queries  # noqa: F401  (they register)
from graphloom.plans.registry import QUERIES, SQL
from graphloom.session import table

FLAGSHIP = "hier_flat_search"
_BLANKS = "' ' || chr(9) || chr(13) || chr(10) || chr(11) || chr(12) || chr(160) || chr(8203) || chr(65279)"
_KEY = f"nullif(lower(trim({{}}, {_BLANKS})), '')"
_LINKS = f"""st AS (SELECT {_KEY.format("node_id")} AS node, node_id, {_KEY.format("parent")} AS parent, updated_at FROM node_state),
  lt AS (SELECT * FROM st WHERE node IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node ORDER BY updated_at DESC NULLS LAST, parent NULLS LAST, node_id) = 1),
  cl AS (SELECT {_KEY.format("community_id")} AS community, {_KEY.format("child")} AS node FROM (SELECT community_id, unnest(members) AS child FROM communities UNION ALL SELECT community_id, unnest(sub_communities) FROM communities)),
  cm AS (SELECT node, min(community) AS listed FROM cl WHERE community IN (SELECT node FROM lt) GROUP BY 1),
  links AS MATERIALIZED (SELECT lt.node, lt.node_id, CASE WHEN lt.parent IN (SELECT node FROM lt) THEN lt.parent ELSE cm.listed END AS parent FROM lt LEFT JOIN cm USING (node)),
  up AS (SELECT node, node AS anc, 0 AS steps FROM links UNION SELECT up.node, links.parent, up.steps + 1 FROM up JOIN links ON links.node = up.anc WHERE links.parent IS NOT NULL AND up.steps < 60)"""
P1_SQL = {
    "p1_found": f"""WITH RECURSIVE {_LINKS}, top AS (SELECT node, max(steps) AS depth, max_by(anc, steps) AS root, bool_or(anc = node AND steps > 0) AS circle FROM up GROUP BY 1)
      SELECT l.node_id, CASE WHEN depth < 60 THEN r.node_id ELSE '' END AS root_id, CASE WHEN depth < 60 THEN CAST(depth AS INTEGER) ELSE -1 END AS depth, CASE WHEN circle THEN 'cycle' WHEN depth < 60 THEN 'tree' ELSE 'below_cycle' END AS state
      FROM top JOIN links l USING (node) JOIN links r ON r.node = top.root""",
    "p1_descendants": f"""WITH RECURSIVE {_LINKS}, deep AS (SELECT node FROM up WHERE steps = 60) SELECT anc AS ancestor, node AS descendant, CAST(steps AS INTEGER) AS distance FROM up WHERE steps > 0 AND node NOT IN (SELECT node FROM deep)""",
}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.found_hierarchy(table(spark, sf_dir, "node_state"), table(spark, sf_dir, "communities"))


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = hierarchy.resolve_parents(table(spark, sf_dir, "node_state"), table(spark, sf_dir, "communities"))
    return hierarchy.descendants(hierarchy.hierarchy(links.select("node", "parent")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_descendants)} | QUERIES


def oracle_sql() -> dict[str, str]:
    return P1_SQL | SQL

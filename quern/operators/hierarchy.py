"""Full hierarchies from parent-child rows by tree contraction (problem 6).

Each round first splices out an independent set of unary nodes (one child, and a
hash larger than that of parent and child), so that chains shrink by about a third,
then rakes all leaves.  A contracted node is written down with its anchor, the node
it now hangs from, and the nodes contracted between the two.  A tree of any shape
and depth is down to its root after O(log n) rounds; a cycle shrinks to a node that
is its own parent and never goes away, which exposes it.  The rounds are then
undone, newest first: a node has its anchor's root, its depth is the anchor's and
the nodes between and itself more, and where paths are asked for its path is the
anchor's path, the nodes between, and itself.  Every round works on what the last one left, a geometrically shrinking
table, and exchanges rows by node only; nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shuffle_width, strip, table


def latest_links(df: DataFrame, node: str, parent: str, updated: str | None = None) -> DataFrame:
    """(node, parent) with one row per node: blanks around ids removed, of several rows the latest counts.

    Equal times are decided by the larger parent, a missing time is oldest, rows
    without a node id are ignored; a blank parent or one that is no node is null.
    """
    clean = lambda c: F.when(strip(F.col(c)) != "", strip(F.col(c)))
    time = F.col(updated) if updated else F.lit(None).cast("timestamp")
    rows = df.select(clean(node).alias("node"), clean(parent).alias("parent"), time.alias("time")).where("node IS NOT NULL")
    rows = rows.groupBy("node").agg(F.max(F.struct("time", "parent")).alias("m")).select("node", F.col("m.parent").alias("parent"))
    known = rows.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    # Rows without a parent stay out of the join, where they would all have one key.
    linked = rows.where("parent IS NOT NULL").join(known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("parent"))
    return linked.unionByName(rows.where("parent IS NULL"))


def resolve_hierarchy(links: DataFrame, paths: bool = True) -> DataFrame:
    """(node, root, depth, path) from (node, parent), one row per node; without ``paths`` no path, and only numbers travel.

    A null parent makes a root: depth 1, path of itself.  A node that never reaches
    a root, in a cycle or below one, has root '' , depth 0 and an empty path.
    An empty table gives no rows.
    """
    spark = links.sparkSession
    empty = F.expr("cast(array() as array<string>)")
    # ``between`` are the nodes contracted between a node and its parent, or their number.
    none, plus = (empty, F.concat) if paths else (F.lit(0), lambda *c: sum(c[1:], c[0]))
    one = (lambda c: F.array(c)) if paths else (lambda c: F.lit(1))
    active = cut(links.select("node", "parent", none.alias("between")))
    records = []
    moving = F.col("parent").isNotNull() & (F.col("parent") != F.col("node"))
    while not active.where(moving).isEmpty():
        below = active.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("children"), F.min("node").alias("child"))
        x = active.join(below.withColumnRenamed("parent", "node"), "node", "left")
        # Another hash in every round; as text its seed stays out of the compiled code, which then serves all rounds.
        h = lambda c: F.xxhash64(F.lit(str(len(records))), c)
        splice = moving & (F.col("children") == 1) & (h("node") > h("parent")) & (h("node") > h("child"))
        x = x.withColumn("kind", F.when(splice, 2).when(moving & F.col("children").isNull(), 1).otherwise(0))
        # The only child of a spliced node is lifted to that node's parent.
        up = x.where("kind = 2").select(F.col("child").alias("node"), F.col("parent").alias("lift"), plus(F.col("between"), one("node")).alias("over"))
        x = x.join(up, "node", "left").select(
            "node", F.coalesce("lift", "parent").alias("parent"), "kind",
            F.when(F.col("over").isNotNull(), plus(F.col("over"), F.col("between"))).otherwise(F.col("between")).alias("between"),
        )
        x = cut(x)
        records.append(x.where("kind > 0").select("node", F.col("parent").alias("anchor"), "between"))
        active = x.where("kind = 0").select("node", "parent", "between")
    rooted = F.col("parent").isNull()
    done = active.select("node", F.when(rooted, F.col("node")).otherwise("").alias("root"), F.when(rooted, one("node")).otherwise(none).alias("way"))
    for k, r in enumerate(reversed(records), 1):
        grown = r.join(done.select(F.col("node").alias("anchor"), "root", "way"), "anchor")
        done = done.unionByName(grown.select("node", "root", F.when(F.col("root") != "", plus(F.col("way"), F.col("between"), one("node"))).otherwise(none).alias("way")))
        if k % 2 == 0 and k < len(records):  # each step reads what is done twice
            done = cut(done.coalesce(shuffle_width(spark)))
    if not paths:
        return done.select("node", "root", F.col("way").alias("depth"))
    return done.select("node", "root", F.size("way").alias("depth"), F.col("way").alias("path"))


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance): every pair along a path, from what resolve_hierarchy gives.

    One row per pair, as many as the sum of all depths; nothing is collected into arrays.
    """
    return resolved.select("node", "depth", F.posexplode("path").alias("at", "ancestor")).where(F.col("ancestor") != F.col("node")).select(
        "ancestor", F.col("node").alias("descendant"), (F.col("depth") - F.col("at") - 1).alias("distance"))


def _structure(spark: SparkSession, sf_dir: str, paths: bool = True) -> DataFrame:
    return resolve_hierarchy(latest_links(table(spark, sf_dir, "document_structure_map"), "node_id", "parent_id", "updated_at"), paths)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structure(spark, sf_dir, paths=False).select(F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth")


def p6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structure(spark, sf_dir).select(F.col("node").alias("node_id"), F.array_join("path", " > ").alias("path"), "depth")


def p6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(_structure(spark, sf_dir)).select(F.col("ancestor").alias("node_id"), F.col("descendant").alias("descendant_id"), "distance")


_CLEAN = """
WITH RECURSIVE clean AS (
  SELECT nullif(regexp_replace(node_id, '^\\s+|\\s+$', '', 'g'), '') AS node, nullif(regexp_replace(parent_id, '^\\s+|\\s+$', '', 'g'), '') AS parent, updated_at FROM document_structure_map),
latest AS (
  SELECT node, parent FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY updated_at DESC NULLS LAST, parent DESC NULLS LAST) AS k FROM clean WHERE node IS NOT NULL) WHERE k = 1),
links AS (SELECT l.node, p.node AS parent FROM latest l LEFT JOIN latest p ON l.parent = p.node),
down AS (
  SELECT node, node AS root, 1 AS depth, node AS path FROM links WHERE parent IS NULL
  UNION ALL SELECT l.node, d.root, d.depth + 1, d.path || ' > ' || l.node FROM links l JOIN down d ON l.parent = d.node)
"""
P6_FOUND_SQL = _CLEAN + "SELECT l.node AS node_id, coalesce(root, '') AS root_id, CAST(coalesce(depth, 0) AS INTEGER) AS depth FROM links l LEFT JOIN down d ON l.node = d.node"
P6_PATHS_SQL = _CLEAN + "SELECT l.node AS node_id, coalesce(path, '') AS path, CAST(coalesce(depth, 0) AS INTEGER) AS depth FROM links l LEFT JOIN down d ON l.node = d.node"
P6_DESCENDANTS_SQL = _CLEAN + """, pairs AS (
  SELECT l.parent AS a, l.node AS b, 1 AS distance FROM links l JOIN down d ON l.node = d.node WHERE l.parent IS NOT NULL
  UNION ALL SELECT l.parent, p.b, p.distance + 1 FROM pairs p JOIN links l ON l.node = p.a WHERE l.parent IS NOT NULL)
SELECT a AS node_id, b AS descendant_id, CAST(distance AS INTEGER) AS distance FROM pairs"""

"""Queries over the parent-child trees of media."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators import hierarchy as H


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/media.parquet").select("id", "parent_id", "exported_at")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.hierarchy(_media(spark, sf_dir), version="exported_at")
    return found.select(F.col("node").alias("media_id"), F.col("root").alias("root_id"), F.col("depth").alias("node_depth"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = _media(spark, sf_dir)
    return H.with_tops(H.hierarchy(media, version="exported_at", with_path=True), media)


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every media with its root, depth and path of ids from the top."""
    return _paths(spark, sf_dir).select(F.col("node").alias("media_id"), F.col("root").alias("root_id"), F.col("depth").alias("node_depth"), F.concat_ws("/", F.col("path").cast("array<string>")).alias("path"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (ancestor, descendant) with the steps between them."""
    return H.descendants(_paths(spark, sf_dir)).select(F.col("ancestor").alias("media_id"), F.col("descendant").alias("descendant_id"), "distance")


_UP = """with recursive m as (select id, max_by(struct_pack(p := parent_id), exported_at).p as parent_id from media group by id),
e as (select a.id as child, a.parent_id as parent from m a join m b on a.parent_id = b.id),
up(id, cur, d, path) as (select child, parent, 1, [child] from e
  union all select id, e.parent, d + 1, list_append(path, cur) from up join e on e.child = up.cur where not list_contains(path, cur)),
last as (select *, row_number() over (partition by id order by d desc) as rn from up),
r as (select id, case when list_contains(path, cur) then list_min(path[list_position(path, cur):]) else cur end as root_id,
  case when cur = id then -1 when list_contains(path, cur) then -2 else d end as node_depth,
  case when cur = id then [id] when list_contains(path, cur) then list_reverse(path[:list_position(path, cur)]) else list_prepend(cur, list_reverse(path)) end as p from last where rn = 1),
w as (select * from r union all select id, id, 0, [id] from m where id not in (select child from e))
"""

QUERIES = {"p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants}
ORACLE = {
    "p2_found": _UP + "select id as media_id, root_id, cast(node_depth as int) as node_depth from r",
    "p2_paths": _UP + "select id as media_id, root_id, cast(node_depth as int) as node_depth, array_to_string(p, '/') as path from w",
    "p2_descendants": _UP + """select a as media_id, id as descendant_id, cast(n - 1 - pos as int) as distance from
  (select id, len(p) as n, unnest(p[:len(p) - 1]) as a, unnest(range(0, len(p) - 1)) as pos from w)""",
}

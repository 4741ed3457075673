"""Parent-child links to full hierarchies by tree contraction.

Forward, each round rakes leaves (drops them, noting their parent and distance) and splices an independent set of
unary nodes out of their chains, noting parent, child and distance. Only edges of a node to itself, contracted circles, survive. Backward, the recorded contractions are undone in
reverse order, so each node gets its root, depth and path from a node resolved before it. Both directions touch a shrinking
share of the nodes per round; every round is written to the shared folder.

Defined results: the row with the largest ``version`` of an id counts (null lowest); a null id is no node; a parent that names no id makes its
child a top; nodes on a circle get depth -1, nodes below a circle -2, both with the smallest id of the circle as root; a path starts at
the top or, below a circle, at the circle's node; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.session import Scratch, salted_join

#: Rows of one parent beyond which a join splits it into salts.
HOT_ROWS = 500_000


def latest(rows: DataFrame, node: str, parent: str, version: str | None) -> DataFrame:
    """(node, parent) of each id's newest row; one pass with map-side combine, no window."""
    rows = rows.filter(F.col(node).isNotNull())
    if version is None:
        newest = F.max(F.col(parent))
    else:
        newest = F.max_by(F.struct(F.col(parent).alias("p")), F.struct(F.col(version).isNotNull(), F.col(version), F.col(parent)))["p"]
    return rows.groupBy(F.col(node).alias("node")).agg(newest.alias("parent"))


def _edges(nodes: DataFrame, hot_rows: int) -> DataFrame:
    """The nodes whose parent exists."""
    known = nodes.groupBy("parent").agg(F.count("*").alias("n_rows")).filter("parent is not null")
    known = known.join(nodes.select(F.col("node").alias("parent")), "parent")
    return salted_join(nodes.filter("parent is not null"), known, "parent", "node", "inner", hot_rows).select("node", "parent")


def _turn(edges: DataFrame, turn: int, with_path: bool) -> DataFrame:
    """One round of contraction: rows with fate 'keep' are the edges left, 'rake' and 'splice' the records.

    A node with one child and a parent is spliced if its hash is below both of theirs, so no two neighbours are; its child takes over its
    edge. Leaves are raked unless they have just done so. Every record's parent and child thus outlast the round.
    """
    mine, up, down = (F.xxhash64(c, F.lit(turn)) for c in ("node", "parent", "child"))
    below = lambda other, name: (mine < other) | ((mine == other) & (F.col("node") < F.col(name)))
    kids = edges.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"), F.max("node").alias("child"))
    splice = (F.col("node") != F.col("parent")) & (F.col("kids") == 1) & below(up, "parent") & below(down, "child")
    marked = edges.join(kids, "node", "left").withColumn("splice", F.coalesce(splice, F.lit(False)))
    gone = marked.filter("splice").select(
        F.col("child").alias("node"), F.col("node").alias("g"), F.col("parent").alias("g_parent"), F.col("steps").alias("g_steps"), F.col("least_id").alias("g_least"), *[F.col("mid").alias("g_mid")] * with_path
    )
    joined = marked.join(gone, "node", "left")
    out = [
        F.col("node"),
        F.coalesce("g_parent", "parent").alias("parent"),
        (F.col("steps") + F.coalesce("g_steps", F.lit(0))).alias("steps"),
        F.least("least_id", "g", "g_least").alias("least_id"),
        F.when(F.col("splice"), F.col("child")).alias("child"),
        F.when(F.col("splice"), "splice").when(F.col("kids").isNull() & F.col("g").isNull(), "rake").otherwise("keep").alias("fate"),
    ]
    if with_path:
        out.append(F.when(F.col("g").isNull(), F.col("mid")).otherwise(F.concat("g_mid", F.array("g"), "mid")).alias("mid"))
    return joined.select(*out)


def _resolve(known: DataFrame, records: DataFrame, with_path: bool, hot_rows: int | None) -> DataFrame:
    """Results of a round's records from those of the nodes they were recorded against; a parent without a result is a top."""
    parents = known.select(F.col("node").alias("parent"), F.col("root").alias("p_root"), F.col("depth").alias("p_depth"), *[F.col("path").alias("p_path")] * with_path)
    if hot_rows is not None:
        parents = records.groupBy("parent").agg(F.count("*").alias("n_rows")).join(parents, "parent")
    joined = salted_join(records, parents, "parent", "node", "left", hot_rows)
    joined = joined.join(known.filter("depth = -1").select(F.col("node").alias("child"), F.col("root").alias("c_root")), "child", "left")
    on_circle, under = F.col("c_root").isNotNull(), F.col("p_depth") < 0
    out = [
        F.col("node"),
        F.coalesce("c_root", "p_root", "parent").alias("root"),
        F.when(on_circle, -1).when(under, -2).otherwise(F.coalesce("p_depth", F.lit(0)) + F.col("steps")).cast("int").alias("depth"),
    ]
    if with_path:
        path = F.when(on_circle, F.array("node")).otherwise(F.concat(F.coalesce("p_path", F.array("parent")), "mid", F.array("node")))
        out.append(path.alias("path"))
    return joined.select(*out)


def hierarchy(rows: DataFrame, node: str = "id", parent: str = "parent_id", version: str | None = None, with_path: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, root, depth[, path]) of every node that has an existing parent; see the module for circles and tops."""
    scratch = Scratch(rows.sparkSession, "hierarchy")
    nodes = scratch.put(latest(rows, node, parent, version))
    edges = _edges(nodes, hot_rows).withColumns({"steps": F.lit(1), "least_id": F.lit(None).cast(nodes.schema["node"].dataType)})
    if with_path:
        edges = edges.withColumn("mid", F.slice(F.array("node"), 1, 0))
    edges = scratch.put(edges)
    scratch.drop(nodes)
    widest = edges.groupBy("parent").count().agg(F.max("count")).first()[0] or 0
    salt_above = hot_rows if widest > hot_rows else None  # a contraction never gives a node more children
    turns: list[DataFrame] = []
    while not edges.filter("node <> parent").isEmpty():
        marked = scratch.put(_turn(edges, len(turns), with_path))
        turns.append(marked)
        edges = marked.filter("fate = 'keep'").drop("fate", "child")
    core = edges.select("node", F.least("node", "least_id").alias("root"), F.lit(-1).alias("depth"), *[F.array("node").alias("path")] * with_path)
    paths = [scratch.write(core)]
    for marked in reversed(turns):
        known = scratch.read(paths, core)
        paths.append(scratch.write(_resolve(known, marked.filter("fate <> 'keep'"), with_path, salt_above)))
        scratch.drop(marked)
    return scratch.read(paths, core)


def with_tops(found: DataFrame, rows: DataFrame, node: str = "id") -> DataFrame:
    """Adds the tops (depth 0, their own root and path) to a result with paths."""
    ids = rows.select(F.col(node).alias("node")).filter("node is not null").distinct()
    tops = ids.join(found.select("node"), "node", "left_anti")
    return found.unionByName(tops.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.array("node").alias("path")))


def descendants(paths: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of every node below another, from the paths; as many rows as the depths add up to."""
    n = F.size("path")
    above = paths.select(F.col("node").alias("descendant"), F.posexplode(F.slice("path", 1, n - 1)).alias("at", "ancestor"), n.alias("n"))
    return above.select("ancestor", "descendant", (F.col("n") - 1 - F.col("at")).alias("distance"))

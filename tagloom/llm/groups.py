"""Consolidating pairwise matches into groups: minimum labels, pointer jumping, contraction.

Each round every node takes the smallest label among itself and its neighbours, the resulting trees are flattened by
pointer jumping, and the edges are rewritten onto the labels; edges inside a group vanish and every node that is not
the smallest of its neighbourhood is absorbed, so a round at least halves what is left. Each step is written to the shared folder.

Defined results: rows with a null on either side link nothing; repeated pairs count once; a left node whose links are
all null has no row; an empty input gives an empty result. Hubs that hold a large share of all pairs are salted by their counted size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.session import Scratch, salted_join, small_enough

#: Rows of one key beyond which a join splits the key into salts.
HOT_ROWS = 500_000
#: Edges that one task may finish, about 10 MB.
LAST_EDGES = 100_000


def _minimum_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, labels) of a graph held in arrays: hook every node under its smallest neighbour, jump, rewrite the edges, until none is left."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        parent = np.arange(len(nodes))
        np.minimum.at(parent, a, b)
        np.minimum.at(parent, b, a)
        while not np.array_equal(parent, jumped := parent[parent]):
            parent = jumped
        label = parent[label]
        a, b = parent[a], parent[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[label]


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = [f for f in batches if len(f)]
    if frames:
        edges = pd.concat(frames, ignore_index=True)
        nodes, labels = _minimum_labels(edges["u"].to_numpy(), edges["v"].to_numpy())
        yield pd.DataFrame({"node": nodes, "parent": labels})


def _flatten(scratch: Scratch, parents: DataFrame, hot_rows: int | None) -> DataFrame:
    """Pointer jumping until every node points at its root. parents: (node, parent), parent <= node."""
    while True:
        sizes = parents.groupBy(F.col("parent").alias("mid")).agg(F.count("*").alias("n_rows"))
        above = sizes.join(parents.select(F.col("node").alias("mid"), F.col("parent").alias("top")), "mid").select("mid", "top", "n_rows")
        jumped = salted_join(parents.withColumnRenamed("parent", "mid"), above, "mid", "node", "left", hot_rows)
        jumped = scratch.put(jumped.select("node", F.coalesce("top", "mid").alias("parent"), (F.coalesce("top", "mid") != F.col("mid")).alias("moved")))
        moved = jumped.filter("moved").limit(1).count()
        scratch.drop(parents)
        parents = jumped.select("node", "parent")
        parents._scratch_path = jumped._scratch_path
        if not moved:
            return parents


def connected(edges: DataFrame, scratch: Scratch, hot_rows: int = HOT_ROWS, last_edges: int = LAST_EDGES) -> DataFrame:
    """(node, label) of every node of ``edges`` (u, v): label is the smallest node of its component."""
    edges = scratch.put(edges.filter("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct())
    if small_enough(edges, hot_rows // 2):  # then no key of the joins below, not even that of one giant group, has more rows than the limit
        hot_rows = None
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        if small_enough(edges, last_edges):
            kind = edges.schema["u"].dataType.simpleString()
            levels.append(scratch.put(edges.repartition(1).mapInPandas(_finish, f"node {kind}, parent {kind}")))
            break
        both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other")))
        hooks = both.groupBy("node").agg(F.min("other").alias("m"), F.count("*").alias("n_rows"))
        hooks = scratch.put(hooks.select("node", F.least("node", "m").alias("parent"), "n_rows"))
        flat = _flatten(scratch, scratch.put(hooks.select("node", "parent")), hot_rows)
        sized = flat.join(hooks.select("node", "n_rows"), "node")
        as_end = lambda end: sized.select(F.col("node").alias(end), F.col("parent").alias(f"{end}_to"), "n_rows")
        moved = salted_join(salted_join(edges, as_end("u"), "u", "v", "inner", hot_rows), as_end("v"), "v", "u", "inner", hot_rows)
        rest = moved.filter("u_to <> v_to").select(F.least("u_to", "v_to").alias("v"), F.greatest("u_to", "v_to").alias("u")).distinct()
        rest = scratch.put(rest)
        scratch.drop(edges, hooks)
        edges = rest
        levels.append(flat)
    if not levels:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    labels = levels.pop()
    while levels:  # back through the rounds: each is a multiple of the one above, so this touches about all nodes once
        own = levels.pop()
        sizes = own.groupBy(F.col("parent").alias("mid")).agg(F.count("*").alias("n_rows"))
        above = sizes.join(labels.select(F.col("node").alias("mid"), F.col("parent").alias("top")), "mid")
        lower = salted_join(own.withColumnRenamed("parent", "mid"), above, "mid", "node", "left", hot_rows)
        lower = scratch.put(lower.select("node", F.coalesce("top", "mid").alias("parent")))
        scratch.drop(own, labels)
        labels = lower
    return labels.select("node", F.col("parent").alias("label"))


def consolidate(links: DataFrame, member: str, key: str, hot_rows: int = HOT_ROWS, last_edges: int = LAST_EDGES) -> DataFrame:
    """(member, group_id): members sharing a key, directly or over others, get the smallest member of their group."""
    scratch = Scratch(links.sparkSession, "groups")
    pairs = scratch.put(links.select(F.col(member).alias("member"), F.col(key).alias("key")).dropna().distinct())
    stars = pairs.groupBy("key").agg(F.min("member").alias("first"), F.count("*").alias("n_rows"))
    edges = salted_join(pairs, stars, "key", "member", "inner", hot_rows).select(F.col("member").alias("u"), F.col("first").alias("v"))
    labels = connected(edges, scratch, hot_rows, last_edges)
    members = pairs.select(F.col("member")).distinct()
    return members.join(labels, members["member"] == labels["node"], "left").select(F.col("member").alias(member), F.coalesce("label", "member").alias("group_id"))

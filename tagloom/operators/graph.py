"""Closures, breadcrumbs, alias expansion, implications and components (J), each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.hierarchy import hierarchy
from tagloom.session import Scratch, salted_join

#: Passes of implications at most.
PASSES = 10


def closure(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(top, node) of every node reachable from top over (parent, child), top itself included; ends on circles and diamonds alike.

    By doubling: round k extends the pairs that were new in the last round, which are 2^(k-1) steps apart, by all pairs known, so a chain of n nodes takes log n rounds.
    """
    scratch = Scratch(nodes.sparkSession, "closure")
    steps = edges.filter("parent is not null and child is not null").select(F.col("parent").alias("top"), F.col("child").alias("node")).distinct()
    own = nodes.select("node").union(steps.select("top")).union(steps.select("node")).filter("node is not null").distinct()
    kind = own.select(F.col("node").alias("top"), "node")
    known = [scratch.write(kind), scratch.write(steps.filter("top <> node"))]
    while True:
        fresh, all_pairs = scratch.read(known[-1], kind), scratch.read(known[1:], kind)
        step = fresh.withColumnRenamed("node", "mid").join(all_pairs.withColumnRenamed("top", "mid"), "mid").select("top", "node").distinct()
        path = scratch.write(step.join(scratch.read(known, kind), ["top", "node"], "left_anti"))
        if scratch.read(path, kind).isEmpty():
            return scratch.read(known, kind).join(nodes.select(F.col("node").alias("top")).distinct(), "top", "left_semi")
        known.append(path)


def path_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(top, node, paths): in how many ways node is reached; edges inside a circle are left out, so every album of it counts once."""
    reach = closure(edges, nodes)
    back = reach.select(F.col("top").alias("child"), F.col("node").alias("parent"))
    forward = Scratch(nodes.sparkSession, "forward").put(edges.join(back, ["parent", "child"], "left_anti"))
    scratch = Scratch(nodes.sparkSession, "paths")
    kind = nodes.select(F.col("node").alias("top"), "node", F.lit(1).cast("bigint").alias("paths"))
    levels = [scratch.write(kind)]
    while True:
        last = scratch.read(levels[-1], kind)
        step = last.join(forward, last["node"] == forward["parent"]).groupBy("top", "child").agg(F.sum("paths").alias("paths")).select("top", F.col("child").alias("node"), "paths")
        path = scratch.write(step)
        if scratch.read(path, kind).isEmpty():
            return scratch.read(levels, kind).groupBy("top", "node").agg(F.sum("paths").alias("paths"))
        levels.append(path)


def breadcrumbs(edges: DataFrame) -> DataFrame:
    """(node, root, depth, path) over the smallest parent of each node, by tree contraction."""
    return hierarchy(edges.groupBy("child").agg(F.min("parent").alias("parent")).unionByName(edges.select(F.col("parent").alias("child")).distinct().withColumn("parent", F.lit(None).cast("bigint"))), "child", "parent", with_path=True)


def expand(start: DataFrame, relation: DataFrame, rounds: int) -> DataFrame:
    """(start, key, hops) of keys reached over (a, b), read both ways, in at most ``rounds`` steps; the fewest hops count."""
    both = relation.select("a", "b").union(relation.select("b", "a")).filter("a is not null and b is not null").distinct()
    reached = start.select(F.col("key").alias("start"), "key", F.lit(0).alias("hops"))
    last = reached
    for n in range(1, rounds + 1):
        last = last.join(both, last["key"] == both["a"]).select("start", F.col("b").alias("key")).distinct().join(reached, ["start", "key"], "left_anti").withColumn("hops", F.lit(n))
        reached = reached.unionByName(last)
    return reached


def implied(edges: DataFrame, targets: DataFrame, implied_tags: DataFrame, passes: int = PASSES) -> DataFrame:
    """(media_id, tag_id, pass) of tags that follow: a rule fires where all its targets are present; at most ``passes`` passes.

    edges: (media_id, tag_id), distinct; targets and implied_tags: (rule_id, tag_id), rules of few rows each.
    """
    scratch = Scratch(edges.sparkSession, "implied")
    rules = targets.distinct()
    rules = scratch.put(rules.join(rules.groupBy("rule_id").agg(F.count("*").alias("wanted")), "rule_id"))
    # only tags that a rule names can matter
    used = rules.select("tag_id").union(implied_tags.select("tag_id")).distinct()
    kind = edges.select("media_id", "tag_id", F.lit(0).alias("pass"))
    known = [scratch.write(kind.join(used, "tag_id", "left_semi").select(*kind.columns))]
    for n in range(1, passes + 1):
        have = scratch.read(known, kind)
        if n > 1:  # a rule can only fire anew where the last pass added a tag
            have = have.join(scratch.read(known[-1], kind).select("media_id").distinct(), "media_id", "left_semi").select(*kind.columns)
        fired = have.join(rules, "tag_id").groupBy("media_id", "rule_id", "wanted").agg(F.count("*").alias("n")).filter("n = wanted")
        new = fired.join(implied_tags, "rule_id").select("media_id", "tag_id").distinct().join(have, ["media_id", "tag_id"], "left_anti").withColumn("pass", F.lit(n))
        path = scratch.write(new.select("media_id", "tag_id", "pass"))
        if scratch.read(path, kind).isEmpty():
            break
        known.append(path)
    return scratch.read(known, kind).filter(F.col("pass") > 0)


def components(edges: DataFrame, hot_rows: int = 500_000) -> DataFrame:
    """(node, root) with the smallest node as root, by alternating large-star and small-star steps until nothing moves.

    A large star hangs a node's larger neighbours under its smallest one, a small star the smaller ones; both keep components and
    hubs are salted by their counted size. edges: (a, b) of one type; loops and nulls are dropped.
    """
    scratch = Scratch(edges.sparkSession, "stars")
    pairs = edges.select("a", "b").filter("a is not null and b is not null and a <> b")
    now = scratch.put(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = scratch.put(now.select(F.col("u").alias("node")).union(now.select("v")).distinct())
    # rows of a round are distinct, so their number and two sums of hashes tell whether any moved
    state = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("bigint"))).first())
    before = state(now)
    while True:
        both = now.select("u", "v").union(now.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_rows")).select("u", F.least("u", "m").alias("m"), "n_rows")
        large = salted_join(both, low, "u", "v", hot_rows=hot_rows).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_rows"))
        small = salted_join(large, low, "u", "v", hot_rows=hot_rows)
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        then = scratch.put(small)
        scratch.drop(now)
        now, was, before = then, before, state(then)
        if was == before:
            roots = now.groupBy("u").agg(F.min("v").alias("root"))
            return nodes.join(roots, nodes["node"] == roots["u"], "left").select("node", F.coalesce("root", "node").alias("root"))

"""Incremental file sync (L): snapshot diffs, missing files, priorities, lifecycle, watermark, dedupe, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Work priorities by state.
PRIORITY = {"missing": 95, "failed": 50, "deferred": 40, "changed": 10, "new": 5, "requeued": 20, "unchanged": 30}


def snapshot(observations: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last observation of each file."""
    rest = [c for c in observations.columns if c not in (key, *order)]
    return observations.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in (*order, *rest)])


def diff(previous: DataFrame, current: DataFrame, key: str, complete: bool = True) -> DataFrame:
    """(key, state, file_size, mtime): new, changed (size or time differs), unchanged, and missing unless the scan was partial, where such files stay deferred."""
    p = previous.select(key, F.col("file_size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.lit(True).alias("had"))
    both = p.join(current.select(key, "file_size", "mtime", F.lit(True).alias("now")), key, "full")
    same = F.col("old_size").eqNullSafe(F.col("file_size")) & F.col("old_mtime").eqNullSafe(F.col("mtime"))
    state = F.when(F.col("now").isNull(), "missing" if complete else "deferred").when(F.col("had").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return both.select(key, state.alias("state"), F.coalesce("file_size", "old_size").alias("file_size"), F.coalesce("mtime", "old_mtime").alias("mtime"))


def cascade(changes: DataFrame) -> DataFrame:
    """What a state means for the later steps of each file."""
    s = F.col("state")
    again = F.when(s.isin("new", "changed"), "pending").when(s == "missing", "blocked").otherwise("done")
    return changes.withColumns({"import_status": again, "ai_status": F.when(again == "pending", "waiting").otherwise(again), "localization_status": F.when(again == "pending", "waiting").otherwise(again)})


def priority(state: str = "state") -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])[F.col(state)], F.lit(35))


def high_watermark(items: DataFrame, lookback: str) -> DataFrame:
    """The latest time among settled files, less a lookback."""
    return items.filter(F.col("state").isin("unchanged", "changed", "new")).agg((F.max("mtime") - F.expr(f"interval {lookback}")).alias("watermark"))


def lifecycle(media: DataFrame) -> DataFrame:
    """(id, step) of media by the first test that holds: broken, placeholder, unclassified, child to continue, retryable, complete."""
    step = (
        F.when(F.col("path").isNull() | F.col("hash").isNull(), "broken")
        .when(F.coalesce(F.col("file_size"), F.lit(0)) <= 0, "placeholder")
        .when(F.col("content_class").isNull(), "follow_up")
        .when(F.col("content_class") == "unknown", "retryable")
        .when(F.col("parent_id").isNotNull() & (F.col("content_class_confidence") < 0.7), "continuation")
        .when(F.col("content_class_confidence") < 0.5, "version_pending")
        .otherwise("complete")
    )
    return media.select("id", step.alias("step"))


def import_new(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per hash that the library lacks, the smallest id."""
    first = incoming.filter("hash is not null").groupBy("hash").agg(F.min("id").alias("id"))
    return first.join(existing.select("hash"), "hash", "left_anti")


def reconcile(manifest: DataFrame, disk: DataFrame, key: str) -> DataFrame:
    """(key, problem): missing or extra files, differing sizes, names listed twice."""
    m = manifest.groupBy(key).agg(F.count("*").alias("listed"), F.min("file_size").alias("want"))
    d = disk.groupBy(key).agg(F.max("file_size").alias("have"), F.lit(True).alias("found"))
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "extra").when(F.col("listed") > 1, "duplicate").when(~F.col("want").eqNullSafe(F.col("have")), "size_mismatch")
    return m.join(d, key, "full").select(key, problem.alias("problem")).filter("problem is not null")


def mutations(before: DataFrame, after: DataFrame, allowed: list[str]) -> DataFrame:
    """(table, verdict) of two sets of table fingerprints (table, n, fingerprint): unchanged, or changed and allowed, forbidden or unexpected (new or gone)."""
    b = before.select("table", F.col("n").alias("n0"), F.col("fingerprint").alias("f0"))
    joined = b.join(after, "table", "full")
    same = F.col("n0").eqNullSafe(F.col("n")) & F.col("f0").eqNullSafe(F.col("fingerprint"))
    verdict = F.when(F.col("n0").isNull() | F.col("n").isNull(), "unexpected").when(same, "unchanged").when(F.col("table").isin(allowed), "allowed").otherwise("forbidden")
    return joined.select("table", verdict.alias("verdict"))

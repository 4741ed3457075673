"""Tag statistics, related tags, dashboards and audits (D), top-k rows per group (E) and listings (F).

All group sizes come from hash aggregates with map-side combine; a top-k is a take-ordered, never a full sort. Ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.library import Library

CATEGORIES = ("general", "artist", "character", "copyright", "meta")  # fixed values


def recount(lib: Library) -> DataFrame:
    """Confirmed edges per tag, 0 for unused tags."""
    used = lib.edges.filter("not is_suggestion").groupBy("tag_id").agg(F.count("*").alias("n"))
    return lib.tags.join(used, lib.tags["id"] == used["tag_id"], "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("post_count"))


def together_with(lib: Library, names: list[str], limit: int = 20) -> DataFrame:
    """Tags most often on media that have any of the named tags, those tags left out; suggestions count."""
    asked = lib.tags.filter(F.col("name").isin(names)).select(F.col("id").alias("tag_id"))
    media = lib.edges.join(F.broadcast(asked), "tag_id", "left_semi").select("media_id").distinct()
    counts = lib.edges.join(media, "media_id", "left_semi").join(F.broadcast(asked), "tag_id", "left_anti").groupBy("tag_id").agg(F.count("*").alias("n_media"))
    top = counts.join(lib.tags.select(F.col("id").alias("tag_id"), "name", "category"), "tag_id").orderBy(F.desc("n_media"), "tag_id").limit(limit)
    return top.select("tag_id", "name", "category", "n_media")


def related(lib: Library, name: str, category: str | None = None, limit: int = 25) -> DataFrame:
    """Co-occurring tags (the tag itself included) with frequency, overlap, jaccard and cosine over stored counts; a query tag counted 0 has none."""
    asked = lib.tags.filter((F.col("name") == name) & (F.col("post_count") > 0)).select(F.col("id").alias("q_id"), F.col("post_count").alias("q"))
    media = lib.edges.join(F.broadcast(asked), F.col("tag_id") == F.col("q_id")).select("media_id", "q")
    counts = lib.edges.join(media, "media_id").groupBy("tag_id", "q").agg(F.count("*").alias("i"))
    tags = lib.tags if category is None else lib.tags.filter(F.col("category") == category)
    joined = counts.join(tags.select(F.col("id").alias("tag_id"), "name", F.col("post_count").alias("t")), "tag_id").orderBy(F.desc("i"), "tag_id").limit(limit)
    i, q, t = (F.col(c).cast("double") for c in "iqt")
    share = lambda over: F.round(F.when(over > 0, i / over).otherwise(0.0), 6)
    return joined.select("tag_id", "name", F.col("i").alias("n_both"), share(q).alias("frequency"), share(F.least(q, t)).alias("overlap"), share(q + t - i).alias("jaccard"), share(F.sqrt(q * t)).alias("cosine"))


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    """Sizes of all groups, null as its own group."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def text_counts(df: DataFrame, column: str, limit: int) -> DataFrame:
    """The largest groups of a column as text, null as '<null>'."""
    key = F.coalesce(F.col(column).cast("string"), F.lit("<null>")).alias("key")
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(limit)


def filled_distribution(df: DataFrame, column: str, keys: tuple[str, ...], missing: str) -> DataFrame:
    """Counts of fixed keys, 0 where a key doesn't occur, and of null under its own name."""
    listed = df.sparkSession.createDataFrame([(k,) for k in (*keys, missing)], "key string")
    counts = df.groupBy(F.coalesce(column, F.lit(missing)).alias("key")).agg(F.count("*").alias("n"))
    return F.broadcast(listed).join(counts, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))


#: How a quantile picks its place among n sorted values (0-based): three rules in use.
PLACES = {
    "floor_n": lambda n, p: F.least(n - 1, F.floor(n * p)),
    "round_n1": lambda n, p: F.bround((n - 1) * p, 0),
    "floor_n1": lambda n, p: F.floor((n - 1) * p),
}


def quantiles(df: DataFrame, group: list[str], value: str, wanted: dict[str, float], rule: str) -> DataFrame:
    """Values at the places of quantiles, per group; null values are left out.

    Values are counted first, so equal values take one row whatever their number, and places are found in the running counts.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("__c"))
    span = W.partitionBy(*group)
    placed = counted.withColumns({"__end": F.sum("__c").over(span.orderBy(value)), "__n": F.sum("__c").over(span)})
    pick = [F.min(F.when(F.col("__end") > PLACES[rule](F.col("__n"), F.lit(p)), F.col(value))).alias(name) for name, p in wanted.items()]
    return placed.groupBy(*group).agg(F.max("__n").alias("n"), *pick)


def top_per_group(df: DataFrame, group: str | Column, keys: list[Column], k: int) -> DataFrame:
    """The first k rows of each group by an order; Spark prunes to k per partition before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*keys))).filter(F.col("rank") <= k)


def entropy(df: DataFrame, group: str, value: str) -> DataFrame:
    """Entropy of a column per group over the logarithm of the number of its values, 0 for one value."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("c"))
    sums = counts.groupBy(group).agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.sum(F.col("c") * F.log2(F.col("c").cast("double"))).alias("s"))
    bits = F.log2(F.col("n").cast("double")) - F.col("s") / F.col("n")
    return sums.select(group, "n", F.round(F.when(F.col("k") > 1, bits / F.log2(F.col("k").cast("double"))).otherwise(0.0), 6).alias("entropy"))


def fingerprint(df: DataFrame, key: str, version: str) -> DataFrame:
    """Rows and a fingerprint of a table that don't depend on row order: hashes of key and version, summed, so no task holds the table."""
    one = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.coalesce(version, F.lit("")))), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(one), F.lit(0)).cast("string").alias("fingerprint"))


def similarity(a: str, b: str) -> Column:
    """Cosine of two vectors of equal length, null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(F.col(x), F.col(y), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))

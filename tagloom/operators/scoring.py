"""Model outputs to tags and classes (M2 to M5); the models themselves are inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.session import small_enough

# Thresholds of the tagger, of its actions and of the classifier.
TAG_THRESHOLD = {"general": 0.35, "character": 0.85}
CONFIRM = {"general": 0.35, "character": 0.65}
CONFIRM_OTHER, SUGGEST = 0.50, 0.20
SURE, MANY = 0.5, 5
MARGIN, FULL_MARGIN = 0.005, 0.15


def _by_category(table: dict[str, float], other: float):
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col("category")], F.lit(other))


def predicted(scores: DataFrame) -> DataFrame:
    """Tags above the threshold of their category. scores: (media_id, tag_id, category, score)."""
    return scores.filter(F.col("score") >= _by_category(TAG_THRESHOLD, TAG_THRESHOLD["general"]))


def actions(scores: DataFrame) -> DataFrame:
    """confirm from the category's limit on, suggest from the lower one on, else drop."""
    act = F.when(F.col("score") >= _by_category(CONFIRM, CONFIRM_OTHER), "confirm").when(F.col("score") >= SUGGEST, "suggest").otherwise("drop")
    return scores.withColumn("action", act)


def class_by_tags(scores: DataFrame) -> DataFrame:
    """anime from five sure tags on, unknown with none, else undecided."""
    n = scores.groupBy("media_id").agg(F.count_if(F.col("score") >= SURE).alias("n"))
    return n.select("media_id", F.when(F.col("n") >= MANY, "anime").when(F.col("n") == 0, "unknown").otherwise("undecided").alias("content_class"))


#: Classes at most; bounds what is collected and sent along as a literal.
MAX_CLASSES = 1_000


def centroids(vectors: DataFrame) -> DataFrame:
    """(label, centroid): mean vector of each label, as many rows as labels."""
    each = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    means = each.groupBy("label", "i").agg(F.avg("x").alias("x"))
    return means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def zero_shot(vectors: DataFrame, classes: DataFrame) -> DataFrame:
    """(vec_id, label, confidence): the nearest class by cosine; null within a margin too small to tell. classes: (label, centroid), a table of some rows.

    The classes go along as one literal array, so there is neither a join nor a row per vector and class; more than ``MAX_CLASSES`` are an error.
    """
    if not small_enough(classes, MAX_CLASSES):
        raise ValueError(f"more than {MAX_CLASSES} classes; class centroids are meant to be a short list")
    listed = classes.orderBy("label").collect()
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    v = F.transform("embedding", lambda x: x.cast("double"))
    scored = F.array(*[F.struct(F.try_divide(dot(v, F.lit(r["centroid"])), norm(v) * norm(F.lit(r["centroid"]))).alias("cos"), F.lit(r["label"]).alias("best")) for r in listed])
    top = vectors.select("vec_id", F.sort_array(scored, asc=False).alias("s")).select("vec_id", F.col("s")[0].alias("a"), F.try_element_at("s", F.lit(2)).alias("b"))
    margin = F.col("a.cos") - F.coalesce("b.cos", F.lit(-1.0))
    return top.select("vec_id", F.when(margin >= MARGIN, F.col("a.best")).alias("label"), F.round(F.least(F.lit(1.0), margin / FULL_MARGIN), 6).alias("confidence"))


def best_per_group(scores: DataFrame, k: int) -> DataFrame:
    """The k best tags of each medium and category."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy("media_id", "category").orderBy(F.desc("score"), "tag_id"))).filter(F.col("rank") <= k)

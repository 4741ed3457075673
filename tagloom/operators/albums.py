"""Recursive album metrics (D5 to D10, F11, I21) over the closure of the album hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.library import Library
from tagloom.operators import graph
from tagloom.operators.stats import top_per_group

RATINGS = ("safe", "questionable", "explicit")  # fixed values, by rank


def _edges(lib: Library) -> DataFrame:
    return lib.album_hierarchy.select(F.col("parent_album_id").alias("parent"), F.col("child_album_id").alias("child"))


def reach(lib: Library) -> DataFrame:
    """(top, album_id) of each album and all below it."""
    return graph.closure(_edges(lib), lib.albums.select(F.col("id").alias("node"))).select("top", F.col("node").alias("album_id"))


def rows_below(lib: Library) -> DataFrame:
    """(top, media_id), a medium once per album it is in; only media that exist."""
    links = lib.album_media.join(lib.media.select(F.col("id").alias("media_id"), "rating"), "media_id")
    return reach(lib).join(links, "album_id").select("top", "album_id", "media_id", "rating")


def media_counts(lib: Library) -> DataFrame:
    """Sum over all albums below; a medium in two albums counts twice."""
    sizes = lib.album_media.groupBy("album_id").agg(F.count("*").alias("n"))
    return reach(lib).join(sizes, "album_id", "left").groupBy("top").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_media"))


def _rank(column: str):
    return F.array_position(F.array(*map(F.lit, RATINGS)), F.coalesce(column, F.lit("safe")))


def bulk_metrics(lib: Library) -> DataFrame:
    """Media and highest rating per album; a diamond's child counts once per path."""
    paths = graph.path_counts(_edges(lib), lib.albums.select(F.col("id").alias("node")))
    links = lib.album_media.join(lib.media.select(F.col("id").alias("media_id"), "rating"), "media_id", "left")
    own = links.groupBy(F.col("album_id").alias("node")).agg(F.count("*").alias("n"), F.max(_rank("rating")).alias("r"))
    out = paths.join(own, "node", "left").groupBy("top").agg(F.coalesce(F.sum(F.col("n") * F.col("paths")), F.lit(0)).alias("n_media"), F.coalesce(F.max("r"), F.lit(1)).alias("r"))
    return out.select("top", "n_media", F.element_at(F.array(*map(F.lit, RATINGS)), F.col("r").cast("int")).alias("max_rating"))


def popular_tags(lib: Library, k: int) -> DataFrame:
    """The k commonest tags of each album's tree, each medium once, suggestions included."""
    media = rows_below(lib).select("top", "media_id").distinct()
    counts = media.join(lib.edges.select("media_id", "tag_id"), "media_id").groupBy("top", "tag_id").agg(F.count("*").alias("n"))
    return top_per_group(counts, "top", [F.desc("n"), F.asc("tag_id")], k).select("top", "rank", "tag_id", "n")


def without(lib: Library, album: int, cascade: bool) -> tuple[DataFrame, DataFrame]:
    """Albums and hierarchy left after deleting one: with all below it, or with its children left as roots."""
    gone = reach(lib).filter(F.col("top") == album).select(F.col("album_id").alias("id")) if cascade else lib.albums.filter(F.col("id") == album).select("id")
    albums = lib.albums.join(gone, "id", "left_anti")
    links = lib.album_hierarchy
    for end in ("parent_album_id", "child_album_id"):
        links = links.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return albums, links.select("parent_album_id", "child_album_id")

"""Saved answers of tag sites as posts (A16): JSON lines in one of two dialects, read without a network.

The 'categorised' dialect has tag strings by category and ratings of one letter, the 'plain' one a single tag string; both become (id, rating, source, file_url, preview_url, filename, width, height, file_size, score,
tags), tags being an array of (name, category). Missing, null and empty fields count alike; an unknown rating is safe; a line that is no JSON gives no post.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Categories with a tag string of their own, ratings, names of files without one, and the forms of post addresses.
CATEGORIES = ("general", "artist", "character", "copyright", "meta")
RATINGS = {
    "categorised": {"g": "safe", "s": "safe", "q": "questionable", "e": "explicit"},
    "plain": {"safe": "safe", "questionable": "questionable", "explicit": "explicit", "s": "safe", "q": "questionable", "e": "explicit"},
}
UNNAMED = {"categorised": "booru_", "plain": "gelbooru_"}
SCHEMA = ", ".join(
    ["id bigint", *(f"{c} bigint" for c in ("image_width", "image_height", "width", "height", "file_size", "score"))]
    + [f"{c} string" for c in ("md5", "file_ext", "file_url", "large_file_url", "preview_file_url", "preview_url", "image", "rating", "source", "tags", "tag_string", *(f"tag_string_{c}" for c in CATEGORIES))]
)


def _first(*columns: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(None).cast("string"))


def _names(column: str, category: str) -> Column:
    words = F.filter(F.split(F.coalesce(column, F.lit("")), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.struct(w.alias("name"), F.lit(category).alias("category")))


def as_posts(answers: DataFrame, dialect: str, base: str) -> DataFrame:
    """Answers (the columns of SCHEMA) as posts; addresses without a host belong to ``base``."""
    base = base.rstrip("/")
    if dialect not in RATINGS:
        raise ValueError(f"unknown dialect: {dialect}")
    plain = dialect == "plain"
    rating = F.coalesce(F.create_map(*[F.lit(x) for pair in RATINGS[dialect].items() for x in pair])[F.lower("rating")], F.lit("safe"))
    whole = lambda c: F.when(F.startswith(c, F.lit("http")), c).otherwise(F.concat(F.lit(base + "/"), F.regexp_replace(c, "^/", "")))
    if plain:
        tags, url, preview = _names("tags", "general"), whole(_first("file_url", "image")), whole(_first("preview_url"))
        stated, path, width, height = _first("image"), _first("file_url"), "width", "height"
    else:
        by_category = F.concat(*[_names(f"tag_string_{c}", c) for c in CATEGORIES])
        tags = F.when(F.size(by_category) > 0, by_category).otherwise(_names("tag_string", "general"))
        url, preview = _first("file_url", "large_file_url"), _first("preview_file_url", "large_file_url")
        stated, path, width, height = F.concat(_first("md5"), F.lit("."), _first("file_ext")), _first("file_url", "large_file_url"), "image_width", "image_height"
    last = F.nullif(F.regexp_extract(F.try_parse_url(path, F.lit("PATH")), "/([^/]*)$", 1), F.lit(""))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return answers.filter("id is not null").select(
        "id", rating.alias("rating"), F.coalesce("source", F.lit("")).alias("source"), url.alias("file_url"), preview.alias("preview_url"), F.coalesce(stated, last, F.concat(F.lit(UNNAMED[dialect]), F.col("id").cast("string"))).alias("filename"),
        number(width).alias("width"), number(height).alias("height"), number("file_size").alias("file_size"), number("score").alias("score"), tags.alias("tags"),
    )


def read_posts(spark: SparkSession, path: str, dialect: str, base: str) -> DataFrame:
    """Posts of a folder of JSON lines."""
    return as_posts(spark.read.schema(SCHEMA).json(path), dialect, base)


def post_address(url: Column) -> Column:
    """(dialect, id) of the address of a post; null for any other address."""
    path, low = F.try_parse_url(url, F.lit("PATH")), F.lower(url)
    number = F.regexp_extract(path, r"/posts/(\d+)", 1)
    asked = lambda key: F.try_parse_url(low, F.lit("QUERY"), F.lit(key))
    plain = F.contains(F.lower(path), F.lit("index.php")) & (asked("page") == "post") & (asked("s") == "view") & asked("id").rlike(r"^\d+$")
    one = lambda dialect, value: F.struct(F.lit(dialect).alias("dialect"), value.try_cast("bigint").alias("id"))
    return F.when(number != "", one("categorised", number)).when(plain, one("plain", asked("id")))

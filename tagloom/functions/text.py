"""Scalar functions on names and keys (H, M1, B38) as column expressions; Python only where Spark has no Unicode normal forms."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Separators of keys, script ranges and role names.
SEPARATORS = r"[\s/／・·,，|]+"
KANA, HANGUL, HAN, LATIN = "぀-ヿ", "가-힯", "一-鿿", "A-Za-z"
ROLES = {"artist": "artist", "character": "character", "copyright": "work", "series": "work", "person": "person"}
# What roles, categories, states and grades of sources mean.
SOURCE_ROLES = {
    "character": "character", "person": "person", "artist": "artist", "artist_creator": "artist", "creator": "artist", "author": "artist", "work": "work", "work_title": "work", "copyright": "work",
    "source_title": "source_title", "title": "source_title", "unknown_name": "unknown", "unknown_name_like": "unknown", "unknown": "unknown",
}
TAG_CATEGORY_ROLES = {"character": "character", "artist": "artist", "copyright": "work", "4": "character", "1": "artist", "3": "work"}
SOURCE_TAG_CATEGORY_ROLES = {**TAG_CATEGORY_ROLES, "work": "work", "series": "work"}
CONCEPT_STATUS = {
    "active": "active", "active_candidate": "active", "searchable_active": "active", "observed": "active", "accepted": "active", "confirmed": "active",
    "rejected": "rejected", "superseded": "rejected", "blocked": "rejected", "rejected_candidate": "rejected", "ambiguous": "ambiguous",
    "needs_review": "needs_review", "requires_review": "needs_review", "candidate": "needs_review", "pending": "needs_review",
}
GRADES = {"high": 0.9, "medium": 0.65, "low": 0.35, "none": 0.0}
# Keys that only describe.
DESCRIPTIVE_KEYS = (
    "1girl", "1boy", "solo", "smile", "standing", "sitting", "blue_hair", "long_hair", "short_hair", "breasts", "large_breasts", "water", "swimsuit",
    "セーラー服", "おなか", "水着", "胸部", "巨乳", "はいてない", "お尻", "ガーターベルト", "メイド", "ウィンク", "少女", "ぱんつ", "スク水", "裸足",
)
CATEGORY_CODES = {"general": 0, "artist": 1, "copyright": 3, "character": 4, "meta": 5}


def _normal(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split())


def _key(text: str) -> str:
    text = re.sub(SEPARATORS, "_", _normal(text).casefold())
    return re.sub(r"_+", "_", re.sub(r"[^\w:()+.\-]", "_", text)).strip("_")


@F.pandas_udf(StringType())
def _normal_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_normal, na_action="ignore")


@F.pandas_udf(StringType())
def _key_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_key, na_action="ignore")


def _ascii(column: Column) -> Column:
    return column.rlike(r"^[\x00-\x7f]*$")


def normalize(column: Column) -> Column:
    """NFKC with white space collapsed and trimmed; null stays null. ASCII text never leaves the JVM's result, but the UDF is only evaluated on the rest."""
    plain = F.trim(F.regexp_replace(column, r"[ \t\n\x0b\f\r\x1c-\x1f]+", " "))
    return F.when(_ascii(column), plain).otherwise(_normal_udf(F.when(~_ascii(column), column)))


def canonical_key(column: Column) -> Column:
    """The key of a name: normalized, case folded, separators and other marks as single underscores."""
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace(column, r"[ \t\n\x0b\f\r\x1c-\x1f]+", " "))), r"[ /,|]+", "_")
    plain = F.regexp_replace(F.regexp_replace(plain, r"[^A-Za-z0-9_:()+.\-]", "_"), r"_+", "_")
    return F.when(_ascii(column), F.regexp_replace(plain, r"^_+|_+$", "")).otherwise(_key_udf(F.when(~_ascii(column), column)))


def lookup_key(provider: Column, text: Column) -> Column:
    """provider::text with the provider as a key."""
    return F.concat(canonical_key(provider), F.lit("::"), text)


def script_hint(column: Column) -> Column:
    """kana before hangul before mixed Han and Latin before Han before Latin before other."""
    has = lambda chars: column.rlike(f"[{chars}]")
    return F.when(has(KANA), "kana").when(has(HANGUL), "hangul").when(has(HAN) & has(LATIN), "cjk+latin").when(has(HAN), "cjk").when(has(LATIN), "latin").otherwise("other")


def script_family(column: Column) -> Column:
    """All scripts of a text, joined with +; 'unknown' for null and empty texts, 'other' for texts in none of the scripts."""
    t = normalize(column)
    of = lambda chars, name: F.when(t.rlike(f"[{chars}]"), name)
    found = F.concat_ws("+", of(LATIN, "latin"), of(HAN, "cjk"), of(KANA, "kana"), of(HANGUL, "hangul"))
    return F.when(t.isNull() | (t == ""), "unknown").when(found == "", "other").otherwise(found)


def parenthetical(column: Column) -> Column:
    """outer and inner of ``outer(inner)`` or ``base_(context)``; inner is null without one."""
    inner = F.regexp_extract(column, r"^(.+?)_?\(([^()]+)\)$", 2)
    outer = F.regexp_extract(column, r"^(.+?)_?\(([^()]+)\)$", 1)
    return F.struct(F.when(inner != "", outer).otherwise(column).alias("outer"), F.when(inner != "", inner).alias("inner"))


def search_keys(column: Column) -> Column:
    """Variants of a key that a search also tries: spaces, tight brackets, the base name."""
    return F.array_distinct(F.array(column, F.replace(column, F.lit("_"), F.lit(" ")), F.replace(column, F.lit("_("), F.lit("(")), F.substring_index(column, "_(", 1)))


# Marks of counters.
COUNTER = "(?:users?入り|users?入|user入り)"


def popularity(column: Column) -> Column:
    """prefix and count of counters such as ``harbor500users入り``; null where there is none or no prefix."""
    t = normalize(column)
    pattern = rf"(?i)^(.+?)([0-9]+)\s*{COUNTER}$"
    n = F.regexp_extract(t, pattern, 2)
    return F.when(n != "", F.struct(normalize(F.regexp_extract(t, pattern, 1)).alias("prefix"), n.try_cast("int").alias("users")))


def rejection(column: Column) -> Column:
    """Why a text is no name: empty, address or path, rating, counter, description; null if it may be one."""
    t = normalize(column)
    return (
        F.when(t.isNull() | (t == ""), "empty_or_invalid")
        .when(t.rlike(r"[a-z][a-z0-9+.-]*://|^[a-zA-Z]:\\|^\\\\"), "url_or_path")
        .when(t.rlike(r"(?i)^(r-?18|r18g|nsfw)$"), "explicit_r18_meta")
        .when(t.rlike(rf"(?i)^(.+?[0-9]+\s*)?{COUNTER}$"), "popularity_meta")
        .when(canonical_key(column).isin(*DESCRIPTIVE_KEYS), "descriptive_general")
    )


def external_ids(column: Column) -> Column:
    """Distinct (work, page) of file names: 7 to 12 digits that stand alone, with an optional page mark."""
    hits = F.regexp_extract_all(column, F.lit(r"(?<!\d)(\d{7,12}(?:[_-]p\d+)?)(?!\d)"), F.lit(1))
    one = lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).alias("work"), F.when(x.rlike(r"p\d+$"), F.regexp_extract(x, r"p(\d+)$", 1).cast("int")).alias("page"))
    return F.array_distinct(F.transform(hits, one))


def work_id(column: Column) -> Column:
    """An id of digits without leading zeros; null for anything else."""
    t = F.trim(column)
    return F.when(t.rlike(r"^\d{1,18}$") & ~t.rlike("^0+$"), F.regexp_replace(t, "^0+", ""))


def short_key(column: Column) -> Column:
    """Whether a key, without outer underscores, is too short to identify anything alone: missing, up to 3 characters, or up to 7 without an underscore."""
    t = F.regexp_replace(column, "^_+|_+$", "")
    return F.coalesce((F.length(t) <= 3) | ((F.length(t) <= 7) & ~F.contains(t, F.lit("_"))), F.lit(True))


def bounded(column: Column, limit: int) -> Column:
    """A key part of at most ``limit`` characters; longer ones end in a hash of the whole."""
    return F.when(F.length(column) <= limit, column).otherwise(F.concat(F.substring(column, 1, limit - 17), F.lit(":"), F.substring(F.sha2(column, 256), 1, 16)))


def stable_hash(*columns: Column, length: int = 24) -> Column:
    """A hash of several values with their lengths, so neighbouring values never run together; null has its own mark."""
    part = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.substring(F.sha2(F.concat_ws("|", *map(part, columns)), 256), 1, length)


def pair_id(a: Column, b: Column) -> Column:
    """One id for a pair in either order."""
    return F.sha2(F.concat_ws("|", F.least(a, b), F.greatest(a, b)), 256)


def mapped(column: Column, table: dict[str, str] | dict[str, float], default: str | float | None) -> Column:
    """The entry of a column's value in a table of fixed size."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[column], F.lit(default))


def concept_status(column: Column, default: str = "needs_review") -> Column:
    """The state of a concept that a source's state asks for."""
    return mapped(F.lower(column), CONCEPT_STATUS, default)


def confidence_score(column: Column, fallback: float | None = None) -> Column:
    """A number as it stands, a grade as its fixed number, else the fallback."""
    return F.coalesce(column.cast("string").try_cast("double"), mapped(F.lower(column.cast("string")), GRADES, fallback))


def redacted(column: Column) -> Column:
    """Texts with paths, file names, addresses or secrets replaced by the reason."""
    t = F.lower(column)
    reason = (
        F.when(t.rlike(r"(api[_-]?key|token|password|secret|cookie)\s*[=:]"), "secret")
        .when(t.rlike(r"https?://|www\."), "url")
        .when(t.rlike(r"(^|[\s\"'(])(/[a-z0-9._-]+){2,}|[a-z]:\\\\"), "path")
        .when(t.rlike(r"\.(jpe?g|png|gif|webm|mp4|webp)([^a-z0-9_]|$)"), "filename")
    )
    return F.struct(reason.alias("reason"), F.when(reason.isNull(), column).otherwise(F.concat(F.lit("[redacted:"), reason, F.lit("]"))).alias("text"))


def aspect(width: Column, height: Column) -> Column:
    return F.try_divide(width.cast("double"), height)


def percent(part: Column, whole: Column) -> Column:
    return F.bround(F.try_divide(part * 100.0, whole), 2)


def ratio(part: Column, whole: Column) -> Column:
    return F.bround(F.try_divide(part.cast("double"), whole), 4)

"""Search plans: a parsed query to one DataFrame plan.

Tag terms become semi and anti joins on the edges of the named tags alone (all included names in one aggregate), counts are aggregated once for
all count predicates, and everything on media columns becomes filters that reach the scan of the cleaned table. Only the page of a result and
the ids of named tags are ever collected.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.library import Library
from tagloom.plans import search_language as L

CONTENT_CLASSES = ("anime", "illustration", "non_anime", "unknown")  # fixed values


def in_range(col: Column, found: L.Range) -> Column:
    """A comparison as a filter; equality with nothing is a test for null."""
    v = found.value
    if found.op == "between":
        return col.between(F.lit(v), F.lit(found.high))
    if found.op == "in":
        return col.isin(v)
    if found.op == "eq":
        return col.isNull() if v is None else col == F.lit(v)
    return {"ge": col >= F.lit(v), "le": col <= F.lit(v), "gt": col > F.lit(v), "lt": col < F.lit(v)}[found.op]


def with_all_tags(media: DataFrame, lib: Library, names: list[str]) -> DataFrame:
    """Media that have every named tag, suggestions included; an unknown name leaves nothing."""
    wanted = sorted(set(names))
    named = lib.edges_of(F.lower("name").isin(wanted), "name")
    has = [F.bool_or(F.lower("name") == name) for name in wanted]
    full = named.groupBy("media_id").agg(reduce(Column.__and__, has).alias("all")).filter("all")
    return media.join(full, media["id"] == full["media_id"], "left_semi")


def without_tags(media: DataFrame, lib: Library, names: list[str]) -> DataFrame:
    """Media with none of the named tags; unknown names change nothing."""
    hit = lib.edges_of(F.lower("name").isin(sorted(set(names))))
    return media.join(hit, media["id"] == hit["media_id"], "left_anti")


def by_wildcard(media: DataFrame, lib: Library, pattern: str, negated: bool) -> DataFrame:
    """Media with (or without) a confirmed tag whose name matches."""
    hit = lib.edges_of(F.col("name").rlike(L.wildcard(pattern))).filter("not is_suggestion")
    return media.join(hit, media["id"] == hit["media_id"], "left_anti" if negated else "left_semi")


def by_counts(media: DataFrame, lib: Library, wanted: dict[str, list[L.Range]]) -> DataFrame:
    """Numbers of confirmed tags, of any or one category; media without any count 0."""
    used = lib.edges.filter("not is_suggestion").select("media_id", "tag_id").join(lib.tags.select(F.col("id").alias("tag_id"), "category"), "tag_id")
    counts = [F.count_if(F.lit(True) if L.COUNTED[k] is None else F.coalesce(F.col("category") == L.COUNTED[k], F.lit(False))).alias(f"__{k}") for k in wanted]
    per_media = used.groupBy(F.col("media_id").alias("__media")).agg(*counts)
    joined = media.join(per_media, media["id"] == per_media["__media"], "left")
    tests = [in_range(F.coalesce(F.col(f"__{k}"), F.lit(0)), r) for k, ranges in wanted.items() for r in ranges if r.op != "in"]
    return joined.filter(reduce(Column.__and__, tests, F.lit(True))).drop("__media", *[f"__{k}" for k in wanted])


def _album_test(media: DataFrame, lib: Library, item: L.Meta) -> DataFrame:
    value, links = item.value, lib.album_media
    negated = item.negated
    if value in ("any", "none"):
        negated ^= value == "none"
    else:
        match = F.col("id") == int(value) if value.isdigit() else F.col("name").ilike(value.replace("_", " "))
        links = links.join(lib.albums.filter(match).select(F.col("id").alias("album_id")), "album_id", "left_semi")
    return media.join(links, media["id"] == links["media_id"], "left_anti" if negated else "left_semi")


def _on_media(query: L.Query, now: datetime) -> list[Column]:
    """All filters that need no other table."""
    out: list[Column] = []
    add = lambda cond, negated: out.append(~cond if negated else cond)
    for key in ("id", "width", "height", "duration"):
        for item in query.meta.get(key, []):
            try:
                found = L.parse_range(item.value, float if key == "duration" else int)
            except ValueError:
                continue
            add(in_range(F.col(key), found), item.negated)
    for item in query.meta.get("filesize", []):
        found = L.parse_size(item.value)
        if not item.negated:
            out.append(in_range(F.col("file_size"), found))
        elif found.op == "eq":
            out.append(F.col("file_size") != found.value)
    for item in query.meta.get("date", []):
        if not item.negated:
            out.append(in_range(F.to_date("uploaded_at"), L.parse_dates(item.value)))
    for item in query.meta.get("age", []):
        if not item.negated:
            out.append(in_range(F.col("uploaded_at"), L.parse_age(item.value, now)))
    for item in query.meta.get("rating", []):
        known = [L.RATINGS[v] for v in item.value.lower().split(",") if v in L.RATINGS]
        if known:
            add(F.col("rating").isin(known), item.negated)
    for item in query.meta.get("source", []):
        s = F.col("source")
        add(s.isNull() | (s == "") if item.value == "none" else s.startswith("http") if item.value == "http" else s.like(item.value + "%"), item.negated)
    for item in query.meta.get("md5", []):
        out.append(F.col("hash") == item.value)
    for item in query.meta.get("filetype", []):
        add(F.col("filename").ilike(f"%.{item.value}"), item.negated)
    for item in [*query.meta.get("class", []), *query.meta.get("content_class", [])]:
        value = item.value.lower()
        if value == "none" or value in CONTENT_CLASSES:
            add(F.col("content_class").isNull() if value == "none" else F.col("content_class") == value, item.negated)
    for item in query.meta.get("parent", []):
        p = F.col("parent_id")
        if item.value in ("none", "any"):
            out.append(p.isNull() if item.value == "none" else p.isNotNull())
        elif item.value.isdigit():
            out.append((p == int(item.value)) | (F.col("id") == int(item.value)))
    return out


def ceiling(rating: str | None, listing: bool = False) -> Column:
    """The rating limit of a request: searches read an unknown limit as 'questionable', listings as nothing."""
    if rating in (None, "explicit"):
        return F.lit(True)
    if rating == "safe":
        return F.col("rating") == "safe"
    if listing and rating != "questionable":
        return F.lit(False)
    return F.col("rating").isin("safe", "questionable")


def classes(value: str | None) -> Column:
    """A content-class list of a request; 'unknown' also takes media without a class, an invalid name is an error."""
    names = [v.strip() for v in (value or "").split(",") if v.strip()]
    if bad := [v for v in names if v not in CONTENT_CLASSES]:
        raise ValueError(f"unknown content class: {bad[0]}")
    if not names:
        return F.lit(True)
    found = F.col("content_class").isin(names)
    return found | F.col("content_class").isNull() if "unknown" in names else found


def select(lib: Library, query: L.Query, now: datetime, rating: str | None = None, content_class: str | None = None) -> DataFrame:
    """The media a query names, unordered."""
    media = lib.media.filter(reduce(Column.__and__, [*_on_media(query, now), ceiling(rating), classes(content_class)]))
    for item in query.meta.get("child", []):
        kids = lib.media.filter("parent_id is not null").select(F.col("parent_id").alias("__parent"))
        if item.value in ("none", "any"):
            media = media.join(kids, media["id"] == kids["__parent"], "left_anti" if item.value == "none" else "left_semi")
    for key in ("pool", "album"):
        for item in query.meta.get(key, []):
            media = _album_test(media, lib, item)
    wanted = {k: [L.parse_range(i.value, int) for i in query.meta[k] if not i.negated] for k in L.COUNTED if k in query.meta}
    if any(wanted.values()):
        media = by_counts(media, lib, wanted)
    if query.include:
        media = with_all_tags(media, lib, query.include)
    if query.exclude:
        media = without_tags(media, lib, query.exclude)
    for negated, pattern in query.wildcards:
        media = by_wildcard(media, lib, pattern, negated)
    return media


def order(query: L.Query, default: str = "id_desc") -> list[Column]:
    """The order of a query; nulls where PostgreSQL puts them, the id last so that pages are stable."""
    asked = [i.value for i in query.meta.get("order") or query.meta.get("sort") or []]  # order before sort, the last one counts
    name = asked[-1] if asked else default
    by_id = F.col("id").desc()
    aspect = F.try_divide(F.col("width").cast("double"), F.col("height"))
    if name == "custom":
        ids = [int(v) for i in query.meta.get("id", []) for v in i.value.split(",") if v.isdigit()]
        if ids:
            place = F.array_position(F.array(*map(F.lit, ids)), F.col("id"))
            return [F.when(place == 0, F.lit(len(ids) + 1)).otherwise(place).asc(), by_id]
        return [by_id]
    known = {
        "id": [by_id],
        "id_desc": [by_id],
        "id_asc": [F.col("id").asc()],
        "filesize": [F.col("file_size").desc_nulls_first(), by_id],
        "landscape": [aspect.desc_nulls_first(), by_id],
        "portrait": [aspect.asc_nulls_last(), by_id],
        "md5": [F.col("hash").asc_nulls_last(), by_id],
    }
    return known.get(name, [F.col("uploaded_at").desc_nulls_first(), by_id])


def page(found: DataFrame, keys: list[Column], limit: int, number: int = 1) -> DataFrame:
    """One page with its rank from 1; top-k instead of a full sort."""
    from pyspark.sql import Window as W

    top = found.orderBy(*keys).limit(number * limit)
    ranked = top.withColumn("position", F.row_number().over(W.orderBy(*keys)))  # at most number * limit rows are in this one window
    return ranked.filter(F.col("position") > (number - 1) * limit)


def posts(found: DataFrame, lib: Library, ids: list[int] | None = None) -> DataFrame:
    """Hits with their tags as space-separated strings per category, and parent and children flags; ``ids`` are those of the hits where they are known."""
    edges, kids = lib.edges.select("media_id", "tag_id"), lib.media.filter("parent_id is not null").select(F.col("parent_id").alias("__kid_of"))
    if ids is None:
        edges = edges.join(found.select(F.col("id").alias("media_id")), "media_id", "left_semi")
    else:
        edges, kids = edges.filter(F.col("media_id").isin(ids)), kids.filter(F.col("__kid_of").isin(ids))
    tagged = edges.join(lib.tags.select(F.col("id").alias("tag_id"), "name", "category"), "tag_id")
    of = lambda cond: F.concat_ws(" ", F.sort_array(F.collect_list(F.when(cond, F.col("name")))))
    strings = tagged.groupBy(F.col("media_id").alias("__media")).agg(
        of(F.lit(True)).alias("tag_string"), F.count("*").alias("tag_count"), *[of(F.col("category") == c).alias(f"tag_string_{c}") for c in ("general", "artist", "character", "copyright", "meta")]
    )
    kids = kids.groupBy("__kid_of").agg(F.count("*").alias("children"))
    out = found.join(strings, found["id"] == strings["__media"], "left").join(kids, found["id"] == kids["__kid_of"], "left").drop("__media", "__kid_of")
    texts = ["tag_string", *(f"tag_string_{c}" for c in ("general", "artist", "character", "copyright", "meta"))]
    return out.withColumns({**{c: F.coalesce(c, F.lit("")) for c in texts}, "tag_count": F.coalesce("tag_count", F.lit(0)), "has_children": F.col("children").isNotNull(), "has_parent": F.col("parent_id").isNotNull()}).drop("children")


def posts_page(hits: DataFrame, lib: Library) -> DataFrame:
    """The posts of one page. Its rows, bounded by the page, become a local table, so the search runs once and only their edges and children are read."""
    rows = hits.toArrow()
    return posts(hits.sparkSession.createDataFrame(rows, hits.schema), lib, rows.column("id").to_pylist())

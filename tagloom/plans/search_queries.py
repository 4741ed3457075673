"""Search queries (B1 to B25, B37, F1 to F6) and their oracle SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.library import Library, oracle
from tagloom.plans import search as S
from tagloom.plans import search_language as L

NOW = datetime(2025, 1, 1, tzinfo=timezone.utc)
_NAME = "select name from t where id = e.tag_id"
_CONFIRMED = "exists (select 1 from e join t on t.id = e.tag_id where e.media_id = m.id and not e.is_suggestion and {})"
_HAS = "exists (select 1 from e join t on t.id = e.tag_id where e.media_id = m.id and t.name = '{}')"
_COUNT = "(select count(*) from e join t on t.id = e.tag_id where e.media_id = m.id and not e.is_suggestion {})"

#: name: (search text, other arguments, SQL condition over m)
_SEARCHES = {
    "b08_tags_included": ("lantern_set harbor_lantern", {}, f"{_HAS.format('lantern_set')} and {_HAS.format('harbor_lantern')}"),
    "b08_unknown_tag": ("lantern_set no_such_tag_anywhere", {}, "false"),
    "b09_tags_excluded": ("clockwork_lantern -lantern_set -no_such_tag", {}, f"{_HAS.format('clockwork_lantern')} and not {_HAS.format('lantern_set')}"),
    "b10_wildcards": ("harbor* -*lantern*", {}, f"{_CONFIRMED.format("t.name ilike 'harbor%'")} and not {_CONFIRMED.format("t.name ilike '%lantern%'")}"),
    "b10_wildcard_brackets": ("*_(station) ?arbor_lantern", {}, f"{_CONFIRMED.format("t.name like '%!_(station)' escape '!'")} and {_CONFIRMED.format("regexp_matches(t.name, '^.?arbor_lantern$')")}"),
    "b11_numbers": ("id:100..2000 width:>=500 -height:<400 duration:..30", {}, "id between 100 and 2000 and width >= 500 and not (height < 400) and duration <= 30"),
    "b12_filesize": ("filesize:200kb..2mb", {}, "file_size between 204800 and 2097152"),
    "b12_filesize_fuzzy": ("filesize:1mb -filesize:5", {}, "file_size between 1048576 and 2097151 and file_size <> 5"),
    "b13_dates": ("date:2023-01-01..2023-06-30 -date:2023-02-02", {}, "cast(uploaded_at at time zone 'UTC' as date) between date '2023-01-01' and date '2023-06-30'"),
    "b13_bad_date": ("date:yesterday", {}, "uploaded_at is null"),
    "b13_age": ("age:<2y age:1mo..20mo", {}, "uploaded_at > timestamptz '2025-01-01 00:00:00+00' - interval 730 days and uploaded_at between timestamptz '2025-01-01 00:00:00+00' - interval 600 days and timestamptz '2025-01-01 00:00:00+00' - interval 30 days"),
    "b14_ratings": ("rating:q,e -rating:explicit rating:nonsense", {}, "rating in ('questionable', 'explicit') and not rating in ('explicit')"),
    "b15_source_http": ("source:http -source:https://art", {}, "source like 'http%' and not source like 'https://art%'"),
    "b15_source_none": ("source:none", {}, "source is null or source = ''"),
    "b16_md5": ("md5:8faf08b91e27de8d8763693e75ca2fa6 -md5:x", {}, "hash = '8faf08b91e27de8d8763693e75ca2fa6' and hash = 'x'"),
    "b17_filetype": ("filetype:png", {}, "filename ilike '%.png'"),
    "b17_filetype_not": ("-filetype:jpg -filetype:png", {}, "not filename ilike '%.jpg' and not filename ilike '%.png'"),
    "b18_class": ("class:anime -content_class:non_anime class:bogus", {}, "content_class = 'anime' and not content_class = 'non_anime'"),
    "b18_class_none": ("class:none", {}, "content_class is null"),
    "b19_pool_any": ("pool:any id:..500", {}, "id <= 500 and exists (select 1 from album_media a where a.media_id = m.id)"),
    "b19_all_pool_any": ("pool:any", {}, "exists (select 1 from album_media a where a.media_id = m.id)"),
    "b19_album_named": ("-album:customer#00000001% pool:none", {}, "not exists (select 1 from album_media a join albums b on b.id = a.album_id where a.media_id = m.id and b.name ilike 'customer#00000001%') and not exists (select 1 from album_media a where a.media_id = m.id)"),
    "b20_parent": ("parent:any rating:s", {}, "parent_id is not null and rating = 'safe'"),
    "b20_parent_id": ("parent:1556", {}, "parent_id = 1556 or id = 1556"),
    "b21_children": ("child:any parent:none", {}, "parent_id is null and exists (select 1 from m k where k.parent_id = m.id)"),
    "b21_childless": ("child:none rating:e", {}, "rating = 'explicit' and not exists (select 1 from m k where k.parent_id = m.id)"),
    "b22_tag_counts": ("tagcount:2..6 chartags:>=1 gentags:<5 arttags:..3 copytags:0 metatags:0..2", {}, " and ".join([
        f"{_COUNT.format('')} between 2 and 6", f"{_COUNT.format("and category = 'character'")} >= 1", f"{_COUNT.format("and category = 'general'")} < 5",
        f"{_COUNT.format("and category = 'artist'")} <= 3", f"{_COUNT.format("and category = 'copyright'")} = 0", f"{_COUNT.format("and category = 'meta'")} between 0 and 2",
    ])),
    "b24_content_classes": ("", {"content_class": "illustration,unknown"}, "content_class in ('illustration', 'unknown') or content_class is null"),
    "b25_rating_ceiling": ("lantern_set", {"rating": "medium"}, f"{_HAS.format('lantern_set')} and rating in ('safe', 'questionable')"),
}


def _search(text: str, extra: dict):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.select(Library(spark, sf_dir), L.parse(text), NOW, **extra).select("id", "rating", "file_type")

    return run


#: name: (search text, SQL condition, SQL order, page size, page)
_ORDERED = {
    "f01_newest": ("rating:s order:whatever", "rating = 'safe'", "uploaded_at desc nulls first, id desc", 20, 1),
    "f01_filesize": ("order:filesize", "true", "file_size desc nulls first, id desc", 30, 1),
    "f01_landscape": ("filetype:png order:id order:landscape", "filename ilike '%.png'", "width / nullif(height, 0)::double desc nulls first, id desc", 25, 1),
    "f01_portrait": ("sort:portrait", "true", "width / nullif(height, 0)::double asc nulls last, id desc", 25, 2),
    "f01_md5": ("order:md5", "true", "hash asc nulls last, id desc", 25, 1),
    "f02_custom": ("id:30,10,20,777 order:custom", "id in (30, 10, 20, 777)", "list_position([30, 10, 20, 777], id), id desc", 10, 1),
    "f06_third_page": ("*lantern* order:id_asc", _CONFIRMED.format("t.name ilike '%lantern%'"), "id asc", 20, 3),
}


def _ordered(text: str, limit: int, number: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query = L.parse(text)
        return S.page(S.select(Library(spark, sf_dir), query, NOW), S.order(query), limit, number).select("position", "id")

    return run


_FLAGSHIP = "*lantern* -harbor_lantern rating:s filesize:50kb.. tagcount:2..20 order:filesize"


def entry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenizer, wildcard semi join, anti join, ranges, counts, order, page and tag strings in one plan."""
    lib, query = Library(spark, sf_dir), L.parse(_FLAGSHIP)
    hits = S.page(S.select(lib, query, NOW), S.order(query), 50)
    return S.posts_page(hits, lib).select("position", "id", "file_size", "tag_count", "tag_string", "tag_string_character", "has_children", "has_parent")


def b37_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every questionable medium as a post record."""
    lib = Library(spark, sf_dir)
    out = S.posts(S.select(lib, L.parse("rating:q"), NOW), lib)
    return out.select("id", F.col("hash").alias("md5"), F.regexp_extract("filename", r"\.([^.]+)$", 1).alias("ext"), "tag_count", "tag_string", "tag_string_general", "tag_string_artist", "tag_string_character", "tag_string_copyright", "tag_string_meta", "has_children", "has_parent")


_STRINGS = """s as (select e.media_id, count(*) as tag_count, string_agg(name, ' ' order by name) as tag_string, {} from e join t on t.id = e.tag_id group by 1)""".format(
    ", ".join(f"coalesce(string_agg(name, ' ' order by name) filter (category = '{c}'), '') as tag_string_{c}" for c in ("general", "artist", "character", "copyright", "meta"))
)
_FLAGS = "exists (select 1 from m k where k.parent_id = {0}.id) as has_children, {0}.parent_id is not null as has_parent"
_HIT = " and ".join([_CONFIRMED.format("t.name ilike '%lantern%'"), f"not {_HAS.format('harbor_lantern')}", "rating = 'safe'", "file_size >= 51200", f"{_COUNT.format('')} between 2 and 20"])

QUERIES = {
    "entry_search": entry_search,
    **{k: _search(text, extra) for k, (text, extra, _) in _SEARCHES.items()},
    **{k: _ordered(text, limit, number) for k, (text, _, _, limit, number) in _ORDERED.items()},
    "b37_posts": b37_posts,
}
ORACLE = {
    "entry_search": oracle(
        f"select position, h.id, file_size, coalesce(tag_count, 0) as tag_count, coalesce(tag_string, '') as tag_string, coalesce(tag_string_character, '') as tag_string_character, {_FLAGS.format('h')} from h left join s on s.media_id = h.id where position <= 50",
        _STRINGS, f"h as (select *, row_number() over (order by file_size desc nulls first, id desc) as position from m where {_HIT})",
    ),
    **{k: oracle(f"select id, rating, file_type from m where {cond}") for k, (_, _, cond) in _SEARCHES.items()},
    **{k: oracle(f"select position, id from h where position > {(p - 1) * n} and position <= {p * n}", f"h as (select id, row_number() over (order by {by}) as position from m where {cond})") for k, (_, cond, by, n, p) in _ORDERED.items()},
    "b37_posts": oracle(
        f"select m.id, hash as md5, regexp_extract(filename, '\\.([^.]+)$', 1) as ext, coalesce(tag_count, 0) as tag_count, coalesce(tag_string, '') as tag_string, {', '.join(f"coalesce(tag_string_{c}, '') as tag_string_{c}" for c in ('general', 'artist', 'character', 'copyright', 'meta'))}, {_FLAGS.format('m')} from m left join s on s.media_id = m.id where rating = 'questionable'",
        _STRINGS,
    ),
}

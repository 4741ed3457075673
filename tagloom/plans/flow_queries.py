"""Sync, streaming, scoring and exchange queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators import scoring as M, stats, sync as L
from tagloom.plans.registry import registry
from tagloom.sources import exchange as X
from tagloom.streaming import library as ST

QUERIES, ORACLE, query = registry()

_CUT = "2024-01-16"
_SNAP = """old as (select path_id, file_size, mtime from (select *, row_number() over (partition by path_id order by mtime desc, event_id desc) as r from sync_items where mtime < timestamp '2024-01-16') where r = 1),
now as (select path_id, file_size, mtime from (select *, row_number() over (partition by path_id order by mtime desc, event_id desc) as r from sync_items where mtime >= timestamp '2024-01-16') where r = 1)"""
_DIFF = """df as (select coalesce(o.path_id, n.path_id) as path_id, case when n.path_id is null then '{}' when o.path_id is null then 'new' when o.file_size = n.file_size and o.mtime = n.mtime then 'unchanged' else 'changed' end as state, coalesce(n.file_size, o.file_size) as file_size, coalesce(n.mtime, o.mtime) as mtime from old o full join now n on o.path_id = n.path_id)"""


def _snapshots(lib):
    items = lib.sync_items
    keep = lambda part: L.snapshot(part, "path_id", ["mtime", "event_id"])
    return keep(items.filter(F.col("mtime") < _CUT)), keep(items.filter(F.col("mtime") >= _CUT))


def _diff(lib, complete=True):
    return L.diff(*_snapshots(lib), "path_id", complete)


@query("l01_snapshot_diff", "select path_id, state, file_size from df", _SNAP, _DIFF.format("missing"))
def _(lib):
    return _diff(lib).select("path_id", "state", "file_size")


@query("l02_partial_scan", "select state, count(*) as n from df group by 1", _SNAP, _DIFF.format("deferred"))
def _(lib):
    return _diff(lib, complete=False).groupBy("state").agg(F.count("*").alias("n"))


@query("l03_cascade", "select path_id, case when state in ('new', 'changed') then 'pending' when state = 'missing' then 'blocked' else 'done' end as import_status, case when state in ('new', 'changed') then 'waiting' when state = 'missing' then 'blocked' else 'done' end as ai_status from df", _SNAP, _DIFF.format("missing"))
def _(lib):
    return L.cascade(_diff(lib)).select("path_id", "import_status", "ai_status")


@query("l04_watermark", "select strftime(max(mtime) - interval 2 hours, '%Y-%m-%d %H:%M:%S') as watermark from df where state <> 'missing'", _SNAP, _DIFF.format("missing"))
def _(lib):
    return L.high_watermark(_diff(lib), "2 hours").select(F.date_format("watermark", "yyyy-MM-dd HH:mm:ss").alias("watermark"))


@query("l05_work_order", "select path_id, position from (select path_id, row_number() over (order by case state when 'missing' then 95 when 'changed' then 10 when 'new' then 5 when 'unchanged' then 30 else 35 end, path_id) as position from df) where position <= 100", _SNAP, _DIFF.format("missing"))
def _(lib):
    from tagloom.plans import search

    return search.page(_diff(lib), [L.priority().asc(), F.asc("path_id")], 100).select("path_id", "position")


@query("l06_lifecycle", """select id, case when path is null or hash is null then 'broken' when coalesce(file_size, 0) <= 0 then 'placeholder' when content_class is null then 'follow_up' when content_class = 'unknown' then 'retryable' when parent_id is not null and content_class_confidence < 0.7 then 'continuation'
  when content_class_confidence < 0.5 then 'version_pending' else 'complete' end as step from m""")
def _(lib):
    return L.lifecycle(lib.media)


@query("l08_import_dedupe", "select hash, min(id) as id from media where hash is not null and hash not in (select hash from m where rating = 'explicit') group by 1")
def _(lib):
    return L.import_new(lib.media.filter("rating = 'explicit'"), lib.raw("media"))


@query("l09_run_ledger", "select state, count(*) as n, sum(file_size)::bigint as bytes, count(*) > 50 as above_limit from df group by 1", _SNAP, _DIFF.format("missing"))
def _(lib):
    return _diff(lib).groupBy("state").agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"), (F.count("*") > 50).alias("above_limit"))


@query("d21_pending_summary", "select state, case when state in ('new', 'changed') then 'pending' when state = 'missing' then 'blocked' else 'done' end as import_status, count(*) as n from df group by 1, 2", _SNAP, _DIFF.format("missing"))
def _(lib):
    return L.cascade(_diff(lib)).groupBy("state", "import_status").agg(F.count("*").alias("n"))


@query("d34_runtime_estimate", "select round(sum(case when state in ('new', 'changed') then 0.5 + file_size / 10000.0::double else 0.01 end), 4) as seconds from df", _SNAP, _DIFF.format("missing"))
def _(lib):
    cost = F.when(F.col("state").isin("new", "changed"), 0.5 + F.col("file_size") / F.lit(10000.0)).otherwise(0.01)
    return _diff(lib).agg(F.round(F.sum(cost), 4).alias("seconds"))


@query("l11_work_claim", "select id from m where not exists (select 1 from e where media_id = m.id and trim(lower(source)) = 'ai_wd') and content_class = 'anime' order by id limit 25")
def _(lib):
    ai = lib.edges.filter(F.trim(F.lower("source")) == "ai_wd").select(F.col("media_id").alias("id"))
    return lib.media.filter("content_class = 'anime'").join(ai, "id", "left_anti").orderBy("id").limit(25).select("id")


@query("l12_candidate_manifest", "select id, path from m where file_type = 'image' and id not in (select media_id from signals where media_id is not null) order by file_size desc nulls last, id limit 500")
def _(lib):
    used = lib.raw("signals").select(F.col("media_id").alias("id"))
    return lib.media.filter("file_type = 'image'").join(used, "id", "left_anti").orderBy(F.desc_nulls_last("file_size"), "id").limit(500).select("id", "path")


@query("l13_reconcile", "select path_id, case when n.path_id is null then 'missing' when o.path_id is null then 'extra' when o.file_size <> n.file_size then 'size_mismatch' end as problem from old o full join now n using (path_id) where n.path_id is null or o.path_id is null or o.file_size <> n.file_size", _SNAP)
def _(lib):
    old, now = _snapshots(lib)
    return L.reconcile(old, now, "path_id")


@query("l14_mutations", "select * from (values ('concepts', 'allowed'), ('signals', 'unchanged'), ('links', 'forbidden')) v(\"table\", verdict)")
def _(lib):
    """Fingerprints of three tables before and after a change to two, only one of which may change."""
    marks = lambda **t: [f.withColumn("table", F.lit(n)) for n, f in t.items()]
    union = lambda parts: parts[0].unionByName(parts[1]).unionByName(parts[2])
    c, s, l = lib.raw("concepts"), lib.raw("signals"), lib.raw("signal_links")
    before = marks(concepts=stats.fingerprint(c, "id", "status"), signals=stats.fingerprint(s, "id", "status"), links=stats.fingerprint(l, "id", "link_status"))
    after = marks(concepts=stats.fingerprint(c.filter("status <> 'superseded'"), "id", "status"), signals=stats.fingerprint(s, "id", "status"), links=stats.fingerprint(l.withColumn("link_status", F.lit("active")), "id", "link_status"))
    return L.mutations(union(before), union(after), ["concepts"])


# Streaming forms; extensions beyond the reference are named x


def _stream(lib):
    return ST.read_events(lib.spark, f"{lib.folder}/events.parquet", lib.raw("events").schema)


@query("l01_streaming_states", "select path_id, event_id, case when p is null then 'new' when ps = file_size and p = mtime then 'unchanged' else 'changed' end as state from (select path_id, event_id, file_size, mtime, lag(mtime) over w as p, lag(file_size) over w as ps from sync_items window w as (partition by path_id order by mtime, event_id))")
def _(lib):
    """L1 as a stateful stream over all observations."""
    items = _stream(lib).select(F.col("user_id").alias("path_id"), F.floor(F.col("value") * 100).cast("bigint").alias("file_size"), F.col("ts").alias("mtime"), "event_id")
    return ST.run_available(ST.file_states(items), "l01")


@query("x01_tumbling_windows", "select strftime(time_bucket(interval 6 hours, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def _(lib):
    out = ST.run_available(ST.windowed_counts(_stream(lib), "6 hours", late="60 days"), "x01", "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


@query("x02_sliding_windows", "select strftime(s, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from (select *, unnest([time_bucket(interval 6 hours, ts), time_bucket(interval 6 hours, ts) - interval 6 hours]) as s from events) group by 1, 2")
def _(lib):
    out = ST.run_available(ST.windowed_counts(_stream(lib), "12 hours", "6 hours", late="60 days"), "x02", "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


@query("x03_sessions", "select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g') as start, count(*) as n from (select *, sum(fresh) over (partition by user_id order by ts, event_id) as s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 2 hours then 0 else 1 end as fresh from events)) group by user_id, s")
def _(lib):
    out = ST.run_available(ST.sessions(_stream(lib), "2 hours", late="60 days"), "x03", "complete")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSS").alias("start"), "n")


@query("x04_streaming_dedupe", "select distinct event_id from events")
def _(lib):
    return ST.run_available(ST.distinct_events(_stream(lib), "event_id", "60 days").select("event_id"), "x04")


# Scoring


_SC = "sc as (select e.media_id, e.tag_id, category, e.confidence as score from e join t on t.id = tag_id where e.confidence is not null)"


def _scores(lib):
    return lib.edges.filter("confidence is not null").join(lib.tags.select(F.col("id").alias("tag_id"), "category"), "tag_id").select("media_id", "tag_id", "category", F.col("confidence").alias("score"))


@query("m02_predicted_tags", "select media_id, tag_id from sc where score >= case category when 'character' then 0.85 else 0.35 end", _SC)
def _(lib):
    return M.predicted(_scores(lib)).select("media_id", "tag_id")


@query("m02_best_tags", "select media_id, category, tag_id, rank from (select *, row_number() over (partition by media_id, category order by score desc, tag_id) as rank from sc) where rank <= 3", _SC)
def _(lib):
    return M.best_per_group(_scores(lib), 3).select("media_id", "category", "tag_id", "rank")


@query("m03_actions", "select category, case when score >= case category when 'general' then 0.35 when 'character' then 0.65 else 0.5 end then 'confirm' when score >= 0.2 then 'suggest' else 'drop' end as action, count(*) as n from sc group by 1, 2", _SC)
def _(lib):
    return M.actions(_scores(lib)).groupBy("category", "action").agg(F.count("*").alias("n"))


@query("m04_class_by_tags", "select media_id, case when count(*) filter (score >= 0.5) >= 5 then 'anime' when count(*) filter (score >= 0.5) = 0 then 'unknown' else 'undecided' end as content_class from sc group by 1", _SC)
def _(lib):
    return M.class_by_tags(_scores(lib))


@query("m05_zero_shot", """select vec_id, case when a - b >= 0.005 then best end as label, round(least(1.0, (a - b) / 0.15), 6) as confidence from (select vec_id, max(c) as a, list_sort(list(c), 'desc')[2] as b, arg_max(label, (c, label)) as best from
  (select v.vec_id, k.label, list_cosine_similarity(v.embedding::double[], k.c) as c from embeddings v, (select label, list(x order by i) as c from (select label, i, avg(x) as x from (select label, unnest(embedding::double[]) as x, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by 1, 2) group by 1) k) group by 1)""")
def _(lib):
    v = lib.raw("embeddings")
    return M.zero_shot(v, M.centroids(v))


# Exchange


_AL = "al as (select target_tag_id, list_sort(list(alias_name)) as a from tag_aliases group by 1)"


@query("a10_csv_export", "select t.id, name || ',' || case category when 'artist' then 1 when 'copyright' then 3 when 'character' then 4 when 'meta' then 5 else 0 end || ',' || post_count || ',' || case when len(a) > 1 then '\"' || array_to_string(a, ',') || '\"' else coalesce(array_to_string(a, ','), '') end as line from t left join al on target_tag_id = t.id", _AL)
def _(lib):
    return X.export_tags(lib)


@query("a11_json_dump", "select t.id, '{\"name\":\"' || name || '\",\"category\":\"' || coalesce(category, 'general') || '\",\"aliases\":[' || coalesce('\"' || array_to_string(a, '\",\"') || '\"', '') || ']}' as json from t left join al on target_tag_id = t.id", _AL)
def _(lib):
    return X.dump_tags(lib)


@query("a12_restore", "select name, category from (select name, coalesce(category, 'general') as category from t) where name not in (select name from t where category = 'general')")
def _(lib):
    """A dump of all tags restored into a store that holds the general ones."""
    return X.restore_tags(X.dump_tags(lib), lib.tags.filter("category = 'general'"))


@query("a08_csv_import", "select name, category from (select name, coalesce(category, 'general') as category from t) where name not in (select name from t where category = 'artist')")
def _(lib):
    """The exported file imported into a store of artists only: tags to insert."""
    parts = F.regexp_extract_all("line", F.lit(r'("[^"]*"|[^,]*)(?:,|$)'), F.lit(1))
    rows = X.export_tags(lib).select(parts[0].alias("name"), parts[1].alias("code"), parts[2].alias("count"), F.regexp_replace(parts[3], '"', "").alias("aliases"))
    return X.import_tags(rows, lib.tags.filter("category = 'artist'"), lib.tag_aliases.limit(0))[0]


@query("a13_restore_media", "select hash, id from m where hash not in (select hash from m where rating = 'safe')")
def _(lib):
    return lib.media.join(lib.media.filter("rating = 'safe'").select("hash"), "hash", "left_anti").select("hash", "id")


@query("a14_restore_albums", "select name, m.id as media_id from albums a join album_media x on x.album_id = a.id join m on m.id = x.media_id")
def _(lib):
    """Album links by name and hash, as a dump holds them."""
    links = lib.album_media.join(lib.albums, F.col("album_id") == F.col("id")).select("name", "media_id").join(lib.media.select(F.col("id").alias("media_id"), "hash"), "media_id").select("name", "hash")
    none = lib.albums.limit(0)
    return X.restore_albums(lib.albums, links, lib.album_hierarchy.select(F.col("parent_album_id").alias("parent"), F.col("child_album_id").alias("child")), none, lib.media)[1]


@query("a03_admissible", "select reason, count(*) as n from (select case when starts_with(filename, '.') then 'hidden' when lower(regexp_extract(filename, '\\.([^.]+)$', 1)) not in ('jpg', 'jpeg', 'png', 'gif', 'webp', 'webm', 'mp4') then 'unsupported_extension' when file_size is null then 'stat_error' when file_size = 0 then 'zero_byte_file' when file_size > 536870912 then 'too_large' end as reason from m) group by 1")
def _(lib):
    """A3 to A5 over the library's own files: reasons and their counts, no content read."""
    return X.admissible(lib.media.select("path", F.col("file_size").alias("length"))).groupBy("reason").agg(F.count("*").alias("n"))


@query("a06_untracked", "select path from m where path not in (select path from m where rating = 'safe') and filename not in (select filename from m where rating = 'safe')")
def _(lib):
    files = X.admissible(lib.media.select("path", F.coalesce("file_size", F.lit(1)).alias("length")))
    return X.untracked(files, lib.media.filter("rating = 'safe'")).select("path")


@query("a17_provider_pages", "select source_work_id as work, source_page_index as page, count(*) as n, count(distinct (title, artist_name)) > 1 as conflict from source_metadata_records group by 1, 2")
def _(lib):
    r = lib.raw("source_metadata_records").select(F.col("source_work_id").alias("work"), F.col("source_page_index").alias("page"), "title", F.col("artist_name").alias("artist"))
    return X.provider_pages(r).select("work", "page", "n", "conflict")


@query("a21_report_checksum")
def _(lib):
    return X.checksum(lib.raw("concepts").select("id", "status", "concept_key"))

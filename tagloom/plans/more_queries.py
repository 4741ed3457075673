"""The remaining inventory: small joins, set operations, listings, store actions and plans, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import text as T
from tagloom.operators import evidence as V, soft_search as S, sync as L, tagstore as G
from tagloom.plans import flow_queries
from tagloom.plans.function_queries import key_sql
from tagloom.plans.registry import registry
from tagloom.plans.store_queries import _ACT, _REVIEWED, _actions
from tagloom.sources import exchange as X

QUERIES, ORACLE, query = registry()


@query("a01_pruned_scan", "select id, hash from media where rating = 'explicit' and file_size > 100000")
def _(lib):
    """Two columns and a filter that both reach the Parquet scan."""
    return lib.raw("media").filter("rating = 'explicit' and file_size > 100000").select("id", "hash")


@query("a04_skip_counters", "select coalesce(case when lower(regexp_extract(filename, '\\.([^.]+)$', 1)) not in ('jpg', 'jpeg', 'png', 'gif', 'webp', 'webm', 'mp4') then 'unsupported' when file_size is null or file_size = 0 then 'unreadable' end, 'importable') as counter, count(*) as n, sum(file_size)::bigint as bytes from m group by 1")
def _(lib):
    """A4 and A5: reasons mapped to counters before any file is read."""
    files = X.admissible(lib.media.select("path", F.col("file_size").alias("length")))
    counter = F.coalesce(T.mapped(F.col("reason"), {"unsupported_extension": "unsupported", "zero_byte_file": "unreadable", "stat_error": "unreadable"}, "other"), F.lit("other"))
    return files.groupBy(F.when(F.col("reason").isNull(), "importable").otherwise(counter).alias("counter")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


@query("a09_strict_import", "select name, coalesce(category, 'general') as category from t where name in (select name from t join tag_aliases on target_tag_id = t.id)")
def _(lib):
    """Only rows with all four columns, into an empty store."""
    rows = lib.tags.join(lib.tag_aliases.groupBy(F.col("target_tag_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("alias_name")), ",").alias("aliases")), "id", "left")
    code = F.coalesce(F.create_map(*[F.lit(x) for k, v in X.CODES.items() for x in (v, str(k))])[F.col("category")], F.lit("0"))
    return X.import_tags(rows.select("name", code.alias("code"), F.col("post_count").cast("string").alias("count"), "aliases"), lib.tags.limit(0), lib.tag_aliases.limit(0), strict=True)[0]


@query("a19_reverse_dictionary", "select lower(display_name) as text, min(canonical_name) as name from tag_translations where source = 'static' group by 1")
def _(lib):
    return lib.tag_translations.filter("source = 'static'").groupBy(F.lower("display_name").alias("text")).agg(F.min("canonical_name").alias("name"))


@query("b26_term_resolution", "select a, case when n = 1 then target else a end as resolved from (select lower(alias) as a, count(distinct canonical_name) as n, min(canonical_name) as target from tag_translations where status <> 'rejected' and source in ('manual', 'static') group by 1)")
def _(lib):
    """Terms that lead to exactly one canonical name are replaced by it."""
    trusted = lib.tag_translations.filter("status <> 'rejected' and source in ('manual', 'static')").groupBy(F.lower("alias").alias("a")).agg(F.count_distinct("canonical_name").alias("n"), F.min("canonical_name").alias("target"))
    return trusted.select("a", F.when(F.col("n") == 1, F.col("target")).otherwise(F.col("a")).alias("resolved"))


_TRUSTED = """trusted as (select lower(unnest([display_name, alias])) as alias, canonical_name, case source when 'manual' then 0 when 'static' then 1 when 'llm' then 2 when 'imported' then 3 else 99 end as p from tag_translations
  where status <> 'rejected' and (coalesce(category, '') not in ('artist', 'character', 'copyright') or source in ('manual', 'static') or (status = 'reviewed' and not needs_review))),
  best as (select distinct alias, canonical_name from trusted x where p = (select min(p) from trusted y where y.alias = x.alias)), asked as (select distinct unnest([upper(alias), display_name, replace(alias, '_', ' ')]) as term from tag_translations)"""


@query("b26_trusted_terms", f"select term, case when n = 1 then target else term end as resolved from (select term, count(distinct canonical_name) as n, min(canonical_name) as target from (select term, canonical_name from asked left join best on lower(term) = alias union all select term, canonical_name from asked join best on {key_sql('term')} = {key_sql('alias')}) group by 1)", _TRUSTED)
def _(lib):
    """All spellings of all translations, resolved by the trusted ones alone."""
    t = lib.tag_translations
    asked = t.select(F.explode(F.array(F.upper("alias"), "display_name", F.replace("alias", F.lit("_"), F.lit(" ")))).alias("term"))
    return S.resolve_terms(asked, t)


@query("b28_like_literals", "select id, name from t where contains(name, '_(') or contains(name, '%')")
def _(lib):
    return lib.tags.filter(S.like(F.col("name"), "_(") | S.like(F.col("name"), "%")).select("id", "name")


@query("c04_tags_in_use", "select id, name from t where exists (select 1 from e where tag_id = t.id and not is_suggestion)")
def _(lib):
    return lib.tags.join(lib.edges.filter("not is_suggestion"), F.col("id") == F.col("tag_id"), "left_semi").select("id", "name")


@query("c06_cooccurrence", "select y.tag_id, count(*) as n from e x join e y on x.media_id = y.media_id join t on t.id = x.tag_id and t.name = 'clockwork_lantern' group by 1")
def _(lib):
    """The self join starts from the rows of one tag."""
    start = lib.tags.filter("name = 'clockwork_lantern'").select(F.col("id").alias("tag_id"))
    media = lib.edges.join(F.broadcast(start), "tag_id", "left_semi").select("media_id")
    return lib.edges.join(media, "media_id").groupBy("tag_id").agg(F.count("*").alias("n"))


@query("c08_scalar_counts", "select id, (select count(*) from e where media_id = m.id and not is_suggestion) as n_tags, (select max(confidence) from e where media_id = m.id) as best from m")
def _(lib):
    counts = lib.edges.groupBy(F.col("media_id").alias("id")).agg(F.count_if(~F.col("is_suggestion")).alias("n"), F.max("confidence").alias("best"))
    return lib.media.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_tags"), "best")


@query("c10_hash_lookup", "select r.id, m.hash from source_metadata_records r join m on m.id = r.media_id")
def _(lib):
    return lib.raw("source_metadata_records").select("id", "media_id").join(lib.media.select(F.col("id").alias("media_id"), "hash"), "media_id").select("id", "hash")


@query("c11_block_pairs", "select a.id as a, b.id as b from signals a join signals b on a.source_metadata_record_id = b.source_metadata_record_id and a.id < b.id")
def _(lib):
    """Pairs inside the blocks of one record; a block is as large as a record has signals."""
    s = lib.raw("signals").filter("source_metadata_record_id is not null").select("id", "source_metadata_record_id")
    return s.select(F.col("id").alias("a"), "source_metadata_record_id").join(s.select(F.col("id").alias("b"), "source_metadata_record_id"), "source_metadata_record_id").filter("a < b").select("a", "b")


@query("e02_total_with_page", "select id, (select count(*) from m where rating = 'questionable') as total from m where rating = 'questionable' order by id limit 30")
def _(lib):
    """A page with the total, which is counted beside it instead of in one window over all rows."""
    hits = lib.media.filter("rating = 'questionable'")
    total = hits.count()
    return hits.orderBy("id").limit(30).select("id", F.lit(total).cast("bigint").alias("total"))


@query("f07_most_used", "select id, name from t order by post_count desc, id limit 15")
def _(lib):
    return lib.tags.orderBy(F.desc("post_count"), "id").limit(15).select("id", "name")


@query("f09_merged_autocomplete", """select name, how from (select name, min(how) as how, max(post_count) as post_count from (select name, 0 as how, post_count from tag_aliases join t on t.id = target_tag_id where alias_name = 'old_harbor_lantern' union all select name, 1, post_count from t where starts_with(name, 'harbor_l') and id % 3 <> 0 union all select name, 2, post_count from t where starts_with(name, 'harbor_l')) group by 1) order by how, post_count desc, name limit 10""")
def _(lib):
    """An exact alias first, then local names, then those only the shared store has; each name once."""
    alias = lib.tag_aliases.filter("alias_name = 'old_harbor_lantern'").select(F.col("target_tag_id").alias("id")).join(lib.tags, "id").select("name", F.lit(0).alias("how"), "post_count")
    shared = lib.tags.filter(F.startswith("name", F.lit("harbor_l")))
    rows = alias.union(shared.filter("id % 3 <> 0").select("name", F.lit(1), "post_count")).union(shared.select("name", F.lit(2), "post_count"))
    return rows.groupBy("name").agg(F.min("how").alias("how"), F.max("post_count").alias("p")).orderBy("how", F.desc("p"), "name").limit(10).select("name", "how")


@query("g02_identity_or_fallback", "select media_id from signals where normalized_key = 'mibelmi_lanebo_julpidir' and media_id is not null union select media_id from source_metadata_records r join source_assertions a on a.source_metadata_record_id = r.id where canonical_name_key = 'mibelmi_lanebo_julpidir' and media_id is not null")
def _(lib):
    own = lib.raw("signals").filter("normalized_key = 'mibelmi_lanebo_julpidir' and media_id is not null").select("media_id")
    fallback = lib.raw("source_assertions").filter("canonical_name_key = 'mibelmi_lanebo_julpidir'").select("source_metadata_record_id").join(S._records(lib), "source_metadata_record_id").select("media_id")
    return own.union(fallback).distinct()


@query("h10_counters", "select id from signals where regexp_matches(display_value, '^.*[0-9]{2,6}users入り$')")
def _(lib):
    return lib.raw("signals").filter(T.popularity(F.col("display_value")).isNotNull()).select("id")


@query("h18_entity_keys")
def _(lib):
    """NFKC, lower case, white space as underscores."""
    return lib.raw("concepts").select("id", F.regexp_replace(F.lower(T.normalize(F.col("primary_display_name"))), " ", "_").alias("entity_key"))


@query("h26_value_lists", "select event_id, [cast(k as varchar)] as vals from (select event_id, json_extract_string(props, '$.k') as k from events) where k is not null")
def _(lib):
    """A JSON value as a list of texts, whether it is one value or a list."""
    v = F.get_json_object("props", "$.k")
    listed = F.when(F.startswith(v, F.lit("[")), F.from_json(v, "array<string>")).otherwise(F.array(v))
    return lib.raw("events").filter(v.isNotNull()).select("event_id", listed.alias("vals"))


@query("i05_rejected_tags", f"select e.media_id, e.tag_id from e where not exists (select 1 from r where r.media_id = e.media_id and r.tag_id = e.tag_id)", _ACT, f"r as ({_REVIEWED})")
def _(lib):
    """What rejecting and deleting take away."""
    return lib.edges.select("media_id", "tag_id").join(G.review(lib.edges, _actions(lib)), ["media_id", "tag_id"], "left_anti")


@query("i18_new_entities", "select asserted_role as entity_type, canonical_name_key as normalized_key, min(raw_input) as name from source_assertions where canonical_name_key <> '' and status <> 'rejected' and not exists (select 1 from concepts c where c.concept_type_hint = asserted_role and split_part(concept_key, ':', 1) = canonical_name_key) group by 1, 2")
def _(lib):
    have = lib.raw("concepts").select(F.col("concept_type_hint").alias("entity_type"), F.substring_index("concept_key", ":", 1).alias("normalized_key"))
    new = lib.raw("source_assertions").filter("canonical_name_key <> '' and status <> 'rejected'").select(F.col("asserted_role").alias("entity_type"), F.col("canonical_name_key").alias("normalized_key"), F.col("raw_input").alias("name"))
    return G.create_entities(have, new)


@query("i20_candidate_decisions", "select media_id, entity_id, role, case when c > 0.8 then 'accepted' when c < 0.4 then 'rejected' else 'open' end as status from (select s.media_id, l.concept_id as entity_id, s.role_hint as role, max(l.confidence) as c from signal_links l join signals s on s.id = l.signal_id where s.media_id is not null and l.concept_id is not null group by 1, 2, 3)")
def _(lib):
    links = lib.raw("signal_links").filter("concept_id is not null").select("signal_id", F.col("concept_id").alias("entity_id"), "confidence")
    s = lib.raw("signals").filter("media_id is not null").select(F.col("id").alias("signal_id"), "media_id", F.col("role_hint").alias("role"))
    rows = links.join(s, "signal_id").groupBy("media_id", "entity_id", "role").agg(F.max("confidence").alias("c"))
    decided = rows.filter("c > 0.8 or c < 0.4").select("media_id", "entity_id", "role", (F.col("c") > 0.8).alias("accept"))
    return G.decide_candidates(rows.select("media_id", "entity_id", "role", F.lit("open").alias("status")), decided)[0]


@query("i22_shares", "select id, md5('share:' || id) as share_key from m where rating = 'safe' and content_class = 'anime'")
def _(lib):
    """Shared media get a key that stays the same for a medium."""
    return lib.media.filter("rating = 'safe' and content_class = 'anime'").select("id", F.md5(F.concat(F.lit("share:"), F.col("id").cast("string"))).alias("share_key"))


@query("k04_registry_bundle")
def _(lib):
    """Names of all record fields with variants, records and roles, one row per key."""
    names = V.record_names(lib.raw("source_metadata_records"))
    return names.groupBy("name_key").agg(F.sort_array(F.collect_set("raw_name")).alias("variants"), F.count("*").alias("seen_count"), F.sort_array(F.collect_set("role")).alias("roles"), F.bool_or("requires_review").alias("review"))


@query("k06_candidates")
def _(lib):
    """Texts to units, units to hints, hints back to all rows of their unit, with assertion and record."""
    return V.candidates(lib.raw("source_assertions"))


@query("l07_sync_plan", "select state, case when state = 'missing' then 95 when state = 'changed' then 10 when state = 'new' then 5 when state = 'unchanged' then 30 else 35 end as priority, case when state in ('new', 'changed') then 'pending' when state = 'missing' then 'blocked' else 'done' end as import_status, count(*) as n from df group by 1, 2, 3", flow_queries._SNAP, flow_queries._DIFF.format("missing"))
def _(lib):
    """Diff, cascade and priority put together."""
    plan = L.cascade(flow_queries._diff(lib)).withColumn("priority", L.priority())
    return plan.groupBy("state", "priority", "import_status").agg(F.count("*").alias("n"))


@query("n_media_detail", "select m.id, p.id as parent, (select list_sort(list(id)) from m k where k.parent_id = m.id) as children, (select count(*) from album_media a where a.media_id = m.id) as n_albums from m left join m p on p.id = m.parent_id where m.rating = 'explicit'")
def _(lib):
    """Detail of explicit media: parent, children and albums."""
    return _detail(lib, lib.media.filter("rating = 'explicit'"))


@query("n_all_media_detail", "select m.id, p.id as parent, k.children, coalesce(a.n, 0) as n_albums from m left join m p on p.id = m.parent_id left join (select parent_id, list_sort(list(id)) as children from m group by 1) k on k.parent_id = m.id left join (select media_id, count(*) as n from album_media group by 1) a on a.media_id = m.id")
def _(lib):
    return _detail(lib, lib.media)


def _detail(lib, media):
    hits = media.select("id", "parent_id")
    kids = lib.media.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("children"))
    albums = lib.album_media.groupBy(F.col("media_id").alias("id")).agg(F.count("*").alias("n"))
    parent = lib.media.select(F.col("id").alias("parent_id"), F.col("id").alias("parent"))
    return hits.join(kids, "id", "left").join(albums, "id", "left").join(parent, "parent_id", "left").select("id", "parent", "children", F.coalesce("n", F.lit(0)).alias("n_albums"))

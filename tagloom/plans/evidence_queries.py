"""Soft search, source evidence and queue queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators import evidence as V, resolve as R, soft_search as S
from tagloom.operators.stats import top_per_group
from tagloom.plans.function_queries import key_sql
from tagloom.plans.registry import registry
from tagloom.session import Scratch

QUERIES, ORACLE, query = registry()

_TERM, _TERM2 = "mibelmi lanebo julpidir", "harbor_lantern"


_ALIASES = f"""rel as (select alias_name as x, name as y from tag_aliases join t on t.id = target_tag_id union all select display_name, canonical_name from tag_translations where status <> 'rejected' union all select a, b from name_aliases),
  sym as (select {key_sql('x')} as a, {key_sql('y')} as b from rel union select {key_sql('y')}, {key_sql('x')} from rel)"""


def _hops(name: str, key: str) -> str:
    """Keys that two steps of the alias relation reach."""
    return f"{name} as (select b as k from sym where a = '{key}' union select y.b from sym x join sym y on x.b = y.a where x.a = '{key}')"


def _five(term: str, key: str, review: bool = False, hops: str = "hops") -> str:
    says = "('searchable_active', 'needs_review')" if review else "('searchable_active')"
    is_on = "('active', 'needs_review')" if review else "('active')"
    spaced = key.replace("_", " ")
    names = f"('{term}', '{key}', '{spaced}')"
    return f"""(select media_id from e join t on t.id = tag_id where not is_suggestion and (lower(name) in {names} or starts_with(lower(name), '{key}_(') or name in (select canonical_name from tag_translations where status <> 'rejected' and (lower(display_name) in {names} or lower(alias) in {names})))
  union select r.media_id from source_assertions s join source_metadata_records r on r.id = s.source_metadata_record_id where r.media_id is not null and s.status in {says} and (lower(raw_input) = '{term}' or lower(normalized_input) = '{term}' or canonical_name_key = '{key}')
  union select media_id from signals where origin_type = 'source_tag_observation' and normalized_key = '{key}' and status <> 'rejected' and media_id is not null
  union select g.media_id from concepts c join signal_links l on l.concept_id = c.id join signals g on g.id = l.signal_id where c.status in {is_on} and l.link_status in ('active', 'materialized_identity') and l.negative_reason_code is null and g.media_id is not null and (lower(primary_display_name) = '{term}' or split_part(concept_key, ':', 1) = '{key}')
  union select media_id from e join t on t.id = tag_id where not is_suggestion and {key_sql('name')} in (select k from {hops} where k <> '{key}')
  union select r.media_id from source_assertions s join source_metadata_records r on r.id = s.source_metadata_record_id where r.media_id is not null and s.status in {says} and canonical_name_key in (select k from {hops} where k <> '{key}'))"""


_KEY = "mibelmi_lanebo_julpidir"


@query("b31_soft_search", f"select id from m where id in {_five(_TERM, _KEY)}", _ALIASES, _hops("hops", _KEY))
def _(lib):
    return S.search(lib, [_TERM], []).select("id")


@query("b31_soft_search_excluded", f"select id from m where id in {_five(_TERM2, _TERM2)} and id not in {_five('lantern_set', 'lantern_set', hops='gone')}", _ALIASES, _hops("hops", _TERM2), _hops("gone", "lantern_set"))
def _(lib):
    return S.search(lib, [_TERM2], ["lantern_set"]).select("id")


@query("b31_soft_search_with_review", f"select id from m where id in {_five(_TERM, _KEY, True)}", _ALIASES, _hops("hops", _KEY))
def _(lib):
    return S.search(lib, [_TERM], [], review=True).select("id")


# tag 15 of every size has an alias and a nickname that stands for the alias

@query("b31_soft_search_two_hops", f"select distinct media_id as id from e join m on m.id = media_id join t on t.id = tag_id where not is_suggestion and {key_sql('name')} in (select y.b from sym x join sym y on x.b = y.a where x.a = (select {key_sql("'nick_' || name")} from t where id = 15))", _ALIASES)
def _(lib):
    """A nickname that only leads to a tag by way of another alias."""
    name = lib.tags.filter("id = 15").first()["name"]
    return S.search(lib, [f"nick_{name}"], []).select("id")


@query("b30_source_filter", f"select id from m where id in (select r.media_id from source_assertions s join source_metadata_records r on r.id = s.source_metadata_record_id where s.status = 'searchable_active' and canonical_name_key = '{_KEY}')")
def _(lib):
    return S.source_filter(lib.media, lib, [_TERM], []).select("id")


@query("b32_concept_media", "select c.id as concept_id, count(distinct g.media_id) as n_media from concepts c join signal_links l on l.concept_id = c.id join signals g on g.id = l.signal_id where c.status = 'active' and l.link_status in ('active', 'materialized_identity') and l.negative_reason_code is null and g.media_id is not null group by 1")
def _(lib):
    links = lib.raw("signal_links").filter(F.col("link_status").isin(*S.ACTIVE_LINKS) & F.col("negative_reason_code").isNull()).select("concept_id", "signal_id")
    media = lib.raw("signals").filter("media_id is not null").select(F.col("id").alias("signal_id"), "media_id")
    on = lib.raw("concepts").filter("status = 'active'").select(F.col("id").alias("concept_id"))
    return links.join(on, "concept_id", "left_semi").join(media, "signal_id").select("concept_id", "media_id").distinct().groupBy("concept_id").agg(F.count("*").alias("n_media"))


@query("b33_query_expansions", f"select id, primary_display_name from concepts where status = 'active' and (lower(primary_display_name) = '{_TERM}' or split_part(concept_key, ':', 1) = '{_KEY}') order by confidence_score desc, id limit 8")
def _(lib):
    return S.concepts_named(lib, _TERM).orderBy(F.desc("confidence_score"), "id").limit(8).select("id", "primary_display_name")


@query("b34_review_hints", "select id, primary_display_name from concepts c where status = 'needs_review' and not exists (select 1 from concepts a where a.status = 'active' and a.primary_display_name = c.primary_display_name)")
def _(lib):
    c = lib.raw("concepts")
    return c.filter("status = 'needs_review'").join(c.filter("status = 'active'").select("primary_display_name"), "primary_display_name", "left_anti").select("id", "primary_display_name")


@query("b35_suggestions", "select media_id, tag_id, name, confidence from (select e.media_id, e.tag_id, name, confidence, row_number() over (order by confidence desc, e.media_id, e.tag_id) as r from e join t on t.id = tag_id join m on m.id = media_id where is_suggestion and confidence between 0.2 and 0.8 and name ilike '%lantern%') where r <= 50")
def _(lib):
    rows = lib.edges.filter("is_suggestion and confidence between 0.2 and 0.8").join(lib.tags.filter(S.like(F.col("name"), "lantern")).select(F.col("id").alias("tag_id"), "name"), "tag_id").join(lib.media.select(F.col("id").alias("media_id")), "media_id", "left_semi")
    return rows.orderBy(F.desc("confidence"), "media_id", "tag_id").limit(50).select("media_id", "tag_id", "name", "confidence")


@query("b36_entity_list", "select c.id, primary_display_name, count(distinct l.signal_id) filter (link_status = 'materialized_identity') as confirmed from concepts c left join signal_links l on l.concept_id = c.id where primary_display_name ilike '%ma%' group by 1, 2")
def _(lib):
    c = lib.raw("concepts").filter(S.like(F.col("primary_display_name"), "ma")).select("id", "primary_display_name")
    n = lib.raw("signal_links").filter("link_status = 'materialized_identity'").select(F.col("concept_id").alias("id"), "signal_id").distinct().groupBy("id").agg(F.count("signal_id").alias("confirmed"))
    return c.join(n, "id", "left").select("id", "primary_display_name", F.coalesce("confirmed", F.lit(0)).alias("confirmed"))


@query("b27_tag_names", "select pos, id, name from (select unnest([3, 1, 2]) as pos, unnest(['lantern_set', 'clockwork_lantern', 'harbor_lantern']) as n) join t on name = n")
def _(lib):
    """Tags by name, in the order asked for."""
    asked = lib.spark.createDataFrame([(1, "clockwork_lantern"), (2, "harbor_lantern"), (3, "lantern_set")], "pos int, name string")
    return F.broadcast(asked).join(lib.tags, "name").select("pos", "id", "name")


@query("b39_translation_list", "select canonical_name, display_name, source from tag_translations where language = 'zh' and source = 'llm' and not needs_review and (canonical_name ilike '%lantern%' or display_name ilike '%lantern%') order by canonical_name desc limit 20")
def _(lib):
    t = lib.tag_translations.filter("language = 'zh' and source = 'llm' and not needs_review")
    return t.filter(S.like(F.col("canonical_name"), "lantern") | S.like(F.col("display_name"), "lantern")).orderBy(F.desc("canonical_name")).limit(20).select("canonical_name", "display_name", "source")


@query("b40_job_targets", "select id from m where (content_class in ('anime', 'unknown') or content_class is null) and not exists (select 1 from e where media_id = m.id and trim(lower(source)) = 'ai_wd') order by id limit 200")
def _(lib):
    from tagloom.plans.search import classes

    ai = lib.edges.filter(F.trim(F.lower("source")) == "ai_wd").select(F.col("media_id").alias("id"))
    return lib.media.filter(classes("anime,unknown")).join(ai, "id", "left_anti").orderBy("id").limit(200).select("id")


# Evidence


@query("k01_record_names")
def _(lib):
    return V.record_names(lib.raw("source_metadata_records"))


@query("k02_applicability", """select id as record_id, list_filter([case when trim(artist_name) <> '' then 'artist' end, case when trim(title) <> '' then 'source_title' end], lambda x: x is not null) as roles, coalesce(trim(artist_name) <> '', false) as applicable,
  case when coalesce(trim(artist_name) <> '', false) then 'has_artist' else 'title_only' end as reason from source_metadata_records where trim(artist_name) <> '' or trim(title) <> ''""")
def _(lib):
    return V.applicability(V.record_names(lib.raw("source_metadata_records")))


@query("k03_best_alias", "select signal_id, concept_id, confidence, id from (select *, row_number() over (partition by signal_id, concept_id order by confidence desc nulls last, id) as r from signal_links) where r = 1")
def _(lib):
    return V.best_alias(lib.raw("signal_links"), ["signal_id", "concept_id"])


@query("k05_name_index", "select distinct canonical_name_key as search_key, canonical_name_key as name_key, 'own' as via from source_assertions where canonical_name_key <> '' union select 'old_' || name, name, 'alias' from (select alias_name, name from tag_aliases join t on t.id = target_tag_id) where name in (select canonical_name_key from source_assertions) and alias_name = 'old_' || name")
def _(lib):
    names = lib.raw("source_assertions").filter("canonical_name_key <> ''").select(F.col("canonical_name_key").alias("name_key")).distinct()
    pairs = lib.tag_aliases.filter(F.startswith("alias_name", F.lit("old_"))).join(lib.tags.select(F.col("id").alias("target_tag_id"), "name"), "target_tag_id").select(F.col("alias_name").alias("a"), F.col("name").alias("b"))
    return V.name_index(names, pairs)


@query("k05_all_name_index", "select distinct canonical_name_key as search_key, canonical_name_key as name_key, 'own' as via from source_assertions where canonical_name_key <> '' union select x, y, 'alias' from (select alias_name as x, name as y from tag_aliases join t on t.id = target_tag_id union all select name, alias_name from tag_aliases join t on t.id = target_tag_id) where y in (select canonical_name_key from source_assertions where canonical_name_key <> '')")
def _(lib):
    """The index over every alias of the tags."""
    names = lib.raw("source_assertions").filter("canonical_name_key <> ''").select(F.col("canonical_name_key").alias("name_key")).distinct()
    pairs = lib.tag_aliases.join(lib.tags.select(F.col("id").alias("target_tag_id"), "name"), "target_tag_id").select(F.col("alias_name").alias("a"), F.col("name").alias("b"))
    return V.name_index(names, pairs)


_K7 = """k7 as (select 'media_tag:' || media_id || ':' || tag_id as signal_key, case when coalesce(trim(lower(e.source)) = 'ai_wd', false) then 'ai_model_tag' else 'normal_media_tag' end as origin_type, name as raw_value, case category when 'artist' then 'artist' when 'copyright' then 'work' else 'character' end as role_hint,
  case when coalesce(trim(lower(e.source)) = 'ai_wd', false) and is_suggestion then 'weak' when coalesce(trim(lower(e.source)) = 'ai_wd', false) then 'medium_ai' else 'strong' end as trust_tier, case when coalesce(trim(lower(e.source)) = 'ai_wd', false) then 'needs_review' else 'active' end as status from e join t on t.id = tag_id where category in ('artist', 'character', 'copyright') or contains(name, '_(')
  union all select 'assertion:' || id, 'source_assertion', raw_input, asserted_role, case when status = 'searchable_active' and asserted_role not in ('unknown', 'source_title') then 'strong' else 'medium' end, case when status = 'rejected' then 'rejected' when asserted_role = 'source_title' then 'needs_review' else 'active' end from source_assertions where trim(raw_input) <> ''
  union all select 'field:' || id || ':artist_name', 'provider_structured_field', artist_name, 'artist', 'medium', 'needs_review' from source_metadata_records where trim(artist_name) <> '' union all select 'field:' || id || ':title', 'provider_structured_field', title, 'source_title', 'weak', 'needs_review' from source_metadata_records where trim(title) <> '')"""


@query("k07_signals", "select signal_key, origin_type, raw_value, role_hint, trust_tier, case when regexp_matches(raw_value, '^.*[0-9]{2,6}users入り$') then 'rejected' else status end as status from k7", _K7)
def _(lib):
    return V.signals_of(lib).select("signal_key", "origin_type", "raw_value", "role_hint", "trust_tier", "status")


@query("k07_clashing_keys", "select signal_key, count(distinct (origin_type, raw_value, role_hint)) as n from k7 group by 1 having count(distinct (origin_type, raw_value, role_hint)) > 1", _K7)
def _(lib):
    return V.clashing_keys(V.signals_of(lib))


@query("k25_work_pages", """select source_work_id, n_records, pages, titles, artists, media, case when artists > 1 then 'artist_conflict' when titles > 1 then 'title_conflict' when media = 0 then 'no_media' when last_page + 1 > pages then 'pages_missing' else 'consistent' end as state from
  (select source_work_id, count(*) as n_records, count(distinct source_page_index) as pages, count(distinct title) as titles, count(distinct artist_name) as artists, count(distinct media_id) as media, max(source_page_index) as last_page from source_metadata_records where source_work_id is not null and status <> 'rejected' group by 1)""")
def _(lib):
    return V.work_pages(lib.raw("source_metadata_records"))


@query("k26_work_signals", """select source_work_id, state, min(artist_name) as raw_value, count(distinct media_id) as media, case state when 'consistent' then 'active' else 'needs_review' end as status from source_metadata_records r join (select source_work_id, case when titles > 1 then 'title_conflict' when media = 0 then 'no_media' when last_page + 1 > pages then 'pages_missing' else 'consistent' end as state from
  (select source_work_id, count(distinct source_page_index) as pages, count(distinct title) as titles, count(distinct artist_name) as artists, count(distinct media_id) as media, max(source_page_index) as last_page from source_metadata_records where source_work_id is not null and status <> 'rejected' group by 1) where artists = 1) using (source_work_id) where artist_name is not null and r.status <> 'rejected' and state <> 'no_media' group by 1, 2""")
def _(lib):
    r = lib.raw("source_metadata_records")
    return V.work_signals(r, V.work_pages(r))


@query("k27_clusters", "select concept_id, count(distinct signal_id) as n_signals, list_sort(list(distinct run_id)) as runs from signal_links where concept_id is not null and link_status in ('active', 'materialized_identity') group by 1")
def _(lib):
    l = lib.raw("signal_links").filter(F.col("concept_id").isNotNull() & F.col("link_status").isin(*S.ACTIVE_LINKS))
    return l.groupBy("concept_id").agg(F.count_distinct("signal_id").alias("n_signals"), F.sort_array(F.collect_set("run_id")).alias("runs"))


@query("k24_materialized", "select s.id as signal_id, coalesce(min(l.concept_id), -1) as concept_id from signals s left join (select l.* from signal_links l join concepts c on c.id = l.concept_id and c.status = 'active' where link_status in ('active', 'materialized_identity')) l on l.signal_id = s.id group by 1")
def _(lib):
    """Every signal labelled with its first active concept, -1 without one."""
    on = lib.raw("concepts").filter("status = 'active'").select(F.col("id").alias("concept_id"))
    l = lib.raw("signal_links").filter(F.col("link_status").isin(*S.ACTIVE_LINKS)).join(on, "concept_id", "left_semi").groupBy("signal_id").agg(F.min("concept_id").alias("c"))
    return lib.raw("signals").select(F.col("id").alias("signal_id")).join(l, "signal_id", "left").select("signal_id", F.coalesce("c", F.lit(-1)).alias("concept_id"))


@query("k28_creator_stars", """select canonical_name_key as name_key, f as first, r as other, case when provider = fp then 'must' else 'deferred' end as relation from (select distinct canonical_name_key, source_metadata_record_id as r, provider from source_assertions where source_metadata_record_id is not null and asserted_role = 'artist' and canonical_name_key <> '' and status <> 'rejected') x
  join (select canonical_name_key, min((source_metadata_record_id, provider)) as mf, min(source_metadata_record_id) as f from source_assertions where asserted_role = 'artist' and canonical_name_key <> '' and status <> 'rejected' group by 1) y using (canonical_name_key)
  join (select canonical_name_key, source_metadata_record_id as f, min(provider) as fp from source_assertions where asserted_role = 'artist' and canonical_name_key <> '' and status <> 'rejected' group by 1, 2) z using (canonical_name_key, f) where r > f""")
def _(lib):
    return V.star_candidates(lib.raw("source_assertions"))


@query("k29_purity", "select concept_id, sum(c)::bigint as n, count(*) as labels, round(max(c) / sum(c), 6) as purity from (select concept_id, normalized_key, count(*) as c from signal_links l join signals s on s.id = l.signal_id where concept_id is not null and normalized_key is not null group by 1, 2) group by 1")
def _(lib):
    l = lib.raw("signal_links").filter("concept_id is not null").select("concept_id", F.col("signal_id").alias("id"))
    return V.purity(l.join(lib.raw("signals").select("id", "normalized_key"), "id"), "concept_id", "normalized_key")


@query("k30_binding_freshness", "select l.id, l.run_id = last as fresh from signal_links l join (select signal_id, max(run_id) as last from signal_links where run_id is not null group by 1) x using (signal_id) where l.run_id is not null")
def _(lib):
    """A link is fresh while no later run has linked its signal again."""
    l = lib.raw("signal_links").filter("run_id is not null").select("id", "signal_id", "run_id")
    last = l.groupBy("signal_id").agg(F.max("run_id").alias("last"))
    return l.join(last, "signal_id").select("id", (F.col("run_id") == F.col("last")).alias("fresh"))


@query("k31_duplicates", """select hash, id, parent_id, n, keep_rank, list_filter([case when low <> high then 'size_differs' end, case when parents then 'has_parent' end], lambda x: x is not null) as risks, keep_rank > 1 and not (low is distinct from high) and not parents as eligible from
  (select hash, id, parent_id, count(*) over w as n, row_number() over (partition by hash order by content_class_confidence desc nulls last, file_size desc nulls last, id, parent_id nulls last) as keep_rank, min(file_size) over w as low, max(file_size) over w as high, bool_or(parent_id is not null) over w as parents from d window w as (partition by hash)) where n > 1""",
       "d as (select distinct id, hash, file_size, parent_id, content_class_confidence from media)")
def _(lib):
    """All distinct exported states; states of one file make up duplicates."""
    return V.duplicates(lib.raw("media").select("id", "hash", "file_size", "parent_id", "content_class_confidence").distinct(), "parent_id")


@query("k32_targets", "select id, case when status = 'rejected' then 'rejected' when status = 'superseded' then 'superseded' when media_id is null then 'no_media' when title is null and artist_name is null then 'no_names' when coalesce(similarity < 50, false) then 'low_similarity' end as reason from source_metadata_records")
def _(lib):
    return V.exclusion(lib.raw("source_metadata_records"))


@query("k33_media_view", """select media_id, count(*) as n_signals, count(distinct normalized_key) as n_keys, count(*) filter (not exists (select 1 from e join t on t.id = tag_id where e.media_id = s.media_id and t.name = s.normalized_key)) as not_tagged from signals s where media_id is not null group by 1""")
def _(lib):
    s = lib.raw("signals").filter("media_id is not null").select("media_id", "normalized_key")
    tagged = lib.edges.select("media_id", "tag_id").join(lib.tags.select(F.col("id").alias("tag_id"), F.col("name").alias("normalized_key")), "tag_id").select("media_id", "normalized_key").distinct().withColumn("tagged", F.lit(True))
    return s.join(tagged, ["media_id", "normalized_key"], "left").groupBy("media_id").agg(F.count("*").alias("n_signals"), F.count_distinct("normalized_key").alias("n_keys"), F.count_if(F.col("tagged").isNull()).alias("not_tagged"))


@query("k34_promotion_preview", "select canonical_name_key, n from (select canonical_name_key, count(*) as n, row_number() over (order by count(*) desc, canonical_name_key) as r from source_assertions where status = 'needs_review' and canonical_name_key <> '' group by 1) where r <= 50")
def _(lib):
    rows = lib.raw("source_assertions").filter("status = 'needs_review' and canonical_name_key <> ''")
    return rows.groupBy("canonical_name_key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "canonical_name_key").limit(50)


@query("k35_search_symmetry", """select a.normalized_key as key, case when len(a.media) = len(list_intersect(a.media, b.media)) and len(a.media) = len(b.media) then 'equal' when len(b.media) > 3 * len(a.media) and len(b.media) > len(a.media) + 10 then 'over_broad' when len(a.media) = len(list_intersect(a.media, b.media)) then 'subset' else 'differs' end as relation
  from (select normalized_key, list(distinct media_id) as media from signals where media_id is not null and normalized_key is not null group by 1) a
  join (select s.canonical_name_key as normalized_key, list(distinct media_id) as media from source_assertions s join source_metadata_records r on r.id = s.source_metadata_record_id where media_id is not null and canonical_name_key <> '' group by 1) b using (normalized_key)""")
def _(lib):
    """Whether a name finds the same media by its signals as by its assertions."""
    a = lib.raw("signals").filter("media_id is not null and normalized_key is not null").select(F.col("normalized_key").alias("key"), "media_id").distinct()
    b = lib.raw("source_assertions").filter("canonical_name_key <> ''").select(F.col("canonical_name_key").alias("key"), "source_metadata_record_id").join(S._records(lib), "source_metadata_record_id").select("key", "media_id").distinct()
    both = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), ["key", "media_id"], "full").groupBy("key").agg(F.count("x").alias("a"), F.count("y").alias("b"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("ab")).filter("a > 0 and b > 0")
    relation = F.when((F.col("a") == F.col("ab")) & (F.col("a") == F.col("b")), "equal").when((F.col("b") > 3 * F.col("a")) & (F.col("b") > F.col("a") + 10), "over_broad").when(F.col("a") == F.col("ab"), "subset").otherwise("differs")
    return both.select("key", relation.alias("relation"))


@query("k36_concept_summary", """select concept_id, rank, normalized_key, n from (select concept_id, normalized_key, count(*) as n, row_number() over (partition by concept_id order by count(*) desc, normalized_key) as rank from signal_links l join signals s on s.id = l.signal_id where concept_id is not null and normalized_key is not null group by 1, 2) where rank <= 12""")
def _(lib):
    l = lib.raw("signal_links").filter("concept_id is not null").select("concept_id", F.col("signal_id").alias("id"))
    n = l.join(lib.raw("signals").filter("normalized_key is not null").select("id", "normalized_key"), "id").groupBy("concept_id", "normalized_key").agg(F.count("*").alias("n"))
    return top_per_group(n, "concept_id", [F.desc("n"), F.asc("normalized_key")], 12).select("concept_id", "rank", "normalized_key", "n")


@query("k37_review_scores")
def _(lib):
    s, e, _ = R.resolved(lib.raw("signals"), Scratch(lib.spark, "k37"))
    return V.pair_scores(s, e.filter("status = 'needs_review'"))


@query("k38_judged_edges")
def _(lib):
    """Judgments (here: a score of at least 8 is a same, one below 0 a different) as edges; a same never overrides a hard negative."""
    s, e, _ = R.resolved(lib.raw("signals"), Scratch(lib.spark, "k38"))
    judged = V.pair_scores(s, e.filter("status = 'needs_review'")).filter("score >= 8 or score < 0")
    hard = e.filter(F.col("negative").isin(*R.HARD)).select("l_id", "r_id").distinct()
    same = judged.filter("score >= 8").join(hard, ["l_id", "r_id"], "left_anti").select("l_id", "r_id", F.lit("llm_must_link").alias("edge_type"), F.lit(0.9).alias("weight"))
    return same.unionByName(judged.filter("score < 0").select("l_id", "r_id", F.lit("llm_cannot_link").alias("edge_type"), F.lit(0.0).alias("weight")))


@query("k39_queue_decisions", """select m.id, case when works is null then 'not_applicable' when works > 1 then 'conflict' when w in (select source_work_id from source_metadata_records where status = 'observed' and title is not null and artist_name is not null) then 'complete' else 'pending' end as decision
  from m left join (select media_id, count(distinct (source_work_id, source_page_index)) as works, min(source_work_id) as w from source_metadata_records where media_id is not null and source_work_id is not null and status <> 'rejected' group by 1) r on r.media_id = m.id""")
def _(lib):
    return V.queue_decisions(lib.media, lib.raw("source_metadata_records"))


_STATE = "st as (select source_work_id, media_id, case when status = 'rejected' then 'terminal' when status = 'superseded' then 'deferred' when media_id is null then 'pending' when title is null or artist_name is null then 'retryable' else 'complete' end as state from source_metadata_records where source_work_id is not null)"


@query("k40_work_queue", "select distinct source_work_id from st where state in ('pending', 'retryable') and source_work_id not in (select source_work_id from (select source_work_id from source_metadata_records where source_work_id is not null and status <> 'rejected' group by 1 having count(distinct artist_name) > 1))", _STATE)
def _(lib):
    r = lib.raw("source_metadata_records")
    clash = V.work_pages(r).filter("state = 'artist_conflict'").select("source_work_id")
    return V.record_state(r).filter("state in ('pending', 'retryable')").join(clash, "source_work_id", "left_anti").select("source_work_id").distinct()


@query("k41_lifecycle", "select source_work_id, ['conflict', 'retryable', 'pending', 'deferred', 'terminal', 'complete'][min(list_position(['conflict', 'retryable', 'pending', 'deferred', 'terminal', 'complete'], state))] as state from st group by 1", _STATE)
def _(lib):
    return V.lifecycle(lib.raw("source_metadata_records"))


@query("k42_batch_closure", "select count(*) as n_works, count(*) filter (done) as closed, count(*) filter (no_media) as without_media, bool_and(done) and count(*) filter (no_media) = 0 as batch_closed from (select source_work_id, bool_and(state in ('complete', 'terminal', 'deferred')) as done, bool_and(media_id is null) as no_media from st group by 1)", _STATE)
def _(lib):
    g = V.record_state(lib.raw("source_metadata_records")).groupBy("source_work_id").agg(F.bool_and(F.col("state").isin("complete", "terminal", "deferred")).alias("done"), F.bool_and(F.col("media_id").isNull()).alias("no_media"))
    return g.agg(F.count("*").alias("n_works"), F.count_if("done").alias("closed"), F.count_if("no_media").alias("without_media"), (F.bool_and("done") & (F.count_if("no_media") == 0)).alias("batch_closed"))


@query("k43_hints")
def _(lib):
    return V.hints(lib.raw("source_assertions"))


_UNIT = "coalesce(case when regexp_matches(raw_input, '^.*[0-9]{2,6}users入り$') then regexp_extract(raw_input, '^(.*?)[ _]*([0-9]{2,6})users入り$', 1) end, lower(trim(raw_input)))"


@query("k44_extraction_units", f"select {_UNIT} as unit, provider, asserted_role as role, count(*) as occurrences, count(*) - 1 as calls_avoided, min(id) as first_id from source_assertions where raw_input is not null and regexp_matches(raw_input, '^[ -~]*$') group by 1, 2, 3")
def _(lib):
    """Units of the texts in ASCII only, whose lower case is the same in both engines; k44_all_units has all texts."""
    return V.unit_keys(lib.raw("source_assertions").filter(F.col("raw_input").rlike("^[ -~]*$")))


@query("k44_all_units")
def _(lib):
    """Units of all texts, whatever their script."""
    return V.unit_keys(lib.raw("source_assertions"))


@query("k45_best_candidates", "select canonical_name_key, id, score from (select canonical_name_key, id, round(coalesce(confidence_score, 0) + case when status = 'searchable_active' then 0.05 else 0 end, 6) as score, row_number() over (partition by canonical_name_key order by round(coalesce(confidence_score, 0) + case when status = 'searchable_active' then 0.05 else 0 end, 6) desc, id) as r from source_assertions where canonical_name_key <> '') where r = 1")
def _(lib):
    rows = lib.raw("source_assertions").filter("canonical_name_key <> ''").withColumn("confidence", F.round(F.coalesce("confidence_score", F.lit(0.0)) + F.when(F.col("status") == "searchable_active", 0.05).otherwise(0.0), 6))
    return V.best_alias(rows, ["canonical_name_key"]).select("canonical_name_key", "id", F.col("confidence").alias("score"))


@query("k46_extraction_summary", f"select role, count(*) as units, cast(sum(n) as bigint) as occurrences, cast(sum(n - 1) as bigint) as calls_avoided, round(avg(n), 4) as mean from (select {_UNIT} as unit, provider, asserted_role as role, count(*) as n from source_assertions where raw_input is not null and regexp_matches(raw_input, '^[ -~]*$') group by 1, 2, 3) group by 1")
def _(lib):
    """The summary of k44's texts in ASCII; k46_all_summary has all texts."""
    return V.unit_summary(V.unit_keys(lib.raw("source_assertions").filter(F.col("raw_input").rlike("^[ -~]*$"))))


@query("k46_all_summary")
def _(lib):
    return V.unit_summary(V.unit_keys(lib.raw("source_assertions")))

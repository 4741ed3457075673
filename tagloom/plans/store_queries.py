"""Upserts with precedence and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators import stats, tagstore as T
from tagloom.plans.registry import registry

QUERIES, ORACLE, query = registry()

# The rows that come in are drawn from the tables: metadata records name media, and each brings the tag with the number of its page.
_IN = "inc as (select media_id, 1 + source_page_index as tag_id, min(similarity) / 100 as confidence from source_metadata_records where media_id is not null group by 1, 2)"
_FULL = "f as (select coalesce(e.media_id, inc.media_id) as media_id, coalesce(e.tag_id, inc.tag_id) as tag_id, e.media_id is not null as had, inc.media_id is not null as came, e.source, e.confidence, e.is_locked, e.is_suggestion, inc.confidence as score from e full join inc on e.media_id = inc.media_id and e.tag_id = inc.tag_id)"


def _incoming(lib):
    r = lib.raw("source_metadata_records").filter("media_id is not null")
    return r.groupBy("media_id", (F.col("source_page_index") + 1).cast("bigint").alias("tag_id")).agg((F.min("similarity") / 100).alias("confidence"))


@query("i01_manual_upsert", "select media_id, tag_id, case when came then 'manual' else source end as source, case when came then 1.0 else confidence end as confidence, case when came then true else is_locked end as is_locked, case when came then false else is_suggestion end as is_suggestion from f", _IN, _FULL)
def _(lib):
    return T.set_tags(lib.edges, _incoming(lib))


@query("i02_import_upsert", "select media_id, tag_id, case when came then 'booru_import' else source end as source, case when came then 1.0 else confidence end as confidence, case when came then true else is_locked end as is_locked, case when came then false else is_suggestion end as is_suggestion from f", _IN, _FULL)
def _(lib):
    return T.set_tags(lib.edges, _incoming(lib), "booru_import")


_TAKE = "case when came and not (had and (coalesce(is_locked, false) or coalesce(source = 'manual', false))) then {} else {} end"


@query("i03_ai_upsert", f"select media_id, tag_id, {_TAKE.format("'ai_wd'", 'source')} as source, {_TAKE.format('score', 'confidence')} as confidence, case when had then is_locked else false end as is_locked, {_TAKE.format('score < 0.5', 'is_suggestion')} as is_suggestion from f", _IN, _FULL)
def _(lib):
    return T.ai_tags(lib.edges, _incoming(lib))


_ACT = "act as (select media_id, tag_id, case when confidence < 0.3 then 'reject' when confidence < 0.5 then 'confirm' when confidence < 0.55 then 'delete' when confidence < 0.6 then 'lock' end as action from e where confidence < 0.6)"


def _actions(lib):
    c = F.col("confidence")
    return lib.edges.filter(c < 0.6).select("media_id", "tag_id", F.when(c < 0.3, "reject").when(c < 0.5, "confirm").when(c < 0.55, "delete").otherwise("lock").alias("action"))


_REVIEWED = "select e.media_id, e.tag_id, source, confidence, case when (action = 'confirm' and is_suggestion) or action = 'lock' then true else is_locked end as is_locked, case when action = 'confirm' and is_suggestion then false else is_suggestion end as is_suggestion from e left join act on act.media_id = e.media_id and act.tag_id = e.tag_id where not coalesce(action = 'delete' or (action = 'reject' and is_suggestion), false)"


@query("i04_review_decisions", _REVIEWED, _ACT)
def _(lib):
    """Confirm, reject, lock and delete (I4, I5, I8) in one pass."""
    return T.review(lib.edges, _actions(lib))


@query("i08_recount_after_review", "select t.id, count(r.tag_id) as post_count from t left join r on r.tag_id = t.id and not r.is_suggestion group by 1", _ACT, f"r as ({_REVIEWED})")
def _(lib):
    kept = T.review(lib.edges, _actions(lib)).filter("not is_suggestion").groupBy(F.col("tag_id").alias("id")).agg(F.count("*").alias("n"))
    return lib.tags.select("id").join(kept, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("post_count"))


@query("i06_provenance", "select e.media_id, e.tag_id, e.source, coalesce(inc.confidence, e.confidence) as confidence, coalesce(case when inc.media_id is not null then true end, e.is_locked) as is_locked, is_suggestion from e left join inc on inc.media_id = e.media_id and inc.tag_id = e.tag_id", _IN)
def _(lib):
    return T.provenance(lib.edges, _incoming(lib).withColumns({"source": F.lit(None).cast("string"), "is_locked": F.lit(True)}))


@query("i07_replace_tags", """select media_id, tag_id, source, confidence, is_locked, is_suggestion from e where media_id not in (select media_id from inc) union all select media_id, tag_id, 'manual', 1.0, true, false from inc""", _IN)
def _(lib):
    return T.replace_tags(lib.edges, _incoming(lib).select("media_id", "tag_id"))


_RANK = "case {} when 'manual' then 0 when 'static' then 1 when 'llm' then 2 when 'imported' then 3 else 4 end"
_TRUST = "trusted as (select lower(unnest(list_distinct([display_name, alias]))) as alias, canonical_name, {} as p from tag_translations where status <> 'rejected' and (coalesce(category, 'general') not in ('artist', 'character', 'copyright') or source in ('manual', 'static') or (status = 'reviewed' and not needs_review)))".format(_RANK.format("source"))


@query("i09_alias_map", "select alias, list_sort(list(distinct canonical_name)) as targets from trusted where p = (select min(p) from trusted x where x.alias = trusted.alias) group by 1", _TRUST)
def _(lib):
    return T.alias_map(lib.tag_translations)


_OLD = "o as (select canonical_name, language, display_name, source, status from tag_translations where display_name not like 'zh2!_%' escape '!')"
_NEW = "n as (select name as canonical_name, 'zh' as language, 'llm_' || name as display_name, 'llm' as source, 'pending' as status from t)"


def _translations(lib):
    old = lib.tag_translations.filter(~F.startswith("display_name", F.lit("zh2_"))).select("canonical_name", "language", "display_name", "source", "status")
    new = lib.tags.select(F.col("name").alias("canonical_name"), F.lit("zh").alias("language"), F.concat(F.lit("llm_"), "name").alias("display_name"), F.lit("llm").alias("source"), F.lit("pending").alias("status"))
    return old, new


_PICK = "case when n.canonical_name is not null and (o.canonical_name is null or {} or {} <= {}) then n.{{0}} else o.{{0}} end as {{0}}".format("{1}", _RANK.format("n.source"), _RANK.format("o.source"))


@query("i10_translation_upsert", f"select coalesce(o.canonical_name, n.canonical_name) as canonical_name, 'zh' as language, {', '.join(_PICK.format(c, 'false') for c in ('display_name', 'source', 'status'))} from o full join n on o.canonical_name = n.canonical_name", _OLD, _NEW)
def _(lib):
    return T.upsert_translations(*_translations(lib))


@query("i10_translation_forced", f"select coalesce(o.canonical_name, n.canonical_name) as canonical_name, 'zh' as language, {', '.join(_PICK.format(c, 'true') for c in ('display_name', 'source', 'status'))} from o full join n on o.canonical_name = n.canonical_name", _OLD, _NEW)
def _(lib):
    return T.upsert_translations(*_translations(lib), force=True)


@query("i11_display_names", f"select name, coalesce((select display_name from tag_translations x where x.canonical_name = t.name and status <> 'rejected' order by {_RANK.format('source')}, display_name limit 1), name) as shown from t")
def _(lib):
    return T.display_names(lib.tags, lib.tag_translations)


@query("i12_alias_to_canonical", f"select alias, canonical_name from (select *, row_number() over (partition by alias order by {_RANK.format('source')}, canonical_name) as r from (select unnest([alias, display_name]) as alias, canonical_name, source from tag_translations where status <> 'rejected')) where r = 1")
def _(lib):
    rows = lib.tag_translations.filter("status <> 'rejected'").select(F.explode(F.array("alias", "display_name")).alias("alias"), "canonical_name", "source")
    return rows.groupBy("alias").agg(F.min(F.struct(T.source_rank("source").alias("p"), "canonical_name"))["canonical_name"].alias("canonical_name"))


@query("i13_missing_translations", "select id, name, post_count from t where not exists (select 1 from tag_translations x where x.canonical_name = t.name) order by post_count desc, id limit 100")
def _(lib):
    return lib.tags.join(lib.tag_translations, lib.tags["name"] == lib.tag_translations["canonical_name"], "left_anti").orderBy(F.desc("post_count"), "id").limit(100).select("id", "name", "post_count")


@query("i14_seed_translations", "select canonical_name, language, display_name, source, status from n where canonical_name not in (select canonical_name from o)", _OLD, _NEW)
def _(lib):
    old, new = _translations(lib)
    return T.insert_absent(old, new, ["canonical_name", "language"])


@query("i15_shared_sync", "select coalesce(a.name, b.name) as name, case when b.name is null then 'to_shared' when a.name is null then 'to_local' else 'conflict' end as side from (select name, category from t where id % 3 <> 0) a full join (select name, coalesce(category, 'general') as category from t where id % 5 <> 0) b on a.name = b.name where a.name is null or b.name is null or a.category is distinct from b.category")
def _(lib):
    """Two stores that each lack some names, as two libraries do."""
    return T.sync_shared(lib.tags.filter("id % 3 <> 0"), lib.tags.filter("id % 5 <> 0").withColumn("category", F.coalesce("category", F.lit("general"))))


@query("i16_new_tags", "select lower(trim(title)) as name, min(provider) as hint from source_metadata_records where title is not null and lower(trim(title)) not in (select name from t) group by 1")
def _(lib):
    """Names that come in with hints, those that exist left out."""
    names = lib.raw("source_metadata_records").filter("title is not null").select(F.lower(F.trim("title")).alias("name"), F.col("provider").alias("hint"))
    return T.insert_absent(lib.tags.select("name"), names, ["name"])


@query("i17_bulk_create", "select distinct lower(name) as name from (select 'old_' || name as name from t union all select 'fresh_' || name from t union all select name from t) where lower(name) not in (select name from t) and lower(name) not in (select alias_name from tag_aliases)")
def _(lib):
    wanted = lib.tags.select(F.explode(F.array(F.concat(F.lit("old_"), "name"), F.concat(F.lit("fresh_"), "name"), F.col("name"))).alias("name")).select(F.lower("name").alias("name"))
    return T.insert_absent(lib.tag_aliases.select(F.col("alias_name").alias("name")), T.insert_absent(lib.tags.select("name"), wanted, ["name"]), ["name"])


_LINKED = "l as (select s.media_id, l.concept_id as entity_id, s.role_hint as role, l.link_status, l.run_id, l.confidence, l.id from signal_links l join signals s on s.id = l.signal_id where s.media_id is not null and l.concept_id is not null)"


@query("i19_assignments", """select coalesce(o.media_id, n.media_id) as media_id, coalesce(o.entity_id, n.entity_id) as entity_id, coalesce(o.role, n.role) as role, case when n.media_id is not null and (not coalesce(o.locked, false) or n.source = 'manual') then n.status else o.status end as status,
  case when n.media_id is not null and (not coalesce(o.locked, false) or n.source = 'manual') then n.source else o.source end as source, case when n.media_id is not null and (not coalesce(o.locked, false) or n.source = 'manual') then n.locked else o.locked end as locked
  from o full join (select * from n where status <> 'confirmed' or source = 'manual' or evidence_id is not null) n on o.media_id = n.media_id and o.entity_id = n.entity_id and o.role = n.role""", _LINKED,
       "o as (select media_id, entity_id, role, 'suggested' as status, 'ai' as source, max(confidence) > 0.8 as locked from l where link_status = 'active' group by 1, 2, 3)",
       "n as (select media_id, entity_id, role, case when max(confidence) > 0.7 then 'confirmed' else 'suggested' end as status, case when count(*) > 1 then 'manual' else 'ai' end as source, max(case when confidence > 0.75 then id end) as evidence_id, false as locked from l group by 1, 2, 3)")
def _(lib):
    links = lib.raw("signal_links").filter("concept_id is not null").select("signal_id", F.col("concept_id").alias("entity_id"), "link_status", "confidence", F.col("id").alias("link_id"))
    s = lib.raw("signals").filter("media_id is not null").select(F.col("id").alias("signal_id"), "media_id", F.col("role_hint").alias("role"))
    rows = links.join(s, "signal_id")
    key = ["media_id", "entity_id", "role"]
    old = rows.filter("link_status = 'active'").groupBy(*key).agg(F.lit("suggested").alias("status"), F.lit("ai").alias("source"), F.lit(None).cast("bigint").alias("evidence_id"), (F.max("confidence") > 0.8).alias("locked"))
    new = rows.groupBy(*key).agg(F.when(F.max("confidence") > 0.7, "confirmed").otherwise("suggested").alias("status"), F.when(F.count("*") > 1, "manual").otherwise("ai").alias("source"), F.max(F.when(F.col("confidence") > 0.75, F.col("link_id"))).alias("evidence_id"), F.lit(False).alias("locked"))
    return T.assign(old, new).drop("evidence_id")


_HIST = "(select string_agg(p || '=' || n, ',' order by p) from (select provider as p, count(*) as n from source_assertions y where y.canonical_name_key = x.canonical_name_key group by 1))"


@query("i23_registry_merge", f"select canonical_name_key as key, list_sort(list(distinct raw_input)) as variants, count(*) as seen_count, {_HIST} as providers from source_assertions x where canonical_name_key <> '' group by 1")
def _(lib):
    """The registries of strong and of other assertions, merged; the sum must be that of all."""
    rows = lib.raw("source_assertions").filter("canonical_name_key <> ''").withColumnRenamed("canonical_name_key", "key")

    def one(part):
        providers = part.groupBy("key", "provider").agg(F.count("*").alias("n")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("provider", "n"))).alias("providers"))
        return part.groupBy("key").agg(F.sort_array(F.collect_set("raw_input")).alias("variants"), F.count("*").alias("seen_count")).join(providers, "key")

    high = F.coalesce(F.col("confidence") == "high", F.lit(False))
    out = T.merge_registry(one(rows.filter(high)), one(rows.filter(~high)))
    hist = F.array_join(F.transform(F.array_sort(F.map_entries("providers")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return out.select("key", "variants", "seen_count", hist.alias("providers"))


@query("i24_scoped_supersede", """select id, case when run_id in (select run_id from r) and not exists (select 1 from r where r.run_id = l.run_id and r.signal_id = l.signal_id) then 'superseded' else link_status end as status from signal_links l""",
       "r as (select distinct run_id, signal_id from signal_links where resolver_version = 'sc2.0' and confidence > 0.5 and run_id is not null)")
def _(lib):
    """A resolver run emits again what it is sure of; the rest of its scope is superseded."""
    links = lib.raw("signal_links")
    emitted = links.filter("resolver_version = 'sc2.0' and confidence > 0.5 and run_id is not null").select("run_id", "signal_id")
    return T.supersede(links.select("id", "run_id", "signal_id", F.col("link_status").alias("status")), emitted, "run_id", "signal_id").select("id", "status")


@query("i25_guarded_apply", "select id, 'active' as status from concepts where status <> 'superseded' union all select id, status from concepts where status = 'superseded'")
def _(lib):
    """A planned snapshot applied because the fingerprint it was planned on still holds."""
    now = lib.raw("concepts").select("id", "status")
    planned_on, found = (stats.fingerprint(now, "id", "status").first() for _ in range(2))
    return T.guarded(now, now.withColumn("status", F.when(F.col("status") != "superseded", "active").otherwise(F.col("status"))), planned_on == found)


@query("i26_translation_review", "select canonical_name, display_name, case when needs_review then 'reviewed' else status end as status from tag_translations where status <> 'rejected'")
def _(lib):
    rows = lib.tag_translations.filter("status <> 'rejected'")
    return rows.select("canonical_name", "display_name", F.when(F.col("needs_review"), "reviewed").otherwise(F.col("status")).alias("status"))


@query("i27_media_insert", "select hash, min(id) as id, case when min(mime_type) in ('image/jpeg', 'image/png') then min(mime_type) else 'application/octet-stream' end as mime_type from media x where hash not in (select hash from m where rating = 'safe') group by 1")
def _(lib):
    """All exports offered to a library that holds the safe media: repeated hashes and known ones are refused."""
    offered = lib.raw("media").groupBy("hash").agg(F.min("id").alias("id"), F.min("mime_type").alias("mime_type"))
    mime = F.when(F.col("mime_type").isin("image/jpeg", "image/png"), F.col("mime_type")).otherwise("application/octet-stream").alias("mime_type")
    return offered.join(lib.media.filter("rating = 'safe'"), "hash", "left_anti").select("hash", "id", mime)


@query("i28_parent_changes", """select a.id, b.id as new_parent, case when a.id = b.id then 'self' when b.parent_id is not null then 'parent_is_child' when exists (select 1 from m k where k.parent_id = a.id) then 'has_children' end as reason from m a join m b on b.id = a.id // 2 + 1""")
def _(lib):
    """Every medium asks for the parent at half its number; the one-level rule says which may have it."""
    changes = lib.media.select("id", F.expr("id div 2 + 1").alias("new_parent"))
    return T.reparent(lib.media, changes.join(lib.media.select(F.col("id").alias("new_parent")), "new_parent", "left_semi").select("id", "new_parent"))


@query("i29_album_move", "select parent_album_id, child_album_id from album_hierarchy where child_album_id < 3000000 union all select 2000001, child_album_id from album_hierarchy where child_album_id >= 3000000")
def _(lib):
    """All customers move to one nation: old edges of the children go, new ones come."""
    moved = lib.album_hierarchy.filter("child_album_id >= 3000000").select(F.lit(2000001).cast("bigint").alias("parent_album_id"), "child_album_id").distinct()
    return lib.album_hierarchy.join(moved.select("child_album_id"), "child_album_id", "left_anti").select("parent_album_id", "child_album_id").unionByName(moved)


@query("i30_membership", "select distinct 1000000 as album_id, media_id from album_media where media_id in (select id from m where rating = 'explicit') except select album_id, media_id from album_media")
def _(lib):
    wanted = lib.album_media.join(lib.media.filter("rating = 'explicit'").select(F.col("id").alias("media_id")), "media_id", "left_semi").select(F.lit(1000000).cast("bigint").alias("album_id"), "media_id").distinct()
    return wanted.join(lib.album_media, ["album_id", "media_id"], "left_anti")

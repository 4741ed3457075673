"""Statistics, joins, windows, listings and set operations (C, D, E, F, G) with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators import stats as S
from tagloom.plans.registry import registry
from tagloom.session import salted_join

QUERIES, ORACLE, query = registry()


_ASKED = "harbor_lantern"
_DAY = "cast(uploaded_at at time zone 'UTC' as date)"


@query("d01_recount", "select id, name, (select count(*) from e where tag_id = t.id and not is_suggestion) as post_count from t")
def _(lib):
    return S.recount(lib)


@query("d02_related_tags", f"""select tag_id, name, category, count(*) as n_media from e join t on t.id = tag_id
  where media_id in (select media_id from e join t on t.id = tag_id where name = '{_ASKED}') and name <> '{_ASKED}' group by all order by n_media desc, tag_id limit 20""")
def _(lib):
    return S.together_with(lib, [_ASKED])


_REL = f"""r as (select x.tag_id, t.name, count(*) as i, max(q.post_count) as q, max(t.post_count) as t from e x join e y on x.media_id = y.media_id
  join t q on q.id = y.tag_id and q.name = '{_ASKED}' and q.post_count > 0 join t on t.id = x.tag_id {{}} group by 1, 2 order by i desc, tag_id limit 25)"""
_SIM = """select tag_id, name, i as n_both, round(case when q > 0 then i::double / q else 0 end, 6) as frequency, round(case when least(q, t) > 0 then i::double / least(q, t) else 0 end, 6) as overlap,
  round(case when q + t - i > 0 then i::double / (q + t - i) else 0 end, 6) as jaccard, round(case when q * t > 0 then i / sqrt(q::double * t) else 0 end, 6) as cosine from r"""


@query("d03_related_similarity", _SIM, _REL.format(""))
def _(lib):
    return S.related(lib, _ASKED)


@query("d03_related_characters", _SIM, _REL.format("and t.category = 'character'"))
def _(lib):
    return S.related(lib, _ASKED, "character")


@query("d04_related_to_set", """select tag_id, name, category, count(*) as n_media from e join t on t.id = tag_id
  where media_id in (select media_id from e join t on t.id = tag_id where name in ('harbor_lantern', 'clockwork_lantern')) and name not in ('harbor_lantern', 'clockwork_lantern') group by all order by n_media desc, tag_id limit 20""")
def _(lib):
    return S.together_with(lib, ["harbor_lantern", "clockwork_lantern"])


@query("d11_media_by_type_rating", "select file_type, rating, count(*) as n, count(parent_id) as with_parent, sum(file_size) as bytes, cast(floor(avg(file_size)) as bigint) as avg_bytes from m group by 1, 2")
def _(lib):
    return lib.media.groupBy("file_type", "rating").agg(F.count("*").alias("n"), F.count("parent_id").alias("with_parent"), F.sum("file_size").alias("bytes"), F.floor(F.avg("file_size")).alias("avg_bytes"))


@query("d11_parents", "select count(*) as n_parents, sum(n) as n_children from (select p.id, count(*) as n from m p join m c on c.parent_id = p.id group by 1)")
def _(lib):
    kids = lib.media.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n"))
    return kids.join(lib.media.select("id"), "id", "left_semi").agg(F.count("*").alias("n_parents"), F.sum("n").alias("n_children"))


@query("d11_uploads_by_day", f"select cast({_DAY} as varchar) as day, count(*) as n from m where uploaded_at >= (select max(uploaded_at) from m) - interval 30 days group by 1")
def _(lib):
    recent = lib.media.select("uploaded_at")
    last = recent.agg(F.max("uploaded_at")).first()[0]
    recent = recent.filter(F.col("uploaded_at") >= F.lit(last) - F.expr("interval 30 days")) if last else recent.limit(0)
    return recent.groupBy(F.to_date("uploaded_at").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("d11_top_tags", "select name, post_count from t order by post_count desc, id limit 10")
def _(lib):
    return lib.tags.orderBy(F.desc("post_count"), "id").limit(10).select("name", "post_count")


@query("e03_top_tags_per_category", "select category, rank, name, post_count from (select *, row_number() over (partition by category order by post_count desc, id) as rank from t where category is not null) where rank <= 10")
def _(lib):
    top = S.top_per_group(lib.tags.filter("category is not null"), "category", [F.desc("post_count"), F.asc("id")], 10)
    return top.select("category", "rank", "name", "post_count")


_BUCKET = "case when n = 0 then '0' when n <= 10 then '1-10' when n <= 50 then '11-50' when n <= 100 then '51-100' else '100+' end"


@query("d11_album_sizes", f"select {_BUCKET} as bucket, count(*) as n_albums from (select a.id, count(x.media_id) as n from albums a left join album_media x on x.album_id = a.id group by 1) group by 1")
def _(lib):
    sizes = lib.album_media.groupBy(F.col("album_id").alias("id")).agg(F.count("*").alias("c"))
    n = F.coalesce("c", F.lit(0))
    bucket = F.when(n == 0, "0").when(n <= 10, "1-10").when(n <= 50, "11-50").when(n <= 100, "51-100").otherwise("100+")
    return lib.albums.join(sizes, "id", "left").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_albums"))


@query("d12_file_types", "select count(*) filter (file_type = 'image') as images, count(*) filter (file_type = 'video') as videos, count(*) filter (file_type = 'gif') as gifs, count(*) as total from m")
def _(lib):
    is_type = lambda v: F.count_if(F.col("file_type") == v)
    return lib.media.agg(is_type("image").alias("images"), is_type("video").alias("videos"), is_type("gif").alias("gifs"), F.count("*").alias("total"))


@query("d13_tag_totals", "select category, count(*) as n, count(*) filter (post_count > 0) as used from t group by 1")
def _(lib):
    return lib.tags.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("post_count") > 0).alias("used"))


@query("d14_count_posts", "select count(*) as n from m where rating = 'safe'")
def _(lib):
    return lib.media.filter("rating = 'safe'").agg(F.count("*").alias("n"))


@query("d15_distinct_by_source", """select coalesce(e.source, '<null>') as source, count(distinct media_id) as n_media, count(distinct tag_id) as n_tags, count(distinct media_id) filter (m.content_class in ('anime', 'illustration')) as n_eligible
  from e left join m on m.id = media_id group by 1""")
def _(lib):
    edges = lib.edges.select("media_id", "tag_id", F.coalesce("source", F.lit("<null>")).alias("source"))
    fit = lib.media.filter(F.col("content_class").isin("anime", "illustration")).select(F.col("id").alias("media_id"), F.lit(True).alias("fit"))
    # Two levels, so no task holds the distinct media of a frequent source.
    media = edges.select("source", "media_id").distinct().join(fit, "media_id", "left").groupBy("source").agg(F.count("*").alias("n_media"), F.count_if("fit").alias("n_eligible"))
    tags = edges.select("source", "tag_id").distinct().groupBy("source").agg(F.count("*").alias("n_tags"))
    return media.join(tags, "source").select("source", "n_media", "n_tags", "n_eligible")


@query("d16_class_distribution", """select key, count(m.id) as n from (values ('anime'), ('illustration'), ('non_anime'), ('unknown'), ('sketch'), ('unclassified')) v(key) left join m on coalesce(content_class, 'unclassified') = key group by 1""")
def _(lib):
    return S.filled_distribution(lib.media, "content_class", ("anime", "illustration", "non_anime", "unknown", "sketch"), "unclassified")


@query("d17_eligible", "select sum((content_class in ('anime', 'illustration') or content_class is null)::int) as eligible, sum((content_class in ('non_anime', 'unknown'))::int) as ineligible from m")
def _(lib):
    c = F.col("content_class")
    return lib.media.agg(F.count_if(c.isin("anime", "illustration") | c.isNull()).alias("eligible"), F.count_if(c.isin("non_anime", "unknown")).alias("ineligible"))


@query("d18_signal_inventory", "select role_hint, status, origin_type, provider, count(*) as n from signals group by all")
def _(lib):
    return S.counts_by(lib.raw("signals"), "role_hint", "status", "origin_type", "provider")


@query("d18_edge_inventory", "select category, e.source, is_suggestion, count(*) as n from e join t on t.id = tag_id group by all")
def _(lib):
    return S.counts_by(lib.edges.join(lib.tags.select(F.col("id").alias("tag_id"), "category"), "tag_id"), "category", "source", "is_suggestion")


@query("d18_assertion_inventory", "select asserted_role, status, provider, confidence, requires_review, count(*) as n from source_assertions group by all")
def _(lib):
    return S.counts_by(lib.raw("source_assertions"), "asserted_role", "status", "provider", "confidence", "requires_review")


@query("d19_localization_candidates", """select name, count(distinct media_id) as n_media from e join t on t.id = tag_id where not exists (select 1 from tag_translations where canonical_name = t.name) group by 1 order by n_media desc, name limit 50""")
def _(lib):
    open_tags = lib.tags.join(lib.tag_translations, lib.tags["name"] == lib.tag_translations["canonical_name"], "left_anti").select(F.col("id").alias("tag_id"), "name")
    return lib.edges.join(open_tags, "tag_id").groupBy("name").agg(F.count("*").alias("n_media")).orderBy(F.desc("n_media"), "name").limit(50)


@query("d20_translation_stats", """select count(*) as n_tags, count(*) filter (x.canonical_name is not null) as covered, count(*) filter (x.canonical_name is null) as open, (select count(*) from tag_translations where needs_review) as needs_review
  from t left join (select distinct canonical_name from tag_translations where status <> 'rejected') x on x.canonical_name = t.name""")
def _(lib):
    done = lib.tag_translations.filter("status <> 'rejected'").select("canonical_name").distinct()
    tags = lib.tags.join(done, lib.tags["name"] == done["canonical_name"], "left")
    review = lib.tag_translations.agg(F.count_if("needs_review").alias("needs_review"))
    counts = tags.agg(F.count("*").alias("n_tags"), F.count("canonical_name").alias("covered"), F.count_if(F.col("canonical_name").isNull()).alias("open"))
    return counts.withColumn("k", F.lit(1)).join(F.broadcast(review.withColumn("k", F.lit(1))), "k").drop("k")


@query("d22_gap_by_category", "select coalesce(category, '<null>') as category, count(*) as n, count(*) filter (not exists (select 1 from tag_translations x where x.canonical_name = t.name)) as untranslated from t group by 1")
def _(lib):
    done = lib.tag_translations.select("canonical_name").distinct()
    tags = lib.tags.join(done, lib.tags["name"] == done["canonical_name"], "left")
    return tags.groupBy(F.coalesce("category", F.lit("<null>")).alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("canonical_name").isNull()).alias("untranslated"))


@query("d23_resolver_status", """select count(*) filter (ok) as resolved, count(*) filter (not ok and review) as needs_review, greatest(0, count(*) - count(*) filter (ok) - count(*) filter (not ok and review)) as none_left from
  (select t.id, coalesce(bool_or(x.status = 'reviewed' and not x.needs_review), false) as ok, coalesce(bool_or(x.needs_review or x.status = 'pending'), false) as review from t left join tag_translations x on x.canonical_name = t.name
   where t.category in ('artist', 'character', 'copyright') group by 1)""")
def _(lib):
    names = lib.tags.filter(F.col("category").isin("artist", "character", "copyright"))
    state = lib.tag_translations.groupBy("canonical_name").agg(F.bool_or((F.col("status") == "reviewed") & ~F.col("needs_review")).alias("ok"), F.bool_or(F.col("needs_review") | (F.col("status") == "pending")).alias("review"))
    joined = names.join(state, names["name"] == state["canonical_name"], "left")
    ok, review = F.coalesce("ok", F.lit(False)), F.coalesce("review", F.lit(False))
    out = joined.agg(F.count_if(ok).alias("resolved"), F.count_if(~ok & review).alias("needs_review"), F.count("*").alias("n"))
    return out.select("resolved", "needs_review", F.greatest(F.lit(0), F.col("n") - F.col("resolved") - F.col("needs_review")).alias("none_left"))


@query("d24_group_counts", "select coalesce(cast(content_class as varchar), '<null>') as key, count(*) as n from m group by 1 order by n desc, key limit 3")
def _(lib):
    return S.text_counts(lib.media, "content_class", 3)


@query("d25_numeric_summary", """select file_type, count(v) as n, min(v) as lowest, max(v) as highest, round(avg(v), 3) as mean, list_sort(list(v))[least(count(v) - 1, cast(floor(0.9 * count(v)) as bigint)) + 1] as p90, count(*) filter (v = 0) as zeros
  from (select file_type, file_size as v from m where file_size is not null) group by 1""")
def _(lib):
    m = lib.media.filter("file_size is not null")
    basic = m.groupBy("file_type").agg(F.min("file_size").alias("lowest"), F.max("file_size").alias("highest"), F.round(F.avg("file_size"), 3).alias("mean"), F.count_if(F.col("file_size") == 0).alias("zeros"))
    return basic.join(S.quantiles(m, ["file_type"], "file_size", {"p90": 0.9}, "floor_n"), "file_type")


@query("d26_tag_registry", """select provider, canonical_name_key, list_sort(list(distinct raw_input)) as variants, count(*) as seen_count, min(id) as first_id from source_assertions where canonical_name_key <> '' group by 1, 2""")
def _(lib):
    rows = lib.raw("source_assertions").filter("canonical_name_key <> ''")
    return rows.groupBy("provider", "canonical_name_key").agg(F.sort_array(F.collect_set("raw_input")).alias("variants"), F.count("*").alias("seen_count"), F.min("id").alias("first_id"))


_HIST = "string_agg({0} || '=' || n, ',' order by {0})"


@query("d27_name_registry", f"""select k as name_key, sum(n) as seen_count, (select {_HIST.format('provider')} from (select provider, sum(n) as n from c where c.k = x.k group by 1)) as providers, (select {_HIST.format('asserted_role')} from (select asserted_role, sum(n) as n from c where c.k = x.k group by 1)) as roles from c x group by 1""",
       "c as (select canonical_name_key as k, provider, asserted_role, count(*) as n from source_assertions where canonical_name_key <> '' group by all)")
def _(lib):
    rows = lib.raw("source_assertions").filter("canonical_name_key <> ''")
    base = rows.groupBy(F.col("canonical_name_key").alias("name_key"), "provider", "asserted_role").agg(F.count("*").alias("n"))

    def histogram(column, name):
        counts = base.groupBy("name_key", column).agg(F.sum("n").alias("n"))
        return counts.groupBy("name_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(column, "n"))), lambda s: F.concat(s[column], F.lit("="), s["n"].cast("string"))), ",").alias(name), F.sum("n").alias(f"n_{name}"))

    providers, roles = histogram("provider", "providers"), histogram("asserted_role", "roles").drop("n_roles")
    return providers.join(roles, "name_key").select("name_key", F.col("n_providers").alias("seen_count"), "providers", "roles")


@query("d28_provider_coverage", """select provider, count(*) as n, round(count(*) filter (asserted_role = 'artist') / nullif(count(*), 0)::double, 4) as artist_share, round(count(*) filter (asserted_role = 'character') / nullif(count(*), 0)::double, 4) as character_share, count(distinct source_metadata_record_id) as n_records from source_assertions group by 1""")
def _(lib):
    rows = lib.raw("source_assertions")
    share = lambda role: F.round(F.try_divide(F.count_if(F.col("asserted_role") == role).cast("double"), F.count("*")), 4).alias(f"{role}_share")
    return rows.groupBy("provider").agg(F.count("*").alias("n"), share("artist"), share("character"), F.count_distinct("source_metadata_record_id").alias("n_records"))


@query("d29_key_collisions", "select canonical_name_key, count(distinct normalized_input) as n_forms from source_assertions where canonical_name_key <> '' group by 1 having count(distinct normalized_input) > 1")
def _(lib):
    rows = lib.raw("source_assertions").filter("canonical_name_key <> ''")
    return rows.groupBy("canonical_name_key").agg(F.count_distinct("normalized_input").alias("n_forms")).filter("n_forms > 1")


@query("d30_role_entropy", """select normalized_key, sum(c) as n, round(case when count(*) > 1 then (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(count(*)) else 0 end, 6) as entropy
  from (select normalized_key, role_hint, count(*) as c from signals where normalized_key is not null group by 1, 2) group by 1""")
def _(lib):
    return S.entropy(lib.raw("signals").filter("normalized_key is not null"), "normalized_key", "role_hint")


@query("d31_table_fingerprint", """select count(*) as n, cast(sum(cast(('0x' || substr(md5(cast(id as varchar) || ':' || coalesce(status, '')), 1, 12)) as ubigint))::decimal(38,0) as varchar) as fingerprint from concepts""")
def _(lib):
    return S.fingerprint(lib.raw("concepts"), "id", "status")


@query("d33_coverage", """select count(distinct s.id) as n_signals, count(distinct l.signal_id) as linked, count(distinct l.signal_id) filter (l.link_status = 'active') as active, round(100.0 * count(distinct l.signal_id) / nullif(count(distinct s.id), 0), 2) as linked_percent
  from signals s left join signal_links l on l.signal_id = s.id and l.concept_id is not null""")
def _(lib):
    links = lib.raw("signal_links").filter("concept_id is not null").groupBy("signal_id").agg(F.bool_or(F.col("link_status") == "active").alias("active"))
    signals = lib.raw("signals").select("id").join(links, F.col("id") == F.col("signal_id"), "left")
    out = signals.agg(F.count("*").alias("n_signals"), F.count("signal_id").alias("linked"), F.count_if(F.coalesce("active", F.lit(False))).alias("active"))
    return out.withColumn("linked_percent", F.round(F.try_divide(F.col("linked") * 100.0, F.col("n_signals")), 2))


@query("d35_classification_stats", "select coalesce(content_class, '<none>') as content_class, count(*) as n, count(content_class_confidence) as scored, count(*) filter (content_class_confidence >= 0.8) as sure from m group by 1")
def _(lib):
    return lib.media.groupBy(F.coalesce("content_class", F.lit("<none>")).alias("content_class")).agg(F.count("*").alias("n"), F.count("content_class_confidence").alias("scored"), F.count_if(F.col("content_class_confidence") >= 0.8).alias("sure"))


_CONF = "case when confidence is null then 'none' when confidence < 0.5 then 'low' when confidence < 0.8 then 'medium' else 'high' end"


@query("d36_trust_audit", f"select origin_type, trust_tier, {_CONF} as confidence_bucket, count(*) as n, count(distinct media_id) as n_media from signals group by all")
def _(lib):
    c = F.col("confidence")
    bucket = F.when(c.isNull(), "none").when(c < 0.5, "low").when(c < 0.8, "medium").otherwise("high").alias("confidence_bucket")
    return lib.raw("signals").groupBy("origin_type", "trust_tier", bucket).agg(F.count("*").alias("n"), F.count_distinct("media_id").alias("n_media"))


@query("d36_signals_per_media", """select max(n) as highest, p[cast(round_even((count(*) - 1) * 0.5, 0) as bigint) + 1] as p50, p[cast(round_even((count(*) - 1) * 0.9, 0) as bigint) + 1] as p90, p[cast(round_even((count(*) - 1) * 0.95, 0) as bigint) + 1] as p95
  from (select count(*) as n from signals where media_id is not null group by media_id), (select list_sort(list(n)) as p from (select count(*) as n from signals where media_id is not null group by media_id)) group by p""")
def _(lib):
    per = lib.raw("signals").filter("media_id is not null").groupBy("media_id").agg(F.count("*").alias("n_signals")).withColumn("all", F.lit(1))
    out = S.quantiles(per, ["all"], "n_signals", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "highest": 1.0}, "round_n1")
    return out.select("highest", "p50", "p90", "p95")


@query("d37_ai_assignments", """select category, case when confidence >= 0.85 then 'ge_85' when confidence >= 0.35 then 'ge_35' else 'below' end as bucket, count(*) as n, count(*) filter (is_suggestion) as suggested, count(*) filter (m.id is null) as orphans
  from e join t on t.id = tag_id left join m on m.id = media_id where trim(lower(e.source)) = 'ai_wd' and confidence is not null group by 1, 2""")
def _(lib):
    ai = lib.edges.filter((F.trim(F.lower("source")) == "ai_wd") & F.col("confidence").isNotNull())
    c = F.col("confidence")
    bucket = F.when(c >= 0.85, "ge_85").when(c >= 0.35, "ge_35").otherwise("below").alias("bucket")
    joined = ai.join(lib.tags.select(F.col("id").alias("tag_id"), "category"), "tag_id").join(lib.media.select("id"), F.col("media_id") == F.col("id"), "left")
    return joined.groupBy("category", bucket).agg(F.count("*").alias("n"), F.count_if("is_suggestion").alias("suggested"), F.count_if(F.col("id").isNull()).alias("orphans"))


@query("d38_alias_gap", """select role_hint, normalized_key, n from (select role_hint, normalized_key, count(*) as n, row_number() over (partition by role_hint order by count(*) desc, normalized_key) as r from signals s
  where normalized_key is not null and not exists (select 1 from source_assertions a where a.canonical_name_key = s.normalized_key) group by 1, 2) where r <= 15""")
def _(lib):
    seen = lib.raw("source_assertions").select("canonical_name_key")
    s = lib.raw("signals").filter("normalized_key is not null")
    gap = s.join(seen, s["normalized_key"] == seen["canonical_name_key"], "left_anti").groupBy("role_hint", "normalized_key").agg(F.count("*").alias("n"))
    return S.top_per_group(gap, "role_hint", [F.desc("n"), F.asc("normalized_key")], 15).select("role_hint", "normalized_key", "n")


@query("d39_review_flags", """select concept_type_hint, count(*) as n, count(*) filter (media_count >= 2) as several_media, count(*) filter (source_count >= 5) as much_evidence, count(*) filter (contains(primary_display_name, '(')) as parenthetical,
  count(*) filter (regexp_matches(primary_display_name, '[぀-ヿ一-鿿]')) as cjk, count(*) filter (coalesce(trim(primary_display_name), '') = '') as empty_name from concepts where status = 'needs_review' group by 1""")
def _(lib):
    c = lib.raw("concepts").filter("status = 'needs_review'")
    name = F.col("primary_display_name")
    return c.groupBy("concept_type_hint").agg(
        F.count("*").alias("n"), F.count_if(F.col("media_count") >= 2).alias("several_media"), F.count_if(F.col("source_count") >= 5).alias("much_evidence"), F.count_if(F.contains(name, F.lit("("))).alias("parenthetical"),
        F.count_if(name.rlike(r"[぀-ヿ一-鿿]")).alias("cjk"), F.count_if(F.coalesce(F.trim(name), F.lit("")) == "").alias("empty_name"),
    )


@query("d40_quantile_rules", """select x as rating, v[least(len(v) - 1, cast(floor(0.75 * len(v)) as bigint)) + 1] as by_floor_n, v[cast(round_even(0.75 * (len(v) - 1), 0) as bigint) + 1] as by_round, v[cast(floor(0.75 * (len(v) - 1)) as bigint) + 1] as by_floor_n1
  from (select rating as x, list_sort(list(width)) as v from m where width is not null group by 1)""")
def _(lib):
    out = None
    for rule, name in (("floor_n", "by_floor_n"), ("round_n1", "by_round"), ("floor_n1", "by_floor_n1")):
        one = S.quantiles(lib.media, ["rating"], "width", {name: 0.75}, rule).drop("n")
        out = one if out is None else out.join(one, "rating")
    return out


# Joins


@query("c01_album_rows", "select album_id, media_id, rating from album_media join m on m.id = media_id")
def _(lib):
    return lib.album_media.join(lib.media.select(F.col("id").alias("media_id"), "rating"), "media_id").select("album_id", "media_id", "rating")


@query("c02_composite_join", "select a.id as assertion_id, s.id as signal_id from source_assertions a join signals s on s.source_metadata_record_id = a.source_metadata_record_id and s.normalized_key = a.canonical_name_key and s.role_hint = a.asserted_role")
def _(lib):
    a = lib.raw("source_assertions").select(F.col("id").alias("assertion_id"), "source_metadata_record_id", F.col("canonical_name_key").alias("normalized_key"), F.col("asserted_role").alias("role_hint"))
    s = lib.raw("signals").select(F.col("id").alias("signal_id"), "source_metadata_record_id", "normalized_key", "role_hint")
    return a.join(s, ["source_metadata_record_id", "normalized_key", "role_hint"]).select("assertion_id", "signal_id")


@query("c03_tags_with_aliases", "select t.id, count(alias_name) as n_aliases, coalesce(min(alias_name), '') as first_alias from t left join tag_aliases on target_tag_id = t.id group by 1")
def _(lib):
    a = lib.tag_aliases.groupBy(F.col("target_tag_id").alias("id")).agg(F.count("*").alias("n"), F.min("alias_name").alias("first"))
    return lib.tags.select("id").join(a, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_aliases"), F.coalesce("first", F.lit("")).alias("first_alias"))


@query("c05_not_ai_tagged", "select id from m where not exists (select 1 from e where media_id = m.id and trim(lower(source)) = 'ai_wd')")
def _(lib):
    ai = lib.edges.filter(F.trim(F.lower("source")) == "ai_wd")
    return lib.media.join(ai, lib.media["id"] == ai["media_id"], "left_anti").select("id")


@query("c05_root_albums", "select id, name from albums where id not in (select child_album_id from album_hierarchy)")
def _(lib):
    return lib.albums.join(lib.album_hierarchy, F.col("id") == F.col("child_album_id"), "left_anti")


@query("c07_siblings", "select a.id, b.id as sibling_id from m a join m b on a.parent_id = b.parent_id and a.id < b.id where a.rating = 'explicit'")
def _(lib):
    """Siblings of explicit media; only children of their parents are joined."""
    a = lib.media.filter("rating = 'explicit' and parent_id is not null").select("id", "parent_id")
    b = lib.media.filter("parent_id is not null").select(F.col("id").alias("sibling_id"), "parent_id")
    return a.join(b, "parent_id").filter("id < sibling_id").select("id", "sibling_id")


@query("c07_all_siblings", "select a.id, b.id as sibling_id from m a join m b on a.parent_id = b.parent_id and a.id < b.id")
def _(lib):
    """Every pair of siblings once; the children of a parent of many are split into blocks that meet pair by pair, so no task holds them all. The rows are the pairs; c07_sibling_groups grows with the media."""
    kids = lib.media.filter("parent_id is not null").select("id", "parent_id")
    sizes = kids.groupBy("parent_id").agg(F.count("*").alias("n_rows")).filter("n_rows > 1").withColumn("salts", F.ceil(F.col("n_rows") / 5_000).cast("int"))
    mine = salted_join(kids, sizes, "parent_id", "id", hot_rows=500_000)
    left = mine.select("parent_id", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), "id")
    right = mine.select("parent_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("sibling_id"))
    return left.join(right, ["parent_id", "salt"]).filter("id < sibling_id").select("id", "sibling_id")


@query("c07_sibling_groups", "select id, parent_id, (select count(*) from m b where b.parent_id = a.parent_id) - 1 as n_siblings from m a where parent_id is not null")
def _(lib):
    """Each medium with its group of siblings and how many others are in it."""
    kids = lib.media.filter("parent_id is not null").select("id", "parent_id")
    sizes = kids.groupBy("parent_id").agg(F.count("*").alias("n_rows")).withColumn("n_siblings", F.col("n_rows") - 1)
    return salted_join(kids, sizes, "parent_id", "id").select("id", "parent_id", "n_siblings")


@query("c09_parenthetical_names", "select b.id as base_id, p.id as tag_id from t b join t p on starts_with(p.name, b.name || '_(')")
def _(lib):
    """name and name_(context): the base is cut off first, so the theta join is an equi-join."""
    p = lib.tags.filter(F.contains("name", F.lit("_("))).select(F.col("id").alias("tag_id"), F.substring_index("name", "_(", 1).alias("base"))
    return lib.tags.select(F.col("id").alias("base_id"), F.col("name").alias("base")).join(p, "base").select("base_id", "tag_id")


@query("c12_media_with_tags", "select media_id, list_sort(list(name)) as tags from e join t on t.id = tag_id join m on m.id = media_id where m.rating = 'explicit' group by 1")
def _(lib):
    edges = lib.edges.join(lib.media.filter("rating = 'explicit'").select(F.col("id").alias("media_id")), "media_id", "left_semi")
    return edges.join(lib.tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").groupBy("media_id").agg(F.sort_array(F.collect_list("name")).alias("tags"))


@query("c12_all_media_with_tags", "select media_id, list_sort(list(name)) as tags from e join t on t.id = tag_id join m on m.id = media_id group by 1")
def _(lib):
    edges = lib.edges.join(lib.media.select(F.col("id").alias("media_id")), "media_id", "left_semi")
    return edges.join(lib.tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").groupBy("media_id").agg(F.sort_array(F.collect_list("name")).alias("tags"))


# Windows


@query("e01_album_thumbnails", "select album_id, media_id, pick from (select album_id, media_id, row_number() over (partition by album_id order by md5(media_id || ':7'), media_id) as pick from album_media where media_id in (select id from m)) where pick <= 4")
def _(lib):
    """Four media of each album in an order drawn by a seed; repeatable, unlike random()."""
    rows = lib.album_media.join(lib.media.select(F.col("id").alias("media_id")), "media_id", "left_semi")
    return S.top_per_group(rows, "album_id", [F.md5(F.concat(F.col("media_id").cast("string"), F.lit(":7"))), F.asc("media_id")], 4).select("album_id", "media_id", F.col("rank").alias("pick"))


@query("e04_best_translation", """select canonical_name, display_name, source from (select *, row_number() over (partition by canonical_name order by case source when 'manual' then 0 when 'static' then 1 when 'llm' then 2 else 3 end, status <> 'reviewed', display_name) as r from tag_translations where status <> 'rejected') where r = 1""")
def _(lib):
    rank = F.when(F.col("source") == "manual", 0).when(F.col("source") == "static", 1).when(F.col("source") == "llm", 2).otherwise(3)
    rows = lib.tag_translations.filter("status <> 'rejected'")
    best = F.min(F.struct(rank.alias("p"), (F.col("status") != "reviewed").alias("open"), "display_name", "source")).alias("b")
    return rows.groupBy("canonical_name").agg(best).select("canonical_name", "b.display_name", "b.source")


@query("e05_best_link", "select signal_id, concept_id, confidence, id as link_id from (select *, row_number() over (partition by signal_id, concept_id order by link_status = 'active' desc, confidence desc nulls last, id desc) as r from signal_links where concept_id is not null) where r = 1")
def _(lib):
    links = lib.raw("signal_links").filter("concept_id is not null")
    best = F.max(F.struct((F.col("link_status") == "active").alias("active"), "confidence", "id")).alias("b")
    return links.groupBy("signal_id", "concept_id").agg(best).select("signal_id", "concept_id", "b.confidence", F.col("b.id").alias("link_id"))


@query("e06_duplicate_suffix", "select id, case when count(*) over (partition by provider_record_key) > 1 then provider_record_key || ':dup:' || row_number() over (partition by provider_record_key order by id) else provider_record_key end as key from source_metadata_records")
def _(lib):
    from pyspark.sql import Window as W

    same = W.partitionBy("provider_record_key")
    n, place = F.count("*").over(same), F.row_number().over(same.orderBy("id"))
    return lib.raw("source_metadata_records").select("id", F.when(n > 1, F.concat("provider_record_key", F.lit(":dup:"), place.cast("string"))).otherwise(F.col("provider_record_key")).alias("key"))


# Listings


@query("f04_media_list", "select position, id, filename from (select row_number() over (order by filename, id) as position, id, filename from m where rating in ('safe', 'questionable')) where position <= 40")
def _(lib):
    from tagloom.plans import search

    return search.page(lib.media.filter(search.ceiling("questionable", listing=True)), [F.asc("filename"), F.asc("id")], 40).select("position", "id", "filename")


@query("f05_album_list", "select position, id, name from (select row_number() over (order by name desc, id) as position, id, name from albums) where position <= 25")
def _(lib):
    from tagloom.plans import search

    return search.page(lib.albums, [F.desc("name"), F.asc("id")], 25).select("position", "id", "name")


@query("f08_autocomplete", """select position, id, name, post_count from (select row_number() over (order by how, post_count desc, id) as position, * from (select id, name, post_count, min(how) as how from
  (select id, name, post_count, case when name like 'harbor%' then 1 else 2 end as how from t where name like '%harbor%' union all select t.id, t.name, post_count, 3 from tag_aliases join t on t.id = target_tag_id where alias_name like 'old!_harbor%' escape '!') group by 1, 2, 3)) where position <= 20""")
def _(lib):
    from tagloom.plans import search

    own = lib.tags.filter(F.contains("name", F.lit("harbor"))).select("id", "name", "post_count", F.when(F.startswith("name", F.lit("harbor")), 1).otherwise(2).alias("how"))
    alias = lib.tag_aliases.filter(F.startswith("alias_name", F.lit("old_harbor"))).select(F.col("target_tag_id").alias("id")).join(lib.tags.select("id", "name", "post_count"), "id").withColumn("how", F.lit(3))
    found = own.unionByName(alias).groupBy("id", "name", "post_count").agg(F.min("how").alias("how"))
    return search.page(found, [F.asc("how"), F.desc("post_count"), F.asc("id")], 20).select("position", "id", "name", "post_count")


@query("f10_random_medium", "select id from m order by md5(id || ':42'), id limit 1")
def _(lib):
    """One medium drawn by a seed."""
    return lib.media.orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(":42"))), "id").limit(1).select("id")


@query("f12_tag_list", "select id, name from t where name like '%!_set' escape '!' and post_count > 0 order by name, id limit 30")
def _(lib):
    return lib.tags.filter(F.col("name").like(r"%\_set") & (F.col("post_count") > 0)).orderBy("name", "id").limit(30).select("id", "name")


@query("f13_artists", "select t.id, name, coalesce(string_agg(alias_name, ',' order by alias_name), '') as aliases from t left join tag_aliases on target_tag_id = t.id where category = 'artist' group by 1, 2")
def _(lib):
    a = lib.tag_aliases.groupBy(F.col("target_tag_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("alias_name")), ",").alias("aliases"))
    return lib.tags.filter("category = 'artist'").join(a, "id", "left").select("id", "name", F.coalesce("aliases", F.lit("")).alias("aliases"))


@query("f14_pools_of_post", "select a.id, a.name, (select count(*) from album_media y where y.album_id = a.id) as post_count from albums a join album_media x on x.album_id = a.id where x.media_id in (5, 17, 300)")
def _(lib):
    hit = lib.album_media.filter(F.col("media_id").isin(5, 17, 300)).select(F.col("album_id").alias("id")).distinct()
    sizes = lib.album_media.join(hit, F.col("album_id") == F.col("id"), "left_semi").groupBy(F.col("album_id").alias("id")).agg(F.count("*").alias("post_count"))
    return lib.albums.join(sizes, "id").select("id", "name", "post_count")


@query("f15_proper_noun_queue", "select id, name, post_count from t where category in ('artist', 'character', 'copyright') and not exists (select 1 from tag_translations x where x.canonical_name = t.name and x.status = 'reviewed') order by post_count desc, id limit 40")
def _(lib):
    done = lib.tag_translations.filter("status = 'reviewed'")
    names = lib.tags.filter(F.col("category").isin("artist", "character", "copyright"))
    return names.join(done, names["name"] == done["canonical_name"], "left_anti").orderBy(F.desc("post_count"), "id").limit(40).select("id", "name", "post_count")


# Set operations


@query("g01_media_with_any_source", "select media_id from signals where media_id is not null union select media_id from source_metadata_records where media_id is not null union select media_id from e")
def _(lib):
    ids = [lib.raw(n).select("media_id").filter("media_id is not null") for n in ("signals", "source_metadata_records")]
    return ids[0].union(ids[1]).union(lib.edges.select("media_id")).distinct()


@query("g03_all_filters", "select id from m where rating = 'safe' intersect select media_id from e where source = 'manual' intersect select media_id from signals where trust_tier = 'strong'")
def _(lib):
    manual, strong = lib.edges.filter("source = 'manual'"), lib.raw("signals").filter("trust_tier = 'strong'")
    return lib.media.filter("rating = 'safe'").join(manual, lib.media["id"] == manual["media_id"], "left_semi").join(strong, lib.media["id"] == strong["media_id"], "left_semi").select("id")


@query("g04_tags_lost", "select tag_id from e where source = 'manual' except select tag_id from e where source = 'ai_wd'")
def _(lib):
    """Tags given by hand that the tagger never gives."""
    by = lambda s: lib.edges.filter(F.col("source") == s).select("tag_id").distinct()
    return by("manual").join(by("ai_wd"), "tag_id", "left_anti")


@query("g05_covered_tags", "select name from t where name in (select canonical_name from tag_translations) intersect select name from t where id in (select tag_id from e)")
def _(lib):
    used = lib.tags.join(lib.edges, F.col("id") == F.col("tag_id"), "left_semi")
    return used.join(lib.tag_translations, F.col("name") == F.col("canonical_name"), "left_semi").select("name").distinct()


@query("g06_roles_subset", "select provider, bool_and(asserted_role in ('artist', 'character', 'person', 'unknown')) as only_known from source_assertions group by 1")
def _(lib):
    known = F.array(*map(F.lit, ("artist", "character", "person", "unknown")))
    return lib.raw("source_assertions").groupBy("provider").agg((F.size(F.array_except(F.collect_set("asserted_role"), known)) == 0).alias("only_known"))


@query("g07_local_over_shared", "select name, category from (select *, row_number() over (partition by name order by prio) as r from (select name, category, 0 as prio from t where id % 3 <> 0 union all select name, 'shared', 1 from t)) where r = 1")
def _(lib):
    local, shared = lib.tags.filter("id % 3 <> 0").select("name", "category", F.lit(0).alias("prio")), lib.tags.select("name", F.lit("shared").alias("category"), F.lit(1).alias("prio"))
    return local.unionByName(shared).groupBy("name").agg(F.min(F.struct("prio", "category"))["category"].alias("category"))


@query("g08_change_journal", "select 'signal' as kind, id from signals where status = 'rejected' union all select 'link', id from signal_links where link_status = 'blocked'")
def _(lib):
    a = lib.raw("signals").filter("status = 'rejected'").select(F.lit("signal").alias("kind"), "id")
    return a.unionByName(lib.raw("signal_links").filter("link_status = 'blocked'").select(F.lit("link").alias("kind"), "id"))

"""Source evidence around the resolver: record fields to names and signals (K1 to K7), duplicates, work pages, queues and audits (K25 to K46)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import text as T
from tagloom.library import Library
from tagloom.session import salted_join

#: Fields of a metadata record that name something: field, role, confidence, needs review.
FIELDS = (("artist_name", "artist", 0.84, False), ("title", "source_title", 0.60, True))
#: States of one work, the first that any of its records is in decides.
LIFECYCLE = ("conflict", "retryable", "pending", "deferred", "terminal", "complete")


def record_names(records: DataFrame) -> DataFrame:
    """(record_id, field, raw_name, name_key, role, confidence, requires_review, script) of every filled field."""
    specs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("raw_name"), F.lit(r).alias("role"), F.lit(c).alias("confidence"), F.lit(v).alias("requires_review")) for f, r, c, v in FIELDS))
    rows = records.select(F.col("id").alias("record_id"), F.explode(specs).alias("x")).select("record_id", "x.*").filter("trim(raw_name) <> ''")
    return rows.withColumns({"name_key": T.canonical_key(F.col("raw_name")), "script": T.script_hint(F.col("raw_name"))})


def applicability(names: DataFrame) -> DataFrame:
    """Per record: the roles it names and why it is or isn't usable."""
    g = names.groupBy("record_id").agg(F.sort_array(F.collect_set("role")).alias("roles"), F.bool_or(~F.col("requires_review")).alias("sure"))
    reason = F.when(~F.col("sure"), "title_only").when(F.array_contains("roles", "artist"), "has_artist").otherwise("other")
    return g.select("record_id", "roles", (F.col("sure") & (F.size("roles") > 0)).alias("applicable"), reason.alias("reason"))


def best_alias(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of highest confidence per key; ties go to the smaller id."""
    return rows.groupBy(*keys).agg(F.max(F.struct("confidence", (-F.col("id")).alias("neg"))).alias("b")).select(*keys, F.col("b.confidence").alias("confidence"), (-F.col("b.neg")).alias("id"))


def name_index(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(search_key, name_key, via): each name by its own key and by aliases in both directions. aliases: (a, b)."""
    own = names.select(F.col("name_key").alias("search_key"), "name_key", F.lit("own").alias("via"))
    both = aliases.select("a", "b").union(aliases.select("b", "a")).toDF("search_key", "name_key").join(names.select("name_key"), "name_key", "left_semi")
    return own.unionByName(both.select("search_key", "name_key", F.lit("alias").alias("via"))).distinct()


def signals_of(lib: Library) -> DataFrame:
    """Signals from media tags, assertions and record fields, under one schema; counters and unnamed roles are dropped or rejected."""
    proper = lib.tags.filter(F.col("category").isin("artist", "character", "copyright") | F.contains("name", F.lit("_("))).select(F.col("id").alias("tag_id"), "name", "category")
    ai = F.coalesce(F.trim(F.lower("source")) == "ai_wd", F.lit(False))
    tags = lib.edges.join(proper, "tag_id").select(
        F.concat(F.lit("media_tag:"), F.col("media_id").cast("string"), F.lit(":"), F.col("tag_id").cast("string")).alias("signal_key"), F.when(ai, "ai_model_tag").otherwise("normal_media_tag").alias("origin_type"), "media_id", F.lit(None).cast("bigint").alias("record_id"),
        F.col("name").alias("raw_value"), T.mapped(F.col("category"), T.ROLES, "character").alias("role_hint"), F.when(ai & F.col("is_suggestion"), "weak").when(ai, "medium_ai").otherwise("strong").alias("trust_tier"), F.when(ai, "needs_review").otherwise("active").alias("status"),
    )
    role = F.col("asserted_role")
    said = lib.raw("source_assertions").select(
        F.concat(F.lit("assertion:"), F.col("id").cast("string")).alias("signal_key"), F.lit("source_assertion").alias("origin_type"), F.lit(None).cast("bigint").alias("media_id"), F.col("source_metadata_record_id").alias("record_id"), F.col("raw_input").alias("raw_value"), role.alias("role_hint"),
        F.when((F.col("status") == "searchable_active") & ~role.isin("unknown", "source_title"), "strong").otherwise("medium").alias("trust_tier"),
        F.when(F.col("status") == "rejected", "rejected").when(role == "source_title", "needs_review").otherwise("active").alias("status"),
    )
    fields = record_names(lib.raw("source_metadata_records")).select(
        F.concat_ws(":", F.lit("field"), F.col("record_id").cast("string"), "field").alias("signal_key"), F.lit("provider_structured_field").alias("origin_type"), F.lit(None).cast("bigint").alias("media_id"), "record_id", "raw_name", F.col("role").alias("role_hint"),
        F.when(F.col("role") == "source_title", "weak").otherwise("medium").alias("trust_tier"), F.lit("needs_review").alias("status"),
    ).withColumnRenamed("raw_name", "raw_value")
    rows = tags.unionByName(said).unionByName(fields).filter("trim(raw_value) <> ''")
    return rows.withColumn("status", F.when(T.popularity(F.col("raw_value")).isNotNull(), "rejected").otherwise(F.col("status")))


# States of inputs that reject a signal, and categories of source tags that name nothing.
REJECTED = ("rejected", "superseded", "blocked", "rejected_candidate")
PLAIN_CATEGORIES = ("", "0", "general", "meta", "5")
SIGNAL = ("signal_key", "origin_type", "media_id", "record_id", "raw_value", "role_hint", "trust_tier", "status")


def _signal(rows: DataFrame, key: Column, origin: str, value: str, role: Column, trust: Column, status: Column) -> DataFrame:
    """Rows as signals; media_id and record_id are null where the source has none, blank values are none."""
    scope = [F.col(c) if c in rows.columns else F.lit(None).cast("bigint").alias(c) for c in ("media_id", "record_id")]
    out = rows.filter(F.trim(value) != "").withColumns({"role_hint": role}).withColumns({"status_made": status, "trust_made": trust})
    return out.select(key.alias("signal_key"), F.lit(origin).alias("origin_type"), *scope, F.col(value).alias("raw_value"), "role_hint", F.col("trust_made").alias("trust_tier"), F.col("status_made").alias("status"))


def _key(kind: str, *parts: str) -> Column:
    return F.concat_ws(":", F.lit(kind), *[F.col(p).cast("string") if p != p.upper() else F.lit(p.lower()) for p in parts])


def name_observation_signals(rows: DataFrame) -> DataFrame:
    """Signals of observed names (id, media_id, record_id, raw_name, name_role, requires_review, status)."""
    role = T.mapped(F.lower("name_role"), T.SOURCE_ROLES, "unknown")
    unsure = F.col("role_hint").isin("unknown", "source_title")
    stated = T.concept_status(F.col("status"), "active")
    status = F.when(unsure | F.coalesce("requires_review", F.lit(False)), "needs_review").otherwise(stated)
    return _signal(rows, _key("name", "id"), "source_name_observation", "raw_name", role, F.when(unsure, "weak").when(status == "rejected", "rejected").otherwise("medium"), status)


def tag_observation_signals(rows: DataFrame) -> DataFrame:
    """Signals of observed source tags (media_id, tag_id, raw_tag, category, status); a name in brackets behind a tag without a role makes it a character."""
    category = F.lower(F.coalesce(F.trim("category"), F.lit("")))
    stated = T.mapped(category, T.SOURCE_TAG_CATEGORY_ROLES, "unknown")
    bracketed = T.parenthetical(F.col("raw_tag"))["inner"].isNotNull()
    role = F.when((stated == "unknown") & bracketed, "character").otherwise(stated)
    out = (category.isin(*PLAIN_CATEGORIES) & (stated == "unknown") & ~bracketed) | T.popularity(F.col("raw_tag")).isNotNull()
    trust = F.when(out, "rejected").when(F.col("role_hint") == "unknown", "weak").otherwise("medium")
    return _signal(rows, _key("tag", "media_id", "tag_id"), "source_tag_observation", "raw_tag", role, trust, F.when(out, "rejected").otherwise(T.concept_status(F.col("status"))))


def alias_candidate_signals(rows: DataFrame) -> DataFrame:
    """Two signals, one a side, of alias candidates (alias_id, source_name, target_name, status, requires_review)."""
    sides = F.array(*(F.struct(F.lit(side).alias("side"), F.col(f"{side}_name").alias("name")) for side in ("source", "target")))
    both = rows.withColumn("s", F.explode(sides)).select("*", "s.side", "s.name").drop("s")
    gone = F.coalesce(F.lower(F.trim("status")).isin(*REJECTED), F.lit(False))
    status = F.when(gone, "rejected").when(F.coalesce("requires_review", F.lit(False)), "needs_review").otherwise(T.concept_status(F.col("status")))
    return _signal(both, _key("alias", "alias_id", "side"), "source_alias_candidate", "name", F.lit("unknown"), F.when(gone, "rejected").otherwise("medium"), status)


def extracted_candidate_signals(rows: DataFrame) -> DataFrame:
    """Signals of extracted candidates (id, record_id, value, candidate_role, candidate_status, origin, active)."""
    role = T.mapped(F.lower("candidate_role"), T.SOURCE_ROLES, "unknown")
    stated = T.concept_status(F.col("candidate_status"))
    gone = (stated == "rejected") | ~F.coalesce("active", F.lit(False))
    ai = F.lower(F.coalesce("origin", F.lit(""))) == "ai_model_tag"
    unsure = F.col("role_hint").isin("source_title", "unknown")
    trust = F.when(gone, "rejected").when(ai & (stated == "active"), "medium_ai").when(ai | unsure, "weak").otherwise("medium")
    return _signal(rows, _key("candidate", "id"), "extracted_candidate", "value", role, trust, F.when(gone, "rejected").when(ai | unsure, "needs_review").otherwise(stated))


def cached_field_signals(rows: DataFrame) -> DataFrame:
    """Signals of the structured fields in cached provider answers (query, then the fields of FIELDS); all are for review."""
    specs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.lit(r).alias("role")) for f, r, _, _ in FIELDS))
    long = rows.select("query", F.explode(specs).alias("x")).select("query", "x.*").distinct()
    key = F.concat_ws(":", F.lit("cache"), "query", "field", F.substring(F.sha2("value", 256), 1, 32))
    return _signal(long, key, "provider_structured_field", "value", F.col("role"), F.when(F.col("role_hint") == "source_title", "weak").otherwise("medium"), F.lit("needs_review"))


def more_signals(lib: Library) -> dict[str, DataFrame]:
    """The five other sources over the library's tables: names and aliases from signals and translations, source tags from imported edges, candidates from assertions, cached answers from records."""
    seen = lib.raw("signals").filter("origin_type = 'source_name_observation'")
    names = seen.select("id", "media_id", F.col("source_metadata_record_id").alias("record_id"), F.col("raw_value").alias("raw_name"), F.col("role_hint").alias("name_role"), (F.col("confidence") < 0.3).alias("requires_review"), "status")
    tags = lib.edges.filter("source = 'booru_import'").select("media_id", "tag_id").join(lib.tags.select(F.col("id").alias("tag_id"), F.col("name").alias("raw_tag"), "category"), "tag_id").withColumn("status", F.lit("observed"))
    aliases = lib.tag_translations.select(F.col("display_name").alias("alias_id"), F.col("display_name").alias("source_name"), F.col("canonical_name").alias("target_name"), "status", F.col("needs_review").alias("requires_review"))
    found = lib.raw("source_assertions").select("id", F.col("source_metadata_record_id").alias("record_id"), F.coalesce("asserted_name", "raw_input").alias("value"), F.col("asserted_role").alias("candidate_role"), F.col("status").alias("candidate_status"), F.col("provider").alias("origin"), (F.col("status") != "superseded").alias("active"))
    cached = lib.raw("source_metadata_records").filter("source_work_id is not null").select(F.concat_ws("/", "provider", "source_work_id").alias("query"), "artist_name", "title")
    return {
        "name_observations": name_observation_signals(names), "tag_observations": tag_observation_signals(tags), "alias_candidates": alias_candidate_signals(aliases),
        "extracted_candidates": extracted_candidate_signals(found), "cached_fields": cached_field_signals(cached),
    }


def all_signals(lib: Library) -> DataFrame:
    """Signals of all eight sources."""
    from functools import reduce

    return reduce(DataFrame.unionByName, more_signals(lib).values(), signals_of(lib).select(*SIGNAL))


def clashing_keys(signals: DataFrame) -> DataFrame:
    """Signal keys that stand for different payloads; a build with any is an error."""
    return signals.groupBy("signal_key").agg(F.count_distinct(F.struct("origin_type", "raw_value", "role_hint")).alias("n")).filter("n > 1")


def duplicates(media: DataFrame, *ties: str) -> DataFrame:
    """Members of groups of equal hash with their rank for keeping (highest confidence of class, largest file, smallest id) and why deleting is risky."""
    from pyspark.sql import Window as W

    same = W.partitionBy("hash")
    order = same.orderBy(F.desc_nulls_last("content_class_confidence"), F.desc_nulls_last("file_size"), "id", *[F.asc_nulls_last(t) for t in ties])
    rows = media.filter("hash is not null").withColumns({"n": F.count("*").over(same), "keep_rank": F.row_number().over(order), "low": F.min("file_size").over(same), "high": F.max("file_size").over(same), "parents": F.max(F.col("parent_id").isNotNull()).over(same)}).filter("n > 1")
    risks = F.array_compact(F.array(F.when(F.col("low") != F.col("high"), "size_differs"), F.when(F.col("parents"), "has_parent")))
    return rows.select("hash", "id", *ties, "n", "keep_rank", risks.alias("risks"), ((F.col("keep_rank") > 1) & (F.size(risks) == 0)).alias("eligible"))


def exclusion(records: DataFrame) -> DataFrame:
    """The first reason that keeps a record from being a target, null for targets."""
    r = F.when(F.col("status") == "rejected", "rejected").when(F.col("status") == "superseded", "superseded").when(F.col("media_id").isNull(), "no_media").when(F.col("title").isNull() & F.col("artist_name").isNull(), "no_names").when(F.coalesce(F.col("similarity") < 50, F.lit(False)), "low_similarity")
    return records.select("id", r.alias("reason"))


def work_pages(records: DataFrame) -> DataFrame:
    """Per work: pages, whether titles and artists agree, and what to do with it."""
    rows = records.filter("source_work_id is not null and status <> 'rejected'")
    g = rows.groupBy("source_work_id").agg(F.count("*").alias("n_records"), F.count_distinct("source_page_index").alias("pages"), F.count_distinct("title").alias("titles"), F.count_distinct("artist_name").alias("artists"), F.count_distinct("media_id").alias("media"), F.max("source_page_index").alias("last_page"))
    reason = F.when(F.col("artists") > 1, "artist_conflict").when(F.col("titles") > 1, "title_conflict").when(F.col("media") == 0, "no_media").when(F.col("last_page") + 1 > F.col("pages"), "pages_missing").otherwise("consistent")
    return g.select("source_work_id", "n_records", "pages", "titles", "artists", "media", reason.alias("state"))


def work_signals(records: DataFrame, pages: DataFrame) -> DataFrame:
    """One artist signal per consistent work, from its only artist."""
    ok = pages.filter("state in ('consistent', 'pages_missing', 'title_conflict') and artists = 1").select("source_work_id", "state")
    rows = records.filter("artist_name is not null and status <> 'rejected'").join(ok, "source_work_id")
    return rows.groupBy("source_work_id", "state").agg(F.min("artist_name").alias("raw_value"), F.count_distinct("media_id").alias("media")).withColumn("status", F.when(F.col("state") == "consistent", "active").otherwise("needs_review"))


def star_candidates(assertions: DataFrame) -> DataFrame:
    """(name_key, first, other, relation): artists of one key tied to the smallest record as must; different providers' records of one key that name different artists can't be."""
    rows = assertions.filter("asserted_role = 'artist' and canonical_name_key <> '' and status <> 'rejected' and source_metadata_record_id is not null").select("canonical_name_key", "source_metadata_record_id", "provider").distinct()
    first = rows.groupBy("canonical_name_key").agg(F.min(F.struct("source_metadata_record_id", "provider")).alias("f"))
    pairs = rows.join(first, "canonical_name_key").filter("source_metadata_record_id > f.source_metadata_record_id")
    return pairs.select(F.col("canonical_name_key").alias("name_key"), F.col("f.source_metadata_record_id").alias("first"), F.col("source_metadata_record_id").alias("other"), F.when(F.col("provider") == F.col("f.provider"), "must").otherwise("deferred").alias("relation"))


def purity(members: DataFrame, group: str, label: str) -> DataFrame:
    """Share of the commonest label in each group."""
    c = members.filter(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("c"))
    return c.groupBy(group).agg(F.sum("c").alias("n"), F.count("*").alias("labels"), F.round(F.max("c") / F.sum("c"), 6).alias("purity"))


def _unit() -> Column:
    return F.coalesce(T.popularity(F.col("raw_input"))["prefix"], F.lower(F.trim("raw_input")))


def unit_keys(assertions: DataFrame) -> DataFrame:
    """Extraction units: rows that would give the same answer share one; how many calls that saves."""
    return assertions.filter("raw_input is not null").groupBy(_unit().alias("unit"), "provider", F.col("asserted_role").alias("role")).agg(F.count("*").alias("occurrences"), (F.count("*") - 1).alias("calls_avoided"), F.min("id").alias("first_id"))


def unit_summary(units: DataFrame) -> DataFrame:
    """Per role: units, rows, saved calls and rows a unit."""
    return units.groupBy("role").agg(F.count("*").alias("units"), F.sum("occurrences").alias("occurrences"), F.sum("calls_avoided").alias("calls_avoided"), F.round(F.avg("occurrences"), 4).alias("mean"))


def _hints() -> Column:
    p, q = T.popularity(F.col("raw_input")), T.parenthetical(F.col("raw_input"))
    why = T.rejection(F.col("raw_input"))
    one = lambda kind, value, conf: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(conf).alias("confidence"))
    return F.array_compact(F.array(
        F.when(p.isNotNull() & (p["prefix"] != ""), one("popularity_prefix", p["prefix"], 0.98)), F.when(why.isNotNull(), one("rejected", F.col("raw_input"), 0.95)),
        F.when(why.isNull() & q["inner"].isNotNull(), one("outer", q["outer"], 0.76)), F.when(why.isNull() & q["inner"].isNotNull(), one("inner", q["inner"], 0.72)),
        F.when(why.isNull() & q["inner"].isNull(), one("name", F.col("raw_input"), 0.78)),
    ))


def hints(assertions: DataFrame) -> DataFrame:
    """Deterministic candidates of each text with fixed confidences: counters split, rejections, bracket parts, plain names."""
    return assertions.select("id", F.explode(_hints()).alias("h")).select("id", "h.*")


def candidates(assertions: DataFrame, hot_rows: int = 500_000) -> DataFrame:
    """(assertion_id, record_id, unit, provider, role, kind, value, confidence, occurrences): the hints of each unit's first text, for every assertion of the unit.

    The key of a unit is its JSON, which leaves nulls out, so units without a provider or role meet too; units of many rows are salted.
    """
    rows = assertions.filter("raw_input is not null").select(F.col("id").alias("assertion_id"), F.col("source_metadata_record_id").alias("record_id"), "raw_input", _unit().alias("unit"), "provider", F.col("asserted_role").alias("role"))
    rows = rows.withColumn("key", F.to_json(F.struct("unit", "provider", "role")))
    units = rows.groupBy("key").agg(F.min(F.struct("assertion_id", "raw_input")).alias("first"), F.count("*").alias("n_rows")).select("key", F.col("first.raw_input").alias("raw_input"), "n_rows")
    units = units.select("key", _hints().alias("hints"), F.col("n_rows").alias("occurrences"), "n_rows")
    found = salted_join(rows.drop("raw_input"), units, "key", "assertion_id", hot_rows=hot_rows)
    return found.select("assertion_id", "record_id", "unit", "provider", "role", F.explode("hints").alias("h"), "occurrences").select("assertion_id", "record_id", "unit", "provider", "role", "h.*", "occurrences")


def pair_scores(s: DataFrame, pairs: DataFrame) -> DataFrame:
    """Additive scores of pairs for a reviewer's queue: shared context, scope, script and origin."""
    cols = ["context", "strength", "media_id", "record_id", "script", "canonical", "ai", "role"]
    side = lambda p: s.select(F.col("id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in cols])
    j = pairs.select("l_id", "r_id").distinct().join(side("l"), "l_id").join(side("r"), "r_id")
    eq = lambda c: F.coalesce(F.col(f"l_{c}") == F.col(f"r_{c}"), F.lit(False))
    explicit = (F.col("l_strength") == "explicit") & (F.col("r_strength") == "explicit")
    points = [
        F.when(eq("context") & explicit, 2.5).when(eq("context"), 2.0).otherwise(0.0), F.when(eq("media_id") | eq("record_id"), 1.5).otherwise(0.0), F.when(eq("canonical") & ~eq("script"), 8.0).otherwise(0.0),
        F.when(~F.col("l_ai") & ~F.col("r_ai"), 3.0).when(F.col("l_ai") & F.col("r_ai"), -5.0).otherwise(0.0), F.when((F.col("l_role") == "unknown") | (F.col("r_role") == "unknown"), -2.0).otherwise(0.0),
    ]
    total: Column = points[0]
    for p in points[1:]:
        total = total + p
    return j.select("l_id", "r_id", total.alias("score"))


def queue_decisions(media: DataFrame, records: DataFrame) -> DataFrame:
    """Per medium: no work named -> not_applicable; several -> conflict; a finished record of that work elsewhere -> complete; else pending."""
    r = records.filter("media_id is not null and source_work_id is not null and status <> 'rejected'")
    per = r.groupBy(F.col("media_id").alias("id")).agg(F.count_distinct(F.struct("source_work_id", "source_page_index")).alias("works"), F.min("source_work_id").alias("source_work_id"))
    done = records.filter("status = 'observed' and title is not null and artist_name is not null").select("source_work_id").distinct().withColumn("done", F.lit(True))
    joined = media.select("id").join(per, "id", "left").join(done, "source_work_id", "left")
    return joined.select("id", F.when(F.col("works").isNull(), "not_applicable").when(F.col("works") > 1, "conflict").when(F.col("done"), "complete").otherwise("pending").alias("decision"))


def record_state(records: DataFrame) -> DataFrame:
    """(source_work_id, media_id, state) of each record in terms of LIFECYCLE."""
    state = F.when(F.col("status") == "rejected", "terminal").when(F.col("status") == "superseded", "deferred").when(F.col("media_id").isNull(), "pending").when(F.col("title").isNull() | F.col("artist_name").isNull(), "retryable").otherwise("complete")
    return records.filter("source_work_id is not null").select("source_work_id", "media_id", state.alias("state"))


def lifecycle(records: DataFrame) -> DataFrame:
    """One state per work, the first in LIFECYCLE that any of its records has."""
    order = F.array(*map(F.lit, LIFECYCLE))
    return record_state(records).groupBy("source_work_id").agg(F.min(F.array_position(order, F.col("state"))).alias("p")).select("source_work_id", F.element_at(order, F.col("p").cast("int")).alias("state"))

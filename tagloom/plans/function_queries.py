"""Scalar functions over whole tables with their oracle SQL; what needs NFKC or case folding has no SQL and is tested on golden strings."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from tagloom.functions import text as T
from tagloom.plans.registry import registry

QUERIES, ORACLE, query = registry()

# For the oracle, which has NFC but no NFKC: full-width marks, letters and digits, half-width kana, ligatures and all gaps in their usual form, gaps collapsed.
_WIDE = "".join(chr(c) for c in (*range(0xFF01, 0xFF5F), *range(0xFF61, 0xFFA0), 0x3000, 0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F))
_USUAL = "".join(unicodedata.normalize("NFKC", c) for c in _WIDE)


def _usual(x: str) -> str:
    named = [text.replace("'", "''") for text in (_WIDE, _USUAL)]
    for ligature in "ﬀﬁﬂﬃﬄﬅﬆ":
        x = f"replace({x}, '{ligature}', '{unicodedata.normalize('NFKC', ligature)}')"
    return f"trim(regexp_replace(nfc_normalize(translate({x}, '{named[0]}', '{named[1]}')), '\\s+', ' ', 'g'))"


def key_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[\\s/／・·,，|]+', '_', 'g'), '[^\\p{{L}}\\p{{N}}_:()+.\\-]', '_', 'g'), '_+', '_', 'g'), '_')"


def family_sql(x: str) -> str:
    """Script families; half-width kana and single letters of Korean syllables are of their script."""
    found = {"latin": "[A-Za-zＡ-Ｚａ-ｚﬀ-ﬆⅠ-ⅿ]", "cjk": "[一-鿿]", "kana": "[぀-ヿｦ-ﾟ]", "hangul": "[가-힯]|[ᄀ-ᄒ][ᅡ-ᅵ]"}
    cases = ", ".join(f"case when regexp_matches({x}, '{chars}') then '{name}' end" for name, chars in found.items())
    return f"coalesce(nullif(concat_ws('+', {cases}), ''), case when {x} is null or {_usual(x)} = '' then 'unknown' else 'other' end)"


def short_sql(x: str) -> str:
    return f"coalesce(length(trim({x}, '_')) <= 3 or (length(trim({x}, '_')) <= 7 and not contains(trim({x}, '_'), '_')), true)"


@query("h01_normalized_text", f"select id, {_usual('raw_input')} as text from source_assertions")
def _(lib):
    return lib.raw("source_assertions").select("id", T.normalize(F.col("raw_input")).alias("text"))


@query("h02_canonical_keys", f"select id, {key_sql(_usual('raw_input'))} as name_key from source_assertions")
def _(lib):
    return lib.raw("source_assertions").select("id", T.canonical_key(F.col("raw_input")).alias("name_key"))


@query("h03_lookup_keys", "select id, regexp_replace(lower(provider), '[^a-z0-9_]', '_', 'g') || '::' || source_work_id as lookup from source_metadata_records")
def _(lib):
    return lib.raw("source_metadata_records").select("id", T.lookup_key(F.col("provider"), F.col("source_work_id")).alias("lookup"))


@query("h04_script_hints", """select id, case when regexp_matches(x, '[぀-ヿ]') then 'kana' when regexp_matches(x, '[가-힯]') then 'hangul' when regexp_matches(x, '[一-鿿]') and regexp_matches(x, '[A-Za-z]') then 'cjk+latin'
  when regexp_matches(x, '[一-鿿]') then 'cjk' when regexp_matches(x, '[A-Za-z]') then 'latin' else 'other' end as hint from (select id, raw_input as x from source_assertions)""")
def _(lib):
    return lib.raw("source_assertions").select("id", T.script_hint(F.col("raw_input")).alias("hint"))


@query("h05_script_families", f"select id, {family_sql('display_value')} as family from signals")
def _(lib):
    return lib.raw("signals").select("id", T.script_family(F.col("display_value")).alias("family"))


@query("h06_parentheticals", r"select id, case when regexp_extract(name, '^(.+?)_?\(([^()]+)\)$', 2) <> '' then regexp_extract(name, '^(.+?)_?\(([^()]+)\)$', 1) else name end as outer_name, nullif(regexp_extract(name, '^(.+?)_?\(([^()]+)\)$', 2), '') as inner_name from t")
def _(lib):
    return lib.tags.select("id", T.parenthetical(F.col("name")).alias("p")).select("id", F.col("p.outer").alias("outer_name"), F.col("p.inner").alias("inner_name"))


@query("h07_search_keys", "select id, list_sort(list_distinct([name, replace(name, '_', ' '), replace(name, '_(', '('), split_part(name, '_(', 1)])) as keys from t")
def _(lib):
    return lib.tags.select("id", F.sort_array(T.search_keys(F.col("name"))).alias("keys"))


_COUNTED = "^(.+?)([0-9]+)\\s*(?:users?入り|users?入|user入り)$"


@query("h08_popularity", f"select id, trim(regexp_extract(x, '(?i){_COUNTED}', 1)) as prefix, try_cast(regexp_extract(x, '(?i){_COUNTED}', 2) as int) as users from (select id, {_usual('raw_input')} as x from source_assertions) where regexp_matches(x, '(?i){_COUNTED}')")
def _(lib):
    p = lib.raw("source_assertions").select("id", T.popularity(F.col("raw_input")).alias("p")).filter("p is not null")
    return p.select("id", "p.prefix", "p.users")


_REASONS = f"""case when x is null or x = '' then 'empty_or_invalid' when regexp_matches(x, '[a-z][a-z0-9+.-]*://') or regexp_matches(x, '^[a-zA-Z]:\\\\') or starts_with(x, '\\\\') then 'url_or_path' when regexp_matches(x, '(?i)^(r-?18|r18g|nsfw)$') then 'explicit_r18_meta'
  when regexp_matches(x, '(?i){_COUNTED}') or regexp_matches(x, '(?i)^(users?入り|users?入|user入り)$') then 'popularity_meta' when {key_sql('x')} in ({', '.join(f"'{k}'" for k in T.DESCRIPTIVE_KEYS)}) then 'descriptive_general' end"""


@query("h09_rejections", f"select id, {_REASONS} as reason from (select id, {_usual('raw_input')} as x from source_assertions)")
def _(lib):
    return lib.raw("source_assertions").select("id", T.rejection(F.col("raw_input")).alias("reason"))


@query("h09_tag_rejections", f"select id, {_REASONS} as reason from (select id, {_usual('name')} as x from tags union all select 1000000 + id, {_usual('filename')} from m union all select 2000000 + id, source from m)")
def _(lib):
    """The same over names of tags, file names and addresses."""
    rows = lib.tags.select("id", F.col("name").alias("x")).union(lib.media.select(F.col("id") + 1000000, "filename")).union(lib.media.select(F.col("id") + 2000000, "source"))
    return rows.select("id", T.rejection(F.col("x")).alias("reason"))


@query("h11_external_ids")
def _(lib):
    """Works and pages named in document texts."""
    ids = lib.raw("documents").select("doc_id", F.explode(T.external_ids(F.col("text"))).alias("x"))
    return ids.select("doc_id", "x.work", "x.page")


@query("h12_work_ids", "select id, case when regexp_full_match(trim(source_work_id), '[0-9]{1,18}') and not regexp_full_match(trim(source_work_id), '0+') then ltrim(trim(source_work_id), '0') end as work from source_metadata_records")
def _(lib):
    return lib.raw("source_metadata_records").select("id", T.work_id(F.col("source_work_id")).alias("work"))


@query("h13_short_keys", f"select id, {short_sql('normalized_key')} as short from signals")
def _(lib):
    return lib.raw("signals").select("id", T.short_key(F.col("normalized_key")).alias("short"))


@query("h14_bounded_keys", "select id, case when length(assertion_key) <= 30 then assertion_key else substr(assertion_key, 1, 13) || ':' || substr(sha256(assertion_key), 1, 16) end as key from source_assertions")
def _(lib):
    return lib.raw("source_assertions").select("id", T.bounded(F.col("assertion_key"), 30).alias("key"))


@query("h15_stable_hashes", """select id, substr(sha256(concat_ws('|', coalesce(length(provider)::varchar || ':' || provider, '-'), coalesce(length(normalized_key)::varchar || ':' || normalized_key, '-'), coalesce(length(role_hint)::varchar || ':' || role_hint, '-'))), 1, 24) as hash from signals""")
def _(lib):
    return lib.raw("signals").select("id", T.stable_hash(F.col("provider"), F.col("normalized_key"), F.col("role_hint")).alias("hash"))


@query("h16_pair_ids", "select s.id as link_id, sha256(least(cast(signal_id as varchar), cast(concept_id as varchar)) || '|' || greatest(cast(signal_id as varchar), cast(concept_id as varchar))) as pair_id from signal_links s where concept_id is not null and signal_id is not null")
def _(lib):
    l = lib.raw("signal_links").filter("concept_id is not null and signal_id is not null")
    return l.select(F.col("id").alias("link_id"), T.pair_id(F.col("signal_id").cast("string"), F.col("concept_id").cast("string")).alias("pair_id"))


def _case(column: str, table: dict, default: str) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in table.items()) + f" else {default} end"


@query("h17_role_mapping", f"select id, {_case('lower(category)', T.TAG_CATEGORY_ROLES, "'unknown'")} as role from t")
def _(lib):
    """Roles of tags by category."""
    return lib.tags.select("id", T.mapped(F.lower("category"), T.TAG_CATEGORY_ROLES, "unknown").alias("role"))


@query("h17_source_roles", f"select id, {_case('lower(asserted_role)', T.SOURCE_ROLES, "'unknown'")} as role, {_case("lower(trim(asserted_role))", T.SOURCE_TAG_CATEGORY_ROLES, "'unknown'")} as tag_role from source_assertions")
def _(lib):
    """Roles that sources state, read as a role and as a tag category."""
    role = F.col("asserted_role")
    return lib.raw("source_assertions").select("id", T.mapped(F.lower(role), T.SOURCE_ROLES, "unknown").alias("role"), T.mapped(F.lower(T.normalize(role)), T.SOURCE_TAG_CATEGORY_ROLES, "unknown").alias("tag_role"))


@query("h17_statuses", f"select id, {_case('lower(status)', T.CONCEPT_STATUS, "'needs_review'")} as concept_status from source_assertions")
def _(lib):
    return lib.raw("source_assertions").select("id", T.concept_status(F.col("status")).alias("concept_status"))


@query("h17_confidences", f"select id, coalesce(try_cast(confidence as double), {_case('lower(confidence)', T.GRADES, 'null')}, confidence_score) as score from source_assertions")
def _(lib):
    """Grades as numbers; where a grade is unknown, the score beside it."""
    return lib.raw("source_assertions").select("id", F.coalesce(T.confidence_score(F.col("confidence")), "confidence_score").alias("score"))


@query("h19_word_split", "select id, list_filter(string_split_regex(name, '[_-]'), lambda x: x <> '') as words from t")
def _(lib):
    return lib.tags.select("id", F.filter(F.split("name", "[_-]"), lambda x: x != "").alias("words"))


@query("h20_extensions", r"select id, lower(regexp_extract(filename, '\.([^.]+)$', 1)) as ext from m")
def _(lib):
    return lib.media.select("id", F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)).alias("ext"))


@query("h21_dates", "select id, strftime(uploaded_at at time zone 'UTC', '%Y-%m-%d') as day, strftime(uploaded_at at time zone 'UTC', '%Y-%m-%dT%H:%M:%S.%g') as iso from m")
def _(lib):
    return lib.media.select("id", F.date_format("uploaded_at", "yyyy-MM-dd").alias("day"), F.date_format("uploaded_at", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("iso"))


@query("h22_allowed_types", "select id, mime_type in ('image/jpeg', 'image/png', 'video/webm') and lower(regexp_extract(filename, '\\.([^.]+)$', 1)) in ('jpg', 'png', 'webm') as allowed from m".replace("\\\\", "\\"))
def _(lib):
    ext = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    return lib.media.select("id", (F.col("mime_type").isin("image/jpeg", "image/png", "video/webm") & ext.isin("jpg", "png", "webm")).alias("allowed"))


@query("h23_json_fields", "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events where json_extract_string(props, '$.k') is not null")
def _(lib):
    return lib.raw("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).filter("k is not null")


@query("h24_ratios", "select id, round(width / nullif(height, 0)::double, 6) as aspect, round_even(100.0::double * file_size / nullif(width::double * height, 0), 2) as byte_percent from m")
def _(lib):
    area = F.col("width").cast("double") * F.col("height")
    return lib.media.select("id", F.round(T.aspect(F.col("width"), F.col("height")), 6).alias("aspect"), T.percent(F.col("file_size").cast("double"), area).alias("byte_percent"))


@query("b38_redaction", """select doc_id, reason, case when reason is null then text else '[redacted:' || reason || ']' end as text from (select doc_id, text, case when regexp_matches(lower(text), '(api[_-]?key|token|password|secret|cookie)\\s*[=:]') then 'secret' when regexp_matches(lower(text), 'https?://|www\\.') then 'url'
  when regexp_matches(lower(text), '(^|[\\s"''(])(/[a-z0-9._-]+){2,}|[a-z]:\\\\') then 'path' when regexp_matches(lower(text), '\\.(jpe?g|png|gif|webm|mp4|webp)([^a-z0-9_]|$)') then 'filename' end as reason from documents)""")
def _(lib):
    d = lib.raw("documents").select("doc_id", T.redacted(F.col("text")).alias("r"))
    return d.select("doc_id", "r.reason", "r.text")


@query("h25_alias_contains", "select canonical_name from tag_translations where alias = 'zharbor_lantern' or display_name = 'zh_lantern_set'")
def _(lib):
    listed = lib.tag_translations.withColumn("names", F.from_json(F.to_json(F.array("alias", "display_name")), "array<string>"))
    return listed.filter(F.arrays_overlap("names", F.array(F.lit("zharbor_lantern"), F.lit("zh_lantern_set")))).select("canonical_name")


@query("h27_tag_strings", "select media_id, pos, name from (select media_id, unnest(list_sort(list(name))) as name, unnest(range(count(*))) as pos from e join t on t.id = tag_id join m on m.id = media_id where m.rating = 'explicit' group by 1)")
def _(lib):
    """Tags written as one string and split again, with their places."""
    edges = lib.edges.join(lib.media.filter("rating = 'explicit'").select(F.col("id").alias("media_id")), "media_id", "left_semi").join(lib.tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    text = edges.groupBy("media_id").agg(F.array_join(F.sort_array(F.collect_list("name")), " ").alias("tags"))
    return text.select("media_id", F.posexplode(F.split("tags", " ")).alias("pos", "name"))


@query("h27_all_tag_strings", "select media_id, pos, name from (select media_id, unnest(list_sort(list(name))) as name, unnest(range(count(*))) as pos from e join t on t.id = tag_id join m on m.id = media_id group by 1)")
def _(lib):
    edges = lib.edges.join(lib.media.select(F.col("id").alias("media_id")), "media_id", "left_semi").join(lib.tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    text = edges.groupBy("media_id").agg(F.array_join(F.sort_array(F.collect_list("name")), " ").alias("tags"))
    return text.select("media_id", F.posexplode(F.split("tags", " ")).alias("pos", "name"))

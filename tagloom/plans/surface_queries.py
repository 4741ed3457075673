"""Parsers, sources and caches as queries, small fixtures for rules that the driver's tables have no case of, and forms of queries that always have rows."""

from __future__ import annotations

import struct
from datetime import datetime, timezone

from pyspark.sql import functions as F

from tagloom.engine import Engine
from tagloom.functions import text as T
from tagloom.operators import evidence as V, resolve as R, soft_search as S
from tagloom.plans import search as P, search_language as L
from tagloom.plans.evidence_queries import _K7, _UNIT
from tagloom.plans.function_queries import _COUNTED, _REASONS, _case, _usual, key_sql
from tagloom.plans.registry import registry
from tagloom.session import shared_dir
from tagloom.sources import exchange as X
from tagloom.streaming.library import Refreshed

QUERIES, ORACLE, query = registry()

_NOW = datetime(2025, 1, 1, tzinfo=timezone.utc)


def _values(columns: str, rows: list[tuple]) -> str:
    """Expected rows as SQL."""
    quote = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) x({columns})"


def _shown(found: L.Range) -> str:
    """A range as text: op:value or op:low..high."""
    one = lambda v: "null" if v is None else v.strftime("%Y-%m-%d") if type(v).__name__ == "date" else v.strftime("%Y-%m-%dT%H:%M") if isinstance(v, datetime) else str(v)
    if found.op == "between":
        return f"between:{one(found.value)}..{one(found.high)}"
    return f"{found.op}:{','.join(map(one, found.value)) if found.op == 'in' else one(found.value)}"


def _table(name: str, doc: str, parse, cases: list[tuple[str, str]]) -> None:
    """A query of a driver-side parser: texts and what they are read as, with the expected readings as its SQL."""

    @query(name, _values("text, parsed", cases))
    def run(lib):
        return lib.spark.createDataFrame([(text, parse(text)) for text, _ in cases], "text string, parsed string")

    QUERIES[name].__doc__ = doc


def _tokens(text: str) -> str:
    return " ".join(f"{'-' * t.negated}{t.kind}[{t.key + ':' if t.key else ''}{t.text}]" for t in L.scan(text, {"kitty": "cat"}))


_table("b01_tokens", "Tokens of query texts.", _tokens, [
    ("cat -dog \"two words\" -\"x y\"", "tag[cat] -tag[dog] tag[two words] -tag[x y]"), ("rating:s -Width:>5", "meta[rating:s] -meta[width:>5]"), ("a*b -c?d \"e*f\"", "wildcard[a*b] -wildcard[c?d] tag[e*f]"),
    ("re:zero", "meta[re:zero]"), ("Kitty", "tag[cat]"), ("", ""), ("\"\"", ""),
])
_table("b02_ranges", "Ranges of whole numbers.", lambda t: _shown(L.parse_range(t, int)), [
    ("1..5", "between:1..5"), ("..5", "le:5"), ("1..", "ge:1"), (">=2", "ge:2"), ("<=2", "le:2"), (">2", "gt:2"), ("<2", "lt:2"), ("3,1,,2", "in:3,1,2"), ("7", "eq:7"),
])
_table("b03_date_ranges", "Date ranges; a bad date anywhere asks for media without one.", lambda t: _shown(L.parse_dates(t)), [
    ("2024-02-03", "eq:2024-02-03"), ("2024-01-01..2024-02-01", "between:2024-01-01..2024-02-01"), ("2024-01-01..soon", "eq:null"), (">=soon", "eq:null"), ("..soon", "eq:null"), ("yesterday", "eq:null"),
])
_table("b04_ages", "Ages before a fixed time.", lambda t: _shown(L.parse_age(t, _NOW)), [
    ("<1w", "gt:2024-12-25T00:00"), ("2w..1y", "between:2024-01-02T00:00..2024-12-18T00:00"), ("1d", "between:2024-12-30T12:00..2024-12-31T12:00"), (">5parsecs", "lt:2025-01-01T00:00"), (">3mo", "lt:2024-10-03T00:00"),
])
_table("b05_sizes", "File sizes; a unit makes an exact size a range.", lambda t: _shown(L.parse_size(t)), [
    ("1.5m", "between:1572864..2621439"), ("100", "eq:100"), ("100kb..", "ge:102400"), (">junk", "gt:0"), ("1kb..2mb", "between:1024..2097152"), ("1kb,2kb", "in:1024,2048"),
])
_table("b06_wildcards", "Wildcards as patterns.", L.wildcard, [("a(*", "(?i)^a\\(.*$"), ("a.b?", "(?i)^a\\.b.?$"), ("\\*", "(?i)^\\\\.*$")])
_table("b23_order_names", "The order a query asks for: order before sort, the last one counts.", lambda t: P.order(L.parse(t))[0]._jc.toString(), [
    ("order:id_asc", "id ASC NULLS FIRST"), ("sort:md5 order:id", "id DESC NULLS LAST"), ("order:nonsense", "uploaded_at DESC NULLS FIRST"), ("order:filesize", "file_size DESC NULLS FIRST"),
])
_table("b29_filter_codec", "Filters as text and back.", lambda t: S.encode_filter(S.decode_filter(S.encode_filter({"key": t}))), [("a", "eyJrZXkiOiJhIn0"), ("猫", "eyJrZXkiOiLnjKsifQ")])


@query("b07_range_filter", "select id, width >= 500 and width <= 900 as mid, duration is null as none, id in (1, 3) as listed from m")
def _(lib):
    """Ranges as filters of columns; equality with nothing is a test for null."""
    on = lambda col, found: P.in_range(F.col(col), found)
    return lib.media.select("id", on("width", L.Range("between", 500, 900)).alias("mid"), on("duration", L.Range("eq", None)).alias("none"), on("id", L.Range("in", [1, 3])).alias("listed"))


@query("b16_md5_found", "select id from m where hash = (select hash from m where id = 1)")
def _(lib):
    """The media with the hash of the first one."""
    found = lib.media.filter("id = 1").first()
    return P.select(lib, L.parse(f"md5:{found['hash']}"), _NOW).select("id")


@query("b19_album_found", "select id from m where exists (select 1 from album_media a join albums b on b.id = a.album_id where a.media_id = m.id and b.name ilike 'customer#00000001%')")
def _(lib):
    return P.select(lib, L.parse("album:customer#00000001%"), _NOW).select("id")


@query("b33_expansions_found", "select id, primary_display_name from concepts where status = 'active' and lower(primary_display_name) = (select lower(primary_display_name) from concepts where status = 'active' order by id limit 1) order by confidence_score desc, id limit 8")
def _(lib):
    """Concepts that the name of the first active one leads to; names alone, whose key differs, aren't in the SQL, so accents are left out of neither."""
    first = lib.raw("concepts").filter("status = 'active'").orderBy("id").limit(1).first()
    named = S.concepts_named(lib, first["primary_display_name"]).filter(F.lower("primary_display_name") == first["primary_display_name"].lower())
    return named.orderBy(F.desc("confidence_score"), "id").limit(8).select("id", "primary_display_name")


@query("c09_word_prefixes", "select a.key as base, b.key as longer from k a join k b on starts_with(b.key, a.key || '_')", "k as (select distinct normalized_key as key from signals where normalized_key is not null)")
def _(lib):
    """Keys that go on after another key: each key's beginnings up to an underscore, so the theta join is an equi-join."""
    keys = lib.raw("signals").select(F.col("normalized_key").alias("key")).filter("key is not null").distinct()
    parts = F.split("key", "_")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "_"))
    longer = keys.filter(F.contains("key", F.lit("_"))).select(F.col("key").alias("longer"), F.explode(F.array_distinct(begins)).alias("key"))
    return keys.join(longer, "key").select(F.col("key").alias("base"), "longer")


@query("h10_name_counters", f"select id from source_assertions where regexp_matches({_usual('raw_input')}, '(?i){_COUNTED}')")
def _(lib):
    return lib.raw("source_assertions").filter(T.popularity(F.col("raw_input")).isNotNull()).select("id")


@query("h11_record_files", "select id, source_work_id || '00' as work, source_page_index as page from source_metadata_records where regexp_full_match(source_work_id, '[0-9]{5,10}') and source_page_index is not null")
def _(lib):
    """Works and pages named in file names made of the records' ids."""
    name = F.concat(F.lit("art "), "source_work_id", F.lit("00_p"), F.col("source_page_index").cast("string"), F.lit(".png"))
    ids = lib.raw("source_metadata_records").select("id", F.explode(T.external_ids(name)).alias("x"))
    return ids.select("id", "x.work", "x.page")


_ASCII = "regexp_matches(raw_input, '^[ -~]*$')"


@query("h01_ascii_texts", f"select id, {_usual('raw_input')} as text from source_assertions where {_ASCII}")
def _(lib):
    """h01 on ASCII texts, which SQL can state, beside the whole table."""
    return lib.raw("source_assertions").filter(F.col("raw_input").rlike("^[ -~]*$")).select("id", T.normalize(F.col("raw_input")).alias("text"))


@query("h02_ascii_keys", f"select id, {key_sql('trim(raw_input)')} as name_key from source_assertions where {_ASCII}")
def _(lib):
    return lib.raw("source_assertions").filter(F.col("raw_input").rlike("^[ -~]*$")).select("id", T.canonical_key(F.col("raw_input")).alias("name_key"))


@query("k44_units_all_scripts", f"select {_UNIT} as unit, provider, asserted_role as role, count(*) as occurrences, count(*) - 1 as calls_avoided, min(id) as first_id from source_assertions where raw_input is not null group by 1, 2, 3".replace(_UNIT, f"coalesce(nullif(trim(regexp_extract({_usual('raw_input')}, '(?i){_COUNTED}', 1)), ''), lower(trim(raw_input, ' ')))"))
def _(lib):
    """Units of all texts; both engines lower the letters of the driver's scripts alike."""
    return V.unit_keys(lib.raw("source_assertions"))


@query("k07_clashing_found", "select signal_key, 2 as n from k7 where origin_type = 'source_assertion'", _K7)
def _(lib):
    """Signal keys of assertions whose text changed in a second build."""
    rows = V.signals_of(lib)
    again = rows.filter("origin_type = 'source_assertion'").withColumn("raw_value", F.concat("raw_value", F.lit("!")))
    return V.clashing_keys(rows.unionByName(again))


_ROLE = _case("lower({})", T.SOURCE_ROLES, "'unknown'")
_STATUS = _case("lower({})", T.CONCEPT_STATUS, "'{}'")
_PAREN = r"(regexp_extract({0}, '^(.+?)_?\(([^()]+)\)$', 2) <> '')"
_HASH = "substr(sha256(value), 1, 32)"
_MADE = {
    "name_observations": f"""select 'name:' || id as signal_key, 'source_name_observation' as origin_type, media_id, record_id, raw_value, role_hint, case when role_hint in ('unknown', 'source_title') then 'weak' when status = 'rejected' then 'rejected' else 'medium' end as trust_tier, status from (
      select *, case when role_hint in ('unknown', 'source_title') or coalesce(low, false) then 'needs_review' else stated end as status from (select id, media_id, source_metadata_record_id as record_id, raw_value, {_ROLE.format('role_hint')} as role_hint, confidence < 0.3 as low, {_STATUS.format('status', 'active')} as stated from signals where origin_type = 'source_name_observation' and trim(raw_value, ' ') <> ''))""",
    "tag_observations": f"""select 'tag:' || media_id || ':' || tag_id as signal_key, 'source_tag_observation' as origin_type, media_id, null::bigint as record_id, name as raw_value, case when stated = 'unknown' and b then 'character' else stated end as role_hint,
      case when o then 'rejected' when stated = 'unknown' and not b then 'weak' else 'medium' end as trust_tier, case when o then 'rejected' else 'active' end as status from (select *, (c in ({", ".join(f"'{x}'" for x in V.PLAIN_CATEGORIES)}) and stated = 'unknown' and not b) or regexp_matches({_usual('name')}, '(?i){_COUNTED}') as o from (
      select media_id, tag_id, name, lower(coalesce(trim(category), '')) as c, {_case("lower(coalesce(trim(category), ''))", T.SOURCE_TAG_CATEGORY_ROLES, "'unknown'")} as stated, {_PAREN.format('name')} as b from e join t on t.id = tag_id where e.source = 'booru_import'))""",
    "alias_candidates": f"""select 'alias:' || display_name || ':' || side as signal_key, 'source_alias_candidate' as origin_type, null::bigint as media_id, null::bigint as record_id, name as raw_value, 'unknown' as role_hint, case when gone then 'rejected' else 'medium' end as trust_tier, case when gone then 'rejected' when needs_review then 'needs_review' else stated end as status from (
      select display_name, side, case side when 'source' then display_name else canonical_name end as name, status in ({", ".join(f"'{x}'" for x in V.REJECTED)}) as gone, needs_review, {_STATUS.format('status', 'needs_review')} as stated from tag_translations, (values ('source'), ('target')) v(side))""",
    "extracted_candidates": f"""select 'candidate:' || id as signal_key, 'extracted_candidate' as origin_type, null::bigint as media_id, record_id, value as raw_value, role_hint, case when gone then 'rejected' when ai and stated = 'active' then 'medium_ai' when ai or unsure then 'weak' else 'medium' end as trust_tier, case when gone then 'rejected' when ai or unsure then 'needs_review' else stated end as status from (
      select *, stated = 'rejected' or coalesce(status, '') in ('', 'superseded') as gone, coalesce(lower(provider), '') = 'ai_model_tag' as ai, role_hint in ('source_title', 'unknown') as unsure from (select id, source_metadata_record_id as record_id, coalesce(asserted_name, raw_input) as value, {_ROLE.format('asserted_role')} as role_hint, status, provider, {_STATUS.format('status', 'needs_review')} as stated from source_assertions) where trim(value, ' ') <> '')""",
    "cached_fields": f"""select distinct 'cache:' || concat_ws('/', provider, source_work_id) || ':' || field || ':' || {_HASH} as signal_key, 'provider_structured_field' as origin_type, null::bigint as media_id, null::bigint as record_id, value as raw_value, role as role_hint, case role when 'source_title' then 'weak' else 'medium' end as trust_tier, 'needs_review' as status from (
      select provider, source_work_id, 'artist_name' as field, artist_name as value, 'artist' as role from source_metadata_records union all select provider, source_work_id, 'title', title, 'source_title' from source_metadata_records) where source_work_id is not null and trim(value, ' ') <> ''""",
}


def _source_of_signals(name: str) -> None:
    @query(f"k07_{name}", _MADE[name])
    def run(lib):
        return V.more_signals(lib)[name]

    QUERIES[f"k07_{name}"].__doc__ = f"Signals from {name.replace('_', ' ')}."


for _name in _MADE:
    _source_of_signals(_name)


@query("k07_all_sources", f"select origin_type, trust_tier, status, count(*) as n from (select origin_type, trust_tier, case when regexp_matches({_usual('raw_value')}, '(?i){_COUNTED}') then 'rejected' else status end as status from k7 {''.join(f' union all select origin_type, trust_tier, status from ({sql})' for sql in _MADE.values())}) group by 1, 2, 3", _K7)
def _(lib):
    """Signals of all eight sources, counted by origin, trust and state."""
    return V.all_signals(lib).groupBy("origin_type", "trust_tier", "status").agg(F.count("*").alias("n"))


_SIGNALS = "id bigint, signal_key string, origin_type string, provider string, media_id bigint, source_metadata_record_id bigint, raw_value string, display_value string, normalized_key string, role_hint string, work_context_key string, trust_tier string, confidence double, status string, created_at timestamp"


def _signal(number: int, key: str, record: int | None, role: str = "character", origin: str = "source_name_observation", shown: str | None = None, media: int | None = None) -> tuple:
    return (number, f"s:{number}", origin, "booru", media, record, shown or key, shown or key, key, role, None, "strong", 0.9, "active", None)


@query("k10_context_fixture", _values("context, label", [("long_work_alt", "other_alias"), ("other_alias", "other_alias"), ("the_long_work", "other_alias")]))
def _(lib):
    """Two records that declare the same work and two other names of it."""
    rows = [s for r in (1, 2) for s in (_signal(10 * r, "the_long_work", r, "work", media=r), _signal(10 * r + 1, "ann_(long_work_alt)", r, media=r), _signal(10 * r + 2, "bob_(other_alias)", r, media=r))]
    return R.context_aliases(R.prepare(lib.spark.createDataFrame(rows, _SIGNALS))).select("context", "label")


@query("k13_alias_fixture", _values("canonical, alias", [("ann", "ann"), ("anna", "ann"), ("ann_lee", "ann"), ("bo", "bo"), ("bob", "bo")]))
def _(lib):
    """Keys that alias signals tie together, directly and over others; a rejected one ties nothing."""
    tied = [("ann", "anna"), ("anna", "ann_lee"), ("bob", "bo"), ("bo", "ann")]
    rows = [_signal(i, key, None, origin="source_alias_candidate", shown=raw) for i, (key, raw) in enumerate(tied)]
    rows[3] = (*rows[3][:13], "rejected", None)
    return R.alias_components(lib.spark.createDataFrame(rows, _SIGNALS))


_PNG, _GIF = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480), b"GIF89a" + struct.pack("<HH", 32, 16)
_JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 300, 200) + b"\x01\x01\x11\x00\x00"


@query("a07_image_sizes", _values("path, kind, width, height", [("a.png", "png", 640, 480), ("b.gif", "gif", 32, 16), ("c.jpg", "jpeg", 200, 300), ("d.txt", None, None, None), ("e.png", None, None, None)]))
def _(lib):
    """Sizes from the first bytes of files."""
    files = [("a.png", _PNG), ("b.gif", _GIF), ("c.jpg", _JPEG), ("d.txt", b"text"), ("e.png", None)]
    return X.image_size(lib.spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in files], "path string, content binary"))


@query("a02_directory_scan")
def _(lib):
    """The files of the data folder itself."""
    return X.scan(lib.spark, lib.folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query("a03_link_reasons", _values("path, reason", [("a/.x.png", "hidden"), ("a/b.png", None), ("a/c.png", "symlink"), ("a/d", "not_a_file"), ("a/e.txt", "unsupported_extension"), ("a/f.png", "zero_byte_file")]))
def _(lib):
    """Reasons against links and folders, where the listing tells them."""
    rows = [("a/.x.png", 1, False, True), ("a/b.png", 1, False, True), ("a/c.png", 1, True, True), ("a/d", 0, False, False), ("a/e.txt", 1, False, True), ("a/f.png", 0, False, True)]
    return X.admissible(lib.spark.createDataFrame(rows, "path string, length bigint, is_link boolean, is_file boolean")).select("path", "reason")


@query("a05_preflight", "select count(*) as n_files, count(*) filter (reason is null) as n_admissible, cast(coalesce(sum(file_size) filter (reason is null), 0) as bigint) as n_bytes from (select file_size, case when starts_with(f, '.') then 'hidden' when ends_with(f, '.icloud') then 'cloud_placeholder' when regexp_extract(f, '\\.([^.]+)$', 1) not in ({}) then 'unsupported_extension' when file_size is null then 'stat_error' when file_size = 0 then 'zero_byte_file' when file_size > {} then 'too_large' end as reason from (select file_size, lower(string_split(path, '/')[-1]) as f from m))".format(", ".join(f"'{e}'" for e in X.EXTENSIONS), X.MAX_BYTES))
def _(lib):
    """Numbers of what an import would take, without reading a file."""
    return X.preflight(lib.media.select("path", F.col("file_size").alias("length")))


@query("a06_untracked_by_hash", "select path from m x where file_size is not null and file_size > 0 and not exists (select 1 from m k where k.rating = 'safe' and k.hash = x.hash) and not exists (select 1 from m k where k.rating = 'safe' and k.path = x.path) and not exists (select 1 from m k where k.rating = 'safe' and k.filename = string_split(x.path, '/')[-1]) and lower(regexp_extract(string_split(path, '/')[-1], '\\.([^.]+)$', 1)) in ({}) and file_size <= {}".format(", ".join(f"'{e}'" for e in X.EXTENSIONS), X.MAX_BYTES))
def _(lib):
    """Files that no safe medium has by path, name or hash; hashes are compared last."""
    files = X.admissible(lib.media.select("path", F.col("file_size").alias("length"), F.col("hash").alias("file_hash")))
    return X.untracked(files, lib.media.filter("rating = 'safe'"), "file_hash").select("path")


@query("a20_cached_counts", "select category, count(*) as n, true as kept from tags group by 1")
def _(lib):
    """Tags per category through the cache: asked twice, the second answer is the first one's."""
    cache, made = X.Cached(lib.spark, f"{shared_dir(lib.spark)}/cache-a20"), []

    def make():
        made.append(1)
        return lib.tags.groupBy("category").agg(F.count("*").alias("n"))

    cache.invalidate("tags/")
    cache.get("tags/categories", lib.folder, make)
    found = cache.get("tags/categories", lib.folder, make)
    return found.withColumn("kept", F.lit(len(made) == 1))


@query("f03_request_order", _values("query, sort, shown", [("rating:s", None, "uploaded_at"), ("rating:s", "file_size", "file_size"), ("rating:s order:md5", "file_size", "hash"), ("rating:s order:id", None, "id")]))
def _(lib):
    """An order in the query beats the request's sort."""
    engine = Engine(lib, _NOW)
    rows = []
    for text, sort in (("rating:s", None), ("rating:s", "file_size"), ("rating:s order:md5", "file_size"), ("rating:s order:id", None)):
        rows.append((text, sort, engine.keys(text, sort)[0]._jc.toString().split(" ")[0]))
    return lib.spark.createDataFrame(rows, "query string, sort string, shown string")


@query("k15_pair_reasons")
def _(lib):
    """How many pairs each rule decides, by reason."""
    from tagloom.plans.resolve_queries import _ready
    from tagloom.session import Scratch

    e = R.edges(Scratch(lib.spark, "k15").put(_ready(lib)))
    return e.groupBy("reason", "negative", "union_allowed").agg(F.count("*").alias("n_pairs"))


@query("l10_refresh", _values("seconds, made", [(0, 1), (299, 1), (300, 2), (500, 2), (601, 3)]))
def _(lib):
    """How often a table is made anew within 300 seconds' time to live."""
    now, made = [0], []
    kept = Refreshed(lambda: made.append(1), 300, lambda: now[0])
    rows = []
    for at in (0, 299, 300, 500, 601):
        now[0] = at
        kept.get()
        rows.append((at, len(made)))
    return lib.spark.createDataFrame(rows, "seconds int, made int")


_HINT = "case when regexp_matches({0}, '[A-Za-z]') then 'latin' else 'other' end"
_K1 = " union all ".join(
    f"select id as record_id, '{f}' as field, {f} as raw_name, {key_sql(f'trim({f})')} as name_key, '{r}' as role, cast({c} as double) as confidence, {str(v).lower()} as requires_review, {_HINT.format(f)} as script from source_metadata_records where trim({f}) <> '' and regexp_matches({f}, '^[ -~]*$')"
    for f, r, c, v in V.FIELDS
)


@query("k01_ascii_names", _K1)
def _(lib):
    """k01 on ASCII names, which SQL can state, beside the whole table."""
    return V.record_names(lib.raw("source_metadata_records")).filter(F.col("raw_name").rlike("^[ -~]*$"))


@query("k04_ascii_registry", f"select name_key, list_sort(list(distinct raw_name)) as variants, count(*) as seen_count, list_sort(list(distinct role)) as roles, bool_or(requires_review) as review from ({_K1}) group by 1")
def _(lib):
    names = V.record_names(lib.raw("source_metadata_records")).filter(F.col("raw_name").rlike("^[ -~]*$"))
    return names.groupBy("name_key").agg(F.sort_array(F.collect_set("raw_name")).alias("variants"), F.count("*").alias("seen_count"), F.sort_array(F.collect_set("role")).alias("roles"), F.bool_or("requires_review").alias("review"))


_INNER = "regexp_extract(raw_input, '^(.+?)_?\\(([^()]+)\\)$', {})"
_WHY = f"(select {_REASONS} from (select {_usual('s.raw_input')} as x))"


@query("k43_ascii_hints", f"""select id, kind, value, confidence from (select id, case when why is not null then 'rejected' when i <> '' then 'outer' else 'name' end as kind, case when why is null and i <> '' then o else raw_input end as value, cast(case when why is not null then 0.95 when i <> '' then 0.76 else 0.78 end as double) as confidence from n
  union all select id, 'inner', i, cast(0.72 as double) from n where why is null and i <> '')""", f"n as (select id, raw_input, {_INNER.format(2)} as i, {_INNER.format(1)} as o, {_WHY} as why from source_assertions s where regexp_matches(raw_input, '^[ -~]*$'))")
def _(lib):
    """k43 on ASCII texts, which hold no counters."""
    return V.hints(lib.raw("source_assertions").filter(F.col("raw_input").rlike("^[ -~]*$")))


def _saved_pages(lib, dialect: str):
    """Media as a site would answer for them, saved as JSON lines and read back."""
    from tagloom.session import Scratch
    from tagloom.sources import posts

    found = P.posts(P.select(lib, L.parse("rating:q"), _NOW), lib)
    if dialect == "categorised":
        answers = found.select("id", F.substring("rating", 1, 1).alias("rating"), "source", F.concat(F.lit("https://a.b/data/"), "filename").alias("file_url"), F.col("width").alias("image_width"), *[f"tag_string_{c}" for c in posts.CATEGORIES])
    else:
        answers = found.select("id", "rating", "source", F.col("filename").alias("image"), "width", F.col("tag_string").alias("tags"))
    path = f"{Scratch(lib.spark, 'a16').root}/{dialect}"
    answers.write.mode("overwrite").json(path)
    out = posts.read_posts(lib.spark, path, dialect, "https://a.b/")
    return out.select("id", "rating", "source", "file_url", "filename", F.col("width").cast("bigint").alias("width"), F.size("tags").alias("n_tags"), F.size(F.filter("tags", lambda t: t["category"] == "artist")).alias("n_artists"))


_SAVED = """select m.id, rating, coalesce(source, '') as source, 'https://a.b/{}' || filename as file_url, filename, cast(coalesce(width, 0) as bigint) as width, cast(coalesce(n, 0) as int) as n_tags, cast(coalesce({}, 0) as int) as n_artists
  from m left join (select media_id, count(*) filter ({}) as n, count(*) filter (category = 'artist') as a from e join t on t.id = tag_id group by 1) c on c.media_id = m.id where rating = 'questionable'"""


@query("a16_categorised_pages", _SAVED.format("data/", "a", "category in ('general', 'artist', 'character', 'copyright', 'meta')"))
def _(lib):
    return _saved_pages(lib, "categorised")


@query("a16_plain_pages", _SAVED.format("", "0", "true"))
def _(lib):
    return _saved_pages(lib, "plain")


_ADDRESSES = [("https://a.b/posts/12?q=x", "categorised", 12), ("https://a.b/index.php?page=post&s=view&id=7", "plain", 7), ("https://a.b/INDEX.php?s=view&id=8&page=post", "plain", 8), ("https://a.b/index.php?page=post&s=list", None, None), ("https://a.b/posts/x", None, None), ("no address", None, None)]


@query("a16_post_addresses", _values("url, dialect, id", _ADDRESSES))
def _(lib):
    from tagloom.sources.posts import post_address

    df = lib.spark.createDataFrame([(u,) for u, _, _ in _ADDRESSES], "url string").withColumn("p", post_address(F.col("url")))
    return df.select("url", "p.dialect", "p.id")


# SQL of whole tables for queries of other modules that need Unicode's normal forms or the rules above.
_HINTS = "case when regexp_matches({0}, '[぀-ヿ]') then 'kana' when regexp_matches({0}, '[가-힯]') then 'hangul' when regexp_matches({0}, '[一-鿿]') and regexp_matches({0}, '[A-Za-z]') then 'cjk+latin' when regexp_matches({0}, '[一-鿿]') then 'cjk' when regexp_matches({0}, '[A-Za-z]') then 'latin' else 'other' end"
_K1_ALL = " union all ".join(
    f"select id as record_id, '{f}' as field, {f} as raw_name, {key_sql(_usual(f))} as name_key, '{r}' as role, cast({c} as double) as confidence, {str(v).lower()} as requires_review, {_HINTS.format(f)} as script from source_metadata_records where trim({f}, ' ') <> ''" for f, r, c, v in V.FIELDS
)
_UNIT_ALL = f"coalesce(nullif(trim(regexp_extract({_usual('raw_input')}, '(?i){_COUNTED}', 1)), ''), lower(trim(raw_input, ' ')))"
_UNITS = f"units as (select {_UNIT_ALL} as unit, provider, asserted_role as role, count(*) as occurrences, count(*) - 1 as calls_avoided, min(id) as first_id from source_assertions where raw_input is not null group by 1, 2, 3)"
_PARTS = f"parts as (select id, raw_input, {_INNER.format(2)} as i, {_INNER.format(1)} as o, trim(regexp_extract({_usual('raw_input')}, '(?i){_COUNTED}', 1)) as p, {_WHY} as why from source_assertions s)"
_HINTED = """hinted as (select id, 'popularity_prefix' as kind, p as value, cast(0.98 as double) as confidence from parts where p <> '' union all select id, 'rejected', raw_input, 0.95 from parts where why is not null
  union all select id, 'outer', o, 0.76 from parts where why is null and i <> '' union all select id, 'inner', i, 0.72 from parts where why is null and i <> '' union all select id, 'name', raw_input, 0.78 from parts where why is null and coalesce(i, '') = '')"""
ORACLE |= {
    "h18_entity_keys": f"select id, replace(lower({_usual('primary_display_name')}), ' ', '_') as entity_key from concepts",
    "k01_record_names": _K1_ALL,
    "k04_registry_bundle": f"select name_key, list_sort(list(distinct raw_name)) as variants, count(*) as seen_count, list_sort(list(distinct role)) as roles, bool_or(requires_review) as review from ({_K1_ALL}) group by 1",
    "k06_candidates": f"""with {_UNITS}, {_PARTS}, {_HINTED} select a.id as assertion_id, a.source_metadata_record_id as record_id, u.unit, u.provider, u.role, h.kind, h.value, h.confidence, occurrences from (select *, {_UNIT_ALL} as unit from source_assertions where raw_input is not null) a
      join units u on u.unit = a.unit and u.provider is not distinct from a.provider and u.role is not distinct from a.asserted_role join hinted h on h.id = u.first_id""",
    "k43_hints": f"with {_PARTS}, {_HINTED} select id, kind, value, confidence from hinted",
    "k44_all_units": f"with {_UNITS} select * from units",
    "k46_all_summary": f"with {_UNITS} select role, count(*) as units, cast(sum(occurrences) as bigint) as occurrences, cast(sum(calls_avoided) as bigint) as calls_avoided, round(avg(occurrences), 4) as mean from units group by 1",
}

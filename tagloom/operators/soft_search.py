"""Soft search (B26, B30 to B34): a term matches a medium by tag, source text, source name, source tag, concept, or one of these names under an alias.

Each term gives one union of six sets of media ids, made distinct once, and one semi or anti join; no OR of EXISTS.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import text as T
from tagloom.library import LISTED_IDS, Library
from tagloom.operators import graph, tagstore

ACTIVE_CONCEPTS, ACTIVE_LINKS = ("active",), ("active", "materialized_identity")  # fixed values


def term_key(term: str) -> str:
    return T._key(term)


def _spellings(term: str) -> list[str]:
    key = term_key(term)
    return sorted({term.lower(), key, key.replace("_", " ")})


def by_tags(lib: Library, term: str) -> DataFrame:
    """Confirmed tags of that name, of a translation to it, or that name with a context in brackets."""
    names = _spellings(term)
    translated = lib.tag_translations.filter((F.col("status") != "rejected") & (F.lower("display_name").isin(names) | F.lower("alias").isin(names))).select(F.col("canonical_name").alias("name"))
    hit = lib.tags.select("id", "name").join(translated, "name", "left_semi").select("id").union(lib.tags.filter(F.lower("name").isin(names) | F.startswith(F.lower("name"), F.lit(term_key(term) + "_("))).select("id"))
    return lib.edges_in(hit.distinct().select(F.col("id").alias("tag_id"))).filter("not is_suggestion").select("media_id")


def alias_relation(lib: Library) -> DataFrame:
    """(a, b), keys of names that stand for each other, in both directions: aliases of tags, translations that aren't rejected, aliases of source names."""
    tags = lib.tag_aliases.join(lib.tags.select(F.col("id").alias("target_tag_id"), "name"), "target_tag_id").select(F.col("alias_name").alias("a"), F.col("name").alias("b"))
    shown = lib.tag_translations.filter("status <> 'rejected'").select("display_name", "canonical_name")
    keys = tags.union(shown).union(lib.name_aliases.select("a", "b")).select(T.canonical_key(F.col("a")).alias("a"), T.canonical_key(F.col("b")).alias("b")).dropna()
    return keys.union(keys.select("b", "a")).distinct()


def _relation(lib: Library) -> DataFrame:
    return lib.prepared("alias_keys", "tags", lambda: alias_relation(lib), "a", "b")


def _tag_keys(lib: Library) -> DataFrame:
    return lib.prepared("tag_keys", "tags", lambda: lib.tags.select("id", T.canonical_key(F.col("name")).alias("name_key")), "name_key")


def prepare(lib: Library) -> None:
    """Writes the tables of keys that soft searches share, if they aren't there."""
    _ = _relation(lib), _tag_keys(lib)


def alias_keys(lib: Library, term: str, rounds: int = 2) -> list[str] | DataFrame:
    """Keys that the alias relation reaches from a term in at most ``rounds`` steps; a frame (key) if they are more than ``LISTED_IDS``."""
    relation = _relation(lib)
    own = term_key(term)
    found, last = {own}, [own]
    for _ in range(rounds):
        near = [r["b"] for r in relation.filter(F.col("a").isin(last)).select("b").distinct().limit(LISTED_IDS + 1).collect()]
        if len(near) > LISTED_IDS:
            reached = graph.expand(lib.spark.createDataFrame([(own,)], "key string"), relation, rounds)
            return reached.filter("hops > 0").select("key").distinct()
        last = sorted(set(near) - found)
        found |= set(last)
        if not last:
            break
    return sorted(found - {own})


def by_aliases(lib: Library, term: str, review: bool = False, rounds: int = 2) -> DataFrame:
    """Confirmed tags and assertions under any name that the alias relation reaches from the term in at most ``rounds`` steps, read both ways."""
    keys = alias_keys(lib, term, rounds)
    if isinstance(keys, list):
        named = lambda df, column: df.filter(column.isin(keys))
    else:
        named = lambda df, column: df.join(keys, column == keys["key"], "left_semi")
    tags = named(_tag_keys(lib), F.col("name_key")).select(F.col("id").alias("tag_id"))
    said = named(_assertions(lib, review), F.col("canonical_name_key")).select("source_metadata_record_id")
    return lib.edges_in(tags).filter("not is_suggestion").select("media_id").union(said.join(_records(lib), "source_metadata_record_id").select("media_id"))


def _records(lib: Library) -> DataFrame:
    return lib.raw("source_metadata_records").filter("media_id is not null").select(F.col("id").alias("source_metadata_record_id"), "media_id")


def _assertions(lib: Library, review: bool) -> DataFrame:
    wanted = ("searchable_active", "needs_review") if review else ("searchable_active",)
    return lib.raw("source_assertions").filter(F.col("status").isin(*wanted))


def by_text(lib: Library, term: str, review: bool = False) -> DataFrame:
    """Assertions typed exactly like the term."""
    hit = _assertions(lib, review).filter((F.lower("raw_input") == term.lower()) | (F.lower("normalized_input") == term.lower()))
    return hit.select("source_metadata_record_id").join(_records(lib), "source_metadata_record_id").select("media_id")


def by_names(lib: Library, term: str, review: bool = False) -> DataFrame:
    """Assertions with the term's key."""
    return _assertions(lib, review).filter(F.col("canonical_name_key") == term_key(term)).select("source_metadata_record_id").join(_records(lib), "source_metadata_record_id").select("media_id")


def by_source_tags(lib: Library, term: str) -> DataFrame:
    s = lib.raw("signals")
    return s.filter((F.col("origin_type") == "source_tag_observation") & (F.col("normalized_key") == term_key(term)) & (F.col("status") != "rejected") & F.col("media_id").isNotNull()).select("media_id")


def concepts_named(lib: Library, term: str, review: bool = False) -> DataFrame:
    wanted = (*ACTIVE_CONCEPTS, "needs_review") if review else ACTIVE_CONCEPTS
    c = lib.raw("concepts").filter(F.col("status").isin(*wanted))
    return c.filter((F.lower("primary_display_name") == term.lower()) | (F.substring_index("concept_key", ":", 1) == term_key(term)))


def by_concepts(lib: Library, term: str, review: bool = False) -> DataFrame:
    """Media of the signals linked to a concept of that name."""
    ids = concepts_named(lib, term, review).select(F.col("id").alias("concept_id"))
    links = lib.raw("signal_links").filter(F.col("link_status").isin(*ACTIVE_LINKS) & F.col("negative_reason_code").isNull()).join(ids, "concept_id", "left_semi").select("signal_id")
    s = lib.raw("signals").filter("media_id is not null").select(F.col("id").alias("signal_id"), "media_id")
    return links.join(s, "signal_id").select("media_id")


def media_of(lib: Library, term: str, review: bool = False) -> DataFrame:
    """All media ids a term matches, once."""
    sets = [by_tags(lib, term), by_text(lib, term, review), by_names(lib, term, review), by_source_tags(lib, term), by_concepts(lib, term, review), by_aliases(lib, term, review)]
    return reduce(DataFrame.union, sets).distinct()


def search(lib: Library, include: list[str], exclude: list[str], review: bool = False) -> DataFrame:
    """Media that match every included term and no excluded one."""
    media = lib.media
    for term in include:
        hit = media_of(lib, term, review).withColumnRenamed("media_id", "__m")
        media = media.join(hit, media["id"] == hit["__m"], "left_semi")
    for term in exclude:
        hit = media_of(lib, term, review).withColumnRenamed("media_id", "__m")
        media = media.join(hit, media["id"] == hit["__m"], "left_anti")
    return media


def source_filter(media: DataFrame, lib: Library, assertions: list[str], tags: list[str]) -> DataFrame:
    """Media with all the given assertion keys and source tags; an empty key matches nothing."""
    for kind, keys in (("assertion", assertions), ("tag", tags)):
        for key in keys:
            hit = (by_names if kind == "assertion" else by_source_tags)(lib, key) if key else lib.media.limit(0).select(F.col("id").alias("media_id"))
            hit = hit.withColumnRenamed("media_id", "__m")
            media = media.join(hit, media["id"] == hit["__m"], "left_semi")
    return media


def encode_filter(fields: dict[str, str]) -> str:
    """A filter as text for an address: JSON with sorted keys in url-safe base64 without padding."""
    import base64
    import json

    return base64.urlsafe_b64encode(json.dumps(fields, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_filter(text: str) -> dict[str, str]:
    """The filter of a text; a text that is none is read as a key."""
    import base64
    import json

    try:
        found = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        return found if isinstance(found, dict) else {"key": term_key(text)}
    except ValueError:
        return {"key": term_key(text)}


def resolve_term(aliases: dict[str, list[str]], revoked: set[str], static: dict[str, str], term: str) -> str:
    """One trusted target replaces a term; several leave it; without any, the static dictionary may."""
    key = term.lower()
    if key in revoked:
        return term
    targets = aliases.get(key, [])
    return targets[0] if len(targets) == 1 else term if targets else static.get(key, term)


def resolve_terms(terms: DataFrame, translations: DataFrame, static: DataFrame | None = None) -> DataFrame:
    """(term, resolved) of each term: its one target among trusted translations, by the text itself or its key; several targets leave it, and without any the
    static dictionary (text, name) may."""
    aliases = tagstore.alias_map(translations).select("alias", F.explode("targets").alias("target"))
    asked = terms.select("term").filter("term is not null").distinct().withColumns({"text": F.lower("term"), "key": T.canonical_key(F.col("term"))})
    same = asked.join(aliases, F.col("text") == F.col("alias")).select("term", "target")
    alike = asked.join(aliases.select(T.canonical_key(F.col("alias")).alias("key"), "target").filter("key <> ''").distinct(), "key").select("term", "target")
    found = same.union(alike).groupBy("term").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target"))
    out = asked.join(found, "term", "left")
    if static is not None:
        out = out.join(static.select("text", F.col("name").alias("__static")), "text", "left")
    other = F.col("__static") if static is not None else F.lit(None).cast("string")
    return out.select("term", F.when(F.col("n") == 1, F.col("target")).when(F.col("n") > 1, F.col("term")).otherwise(F.coalesce(other, "term")).alias("resolved"))


def like(column: Column, text: str) -> Column:
    """column contains text, its own wildcards taken literally."""
    return F.contains(F.lower(column), F.lit(text.lower()))

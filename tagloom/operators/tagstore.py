"""Upserts with precedence (I): the tag store, translations, entities, albums and registries.

Each change is (existing full-outer incoming) -> one decision per row -> new snapshot; the decision is a plain column expression, so one shuffle on
the key does it. Incoming rows are reduced to one per key first (the last by ``turn``), with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Priorities of translation sources, best first, and confidence limits of the tagger.
SOURCE_ORDER = ("manual", "static", "llm", "imported")
SUGGEST_BELOW = 0.5
FIELDS = ["source", "confidence", "is_locked", "is_suggestion"]


def _both(existing: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    old = existing.select(*keys, *[F.col(c).alias(f"old_{c}") for c in fields], F.lit(True).alias("had"))
    new = incoming.select(*keys, *[F.col(c).alias(f"new_{c}") for c in incoming.columns if c not in keys], F.lit(True).alias("came"))
    return old.join(new, keys, "full").withColumns({"had": F.coalesce("had", F.lit(False)), "came": F.coalesce("came", F.lit(False))})


def last_per_key(rows: DataFrame, keys: list[str], turn: str) -> DataFrame:
    """One row per key, the one with the largest turn."""
    rest = [c for c in rows.columns if c not in (*keys, turn)]
    return rows.groupBy(*keys).agg(F.max(F.struct(turn, *rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def set_tags(existing: DataFrame, incoming: DataFrame, source: str = "manual") -> DataFrame:
    """Manual or imported tags: always win, full confidence, locked, no suggestion. incoming: (media_id, tag_id)."""
    both = _both(existing, incoming.select("media_id", "tag_id").distinct(), ["media_id", "tag_id"], FIELDS)
    pick = lambda c, v: F.when(F.col("came"), F.lit(v)).otherwise(F.col(f"old_{c}")).alias(c)
    return both.select("media_id", "tag_id", pick("source", source), pick("confidence", 1.0), pick("is_locked", True), pick("is_suggestion", False))


def ai_tags(existing: DataFrame, incoming: DataFrame, threshold: float = SUGGEST_BELOW) -> DataFrame:
    """Tagger results: never over a locked or manual row; others take the new score, new rows are unlocked. incoming: (media_id, tag_id, confidence)."""
    both = _both(existing, incoming, ["media_id", "tag_id"], FIELDS)
    held = F.coalesce(F.col("old_is_locked"), F.lit(False)) | F.coalesce(F.col("old_source") == "manual", F.lit(False))
    take = F.col("came") & ~(F.col("had") & held)
    return both.select(
        "media_id", "tag_id", F.when(take, "ai_wd").otherwise(F.col("old_source")).alias("source"), F.when(take, F.col("new_confidence")).otherwise(F.col("old_confidence")).alias("confidence"),
        F.when(F.col("had"), F.col("old_is_locked")).otherwise(F.lit(False)).alias("is_locked"), F.when(take, F.col("new_confidence") < threshold).otherwise(F.col("old_is_suggestion")).alias("is_suggestion"),
    )


def review(existing: DataFrame, actions: DataFrame) -> DataFrame:
    """Review decisions (media_id, tag_id, action): confirm locks a suggestion, reject deletes one, lock locks, delete removes any row."""
    both = existing.join(actions.select("media_id", "tag_id", "action"), ["media_id", "tag_id"], "left")
    act, hint = F.col("action"), F.col("is_suggestion")
    gone = F.coalesce((act == "delete") | ((act == "reject") & hint), F.lit(False))
    confirm = F.coalesce((act == "confirm") & hint, F.lit(False))
    return both.filter(~gone).select(
        "media_id", "tag_id", "source", "confidence", F.when(confirm | F.coalesce(act == "lock", F.lit(False)), True).otherwise(F.col("is_locked")).alias("is_locked"), F.when(confirm, False).otherwise(hint).alias("is_suggestion")
    )


def provenance(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """New values where they aren't null; changes: (media_id, tag_id, source, confidence, is_locked)."""
    both = existing.join(changes.select("media_id", "tag_id", *[F.col(c).alias(f"new_{c}") for c in ("source", "confidence", "is_locked")]), ["media_id", "tag_id"], "left")
    return both.select("media_id", "tag_id", *[F.coalesce(f"new_{c}", c).alias(c) for c in ("source", "confidence", "is_locked")], "is_suggestion")


def replace_tags(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """The tags of the media in ``wanted`` (media_id, tag_id) become exactly those; other media keep theirs. A null tag empties a medium."""
    touched = wanted.select("media_id").distinct()
    rest = existing.join(touched, "media_id", "left_anti").select("media_id", "tag_id", *FIELDS)
    kept = existing.join(touched, "media_id", "left_semi").join(wanted, ["media_id", "tag_id"], "left_semi").select("media_id", "tag_id", *FIELDS)
    return rest.unionByName(set_tags(kept, wanted.filter("tag_id is not null")))


def source_rank(column: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for i, s in enumerate(SOURCE_ORDER) for x in (s, i)])[F.col(column)], F.lit(len(SOURCE_ORDER)))


def upsert_translations(existing: DataFrame, incoming: DataFrame, force: bool = False) -> DataFrame:
    """One translation per (canonical_name, language); a source of lower priority never replaces a better one unless forced."""
    both = _both(existing, incoming, ["canonical_name", "language"], ["display_name", "source", "status"])
    take = F.col("came") & (~F.col("had") | F.lit(force) | (source_rank("new_source") <= source_rank("old_source")))
    return both.select("canonical_name", "language", *[F.when(take, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in ("display_name", "source", "status")])


def alias_map(translations: DataFrame) -> DataFrame:
    """(alias, targets): trusted rows only, the best source wins, all targets of a tie are kept.

    Rows of plain categories are trusted; proper nouns need a manual or static source, or a finished review.
    """
    proper = F.col("category").isin("artist", "character", "copyright")
    trusted = ~F.coalesce(proper, F.lit(False)) | F.col("source").isin("manual", "static") | ((F.col("status") == "reviewed") & ~F.col("needs_review"))
    rows = translations.filter((F.col("status") != "rejected") & trusted).withColumn("alias", F.explode(F.array_distinct(F.array(F.lower("display_name"), F.lower("alias"))))).withColumn("p", source_rank("source"))
    best = rows.groupBy("alias").agg(F.min("p").alias("p"))
    return rows.join(best, ["alias", "p"]).groupBy("alias").agg(F.sort_array(F.collect_set("canonical_name")).alias("targets"))


def display_names(tags: DataFrame, translations: DataFrame) -> DataFrame:
    """(name, shown): the best translation that isn't rejected, else the name itself."""
    best = translations.filter("status <> 'rejected'").groupBy(F.col("canonical_name").alias("name")).agg(F.min(F.struct(source_rank("source").alias("p"), "display_name")).alias("b"))
    return tags.select("name").join(best, "name", "left").select("name", F.coalesce("b.display_name", "name").alias("shown"))


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of incoming whose key is new, one per key (the smallest row)."""
    rest = [c for c in incoming.columns if c not in keys]
    one = incoming.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]) if rest else incoming.distinct()
    return one.join(existing.select(*keys), keys, "left_anti")


def sync_shared(local: DataFrame, shared: DataFrame) -> DataFrame:
    """(name, side): names each side lacks ('to_shared', 'to_local') and those whose categories differ ('conflict')."""
    both = local.select("name", F.col("category").alias("a"), F.lit(True).alias("l")).join(shared.select("name", F.col("category").alias("b"), F.lit(True).alias("s")), "name", "full")
    side = F.when(F.col("s").isNull(), "to_shared").when(F.col("l").isNull(), "to_local").when(~F.col("a").eqNullSafe(F.col("b")), "conflict")
    return both.select("name", side.alias("side")).filter("side is not null")


def assign(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Assignments (media_id, entity_id, role, status, source, evidence_id, locked): a confirmed one that isn't manual needs evidence, locked rows yield to manual ones only."""
    good = incoming.filter((F.col("status") != "confirmed") | (F.col("source") == "manual") | F.col("evidence_id").isNotNull())
    fields = ["status", "source", "evidence_id", "locked"]
    both = _both(existing, good, ["media_id", "entity_id", "role"], fields)
    take = F.col("came") & (~F.coalesce("old_locked", F.lit(False)) | (F.col("new_source") == "manual"))
    return both.select("media_id", "entity_id", "role", *[F.when(take, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in fields])


def merge_registry(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Registry rows (key, variants, providers, seen_count): variants united, provider counts and totals added."""
    both = _both(existing, incoming, ["key"], ["variants", "providers", "seen_count"])
    none, empty = F.array().cast("array<string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    providers = F.map_zip_with(F.coalesce("old_providers", empty), F.coalesce("new_providers", empty), lambda k, a, b: zero(a) + zero(b))
    return both.select("key", F.array_sort(F.array_union(F.coalesce("old_variants", none), F.coalesce("new_variants", none))).alias("variants"), providers.alias("providers"), (zero("old_seen_count") + zero("new_seen_count")).alias("seen_count"))


def supersede(existing: DataFrame, emitted: DataFrame, scope: str, key: str) -> DataFrame:
    """Rows of the emitted scopes that weren't emitted again become superseded; other scopes stay as they are."""
    scopes = emitted.select(F.col(scope)).distinct().withColumn("in_scope", F.lit(True))
    again = emitted.select(scope, key).distinct().withColumn("again", F.lit(True))
    joined = existing.join(scopes, scope, "left").join(again, [scope, key], "left")
    status = F.when(F.col("in_scope") & F.col("again").isNull(), "superseded").otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("in_scope", "again")


def guarded(current: DataFrame, wanted: DataFrame, same: bool) -> DataFrame:
    """The new snapshot of a run if the fingerprint it was planned on still holds, else the current one."""
    return wanted if same else current


def reparent(media: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, new_parent, reason) of parent changes (id, new_parent): one level only, so a parent mustn't be a child, a child mustn't have children, and none is its own."""
    kids = media.filter("parent_id is not null").select(F.col("parent_id").alias("id")).distinct().withColumn("has_kids", F.lit(True))
    parents = media.select(F.col("id").alias("new_parent"), F.lit(True).alias("known"), F.col("parent_id").isNotNull().alias("is_child"))
    joined = changes.join(kids, "id", "left").join(parents, "new_parent", "left")
    reason = (
        F.when(F.col("new_parent").isNull(), None).when(F.col("id") == F.col("new_parent"), "self").when(F.col("known").isNull(), "missing").when(F.col("is_child"), "parent_is_child").when(F.col("has_kids"), "has_children")
    )
    return joined.select("id", "new_parent", reason.alias("reason"))


def create_entities(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """New entities (entity_type, normalized_key, name), one per type and key, those that exist left out."""
    return insert_absent(existing, incoming, ["entity_type", "normalized_key"])


def decide_candidates(candidates: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates with their new status, assignments of the accepted ones). decisions: (media_id, entity_id, role, accept)."""
    key = ["media_id", "entity_id", "role"]
    joined = candidates.join(decisions, key, "left")
    status = F.when(F.col("accept"), "accepted").when(~F.col("accept"), "rejected").otherwise(F.col("status"))
    done = joined.withColumn("status", status).drop("accept")
    return done, done.filter("status = 'accepted'").select(*key, F.lit("confirmed").alias("status"), F.lit("manual").alias("source"), F.lit(None).cast("bigint").alias("evidence_id"), F.lit(True).alias("locked"))

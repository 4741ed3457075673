"""Entity resolution of name signals (K8 to K24): contexts, ambiguity, blocking, pair rules, constrained union, concepts.

Signals have id, surface, canonical, role, context, trust, status, provider, media_id, record_id, confidence, display, script, ai. Every step is a
plan over whole tables; pairs arise only inside blocks of at most ``BLOCK`` signals, larger identity blocks are split by six features, and
a part that is still larger is tied to its best signal as a star. Only the order-dependent greedy union runs in Python, once per unconstrained component.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.functions import text as T
from tagloom.operators import graph
from tagloom.operators.stats import entropy
from tagloom.session import Scratch, salted_join

BLOCK = 60
# Trust weights, keys that identify nobody, reasons that forbid a merge.
TRUST = {"strong": 1.0, "medium": 0.65, "medium_ai": 0.45, "weak": 0.25, "rejected": 0.0}
STOP_KEYS = ("original", "unknown", "artist", "character", "girl", "boy", "tagme", "untitled", "unknown_artist", "original_character")
CONTEXT_STOP_KEYS = ("animal", "bunny", "cheerleading", "clothes", "clothing", "creature", "cup", "flower", "food", "medium", "object", "place", "series", "shape", "sky", "small", "spring", "swimsuit", "symbol", "track")
#: Most contexts beside its work that a record may declare.
ALIASES = 12
HARD = ("role_conflict", "source_title_only_guard", "creator_identity_strong_evidence_missing", "work_context_conflict", "alias_work_context_conflict", "rejected_signal_guard", "generic_identity_surface_guard", "llm_cannot_link")


def trust_weight(column: str | Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in TRUST.items() for x in pair])[F.col(column) if isinstance(column, str) else column], F.lit(0.0))


def prepare(signals: DataFrame) -> DataFrame:
    """The signal table under the names used here; keys in brackets give the surface and a context."""
    p = T.parenthetical(F.col("normalized_key"))
    return signals.filter("id is not null and normalized_key is not null and normalized_key <> ''").select(
        "id", p["outer"].alias("surface"), F.col("normalized_key").alias("canonical"), F.coalesce("role_hint", F.lit("unknown")).alias("role"), F.coalesce("work_context_key", p["inner"]).alias("declared"),
        F.col("trust_tier").alias("trust"), "status", "provider", "media_id", F.col("source_metadata_record_id").alias("record_id"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("display_value", F.lit("")).alias("display"),
        T.script_family(F.coalesce("display_value", F.lit(""))).alias("script"), F.coalesce(F.col("trust_tier") == "medium_ai", F.lit(False)).alias("ai"), "origin_type", p["inner"].isNotNull().alias("bracketed"),
        F.col("work_context_key").alias("work_context"), F.array_compact(F.array(p["inner"], T.parenthetical(F.col("raw_value"))["inner"])).alias("brackets"),
    )


def usable(s: DataFrame) -> DataFrame:
    return s.filter("coalesce(status, '') <> 'rejected' and coalesce(trust, '') <> 'rejected'")


def ambiguity(s: DataFrame) -> DataFrame:
    """Score per surface of how many different things it may name; ambiguous from 0.5 on."""
    rows = usable(s)
    g = rows.groupBy("surface").agg(
        F.count("*").alias("n"), F.count_distinct("declared").alias("contexts"), F.count_distinct("provider").alias("providers"), F.count_distinct("record_id").alias("records"), F.count_distinct("media_id").alias("media"),
        F.count_distinct("script").alias("scripts"), F.bool_or("bracketed").alias("bracketed"),
    ).join(entropy(rows, "surface", "role").select("surface", F.bround("entropy", 4).alias("entropy")), "surface")
    ctx = F.col("contexts")
    score = (
        F.when(T.short_key(F.col("surface")), 0.35).otherwise(0.0)
        + F.when(ctx == 0, 0.15).when(ctx > 1, F.least(F.lit(0.5), 0.25 + 0.08 * (ctx - 1))).otherwise(0.0)
        + F.when(F.col("n") >= 5, F.least(F.lit(0.25), 0.08 + 0.04 * F.log2(F.col("n").cast("double")))).otherwise(0.0)
        + 0.25 * F.col("entropy")
        + F.when((F.col("providers") > 1) & (ctx > 1), 0.08).otherwise(0.0)
        - F.when((ctx == 1) & (F.greatest("records", "media") >= 2), 0.25).otherwise(0.0)
        - F.when(F.col("bracketed"), 0.15).otherwise(0.0)
        - F.when((F.col("scripts") > 1) & (ctx <= 1), 0.05).otherwise(0.0)
    )
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)
    return g.select("surface", "n", "contexts", "providers", "entropy", score.alias("score"), (score >= 0.5).alias("ambiguous"))


def context_sets(s: DataFrame) -> DataFrame:
    """(scope, scope_id, contexts): the contexts declared in one medium or one record."""
    scopes = F.explode(F.array(F.struct(F.lit("media").alias("scope"), F.col("media_id").alias("scope_id")), F.struct(F.lit("record").alias("scope"), F.col("record_id").alias("scope_id"))))
    rows = usable(s).filter("declared is not null").select(scopes.alias("s"), "declared").select("s.scope", "s.scope_id", "declared").filter("scope_id is not null")
    return rows.groupBy("scope", "scope_id").agg(F.sort_array(F.collect_set("declared")).alias("contexts"))


def _compact(column: str) -> Column:
    return F.lower(F.regexp_replace(column, r"(?U)[\W_]+", ""))


def context_aliases(s: DataFrame) -> DataFrame:
    """(context, label): contexts that are the same work. The only context that a record's work signals name is paired with every other context its names declare,
    by field or in brackets; a record that declares more than ``ALIASES`` pairs none, as in the reference. A pair holds if both are equal without separators, or if at
    least two records of at least two media or providers declare it and its other context belongs to one work. The label is the one in Latin script, then the shortest, then the first."""
    rows, key = usable(s).filter("record_id is not null"), lambda c: F.nullif(T.canonical_key(c), F.lit(""))
    works = rows.filter("role = 'work'").select("record_id", key(F.coalesce(F.nullif("work_context", F.lit("")), "canonical")).alias("work")).filter("work is not null")
    works = works.groupBy("record_id").agg(F.min("work").alias("work"), F.max("work").alias("last")).filter("work = last").drop("last")
    named = rows.filter(F.col("role").isin("character", "person", "unknown")).select("record_id", F.explode(F.array_append("brackets", F.col("work_context"))).alias("c")).select("record_id", key(F.col("c")).alias("declared"))
    bare, foreign = _compact("declared"), lambda c: F.col(c).rlike(r"[^\x00-\x7f]")
    named = named.filter((bare != "") & ~bare.isin(*CONTEXT_STOP_KEYS) & (foreign("declared") | F.col("declared").rlike("[_:0-9]") | (F.length(bare) > 8))).distinct()
    pairs = named.join(works, "record_id").filter("declared <> work")
    pairs = pairs.join(pairs.groupBy("record_id").agg(F.count("*").alias("k")).filter(F.col("k") <= ALIASES), "record_id").filter(~(foreign("declared") & foreign("work")) | (_compact("work") == bare))
    clash = pairs.groupBy("declared").agg((F.count_distinct("work") > 1).alias("clash")).filter("clash")
    units = s.filter("record_id is not null").select("record_id", "media_id", "provider").distinct()
    support = pairs.join(units, "record_id").groupBy(F.least("work", "declared").alias("a"), F.greatest("work", "declared").alias("b")).agg(F.count_distinct("record_id").alias("records"), F.greatest(F.count_distinct("media_id"), F.count_distinct(F.nullif("provider", F.lit("")))).alias("independent"))
    of = lambda c: clash.select(F.col("declared").alias(c), F.col("clash").alias(f"{c}_clash"))
    support = support.join(of("a"), "a", "left").join(of("b"), "b", "left")
    same = support.filter((_compact("a") == _compact("b")) | ((F.col("records") >= 2) & (F.col("independent") >= 2) & F.col("a_clash").isNull() & F.col("b_clash").isNull())).select("a", "b")
    roots = graph.components(same)
    label = F.min(F.struct((~F.col("node").rlike("[A-Za-z]")).alias("x"), F.length("node").alias("y"), "node"))["node"].alias("label")
    return roots.join(roots.groupBy("root").agg(label), "root").select(F.col("node").alias("context"), "label")


def with_context(s: DataFrame) -> DataFrame:
    """Adds context and its strength: declared, else the only one of its record, else the only one of its medium."""
    sets = context_sets(s).filter(F.size("contexts") == 1).select("scope", "scope_id", F.element_at("contexts", 1).alias("only"))
    of = lambda scope, key, name: sets.filter(F.col("scope") == scope).select(F.col("scope_id").alias(key), F.col("only").alias(name))
    joined = s.join(of("record", "record_id", "by_record"), "record_id", "left").join(of("media", "media_id", "by_media"), "media_id", "left")
    strength = F.when(F.col("declared").isNotNull(), "explicit").when(F.col("by_record").isNotNull(), "record").when(F.col("by_media").isNotNull(), "media").otherwise("none")
    return joined.withColumns({"context": F.coalesce("declared", "by_record", "by_media"), "strength": strength}).drop("by_record", "by_media")


def with_anchor(s: DataFrame, profile: DataFrame) -> DataFrame:
    """Adds ambiguous and the identity anchor role:surface[:work:context]; artists need a stable id, so have none here."""
    joined = s.join(profile.select("surface", "ambiguous"), "surface", "left").withColumn("ambiguous", F.coalesce("ambiguous", T.short_key(F.col("surface"))))
    ok = (F.coalesce("status", F.lit("")) != "rejected") & ~F.col("surface").isin(*STOP_KEYS)
    person = F.col("role").isin("character", "person")
    named = F.concat_ws(":", "role", "surface")
    anchor = F.when(ok & person & F.col("context").isNotNull(), F.concat(named, F.lit(":work:"), F.col("context"))).when(ok & person & ~F.col("ambiguous"), named).when(ok & (F.col("role") == "work"), named)
    return joined.withColumn("anchor", anchor)


def alias_components(signals: DataFrame) -> DataFrame:
    """(canonical, alias): components of keys that alias signals tie together."""
    rows = signals.filter("origin_type = 'source_alias_candidate' and coalesce(status, '') not in ('rejected', 'superseded') and raw_value is not null and normalized_key is not null")
    pairs = rows.select(T.canonical_key(F.col("raw_value")).alias("a"), F.col("normalized_key").alias("b"))
    return graph.components(pairs).select(F.col("node").alias("canonical"), F.col("root").alias("alias"))


def role_group(column: str = "role") -> Column:
    return F.when(F.col(column).isin("character", "person"), "character_person").otherwise(F.col(column))


def blocks(s: DataFrame) -> DataFrame:
    """(block, id): all blocking keys of the usable signals."""
    g, has = role_group(), F.col("role").isin("character", "person", "unknown")
    text = lambda *parts: F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    keys = F.array(
        text("exact", g, F.col("canonical")),
        F.when(F.col("surface") != F.col("canonical"), text("surface", g, F.col("surface"))),
        F.when(F.col("context").isNotNull(), text("context", g, F.col("surface"), "work", F.col("context"))),
        F.when(F.col("anchor").isNotNull(), text("identity", F.col("anchor"))),
        F.when(F.col("alias").isNotNull(), text("alias", F.col("alias"))),
        F.when(has & F.col("record_id").isNotNull(), text("record_context", F.col("record_id").cast("string"))),
        F.when(has & F.col("media_id").isNotNull(), text("media_context", F.col("media_id").cast("string"))),
    )
    return usable(s).select(F.explode(F.array_compact(keys)).alias("block"), "id")


def block_sizes(keys: DataFrame) -> DataFrame:
    """Per kind of block: blocks, rows and the largest block."""
    n = keys.groupBy("block").agg(F.count("*").alias("n"))
    return n.groupBy(F.substring_index("block", ":", 1).alias("kind")).agg(F.count("*").alias("n_blocks"), F.sum("n").alias("n_rows"), F.max("n").alias("largest"))


def _side(s: DataFrame, p: str) -> DataFrame:
    cols = ["surface", "canonical", "role", "context", "trust", "provider", "media_id", "record_id", "confidence", "script", "ai", "ambiguous", "anchor", "alias", "strength", "origin_type"]
    return s.select(F.col("id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in cols])


def pair_rule(cooccurrence: Column) -> Column:
    """The first rule that holds for a pair (columns l_... and r_...), as a struct; null if none does."""
    l, r = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))
    eq = lambda c: F.coalesce(l(c) == r(c), F.lit(False))
    either = lambda v: (l("role") == v) | (r("role") == v)
    char = lambda x: x("role").isin("character", "person")
    both_char = char(l) & char(r)
    compatible_roles = eq("role") | either("unknown") | both_char
    ctx_same = eq("context")
    ctx_clash = l("context").isNotNull() & r("context").isNotNull() & ~ctx_same
    partial = l("context").isNull() != r("context").isNull()
    both_ai, both_weak = l("ai") & r("ai"), (l("trust") == "weak") & (r("trust") == "weak")
    manual = l("origin_type").eqNullSafe("manual") | r("origin_type").eqNullSafe("manual")
    independent = ~l("ai") & ~r("ai") & F.coalesce(l("provider") != r("provider"), F.lit(False)) & ~eq("record_id") & ~eq("media_id")
    explicit = ctx_same & (l("strength") == "explicit") & (r("strength") == "explicit")
    corroborated = manual | (independent & (explicit | ((l("script") != r("script")) & eq("canonical"))))
    surface, canonical, alias, anchor = eq("surface"), eq("canonical"), eq("alias"), eq("anchor")
    fuzzy = surface & ~ctx_same & (char(l) | char(r) | either("unknown")) & (l("ambiguous") | r("ambiguous"))
    alias_signal = lambda x: x("origin_type") == "source_alias_candidate"

    def edge(kind, weight, status, union, reason, negative=None):
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(F.lit(kind).alias("edge_type"), as_col(weight).cast("double").alias("weight"), as_col(status).alias("status"), as_col(union).cast("boolean").alias("union_allowed"), as_col(reason).alias("reason"), as_col(negative).cast("string").alias("negative"))

    pick = lambda a, x, b, y, z: F.when(a, F.lit(x)).when(b, F.lit(y)).otherwise(F.lit(z))
    alias_ok = (~(alias_signal(l) & alias_signal(r))) & ~both_ai & ctx_same
    exact_partial = partial & (char(l) | char(r))
    return (
        F.when(~compatible_roles, edge("negative_guard", 0.0, "rejected", False, "role_conflict_guard", "role_conflict"))
        .when(either("source_title"), edge("context_only", 0.10, "weak", False, "source_title_context_only", "source_title_only_guard"))
        .when(either("artist"), edge("creator_identity_guard", 0.0, "needs_review", False, "creator_identity_strong_evidence_missing", "creator_identity_strong_evidence_missing"))
        .when(either("unknown") & ~corroborated, edge("unknown_role_review", 0.38, "needs_review", False, "unknown_role_requires_corroboration"))
        .when(both_char & ctx_clash & (alias | canonical | surface), edge("negative_guard", 0.0, "rejected", False, F.when(alias, "alias_context_conflict_guard").otherwise("work_context_conflict_guard"), F.when(alias, "alias_work_context_conflict").otherwise("work_context_conflict")))
        .when(alias, edge("alias_candidate_edge", F.when(alias_ok, 0.82).otherwise(0.58), F.when(alias_ok, "active").otherwise("needs_review"), True, "alias_candidate_component"))
        .when(fuzzy & ctx_clash, edge("negative_guard", 0.0, "rejected", False, "work_context_conflict_guard", "work_context_conflict"))
        .when(fuzzy & (eq("media_id") | eq("record_id")), edge("same_scope_duplicate_review", 0.32, "needs_review", True, "ambiguous_short_same_scope_review"))
        .when(fuzzy & partial, edge("same_surface_context", 0.46, "needs_review", True, "ambiguous_short_partial_work_context_review"))
        .when(fuzzy, edge("negative_guard", 0.0, "needs_review", False, "ambiguous_short_guard", "ambiguous_short_without_work_context"))
        .when(anchor, edge("stable_identity_anchor", pick(both_ai, 0.48, both_weak, 0.34, 0.94), pick(both_ai, "needs_review", both_weak, "needs_review", "active"), True, pick(both_ai, "medium_ai_identity_anchor_review", both_weak, "weak_identity_anchor_review", "stable_identity_anchor")))
        .when(surface & ctx_same, edge("same_surface_context", F.when(both_ai, 0.45).otherwise(0.92), F.when(both_ai, "needs_review").otherwise("active"), True, F.when(both_ai, "medium_ai_same_context_review").otherwise("same_surface_and_work_context")))
        .when(canonical, edge("exact_canonical_key", F.when(exact_partial, 0.42).when(both_ai, 0.45).when(both_weak, 0.25).otherwise(0.86), F.when(exact_partial | both_ai, "needs_review").when(both_weak, "weak").otherwise("active"),
                              ~(both_weak & ~exact_partial & ~both_ai), F.when(exact_partial, "exact_key_partial_context_review").when(both_ai, "medium_ai_exact_key_review").when(both_weak, "weak_exact_key_context_needed").otherwise("exact_canonical_key")))
        .when(cooccurrence, edge("cooccurrence_context", 0.18, "weak", False, "cooccurrence_only_context"))
    )


def _block_pairs(s: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """((block, l_id, r_id, across) of the pairs that each block compares, (block, n) of its signals)."""
    keys = blocks(s)
    sizes = keys.groupBy("block").agg(F.count("*").alias("n")).filter("n > 1")
    sized = salted_join(keys, sizes.withColumn("n_rows", F.col("n")), "block", "id")  # blocks of a hot record or medium are split
    small = sized.filter(F.col("n") <= block).select("block", "id")
    pairs = small.alias("a").join(small.alias("b"), "block").filter("a.id < b.id").select("block", F.col("a.id").alias("l_id"), F.col("b.id").alias("r_id"))
    kind = F.substring_index("block", ":", 1)
    part = ["block", "role_group", "ctx", "ai", "tier", "script", "ambiguous"]
    tier = F.when(F.col("trust") == "strong", "strong").when(F.col("trust").isin("medium", "medium_ai"), "medium").otherwise("weak")
    features = s.select("id", role_group().alias("role_group"), F.coalesce("context", F.lit("no_context")).alias("ctx"), "ai", tier.alias("tier"), "script", "ambiguous", "anchor", F.struct(trust_weight("trust").alias("t"), ~F.col("ai"), "confidence", "id").alias("rank"))
    large = sized.filter((F.col("n") > block) & kind.isin("exact", "context", "identity")).select("block", "id").join(features, "id")
    best = large.groupBy(*part).agg(F.max(F.struct("rank", "id", "anchor")).alias("best"), F.count("*").alias("m")).select(*part, F.col("best.id").alias("best_id"), F.col("best.anchor").alias("best_anchor"), "m")
    member = salted_join(large.select(*part, "id"), best.withColumn("n_rows", F.col("m")), part, "id")
    inside = member.filter(F.col("m") <= block).select(*part, "id")
    inner = inside.alias("a").join(inside.alias("b"), part).filter("a.id < b.id").select("block", F.col("a.id").alias("l_id"), F.col("b.id").alias("r_id"))
    star = member.filter((F.col("m") > block) & (F.col("id") != F.col("best_id"))).select("block", F.least("id", "best_id").alias("l_id"), F.greatest("id", "best_id").alias("r_id"))
    # Best signals of different parts of a block, tied only where their anchors agree: a star to the smallest, since they are one identity.
    lead = best.filter("best_anchor is not null").select("block", "best_id", "best_anchor")
    first = lead.groupBy("block", "best_anchor").agg(F.min("best_id").alias("first"))
    across = lead.join(first, ["block", "best_anchor"]).filter("first < best_id").select("block", F.col("first").alias("l_id"), F.col("best_id").alias("r_id"), F.lit(True).alias("across"))
    return pairs.unionByName(inner).unionByName(star).withColumn("across", F.lit(False)).unionByName(across), sizes


def candidate_pairs(s: DataFrame, block: int = BLOCK) -> DataFrame:
    """(l_id, r_id, cooccur, across) of every pair that a block compares, before any rule."""
    kind = F.substring_index("block", ":", 1)
    return _block_pairs(s, block)[0].groupBy("l_id", "r_id").agg(F.bool_or(kind.isin("record_context", "media_context")).alias("cooccur"), F.bool_and("across").alias("across"))


def block_pairs(s: DataFrame, block: int = BLOCK) -> DataFrame:
    """The candidate pairs of blocks of at most ``block`` signals alone."""
    pairs, sizes = _block_pairs(s, block)
    kind = F.substring_index("block", ":", 1)
    usual = pairs.filter("not across").join(sizes.filter(F.col("n") <= block).select("block"), "block", "left_semi")
    return usual.groupBy("l_id", "r_id").agg(F.bool_or(kind.isin("record_context", "media_context")).alias("cooccur"), F.lit(False).alias("across"))


def edges(s: DataFrame, block: int = BLOCK) -> DataFrame:
    """(l_id, r_id, edge_type, weight, status, union_allowed, reason, negative): the best edge of each pair and type over all blocks."""
    return edges_of(s, candidate_pairs(s, block))


def edges_of(s: DataFrame, pairs: DataFrame) -> DataFrame:
    """The edge of each candidate pair (l_id, r_id, cooccur, across) by the first rule that holds."""
    joined = pairs.join(_side(s, "l"), "l_id").join(_side(s, "r"), "r_id")
    found = joined.select("l_id", "r_id", "across", pair_rule(F.col("cooccur")).alias("e")).filter("e is not null").select("l_id", "r_id", "across", "e.*")
    return found.filter("not across or (status = 'active' and union_allowed)").drop("across")


def _greedy(frame: pd.DataFrame) -> pd.DataFrame:
    """Constrained union inside one component: merges best edges first, never putting a blocked pair into one group."""
    frame = frame.sort_values(["merge", "active", "weight", "l_id", "r_id"], ascending=[True, False, False, True, True])
    parent: dict[int, int] = {}
    against: dict[int, set[int]] = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for left, right, merge in zip(frame["l_id"], frame["r_id"], frame["merge"]):
        a, b = find(left), find(right)
        if not merge:
            against.setdefault(a, set()).add(b)
            against.setdefault(b, set()).add(a)
            continue
        if a == b or b in against.get(a, ()) or a in against.get(b, ()):
            continue
        a, b = min(a, b), max(a, b)
        parent[b] = a
        for c in against.pop(b, ()):
            against.setdefault(a, set()).add(c)
            against.setdefault(c, set()).discard(b)
            against[c].add(a)
    rows = [(x, find(x)) for x in list(parent)]
    return pd.DataFrame(rows, columns=["id", "group_id"])


def component_sizes(e: DataFrame) -> DataFrame:
    """(root, n_signals, n_edges, n_blocked) of each component of materializing edges; those with blocked pairs are what one task of the greedy union holds."""
    merge = e.filter("union_allowed and status = 'active' and negative is null").select("l_id", "r_id").distinct()
    roots = Scratch(e.sparkSession, "sizes").put(graph.components(merge.select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))))
    signals = roots.groupBy("root").agg(F.count("*").alias("n_signals"))
    edges_in = merge.join(roots.select(F.col("node").alias("l_id"), "root"), "l_id").groupBy("root").agg(F.count("*").alias("n_edges"))
    apart = e.filter(F.col("negative").isin(*HARD)).select("l_id", "r_id").distinct()
    apart = apart.join(roots.select(F.col("node").alias("l_id"), "root"), "l_id").join(roots.select(F.col("node").alias("r_id"), F.col("root").alias("other")), "r_id").filter("root = other").groupBy("root").agg(F.count("*").alias("n_blocked"))
    return signals.join(edges_in, "root", "left").join(apart, "root", "left").select("root", "n_signals", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("n_blocked", F.lit(0)).alias("n_blocked"))


def constrained_groups(e: DataFrame) -> DataFrame:
    """(id, group_id) of the greedy union over materializing edges; hard negatives keep their pairs apart. The last tie-break is the pair itself."""
    scratch = Scratch(e.sparkSession, "union")
    merge = scratch.put(e.filter("union_allowed and status = 'active' and negative is null").groupBy("l_id", "r_id").agg(F.max("weight").alias("weight")))
    roots = graph.components(merge.select(F.col("l_id").alias("a"), F.col("r_id").alias("b")))
    tagged = merge.join(roots.select(F.col("node").alias("l_id"), "root"), "l_id").select("root", "l_id", "r_id", "weight", F.lit(True).alias("active"), F.lit(True).alias("merge"))
    apart = e.filter(F.col("negative").isin(*HARD)).select("l_id", "r_id").distinct()
    apart = apart.join(roots.select(F.col("node").alias("l_id"), "root"), "l_id").join(roots.select(F.col("node").alias("r_id"), F.col("root").alias("other")), "r_id").filter("root = other")
    blocked = apart.select("root", "l_id", "r_id", F.lit(0.0).alias("weight"), F.lit(False).alias("active"), F.lit(False).alias("merge"))
    # Components without a blocked pair need no greedy order: their root is the answer.
    strict = blocked.select("root").distinct()
    free = roots.join(strict, "root", "left_anti").select(F.col("node").alias("id"), F.col("root").alias("group_id"))
    hard = tagged.unionByName(blocked).join(strict, "root", "left_semi")
    return free.unionByName(hard.groupBy("root").applyInPandas(_greedy, "id bigint, group_id bigint"))


def concepts(s: DataFrame, groups: DataFrame, e: DataFrame) -> DataFrame:
    """One concept per group (single signals included): status, confidence, evidence score, counts and the name to show."""
    of = s.join(groups, "id", "left").withColumn("concept", F.coalesce("group_id", "id"))
    inside = e.join(groups.select(F.col("id").alias("l_id"), F.col("group_id").alias("lg")), "l_id").join(groups.select(F.col("id").alias("r_id"), F.col("group_id").alias("rg")), "r_id").filter("lg = rg")
    ties = inside.groupBy(F.col("lg").alias("concept")).agg(F.bool_or(F.col("status") == "active").alias("active_edge"), F.bool_or(F.col("reason").endswith("review")).alias("review_edge"), F.bool_or(F.col("negative").isNotNull()).alias("guarded"))
    plain = ~F.col("ai") & (F.col("origin_type") != "source_alias_candidate")
    g = of.groupBy("concept").agg(
        F.count("*").alias("signals"), F.count_distinct("media_id").alias("media"), F.count_distinct("provider").alias("providers"), F.bool_and("ai").alias("all_ai"), F.bool_and(F.col("origin_type") == "source_alias_candidate").alias("all_alias"),
        F.bool_and((F.col("trust") == "weak") | (F.col("role") == "source_title")).alias("all_weak"), F.bool_or((F.col("trust") == "strong") & ~F.col("ai")).alias("strong"), F.bool_or((F.col("trust") == "medium")).alias("medium"),
        F.count_if(plain).alias("plain"), F.bool_or("ai").alias("some_ai"), F.count_distinct(role_group()).alias("role_groups"), F.max("confidence").alias("best"), F.round(F.sum(trust_weight("trust")), 4).alias("evidence"),
        F.max_by("display", F.struct(trust_weight("trust").alias("t"), "confidence", (-F.length("display")).alias("k"), "id")).alias("name"), F.mode("role", True).alias("role"),
    ).join(ties, "concept", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    doubt = (F.col("role_groups") > 1) | yes("guarded") | yes("review_edge") | F.col("all_ai") | F.col("all_alias") | F.col("all_weak")
    active = F.col("strong") | (F.col("medium") & (yes("active_edge") | (F.col("plain") >= 2))) | (F.col("some_ai") & (F.col("plain") >= 1) & yes("active_edge"))
    status = F.when(doubt, "needs_review").when(active, "active").otherwise("needs_review")
    best = F.when(F.col("all_ai"), F.least(F.lit(0.59), F.col("best"))).when(status != "active", F.least(F.lit(0.74), F.col("best"))).otherwise(F.col("best"))
    return g.select("concept", "name", "role", status.alias("status"), F.round(best, 4).alias("confidence"), "evidence", "signals", "media", "providers")


def concept_keys(c: DataFrame) -> DataFrame:
    """role:key of each concept; a key that several concepts would share gets a running number from the second on."""
    base = F.concat_ws(":", "role", T.canonical_key(F.col("name")))
    place = F.row_number().over(W.partitionBy("base").orderBy("concept"))
    return c.select("concept", base.alias("base")).withColumn("n", place).select("concept", F.when(F.col("n") > 1, F.concat("base", F.lit("#"), F.col("n").cast("string"))).otherwise(F.col("base")).alias("concept_key"))


def dispositions(e: DataFrame, groups: DataFrame) -> DataFrame:
    """(l_id, r_id, disposition): cannot before must (one group) before a transitive cannot (their groups hold a blocked pair) before deferred."""
    group = lambda p: groups.select(F.col("id").alias(f"{p}_id"), F.col("group_id").alias(f"{p}_group"))
    pairs = e.groupBy("l_id", "r_id").agg(F.bool_or(F.col("negative").isin(*HARD)).alias("hard"))
    pairs = pairs.join(group("l"), "l_id", "left").join(group("r"), "r_id", "left").withColumns({"lg": F.coalesce("l_group", "l_id"), "rg": F.coalesce("r_group", "r_id")})
    hard = F.coalesce("hard", F.lit(False))
    barred = pairs.filter(hard).select(F.least("lg", "rg").alias("x"), F.greatest("lg", "rg").alias("y")).distinct().withColumn("barred", F.lit(True))
    joined = pairs.withColumns({"x": F.least("lg", "rg"), "y": F.greatest("lg", "rg")}).join(barred, ["x", "y"], "left")
    kind = F.when(hard, "cannot").when(F.col("lg") == F.col("rg"), "must").when(F.col("barred"), "transitive_cannot").otherwise("deferred")
    return joined.select("l_id", "r_id", kind.alias("disposition"))


def pair_accounting(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """One row: candidate pairs, those of each disposition, and pairs without one (unaccounted), with several (duplicates) or outside the candidates (extra)."""
    kinds = ("must", "cannot", "transitive_cannot", "deferred")
    per = found.groupBy("l_id", "r_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("disposition") == k).alias(k) for k in kinds])
    both = candidates.select("l_id", "r_id").distinct().withColumn("wanted", F.lit(True)).join(per, ["l_id", "r_id"], "full")
    wanted, valid = F.col("wanted").isNotNull(), sum((F.col(k) for k in kinds), F.lit(0))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    g = both.agg(F.count("wanted").alias("total"), *[zero(F.when(wanted, F.col(k))).alias(k) for k in kinds], F.count_if(wanted & (F.coalesce(valid, F.lit(0)) == 0)).alias("unaccounted"), zero(F.col("n") - 1).alias("duplicates"), F.count_if(~wanted).alias("extra"))
    coverage = F.when(F.col("total") > 0, F.round((F.col("total") - F.col("unaccounted")) / F.col("total"), 12)).otherwise(1.0)
    equal = (F.col("total") == sum((F.col(k) for k in kinds), F.lit(0))) & (F.col("duplicates") + F.col("extra") + F.col("unaccounted") == 0)
    return g.select("*", coverage.alias("coverage"), equal.alias("equality"))


def oversized(s: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row: blocks beyond the bound, their pairs, how many of those are compared and how many are skipped or stood for by a star. A pair counts in each block that holds it, so no block is spread out."""
    pairs, sizes = _block_pairs(s, block)
    large = sizes.filter(F.col("n") > block)
    made = pairs.join(large.select("block"), "block", "left_semi").groupBy("block").agg(F.count("*").alias("made"))
    all_pairs, compared = F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)), F.coalesce(F.sum("made"), F.lit(0))
    return large.join(made, "block", "left").agg(F.count("*").alias("oversized_blocks"), all_pairs.alias("oversized_pairs"), compared.alias("oversized_compared"), (all_pairs - compared).alias("oversized_left_out"))


def violations(e: DataFrame, groups: DataFrame) -> DataFrame:
    """Hard negative pairs inside one group; the union must leave none."""
    return dispositions(e, groups).filter("disposition = 'cannot'").join(groups.select(F.col("id").alias("l_id"), F.col("group_id").alias("a")), "l_id").join(groups.select(F.col("id").alias("r_id"), F.col("group_id").alias("b")), "r_id").filter("a = b")


def resolved(signals: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signals with all features, edges, groups), each written once."""
    s = with_context(prepare(signals))
    s = with_anchor(s, ambiguity(s)).join(alias_components(signals), "canonical", "left")
    s = scratch.put(s)
    e = scratch.put(edges(s))
    return s, e, scratch.put(constrained_groups(e))

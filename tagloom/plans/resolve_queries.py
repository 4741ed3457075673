"""Entity resolution queries; what SQL can state has an oracle, the greedy union is tested against a plain one and its invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.library import oracle
from tagloom.operators import resolve as R
from tagloom.plans.function_queries import _usual, family_sql, key_sql, short_sql
from tagloom.plans.registry import registry
from tagloom.session import Scratch

QUERIES, ORACLE, query = registry()

_P = r"regexp_extract(normalized_key, '^(.+?)_?\(([^()]+)\)$', {})"
_FAMILY = family_sql("x")
_S = f"""s as (select id, case when {_P.format(2)} <> '' then {_P.format(1)} else normalized_key end as surface, normalized_key as canonical, coalesce(role_hint, 'unknown') as role, coalesce(work_context_key, nullif({_P.format(2)}, '')) as declared, trust_tier as trust, status, provider, media_id,
  source_metadata_record_id as record_id, coalesce(confidence, 0) as confidence, {_FAMILY} as script,
  coalesce(trust_tier = 'medium_ai', false) as ai, origin_type, {_P.format(2)} <> '' as bracketed from (select *, coalesce(display_value, '') as x from signals where normalized_key <> ''))"""
_U = "u as (select * from s where coalesce(status, '') <> 'rejected' and coalesce(trust, '') <> 'rejected')"
_E = "ent as (select surface, round_even(case when count(*) > 1 then (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(count(*)) else 0 end, 4) as entropy from (select surface, role, count(*) as c from u group by 1, 2) group by 1)"
_SHORT = short_sql("surface")
_AMB = f"""amb as (select *, score >= 0.5 as ambiguous from (select surface, n, contexts, providers, entropy, round(greatest(0, least(1, case when {_SHORT} then 0.35 else 0 end + case when contexts = 0 then 0.15 when contexts > 1 then least(0.5, 0.25 + 0.08 * (contexts - 1)) else 0 end
  + case when n >= 5 then least(0.25, 0.08 + 0.04 * log2(n)) else 0 end + 0.25 * entropy + case when providers > 1 and contexts > 1 then 0.08 else 0 end - case when contexts = 1 and greatest(records, media) >= 2 then 0.25 else 0 end - case when bracketed then 0.15 else 0 end - case when scripts > 1 and contexts <= 1 then 0.05 else 0 end)), 4) as score
  from (select surface, count(*) as n, count(distinct declared) as contexts, count(distinct provider) as providers, count(distinct record_id) as records, count(distinct media_id) as media, count(distinct script) as scripts, bool_or(bracketed) as bracketed from u group by 1) join ent using (surface)))"""
_CTX = """ctx as (select 'media' as scope, media_id as scope_id, list_sort(list(distinct declared)) as contexts from u where declared is not null and media_id is not null group by 2 union all select 'record', record_id, list_sort(list(distinct declared)) from u where declared is not null and record_id is not null group by 2)"""
_W = """w as (select s.*, coalesce(declared, r.contexts[1], x.contexts[1]) as context, case when declared is not null then 'explicit' when r.scope is not null then 'record' when x.scope is not null then 'media' else 'none' end as strength from s
  left join ctx r on r.scope = 'record' and r.scope_id = record_id and len(r.contexts) = 1 left join ctx x on x.scope = 'media' and x.scope_id = media_id and len(x.contexts) = 1)"""
_STOP = ", ".join(f"'{k}'" for k in R.STOP_KEYS)
_A = f"""a as (select w.*, coalesce(amb.ambiguous, {short_sql('w.surface')}) as amb, case when coalesce(status, '') = 'rejected' or w.surface in ({_STOP}) then null when role in ('character', 'person') and context is not null then role || ':' || w.surface || ':work:' || context
  when role in ('character', 'person') and not coalesce(amb.ambiguous, {short_sql('w.surface')}) then role || ':' || w.surface when role = 'work' then role || ':' || w.surface end as anchor from w left join amb using (surface))"""
_ALL = (_S, _U, _E, _AMB, _CTX, _W, _A)


def _signals(lib):
    return R.prepare(lib.raw("signals"))


@query("k08_ambiguity", "select surface, n, contexts, providers, entropy, score, ambiguous from amb", *_ALL[:4])
def _(lib):
    return R.ambiguity(_signals(lib))


@query("k09_context_sets", "select scope, scope_id, contexts from ctx", *_ALL[:5])
def _(lib):
    return R.context_sets(_signals(lib))


@query("k10_context_aliases")
def _(lib):
    return R.context_aliases(_signals(lib))


@query("k11_effective_context", "select id, context, strength from w", *_ALL[:6])
def _(lib):
    return R.with_context(_signals(lib)).select("id", "context", "strength")


@query("k12_anchors", "select id, amb as ambiguous, anchor from a", *_ALL)
def _(lib):
    s = R.with_context(_signals(lib))
    return R.with_anchor(s, R.ambiguity(s)).select("id", "ambiguous", "anchor")


@query("k13_alias_components")
def _(lib):
    return R.alias_components(lib.raw("signals"))


def _ready(lib):
    s = R.with_context(_signals(lib))
    return R.with_anchor(s, R.ambiguity(s)).join(R.alias_components(lib.raw("signals")), "canonical", "left")


@query("k14_block_sizes", """select kind, count(*) as n_blocks, cast(sum(n) as bigint) as n_rows, max(n) as largest from (select split_part(block, ':', 1) as kind, block, count(*) as n from (select unnest(list_filter([
  'exact:' || case when role in ('character', 'person') then 'character_person' else role end || ':' || canonical, case when surface <> canonical then 'surface:' || case when role in ('character', 'person') then 'character_person' else role end || ':' || surface end,
  'context:' || case when role in ('character', 'person') then 'character_person' else role end || ':' || surface || ':work:' || context, 'identity:' || anchor,
  case when role in ('character', 'person', 'unknown') then 'record_context:' || record_id end, case when role in ('character', 'person', 'unknown') then 'media_context:' || media_id end], lambda x: x is not null)) as block from a where coalesce(status, '') <> 'rejected' and coalesce(trust, '') <> 'rejected') group by 1, 2) group by 1""", *_ALL)
def _(lib):
    """Sizes of all blocks but the alias ones, whose keys need case folding; k14_all_block_sizes has those too."""
    s = R.with_context(_signals(lib))
    return R.block_sizes(R.blocks(R.with_anchor(s, R.ambiguity(s)).withColumn("alias", F.lit(None).cast("string"))))


@query("k14_all_block_sizes")
def _(lib):
    return R.block_sizes(R.blocks(_ready(lib)))


# The edges of pairs in blocks of at most 60 signals as SQL: (condition, type, weight, state, may merge, reason, what forbids), the first that holds.
_EQ = lambda c: f"coalesce(l.{c} = r.{c}, false)"
_ROLE_IS = lambda v: f"(l.role = '{v}' or r.role = '{v}')"
_CHAR = lambda x: f"{x}.role in ('character', 'person')"
_CLASH, _PARTIAL = f"(l.context is not null and r.context is not null and not {_EQ('context')})", "((l.context is null) <> (r.context is null))"
_BOTH_AI, _BOTH_WEAK = "(l.ai and r.ai)", "(coalesce(l.trust, '') = 'weak' and coalesce(r.trust, '') = 'weak')"
_APART = f"(not l.ai and not r.ai and coalesce(l.provider <> r.provider, false) and not {_EQ('record_id')} and not {_EQ('media_id')})"
_SURE = f"(coalesce(l.origin_type, '') = 'manual' or coalesce(r.origin_type, '') = 'manual' or ({_APART} and (({_EQ('context')} and l.strength = 'explicit' and r.strength = 'explicit') or (l.script <> r.script and {_EQ('canonical')}))))"
_FUZZY = f"({_EQ('surface')} and not {_EQ('context')} and ({_CHAR('l')} or {_CHAR('r')} or {_ROLE_IS('unknown')}) and (l.amb or r.amb))"
_EXACT_PARTIAL = f"({_PARTIAL} and ({_CHAR('l')} or {_CHAR('r')}))"
_RULES = [
    (f"not ({_EQ('role')} or {_ROLE_IS('unknown')} or ({_CHAR('l')} and {_CHAR('r')}))", "'negative_guard'", "0.0", "'rejected'", "false", "'role_conflict_guard'", "'role_conflict'"),
    (_ROLE_IS("source_title"), "'context_only'", "0.1", "'weak'", "false", "'source_title_context_only'", "'source_title_only_guard'"),
    (_ROLE_IS("artist"), "'creator_identity_guard'", "0.0", "'needs_review'", "false", "'creator_identity_strong_evidence_missing'", "'creator_identity_strong_evidence_missing'"),
    (f"{_ROLE_IS('unknown')} and not {_SURE}", "'unknown_role_review'", "0.38", "'needs_review'", "false", "'unknown_role_requires_corroboration'", "null"),
    (f"{_CHAR('l')} and {_CHAR('r')} and {_CLASH} and ({_EQ('canonical')} or {_EQ('surface')})", "'negative_guard'", "0.0", "'rejected'", "false", "'work_context_conflict_guard'", "'work_context_conflict'"),
    (f"{_FUZZY} and {_CLASH}", "'negative_guard'", "0.0", "'rejected'", "false", "'work_context_conflict_guard'", "'work_context_conflict'"),
    (f"{_FUZZY} and ({_EQ('media_id')} or {_EQ('record_id')})", "'same_scope_duplicate_review'", "0.32", "'needs_review'", "true", "'ambiguous_short_same_scope_review'", "null"),
    (f"{_FUZZY} and {_PARTIAL}", "'same_surface_context'", "0.46", "'needs_review'", "true", "'ambiguous_short_partial_work_context_review'", "null"),
    (_FUZZY, "'negative_guard'", "0.0", "'needs_review'", "false", "'ambiguous_short_guard'", "'ambiguous_short_without_work_context'"),
    (_EQ("anchor"), "'stable_identity_anchor'", f"case when {_BOTH_AI} then 0.48 when {_BOTH_WEAK} then 0.34 else 0.94 end", f"case when {_BOTH_AI} or {_BOTH_WEAK} then 'needs_review' else 'active' end", "true",
     f"case when {_BOTH_AI} then 'medium_ai_identity_anchor_review' when {_BOTH_WEAK} then 'weak_identity_anchor_review' else 'stable_identity_anchor' end", "null"),
    (f"{_EQ('surface')} and {_EQ('context')}", "'same_surface_context'", f"case when {_BOTH_AI} then 0.45 else 0.92 end", f"case when {_BOTH_AI} then 'needs_review' else 'active' end", "true", f"case when {_BOTH_AI} then 'medium_ai_same_context_review' else 'same_surface_and_work_context' end", "null"),
    (_EQ("canonical"), "'exact_canonical_key'", f"case when {_EXACT_PARTIAL} then 0.42 when {_BOTH_AI} then 0.45 when {_BOTH_WEAK} then 0.25 else 0.86 end", f"case when {_EXACT_PARTIAL} or {_BOTH_AI} then 'needs_review' when {_BOTH_WEAK} then 'weak' else 'active' end",
     f"not ({_BOTH_WEAK} and not {_EXACT_PARTIAL} and not {_BOTH_AI})", f"case when {_EXACT_PARTIAL} then 'exact_key_partial_context_review' when {_BOTH_AI} then 'medium_ai_exact_key_review' when {_BOTH_WEAK} then 'weak_exact_key_context_needed' else 'exact_canonical_key' end", "null"),
    ("cooccur", "'cooccurrence_context'", "0.18", "'weak'", "false", "'cooccurrence_only_context'", "null"),
]
_GROUP = "case when role in ('character', 'person') then 'character_person' else role end"
_KEYS = f"""keys as (select id, unnest(list_filter(['exact:' || {_GROUP} || ':' || canonical, case when surface <> canonical then 'surface:' || {_GROUP} || ':' || surface end, 'context:' || {_GROUP} || ':' || surface || ':work:' || context, 'identity:' || anchor,
  case when role in ('character', 'person', 'unknown') then 'record_context:' || record_id end, case when role in ('character', 'person', 'unknown') then 'media_context:' || media_id end], lambda x: x is not null)) as block from a where coalesce(status, '') <> 'rejected' and coalesce(trust, '') <> 'rejected'),
  usual as (select id, block from keys where block in (select block from keys group by 1 having count(*) between 2 and 60)),
  pairs as (select x.id as l_id, y.id as r_id, bool_or(split_part(x.block, ':', 1) in ('record_context', 'media_context')) as cooccur from usual x join usual y on x.block = y.block and x.id < y.id group by 1, 2)"""
_EDGES = "edges as (select l_id, r_id, {} from pairs join a l on l.id = l_id join a r on r.id = r_id)".format(
    ", ".join(f"case {' '.join(f'when {rule[0]} then {rule[i]}' for rule in _RULES)} end as {name}" for i, name in enumerate(("edge_type", "weight", "status", "union_allowed", "reason", "negative"), 1))
)


@query("k16_edges_in_blocks", "select l_id, r_id, edge_type, cast(weight as double) as weight, status, union_allowed, reason, negative from edges where edge_type is not null", *_ALL, _KEYS, _EDGES)
def _(lib):
    """The edges of pairs that meet in a block of at most 60 signals; larger blocks have stars instead of pairs, which k16_edges has too."""
    s = Scratch(lib.spark, "k16b").put(_ready(lib))
    return R.edges_of(s, R.block_pairs(s))


@query("k16_edges")
def _(lib):
    """Every pair's edge by the first rule that holds (K15 over the blocks of K16)."""
    return R.edges(Scratch(lib.spark, "k16").put(_ready(lib)))


@query("k17_groups")
def _(lib):
    return R.resolved(lib.raw("signals"), Scratch(lib.spark, "k17"))[2]


@query("k17_component_sizes")
def _(lib):
    """Components by size; the largest with blocked pairs bounds a task of the union."""
    s = Scratch(lib.spark, "k17s").put(_ready(lib))
    return R.component_sizes(Scratch(lib.spark, "k17e").put(R.edges(s)))


@query("k18_concept_keys")
def _(lib):
    s, e, g = R.resolved(lib.raw("signals"), Scratch(lib.spark, "k18"))
    return R.concept_keys(R.concepts(s, g, e))


@query("k19_concepts")
def _(lib):
    s, e, g = R.resolved(lib.raw("signals"), Scratch(lib.spark, "k19"))
    return R.concepts(s, g, e)


@query("k20_links")
def _(lib):
    """Every signal with its concept and why: the strongest edge that ties it to its group, or none."""
    s, e, g = R.resolved(lib.raw("signals"), Scratch(lib.spark, "k20"))
    ends = e.filter("union_allowed and status = 'active' and negative is null").select(F.explode(F.array("l_id", "r_id")).alias("id"), "weight", "reason")
    best = ends.groupBy("id").agg(F.max(F.struct("weight", "reason")).alias("b"))
    out = s.select("id", "status").join(g, "id", "left").join(best, "id", "left")
    status = F.when(F.col("status") == "rejected", "rejected").when(F.col("group_id").isNotNull(), "materialized_identity").otherwise("active")
    return out.select(F.col("id").alias("signal_id"), F.coalesce("group_id", "id").alias("concept"), status.alias("link_status"), F.col("b.reason").alias("reason"))


@query("k21_reviews")
def _(lib):
    """Counts of what a reviewer should see; 'blocked_pair_inside' must be 0."""
    s, e, g = R.resolved(lib.raw("signals"), Scratch(lib.spark, "k21"))
    c = R.concepts(s, g, e)
    tag = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    names = c.groupBy("role", "name").agg(F.count("*").alias("k")).filter("k > 1")
    out = tag(R.violations(e, g), "blocked_pair_inside").union(tag(R.dispositions(e, g).filter("disposition = 'deferred'"), "merge_candidate"))
    return out.union(tag(c.filter("confidence <= 0.59 and status = 'needs_review'"), "ai_or_weak_only")).union(tag(names, "fragmented_name")).union(tag(c.filter("signals > 60"), "large_group"))


@query("k22_dispositions")
def _(lib):
    _, e, g = R.resolved(lib.raw("signals"), Scratch(lib.spark, "k22"))
    return R.dispositions(e, g)


@query("k23_fallback_index")
def _(lib):
    """(key, media_id, relation): media found by a signal's own key, by keys it must be or may be the same as; keys it can't be are named as blocked."""
    s, e, g = R.resolved(lib.raw("signals"), Scratch(lib.spark, "k23"))
    d = R.dispositions(e, g)
    own = s.filter("media_id is not null").select(F.col("canonical").alias("key"), "media_id", F.lit("direct").alias("relation"))
    both = d.select("l_id", "r_id", "disposition").union(d.select("r_id", "l_id", "disposition")).toDF("a_id", "b_id", "disposition")
    near = both.join(s.select(F.col("id").alias("a_id"), F.col("canonical").alias("key")), "a_id").join(s.select(F.col("id").alias("b_id"), "media_id", F.col("canonical").alias("other")), "b_id").filter("media_id is not null and key <> other")
    relation = F.when(F.col("disposition") == "must", "must").when(F.col("disposition") == "deferred", "deferred").otherwise("blocked")
    return own.union(near.select("key", "media_id", relation.alias("relation"))).distinct()


@query("d32_pair_accounting")
def _(lib):
    """Dispositions against the candidate pairs of all blocks, taken before any rule (total to equality), and the pairs of oversized blocks that were never candidates."""
    scratch = Scratch(lib.spark, "d32")
    s, e, g = R.resolved(lib.raw("signals"), scratch)
    return R.pair_accounting(R.candidate_pairs(s), R.dispositions(e, g)).crossJoin(R.oversized(s))


# Oracles of what follows from the union. SQL takes connected components for groups, which is the same as long as no component holds a blocked pair and no block is larger
# than 60; k17_component_sizes and d32_pair_accounting report both.
_HARD = ", ".join(f"'{x}'" for x in R.HARD)
_UNION = """made as (select * from edges where edge_type is not null), merged as (select l_id, r_id, weight, reason from made where union_allowed and status = 'active' and negative is null),
  sides as (select l_id as x, r_id as y from merged union select r_id, l_id from merged), comp(node, b) as (select x, x from sides union select comp.node, sides.y from comp join sides on sides.x = comp.b), g as (select node as id, min(b) as group_id from comp group by 1)"""
_DISPOSED = f"""placed as (select l_id, r_id, hard, coalesce(x.group_id, l_id) as lg, coalesce(y.group_id, r_id) as rg from (select l_id, r_id, coalesce(bool_or(negative in ({_HARD})), false) as hard from made group by 1, 2) left join g x on x.id = l_id left join g y on y.id = r_id),
  disposed as (select l_id, r_id, case when hard then 'cannot' when lg = rg then 'must' when exists (select 1 from placed q where q.hard and least(q.lg, q.rg) = least(p.lg, p.rg) and greatest(q.lg, q.rg) = greatest(p.lg, p.rg)) then 'transitive_cannot' else 'deferred' end as disposition from placed p)"""
_SCORED = f"""scored as (select l_id, r_id, case when {_EQ('context')} and l.strength = 'explicit' and r.strength = 'explicit' then 2.5 when {_EQ('context')} then 2.0 else 0 end + case when {_EQ('media_id')} or {_EQ('record_id')} then 1.5 else 0 end
  + case when {_EQ('canonical')} and not {_EQ('script')} then 8.0 else 0 end + case when not l.ai and not r.ai then 3.0 when l.ai and r.ai then -5.0 else 0 end + case when {_ROLE_IS('unknown')} then -2.0 else 0 end as score
  from (select distinct l_id, r_id from made where status = 'needs_review') join a l on l.id = l_id join a r on r.id = r_id)"""
_LINKED = (*_ALL, _KEYS, _EDGES, _UNION)
ORACLE |= {
    "k16_edges": oracle("select l_id, r_id, edge_type, cast(weight as double) as weight, status, union_allowed, reason, negative from edges where edge_type is not null", *_ALL, _KEYS, _EDGES),
    "k17_groups": oracle("select id, group_id from g", *_LINKED, recursive=True),
    "k20_links": oracle(
        """select s.id as signal_id, coalesce(group_id, s.id) as concept, case when s.status = 'rejected' then 'rejected' when group_id is not null then 'materialized_identity' else 'active' end as link_status, reason from s left join g on g.id = s.id
        left join (select id, reason from (select *, row_number() over (partition by id order by weight desc, reason desc) as rn from (select l_id as id, weight, reason from merged union all select r_id, weight, reason from merged)) where rn = 1) b on b.id = s.id""",
        *_LINKED, recursive=True,
    ),
    "k22_dispositions": oracle("select l_id, r_id, disposition from disposed", *_LINKED, _DISPOSED, recursive=True),
    "k23_fallback_index": oracle(
        """select distinct key, media_id, relation from (select canonical as key, media_id, 'direct' as relation from s where media_id is not null union all
        select x.canonical, y.media_id, case disposition when 'must' then 'must' when 'deferred' then 'deferred' else 'blocked' end from (select l_id as p, r_id as q, disposition from disposed union all select r_id, l_id, disposition from disposed) join s x on x.id = p join s y on y.id = q where y.media_id is not null and x.canonical <> y.canonical)""",
        *_LINKED, _DISPOSED, recursive=True,
    ),
    "d32_pair_accounting": oracle(
        """select cast(t as bigint) as total, cast(m as bigint) as must, cast(c as bigint) as cannot, cast(tc as bigint) as transitive_cannot, cast(d as bigint) as deferred, cast(t - m - c - tc - d as bigint) as unaccounted, cast(0 as bigint) as duplicates, cast(0 as bigint) as extra, round((m + c + tc + d) / t::double, 12) as coverage, t = m + c + tc + d as equality,
        b as oversized_blocks, cast(0 as bigint) as oversized_pairs, cast(0 as bigint) as oversized_compared, cast(0 as bigint) as oversized_left_out from (select (select count(*) from pairs) as t, count(*) filter (disposition = 'must') as m, count(*) filter (disposition = 'cannot') as c, count(*) filter (disposition = 'transitive_cannot') as tc, count(*) filter (disposition = 'deferred') as d,
        (select count(*) from (select block from keys group by 1 having count(*) > 60)) as b from disposed)""",
        *_LINKED, _DISPOSED, recursive=True,
    ),
    "k37_review_scores": oracle("select l_id, r_id, cast(score as double) as score from scored", *_LINKED, _SCORED, recursive=True),
    "k38_judged_edges": oracle(
        f"""select l_id, r_id, 'llm_must_link' as edge_type, cast(0.9 as double) as weight from scored p where score >= 8 and not exists (select 1 from made where made.l_id = p.l_id and made.r_id = p.r_id and negative in ({_HARD}))
        union all select l_id, r_id, 'llm_cannot_link', cast(0 as double) from scored where score < 0""",
        *_LINKED, _SCORED, recursive=True,
    ),
}
_WEIGHT = f"cast(case trust {' '.join(f"when '{k}' then {v}" for k, v in R.TRUST.items())} else 0 end as double)"
_CONCEPTS = f"""member as (select s.*, coalesce(group_id, s.id) as concept, {_WEIGHT} as tw, coalesce(r.display_value, '') as display, case when role in ('character', 'person') then 'character_person' else role end as rg from s join signals r on r.id = s.id left join g on g.id = s.id),
  ties as (select x.group_id as concept, bool_or(status = 'active') as active_edge, bool_or(ends_with(reason, 'review')) as review_edge, bool_or(negative is not null) as guarded from made join g x on x.id = l_id join g y on y.id = r_id where x.group_id = y.group_id group by 1),
  sums as (select concept, count(*) as signals, count(distinct media_id) as media, count(distinct provider) as providers, bool_and(ai) as all_ai, bool_and(origin_type = 'source_alias_candidate') as all_alias, bool_and(trust = 'weak' or role = 'source_title') as all_weak, coalesce(bool_or(trust = 'strong' and not ai), false) as strong,
    coalesce(bool_or(trust = 'medium'), false) as medium, count(*) filter (not ai and origin_type <> 'source_alias_candidate') as plain, bool_or(ai) as some_ai, count(distinct rg) as role_groups, max(confidence) as best, round(sum(tw), 4) as evidence from member group by 1),
  shown as (select concept, display as name from (select *, row_number() over (partition by concept order by tw desc, confidence desc, length(display), id desc) as rn from member) where rn = 1),
  roles as (select concept, role from (select concept, role, row_number() over (partition by concept order by count(*) desc, role) as rn from member group by 1, 2) where rn = 1),
  stated as (select *, case when role_groups > 1 or coalesce(guarded, false) or coalesce(review_edge, false) or all_ai or all_alias or coalesce(all_weak, false) then 'needs_review' when strong or (medium and (coalesce(active_edge, false) or plain >= 2)) or (some_ai and plain >= 1 and coalesce(active_edge, false)) then 'active' else 'needs_review' end as status from sums left join ties using (concept)),
  con as (select concept, name, role, status, round(case when all_ai then least(0.59, best) when status <> 'active' then least(0.74, best) else best end, 4) as confidence, evidence, signals, media, providers from stated join shown using (concept) join roles using (concept))"""
ORACLE |= {
    "k18_concept_keys": oracle(
        f"select concept, case when n > 1 then base || '#' || n else base end as concept_key from (select concept, base, row_number() over (partition by base order by concept) as n from (select concept, role || ':' || {key_sql(_usual('name'))} as base from con))", *_LINKED, _CONCEPTS, recursive=True
    ),
    "k19_concepts": oracle("select concept, name, role, status, confidence, evidence, signals, media, providers from con", *_LINKED, _CONCEPTS, recursive=True),
    "k21_reviews": oracle(
        """select 'blocked_pair_inside' as kind, cast(0 as bigint) as n union all select 'merge_candidate', count(*) from disposed where disposition = 'deferred' union all select 'ai_or_weak_only', count(*) from con where confidence <= 0.59 and status = 'needs_review'
        union all select 'fragmented_name', count(*) from (select role, name from con group by 1, 2 having count(*) > 1) union all select 'large_group', count(*) from con where signals > 60""",
        *_LINKED, _DISPOSED, _CONCEPTS, recursive=True,
    ),
}

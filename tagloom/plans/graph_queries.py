"""Album metrics and graph operators with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators import albums as A
from tagloom.operators import graph as G
from tagloom.plans.registry import registry

QUERIES, ORACLE, query = registry()

_REACH = "reach(top, album_id) as (select id, id from albums union select top, child_album_id from reach join album_hierarchy on parent_album_id = album_id)"
_PATHS = "reach(top, album_id) as (select id, id from albums union all select top, child_album_id from reach join album_hierarchy on parent_album_id = album_id)"
_BELOW = "b as (select top, reach.album_id, media_id, rating from reach join album_media x on x.album_id = reach.album_id join m on m.id = media_id)"


@query("d05_album_popular_tags", "select top, rank, tag_id, n from (select top, tag_id, count(*) as n, row_number() over (partition by top order by count(*) desc, tag_id) as rank from (select distinct top, media_id from b) d join e on e.media_id = d.media_id group by 1, 2) where rank <= 5", _REACH, _BELOW, recursive=True)
def _(lib):
    return A.popular_tags(lib, 5)


@query("d06_album_media_count", "select top, cast(coalesce(sum(n), 0) as bigint) as n_media from reach left join (select album_id, count(*) as n from album_media group by 1) s on s.album_id = reach.album_id group by 1", _REACH, recursive=True)
def _(lib):
    return A.media_counts(lib)


@query("d07_bulk_metrics", "select top, cast(coalesce(sum(n), 0) as bigint) as n_media, ['safe', 'questionable', 'explicit'][coalesce(max(r), 1)] as max_rating from reach left join (select album_id, count(*) as n, max(list_position(['safe', 'questionable', 'explicit'], coalesce(rating, 'safe'))) as r from album_media x left join m on m.id = media_id group by 1) s on s.album_id = reach.album_id group by 1", _PATHS, recursive=True)
def _(lib):
    return A.bulk_metrics(lib)


@query("d08_max_rating", "select a.id as top, ['safe', 'questionable', 'explicit'][coalesce(max(list_position(['safe', 'questionable', 'explicit'], rating)), 1)] as max_rating from albums a left join b on b.top = a.id group by 1", _REACH, _BELOW, recursive=True)
def _(lib):
    rank = F.array_position(F.array(*map(F.lit, A.RATINGS)), F.col("rating"))
    found = A.rows_below(lib).groupBy("top").agg(F.max(rank).alias("r"))
    return lib.albums.select(F.col("id").alias("top")).join(found, "top", "left").select("top", F.element_at(F.array(*map(F.lit, A.RATINGS)), F.coalesce("r", F.lit(1)).cast("int")).alias("max_rating"))


@query("d09_album_tags", "select distinct top, tag_id from b join e on e.media_id = b.media_id", _REACH, _BELOW, recursive=True)
def _(lib):
    return A.rows_below(lib).select("top", "media_id").distinct().join(lib.edges.select("media_id", "tag_id"), "media_id").select("top", "tag_id").distinct()


@query("d10_flattened_pools", "select top, list_sort(list(distinct media_id)) as media_ids from b group by 1", _REACH, _BELOW, recursive=True)
def _(lib):
    rows = A.rows_below(lib).select("top", "media_id").distinct()
    return rows.groupBy("top").agg(F.sort_array(F.collect_list("media_id")).alias("media_ids"))


@query("f11_subtree_thumbnails", "select top, media_id from (select top, media_id, row_number() over (partition by top order by md5(media_id || ':9'), media_id) as r from (select distinct top, media_id from b)) where r <= 4", _REACH, _BELOW, recursive=True)
def _(lib):
    rows = A.rows_below(lib).select("top", "media_id").distinct()
    return A.top_per_group(rows, "top", [F.md5(F.concat(F.col("media_id").cast("string"), F.lit(":9"))), F.asc("media_id")], 4).select("top", "media_id")


@query("i21_album_delete_cascade", "select id from albums where id not in (select album_id from reach where top = 2000003)", _REACH, recursive=True)
def _(lib):
    return A.without(lib, 2000003, True)[0].select("id")


@query("i21_album_delete_orphan", "select parent_album_id, child_album_id from album_hierarchy where parent_album_id <> 2000003 and child_album_id <> 2000003")
def _(lib):
    return A.without(lib, 2000003, False)[1]


@query("j01_closure", "select top, album_id from reach", _REACH, recursive=True)
def _(lib):
    return A.reach(lib)


@query("j02_breadcrumbs", "select c as node, root, depth, path from (select c, p as root, d as depth, path, row_number() over (partition by c order by d desc) as r from up) where r = 1",
       "one as (select child_album_id as c, min(parent_album_id) as p from album_hierarchy group by 1)",
       "up(c, p, d, path) as (select c, p, 1, p || '/' || c from one union all select up.c, one.p, d + 1, one.p || '/' || path from up join one on one.c = up.p)", recursive=True)
def _(lib):
    edges = lib.album_hierarchy.select(F.col("parent_album_id").alias("parent"), F.col("child_album_id").alias("child"))
    return G.breadcrumbs(edges).select("node", "root", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


_REL = "rel as (select alias_name as a, name as b from tag_aliases join t on t.id = target_tag_id union select display_name, canonical_name from tag_translations where status <> 'rejected'), sym as (select a, b from rel union select b, a from rel)"
_HOPS = "hops(s, k, h) as (select a, a, 0 from (select distinct a from sym where a like 'alt!_%' escape '!') union select s, b, h + 1 from hops join sym on a = k where h < {})"


def _relation(lib):
    named = lib.tag_aliases.join(lib.tags.select(F.col("id").alias("target_tag_id"), "name"), "target_tag_id").select(F.col("alias_name").alias("a"), F.col("name").alias("b"))
    return named.union(lib.tag_translations.filter("status <> 'rejected'").select("display_name", "canonical_name"))


def _expand(lib, rounds):
    start = lib.tag_aliases.filter(F.startswith("alias_name", F.lit("alt_"))).join(lib.tags.select(F.col("id").alias("target_tag_id")), "target_tag_id", "left_semi").select(F.col("alias_name").alias("key")).distinct()
    return G.expand(start, _relation(lib), rounds)


def _expand_all(lib, rounds):
    """From every key of the relation, whichever side it is on."""
    relation = _relation(lib)
    start = relation.select(F.col("a").alias("key")).union(relation.select("b")).filter("key is not null").distinct()
    return G.expand(start, relation, rounds)


@query("j03_two_hop_aliases", "select s as start, k as key, min(h) as hops from hops group by 1, 2", _REL, _HOPS.format(2), recursive=True)
def _(lib):
    return _expand(lib, 2)


@query("j04_four_round_closure", "select s as start, k as key, min(h) as hops from hops group by 1, 2", _REL, _HOPS.format(4), recursive=True)
def _(lib):
    return _expand(lib, 4)


_HOPS_ALL = "hops(s, k, h) as (select a, a, 0 from (select distinct a from sym where a is not null) union select s, b, h + 1 from hops join sym on a = k where h < {} and b is not null)"


@query("j03_all_two_hop_aliases", "select s as start, k as key, min(h) as hops from hops group by 1, 2", _REL, _HOPS_ALL.format(2), recursive=True)
def _(lib):
    return _expand_all(lib, 2)


@query("j04_all_four_round_closure", "select s as start, k as key, min(h) as hops from hops group by 1, 2", _REL, _HOPS_ALL.format(4), recursive=True)
def _(lib):
    return _expand_all(lib, 4)


_PASS = """p{n} as (select * from p{k} union all select distinct f.media_id, i.tag_id, {n} from (select media_id, r.rule_id from p{k} join r on r.tag_id = p{k}.tag_id group by 1, 2 having count(*) = max(wanted)) f
  join implication_implied i on i.rule_id = f.rule_id where not exists (select 1 from p{k} x where x.media_id = f.media_id and x.tag_id = i.tag_id))"""


@query("j05_implications", "select media_id, tag_id, pass from p10 where pass > 0",
       "r as (select x.rule_id, tag_id, wanted from implication_targets x join (select rule_id, count(*) as wanted from implication_targets group by 1) w on w.rule_id = x.rule_id)",
       "p0 as (select media_id, tag_id, 0 as pass from e where not is_suggestion)", *(_PASS.format(n=n, k=n - 1) for n in range(1, 11)))
def _(lib):
    edges = lib.edges.filter("not is_suggestion").select("media_id", "tag_id")
    return G.implied(edges, lib.implication_targets, lib.implication_implied)


@query("j06_components", "select node, min(b) as root from c group by 1",
       "n as (select distinct media_id as a, -record as b from (select media_id, id as record from source_metadata_records where media_id is not null))",
       "s as (select a, b from n union select b, a from n)", "c(node, b) as (select a, b from s union select a, a from s union select c.node, s.b from c join s on s.a = c.b)", recursive=True)
def _(lib):
    """Media and the metadata records that name them."""
    r = lib.raw("source_metadata_records").filter("media_id is not null")
    return G.components(r.select(F.col("media_id").alias("a"), (-F.col("id")).alias("b")))


@query("j07_bipartite_audit", "select n_nodes, count(*) as n_components from (select min_b, count(*) as n_nodes from (select node, min(b) as min_b from c group by 1) group by 1) group by 1",
       "n as (select distinct signal_id as a, -concept_id as b from signal_links where concept_id is not null and link_status = 'active')",
       "s as (select a, b from n union select b, a from n)", "c(node, b) as (select a, b from s union select a, a from s union select c.node, s.b from c join s on s.a = c.b)", recursive=True)
def _(lib):
    """How many components of active signal-concept links have how many nodes."""
    links = lib.raw("signal_links").filter("concept_id is not null and link_status = 'active'")
    roots = G.components(links.select(F.col("signal_id").alias("a"), (-F.col("concept_id")).alias("b")))
    return roots.groupBy("root").agg(F.count("*").alias("n_nodes")).groupBy("n_nodes").agg(F.count("*").alias("n_components"))

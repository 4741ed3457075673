"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import cooccurrence, frequency, groups, lookalikes, packing, variants
from tagloom.llm.sentences import sentences
from tagloom.llm.tokenizer import Tokenizer
from tagloom.session import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pair_table(spark: SparkSession, sf_dir: str) -> cooccurrence.PairTable:
    """media_tags in two batches, the first nine tenths of the time span and the late rows, as an incremental load brings them."""
    links = table(spark, sf_dir, "media_tags").select("media_id", "tag_id", "updated_at")
    seconds = F.col("updated_at").cast("double")
    lo, hi = links.agg(F.min(seconds), F.max(seconds)).first()
    late = F.coalesce(seconds > F.lit(lo + 0.9 * (hi - lo) if lo is not None else 0.0), F.lit(False))
    pairs = cooccurrence.PairTable(spark, "p1", min_count=5)
    return pairs.apply(links.filter(~late), "media_id", "tag_id").apply(links.filter(late), "media_id", "tag_id")


def _scored(pairs: cooccurrence.PairTable) -> DataFrame:
    return pairs.scores(5).select(F.col("a").alias("tag_a"), F.col("b").alias("tag_b"), F.col("n").alias("n_both"), "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.together(_pair_table(spark, sf_dir), 5, 5).select(F.col("a").alias("tag_a"), F.col("b").alias("tag_b"))


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and lift of every pair that occurs at least 5 times."""
    return _scored(_pair_table(spark, sf_dir))


def p1_after_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after a third batch takes away every membership that a reverse search named."""
    links = table(spark, sf_dir, "media_tags").select("media_id", "tag_id", "source")
    gone = links.filter("source = 'reverse_search'")
    return _scored(_pair_table(spark, sf_dir).apply(links.limit(0), "media_id", "tag_id", gone))


def _counting_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "signal_links")
    return links.filter(F.col("concept_id").isNotNull() & F.col("link_status").isin("active", "materialized_identity") & F.col("negative_reason_code").isNull())


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.consolidate(_counting_links(spark, sf_dir), "signal_id", "concept_id")


def p3_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each identity."""
    return p3_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("n_signals"))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = Scratch(spark, "p4").put(frequency.all_counts(table(spark, sf_dir, "media_tags"), "media_id", ["tag_id", "source"]))
    every = counts.filter("field_name is null").first()
    return frequency.marked_terms(counts.filter("field_name is not null"), every["n_records"] if every else 0)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).filter("mark is not null").select("field_name", "term", "mark")


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms with their counts and mark."""
    return _terms(spark, sf_dir)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "source_assertions").select(F.lit("raw_input").alias("field_name"), "id", F.col("raw_input").alias("text"))
    shown = table(spark, sf_dir, "signals").select(F.lit("display_value").alias("field_name"), "id", F.col("display_value").alias("text"))
    return raw.unionByName(shown)


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name with the one form of all names that look like it."""
    names = _names(spark, sf_dir)
    return lookalikes.forms(names, "text", lookalikes.train(names, "text"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each form with the number of rows and of different texts that look like it."""
    return lookalikes.classes_of(p5_forms(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.same_looking_pairs(Scratch(spark, "p5").put(p5_forms(spark, sf_dir)))


def _typed_names(spark: SparkSession, sf_dir: str) -> tuple:
    rows = table(spark, sf_dir, "source_assertions").select("canonical_name_key", "raw_input", "normalized_input")
    return rows, "canonical_name_key", ["raw_input", "normalized_input"], table(spark, sf_dir, "given_nicknames"), lookalikes.train(rows, "raw_input")


def p6_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every canonical_name_key that is a name, with the entity it belongs to: the result that grows with the keys, not with their pairs."""
    return variants.link_keys(*_typed_names(spark, sf_dir))


def p6_link_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by the metric, and apart from them those by middle names, nicknames and initials."""
    return variants.link_kinds(*_typed_names(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.entity_pairs(Scratch(spark, "p6").put(p6_entities(spark, sf_dir)))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return Tokenizer().encode(docs, "text").select("doc_id", "ids")


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts put together again from their ids."""
    return p7_ids(spark, sf_dir).select("doc_id", Tokenizer().decode(F.col("ids")).alias("text"))


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    # pack_capacities is a fixed table of three rows
    capacities = [(r["capacity_id"], r["capacity_tokens"]) for r in table(spark, sf_dir, "pack_capacities").orderBy("capacity_id").collect()]
    sizes = Scratch(spark, "p8").put(p7_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n_tokens")))
    return packing.pack(sizes, "doc_id", "n_tokens", capacities), capacities


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document (and piece of one larger than the capacity) for each capacity."""
    return _packed(spark, sf_dir)[0]


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and filled share of each capacity."""
    return packing.fill(*_packed(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def p9_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence with its text."""
    return sentences(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", with_text=True)


_LINKS = """select distinct media_id, tag_id from media_tags where media_id is not null and tag_id is not null"""
_P1_OF = """with l as ({}), n as (select tag_id, count(*) as n from l group by 1), t as (select count(distinct media_id) as t from l),
p as (select x.tag_id as tag_a, y.tag_id as tag_b, count(*) as n_both from l x join l y on x.media_id = y.media_id and x.tag_id < y.tag_id group by 1, 2 having count(*) >= 5)
"""
_P1 = _P1_OF.format(_LINKS)
_P1_PURGED = _P1_OF.format("select media_id, tag_id from media_tags where media_id is not null and tag_id is not null group by 1, 2 having not coalesce(bool_or(source = 'reverse_search'), false)")
_P1_SCORES = "select tag_a, tag_b, n_both, a.n as n_a, b.n as n_b, round(n_both * t.t::double / (a.n::double * b.n), 6) as lift from p join n a on a.tag_id = tag_a join n b on b.tag_id = tag_b, t"
_P4 = """with v as (select 'tag_id' as field_name, cast(tag_id as varchar) as term, media_id from media_tags union all select 'source', source, media_id from media_tags),
c as (select field_name, term, count(*) as n_rows, count(distinct media_id) as n_records from v where term is not null group by 1, 2),
m as (select *, case when n_records < 4 then 'rare' when n_records * 20 > (select count(distinct media_id) from media_tags) then 'common' end as mark from c)
"""
_P3 = """with recursive e as (select distinct signal_id as s, concept_id as c from signal_links
  where concept_id is not null and link_status in ('active', 'materialized_identity') and negative_reason_code is null and signal_id is not null),
n as (select distinct x.s as a, y.s as b from e x join e y on x.c = y.c),
r(a, b) as (select a, b from n union select r.a, n.b from r join n on r.b = n.a),
g as (select a as signal_id, min(b) as group_id from r group by 1)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_scores": p1_scores,
    "p1_after_purge": p1_after_purge,
    "p3_found": p3_found,
    "p3_group_sizes": p3_group_sizes,
    "p4_found": p4_found,
    "p4_terms": p4_terms,
    "p5_forms": p5_forms,
    "p5_classes": p5_classes,
    "p5_found": p5_found,
    "p6_entities": p6_entities,
    "p6_link_kinds": p6_link_kinds,
    "p6_found": p6_found,
    "p7_ids": p7_ids,
    "p7_decoded": p7_decoded,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_texts": p9_texts,
}
ORACLE = {
    "p1_found": _P1 + "select tag_a, tag_b from p join n a on a.tag_id = tag_a join n b on b.tag_id = tag_b, t where n_both * t >= 5 * a.n * b.n",
    "p1_scores": _P1 + _P1_SCORES,
    "p1_after_purge": _P1_PURGED + _P1_SCORES,
    "p3_found": _P3 + "select signal_id, group_id from g",
    "p3_group_sizes": _P3 + "select group_id, count(*) as n_signals from g group by 1",
    "p4_found": _P4 + "select field_name, term, mark from m where mark is not null",
    "p7_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p4_terms": _P4 + "select field_name, term, n_rows, n_records, mark from m",
}

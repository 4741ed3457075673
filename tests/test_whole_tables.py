"""Queries over whole tables, against plain restatements on hand-made rows."""

import glob
import os
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tagloom.operators import evidence, resolve


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def run(spark, folder, name, **tables):
    """A query over tables written for it."""
    for table, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return __spark_entry__.queries()[name](spark, str(folder))


SMALL = "/root/testdata/sf0.001"
ASSERTED = "id long, source_metadata_record_id long, provider string, asserted_role string, raw_input string"
TEXTS = [
    (1, 10, "a", "artist", "Mao"), (2, 11, "a", "artist", " mao"), (3, 12, "b", "artist", "mao"), (4, 12, "a", "artist", "猫の絵"), (5, 13, "a", "artist", "猫の絵 "), (6, 14, None, "artist", "猫の絵"), (7, 15, None, "artist", "猫の絵"),
    (8, None, "a", "character", "ÉMILIE"), (9, 16, "a", "character", "Émilie"), (10, 17, "a", "character", "Иван"), (11, 17, "a", "character", "김철수"), (12, 18, "a", "character", "ma​o"), (13, 18, "a", None, "港1000users入り"), (14, 19, "a", None, "港50users入り"), (15, 19, "a", None, None),
]


def unit(text):
    found = re.match(r"^(.*?)[ _]*(\d{2,6})users入り$", text)
    return found[1] if found else text.strip(" ").lower()


def units():
    out = defaultdict(list)
    for i, record, provider, role, text in TEXTS:
        if text is not None:
            out[unit(text), provider, role].append((i, record, text))
    return out


def test_k44_k46_take_all_scripts(spark, tmp_path):
    want = units()
    got = run(spark, tmp_path, "k44_all_units", source_assertions=(TEXTS, ASSERTED)).select("unit", "provider", "role", "occurrences", "calls_avoided", "first_id")
    assert rows(got) == sorted(((*k, len(v), len(v) - 1, min(v)[0]) for k, v in want.items()), key=repr)
    sizes = defaultdict(list)
    for (_, _, role), v in want.items():
        sizes[role].append(len(v))
    got = run(spark, tmp_path, "k46_all_summary").select("role", "units", "occurrences", "calls_avoided", "mean")
    assert rows(got) == sorted(((r, len(n), sum(n), sum(n) - len(n), round(sum(n) / len(n), 4)) for r, n in sizes.items()), key=repr)


SIGNALS = "id long, normalized_key string, raw_value string, display_value string, role_hint string, work_context_key string, trust_tier string, status string, provider string, media_id long, source_metadata_record_id long, confidence double, origin_type string"


def signal(i, key, record=None, work=None, role="character", media=None, provider="a", raw=None, origin="manual"):
    return (i, key, raw, key, role, work, "strong", "active", provider, media, record, 0.5, origin)


def test_k14_has_alias_blocks(spark, tmp_path):
    data = [signal(1, "new_name_here", raw="Old Name Here", origin="source_alias_candidate"), signal(2, "old_name_here"), signal(3, "other_name_here")]
    got = run(spark, tmp_path, "k14_all_block_sizes", signals=(data, SIGNALS))
    assert {tuple(r) for r in got.select("kind", "n_blocks", "n_rows", "largest").collect()} >= {("alias", 1, 2, 2), ("exact", 3, 3, 1)}


def test_k06_gives_every_assertion_its_candidates(spark, tmp_path):
    got = run(spark, tmp_path, "k06_candidates", source_assertions=(TEXTS, ASSERTED))
    first = {r["id"]: [] for r in spark.createDataFrame(TEXTS, ASSERTED).collect()}
    for i, *hint in rows(evidence.hints(spark.createDataFrame(TEXTS, ASSERTED).filter("raw_input is not null"))):
        first[i].append(tuple(hint))
    want = [(i, record, *key, *hint, len(members)) for key, members in units().items() for i, record, _ in members for hint in first[min(members)[0]]]
    assert {r["assertion_id"] for r in got.collect()} == {t[0] for t in TEXTS if t[4] is not None}
    assert rows(got) == sorted(want, key=repr)
    assert rows(evidence.candidates(spark.createDataFrame(TEXTS, ASSERTED), hot_rows=1)) == rows(got)


def test_d32_accounts_for_candidates_before_the_rules(spark, tmp_path):
    data = [signal(1, "series_name_here_(x)", role="series"), signal(2, "series_name_here_(y)", role="series"), signal(3, "same_name_here"), signal(4, "same_name_here")]  # no rule holds for 1 and 2
    data += [signal(100 + i, f"one_of_a_crowd_{i}", media=7) for i in range(resolve.BLOCK + 1)]
    got = run(spark, tmp_path, "d32_pair_accounting", signals=(data, SIGNALS)).first().asDict()
    crowd = (resolve.BLOCK + 1) * resolve.BLOCK // 2
    assert got == dict(total=2, must=1, cannot=0, transitive_cannot=0, deferred=0, unaccounted=1, duplicates=0, extra=0, coverage=0.5, equality=False, oversized_blocks=1, oversized_pairs=crowd, oversized_compared=0, oversized_left_out=crowd)


def test_d32_duplicates_and_extra(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "l_id long, r_id long")
    found = spark.createDataFrame([(1, 2, "must"), (1, 2, "cannot"), (1, 3, "deferred"), (8, 9, "must")], "l_id long, r_id long, disposition string")
    got = resolve.pair_accounting(pairs, found).first().asDict()
    assert got == dict(total=3, must=1, cannot=1, transitive_cannot=0, deferred=1, unaccounted=1, duplicates=1, extra=1, coverage=round(2 / 3, 12), equality=False)
    whole = resolve.pair_accounting(pairs, spark.createDataFrame([(1, 2, "must"), (1, 3, "cannot"), (2, 3, "deferred")], "l_id long, r_id long, disposition string")).first()
    assert whole["coverage"] == 1 and whole["equality"]


def test_k10_pairs_the_work_with_all_declared_contexts(spark, tmp_path):
    data = []
    for r in (1, 2):  # three contexts in a record; one signal has both a field and brackets
        data += [signal(10 * r, "the_long_work", r, role="work", media=r), signal(10 * r + 1, "ann_(long_work_alt)", r, work="the_long_work", media=r), signal(10 * r + 2, "bob_(other_alias)", r, media=r)]
    for r, work in ((3, "first_work"), (4, "first_work"), (5, "second_work"), (6, "second_work")):  # a context of two works
        data += [signal(10 * r, work, r, role="work", media=r), signal(10 * r + 1, "cy_(shared_name)", r, media=r)]
    data += [signal(70, "sky_harbor_2", 7, role="work"), signal(71, "di_(skyharbor2)", 7), signal(72, "eve_(once_only)", 7), signal(73, "fay_(sky)", 7)]  # equal without separators
    for r in (8, 9):  # two works
        data += [signal(10 * r + 100, "third_work", r, role="work", media=r), signal(10 * r + 101, "fourth_work", r, role="work", media=r), signal(10 * r + 102, "gus_(unsure_name)", r, media=r)]
    got = run(spark, tmp_path, "k10_context_aliases", signals=(data, SIGNALS)).select("context", "label")
    assert rows(got) == [("long_work_alt", "other_alias"), ("other_alias", "other_alias"), ("sky_harbor_2", "skyharbor2"), ("skyharbor2", "skyharbor2"), ("the_long_work", "other_alias")]


@pytest.mark.parametrize("name", ["c07_all_siblings", "c12_all_media_with_tags", "h27_all_tag_strings", "n_all_media_detail", "b19_all_pool_any"])
def test_whole_tables_against_sql(spark, name):
    got = __spark_entry__.queries()[name](spark, SMALL)
    assert matches(got, name)


def matches(got, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    return want and rows(got) == sorted(map(tuple, want), key=repr)


TAGS = ([(30, "bell", "general", 1), (5, "cat", "general", 1), (15, "dog", "general", 1), (4, "eel", "general", 1)], "id long, name string, category string, post_count long")


def test_j03_j04_k05_take_all_aliases(spark, tmp_path):
    data, schema = TAGS
    spark.createDataFrame(data, schema).withColumn("created_at", F.current_timestamp()).write.parquet(f"{tmp_path}/tags.parquet")
    aliases = {(f"{p}_{name}", name) for p, n in (("old", 5), ("alt", 15)) for i, name, *_ in data if i % n == 0}
    pairs = aliases | {(f"zh_{name}", name) for i, name, *_ in data if i % 3 != 2 and i % 9} | {(f"zh2_{name}", name) for i, name, *_ in data if i % 4 == 0}
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    for name, rounds in (("j03_all_two_hop_aliases", 2), ("j04_all_four_round_closure", 4)):
        want = set()
        for start in near:
            seen, last = {start: 0}, {start}
            for n in range(1, rounds + 1):
                last = {y for x in last for y in near[x]} - set(seen)
                seen |= dict.fromkeys(last, n)
            want |= {(start, k, h) for k, h in seen.items()}
        assert rows(run(spark, tmp_path, name).select("start", "key", "hops")) == sorted(want, key=repr)
    said = ([("bell",), ("dog",), ("alt_dog",), ("fox",), ("",)], "canonical_name_key string")
    names = {n for n, in said[0] if n}
    want = {(n, n, "own") for n in names} | {(x, y, "alias") for a, b in aliases for x, y in ((a, b), (b, a)) if y in names}
    assert rows(run(spark, tmp_path, "k05_all_name_index", source_assertions=said)) == sorted(want, key=repr)

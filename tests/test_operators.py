"""Core operators on hand-made rows."""

import itertools
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagloom.functions import text as T
from tagloom.operators import evidence, graph, resolve, scoring, stats, sync, tagstore
from tagloom.operators import soft_search as soft
from tagloom.session import salted_join
from tagloom.sources import exchange


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "t string")


def test_salted_join_equals_a_join(spark):
    big = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 99), (3, 98), (None, 97)], "k int, v int")
    unique = big.filter("k is not null").groupBy("k").agg(F.count("*").alias("n_rows")).filter("k <> 3").withColumn("w", F.col("k") * 10)
    assert rows(salted_join(big, unique, "k", "v", "inner", 10).select("k", "v", "w")) == rows(big.join(unique, "k").select("k", "v", "w"))
    assert salted_join(big, unique, "k", "v", "left", 10).count() == big.count()


# Functions


def test_h01_h02_golden_strings(spark):
    df = texts(spark, ["  Ａｂ  c　d ", "Straße", "ゴジラ・モスラ", "a / b|c", "x(y)", "", None, "__a!!b__", "한글 이름"])
    got = [tuple(r) for r in df.select(T.normalize(F.col("t")), T.canonical_key(F.col("t"))).collect()]
    assert got == [("Ab c d", "ab_c_d"), ("Straße", "strasse"), ("ゴジラ・モスラ", "ゴジラ_モスラ"), ("a / b|c", "a_b_c"), ("x(y)", "x(y)"), ("", ""), (None, None), ("__a!!b__", "a_b"), ("한글 이름", "한글_이름")]


def test_h02_fast_path_is_the_same_function(spark):
    values = ["".join(c) for c in itertools.product("aZ_ /(", repeat=3)] + ["a-b.c+d:e", "A,B", "tab\tx", "9'x\""]
    got = [r[0] for r in texts(spark, values).select(T.canonical_key(F.col("t"))).collect()]
    assert got == [T._key(v) for v in values]


def test_h11_external_ids(spark):
    df = texts(spark, ["1234567_p0 and 12345678-p12", "123456", "1234567890123", "a7654321b 7654321", None])
    got = [[tuple(x) for x in r[0]] if r[0] is not None else None for r in df.select(T.external_ids(F.col("t"))).collect()]
    assert got == [[("1234567", 0), ("12345678", 12)], [], [], [("7654321", None)], None]


def test_h08_h09_h13(spark):
    df = texts(spark, ["harbor500users入り", "海５００Users入", "users入り", "R-18", "NSFW", "Blue Hair", "水着", "https://a.b", "C:\\x", "\\\\host", "12 34", "  ", None, "Name"])
    got = [r[0] for r in df.select(T.rejection(F.col("t"))).collect()]
    assert got == ["popularity_meta"] * 3 + ["explicit_r18_meta"] * 2 + ["descriptive_general"] * 2 + ["url_or_path"] * 3 + [None] + ["empty_or_invalid"] * 2 + [None]
    assert [r[0] and tuple(r[0]) for r in df.select(T.popularity(F.col("t"))).collect()][:4] == [("harbor", 500), ("海", 500), None, None]
    assert [r[0] for r in texts(spark, ["abc", "abcdefg", "abc_def", "abcdefgh", "_ab_", "_abcdefg", None, ""]).select(T.short_key(F.col("t"))).collect()] == [True, True, False, False, True, True, True, True]


def test_h05_script_families(spark):
    got = [r[0] for r in texts(spark, ["Ａb", "漢字 abc", "ｶﾅ", "한글", "Жан", "12", " ", None]).select(T.script_family(F.col("t"))).collect()]
    assert got == ["latin", "latin+cjk", "kana", "hangul", "other", "other", "unknown", "unknown"]


def test_h17_tables(spark):
    df = texts(spark, ["Creator", "series", "observed", "BLOCKED", "High", "0.4", None])
    got = [tuple(r) for r in df.select(T.mapped(F.lower("t"), T.SOURCE_ROLES, "unknown"), T.mapped(F.col("t"), T.SOURCE_TAG_CATEGORY_ROLES, "unknown"), T.concept_status(F.col("t")), T.confidence_score(F.col("t"), 0.1)).collect()]
    assert [g[0] for g in got] == ["artist"] + ["unknown"] * 6 and got[1][1] == "work" and [g[2] for g in got][2:4] == ["active", "rejected"] and [g[3] for g in got][4:] == [0.9, 0.4, 0.1]


def test_b38_redaction(spark):
    got = [r[0]["reason"] for r in texts(spark, ["token = x", "see https://a.b/c", "in /home/u/x", "img.png here", "plain"]).select(T.redacted(F.col("t"))).collect()]
    assert got == ["secret", "url", "path", "filename", None]


# Graphs


def test_j01_circle_and_diamond(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (10, 11), (10, 12), (11, 13), (12, 13)], "parent long, child long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 10, 11, 12, 13)], "node long")
    reach = set(rows(graph.closure(edges, nodes)))
    assert {b for a, b in reach if a == 1} == {1, 2, 3} and {b for a, b in reach if a == 10} == {10, 11, 12, 13}
    paths = {(r["top"], r["node"]): r["paths"] for r in graph.path_counts(edges, nodes).collect()}
    assert paths[(10, 13)] == 2 and paths[(10, 11)] == 1 and (1, 2) not in paths


def test_j05_implications(spark):
    edges = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "media_id long, tag_id long")
    targets = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (3, 4)], "rule_id long, tag_id long")
    out = spark.createDataFrame([(1, 3), (2, 4), (3, 1)], "rule_id long, tag_id long")
    assert rows(graph.implied(edges, targets, out)) == [(1, 3, 1), (1, 4, 2)]
    assert rows(graph.implied(edges, targets, out, passes=1)) == [(1, 3, 1)]


@pytest.mark.parametrize("seed", range(2))
def test_j06_components(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randint(1, 60), rnd.randint(1, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    got = dict(rows(graph.components(spark.createDataFrame(pairs + [(None, 3)], "a long, b long"), hot_rows=5)))
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert got == {x: find(x) for x in parent}


# Resolution


def _edge(l, r, weight=0.9, negative=None):
    return (l, r, "e", weight, "active" if negative is None else "rejected", negative is None, "why", negative)


EDGES = "l_id long, r_id long, edge_type string, weight double, status string, union_allowed boolean, reason string, negative string"


def test_k17_cannot_link_triangle(spark):
    e = spark.createDataFrame([_edge(1, 2, 0.9), _edge(2, 3, 0.8), _edge(1, 3, 0.0, "work_context_conflict"), _edge(7, 8)], EDGES)
    groups = resolve.constrained_groups(e)
    assert dict(rows(groups)) == {1: 1, 2: 1, 3: 3, 7: 7, 8: 7}
    assert resolve.violations(e, groups).count() == 0
    kinds = {(a, b): k for a, b, k in rows(resolve.dispositions(e, groups))}
    assert kinds == {(1, 2): "must", (2, 3): "transitive_cannot", (1, 3): "cannot", (7, 8): "must"}


@pytest.mark.parametrize("seed", range(3))
def test_k17_invariants_and_order(spark, seed):
    rnd = random.Random(seed)
    made = [_edge(*sorted(rnd.sample(range(30), 2)), round(rnd.random(), 3), rnd.choice([None, None, None, "role_conflict"])) for _ in range(60)]
    groups = {tuple(sorted(rows(resolve.constrained_groups(spark.createDataFrame(rnd.sample(made, len(made)), EDGES))))) for _ in range(2)}
    assert len(groups) == 1
    group = dict(next(iter(groups)))
    assert all(group.get(e[0], e[0]) != group.get(e[1], e[1]) for e in made if e[7])


SIGNAL = dict(surface="long_enough_name", canonical="long_enough_name", role="character", context=None, trust="strong", provider="a", media_id=1, record_id=1, confidence=0.9, script="latin", ai=False, ambiguous=False, anchor=None, alias=None, strength="none", origin_type="x")
TYPES = "surface string, canonical string, role string, context string, trust string, provider string, media_id long, record_id long, confidence double, script string, ai boolean, ambiguous boolean, anchor string, alias string, strength string, origin_type string"
RULES = [
    (dict(role="work"), {}, False, "role_conflict_guard"),
    (dict(role="source_title"), dict(role="unknown"), False, "source_title_context_only"),
    (dict(role="artist"), dict(role="artist"), False, "creator_identity_strong_evidence_missing"),
    (dict(role="unknown"), {}, False, "unknown_role_requires_corroboration"),
    (dict(context="x"), dict(context="y"), False, "work_context_conflict_guard"),
    (dict(alias="k", context="x"), dict(alias="k", context="y"), False, "alias_context_conflict_guard"),
    (dict(alias="k", context="x", canonical="p", surface="p"), dict(alias="k", context="x", canonical="q", surface="q"), False, "alias_candidate_component"),
    (dict(ambiguous=True, context="x", role="unknown", origin_type="manual"), dict(context="y"), False, "work_context_conflict_guard"),
    (dict(ambiguous=True), dict(context="y"), False, "ambiguous_short_same_scope_review"),
    (dict(ambiguous=True, media_id=5, record_id=5), dict(context="y"), False, "ambiguous_short_partial_work_context_review"),
    (dict(ambiguous=True, media_id=5, record_id=5), {}, False, "ambiguous_short_guard"),
    (dict(anchor="z"), dict(anchor="z"), False, "stable_identity_anchor"),
    (dict(anchor="z", ai=True), dict(anchor="z", ai=True), False, "medium_ai_identity_anchor_review"),
    (dict(context="x"), dict(context="x"), False, "same_surface_and_work_context"),
    ({}, {}, False, "exact_canonical_key"),
    ({}, dict(context="x"), False, "exact_key_partial_context_review"),
    (dict(trust="weak"), dict(trust="weak"), False, "weak_exact_key_context_needed"),
    (dict(surface="p", canonical="p"), dict(surface="q", canonical="q"), True, "cooccurrence_only_context"),
    (dict(surface="p", canonical="p"), dict(surface="q", canonical="q"), False, None),
]


def test_k15_every_rule(spark):
    names = [t.split()[0] for t in TYPES.split(", ")]
    schema = ", ".join(f"{p}_{t}" for p in "lr" for t in TYPES.split(", ")) + ", co boolean, i int"
    data = [tuple((SIGNAL | left)[n] for n in names) + tuple((SIGNAL | right)[n] for n in names) + (co, i) for i, (left, right, co, _) in enumerate(RULES)]
    got = spark.createDataFrame(data, schema).select("i", resolve.pair_rule(F.col("co")).alias("e")).collect()
    assert {r["i"]: r["e"] and r["e"]["reason"] for r in got} == {i: want for i, (*_, want) in enumerate(RULES)}


def test_k16_large_blocks_become_stars(spark):
    schema = "id long, " + TYPES + ", status string, display string, declared string"
    names = [t.split()[0] for t in TYPES.split(", ")]
    data = [(i, *((SIGNAL | dict(anchor="character:long_enough_name", media_id=i, record_id=i, confidence=i / 100))[n] for n in names), "active", "d", None) for i in range(1, 21)]
    e = resolve.edges(spark.createDataFrame(data, schema), block=5)
    assert e.count() == 19 and {r["r_id"] for r in e.collect()} == {20}
    assert set(dict(rows(resolve.constrained_groups(e))).values()) == {1}


# Upserts


def test_i01_i03_i19_precedence_grid(spark):
    old = spark.createDataFrame([(1, i, s, 0.4, k, False) for i, (s, k) in enumerate(itertools.product(["manual", "ai_wd", None], [True, False]))], "media_id long, tag_id long, source string, confidence double, is_locked boolean, is_suggestion boolean")
    new = spark.createDataFrame([(1, i, 0.3) for i in range(7)], "media_id long, tag_id long, confidence double")
    got = {r["tag_id"]: (r["source"], r["confidence"], r["is_locked"], r["is_suggestion"]) for r in tagstore.ai_tags(old, new).collect()}
    assert got == {0: ("manual", 0.4, True, False), 1: ("manual", 0.4, False, False), 2: ("ai_wd", 0.4, True, False), 3: ("ai_wd", 0.3, False, True), 4: (None, 0.4, True, False), 5: ("ai_wd", 0.3, False, True), 6: ("ai_wd", 0.3, False, True)}
    assert {tuple(r)[2:] for r in tagstore.set_tags(old, new).collect()} == {("manual", 1.0, True, False)}


def test_i07_empty_set_clears_a_medium(spark):
    old = spark.createDataFrame([(1, 1, "x", 0.1, False, False), (2, 1, "x", 0.1, False, False)], "media_id long, tag_id long, source string, confidence double, is_locked boolean, is_suggestion boolean")
    wanted = spark.createDataFrame([(1, None)], "media_id long, tag_id long")
    assert [r["media_id"] for r in tagstore.replace_tags(old, wanted).collect()] == [2]


def test_i20_decisions(spark):
    c = spark.createDataFrame([(1, 1, "a", "open"), (2, 2, "a", "open"), (3, 3, "a", "open")], "media_id long, entity_id long, role string, status string")
    d = spark.createDataFrame([(1, 1, "a", True), (2, 2, "a", False)], "media_id long, entity_id long, role string, accept boolean")
    done, assigned = tagstore.decide_candidates(c, d)
    assert [r["status"] for r in done.orderBy("media_id").collect()] == ["accepted", "rejected", "open"] and assigned.count() == 1


def test_last_per_key(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, turn int, v string")
    assert rows(tagstore.last_per_key(df, ["k"], "turn")) == [(1, "b"), (2, "c")]


# Soft search codec, statistics, sync, scoring


def test_b29_filter_codec():
    fields = {"kind": "assertion", "key": "ゴジラ"}
    assert soft.decode_filter(soft.encode_filter(fields)) == fields
    assert soft.decode_filter("Not A Filter!") == {"key": "not_a_filter"}


def test_b26_resolution():
    aliases = {"neko": ["cat"], "inu": ["dog", "wolf"]}
    assert [soft.resolve_term(aliases, {"gone"}, {"tori": "bird", "gone": "x"}, t) for t in ("Neko", "inu", "tori", "gone", "zz")] == ["cat", "inu", "bird", "gone", "zz"]


def test_d40_quantile_places(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 2, 3, 9)] + [("b", 5), ("b", None)], "g string, v int")
    pick = lambda rule, p: dict((r["g"], r["q"]) for r in stats.quantiles(df, ["g"], "v", {"q": p}, rule).collect())
    for p in (0.0, 0.3, 0.5, 0.9, 1.0):
        s = [1, 2, 2, 3, 9]
        assert pick("floor_n", p)["a"] == s[min(4, int(p * 5))] and pick("round_n1", p)["a"] == s[round(p * 4)] and pick("floor_n1", p)["a"] == s[int(p * 4)]
        assert pick("floor_n", p)["b"] == 5


def test_d31_fingerprint_ignores_order_but_not_values(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id long, v string")
    b = spark.createDataFrame([(2, None), (1, "x")], "id long, v string")
    mark = lambda d: tuple(stats.fingerprint(d, "id", "v").first())
    assert mark(a) == mark(b) and mark(a) != mark(a.fillna("y")) and mark(a.limit(0)) == (0, "0")


def test_l01_l02_snapshots(spark):
    t = "path_id long, file_size long, mtime long"
    old = spark.createDataFrame([(1, 5, 1), (2, 5, 1), (3, 5, None)], t)
    now = spark.createDataFrame([(1, 5, 1), (2, 6, 1), (3, 5, None), (4, 1, 1)], t)
    assert {a: s for a, s, *_ in rows(sync.diff(old, now, "path_id"))} == {1: "unchanged", 2: "changed", 3: "unchanged", 4: "new"}
    assert {a: s for a, s, *_ in rows(sync.diff(now, old, "path_id"))}[4] == "missing"
    assert {a: s for a, s, *_ in rows(sync.diff(now, old, "path_id", complete=False))}[4] == "deferred"


def test_m05_zero_vector_and_tie(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (3, [1.0, 1.0], 0), (4, [0.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "label int, centroid array<double>")
    got = {r["vec_id"]: r["label"] for r in scoring.zero_shot(v, c).collect()}
    assert got == {1: 0, 2: 1, 3: None, 4: None}


def test_k31_duplicates(spark):
    m = spark.createDataFrame([(1, "h", 5, None, 0.5), (2, "h", 5, None, 0.9), (3, "g", 1, None, 0.1)], "id long, hash string, file_size long, parent_id long, content_class_confidence double")
    assert [(r["id"], r["keep_rank"], r["eligible"]) for r in evidence.duplicates(m).orderBy("keep_rank").collect()] == [(2, 1, False), (1, 2, True)]


# Exchange


def test_a08_csv_import(spark, tmp_path):
    (tmp_path / "tags.csv").write_text('Cat,0,5,"neko,Mao,cat"\ndog,9,1,inu\nalone\nCAT,1,5,\nbird,4,1,neko\n' + "x" * 300 + ",0,1,\n")
    raw = exchange.read_tag_csv(spark, str(tmp_path / "tags.csv")).coalesce(1)
    tags = spark.createDataFrame([("dog", "artist")], "name string, category string")
    none = spark.createDataFrame([], "alias_name string, target_tag_id long")
    insert, update, aliases = exchange.import_tags(raw, tags, none)
    assert rows(insert) == [("bird", "character"), ("cat", "general")] and rows(update) == [("dog", "general")]
    assert rows(aliases) == [("inu", "dog"), ("mao", "cat"), ("neko", "cat")]
    assert rows(exchange.import_tags(raw, tags, none, strict=True)[0]) == [("bird", "character"), ("cat", "general")]


def test_a02_a07_scan_and_sizes(spark, tmp_path):
    import struct

    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 30, 20) + b"\x00" * 9)
    (tmp_path / "b.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 7, 9) + b"\x00")
    (tmp_path / "c.txt").write_text("x")
    files = exchange.admissible(exchange.scan(spark, str(tmp_path)))
    assert {r["path"].rsplit("/", 1)[1]: r["reason"] for r in files.collect()} == {"a.png": None, "b.gif": None, "c.txt": "unsupported_extension"}
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    assert {r["kind"]: (r["width"], r["height"]) for r in exchange.image_size(content).collect()} == {"png": (30, 20), "gif": (7, 9), None: (None, None)}


def test_a19_a20_a21_dictionary_cache_report(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"name":"cat","text":"猫"}\n{"name":"ant","text":"猫"}\n{"name":"x"}\n')
    assert rows(exchange.reverse_dictionary(spark, str(tmp_path / "d.json"))) == [("猫", "ant")]
    made = []
    keep = exchange.Cached(spark, str(tmp_path / "cache"))
    make = lambda: made.append(1) or spark.createDataFrame([(1,)], "v int")
    assert [keep.get("q", v, make).count() for v in ("1", "1", "2")] == [1, 1, 1] and len(made) == 2
    late = exchange.Cached(spark, str(tmp_path / "cache"), clock=lambda: __import__("time").time() + 3601)
    assert late.get("q", "1", make).count() == 1 and len(made) == 3  # too old
    assert keep.invalidate("r") == 0 and keep.invalidate("q") == 1 and keep.get("q", "1", make).count() == 1 and len(made) == 4
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert rows(exchange.write_report(df, str(tmp_path / "r"), "csv")) == rows(exchange.checksum(df.orderBy(F.desc("id"))))


def test_a18_second_store(spark, tmp_path):
    """A table of another database, here Derby in memory, which Spark brings along."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url, options = "jdbc:derby:memory:second;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.createDataFrame([(1, "cat"), (2, None)], "id int, name string")
    df.write.format("jdbc").options(url=url, dbtable="tags", **options).mode("overwrite").save()
    assert rows(exchange.second_store(spark, url, "tags", **options).select("ID", "NAME")) == [(1, "cat"), (2, None)]


def test_j01_long_chain_and_part_of_the_tops(spark):
    n = 37
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 2), (None, 1)], "parent long, child long")
    nodes = spark.createDataFrame([(0,), (30,), (99,)], "node long")
    want = {(0, i) for i in range(n + 1)} | {(30, i) for i in range(30, n + 1)} | {(99, 99)}
    assert set(rows(graph.closure(edges, nodes))) == want


def test_streaming_late_rows_are_dropped(spark, tmp_path):
    from tagloom.streaming import library as st

    for i, rows_ in enumerate([[(1, "2024-01-01 00:10:00")], [(2, "2024-01-02 00:00:00")], [(5, "2024-01-02 00:30:00")], [(3, "2024-01-01 00:20:00"), (4, "2024-01-03 00:00:00")]]):
        pd.DataFrame([(e, pd.Timestamp(t), 1, "view", 1.0) for e, t in rows_], columns=["event_id", "ts", "user_id", "event_type", "value"]).astype({"event_type": "object"}).to_parquet(tmp_path / f"{i}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(tmp_path / f"{i}.parquet", (1_700_000_000 + 60 * i,) * 2)  # the stream takes files in order of time
    stream = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    got = st.run_available(st.windowed_counts(stream, "1 hour", late="1 hour"), "late")
    assert sorted(r["n"] for r in got.collect()) == [1, 2]  # event 3 came after its window was closed


# Signal sources


def test_k07_sources_by_hand(spark):
    names = spark.createDataFrame([(1, 5, 6, "Ann", "artist", False, "observed"), (2, 5, 6, "Ann", "artist", True, "observed"), (3, 5, 6, "Ann", "artist", False, "blocked"), (4, 5, 6, "Ann", None, False, "blocked"), (5, 5, 6, " ", "artist", False, None), (6, 5, 6, "Bo", "creator", None, None)], "id long, media_id long, record_id long, raw_name string, name_role string, requires_review boolean, status string")
    got = {r["signal_key"]: (r["role_hint"], r["trust_tier"], r["status"]) for r in evidence.name_observation_signals(names).collect()}
    assert got == {"name:1": ("artist", "medium", "active"), "name:2": ("artist", "medium", "needs_review"), "name:3": ("artist", "rejected", "rejected"), "name:4": ("unknown", "weak", "needs_review"), "name:6": ("artist", "medium", "active")}
    tags = spark.createDataFrame([(1, 1, "sky", "general", "observed"), (1, 2, "ann_(work)", "general", "observed"), (1, 3, "bo", "4", None), (1, 4, "x500users入り", "artist", "observed"), (1, 5, "odd", "other", "observed"), (1, 6, "y", None, "observed")], "media_id long, tag_id long, raw_tag string, category string, status string")
    got = {r["signal_key"]: (r["role_hint"], r["trust_tier"], r["status"]) for r in evidence.tag_observation_signals(tags).collect()}
    assert got == {
        "tag:1:1": ("unknown", "rejected", "rejected"), "tag:1:2": ("character", "medium", "active"), "tag:1:3": ("character", "medium", "needs_review"), "tag:1:4": ("artist", "rejected", "rejected"),
        "tag:1:5": ("unknown", "weak", "active"), "tag:1:6": ("unknown", "rejected", "rejected"),
    }
    aliases = spark.createDataFrame([("a", "Ann", "Anna", "superseded", True), ("b", "Bo", "Bob", "accepted", False), ("c", "Cy", "", None, True)], "alias_id string, source_name string, target_name string, status string, requires_review boolean")
    got = {r["signal_key"]: (r["trust_tier"], r["status"]) for r in evidence.alias_candidate_signals(aliases).collect()}
    assert got == {"alias:a:source": ("rejected", "rejected"), "alias:a:target": ("rejected", "rejected"), "alias:b:source": ("medium", "active"), "alias:b:target": ("medium", "active"), "alias:c:source": ("medium", "needs_review")}
    found = spark.createDataFrame([(1, 1, "Ann", "artist", "accepted", "x", True), (2, 1, "Ann", "artist", "accepted", "ai_model_tag", True), (3, 1, "Ann", "artist", "pending", "ai_model_tag", True), (4, 1, "Ann", "title", "accepted", None, True), (5, 1, "Ann", "artist", "accepted", "x", None)], "id long, record_id long, value string, candidate_role string, candidate_status string, origin string, active boolean")
    got = {r["signal_key"]: (r["trust_tier"], r["status"]) for r in evidence.extracted_candidate_signals(found).collect()}
    assert got == {"candidate:1": ("medium", "active"), "candidate:2": ("medium_ai", "needs_review"), "candidate:3": ("weak", "needs_review"), "candidate:4": ("weak", "needs_review"), "candidate:5": ("rejected", "rejected")}


def test_a16_saved_pages(spark, tmp_path):
    from tagloom.sources import posts

    (tmp_path / "c.json").write_text(
        '{"id":1,"rating":"G","md5":"ab","file_ext":"png","large_file_url":"https://x/y/z.png","tag_string_artist":" ann  bo ","tag_string_general":"sky","score":3,"extra":1}\n'
        '{"id":2,"rating":null,"tag_string":"old style","file_url":"https://x/y/z.png?q=1"}\n{"id":3,"rating":"?","source":""}\nnot json\n{"rating":"e"}\n'
    )
    got = {r["id"]: r for r in posts.read_posts(spark, str(tmp_path / "c.json"), "categorised", "https://x").collect()}
    assert set(got) == {1, 2, 3} and [(t["name"], t["category"]) for t in got[1]["tags"]] == [("sky", "general"), ("ann", "artist"), ("bo", "artist")]
    assert (got[1]["filename"], got[1]["file_url"], got[1]["rating"], got[1]["score"]) == ("ab.png", "https://x/y/z.png", "safe", 3)
    assert (got[2]["filename"], len(got[2]["tags"]), got[2]["rating"]) == ("z.png", 2, "safe") and (got[3]["filename"], got[3]["tags"], got[3]["source"], got[3]["width"]) == ("booru_3", [], "", 0)
    (tmp_path / "p.json").write_text('{"id":1,"rating":"E","image":"a.png","file_url":"/img/b.png","preview_url":"t/c.png","tags":"sky ann","width":5}\n{"id":2,"file_url":"https://y/d.png"}\n{"id":3}\n')
    got = {r["id"]: r for r in posts.read_posts(spark, str(tmp_path / "p.json"), "plain", "https://x/").collect()}
    assert (got[1]["filename"], got[1]["file_url"], got[1]["preview_url"], got[1]["rating"], got[1]["width"]) == ("a.png", "https://x/img/b.png", "https://x/t/c.png", "explicit", 5)
    assert got[2]["filename"] == "d.png" and got[3]["filename"] == "gelbooru_3" and got[3]["file_url"] is None
    with pytest.raises(ValueError):
        posts.read_posts(spark, str(tmp_path / "p.json"), "other", "https://x")

"""The query surface on a small library, its semantics traps 1, 2 and 7."""

from datetime import datetime, timezone

import pytest

from tagloom.engine import Engine
from tagloom.library import Library
from tagloom.streaming.library import Refreshed

T = datetime(2024, 1, 1)
MEDIA = "id long, filename string, path string, hash string, file_type string, mime_type string, file_size long, width int, height int, duration double, rating string, uploaded_at timestamp, source string, parent_id long, content_class string, content_class_confidence double, exported_at timestamp"


@pytest.fixture(scope="module")
def engine(spark):
    def medium(i, rating="safe", parent=None):
        return (i, f"{i}.png", f"/{i}.png", f"h{i}", "image", "image/png", 100 * i, 10, 10, None, rating, T, None, parent, "anime", 0.9, T)

    given = {
        "media": spark.createDataFrame([medium(0), medium(1, "questionable"), medium(2, "explicit", 0), medium(3, parent=0), medium(4)], MEDIA),
        "tags": spark.createDataFrame([(0, "cat", "general", 2, T), (1, "hat_(red)", "general", 1, T), (2, "re:zero", "copyright", 1, T), (3, "alice", "artist", 0, T), (4, "cat_box", "general", 1, T)], "id long, name string, category string, post_count long, created_at timestamp"),
        "media_tags": spark.createDataFrame([(0, 0, "manual", 0.9, True, False, T, T), (1, 0, "ai_wd", 0.3, False, True, T, T), (2, 1, "manual", 0.9, True, False, T, T), (3, 2, "manual", 0.9, True, False, T, T), (0, 4, "manual", 1.0, True, False, T, T), (9, 0, "manual", 1.0, True, False, T, T)], "media_id long, tag_id long, source string, confidence double, is_locked boolean, is_suggestion boolean, created_at timestamp, updated_at timestamp"),
        "source_metadata_records": spark.createDataFrame([(1, 4)], "id long, media_id long"),
        "source_assertions": spark.createDataFrame([(1, 1, "Felix", "Felix", "felix", "searchable_active")], "id long, source_metadata_record_id long, raw_input string, normalized_input string, canonical_name_key string, status string"),
        "signals": spark.createDataFrame([], "id long, origin_type string, normalized_key string, status string, media_id long"),
        "signal_links": spark.createDataFrame([], "signal_id long, concept_id long, link_status string, negative_reason_code string"),
        "concepts": spark.createDataFrame([], "id long, primary_display_name string, concept_key string, status string"),
        "region": spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string"),
        "nation": spark.createDataFrame([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": spark.createDataFrame([(0, "C", 0)], "c_custkey long, c_name string, c_nationkey int"),
        "orders": spark.createDataFrame([(0, 0), (2, 0)], "o_orderkey long, o_custkey long"),
    }
    lib = Library(spark, "/none", given)
    none = spark.createDataFrame([], "canonical_name string, language string, display_name string, alias string, category string, source string, status string, needs_review boolean")
    lib.__dict__.update(tag_translations=none, tag_aliases=spark.createDataFrame([("kitty", 0)], "alias_name string, target_tag_id long"))
    return Engine(lib, datetime(2025, 1, 1, tzinfo=timezone.utc))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_trap_1_suggestions_count_in_strict_mode_only(engine):
    assert ids(engine.found("cat", "strict")) == [0, 1] and ids(engine.found("cat", "soft")) == [0]
    assert ids(engine.found("c?t", "strict")) == [0]


def test_trap_2_unknown_terms_and_source_names(engine):
    assert ids(engine.found("nobody", "strict")) == [] and ids(engine.found("felix", "soft")) == [4]
    assert ids(engine.found("-nobody", "strict")) == [0, 1, 2, 3, 4] and ids(engine.found("-felix", "soft")) == [0, 1, 2, 3]


def test_trap_4_colon_names_need_quotes(engine):
    assert ids(engine.found('"re:zero"', "strict")) == [3] and len(ids(engine.found("re:zero", "strict"))) == 5


def test_brackets_and_aliases(engine):
    assert ids(engine.found("hat", "soft")) == [2] and ids(engine.found("hat_(*", "strict")) == [2]
    assert ids(Engine(engine.lib, engine.now, {"kitty": "cat"}).found("kitty", "strict")) == [0, 1]


def test_pages_and_sorts(engine):
    page = engine.search("order:filesize", page=2, limit=2)
    assert (page.total, page.pages) == (5, 3) and [r["id"] for r in page.items.orderBy("position").collect()] == [2, 1]
    assert [r["id"] for r in engine.search("", sort="filename", limit=2).items.orderBy("position").collect()] == [0, 1]
    assert engine.search("", page=9, limit=2).items.count() == 0
    assert engine.media_list("safe").total == 3 and engine.media_list("nonsense").total == 0
    assert engine.count("rating:e") == 1 and ids(engine.random("", 7)) == ids(engine.random("", 7))


def test_media_and_albums(engine):
    detail = engine.media_detail(0).first()
    assert detail["children"] == [2, 3] and [t["name"] for t in detail["tags"]] == ["cat", "cat_box"]
    assert engine.media_detail(3).first()["siblings"] == [2] and ids(engine.media_batch([0, 3, 77])) == [0, 3]
    assert ids(engine.media_albums(2)) == [3000000] and ids(engine.albums(roots=True).items) == [1000000]
    assert ids(engine.album_contents(3000000, "rating:e").items) == [2] and ids(engine.album_children(1000000)) == [2000000]
    assert engine.album_parents(3000000).first()["path"] == [1000000, 2000000, 3000000]
    assert {r["tag_id"] for r in engine.album_tags(1000000).collect()} == {0, 1, 4}
    assert engine.pools(2).first()["media_ids"] == [0, 2]


def test_tags(engine):
    assert [r["name"] for r in engine.autocomplete("cat").collect()] == ["cat", "cat_box"] and [r["name"] for r in engine.autocomplete("kit").collect()] == ["cat"]
    assert [r["name"] for r in engine.tags(names=["cat_box", "cat"]).collect()] == ["cat_box", "cat"]
    assert [r["name"] for r in engine.tags("cat", hide_empty=True).collect()] == ["cat", "cat_box"]
    assert [r["name"] for r in engine.related(["cat"]).collect()] == ["cat_box"] and engine.related_tag("alice").count() == 0
    assert [r["name"] for r in engine.related_tag("cat").collect()] == ["cat", "cat_box"]
    assert engine.artists().count() == 1 and {"tag_string", "has_children"} <= set(engine.posts("rating:s").columns)


def test_l10_refresh():
    times = iter([0, 100, 400, 400])
    made = []
    r = Refreshed(lambda: made.append(1) or len(made), 300, lambda: next(times))
    assert [r.get(), r.get(), r.get()] == [1, 1, 2]

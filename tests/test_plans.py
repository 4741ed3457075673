"""What the plans of searches read: filters in the scan, one scan of media, no sort of a whole table, no shuffle of all edges."""

import re

from tagloom.library import Library, Prepared
from tagloom.plans import search as S, search_language as L
from tagloom.plans.search_queries import NOW, _FLAGSHIP

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    df._jdf.queryExecution().executedPlan()
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_reach_the_scan_of_media(spark):
    text = plan(S.select(Library(spark, SF), L.parse("rating:s filesize:50kb.. -filetype:png"), NOW).select("id"))
    assert "SortAggregate" not in text and "Exchange" not in text
    pushed = re.search(r"PushedFilters: \[(.*)\]", text)[1]
    assert "EqualTo(rating,safe)" in pushed and "GreaterThanOrEqual(file_size,51200)" in pushed
    assert re.search(r"ReadSchema: struct<(.*)>", text)[1].count(":") == 4  # id, filename, file_size, rating


def test_flagship_reads_media_once(spark):
    lib = Library(spark, SF)
    hits = S.page(S.select(lib, L.parse(_FLAGSHIP), NOW), S.order(L.parse(_FLAGSHIP)), 50)
    text = plan(hits)
    assert "SortAggregate" not in text and text.count("content_class:string") == 1
    text = plan(S.posts_page(hits, lib))
    assert "SortAggregate" not in text and "content_class:string" not in text  # of media only parent_id, of edges only those of the page
    assert "In(media_id" in text or "EqualTo(media_id" in text


def test_named_tags_read_only_their_edges(spark):
    lib = Library(spark, SF)
    text = plan(S.with_all_tags(lib.media.select("id"), lib, ["lantern_set", "harbor_lantern"]))
    assert "SortAggregate" not in text and re.search(r"PushedFilters: \[[^\]]*In\(tag_id", text)


def test_cleaned_tables_follow_their_files(spark, tmp_path):
    import shutil

    shutil.copy(f"{SF}/media.parquet", tmp_path / "media.parquet")
    first = Library(spark, str(tmp_path)).media
    assert first.count() == Library(spark, SF).media.count()
    path = Prepared.of(spark, str(tmp_path)).done["media"][1]._scratch_path
    assert Library(spark, str(tmp_path)).media.count() and Prepared.of(spark, str(tmp_path)).done["media"][1]._scratch_path == path
    raw = spark.read.parquet(f"{SF}/media.parquet").filter("id <= 10")
    raw.write.mode("overwrite").parquet(str(tmp_path / "other"))
    shutil.os.remove(tmp_path / "media.parquet")
    shutil.move(str(tmp_path / "other"), str(tmp_path / "media.parquet"))
    assert Library(spark, str(tmp_path)).media.count() == raw.select("id").distinct().count()

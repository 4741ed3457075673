"""Files in and out (A): tag CSV, logical dumps, directory scans, dictionaries, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import _path, drop_table

from tagloom.library import Library

# Category codes of tag files, admissible file types.
CODES = {0: "general", 1: "artist", 3: "copyright", 4: "character", 5: "meta"}
EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "webm", "mp4")
MAX_BYTES = 512 * 1024**2
_CSV = "name string, code string, count string, aliases string"


def read_tag_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=_CSV, header=False, mode="PERMISSIVE", escape='"')


def import_tags(rows: DataFrame, tags: DataFrame, aliases: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tags to insert, tags to update, aliases to insert) of rows (name, code, count, aliases).

    Names are trimmed and lower-cased; rows without a second column, or over 255 characters, are left out, strict ones also without all
    four; a code that is no number is an error, an unknown one is 'general'. The first row of a name counts, the first alias row wins, aliases equal to their tag or to any tag are dropped.
    """
    clean = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("name", F.lower(F.trim("name"))).filter("name <> '' and length(name) <= 255 and code is not null")
    if strict:
        clean = clean.filter("`count` is not null and aliases is not null")
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])[F.trim("code").cast("int")], F.lit("general"))
    one = clean.groupBy("name").agg(F.min(F.struct("at", kind.alias("category"), F.coalesce("aliases", F.lit("")).alias("aliases"))).alias("r")).select("name", "r.at", "r.category", "r.aliases")
    joined = one.join(tags.select("name", F.col("category").alias("old"), F.lit(True).alias("had")), "name", "left")
    insert = joined.filter("had is null").select("name", "category")
    update = joined.filter("had and not (old <=> category)").select("name", "category")
    listed = one.select("name", "at", F.posexplode(F.split("aliases", ",")).alias("p", "alias")).withColumn("alias", F.lower(F.trim("alias"))).filter("alias <> '' and alias <> name")
    first = listed.groupBy("alias").agg(F.min_by("name", F.struct("at", "p")).alias("target"))
    taken = tags.select(F.col("name").alias("alias")).union(one.select("name")).union(aliases.select("alias_name"))
    return insert, update, first.join(taken.toDF("alias"), "alias", "left_anti").select(F.col("alias").alias("alias_name"), "target")


def export_tags(lib: Library) -> DataFrame:
    """One CSV line per tag: name, category code, count, aliases (quoted where there are several)."""
    names = lib.tag_aliases.groupBy(F.col("target_tag_id").alias("id")).agg(F.sort_array(F.collect_list("alias_name")).alias("a"))
    code = F.coalesce(F.create_map(*[F.lit(x) for k, v in CODES.items() for x in (v, k)])[F.col("category")], F.lit(0)).cast("string")
    listed = F.when(F.size("a") > 1, F.concat(F.lit('"'), F.array_join("a", ","), F.lit('"'))).otherwise(F.coalesce(F.array_join("a", ","), F.lit("")))
    return lib.tags.join(names, "id", "left").select("id", F.concat_ws(",", "name", code, F.col("post_count").cast("string"), listed).alias("line"))


def dump_tags(lib: Library) -> DataFrame:
    """Version 1 of the logical dump: a JSON object per tag with its aliases by name."""
    names = lib.tag_aliases.groupBy(F.col("target_tag_id").alias("id")).agg(F.sort_array(F.collect_list("alias_name")).alias("aliases"))
    whole = lib.tags.join(names, "id", "left").select("id", F.struct("name", F.coalesce("category", F.lit("general")).alias("category"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")).alias("tag"))
    return whole.select("id", F.to_json("tag").alias("json"))


def restore_tags(dump: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags of a dump (json) that the store lacks by name."""
    rows = dump.select(F.from_json("json", "name string, category string, aliases array<string>").alias("t")).select("t.name", "t.category")
    return rows.filter("name is not null").join(tags.select("name"), "name", "left_anti").distinct()


def restore_albums(albums: DataFrame, links: DataFrame, edges: DataFrame, target: DataFrame, media: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(albums to create, media links, hierarchy) by name and hash: albums (name), links (name, hash), edges (parent, child) of a dump into target albums (id, name) and media (id, hash); loops and repeats go."""
    create = albums.select("name").distinct().join(target.select("name"), "name", "left_anti")
    known = links.join(media.select("hash", F.col("id").alias("media_id")), "hash").select("name", "media_id").distinct()
    tree = edges.filter("parent <> child").select("parent", "child").distinct()
    return create, known, tree


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder: path, size, time; contents are never read. Spark itself leaves out empty files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")


def admissible(files: DataFrame) -> DataFrame:
    """Adds the first reason against a file, null if it may be imported; is_link and is_file count where the listing has them."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    ext = F.regexp_extract(name, r"\.([^.]+)$", 1)
    reason = F.when(F.startswith(name, F.lit(".")), "hidden").when(F.endswith(name, F.lit(".icloud")), "cloud_placeholder")
    if "is_link" in files.columns:
        reason = reason.when(F.col("is_link"), "symlink")
    if "is_file" in files.columns:
        reason = reason.when(~F.col("is_file"), "not_a_file")
    reason = reason.when(~ext.isin(*EXTENSIONS), "unsupported_extension").when(F.col("length").isNull(), "stat_error").when(F.col("length") == 0, "zero_byte_file").when(F.col("length") > MAX_BYTES, "too_large")
    return files.withColumn("reason", reason)


def preflight(files: DataFrame) -> DataFrame:
    """(n_files, n_admissible, n_bytes) of a listing; no file is read."""
    ok = F.col("reason").isNull()
    return admissible(files).agg(F.count("*").alias("n_files"), F.count_if(ok).alias("n_admissible"), F.coalesce(F.sum(F.when(ok, F.col("length"))), F.lit(0)).cast("bigint").alias("n_bytes"))


def untracked(files: DataFrame, media: DataFrame, file_hash: str | None = None) -> DataFrame:
    """Admissible files whose path and name no medium has, nor their hash, where there is one; hashes, the costly test, come last."""
    named = files.filter("reason is null").withColumn("filename", F.element_at(F.split("path", "/"), -1))
    left = named.join(media.select("path"), "path", "left_anti").join(media.select("filename"), "filename", "left_anti")
    return left.join(media.select(F.col("hash").alias(file_hash)), file_hash, "left_anti") if file_hash else left


def provider_pages(records: DataFrame) -> DataFrame:
    """One row per work and page of provider records (work, page, title, artist), with whether repeated records disagree."""
    g = records.groupBy("work", "page").agg(F.count("*").alias("n"), F.count_distinct(F.struct("title", "artist")).alias("versions"), F.min(F.struct("title", "artist")).alias("r"))
    return g.select("work", "page", "n", (F.col("versions") > 1).alias("conflict"), "r.title", "r.artist")


def reverse_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(text, name) of a JSON-lines dictionary (name, text), lower-cased; the first name of a text counts."""
    rows = spark.read.schema("name string, text string").json(path)
    return rows.filter("text is not null").groupBy(F.lower("text").alias("text")).agg(F.min("name").alias("name"))


def second_store(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of another database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_report(df: DataFrame, path: str, kind: str) -> DataFrame:
    """Writes a report as csv, json or parquet and gives its rows and checksum, which don't depend on row order."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)
    return checksum(df)


def checksum(df: DataFrame) -> DataFrame:
    one = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(one), F.lit(0)).cast("string").alias("checksum"))


class Cached:
    """Results kept as tables under their name and the version of their sources, so a changed source never serves an old result.

    A result is made again after ``seconds``; ``invalidate`` drops all whose name starts with a prefix. Only a result that isn't there or is too old is made, an
    unreadable one is an error.
    """

    def __init__(self, spark: SparkSession, folder: str, seconds: float = 3600, clock=None):
        import time

        self.spark, self.folder, self.seconds, self.clock = spark, folder.rstrip("/"), seconds, clock or time.time

    def _names(self) -> list[str]:
        fs, path = _path(self.spark, self.folder)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def get(self, name: str, version: str, make) -> DataFrame:
        import hashlib
        from urllib.parse import quote

        path = f"{self.folder}/{quote(name, safe='')}/{hashlib.md5(version.encode()).hexdigest()}"
        fs, done = _path(self.spark, f"{path}/_SUCCESS")
        if not fs.exists(done) or self.clock() - fs.getFileStatus(done).getModificationTime() / 1000 >= self.seconds:
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def invalidate(self, prefix: str = "") -> int:
        """Drops the results of names with a prefix; how many names there were."""
        from urllib.parse import unquote

        gone = [n for n in self._names() if unquote(n).startswith(prefix)]
        drop_table(self.spark, *(f"{self.folder}/{n}" for n in gone))
        return len(gone)


def image_size(files: DataFrame) -> DataFrame:
    """(path, kind, width, height) of PNG, GIF and JPEG files from their first bytes; null for other or broken ones. files: (path, content)."""
    import struct

    import pandas as pd

    def measure(data: bytes | None) -> tuple[str | None, int | None, int | None]:
        if not data:
            return None, None, None
        if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
            return ("png", *struct.unpack(">II", data[16:24]))
        if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
            return ("gif", *struct.unpack("<HH", data[6:10]))
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data) and data[at] == 0xFF:
                mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                    return "jpeg", width, height
                at += 2 + size
        return None, None, None

    def batches(frames):
        for frame in frames:
            found = [measure(c) for c in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "kind": [f[0] for f in found], "width": pd.array([f[1] for f in found], "Int32"), "height": pd.array([f[2] for f in found], "Int32")})

    return files.select("path", "content").mapInPandas(batches, "path string, kind string, width int, height int")

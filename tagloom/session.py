"""Session helpers: shared scratch tables, the cut of long lineages and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in rows, that a caller of :func:`small_enough` may broadcast unless it states another bound.
BROADCAST_ROWS = 200_000


def local_session(cores: str = "8", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tagloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local session without that setting (tests, benches) gets a temporary folder; a cluster session
    without it is an error, since a machine-local folder would lose data with its machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.TemporaryDirectory(prefix="tagloom-")
        atexit.register(folder.cleanup)
        found = f"file://{folder.name}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, name: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def table_state(spark: SparkSession, name: str) -> tuple[str, int]:
    """A mark that changes when the files of a table do, and their bytes; two calls however many files there are."""
    fs, path = _path(spark, name)
    total = fs.getContentSummary(path)
    return f"{total.getLength()}-{total.getFileCount()}-{fs.getFileStatus(path).getModificationTime()}", total.getLength()


def subfolders(spark: SparkSession, name: str) -> dict[str, int]:
    """Folders in a folder (the partitions of a written table) with their bytes."""
    fs, path = _path(spark, name)
    return {f.getPath().getName(): fs.getContentSummary(f.getPath()).getLength() for f in fs.listStatus(path) if f.isDirectory()}


def drop_table(spark: SparkSession, *paths: str) -> None:
    """Deletes written scratch tables."""
    for name in paths:
        fs, path = _path(spark, name)
        fs.delete(path, True)


class Scratch:
    """Tables written into the shared folder to cut lineage; they survive the loss of executors.

    ``put`` writes a frame and returns it read back; ``drop`` deletes tables that later rounds no longer
    need. What is left (a lazily returned result still reads it) goes when the process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        atexit.register(self._end)

    def _end(self) -> None:
        try:
            drop_table(self.spark, self.root)
        except Exception:  # the session is gone; the folder belongs to the cluster's own clean-up
            pass

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> str:
        self.count += 1
        path = f"{self.root}/{self.count:04d}"
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return path

    def read(self, path: str | list[str], like: DataFrame) -> DataFrame:
        """One scan over one or more written tables of the same columns."""
        return self.spark.read.schema(like.schema).parquet(*([path] if isinstance(path, str) else path))

    def put(self, df: DataFrame) -> DataFrame:
        out = self.read(path := self.write(df), df)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            if df is not None and (path := getattr(df, "_scratch_path", None)):
                drop_table(self.spark, path)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a frame has at most so many rows; reads no more than one row beyond the bound."""
    return df.limit(rows + 1).count() <= rows


def salted_join(big: DataFrame, unique: DataFrame, key: str | list[str], spread: str, how: str = "inner", hot_rows: int | None = 500_000, size_col: str = "n_rows") -> DataFrame:
    """Equi-join of a large, skewed frame with one that has each key once and that key's row count in ``size_col``.

    Keys with more than ``hot_rows`` rows are split into ceil(rows / hot_rows) salts; there are at most
    total / hot_rows of them, so their list is safely broadcast to choose the salts of the large side.
    Null keys never match; ``how='left'`` keeps their rows. ``hot_rows=None`` says that no key can be hot (the
    whole frame is smaller than the limit), which leaves a plain join.
    """
    keys = [key] if isinstance(key, str) else key
    if hot_rows is None:
        return big.join(unique.drop(size_col), keys, how)
    salts = F.ceil(F.col(size_col) / F.lit(hot_rows)).cast("int")
    hot = unique.filter(F.col(size_col) > hot_rows).select(*[F.col(k).alias(f"__hot_{i}") for i, k in enumerate(keys)], salts.alias("__salts"))
    same = [F.col(k) == F.col(f"__hot_{i}") for i, k in enumerate(keys)]
    left = big.join(F.broadcast(hot), same, "left").withColumn(
        "__salt", F.when(F.col("__salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("__salts")).cast("int"))
    ).drop("__salts", *[f"__hot_{i}" for i in range(len(keys))])
    right = unique.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).drop(size_col)
    return left.join(right, [*keys, "__salt"], how).drop("__salt")

"""Structured Streaming forms: event windows with watermarks, dedupe, and the stateful file sync.

Each takes a streaming frame and returns one; ``run_available`` drives a stream over what is there and hands back the rows,
with its checkpoint in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tagloom.session import Scratch


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet folder or file as a stream, with a given schema."""
    folder, _, name = path.rpartition("/")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks take no timestamps without a zone


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums per event type in tumbling or sliding windows; rows later than the watermark are dropped."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of a user that end after a gap without events."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; state is bounded by the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def file_states(observations: DataFrame) -> DataFrame:
    """new, changed or unchanged for each observation of a file (path_id, file_size, mtime), in order of time; the state per file is one size and time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, when = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values(["mtime", "event_id"])
        out = []
        for e, s, t in zip(rows["event_id"], rows["file_size"], rows["mtime"]):
            at = t.value // 1000
            out.append((key[0], e, "new" if size is None else "unchanged" if (s, at) == (size, when) else "changed"))
            size, when = int(s), int(at)
        state.update((size, when))
        yield pd.DataFrame(out, columns=["path_id", "event_id", "state"])

    return observations.groupBy("path_id").applyInPandasWithState(step, "path_id bigint, event_id bigint, state string", "size bigint, at bigint", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """All rows of a stream over the input that is there now; each micro-batch is written under its number, so a repeated one overwrites itself."""
    spark = stream.sparkSession
    scratch = Scratch(spark, label)
    written: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{scratch.root}/batch-{number:06d}"
        batch.write.mode("overwrite").parquet(path)
        if path not in written:
            written.append(path)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return scratch.read(written, stream) if written else spark.createDataFrame([], stream.schema)


class Refreshed:
    """A slowly changing table for the static side of a stream: made again after ``seconds``, else kept (L10)."""

    def __init__(self, make, seconds: float = 300, clock=None):
        import time

        self.make, self.seconds, self.clock = make, seconds, clock or time.monotonic
        self.made_at, self.value = None, None

    def get(self) -> DataFrame:
        if self.made_at is None or self.clock() - self.made_at >= self.seconds:
            self.value, self.made_at = self.make(), self.clock()
        return self.value

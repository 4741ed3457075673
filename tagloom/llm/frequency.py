"""Frequency of every distinct value: heavy-light aggregation.

Rows and records per term are exact. A frequent-items sketch over all rows names the heavy terms, at most ``MAX_HEAVY``; they are split off in the scan,
before anything is shuffled. Rows of heavy terms are added up in local arrays, and the records they occur in are kept in packed blocks: a block has the sorted
record ids of one slice of all ids, as differences, compressed, about a byte or two each. Only arrays and blocks travel; blocks of a slice meet in one task, which
counts what is distinct in them. The light rest is shuffled by term, once. "All rows" is a heavy term of its own, which gives the number of records. Which terms are called heavy
decides only where they are counted, not their counts.

Defined results: null is no term ('' is one); a row whose record is null counts as a row but as no record; repeated
(term, record) rows count as rows each and as one record; an empty input gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Heavy terms at most; bounds the broadcast list and the counter arrays.
MAX_HEAVY = 512
#: Counters of the frequent-items sketch; a term with more than about 1 / SKETCH of all rows can't escape it, and one with fewer isn't heavy.
SKETCH = 8192
#: Rows of heavy terms that a task holds before it packs them, and that a slice has at most, if ids are spread evenly.
HELD, SLICE_ROWS = 2_000_000, 4_000_000
_LOCAL = "slice int, rows array<bigint>, block binary"


def _distinct(at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sorted by term, then record, each pair once."""
    order = np.lexsort((ids, at))
    at, ids = at[order], ids[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (ids[1:] != ids[:-1])
    return at[new], ids[new]


def _pack(at: np.ndarray, ids: np.ndarray) -> bytes:
    """Sorted pairs as differences, whole numbers byte plane by byte plane, compressed."""
    if ids.dtype == np.int64:
        planes = np.diff(ids, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes()
    else:
        sink = pa.BufferOutputStream()
        batch = pa.record_batch([pa.array(ids.tolist(), pa.string())], ["id"])
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        planes = sink.getvalue().to_pybytes()
    raw = np.diff(at, prepend=0).astype(np.int16).tobytes() + planes
    return np.array([len(at), len(raw)], np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(block: bytes, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    n, size = np.frombuffer(block[:16], np.int64)
    raw = pa.decompress(block[16:], int(size), codec="zstd", asbytes=True)
    at = np.cumsum(np.frombuffer(raw[: 2 * n], np.int16), dtype=np.int64)
    if whole:
        return at, np.cumsum(np.ascontiguousarray(np.frombuffer(raw[2 * n :], np.uint8).reshape(8, -1).T).view(np.int64).ravel())
    with pa.ipc.open_stream(raw[2 * n :]) as reader:
        return at, np.array(reader.read_all().column(0).to_pylist(), object)


def _slice_of(ids: np.ndarray, slices: int) -> np.ndarray:
    """Slices of records; neighbouring whole numbers stay together, since their differences pack well."""
    if ids.dtype == np.int64:
        return (((ids >> 16).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % slices
    from pandas.util import hash_array

    return (hash_array(ids) >> np.uint64(1)).astype(np.int64) % slices


def _local(size: int, slices: int):
    """Counts the heavy rows of a partition and packs the records they name."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros(size, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        schema = pa.schema([("slice", pa.int32()), ("rows", pa.list_(pa.int64())), ("block", pa.binary())])

        def packed() -> pa.RecordBatch:
            at, ids = _distinct(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            to = _slice_of(ids, slices)
            order = np.argsort(to, kind="stable")
            at, ids, to = at[order], ids[order], to[order]
            bounds = np.flatnonzero(np.diff(to, prepend=-1, append=slices))
            blocks = [_pack(at[a:b], ids[a:b]) for a, b in zip(bounds, bounds[1:])]
            held.clear()
            return pa.record_batch([pa.array(to[bounds[:-1]], pa.int32()), pa.nulls(len(blocks), pa.list_(pa.int64())), pa.array(blocks, pa.binary())], schema=schema)

        for batch in batches:
            at, record = batch.column("heavy_at").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("record")
            rows += np.bincount(at, minlength=size)
            there = record.is_valid().to_numpy(zero_copy_only=False)
            ids = record.drop_null()
            held.append((at[there], ids.to_numpy() if pa.types.is_int64(ids.type) else np.array(ids.to_pylist(), object)))
            if sum(len(h[0]) for h in held) >= HELD:
                yield packed()
        if any(len(h[0]) for h in held):
            yield packed()
        if rows.any():
            yield pa.record_batch([pa.array([TaskContext.get().partitionId() % slices], pa.int32()), pa.array([rows.tolist()], pa.list_(pa.int64())), pa.array([None], pa.binary())], schema=schema)

    return count


def _merge(size: int, whole: bool):
    """Adds up the arrays of a slice and counts the distinct records in its blocks."""

    def merge(found: pa.Table) -> pa.Table:
        rows, records = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for counted in found.column("rows").drop_null().to_pylist():
            rows += counted
        blocks = [_unpack(b, whole) for b in found.column("block").drop_null().to_pylist()]
        if blocks:
            at, _ = _distinct(np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks]))
            records += np.bincount(at, minlength=size)
        return pa.table({"rows": pa.array([rows.tolist()], pa.list_(pa.int64())), "records": pa.array([records.tolist()], pa.list_(pa.int64()))})

    return merge


def all_counts(table: DataFrame, record: str, fields: list[str], max_heavy: int = MAX_HEAVY, sketch: int = SKETCH) -> DataFrame:
    """(field_name, term, n_rows, n_records) of every value of ``fields``, values as strings, as they stand; and one row without field and term for all rows."""
    spark = table.sparkSession
    whole = table.schema[record].dataType.typeName() in ("byte", "short", "integer", "long")
    source = table.select(F.col(record).cast("bigint" if whole else "string").alias("record"), *[F.col(f).cast("string").alias(f"term_{i}") for i, f in enumerate(fields)])
    pairs = [F.struct(F.lit(f).alias("field_name"), F.col(f"term_{i}").alias("term")) for i, f in enumerate(fields)]
    long = source.select("record", F.explode(F.array(*pairs)).alias("e")).select("record", "e.*").filter("term is not null")
    named = f"approx_top_k(concat_ws('\\u0001', field_name, term), {max_heavy}, {max(sketch, max_heavy)})"
    seen = long.agg(F.expr(named).alias("top"), F.count("*").alias("n")).first()
    heavy = [(i, *x["item"].split("\u0001", 1)) for i, x in enumerate(x for x in seen["top"] or [] if x["count"] * sketch >= seen["n"])]
    every = len(heavy)
    listed = F.broadcast(spark.createDataFrame(heavy, "heavy_at int, heavy_field string, heavy_term string"))
    same = (F.col("field_name") == F.col("heavy_field")) & (F.col("term") == F.col("heavy_term"))

    light = long.join(listed, same, "left_anti").repartition("field_name", "term")  # no term here has more than its share of rows
    light = light.groupBy("field_name", "term", "record").agg(F.count("*").alias("n"))
    light = light.groupBy("field_name", "term").agg(F.sum("n").alias("n_rows"), F.count("record").alias("n_records"))

    with_all = source.select("record", F.explode(F.array(*pairs, F.struct(F.lit(None).cast("string").alias("field_name"), F.lit(None).cast("string").alias("term")))).alias("e")).select("record", "e.*")
    marked = with_all.filter("field_name is null or term is not null").join(listed, same, "left").select(F.when(F.col("field_name").isNull(), every).otherwise(F.col("heavy_at")).alias("heavy_at"), "record")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    slices = max(min(spread, seen["n"] // 250_000 + 1), -(-seen["n"] // SLICE_ROWS))
    local = marked.filter("heavy_at is not null").mapInArrow(_local(every + 1, slices), _LOCAL)
    merged = local.groupBy("slice").applyInArrow(_merge(every + 1, whole), "rows array<bigint>, records array<bigint>")
    summed = merged.select(F.posexplode(F.arrays_zip("rows", "records")).alias("heavy_at", "c")).groupBy("heavy_at").agg(F.sum("c.rows").alias("n_rows"), F.sum("c.records").alias("n_records"))
    known = summed.join(listed, "heavy_at", "left")
    return light.unionByName(known.select(F.col("heavy_field").alias("field_name"), F.col("heavy_term").alias("term"), "n_rows", "n_records"))


def term_counts(table: DataFrame, record: str, fields: list[str], max_heavy: int = MAX_HEAVY, sketch: int = SKETCH) -> DataFrame:
    """(field_name, term, n_rows, n_records) of every value of ``fields``."""
    return all_counts(table, record, fields, max_heavy, sketch).filter("field_name is not null")


def marked_terms(counts: DataFrame, records: int, rare_below: int = 4, common_share: int = 20) -> DataFrame:
    """Adds mark: 'rare' below ``rare_below`` records, 'common' above 1/common_share of all ``records``, else null."""
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") * common_share > records, "common")
    return counts.withColumn("mark", mark)

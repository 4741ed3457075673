"""Filling fixed-capacity containers: cost-balanced packing.

Each item costs ``LINEAR * n + QUADRATIC * n * n`` (work linear in its tokens and attention quadratic in them). Items are dealt into groups of a bounded number
of items by a sorted round robin; in a group they are taken from the largest down and each goes to the sequence of lowest cost
among those with room for it; a new sequence is opened when none has room. A tree over the amounts of room finds that sequence in O(log capacity).

An item larger than the capacity is cut: its full pieces have a container each, its remainder is packed like an item. Defined results: items of
size 0 are packed too and take no room; a null size counts as 0; repeated items are packed as often as they
occur; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a group; bounds the memory of a task and costs at most part of one container a group.
GROUP_ITEMS = 20_000
LINEAR, QUADRATIC = 1.0, 1.0 / 4096


def assign(sizes: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[int]:
    """Container number of each size (0 to ``capacity``), by the rule above."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    leaves = 1 << capacity.bit_length()
    none = float("inf")
    tree = [none] * (2 * leaves)
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]  # by room left

    def set_leaf(room: int) -> None:
        at = leaves + room
        tree[at] = heaps[room][0][0] if heaps[room] else none
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            least = a if a <= b else b
            if tree[at] == least:
                break
            tree[at] = least
            at >>= 1

    opened = 0
    out = [0] * len(sizes)
    for i in order:
        size = sizes[i]
        at, best, where = leaves + size, none, -1
        if tree[at] < best:
            best, where = tree[at], at
        while at > 1:  # the nodes right of the path cover all rooms above size
            if not at & 1 and tree[at + 1] < best:
                best, where = tree[at + 1], at + 1
            at >>= 1
        if where < 0:
            cost, number, room = 0.0, opened, capacity
            opened += 1
        else:
            while where < leaves:
                where = 2 * where if tree[2 * where] == best else 2 * where + 1
            room = where - leaves
            cost, number = heapq.heappop(heaps[room])
            set_leaf(room)
        out[i] = number
        heapq.heappush(heaps[room - size], (cost + linear * size + quadratic * size * size, number))
        set_leaf(room - size)
    return out


def _pack_group(capacities: list[tuple[int, int]]):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        items = pd.concat(frames, ignore_index=True)
        base = TaskContext.get().partitionId() << 32
        for capacity_id, capacity in capacities:
            size = items["size"].to_numpy()
            whole, rest = size // capacity, size % capacity
            parts = items.assign(piece=whole, size=rest)[(rest > 0) | (size == 0)]
            number = assign(parts["size"].tolist(), capacity)
            full = items.loc[items.index.repeat(whole)]
            piece = full.groupby(level=0).cumcount()
            first = max(number, default=-1) + 1
            full = full.assign(piece=piece, size=capacity)
            done = pd.concat([parts.assign(container=number), full.assign(container=range(first, first + len(full)))])
            yield pd.DataFrame({"capacity_id": capacity_id, "item": done["item"], "piece": done["piece"].astype("int32"), "n_tokens": done["size"].astype("int32"), "container_id": done["container"] + base})

    return pack


def pack(items: DataFrame, item: str, size: str, capacities: list[tuple[int, int]], group_items: int = GROUP_ITEMS) -> DataFrame:
    """(capacity_id, item, piece, n_tokens, container_id) for each capacity (id, tokens); container ids are unique for one capacity."""
    if any(c <= 0 for _, c in capacities):
        raise ValueError("a capacity must be positive")
    chosen = items.select(F.col(item).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"))
    groups = max(1, -(-chosen.count() // group_items))
    kind = chosen.schema["item"].dataType.simpleString()
    packed = chosen.repartition(groups).mapInPandas(_pack_group(capacities), f"capacity_id int, item {kind}, piece int, n_tokens int, container_id bigint")
    return packed.withColumnRenamed("item", item)


def fill(packed: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """(capacity_id, n_containers, n_tokens, room, used) of each capacity; used is the filled share of all containers."""
    room = F.create_map(*[F.lit(x) for pair in capacities for x in pair])[F.col("capacity_id")]
    totals = packed.groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("capacity_id").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"))
    return totals.select("capacity_id", "n_containers", "n_tokens", (F.col("n_containers") * room).alias("room"), F.round(F.col("n_tokens") / (F.col("n_containers") * room), 6).alias("used"))

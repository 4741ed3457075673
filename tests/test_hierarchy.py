"""Tree contraction against a walk up every node."""

import random
from datetime import datetime, timedelta

import pytest

from tagloom.operators import hierarchy as H

SCHEMA = "id long, parent_id long, exported_at timestamp, node string, root long"
T0 = datetime(2024, 1, 1)


def walk(parents):
    """(root, depth, path) of each node with an existing parent."""
    out = {}
    for start in parents:
        if parents[start] not in parents:
            continue
        path, at = [start], parents[start]
        while at in parents and at not in path:
            path.append(at)
            at = parents[at]
        if at not in parents:
            out[start] = (path[-1], len(path) - 1, tuple(reversed(path)))
        else:
            circle = path[path.index(at) :]
            if at == start:
                out[start] = (min(circle), -1, (start,))
            else:
                out[start] = (min(circle), -2, tuple(reversed(path[: path.index(at) + 1])))
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, p, t, "x", 9) for i, p, t in rows], SCHEMA)
    found = H.hierarchy(df, version="exported_at", with_path=True, **kw)
    return {r["node"]: (r["root"], r["depth"], tuple(r["path"])) for r in found.collect()}


def as_rows(parents):
    return [(i, p, T0) for i, p in parents.items()]


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    n = 60
    parents = {i: rnd.choice([None, rnd.randint(1, n + 10), rnd.randint(1, n)]) for i in range(1, n + 1)}
    assert run(spark, as_rows(parents)) == walk(parents)


def test_long_chain_and_wide_star(spark):
    parents = {1: None, **{i: i - 1 for i in range(2, 150)}, **{i: 1 for i in range(200, 400)}}
    assert run(spark, as_rows(parents)) == walk(parents)


def test_hot_parent_is_salted(spark):
    parents = {1: None, **{i: 1 for i in range(2, 60)}, 100: 50}
    assert run(spark, as_rows(parents), hot_rows=10) == walk(parents)


def test_circles(spark):
    parents = {1: 1, 2: 3, 3: 2, 4: 3, 5: 4, 6: 7, 7: 8, 8: 6, 9: 1}
    assert run(spark, as_rows(parents)) == walk(parents)


def test_states_nulls_and_repeats(spark):
    rows = [(1, None, T0), (2, 9, T0), (2, 1, T0 + timedelta(days=1)), (2, 1, T0 + timedelta(days=1)), (3, 2, None), (None, 1, T0), (4, 77, T0)]
    assert run(spark, rows) == {2: (1, 1, (1, 2)), 3: (1, 2, (1, 2, 3))}


def test_empty(spark):
    assert run(spark, []) == {}


def test_tops_and_descendants(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 4)], "id long, parent_id long")
    paths = H.with_tops(H.hierarchy(df, with_path=True), df)
    assert {r["node"] for r in paths.collect()} == {1, 2, 3, 4}
    pairs = {tuple(r) for r in H.descendants(paths).collect()}
    assert pairs == {(1, 2, 1), (1, 3, 2), (2, 3, 1)}

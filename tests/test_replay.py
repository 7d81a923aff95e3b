"""Guarded replay against one push after another."""

import random

import pytest

from revledger.operators.replay import replay

PUSH = "application string, schemas_type string, revision_history_id long, expected_revision string, revision string, more int"


def one_by_one(pushes, stored):
    state, out = dict(stored), []
    for app, kind, no, expected, revision, more in sorted(pushes, key=lambda p: p[2]):
        ok = state.get((app, kind)) == expected
        if ok:
            state[app, kind] = revision
        out.append((app, kind, no, expected, revision, more, ok, state.get((app, kind))))
    return sorted(out, key=lambda r: r[2])


def run(spark, pushes, stored, **options):
    p = spark.createDataFrame(pushes, PUSH).repartition(5)
    s = spark.createDataFrame([(*k, v) for k, v in stored.items()],
                              "application string, schemas_type string, revision string")
    return sorted(map(tuple, replay(p, s, **options).collect()), key=lambda r: r[2])


def some_pushes(r, n, values):
    names = [None, "", *[f"r{i}" for i in range(values)]]
    keys = [("a", "x"), ("a", None), (None, None), ("b", "x"), ("hot", "x")]
    weights = [1, 1, 1, 1, 12]
    return [(*r.choices(keys, weights)[0], i, r.choice(names), r.choice(names), i % 3) for i in range(n)]


@pytest.mark.parametrize("chunk_rows,values", [(None, 3), (40, 1), (40, 30), (7, 3)])
def test_replay_equals_one_by_one(spark, chunk_rows, values):
    r = random.Random(values)
    pushes = some_pushes(r, 700, values)
    stored = {("a", "x"): "r0", ("hot", "x"): "r0", (None, None): "r1", ("unused", "x"): "r0"}
    assert run(spark, pushes, stored, chunk_rows=chunk_rows) == one_by_one(pushes, stored)


def test_a_long_chain_crosses_every_chunk(spark):
    """Every push expects the one before: all are accepted, one value each."""
    pushes = [("k", "x", i, f"r{i}" if i else None, f"r{i + 1}", 0) for i in range(1000)]
    got = run(spark, pushes, {}, chunk_rows=16)
    assert got == one_by_one(pushes, {}) and all(r[6] for r in got)


def test_chunks_that_nothing_enters(spark):
    pushes = [("k", "x", i, "never" if 20 <= i < 900 else "s", "s" if i < 950 else "t", 0) for i in range(1000)]
    assert run(spark, pushes, {("k", "x"): "s"}, chunk_rows=16) == one_by_one(pushes, {("k", "x"): "s"})


def test_empty(spark):
    assert run(spark, [], {("k", "x"): "s"}) == []

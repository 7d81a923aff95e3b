"""Upgrade loop pieces on literal rows: steps of a key, schema arrays,
settings clusters behind hops."""

import datetime

import pytest
from pyspark.sql import functions as F

from revledger.operators import graph, ledger, routing

ROW = "revision_history_id long, k string, datetime timestamp_ntz, revision string, comment string, schemas array<string>"
STEP = "k string, revision string, comment string, schemas array<string>, step int"
OLD = datetime.datetime(2024, 1, 1)


def test_steps_replace_one_another_in_one_pass(spark):
    current = spark.createDataFrame([(7, "a", OLD, "r0", "old", ["x"]), (9, "b", OLD, "r0", None, None)], ROW)
    rows = spark.createDataFrame([
        ("a", "r2", "done", [], 2), ("a", "r1", None, None, 1), ("c", "r5", "new", ["s", "t"], 1),
        ("d", "r1", None, None, 1), ("d", "r9", None, None, 1), ("d", "r2", None, None, 2)], STEP)
    now = datetime.datetime(2024, 3, 1, 23, 59, 1)
    new, appended, conflicts = ledger.replay_steps(current, current, rows, "step", ["k"], now)
    got = sorted(map(tuple, appended.select("revision_history_id", "k", "datetime", "revision", "comment", "schemas").collect()))
    assert got == [(10, "a", now, "r1", None, None), (11, "a", now, "r2", "done", []), (12, "c", now, "r5", "new", ["s", "t"])]
    assert sorted((r["k"], r["revision"], r["schemas"]) for r in new.collect()) == [
        ("a", "r2", []), ("b", "r0", None), ("c", "r5", ["s", "t"])]
    assert sorted(r["revision"] for r in conflicts.collect()) == ["r1", "r2", "r9"]


def test_push_gives_one_stamp_to_the_batch(spark):
    batch = spark.createDataFrame([(k, OLD, f"r{k}", None, None) for k in "abc"],
                                  "k string, datetime timestamp, revision string, comment string, schemas array<string>")
    empty = spark.createDataFrame([], ROW)
    now = datetime.datetime(2024, 5, 5, 5)
    new, appended, conflicts = ledger.push(empty, empty, batch, ["k"], now)
    assert {r["datetime"] for r in appended.collect()} == {now} and conflicts.count() == 0
    assert [r["revision_history_id"] for r in appended.orderBy("k").collect()] == [1, 2, 3]


def test_schema_arrays_equal_the_rows(spark, monkeypatch):
    monkeypatch.setattr(routing, "ARRAY_PART", 4)
    rows = [("t", "var", i, f"n{i % 7}") for i in range(50)] + [("u", "func", 3, "only")]
    df = spark.createDataFrame(rows, "schemas_type string, kind string, schema_key long, name string").repartition(7)
    got = {(r["schemas_type"], r["kind"]): r["schemas"] for r in routing.schema_arrays(df, limit=50).collect()}
    assert got == {("t", "var"): [f"n{i % 7}" for i in range(50)], ("u", "func"): ["only"]}
    for limit in (49, 3):
        with pytest.raises(Exception, match="schema list over"):
            routing.schema_arrays(df, limit=limit).collect()
    assert routing.schema_arrays(df.limit(0)).collect() == []


def test_hops_are_looked_up_in_every_settings_cluster(spark):
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "application int, from_rev int, to_rev int")
    starts = spark.createDataFrame([("h1", 1, 0, 2), ("h2", 2, 0, 2)], "host string, application int, from_rev int, target_rev int")
    entry = "application int, migration_id string, to_rev int, compatible array<int>"
    script = "application int, migration_id string, upgrade_type string, pos int, script string"
    entries = spark.createDataFrame([(1, "m1", 1, [0]), (1, "m2", 2, [1, 0])], entry)
    scripts = spark.createDataFrame([(1, "m1", "main", 1, "m1.sql"), (1, "m2", "other", 1, "m2.sql")], script)
    settings = spark.createDataFrame([(1, 1), (1, 2)], "application int, cluster_no long")
    s_entries = spark.createDataFrame(
        [(1, 1, "s1", 1, [0]), (1, 1, "s2", 2, [1]), (1, 2, "t1", 1, [0]), (1, 2, "t1b", 1, [0])],
        "application int, cluster_no int, migration_id string, to_rev int, compatible array<int>")
    s_scripts = spark.createDataFrame(
        [(1, 1, "s1", "main", 1, "s1.sql"), (1, 2, "s2", "main", 1, "wrong.sql")],
        "application int, cluster_no int, migration_id string, upgrade_type string, pos int, script string")
    ways = graph.find_ways(edges, starts)
    hops = graph.all_hop_scripts(ways, entries, scripts, settings, s_entries, s_scripts, F.lit("main"))
    got = sorted(map(tuple, hops.select("host", "hop_no", "cluster_no", "status", "migration_id", "script").collect()))
    assert got == [("h1", 1, 0, "ok", "m1", "m1.sql"), ("h1", 1, 1, "ok", "s1", "s1.sql"),
                   ("h1", 1, 2, "non_unique", None, None), ("h1", 2, 0, "ok", "m2", None),
                   ("h1", 2, 1, "ok", "s2", None), ("h1", 2, 2, "missing", None, None)]
    refused = graph.refusals(ways, hops).select("host", "reason").collect()
    assert sorted(map(tuple, refused)) == [("h1", "non_unique"), ("h2", "no_way")]


def _fleet(spark, n_schemas=3):
    """Views of two applications with a way of two hops, one lacking an entry."""
    frame = spark.createDataFrame
    entry = "application long, migration_id string, to_rev long, compatible array<long>"
    cluster = entry.replace("application long", "application long, cluster_no int")
    return {
        "fx_edges": frame([(a, f, f + 1) for a in (1, 2) for f in (1, 2)], "application long, from_rev long, to_rev long"),
        "fx_fleet": frame([("h1", 1, "7", "main", 1, 3), ("h2", 2, "7", "main", 1, 3)],
                          "host_id string, application long, group_type string, upgrade_type string, from_rev long, target_rev long"),
        "fx_migration_entries": frame([(1, "a2", 2, [1]), (1, "a3", 3, [2]), (2, "a2", 2, [1])], entry),
        "fx_settings_list": frame([(1, 1)], "application long, cluster_no int"),
        "fx_settings_entries": frame([(1, 1, "s2", 2, [1]), (1, 1, "s3", 3, [2])], cluster),
        "fx_schemas": frame([(i, "7", f"s{i}", "var") for i in range(n_schemas)],
                            "schema_key long, schemas_type string, name string, kind string"),
        "fx_fleet_history": spark.sql(
            "select 5L as revision_history_id, 'h1' as host_id, '7' as schemas_type, kind, timestamp_ntz'2024-01-02' as datetime,"
            " 1L as revision, 'installed' as comment, array('old') as schemas from values ('var'), ('func') as t(kind)"),
    }


def test_refusals_meet_no_script(spark):
    from revledger.plans import catalog
    from revledger.plans.registry import REGISTRY

    catalog.load()
    out = REGISTRY["upgrade_refusals"].build(_fleet(spark)).collect()  # no view of scripts is there
    assert [(r["host_id"], r["reason"]) for r in out] == [("h2", "missing")]


def test_no_step_of_an_upgrade_carries_schema_lists(spark, monkeypatch):
    from revledger.operators import ledger
    from revledger.plans import catalog
    from revledger.plans.registry import REGISTRY

    catalog.load()
    seen, real = [], ledger.replay_steps
    monkeypatch.setattr(ledger, "replay_steps", lambda c, h, rows, *a: seen.append(rows) or real(c, h, rows, *a))
    out = REGISTRY["ledger_upgrade"].build(_fleet(spark)).collect()
    assert seen[0].filter("schemas is not null").isEmpty()
    got = sorted((r["part"], r["kind"], r["revision"], r["comment"], r["schemas"], r["n_schemas"]) for r in out if r["comment"])
    assert got == [("current", "func", 3, "upgraded", "", 0), ("current", "var", 3, "upgraded", "s0,s1,s2", 3),
                   ("history", "func", 3, "upgraded", "", 0), ("history", "var", 3, "upgraded", "s0,s1,s2", 3)]
    assert [(r["revision"], r["schemas"], r["n_schemas"]) for r in out if r["comment"] is None] == [(2, None, None)]

"""Small literal inputs for the semantic traps of the ledger tool."""

import datetime

import pytest
from pyspark.sql import functions as F

from revledger.functions.lists import as_list
from revledger.operators import checks, drops, grants, graph, ledger, routing, scripts
from revledger.operators.sequence import assign_ids, number_rows, previous_in_group

T0 = datetime.datetime(2024, 1, 1)
LEDGER = ("revision_history_id long, application string, schemas_type string, "
          "datetime timestamp_ntz, revision string, comment string")


def _key(t):
    return tuple((x is None, str(x)) for x in t)


def srt(xs):
    return sorted(xs, key=_key)


def rows(df, *cols):
    return srt(tuple(r[c] for c in cols) for r in df.collect())


def test_guard_missing_row_equals_expected_null(spark):  # N7, F9
    current = spark.createDataFrame([(1, "a", "t", T0, "r1", None)], LEDGER)
    expected = spark.createDataFrame(
        [("a", "t", "r1"), ("a", "t2", None), ("b", "t", "r9"), ("a", "t", "r2")],
        "application string, schemas_type string, revision string")
    bad = ledger.guard(current, expected)
    assert rows(bad, "application", "schemas_type", "expected_revision", "stored_revision") == [
        ("a", "t", "r2", "r1"), ("b", "t", "r9", None)]


def test_push_conflicts_and_ids(spark):  # N2, T1, T5
    current = spark.createDataFrame([(5, "a", "t", T0, "r1", None)], LEDGER)
    history = spark.createDataFrame([(5, "a", "t", T0, "r1", None)], LEDGER)
    batch = spark.createDataFrame(
        [(0, "a", "t", T0, "r2", "x"), (0, "b", "t", T0, "r1", None), (0, "c", "t", T0, "r3", None),
         (0, "c", "t", T0, "r4", None)], LEDGER)
    new_current, appended, conflicts = ledger.push(current, history, batch)
    assert rows(appended, "revision_history_id", "application") == [(6, "b")]
    assert rows(conflicts, "application", "revision") == [("a", "r2"), ("c", "r3"), ("c", "r4")]
    assert rows(new_current, "application", "revision") == [("a", "r1"), ("b", "r1")]


def test_clean_keeps_history_and_replace(spark):  # N3, T2
    current = spark.createDataFrame([(1, "a", "t", T0, "r1", None), (2, "b", "t", T0, "r1", None)],
                                    LEDGER)
    history = current
    batch = spark.createDataFrame([(0, "a", "t", T0, "r2", "c")], LEDGER)
    assert rows(ledger.clean(current, batch), "application") == [("b",)]
    new_current, appended, conflicts = ledger.replace(current, history, batch)
    assert rows(new_current, "application", "revision", "revision_history_id") == [
        ("a", "r2", 3), ("b", "r1", 2)]
    assert conflicts.count() == 0
    # the latest history row per key equals the current row after a replace
    full = history.unionByName(appended)
    assert rows(ledger.latest(full), "application", "revision") == rows(new_current, "application",
                                                                           "revision")


def test_latest_ignores_tied_timestamps(spark):  # N1
    h = spark.createDataFrame([(i, "a", "t", T0, f"r{i}", None) for i in (3, 1, 2)], LEDGER)
    assert rows(ledger.latest(h), "revision") == [("r3",)]


def test_drift_null_safe(spark):  # N25, J7
    var = spark.createDataFrame([(1, "a", "t", T0, "r1", None), (2, "b", "t", T0, "r1", "x")], LEDGER)
    func = spark.createDataFrame([(3, "a", "t", T0, "r1", None), (4, "b", "t", T0, "r1", "y")], LEDGER)
    out = rows(ledger.drift(var, func), "application", "kind", "comment")
    assert out == [("a", "both", None), ("b", "func", "y"), ("b", "var", "x")]


def test_transitions_order_by_id(spark):  # W3
    h = spark.createDataFrame([(i, "a", "t", T0, f"r{i}", None) for i in (5, 1, 9)], LEDGER)
    out = rows(ledger.transitions(h), "revision_history_id", "from_revision", "to_revision")
    assert out == [(1, None, "r1"), (5, "r1", "r5"), (9, "r5", "r9")]


@pytest.mark.parametrize("limit", [1000, 10_000_000])
def test_numbering_spreads_a_hot_group(spark, limit):  # T5, W2
    df = spark.range(0, 5000).select(
        F.when(F.col("id") < 4000, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 7)
                                                                    .cast("string"))).alias("g"),
        (F.col("id") * 7919 % 5000).alias("o"))
    n = number_rows(df, ["g"], ["o"], "n", group_row_limit=limit)
    bad = n.groupBy("g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"),
                             F.count("*").alias("c"), F.countDistinct("n").alias("d"))
    for r in bad.collect():
        assert r["lo"] == 1 and r["hi"] == r["c"] == r["d"]
    ordered = n.filter("g = 'hot'").orderBy("n").select("o").collect()
    assert [r["o"] for r in ordered] == sorted(r["o"] for r in ordered)
    ids = assign_ids(df, ["g", "o"], "id", 100)
    assert ids.agg(F.min("id"), F.max("id"), F.countDistinct("id")).first()[:] == (100, 5099, 5000)


@pytest.mark.parametrize("limit", [1, 1000])
def test_previous_in_group_nulls_in_key(spark, limit):
    df = spark.createDataFrame([(None, 1, "x"), (None, 2, "y"), ("a", 1, "z")],
                               "k string, o long, v string")
    out = rows(previous_in_group(df, ["k"], ["o"], ["v"], group_row_limit=limit), "k", "o", "prev_v")
    assert out == srt([(None, 1, None), (None, 2, "x"), ("a", 1, None)])


EDGES = "application string, from_rev string, to_rev string"
STARTS = "application string, from_rev string, target_rev string"


@pytest.mark.parametrize("limit", [0, 1000])
def test_ways_statuses_and_cycles(spark, limit):  # N6, N8, N9, N11, G1, G2
    edges = spark.createDataFrame([
        ("a", "1", "2"), ("a", "2", "3"), ("a", "1", "3"), ("a", "3", "4"), ("a", "2", "4"),
        ("a", "4", "2"), ("a", "x", "x"), ("a", "0", "1"),
        ("b", "p", "q"), ("b", "q", "p"),
    ], EDGES)
    starts = spark.createDataFrame([
        ("a", "4", "4"), ("a", "3", "4"), ("a", "1", "4"), ("a", "0", "4"), ("a", "x", "4"),
        ("a", None, "4"), ("b", "p", "z"), ("c", "1", "1"),
    ], STARTS)
    w = graph.find_ways(edges, starts, group_edge_limit=limit)
    got = {(r["application"], r["from_rev"]): (r["status"], r["length"], r["n_paths"],
                                               None if r["way"] is None else
                                               [(h["to_rev"], h["from_rev"]) for h in r["way"]])
           for r in w.collect()}
    assert got[("a", "4")] == ("at_target", 0, 1, [])
    assert got[("a", "3")] == ("unique", 1, 1, [("4", "3")])
    assert got[("a", "1")] == ("ambiguous", 2, 2, None)
    assert got[("a", "0")] == ("ambiguous", 3, 2, None)
    assert got[("a", "x")][0] == "no_way"
    assert got[("a", None)][0] == "no_way"
    assert got[("b", "p")][0] == "no_way"
    assert got[("c", "1")][:2] == ("at_target", 0)


@pytest.mark.parametrize("limit", [0, 1000])
def test_unique_way_is_oldest_hop_first(spark, limit):
    edges = spark.createDataFrame([("a", "1", "2"), ("a", "2", "3"), ("a", "3", "4")], EDGES)
    starts = spark.createDataFrame([("a", "1", "4")], STARTS)
    w = graph.find_ways(edges, starts, group_edge_limit=limit).first()
    assert [(h["to_rev"], h["from_rev"]) for h in w["way"]] == [("2", "1"), ("3", "2"), ("4", "3")]
    hops = graph.expand_hops(graph.find_ways(edges, starts, group_edge_limit=limit),
                             F.lit("done"))
    assert rows(hops, "kind", "hop_no", "revision", "comment", "is_final") == [
        ("func", 1, "4", "done", True), ("var", 1, "2", None, False),
        ("var", 2, "3", None, False), ("var", 3, "4", "done", True)]
    with_s = graph.expand_hops(graph.find_ways(edges, starts, group_edge_limit=limit),
                               F.lit("done"), kinds=("var",), final_schemas=F.array(F.lit("s1")))
    assert [r["schemas"] for r in with_s.orderBy("hop_no").collect()] == [None, None, ["s1"]]


def test_level_loop_equals_grouped_search(spark):
    from revledger.plans.fixtures import Fixtures
    from tests.conftest import SMALL
    fx = Fixtures(spark, SMALL)
    cols = ["application", "from_rev", "status", "length", "n_paths", "way"]
    a = graph.find_ways(fx["fx_edges"], fx["fx_starts"]).select(*cols)
    b = graph.find_ways(fx["fx_edges"], fx["fx_starts"], group_edge_limit=0).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_hop_scripts_statuses(spark):  # N22, J4
    edges = spark.createDataFrame([("a", "1", "2"), ("a", "2", "3")], EDGES)
    starts = spark.createDataFrame([("a", "1", "3")], STARTS)
    ways = graph.find_ways(edges, starts)
    entries = spark.createDataFrame(
        [("a", "m1", "3", ["2"]), ("a", "m2", "3", ["2", "9"])],
        "application string, migration_id string, to_rev string, compatible array<string>")
    scripts_df = spark.createDataFrame([("a", "m1", "main", 1, "x.sql")],
                                       "application string, migration_id string, "
                                       "upgrade_type string, pos int, script string")
    out = graph.hop_scripts(ways, entries, scripts_df, F.lit("main"))
    assert rows(out, "hop_no", "status") == [(1, "missing"), (2, "non_unique")]


GRANT_DECL = "schema_key long, owner string, grants array<string>"
GRANT_OBS = "schema_key long, grantor string, grantee string, privilege string, is_grantable boolean"


def test_grant_audit_rules(spark):  # N12, N13, N14
    declared = spark.createDataFrame([(1, "o", ["o", "u"]), (2, "o", None)], GRANT_DECL)
    observed = spark.createDataFrame([
        (1, "o", "o", "CREATE", False), (1, "o", "o", "USAGE", False), (1, "o", "u", "USAGE", False),
        (1, "x", "u", "USAGE", False), (1, "o", "u", "USAGE", True), (1, "o", "u", "CREATE", False),
        (2, "o", "o", "USAGE", False),
    ], GRANT_OBS)
    a = grants.audit(observed, declared)
    assert a.count() == observed.count()
    assert rows(a.filter("status = 'unexpected'"), "grantor", "grantee", "privilege",
                "is_grantable") == [("o", "u", "CREATE", False), ("o", "u", "USAGE", True),
                                    ("x", "u", "USAGE", False)]
    assert {r["severity"] for r in grants.audit(observed, declared, weak=True)
            .filter("status = 'unexpected'").collect()} == {"notice"}
    assert rows(grants.missing(observed, declared), "schema_key", "privilege", "grantee") == [
        (2, "CREATE", "o")]


def test_null_acl_gives_owner_defaults(spark):  # N15
    acl = spark.createDataFrame(
        [(1, "o", None), (2, "o", [("o", "u", "USAGE", False)])],
        "schema_key long, owner string, "
        "acl array<struct<grantor:string,grantee:string,privilege:string,is_grantable:boolean>>")
    out = rows(grants.acl_rows(acl), "schema_key", "grantee", "privilege")
    assert out == [(1, "o", "CREATE"), (1, "o", "USAGE"), (2, "u", "USAGE")]


def test_role_names(spark):  # J10
    obs = spark.createDataFrame([(1, 0, 7), (1, 5, 99)], "schema_key long, grantor_oid long, "
                                                         "grantee_oid long")
    roles = spark.createDataFrame([(5, "alice"), (7, "bob"), (0, "nobody")], "oid long, rolname string")
    out = rows(grants.role_names(obs, roles), "grantor", "grantee")
    assert out == srt([("public", "bob"), ("alice", None)])


def test_drop_targets_union_distinct(spark):  # N16, N17, F4
    rec = spark.createDataFrame([("a", ["s1", "s2"]), ("b", None)], "application string, schemas array<string>")
    dec = spark.createDataFrame([("a", ["s2", "s3"]), ("b", [])], "application string, schemas array<string>")
    assert rows(drops.drop_targets(rec, dec, ["application"]), "application", "schema_name") == [
        ("a", "s1"), ("a", "s2"), ("a", "s3")]
    t = spark.createDataFrame([("v", "var", False), ("w", "var", True), ("f", "func", False)],
                              "schema_name string, kind string, cascade boolean")
    assert rows(drops.cascade_refusals(t), "schema_name") == [("v",)]


def test_drop_word_by_version(spark):  # J8
    t = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "s")], "application string, schema_name string")
    r = spark.createDataFrame([("s", "f", "")], "schema_name string, routine_name string, args string")
    v = spark.createDataFrame([("a", "PostgreSQL 10.4 on x"), ("b", "PostgreSQL 100.1"),
                               ("c", "PostgreSQL 8.4.1")], "application string, server_version string")
    out = rows(drops.drop_routines(t, r, v, ["application"]), "application", "drop_kind")
    assert out == [("a", "function"), ("b", "routine"), ("c", "function")]


def test_entry_kind_first_marker_wins(spark):  # N18, F6
    flags = spark.createDataFrame([("d1", True, True, True, True), ("d2", False, False, True, True),
                                   ("d3", None, False, False, False)],
                                  "dir string, has_init boolean, has_schema boolean, "
                                  "has_late boolean, has_safeguard boolean")
    assert rows(scripts.entry_kinds(flags), "dir", "kind") == [("d1", "init"), ("d2", "late"),
                                                              ("d3", None)]


def test_pins_match_in_every_dir(spark):  # N19, N20, O1
    files = spark.createDataFrame([
        ("g", "inc", 0, "b.sql"), ("g", "inc", 0, "a.sql"), ("g", "own", 1, "a.sql"),
        ("g", "own", 1, "c.sql"), ("g", "own", 1, "z.sql"),
    ], "grp string, dir string, dir_pos int, name string")
    pins = spark.createDataFrame([("g", "z.sql", "first", 1), ("g", "a.sql", "first", 2),
                                  ("g", "b.sql", "last", 1), ("g", "q.sql", "last", 2),
                                  ("g", "a.sql", "last", 3)],
                                 "grp string, name string, which string, pin_pos long")
    inline = spark.createDataFrame([("g", "<inline>", 9)], "grp string, name string, dir_pos int")
    o = scripts.pinned_order(files, pins, inline)
    assert [(r["dir"], r["name"]) for r in o.orderBy("seq").collect()] == [
        ("own", "z.sql"), ("inc", "a.sql"), ("own", "a.sql"), ("own", "c.sql"),
        (None, "<inline>"), ("inc", "b.sql")]
    assert rows(scripts.unused_pins(files, pins), "name", "reason") == [("a.sql", "shadowed"),
                                                                        ("q.sql", "not_found")]


def test_root_by_component(spark):  # N26, P5
    files = spark.createDataFrame([("src1/a.sql",), ("src10/a.sql",), ("src1",), ("x/y",)], "path string")
    roots = spark.createDataFrame([("src1/",), ("x/y",)], "root string")
    assert rows(scripts.outside_roots(files, roots), "path") == [("src10/a.sql",)]


def test_include_refs(spark):  # F3
    inc = spark.createDataFrame([("${a}/x",), ("$a_1/y",), ("$b",), ("a$a",), ("${a",), ("$a\nz",)],
                                "include string")
    refs = spark.createDataFrame([("a", "/r"), ("a_1", "/s")], "ref_name string, ref_value string")
    out = {r["include"]: (r["ref_name"], r["resolved"], r["status"])
           for r in scripts.resolve_refs(inc, refs).collect()}
    assert out["${a}/x"] == ("a", "/r/x", "resolved")
    assert out["$a_1/y"] == ("a_1", "/s/y", "resolved")
    assert out["$b"] == ("b", None, "undefined")
    assert out["a$a"] == (None, "a$a", "plain")
    assert out["${a"] == (None, "${a", "plain")
    assert out["$a\nz"] == ("a", "/r\nz", "resolved")


def test_as_list(spark):  # P7
    df = spark.createDataFrame([("x",), ('["a", "b"]',), (None,), (" [\"c\"]",)], "f string")
    out = [r["l"] for r in df.select(as_list("f").alias("l")).collect()]
    assert out == [["x"], ["a", "b"], None, ["c"]]


def test_pattern_split_lets_null_through(spark):  # P3
    df = spark.createDataFrame([("PRE-1",), ("pre-2",), ("r1",), (None,), ("xPRE-",)], "revision string")
    ok, bad = checks.split_by_pattern(df, "revision", "PRE-%")
    assert rows(bad, "revision") == [("PRE-1",), ("pre-2",)]
    assert ok.count() == 3


def test_inherited_type(spark):  # A4, P6
    child = spark.createDataFrame([(1, "p", None), (2, "p", "t"), (3, "p", "u"), (4, "q", "u")],
                                  "id long, parent string, type string")
    parent = spark.createDataFrame([("p", "t"), ("q", None)], "parent string, type string")
    assert rows(checks.inherited(child, parent, "parent", "parent"), "id") == [(3,)]
    eff = checks.inherit_type(child, parent, "parent", "parent")
    assert rows(eff, "id", "effective_type") == [(1, "t"), (2, "t"), (3, "u"), (4, "u")]


def test_route_salted_equals_broadcast(spark):  # J1
    hosts = spark.range(200).select(F.col("id").alias("host_id"),
                                    (F.col("id") % 3).cast("string").alias("host_type"))
    descr = spark.range(30).select(F.col("id").alias("k"),
                                   (F.col("id") % 3).cast("string").alias("schemas_type"))
    a = routing.route(hosts, descr).select("host_id", "k")
    b = routing.route(hosts, descr, force_salt=True).select("host_id", "k")
    assert a.count() == 2000 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_settings_compat_reasons(spark):  # J3
    src = spark.createDataFrame([(1, "a", "r1"), (2, "a", "r2"), (3, "b", "r1")],
                                "source_id long, application string, revision string")
    st = spark.createDataFrame([("a", ["r1"])], "application string, compatible array<string>")
    assert rows(routing.compat_violations(src, st), "source_id", "reason") == [
        (2, "revision"), (3, "application")]


def test_shared_document_at_most_one(spark):  # N21, J9
    hosts = spark.createDataFrame([(1, "h")], "host_id long, name string")
    two = spark.createDataFrame([("{}",), ("{}",)], "doc string")
    with pytest.raises(ValueError):
        routing.enrich_params(hosts, two)


def test_numbering_empty_input(spark):
    empty = spark.createDataFrame([], "g string, o long")
    assert assign_ids(empty, ["o"], "id", 1).count() == 0
    assert number_rows(empty, ["g"], ["o"], "n").count() == 0
    assert number_rows(empty, ["g"], ["o"], "n", group_row_limit=0).count() == 0


def test_size_check_bounds(spark):
    from revledger.operators.joins import bounded, maybe_broadcast
    df = spark.range(10)
    assert bounded(df, 9) is None and bounded(df, 10).count() == 10
    big = maybe_broadcast(df, 3)
    # over the bound: left for a regular join
    assert "ResolvedHint" not in big._jdf.queryExecution().analyzed().toString()
    assert big.count() == 10
    j = spark.range(100).join(maybe_broadcast(df, 50), "id")
    assert j.count() == 10


def test_operators_keep_column_order(spark):
    cur = spark.createDataFrame([(1, "a", "t", T0, "r1", None), (2, "b", "t", T0, "r1", None)], LEDGER)
    batch = spark.createDataFrame([(0, "a", "t", T0, "r2", "c")], LEDGER)
    assert ledger.clean(cur, batch).columns == cur.columns
    new_current, appended, conflicts = ledger.push(cur, cur, batch)
    assert new_current.columns == cur.columns and conflicts.columns == cur.columns[1:]
    new_current, _, _ = ledger.replace(cur, cur, batch)
    assert new_current.columns == cur.columns


def test_entry_kind_from_marker_files(spark):  # N18
    files = spark.createDataFrame([("d1", "late.yaml"), ("d1", "schema.yaml"), ("d2", "x.sql"),
                                   ("d3", "safeguard.yaml"), ("d3", "init.yaml")],
                                  "dir string, name string")
    out = rows(scripts.entry_kinds(scripts.marker_flags(files)), "dir", "kind")
    assert out == [("d1", "schema"), ("d2", None), ("d3", "init")]


def test_hosts_list_with_shared_entry(spark):  # N21, J9
    entries = spark.createDataFrame(
        [("h1", None, '{"p": 1}', None), ("h2", "t", None, None), (None, None, None, '{"s": 2}')],
        "name string, type string, params string, shared string")
    hosts, shared = routing.split_hosts(entries)
    out = routing.enrich_params(routing.host_types(hosts), shared)
    assert rows(out, "name", "host_type", "shared") == [("h1", "h1", '{"s": 2}'), ("h2", "t", '{"s": 2}')]
    two = entries.unionByName(entries.filter("shared is not null"))
    with pytest.raises(ValueError):
        routing.split_hosts(two)


def test_limits_from_session_conf(spark):
    from revledger.operators.joins import bounded
    spark.conf.set("spark.revledger.broadcastRows", "5")
    try:
        assert bounded(spark.range(10)) is None and bounded(spark.range(5)) is not None
    finally:
        spark.conf.unset("spark.revledger.broadcastRows")
    assert bounded(spark.range(10)) is not None


def test_salted_left_join_keeps_unmatched_once(spark, monkeypatch):
    from revledger.operators import joins
    from revledger.operators.joins import fanout_join
    monkeypatch.setattr(joins, "PAIR_LIMIT", 4)
    big = spark.range(50).select(F.col("id").alias("h"), (F.col("id") % 4).cast("string").alias("t"))
    small = spark.createDataFrame([("0", 1), ("0", 2), ("1", 3)], "k string, v int")
    a = fanout_join(big, small, "t", "k", F.xxhash64("h"), how="left").select("h", "v")
    b = fanout_join(big, small, "t", "k", F.xxhash64("h"), how="left", force_salt=True).select("h", "v")
    assert a.count() == b.count() == 13 * 2 + 13 + 24
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_cluster_session_needs_shared_checkpoint_dir():
    from revledger.session import ensure_checkpoint_dir

    class Ctx:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext = Ctx()
        conf = Conf()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_checkpoint_dir_from_conf_is_used():
    from revledger.session import ensure_checkpoint_dir
    seen = {}

    class Ctx:
        master = "yarn"

        def getCheckpointDir(self):
            return seen.get("dir")

        def setCheckpointDir(self, d):
            seen["dir"] = d

    class Conf:
        def get(self, key, default=None):
            return "hdfs://shared/ckpt" if key == "spark.checkpoint.dir" else default

    class Session:
        sparkContext = Ctx()
        conf = Conf()

    assert ensure_checkpoint_dir(Session()) == "hdfs://shared/ckpt"


FLEET = "host_id string, application string, kind string, from_rev string, target_rev string"


def _fleet(spark, limit, hops_limit=10**6):
    edges = spark.createDataFrame([("a", "1", "2"), ("a", "2", "3")], EDGES)
    starts = spark.createDataFrame([
        ("h1", "a", "main", "1", "3"), ("h2", "a", "main", "1", "3"), ("h3", "a", "replica", "1", "2"),
        ("h4", "a", "main", "3", "3"), ("h5", "a", "main", "9", "3")], FLEET)
    return graph.find_ways(edges, starts, group_edge_limit=limit, way_hop_limit=hops_limit)


@pytest.mark.parametrize("limit", [0, 1000])
@pytest.mark.parametrize("hops_limit", [1, 10**6])
def test_fleet_with_two_hosts_and_two_targets(spark, limit, hops_limit):  # J4, G3
    ways = _fleet(spark, limit, hops_limit)
    entries = spark.createDataFrame(
        [("a", "m2", "2", ["1"]), ("a", "m3", "3", ["2"])],
        "application string, migration_id string, to_rev string, compatible array<string>")
    scripts_df = spark.createDataFrame(
        [("a", "m2", "main", 1, "2m"), ("a", "m2", "replica", 1, "2r"), ("a", "m3", "main", 1, "3m")],
        "application string, migration_id string, upgrade_type string, pos int, script string")
    out = graph.hop_scripts(ways, entries, scripts_df, F.col("kind"))
    assert rows(out, "host_id", "target_rev", "hop_no", "status", "script") == [
        ("h1", "3", 1, "ok", "2m"), ("h1", "3", 2, "ok", "3m"),
        ("h2", "3", 1, "ok", "2m"), ("h2", "3", 2, "ok", "3m"), ("h3", "2", 1, "ok", "2r")]
    assert rows(graph.refusals(ways, out), "host_id", "reason") == [("h5", "no_way")]
    pushed = graph.expand_hops(ways, F.lit("done"), kinds=("var",))
    assert rows(pushed, "host_id", "target_rev", "hop_no", "revision", "is_final") == [
        ("h1", "3", 1, "2", False), ("h1", "3", 2, "3", True), ("h2", "3", 1, "2", False),
        ("h2", "3", 2, "3", True), ("h3", "2", 1, "2", True), ("h4", "3", 1, "3", True)]


def test_refused_hosts_name_the_first_bad_hop(spark):
    ways = _fleet(spark, 1000)
    entries = spark.createDataFrame(
        [("a", "m2", "2", ["1"]), ("a", "n2", "2", ["1"])],
        "application string, migration_id string, to_rev string, compatible array<string>")
    none = spark.createDataFrame([], "application string, migration_id string, upgrade_type string, "
                                     "pos int, script string")
    out = graph.refusals(ways, graph.hop_scripts(ways, entries, none, F.col("kind")))
    assert rows(out, "host_id", "reason") == [("h1", "non_unique"), ("h2", "non_unique"),
                                              ("h3", "non_unique"), ("h5", "no_way")]


@pytest.mark.parametrize("limit", [0, 1000])
def test_null_edges_and_large_ids(spark, limit):  # G1
    big = (1 << 53) + 1
    edges = spark.createDataFrame([(1, big, big + 1), (1, big + 1, big + 2), (1, None, big), (1, big, None),
                                   (None, big, big + 2)], "application long, from_rev long, to_rev long")
    starts = spark.createDataFrame([(1, big, big + 2), (1, None, big), (None, big, big + 2)],
                                   "application long, from_rev long, target_rev long")
    out = graph.find_ways(edges, starts, group_edge_limit=limit)
    got = {(r["application"], r["from_rev"]): (r["status"], [(h["to_rev"], h["from_rev"]) for h in r["way"] or []])
           for r in out.collect()}
    assert got == {(1, big): ("unique", [(big + 1, big), (big + 2, big + 1)]),
                   (1, None): ("no_way", []), (None, big): ("no_way", [])}


@pytest.mark.parametrize("limit", [0, 1000])
def test_long_chain_is_walked_to_its_end(spark, limit):
    edges = spark.createDataFrame([("a", str(i), str(i + 1)) for i in range(12)], EDGES)
    starts = spark.createDataFrame([("a", "0", "12")], STARTS)
    r = graph.find_ways(edges, starts, group_edge_limit=limit).first()
    assert (r["status"], r["length"]) == ("unique", 12)


def test_hop_with_over_a_thousand_scripts_stays_in_order(spark):
    from revledger.operators import routing
    plan = spark.createDataFrame(
        [("h", 1, 1, p, f"a{p}") for p in range(1, 1102)] + [("h", 1, 2, 1, "b1")],
        "host_id string, phase_no int, hop_no long, pos long, item string")
    out = routing.number_fragments(plan, order=["phase_no", "hop_no", "pos"])
    got = {r["item"]: r["fragment_no"] for r in out.collect()}
    assert got["a1101"] == 1101 and got["b1"] == 1102


def test_as_list_keeps_texts_that_are_no_list(spark):  # P7
    df = spark.createDataFrame([("[draft].sql",), ("[1, 2]",), ('["a"]',), ("[",), (None,), ("x",)], "f string")
    assert [r["l"] for r in df.select(as_list("f").alias("l")).collect()] == [
        ["[draft].sql"], ["1", "2"], ["a"], ["["], None, ["x"]]


def test_layout_migration_moves_every_column(spark):  # T3
    from revledger.operators.layout import migrate_layout
    cur = spark.createDataFrame([("a", "r2", ["s"], "var"), ("b", "r9", None, "func")],
                                "application string, revision string, schemas array<string>, kind string")
    hist = spark.createDataFrame([(1, "a", "r1", None, "var")],
                                 "id long, application string, revision string, schemas array<string>, kind string")
    new = spark.createDataFrame([(7,)], "revision_history_id long")
    moved, rows_, rest, _ = migrate_layout(cur, hist, new, "a", "main")
    assert [(r["revision"], r["schemas"], r["kind"]) for r in moved.collect()] == [("r2", ["s"], "var")]
    assert rows(rows_, "revision_history_id", "revision", "schemas", "kind", "source") == [
        (8, "r1", None, "var", "history"), (9, "r2", ["s"], "var", "current")]
    assert rest.count() == 1


def test_scan_paths_are_relative_and_decoded(spark):  # S3
    import os
    import tempfile

    from revledger.sources.scripts import scan_scripts, write_scripts
    root = tempfile.mkdtemp(prefix="revledger.v1+x ")
    names = ["sub dir/a b.sql", "p+q/r.s/%41.sql", "é/ü.sql"]
    files = spark.createDataFrame([(n, f"select '{n}';") for n in names], "path string, text string")
    assert write_scripts(files, "file://" + root).count() == 3
    assert os.path.exists(f"{root}/sub dir/a b.sql")
    for r in (root, "file://" + root + "/", "file:" + root):
        got = {x["path"]: x["text"] for x in scan_scripts(spark, [r]).collect()}
        assert got == {n: f"select '{n}';" for n in names}


def test_only_heavy_keys_are_split(spark, monkeypatch):  # J1, J8
    """One key in a fifth of all rows is dealt over many tasks, by its size;
    rows of other keys are not repeated."""
    from revledger.operators import joins

    monkeypatch.setattr(joins, "PAIR_LIMIT", 1000)
    big = spark.range(10_000).select(F.col("id").alias("h"), F.when(F.col("id") % 5 == 0, F.lit(-1)).otherwise(
        F.col("id")).alias("t"))
    small = spark.range(-1, 6000).select(F.col("id").alias("k"), F.explode(F.array(F.lit(1), F.lit(2))).alias("v"))
    out = joins.split_join(big, small, "t", "k", F.xxhash64("h")).select("h", "v", F.spark_partition_id().alias("p"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = joins.split_join(big, small, "t", "k", F.xxhash64("h")).select(
            "h", "v", "t", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    hot = [r for r in rows if r["t"] == -1]
    assert len(hot) == 4000 and len({r["p"] for r in hot}) > 1
    assert sorted((r["h"], r["v"]) for r in rows) == sorted(
        (h, v) for h in range(10_000) if h % 5 == 0 or h < 6000 for v in (1, 2))
    assert out.count() == len(rows)


def test_files_are_read_once_for_roots(spark):  # P5
    files = spark.createDataFrame([("a/b/x",), ("a/b",), ("a/bc/x",), ("/r/s",), ("c",), (None,), ("",), ("d/e/f/g",)],
                                  "path string")
    roots = spark.createDataFrame([("a/b/",), ("/r",), ("d/e/f",), ("c//",), (None,)], "root string")
    out = scripts.outside_roots(files, roots)
    assert sorted(map(str, (r["path"] for r in out.collect()))) == ["", "None", "a/bc/x"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LocalRelation") + plan.count("LogicalRDD") <= 1 + 3 and "Aggregate" not in plan


def test_table_scope_drops_what_was_written_inside(spark, tmp_path):
    import os

    from revledger.session import table_scope, written
    before = written(spark.range(3), "outside")
    with table_scope(spark):
        a = written(spark.range(5), "inside")
        with table_scope(spark):
            b = written(a.filter("id > 1"), "deeper")
            assert b.count() == 3
        inner = {f.split("file:")[-1] for f in a.inputFiles()}
        a.write.parquet(str(tmp_path / "result"))
        assert all(os.path.exists(f) for f in inner)
    assert not any(os.path.exists(f) for f in inner)
    assert spark.read.parquet(str(tmp_path / "result")).count() == 5 and before.count() == 3


def test_what_was_shuffled_for_a_written_table_goes_with_it(spark):
    import time

    from revledger.session import shuffles_dropped, written
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.endswith(".data")}

    had = shuffled()
    df = spark.range(20_000).select(F.xxhash64("id").alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    out = written(df)
    end = time.time() + 20
    while shuffled() - had and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - had
    assert out.count() == df.count() == 20_000 and spark.conf.get(name, None) == before
    with pytest.raises(ZeroDivisionError), shuffles_dropped(spark):
        1 / 0
    assert spark.conf.get(name, None) == before


def test_long_lists_are_kept_once_for_their_rows(spark, tmp_path):  # T2
    """Rows of many keys with a long list each: the table holds a list a few
    times, not once a row, however the rows came."""
    import os

    from revledger.session import written
    texts = [("".join(chr(97 + (i * 7919 + j * j * 31 + j * 17) % 26) for j in range(300_000)), str(i)) for i in range(8)]
    lists = spark.createDataFrame(texts, "names string, t string").unionByName(
        spark.createDataFrame([("", "empty"), (None, "null")], "names string, t string"))
    ids = spark.range(2000)
    data = written(ids.select("id", F.when(F.col("id") % 11 < 8, (F.col("id") % 11).cast("string")).when(
        F.col("id") % 11 == 8, "empty").when(F.col("id") % 11 == 9, "unlisted").alias("k")).repartition(2))
    plain = data.join(lists, F.col("k") == F.col("t"), "left")
    out = routing.with_lists(data, lists, F.col("k") == F.col("t"), "names", ["k", "id"])

    def short(df):
        return rows(df.select("id", "k", "t", F.md5("names").alias("m")), "id", "k", "t", "m")
    assert short(out) == short(plain)
    out.write.parquet(str(tmp_path / "out"))
    size = sum(os.path.getsize(tmp_path / "out" / f) for f in os.listdir(tmp_path / "out"))
    assert size < 40 * 300_000  # 1455 rows have one


def test_entries_of_a_hop_count_once_however_often_they_are_listed(spark):  # J4
    ways = spark.createDataFrame([(a, 1, 3, "unique", 2, 1, [(2, 1), (3, 2)]) for a in (7, 8)],
                                 "application int, from_rev int, target_rev int, status string, length int, n_paths int, "
                                 "way array<struct<to_rev:int,from_rev:int>>")
    entries = spark.createDataFrame(
        [(7, "a", 2, [1, 1, None]), (7, "a", 2, [1]), (7, "b", 3, [2]), (7, "c", 3, [2, 1]), (8, None, 2, [1]), (8, "d", 3, [])],
        "application int, migration_id string, to_rev int, compatible array<int>")
    out = graph.hop_entries(ways, entries, F.lit("main"))
    assert rows(out, "application", "hop_no", "status", "migration_id") == srt([
        (7, 1, "ok", "a"), (7, 2, "non_unique", None), (8, 1, "missing", None), (8, 2, "missing", None)])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = graph.hop_entries(ways, entries, F.lit("main"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange") <= 2  # the entries once, the hops once


def test_routing_is_dealt_by_pairs_whatever_the_files(spark):  # J1
    hosts = spark.createDataFrame([(i, f"t{i % 2}") for i in range(40)], "host_id int, host_type string").coalesce(1)
    descr = spark.createDataFrame([(f"t{i % 2}", i) for i in range(50)], "schemas_type string, k int").coalesce(1)
    spark.conf.set("spark.revledger.taskPairs", "100")
    try:
        out = routing.route(hosts, descr)
        assert out.rdd.getNumPartitions() >= 10
        assert rows(out, "host_id", "k") == srt((h, k) for h in range(40) for k in range(50) if h % 2 == k % 2)
    finally:
        spark.conf.unset("spark.revledger.taskPairs")


def test_routed_rows_come_in_blocks(spark):  # J1
    """A table of all pairs is small on disk: rows of one descriptor come one
    after another for a block of hosts, not one for each host in turn."""
    hosts = [(i % 380, [None, "x", "y", "none"][i % 4]) for i in range(400)] + [(None, "x"), (None, None)]
    descr = [(t, i) for i in range(60) for t in ("x", "x", "y", None, "z")]
    h = spark.createDataFrame(hosts, "host_id int, host_type string")
    d = spark.createDataFrame(descr, "schemas_type string, k int")
    spark.conf.set("spark.revledger.taskPairs", "6000")
    try:
        out = routing.route(h, d)
        assert out.columns == ["host_id", "host_type", "k"]
        got = out.withColumn("p", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id())
        got = sorted(got.collect(), key=lambda r: r["n"])
    finally:
        spark.conf.unset("spark.revledger.taskPairs")
    assert srt((r["host_id"], r["host_type"], r["k"]) for r in got) == srt(
        (i, t, k) for i, t in hosts for u, k in descr if t is not None and t == u)
    runs = 1 + sum((a["host_type"], a["k"]) != (b["host_type"], b["k"]) for a, b in zip(got, got[1:]))
    assert len(got) == 60 * (2 * 101 + 100) and runs <= len(got) / 25
    assert max(map([r["p"] for r in got].count, {r["p"] for r in got})) <= 4 * 6000


def _numbered(hosts, typed, own):
    """The plan of every host id, laid out and counted row by row."""
    plans = {}
    for h, t in hosts:
        plans.setdefault(h, []).extend((p, pos, item) for ty, p, pos, item in typed if ty == t)
    for h, p, pos, item in own:
        plans.setdefault(h, []).append((p, pos, item))
    return srt((h, *row, i + 1) for h, plan in plans.items() for i, row in enumerate(sorted(plan)))


@pytest.mark.parametrize("with_own", [False, True])
def test_plans_numbered_by_type_are_those_numbered_by_host(spark, with_own):  # U3, W2
    hosts = [("a", "x"), ("b", "x"), ("b", "x"), ("c", "x"), ("c", "y"), ("d", "none"), (None, "y"), (None, "y"),
             ("e", None), ("f", "y"), ("g", "y")]
    typed = [("x", 0, 0, "init"), ("x", 2, 1, "f1"), ("x", 2, 2, "f2"), ("y", 2, 7, "f7"), ("x", 3, 0, "end"),
             ("y", 2, 7, "f7"), ("z", 2, 1, "never")]
    own = [("a", 1, 1, "h1"), ("a", 1, 2, "h2"), ("b", 1, 1, "h1"), ("d", 1, 5, "h5"), ("f", 1, 3, "h3")] * with_own
    cols = "phase_no int, pos int, item string"
    out = routing.number_routed(
        spark.createDataFrame(hosts, "host_id string, host_type string"),
        spark.createDataFrame(typed, "schemas_type string, " + cols),
        own=spark.createDataFrame(own, "host_id string, " + cols) if with_own else None, own_phase=1)
    assert rows(out, "host_id", "phase_no", "pos", "item", "fragment_no") == _numbered(hosts, typed, own)


@pytest.mark.parametrize("with_own", [False, True])
def test_plans_numbered_in_blocks_are_those_numbered_by_host(spark, with_own):  # U3, W2
    spark.conf.set("spark.revledger.taskPairs", "3")
    try:
        test_plans_numbered_by_type_are_those_numbered_by_host(spark, with_own)
    finally:
        spark.conf.unset("spark.revledger.taskPairs")


def test_fragment_numbers_shuffles_no_routed_row(spark):  # W2
    hosts = spark.createDataFrame([(i, "t") for i in range(30)], "host_id int, host_type string")
    typed = spark.createDataFrame([("t", 0, i) for i in range(30)], "schemas_type string, phase_no int, pos int")
    out = routing.number_routed(hosts, typed)

    def windows(df):
        return "Window [" in df._jdf.queryExecution().optimizedPlan().toString()

    assert windows(routing.number_fragments(routing.route(hosts, typed)))
    assert not windows(out)  # the numbers of a type are there before the join
    assert out.count() == 900

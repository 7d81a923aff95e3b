"""Randomised checks against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from revledger.operators import grants, graph


def brute_ways(edges, start, target, max_depth=12):
    """Enumerate walks ending at ``target``, longest first, one more hop per
    round, until a round holds walks that begin at ``start``."""
    if start == target:
        return "at_target", 0, 1, []
    into = {}
    for f, t in edges:
        into.setdefault(t, []).append(f)
    walks = [[(target, f)] for f in into.get(target, [])]
    depth = 1
    while walks and depth <= max_depth:
        hits = [w for w in walks if w[0][1] == start]
        if hits:
            if len(hits) == 1:
                return "unique", depth, 1, hits[0]
            return "ambiguous", depth, len(hits), None
        walks = [[(w[0][1], f)] + w for w in walks for f in into.get(w[0][1], [])]
        depth += 1
    return "no_way", None, None, None


def random_graphs(seed, n_apps=40):
    rnd = random.Random(seed)
    edges, starts, expect = [], [], {}
    for a in range(n_apps):
        n = rnd.randint(1, 7)
        es = sorted({(str(rnd.randrange(n)), str(rnd.randrange(n))) for _ in range(rnd.randint(0, 12))})
        es = [(f, t) for f, t in es if f != t] + ([("0", "0")] if rnd.random() < 0.2 else [])
        target = str(rnd.randrange(n))
        app = f"app{a}"
        edges += [(app, f, t) for f, t in es]
        for s in range(n):
            starts.append((app, str(s), target))
            expect[(app, str(s))] = brute_ways(sorted(set(es)), str(s), target)
    return edges, starts, expect


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ways_match_walk_enumeration(spark, seed):
    edges, starts, expect = random_graphs(seed)
    e = spark.createDataFrame(edges, "application string, from_rev string, to_rev string")
    s = spark.createDataFrame(starts, "application string, from_rev string, target_rev string")
    for limit in (0, 1000):
        got = {}
        for r in graph.find_ways(e, s, group_edge_limit=limit).collect():
            way = None if r["way"] is None else [(h["to_rev"], h["from_rev"]) for h in r["way"]]
            got[(r["application"], r["from_rev"])] = (r["status"], r["length"], r["n_paths"], way)
        for k, exp in expect.items():
            status, length, n, way = got[k]
            if exp[0] == "no_way":
                assert status == "no_way", (k, got[k])
            else:
                assert (status, length, n, way) == exp, (k, got[k], exp)


def test_audit_partitions_observed(spark):
    rnd = random.Random(7)
    roles = [f"r{i}" for i in range(5)]
    declared = [(k, rnd.choice(roles), rnd.sample(roles, rnd.randint(0, 3)) if rnd.random() < 0.8
                 else None) for k in range(30)]
    observed = sorted({(rnd.randrange(32), rnd.choice(roles), rnd.choice(roles),
                        rnd.choice(["USAGE", "CREATE"]), rnd.random() < 0.2) for _ in range(300)})
    d = spark.createDataFrame(declared, "schema_key long, owner string, grants array<string>")
    o = spark.createDataFrame(observed, "schema_key long, grantor string, grantee string, "
                                        "privilege string, is_grantable boolean")
    audit = grants.audit(o, d)
    assert audit.count() == len(observed)  # accepted + unexpected = observed
    owner = {k: w for k, w, _ in declared}
    usage = {k: {w} | set(g or []) for k, w, g in declared}
    for r in audit.collect():
        k = r["schema_key"]
        ok = (k in owner and r["grantor"] == owner[k] and not r["is_grantable"]
              and ((r["privilege"] == "CREATE" and r["grantee"] == owner[k])
                   or (r["privilege"] == "USAGE" and r["grantee"] in usage[k])))
        assert (r["status"] == "accepted") == ok
    missing = {(r["schema_key"], r["privilege"], r["grantee"]) for r in grants.missing(o, d).collect()}
    acc = {(r["schema_key"], r["privilege"], r["grantee"])
           for r in audit.filter(F.col("status") == "accepted").collect()}
    want = {(k, "CREATE", w) for k, w, _ in declared} | {(k, "USAGE", g) for k in usage for g in usage[k]}
    assert missing == want - acc


def test_push_then_clean_restores_current(spark):
    import datetime

    from revledger.operators import ledger
    rnd = random.Random(11)
    t = datetime.datetime(2024, 1, 1)
    schema = ("revision_history_id long, application string, schemas_type string, "
              "datetime timestamp_ntz, revision string, comment string")
    cur = [(i, f"a{rnd.randrange(20)}", f"t{i}", t, f"r{i}", None) for i in range(30)]
    cur = list({(r[1], r[2]): r for r in cur}.values())
    batch = [(0, f"a{rnd.randrange(25)}", f"t{rnd.randrange(40)}", t, "rb", "c") for _ in range(40)]
    c = spark.createDataFrame(cur, schema)
    b = spark.createDataFrame(batch, schema)
    new_current, appended, conflicts = ledger.push(c, c, b)
    # accepted + conflicting rows are the batch
    assert appended.count() + conflicts.count() == len(batch)
    # cleaning the pushed keys gives back the stored table
    back = ledger.clean(new_current, appended)
    assert back.exceptAll(c).count() == 0 and c.exceptAll(back).count() == 0
    # ids continue after the largest stored id, densely
    ids = sorted(r[0] for r in appended.select("revision_history_id").collect())
    top = max(r[0] for r in cur)
    assert ids == list(range(top + 1, top + 1 + len(ids)))

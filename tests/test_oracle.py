"""Every registered query against its DuckDB oracle on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from revledger.session import TABLES
from tests.conftest import SMALL
from tools.check_oracle import digest

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    hs, ls = digest(sdf.columns, srows)
    hd, ld = digest(dcols, drows)
    assert hs == hd, (sorted(set(ls) - set(ld))[:3], sorted(set(ld) - set(ls))[:3])


def test_every_query_has_a_runner():
    assert set(ORACLE) <= set(QUERIES)
    assert not {q for q in set(QUERIES) - set(ORACLE) if not q.startswith("op") and q != "pipeline"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"status", "way_text"} <= set(df.columns)


def test_entry_in_fresh_process():
    """entry() must not depend on queries() having been called first."""
    import subprocess
    import sys
    code = ("import __spark_entry__ as E\n"
            "from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
            ".getOrCreate()\n"
            "print('ROWS', E.entry(s).count())\n")
    root = __import__("os").path.dirname(__import__("os").path.dirname(__file__))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True,
                         timeout=600)
    assert "ROWS" in out.stdout, out.stderr[-2000:]


FORCED_QUERIES = ["ledger_transitions", "fragment_numbers", "pinned_order", "route_hosts",
                  "migration_ways", "ledger_push", "revision_guard"]


@pytest.mark.parametrize("name", FORCED_QUERIES)
def test_scale_paths_match_oracle(spark, con, name):
    """Tiny limits force the hot-group, level-loop and salted paths."""
    from tools.check_forced import FORCED
    for k, v in FORCED.items():
        spark.conf.set(k, v)
    try:
        sdf = QUERIES[name](spark, SMALL)
        srows = [tuple(r) for r in sdf.collect()]
    finally:
        for k in FORCED:
            spark.conf.unset(k)
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]

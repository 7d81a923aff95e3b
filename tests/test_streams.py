"""Streams against batch equivalents and a sequential brute force."""

import os
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as E
from revledger.plans.fixtures import Fixtures
from revledger.plans.script_queries import _script_files
from revledger.plans.stream_queries import guard_pushes
from revledger.sources.scripts import bundle_keys, scan_scripts, write_bundles
from tests.conftest import SMALL


def test_stream_guard_matches_sequential_replay(spark):
    got = E.queries()["stream_guard"](spark, SMALL)
    pushes = guard_pushes(Fixtures(spark, SMALL)["fx_history"]).toPandas()
    expect = {}
    for (app, st), grp in pushes.groupby(["application", "schemas_type"]):
        stored, known = None, False
        for _, r in grp.sort_values("revision_history_id").iterrows():
            exp = None if r["expected_revision"] is None or r["expected_revision"] != r[
                "expected_revision"] else r["expected_revision"]
            ok = (stored if known else None) == exp
            expect[int(r["revision_history_id"])] = ok
            if ok:
                stored, known = r["revision"], True
    actual = {int(r["revision_history_id"]): bool(r["accepted"]) for r in got.collect()}
    assert actual == expect
    assert any(expect.values()) and not all(expect.values())


def test_stream_push_equals_batch_latest(spark):
    q = E.queries()
    a = q["stream_push"](spark, SMALL)
    b = q["ledger_latest"](spark, SMALL).select(*a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_scan_and_bundle_sink(spark):
    root = tempfile.mkdtemp(prefix="revledger-scan-")
    for d, name, text in [("a/x", "1.sql", "select 1;"), ("a/x", "2.txt", "no"),
                          ("a/y.z", "3.sql", "select 3;\n")]:
        os.makedirs(f"{root}/{d}", exist_ok=True)
        with open(f"{root}/{d}/{name}", "w") as fh:
            fh.write(text)
    df = scan_scripts(spark, [root])
    got = sorted((r["path"], r["text"]) for r in df.collect())
    assert got == [("a/x/1.sql", "select 1;"), ("a/y.z/3.sql", "select 3;\n")]
    plan = df.select(F.lit("host.one").alias("host"), F.split_part("path", F.lit("/"), F.lit(2))
                     .alias("kind"), "text", F.col("path").alias("seq"))
    out = tempfile.mkdtemp(prefix="revledger-bundle-") + "/b"
    write_bundles(bundle_keys(plan, "host", "kind"), out)
    back = spark.read.text(out).filter("value <> ''").select("host_key", "type_key", "value")
    assert sorted(tuple(r) for r in back.collect()) == [
        ("host-one", "x", "select 1;"), ("host-one", "y-z", "select 3;")]


def test_scan_reads_files_in_few_tasks_and_passes_over_what_the_source_does(spark, monkeypatch):
    """Tasks do not grow with the files, nothing is opened by the file source,
    and the rows are those of the file source."""
    from revledger.sources import scripts

    root = tempfile.mkdtemp(prefix="revledger-scan v1+x-")
    names = [f"h{i % 3}/sub {i % 2}/%{i}+ é.sql" for i in range(60)] + ["top.sql", "a=b/_x=1.sql"]
    for name in names + ["h0/.hid.sql", "_tmp/1.sql", ".git/2.sql", "h1/_3.sql", "h1/4.txt", "h2/empty.sql"]:
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as fh:
            fh.write(b"" if "empty" in name else f"select '{name}';\r\n".encode() + b"\xff\n")
    os.makedirs(f"{root}/none")
    monkeypatch.setattr(scripts, "_BATCH_BYTES", 100)
    df = scan_scripts(spark, [root])
    assert "Scan text" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    by_tasks = sorted((r["path"], bytes(r["b"])) for r in df.select("path", F.col("text").cast("binary").alias("b")).collect())
    source = scripts._read_by_source(spark, root, ".sql").select("path", F.col("text").cast("binary").alias("b"))
    assert by_tasks == sorted((r["path"], bytes(r["b"])) for r in source.collect())
    assert [p for p, _ in by_tasks] == sorted(names)
    one = scan_scripts(spark, [f"{root}/h0/*", f"{root}/none"])
    assert one.count() == 20


def test_bundles_deal_paths_before_texts_are_read(spark, monkeypatch):
    """No text is shuffled between its file and its bundle, and part files in
    name order hold a bundle's fragments in path order."""
    from revledger.functions.keys import file_safe_key
    from revledger.sources import scripts

    root = tempfile.mkdtemp(prefix="revledger-scan-")
    names = [f"{h}/{k}/{i:03d} f.sql" for h in ("a.b", "a-b", "c") for k in ("x", "y.z") for i in range(40)]
    for name in names:
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w") as fh:
            fh.write(name)
    monkeypatch.setattr(scripts, "TASK_FILES", 7)
    host, kind = (F.split_part("path", F.lit("/"), F.lit(i)) for i in (1, 2))
    df = scan_scripts(spark, [root], order=[file_safe_key(host), file_safe_key(kind), F.col("path")])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("MapInArrow")] and "rangepartitioning" in plan
    assert df.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    out = tempfile.mkdtemp(prefix="revledger-bundle-") + "/b"
    write_bundles(bundle_keys(df, host, kind).withColumn("seq", F.col("path")), out, dealt=True)
    lines = spark.read.text(out).select("host_key", "type_key", "value", F.col("_metadata.file_name").alias("name"),
                                        F.monotonically_increasing_id().alias("line")).collect()
    got, want = {}, {}
    for r in sorted(lines, key=lambda r: (r["name"], r["line"])):
        got.setdefault((r["host_key"], r["type_key"]), []).append(r["value"])
    for name in sorted(names):
        h, k, _ = name.split("/")
        want.setdefault((h.replace(".", "-"), k.replace(".", "-")), []).append(name)
    assert got == want and len({r["name"] for r in lines}) > 20
    # a root that the file source reads is dealt by the same order
    both = [r["path"] for r in scan_scripts(spark, [f"{root}/c/*", f"{root}/a.b"], order=[F.col("path")]).collect()]
    assert both == sorted(both) and len(both) == 160


def test_scripts_join_no_labels_unless_they_repeat(spark):
    """The corpus needs no join with labels that are unique; labels that
    repeat (or are null) give the rows of the view."""

    docs = spark.createDataFrame([(i, f"text {i}", "en", f"src{i % 2}") for i in range(1, 9)] + [(None, "n", "en", "src0")],
                                 "doc_id long, text string, lang string, source string")
    for ids, joins in (([1, 2, 5, None, None], False), ([1, 2, 2, None], True)):
        fx = Fixtures(spark, "none")
        fx._frames = {"documents": docs, "labels": spark.createDataFrame([(i, 1, 0) for i in ids],
                                                                         "doc_id long, quality int, toxic int")}
        got, view = _script_files(fx), fx["fx_script_files"]
        assert ("Join" in got._jdf.queryExecution().optimizedPlan().toString()) == joins
        assert sorted(map(str, got.collect())) == sorted(map(str, view.collect()))


def test_ledger_commit_protocol(spark):
    import datetime

    from revledger.operators import ledger
    from revledger.schemas import LEDGER_CURRENT, LEDGER_HISTORY
    from revledger.sources import ledger_io

    root = tempfile.mkdtemp(prefix="revledger-ledger-")
    t = datetime.datetime(2024, 1, 1)
    empty_c = spark.createDataFrame([], LEDGER_CURRENT)
    empty_h = spark.createDataFrame([], LEDGER_HISTORY)
    b1 = spark.createDataFrame([("a", "t", "var", t, "r1", None, None),
                                ("b", "t", "var", t, "r1", "c", [])], LEDGER_CURRENT)
    cur, app, bad = ledger.push(empty_c, empty_h, b1, key=["application", "schemas_type", "kind"])
    ledger_io.commit_batch(root, 0, cur, app)
    b2 = spark.createDataFrame([("a", "t", "var", t, "r2", None, ["s"])], LEDGER_CURRENT)
    prev = ledger_io.read_current(spark, root, LEDGER_CURRENT)
    hist = ledger_io.read_history(spark, root)
    cur2, app2, _ = ledger.replace(prev, hist, b2, key=["application", "schemas_type", "kind"])
    ledger_io.commit_batch(root, 1, cur2.select(*LEDGER_CURRENT.names), app2)
    # a half-written batch 2 (history only, no commit row) is invisible
    ledger_io._write(app2, f"{root}/history/batch_id=2/attempt=x", ["application"])
    assert sorted(r["batch_id"] for r in ledger_io.committed(spark, root).collect()) == [0, 1]
    got = {r["application"]: (r["revision"], r["schemas"])
           for r in ledger_io.read_current(spark, root, LEDGER_CURRENT).collect()}
    assert got == {"a": ("r2", ["s"]), "b": ("r1", [])}  # NULL and empty arrays kept apart
    ids = sorted(r["revision_history_id"] for r in ledger_io.read_history(spark, root).collect())
    assert ids == [1, 2, 3]
    assert ledger_io.history_top(spark, root) == 3


def test_fetch_prunes_buckets(spark):
    import datetime

    from revledger.operators import ledger
    from revledger.schemas import LEDGER_CURRENT, LEDGER_HISTORY
    from revledger.sources import ledger_io

    root = tempfile.mkdtemp(prefix="revledger-fetch-")
    t = datetime.datetime(2024, 1, 1)
    batch = spark.createDataFrame([(f"app{i}", "t", "var", t, f"r{i}", None, None) for i in range(200)],
                                  LEDGER_CURRENT)
    key = ["application", "schemas_type", "kind"]
    cur, app, _ = ledger.push(spark.createDataFrame([], LEDGER_CURRENT),
                              spark.createDataFrame([], LEDGER_HISTORY), batch, key=key)
    ledger_io.commit_batch(root, 0, cur, app)
    keys = spark.createDataFrame([("app7", "t", "var"), ("nope", "t", "var")],
                                 "application string, schemas_type string, kind string")
    got = ledger_io.fetch_stored(spark, root, keys, LEDGER_CURRENT)
    assert sorted((r["application"], r["revision"]) for r in got.collect()) == [
        ("app7", "r7"), ("nope", None)]
    one = ledger_io.read_current(spark, root, LEDGER_CURRENT)
    assert one.count() == 200


def _ledger_rows(spark, rows):
    from revledger.schemas import LEDGER_CURRENT, LEDGER_HISTORY
    import datetime
    t = datetime.datetime(2024, 1, 1)
    cur = spark.createDataFrame([(a, "t", "var", t, r, None, None) for _, a, r in rows], LEDGER_CURRENT)
    hist = spark.createDataFrame([(i, a, "t", "var", t, r, None, None) for i, a, r in rows], LEDGER_HISTORY)
    return cur, hist


def test_empty_batches_and_touched_buckets(spark):
    from revledger.schemas import LEDGER_CURRENT
    from revledger.sources import ledger_io

    root = tempfile.mkdtemp(prefix="revledger-ledger-")
    none = _ledger_rows(spark, [])
    ledger_io.commit_batch(root, 0, *none)
    assert ledger_io.read_current(spark, root, LEDGER_CURRENT).count() == 0
    assert ledger_io.history_top(spark, root) == 0
    cur, hist = _ledger_rows(spark, [(i + 1, f"a{i}", "r1") for i in range(40)])
    ledger_io.commit_batch(root, 1, cur, hist)
    ledger_io.commit_batch(root, 2, *none, buckets=[])
    cur, hist = _ledger_rows(spark, [(41, "a7", "r2")])
    buckets = ledger_io.touched_buckets(cur)
    assert len(buckets) == 1
    rest = ledger_io.read_current(spark, root, LEDGER_CURRENT, 3, buckets).filter("application <> 'a7'")
    ledger_io.commit_batch(root, 3, rest.unionByName(cur), hist, buckets=buckets)
    got = {r["application"]: r["revision"] for r in ledger_io.read_current(spark, root, LEDGER_CURRENT).collect()}
    assert got == {f"a{i}": "r2" if i == 7 else "r1" for i in range(40)}
    [attempt] = os.listdir(f"{root}/current/batch_id=3")
    assert len(os.listdir(f"{root}/current/batch_id=3/{attempt}")) <= 3  # one bucket folder beside the marks
    assert ledger_io.history_top(spark, root) == 41 and ledger_io.read_history(spark, root).count() == 41


def test_damaged_commit_is_an_error(spark):
    import glob

    import pytest

    from revledger.schemas import LEDGER_CURRENT
    from revledger.sources import ledger_io

    root = tempfile.mkdtemp(prefix="revledger-ledger-")
    ledger_io.commit_batch(root, 0, *_ledger_rows(spark, [(1, "a", "r1")]))
    for f in glob.glob(f"{root}/commits/.*.crc"):
        os.remove(f)
    with open(f"{root}/commits/0.json", "wb") as fh:
        fh.write(b"not a commit")
    with pytest.raises(Exception):
        ledger_io.read_current(spark, root, LEDGER_CURRENT).count()
    with pytest.raises(Exception):
        ledger_io.history_top(spark, root)


def test_one_of_two_writers_wins(spark):
    from revledger.schemas import LEDGER_CURRENT
    from revledger.sources import ledger_io

    root = tempfile.mkdtemp(prefix="revledger-ledger-")
    first, second = (_ledger_rows(spark, [(1, "a", r)]) for r in ("r1", "r2"))
    assert ledger_io.commit_batch(root, 0, *first)
    assert not ledger_io.commit_batch(root, 0, *second)
    assert [r["revision"] for r in ledger_io.read_current(spark, root, LEDGER_CURRENT).collect()] == ["r1"]
    assert [r["revision"] for r in ledger_io.read_history(spark, root).collect()] == ["r1"]
    # the loser's folders go, the winner's stay
    assert len(os.listdir(f"{root}/history/batch_id=0")) == 2
    assert ledger_io.vacuum(spark, root) == 2
    assert len(os.listdir(f"{root}/history/batch_id=0")) == len(os.listdir(f"{root}/current/batch_id=0")) == 1


def test_a_commit_is_never_replaced(spark):
    from revledger.sources import ledger_io

    root = tempfile.mkdtemp(prefix="revledger-ledger-")
    os.makedirs(f"{root}/commits")
    won = [ledger_io.put_if_absent(spark, f"{root}/commits/0.json", str(i)) for i in range(4)]
    assert won == [True, False, False, False]
    assert open(f"{root}/commits/0.json").read() == "0"
    assert [f for f in os.listdir(f"{root}/commits") if not f.startswith(".")] == ["0.json"]


def test_vacuum_keeps_every_snapshot_that_is_kept(spark):
    from revledger.schemas import LEDGER_CURRENT
    from revledger.sources import ledger_io

    root = tempfile.mkdtemp(prefix="revledger-ledger-")
    cur, hist = _ledger_rows(spark, [(i + 1, f"a{i}", "r0") for i in range(30)])
    ledger_io.commit_batch(root, 0, cur, hist)
    for n in range(1, 5):
        cur, hist = _ledger_rows(spark, [(30 + n, "a7", f"r{n}")])
        buckets = ledger_io.touched_buckets(cur)
        rest = ledger_io.read_current(spark, root, LEDGER_CURRENT, n, buckets).filter("application <> 'a7'")
        assert ledger_io.commit_batch(root, n, rest.unionByName(cur), hist, buckets=buckets)
    reader = ledger_io.read_current(spark, root, LEDGER_CURRENT, before=4)  # a snapshot that is kept
    want = {n: sorted((r["application"], r["revision"]) for r in ledger_io.read_current(
        spark, root, LEDGER_CURRENT, before=n + 1).collect()) for n in (3, 4)}
    assert ledger_io.vacuum(spark, root, keep=2) == 3  # a7's bucket of batches 0, 1 and 2
    assert ledger_io.vacuum(spark, root, keep=2) == 0
    assert sorted((r["application"], r["revision"]) for r in reader.collect()) == want[3]
    for n in (3, 4):
        got = ledger_io.read_current(spark, root, LEDGER_CURRENT, before=n + 1).collect()
        assert sorted((r["application"], r["revision"]) for r in got) == want[n]
    assert ledger_io.read_history(spark, root).count() == 34


def test_few_keys_skip_row_groups(spark, monkeypatch):
    """Literal keys reach the scan, which reads only row groups that may
    hold them."""
    from revledger.schemas import LEDGER_CURRENT
    from revledger.sources import ledger_io

    monkeypatch.setattr(ledger_io, "LEDGER_BUCKETS", 1)
    monkeypatch.setattr(ledger_io, "FILE_ROWS", 100)
    root = tempfile.mkdtemp(prefix="revledger-ledger-")
    ledger_io.commit_batch(root, 0, *_ledger_rows(spark, [(i + 1, f"a{i:05d}", f"r{i}") for i in range(5000)]))
    keys = spark.createDataFrame([(f"a{i:05d}", "t", "var") for i in (7, 8, 2501, 77777)],
                                 "application string, schemas_type string, kind string")
    found = ledger_io.fetch_stored(spark, root, keys, LEDGER_CURRENT)
    assert sorted((r["application"], r["revision"]) for r in found.collect()) == [
        ("a00007", "r7"), ("a00008", "r8"), ("a02501", "r2501"), ("a77777", None)]
    plan = found._jdf.queryExecution().toString()
    assert "EqualTo(application,a02501)" in plan
    asked = ledger_io.read_current(spark, root, LEDGER_CURRENT).filter("application = 'a02501' or application = 'a00007'")
    asked.collect()
    scan = asked._jdf.queryExecution().executedPlan()
    while not scan.children().isEmpty():
        scan = scan.children().head()
    rows = scan.metrics().apply("numOutputRows").value()
    assert 0 < rows <= 200  # two files of 50

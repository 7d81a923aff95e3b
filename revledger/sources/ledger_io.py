"""Ledger tables on storage (S1) and the two-table write protocol.

Layout under ``root``:
  history/batch_id=N/attempt=A/                history rows appended by batch N
  current/batch_id=N/attempt=A/app_bucket=B/   the current rows of bucket B after batch N,
                                               for every bucket that batch N touched
  commits/N.json                               batch N is complete; it names the attempt, the
                                               touched buckets (NULL: all), the largest id

``app_bucket`` is a fixed hash bucket of the application. The current table
is, for each bucket, what the newest committed batch that touched it wrote;
a batch rewrites only the buckets of its own keys, and a lookup of a few
keys reads only their bucket folders. Rows are sorted by key and files carry
a Bloom filter of the application, so a lookup by literal keys skips the row
groups that cannot hold them.

A batch writes its rows into folders of its own attempt and then publishes its
commit file, which must not exist yet: the file is written under another
name and renamed without overwriting, which HDFS does atomically. Of several
writers of a batch one wins; the others get False and their folders are never
read. A retry of a batch that is already committed changes nothing. Readers
list the commits once and read what these name, so they see one snapshot;
:func:`vacuum` drops what no commit that is kept names any more. Only a
folder that does not exist counts as an empty ledger; any other failed read
is an error.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from revledger.schemas import LEDGER_HISTORY


# fixed layout parameter: number of application hash buckets per folder
LEDGER_BUCKETS = 64
BUCKET = "app_bucket"


def app_bucket(app_col="application"):
    c = F.col(app_col) if isinstance(app_col, str) else app_col
    return F.pmod(F.xxhash64(c), F.lit(LEDGER_BUCKETS)).cast("int")


#: rows of a file at most; a lookup of at most this many keys is by literals
FILE_ROWS, LITERAL_KEYS = 1_000_000, 200

COMMIT = StructType([StructField("batch_id", LongType()), StructField("attempt", StringType()),
                     StructField("top_id", LongType()), StructField("buckets", ArrayType(IntegerType()))])


# ---------------------------------------------------------------------------
# the file system under Spark: the one place that needs the JVM gateway


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    p, fs = _path(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def _drop(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Whether ``text`` became the file at ``path``, which did not exist."""
    p, fs = _path(spark, path)
    if fs.exists(p):
        return False
    q, _ = _path(spark, f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}")
    out = fs.create(q, False)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    jvm = spark._jvm
    plain = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = plain
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(q, p, options)
        return True
    except Exception:
        fs.delete(q, False)
        if fs.exists(p):
            return False  # another writer was first
        raise


# ---------------------------------------------------------------------------
# reading


def _with_bucket(schema: StructType) -> StructType:
    return StructType(schema.fields + [StructField(BUCKET, IntegerType())])


def _commits(spark: SparkSession, root: str, before: int | None) -> DataFrame | None:
    """The commit log, or None for a ledger that was never written."""
    if not _exists(spark, f"{root}/commits"):
        return None
    c = spark.read.schema(COMMIT).option("mode", "FAILFAST").json(f"{root}/commits")
    return c if before is None else c.filter(F.col("batch_id") < before)


def last_committed(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    """Newest committed batch id (an aggregate; the batch list stays in Spark)."""
    c = _commits(spark, root, before)
    return None if c is None else c.agg(F.max("batch_id").alias("m")).first()["m"]


def read_history(spark: SparkSession, root: str, schema=LEDGER_HISTORY,
                 before: int | None = None) -> DataFrame:
    """Committed history rows (explicit schema): a semi-join with the
    commit log drops rows of attempts that did not win."""
    if last_committed(spark, root, before) is None:
        return spark.createDataFrame([], schema)
    mark = ["batch_id", "attempt"]
    marked = StructType(_with_bucket(schema).fields + [StructField("batch_id", LongType()),
                                                       StructField("attempt", StringType())])
    h = spark.read.schema(marked).parquet(f"{root}/history")
    return h.join(_commits(spark, root, before).select(*mark), mark, "left_semi").drop(*mark, BUCKET)


def _newest(commits: DataFrame) -> DataFrame:
    """(b, batch_id, attempt): the commit that last wrote each bucket."""
    every = F.sequence(F.lit(0), F.lit(LEDGER_BUCKETS - 1))
    return commits.select("batch_id", "attempt", F.explode(F.coalesce("buckets", every)).alias("b")).groupBy("b").agg(
        F.max(F.struct("batch_id", "attempt")).alias("_c")).select("b", "_c.*")


def _folder(root: str, table: str, batch_id, attempt) -> str:
    return f"{root}/{table}/batch_id={batch_id}/attempt={attempt}"


def read_current(spark: SparkSession, root: str, schema, before: int | None = None,
                 buckets: list[int] | None = None) -> DataFrame:
    """The current table after the newest committed batch (before ``before``),
    or only the given buckets of it. At most ``LEDGER_BUCKETS`` rows (the
    newest batch of each bucket) reach the driver."""
    c = _commits(spark, root, before)
    if c is None:
        return spark.createDataFrame([], schema)
    newest = _newest(c)
    if buckets is not None:
        newest = newest.filter(F.col("b").isin(buckets))
    rows = newest.collect()
    # a bucket without rows has no folder
    there = {f: set(_children(spark, f)) for f in {
        _folder(root, "current", r["batch_id"], r["attempt"]) for r in rows}}
    paths = [f"{f}/{BUCKET}={r['b']}" for r in rows
             if f"{BUCKET}={r['b']}" in there[f := _folder(root, "current", r["batch_id"], r["attempt"])]]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def touched_buckets(rows: DataFrame) -> list[int]:
    """The buckets of the applications in ``rows``: at most LEDGER_BUCKETS."""
    return sorted(r[BUCKET] for r in rows.select(app_bucket().alias(BUCKET)).distinct().collect())


def fetch_stored(spark: SparkSession, root: str, keys: DataFrame, schema,
                 key=("application", "schemas_type", "kind")) -> DataFrame:
    """Stored (revision, comment) for many keys (S1, P1); only the bucket
    folders of the keys are read, and of few keys only the row groups whose
    range and Bloom filter of the application may hold them."""
    key = list(key)
    k = keys.select(*key).distinct()
    few = k.limit(LITERAL_KEYS + 1).collect()
    if len(few) > LITERAL_KEYS:
        cur = read_current(spark, root, schema, buckets=touched_buckets(k))
        return k.join(cur.select(*key, "revision", "comment"), key, "left")
    k = spark.createDataFrame(few, k.schema)
    cur = read_current(spark, root, schema, buckets=touched_buckets(k))
    names = sorted({r[key[0]] for r in few if r[key[0]] is not None})
    asked = reduce(lambda a, b: a | b, [F.col(key[0]) == n for n in names], F.lit(False))
    return k.join(F.broadcast(cur.filter(asked).select(*key, "revision", "comment")), key, "left")


def history_top(spark: SparkSession, root: str, before: int | None = None) -> int:
    """Largest committed history id (0 for an empty ledger). Each commit
    records the largest id of its batch, so this reads only the commit
    log, never the history."""
    c = _commits(spark, root, before)
    top = None if c is None else c.agg(F.max("top_id").alias("m")).first()["m"]
    return 0 if top is None else int(top)


# ---------------------------------------------------------------------------
# writing


def _write(df: DataFrame, path: str, key: list[str]) -> None:
    (df.withColumn(BUCKET, app_bucket()).repartition(BUCKET).sortWithinPartitions(BUCKET, *key)
       .write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS)
       .option("parquet.bloom.filter.enabled#application", "true")
       .partitionBy(BUCKET).parquet(path))


def commit_batch(root: str, batch_id: int, current: DataFrame, appended: DataFrame,
                 key=("application", "schemas_type", "kind"), buckets: list[int] | None = None) -> bool:
    """Write one batch: history rows, then the current rows, then the commit
    (which records the batch's largest history id, NULL for an empty batch).
    ``current`` holds the rows of ``buckets``, or the whole table. False
    when another writer committed the batch: then nothing of this one counts."""
    spark = current.sparkSession
    key = [k for k in key if k in current.columns]
    attempt = uuid.uuid4().hex
    history = _folder(root, "history", batch_id, attempt)
    _write(appended, history, key)
    _write(current, _folder(root, "current", batch_id, attempt), key)
    written = spark.read.schema(appended.schema).parquet(history)
    top = written.agg(F.max(F.col("revision_history_id").cast("long"))).first()[0]
    return put_if_absent(spark, f"{root}/commits/{batch_id}.json", json.dumps(
        {"batch_id": batch_id, "attempt": attempt, "top_id": top, "buckets": buckets}))


def committed(spark: SparkSession, root: str) -> DataFrame | None:
    """The commit log (batch_id, ...), or None for an empty ledger."""
    return _commits(spark, root, None)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Drop the folders that no reader of the last ``keep`` commits needs:
    current buckets that a batch before them had already replaced, and
    attempts up to the newest commit that did not win. Returns how many went."""
    log = _commits(spark, root, None)
    if log is None:
        return 0
    won = {r["batch_id"]: r["attempt"] for r in log.select("batch_id", "attempt").collect()}
    if not won:
        return 0
    kept = sorted(won)[-keep:]
    needed = {(r["batch_id"], r["b"]) for r in _newest(log.filter(F.col("batch_id") <= kept[0])).collect()}
    gone = []
    for table in ("history", "current"):
        for batch in _children(spark, f"{root}/{table}"):
            n = int(batch.partition("=")[2])
            for attempt in _children(spark, f"{root}/{table}/{batch}"):
                folder = f"{root}/{table}/{batch}/{attempt}"
                if won.get(n) != attempt.partition("=")[2]:
                    gone += [folder] if n <= kept[-1] else []
                elif table == "current" and n <= kept[0]:
                    gone += [f"{folder}/{b}" for b in _children(spark, folder) if b.startswith(f"{BUCKET}=")
                             and (n, int(b.partition("=")[2])) not in needed]
    for folder in gone:
        _drop(spark, folder)
    return len(gone)

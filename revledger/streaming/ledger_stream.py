"""Ledger rules applied to streams of pushes (K1-K4).

A push arrives as an event; the same batch operators run on every
micro-batch. Sinks are keyed by ``batch_id`` and written with overwrite,
so a replayed micro-batch rewrites its own folder instead of adding
rows twice. Checkpoints and sinks live under the session's shared
checkpoint folder unless a path is given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revledger.operators import checks, ledger
from revledger.operators.joins import maybe_broadcast
from revledger.operators.replay import replay
from revledger.operators.sequence import assign_ids
from revledger.session import ensure_checkpoint_dir
from revledger.sources import ledger_io

KEY = ["application", "schemas_type"]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One driver table of ``folder`` read as a file stream."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
            .option("maxFilesPerTrigger", 1).parquet(folder))


def run_available(writer, checkpoint: str) -> None:
    """Run a stream over everything available now, then stop."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def stream_split(stream: DataFrame, col: str, pattern: str, out: str, checkpoint: str) -> None:
    """K3: banned-pattern split of a stream into accepted / rejected sinks."""
    def write(batch: DataFrame, batch_id: int) -> None:
        ok, rejected = checks.split_by_pattern(batch, col, pattern)
        ok.write.mode("overwrite").parquet(f"{out}/accepted/batch_id={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{out}/rejected/batch_id={batch_id}")

    run_available(stream.writeStream.foreachBatch(write), checkpoint)


def stream_route(stream: DataFrame, descriptors: DataFrame, stream_key: str, descr_key: str,
                 out: str, checkpoint: str) -> None:
    """K4: stream-static join. The static side is broadcast only when its
    size is checked small; otherwise a regular join."""
    d = maybe_broadcast(descriptors)
    joined = stream.join(d, stream[stream_key] == d[descr_key])
    run_available(joined.writeStream.format("parquet").option("path", out), checkpoint)


def stream_push(stream: DataFrame, root: str, checkpoint: str) -> None:
    """K1: clean-then-push every micro-batch into the ledger at ``root``
    (layout and commit protocol: ``sources.ledger_io``). History ids follow
    the largest committed id, in event-id order; the batch's newest row per
    key replaces the stored one. Only the buckets of the batch's keys are
    read and written; an empty batch commits without rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cols = [c for c in batch.columns if c != ledger.ID]
        rows = assign_ids(batch, [ledger.ID], "_new_id",
                          ledger_io.history_top(spark, root, batch_id) + 1)
        # ids were fixed by assign_ids' checkpoint; all uses below read it
        hist = rows.select(F.col("_new_id").alias(ledger.ID), *cols)
        newest = ledger.latest(hist)
        buckets = ledger_io.touched_buckets(hist)
        prev = ledger_io.read_current(spark, root, newest.schema, batch_id, buckets)
        current = ledger.clean(prev, newest).unionByName(newest)
        ledger_io.commit_batch(root, batch_id, current, hist, buckets=buckets)

    run_available(stream.writeStream.foreachBatch(write), checkpoint)


def read_current(spark: SparkSession, root: str, schema) -> DataFrame:
    return ledger_io.read_current(spark, root, schema)


GUARD_OUT = ("application string, schemas_type string, revision_history_id long, "
             "expected_revision string, revision string, accepted boolean, stored_after string")


def stream_guard(stream: DataFrame, root: str, out: str, checkpoint: str) -> None:
    """K2: guarded push per key against the ledger at ``root``, whose stored
    revisions are the state (a key without a row expects NULL).

    Acceptance depends on the previous decision; ``operators.replay`` finds
    it for all pushes of a micro-batch at once, a hot key dealt over tasks by
    chunk. Accepted rows enter the ledger in the same batch. Batch n of the
    stream is batch n + 1 of the ledger: batch 0 is what it held before, if
    anything."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        number = batch_id + 1
        guard_out = spark.createDataFrame([], GUARD_OUT).schema
        buckets = ledger_io.touched_buckets(batch)
        state = spark.createDataFrame([], GUARD_STATE).schema
        prev = ledger_io.read_current(spark, root, state, number, buckets)
        done = replay(batch, prev, KEY).select(*[f.name for f in guard_out])
        folder = f"{out}/batch_id={batch_id}"
        done.write.mode("overwrite").parquet(folder)
        done = spark.read.schema(done.schema).parquet(folder)
        newest = done.groupBy(*KEY).agg(F.max_by("stored_after", ledger.ID).alias("revision"))
        newest = newest.filter(F.col("revision").isNotNull())
        current = ledger.clean(prev, done.select(*KEY)).unionByName(newest)
        accepted = done.filter("accepted").select(ledger.ID, *KEY, "revision")
        ledger_io.commit_batch(root, number, current, accepted, buckets=buckets)

    run_available(stream.writeStream.foreachBatch(write), checkpoint)


#: what the guard keeps of the ledger's current table
GUARD_STATE = "application string, schemas_type string, revision string"

"""Streaming queries: the events table read as a file stream, run with an
``availableNow`` trigger, results read back from their sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from revledger.plans.fixtures import view_over
from revledger.plans.registry import query
from revledger.sources import ledger_io
from revledger.streaming import ledger_stream as ls


def _pushes(fx):
    events = ls.table_stream(fx.spark, fx.sf_dir, "events")
    return view_over(fx.spark, "fx_history", events=events)


def _in_arrivals(fx, name: str, run, parts: int = 3):
    """``run`` a stream of the same pushes over ``parts`` arrivals, ranges of
    event ids in order (the first has what has no id), with an empty one
    after the first. The stream stops and goes on from its checkpoint
    between them; an arrival is written by as many tasks as read it."""
    folder = ls.scratch(fx.spark, name)
    events = fx["events"]
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    low, high = (0, 0) if low is None else (low, high)
    step = (high - low) // parts + 1
    part = F.coalesce(F.floor((F.col("event_id") - low) / step), F.lit(0))
    for i in range(parts):
        events.filter(part == i).write.parquet(f"{folder}/{2 * i}")
        if i == 0:
            events.limit(0).write.parquet(f"{folder}/1")
        stream = fx.spark.readStream.schema(events.schema).parquet(folder + "/*")
        run(view_over(fx.spark, "fx_history", events=stream))


@query("stream_reject", ("fx_history",), """
select revision_history_id, revision,
       case when coalesce(revision ilike 'PRE-%', false) then 'rejected' else 'accepted' end as status
from {fx_history}
""")
def stream_reject(fx):
    """Banned-pattern split of a push stream into two sinks (K3)."""
    out = ls.scratch(fx.spark, "reject")
    ls.stream_split(_pushes(fx), "revision", "PRE-%", out, out + "/_checkpoint")
    cols = ["revision_history_id", "revision"]
    ok = fx.spark.read.parquet(out + "/accepted").select(*cols, F.lit("accepted").alias("status"))
    bad = fx.spark.read.parquet(out + "/rejected").select(*cols, F.lit("rejected").alias("status"))
    return ok.unionByName(bad)


@query("stream_route", ("events", "fx_groups"), """
select e.event_id as host_id, cast(e.user_id % 25 as string) as host_type,
       g.has_init, g.has_late, g.has_safeguard
from {events} e join {fx_groups} g on g.schemas_type = cast(e.user_id % 25 as string)
""")
def stream_route(fx):
    """Host registrations joined to static per-type descriptors (K4)."""
    events = ls.table_stream(fx.spark, fx.sf_dir, "events")
    hosts = events.select(F.col("event_id").alias("host_id"),
                          (F.col("user_id") % 25).cast("string").alias("host_type"))
    out = ls.scratch(fx.spark, "route")
    ls.stream_route(hosts, fx["fx_groups"], "host_type", "schemas_type", out, out + "_checkpoint")
    return fx.spark.read.parquet(out).select("host_id", "host_type", "has_init", "has_late",
                                             "has_safeguard")


@query("stream_push", ("fx_history",), """
select application, schemas_type, datetime, revision, comment
from (select *, row_number() over (partition by application, schemas_type
                                   order by revision_history_id desc) as k
      from {fx_history}) x
where k = 1
""")
def stream_push(fx):
    """Continuous clean-then-push of a push stream into a ledger, over several
    micro-batches of which one is empty (K1)."""
    root = ls.scratch(fx.spark, "push")
    _in_arrivals(fx, "push-input", lambda pushes: ls.stream_push(pushes, root, root + "/_checkpoint"))
    return ls.read_current(fx.spark, root, fx["fx_history"].schema).select(
        "application", "schemas_type", "datetime", "revision", "comment")


def guard_pushes(pushes):
    """Push events with the revision each one expects to replace."""
    expected = F.when(F.col("revision_history_id") % 3 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("r"), ((F.col("revision_history_id") - 1) % 7).cast("string")))
    return pushes.select("application", "schemas_type", "revision_history_id",
                         expected.alias("expected_revision"), "revision")


# the replay as a recursive CTE: one step per push of a key, carrying the
# stored revision; {SEED} is the ledger before the first push
_GUARD_SQL = """
with recursive p as (
  select application, schemas_type, revision_history_id, revision,
         case when revision_history_id % 3 = 0 then null
              else 'r' || cast((revision_history_id - 1) % 7 as varchar) end as expected_revision,
         row_number() over (partition by application, schemas_type order by revision_history_id) as n
  from {fx_history}),
seed as ({SEED}),
step(application, schemas_type, n, revision_history_id, expected_revision, revision, accepted, stored) as (
  select p.application, p.schemas_type, p.n, p.revision_history_id, p.expected_revision, p.revision,
         s.revision is not distinct from p.expected_revision,
         case when s.revision is not distinct from p.expected_revision then p.revision else s.revision end
  from p left join seed s on s.application = p.application and s.schemas_type = p.schemas_type
  where p.n = 1
  union all
  select p.application, p.schemas_type, p.n, p.revision_history_id, p.expected_revision, p.revision,
         t.stored is not distinct from p.expected_revision,
         case when t.stored is not distinct from p.expected_revision then p.revision else t.stored end
  from step t join p on p.application = t.application and p.schemas_type = t.schemas_type and p.n = t.n + 1
)
select application, schemas_type, revision_history_id, expected_revision, revision, accepted,
       stored as stored_after from step
"""
_NO_SEED = "select null as application, null as schemas_type, cast(null as varchar) as revision where false"


def _guard(fx, seed):
    root, out = ls.scratch(fx.spark, "guard-ledger"), ls.scratch(fx.spark, "guard")
    if seed is not None:
        rows = seed.select("revision_history_id", "application", "schemas_type", "revision")
        ledger_io.commit_batch(root, 0, rows.drop("revision_history_id"), rows)
    _in_arrivals(fx, "guard-input", lambda pushes: ls.stream_guard(
        guard_pushes(pushes), root, out, out + "-checkpoint"))
    return fx.spark.read.schema(ls.GUARD_OUT).parquet(out).drop("batch_id")


@query("stream_guard", ("fx_history",), _GUARD_SQL.replace("{SEED}", _NO_SEED))
def stream_guard(fx):
    """Guarded push per key into an empty ledger, over several micro-batches (K2)."""
    return _guard(fx, None)


@query("stream_guard_seeded", ("fx_history", "fx_current"),
       _GUARD_SQL.replace("{SEED}", "select application, schemas_type, revision from {fx_current}"))
def stream_guard_seeded(fx):
    """Guarded push per key onto the revisions that a ledger already stores (K2)."""
    return _guard(fx, fx["fx_current"])

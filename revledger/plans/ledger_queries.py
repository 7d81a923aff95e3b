"""Ledger queries over the fixture ledger (fx_history / fx_current / fx_pushes / fx_batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from revledger.functions.keys import file_safe_key, ident_key
from revledger.operators import checks, ledger
from revledger.plans.registry import query

LEDGER_COLS = ["revision_history_id", "application", "schemas_type", "datetime", "revision", "comment"]


@query("ledger_latest", ("fx_history",), """
select revision_history_id, application, schemas_type, datetime, revision, comment
from (select *, row_number() over (partition by application, schemas_type
                                   order by revision_history_id desc) as k
      from {fx_history}) x
where k = 1
""")
def ledger_latest(fx):
    """Newest history row per key."""
    return ledger.latest(fx["fx_history"])


@query("ledger_fetch", ("fx_history", "fx_current"), """
select k.application, k.schemas_type, c.revision, c.comment
from (select distinct application, schemas_type from {fx_history}) k
left join {fx_current} c on c.application = k.application and c.schemas_type = k.schemas_type
""")
def ledger_fetch(fx):
    """Stored revision and comment for every key ever pushed; NULL where none is stored."""
    return ledger.fetch(fx["fx_current"], fx["fx_history"])


@query("ledger_transitions", ("fx_history",), """
select application, schemas_type, revision_history_id,
       lag(revision) over (partition by application, schemas_type order by revision_history_id) as from_revision,
       revision as to_revision
from {fx_history}
""")
def ledger_transitions(fx):
    """History as (previous revision -> revision) hops per key, in id order."""
    return ledger.transitions(fx["fx_history"])


@query("pattern_reject", ("fx_history",), """
select revision_history_id, revision,
       case when coalesce(revision ilike 'PRE-%', false) then 'rejected' else 'accepted' end as status
from {fx_history}
""")
def pattern_reject(fx):
    """Banned revision pattern: rows matching PRE-% (ILIKE) rejected, the rest accepted."""
    ok, rejected = checks.split_by_pattern(fx["fx_history"], "revision", "PRE-%")
    cols = ["revision_history_id", "revision"]
    return ok.select(*cols, F.lit("accepted").alias("status")).unionByName(
        rejected.select(*cols, F.lit("rejected").alias("status")))


@query("ident_key", ("fx_history",), """
select distinct application, schemas_type,
       lower(replace(concat(application, '-', revision), '-', '_')) as app_ident,
       replace(replace(concat(application, '/', schemas_type, '.', revision), '/', '-'), '.', '-') as file_key
from {fx_history}
""")
def ident_key_q(fx):
    """Identifier and file-safe keys of ledger names (F1, F2)."""
    h = fx["fx_history"]
    return h.select(
        "application", "schemas_type",
        ident_key(F.concat_ws("-", "application", "revision")).alias("app_ident"),
        file_safe_key(F.concat(F.col("application"), F.lit("/"), F.col("schemas_type"),
                               F.lit("."), F.col("revision"))).alias("file_key"),
    ).distinct()


@query("ledger_clean", ("fx_current", "fx_pushes"), """
select c.* from {fx_current} c
where not exists (select 1 from {fx_pushes} b
                  where b.application = c.application and b.schemas_type = c.schemas_type)
""")
def ledger_clean(fx):
    """Current rows left after cleaning the batch keys."""
    return ledger.clean(fx["fx_current"], fx["fx_pushes"])


_PUSH_SQL = """
select cast(m.top + row_number() over (order by a.application, a.schemas_type) as bigint) as revision_history_id,
       a.application, a.schemas_type, a.revision, a.comment, 'pushed' as status
from (select b.* from {fx_pushes} b
      where not exists (select 1 from bad where bad.application = b.application
                                            and bad.schemas_type = b.schemas_type)) a,
     (select max(revision_history_id) as top from {fx_history_before}) m
union all
select cast(null as bigint), b.application, b.schemas_type, b.revision, b.comment, 'conflict'
from {fx_pushes} b
where exists (select 1 from bad where bad.application = b.application and bad.schemas_type = b.schemas_type)
"""


@query("ledger_push", ("fx_current_old", "fx_pushes", "fx_history_before"), """
with bad as (select application, schemas_type from {fx_pushes} group by application, schemas_type
             having count(*) > 1
             union
             select application, schemas_type from {fx_current_old})
""" + _PUSH_SQL)
def ledger_push(fx):
    """Push a batch without cleaning: new history rows with dense ids; pushes
    of stored keys and of keys repeated in the batch are conflicts (T1, T5)."""
    _, appended, conflicts = ledger.push(fx["fx_current_old"], fx["fx_history_before"], fx["fx_pushes"])
    cols = ["revision_history_id", "application", "schemas_type", "revision", "comment"]
    return appended.select(*cols, F.lit("pushed").alias("status")).unionByName(
        conflicts.select(F.lit(None).cast("bigint").alias("revision_history_id"),
                         *cols[1:], F.lit("conflict").alias("status")))


@query("ledger_replace", ("fx_current", "fx_pushes", "fx_history_before"), """
with bad as (select application, schemas_type from {fx_pushes} group by application, schemas_type
             having count(*) > 1)
select revision_history_id, application, schemas_type, datetime, revision, comment
from {fx_current} c
where not exists (select 1 from {fx_pushes} b
                  where b.application = c.application and b.schemas_type = c.schemas_type)
union all
select cast(m.top + row_number() over (order by a.application, a.schemas_type) as bigint),
       a.application, a.schemas_type, a.datetime, a.revision, a.comment
from (select b.* from {fx_pushes} b
      where not exists (select 1 from bad where bad.application = b.application
                                            and bad.schemas_type = b.schemas_type)) a,
     (select max(revision_history_id) as top from {fx_history_before}) m
""")
def ledger_replace(fx):
    """Clean-then-push of a batch: the current table afterwards; keys repeated
    in the batch are cleaned but not pushed (T2)."""
    new_current, _, _ = ledger.replace(fx["fx_current"], fx["fx_history_before"], fx["fx_pushes"])
    return new_current.select(*LEDGER_COLS)


@query("revision_guard", ("fx_current", "fx_pushes"), """
select b.application, b.schemas_type, b.revision as expected_revision, c.revision as stored_revision
from {fx_pushes} b left join {fx_current} c
  on c.application = b.application and c.schemas_type = b.schemas_type
where c.revision is distinct from b.revision
""")
def revision_guard(fx):
    """Pushes whose key has a stored revision distinct from the expected one."""
    return ledger.guard(fx["fx_current"], fx["fx_pushes"])


@query("ledger_drift", ("fx_history_kinds",), """
with v as (select * from (select *, row_number() over (partition by application, schemas_type
                                                       order by revision_history_id desc) k
                          from {fx_history_kinds} where kind = 'var') x where k = 1),
     f as (select * from (select *, row_number() over (partition by application, schemas_type
                                                       order by revision_history_id desc) k
                          from {fx_history_kinds} where kind = 'func') x where k = 1),
     j as (select coalesce(v.application, f.application) as application,
                  coalesce(v.schemas_type, f.schemas_type) as schemas_type,
                  v.revision as v_rev, v.comment as v_com, f.revision as f_rev, f.comment as f_com
           from v full outer join f on v.application = f.application and v.schemas_type = f.schemas_type)
select application, schemas_type, 'both' as kind, v_rev as revision, v_com as comment from j
where v_rev is not distinct from f_rev and v_com is not distinct from f_com
union all
select application, schemas_type, 'var', v_rev, v_com from j
where not (v_rev is not distinct from f_rev and v_com is not distinct from f_com)
union all
select application, schemas_type, 'func', f_rev, f_com from j
where not (v_rev is not distinct from f_rev and v_com is not distinct from f_com)
""")
def ledger_drift(fx):
    """Var / func comparison per key: one row when equal, else one per side."""
    h = fx["fx_history_kinds"]
    var = ledger.latest(h.filter(F.col("kind") == "var").drop("kind"))
    func = ledger.latest(h.filter(F.col("kind") == "func").drop("kind"))
    return ledger.drift(var, func)


@query("ledger_store_fetch", ("fx_current", "fx_batch"), """
select b.application, b.schemas_type, b.revision, b.comment from {fx_batch} b
union all
select c.application, c.schemas_type, c.revision, c.comment from {fx_current} c
where not exists (select 1 from {fx_batch} b where b.application = c.application
                                               and b.schemas_type = c.schemas_type)
""")
def ledger_store_fetch(fx):
    """Ledger on storage (S1, P1): the current table is committed as batch 0,
    an empty batch as batch 1, and the newer pushes replace their keys as
    batch 2 (touched buckets only); then every key is fetched."""
    from revledger.sources import ledger_io
    from revledger.streaming.ledger_stream import scratch

    key = ["application", "schemas_type"]
    root = scratch(fx.spark, "ledger")
    current, batch = fx["fx_current"], fx["fx_batch"]
    ledger_io.commit_batch(root, 0, current, current, key=key)
    ledger_io.commit_batch(root, 1, current.limit(0), current.limit(0), key=key, buckets=[])
    buckets = ledger_io.touched_buckets(batch)
    stored = ledger_io.read_current(fx.spark, root, current.schema, 2, buckets)
    ledger_io.commit_batch(root, 2, ledger.clean(stored, batch, key).unionByName(batch), batch,
                           key=key, buckets=buckets)
    keys = current.select(*key).union(batch.select(*key))
    return ledger_io.fetch_stored(fx.spark, root, keys, current.schema, key=key)

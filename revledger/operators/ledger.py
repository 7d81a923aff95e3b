"""Revision-ledger algebra: fetch, clean, latest, guard, drift, transitions,
push and clean-then-push (S1/P1, P2, A5/W1, J2, J7, W3, T1, T2).

A ledger is two DataFrames: ``current`` (one row per key) and ``history``
(append-only, ordered by ``revision_history_id``). Timestamps of one push
tie by design, so history order is always the id, never ``datetime``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revledger.operators.joins import maybe_broadcast
from revledger.operators.sequence import assign_ids, previous_in_group

KEY = ("application", "schemas_type")
ID = "revision_history_id"


def _stored_rows(current: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Current rows of ``keys`` only. The key set is broadcast when its size
    is checked small, so the (large) current table is filtered where it is
    read instead of being shuffled."""
    return current.join(maybe_broadcast(keys), key, "left_semi").select(*current.columns)


def fetch(current: DataFrame, keys: DataFrame, key=KEY) -> DataFrame:
    """Stored (revision, comment) for many keys at once; NULLs for a key with
    no stored row. Current is first cut down to the requested keys, then
    the keys are left-joined to that small remainder."""
    key = list(key)
    k = keys.select(*key).distinct()
    c = _stored_rows(current, k, key).select(*key, "revision", "comment")
    return k.join(c, key, "left")


def clean(current: DataFrame, keys: DataFrame, key=KEY) -> DataFrame:
    """Current rows that remain after deleting ``keys`` (history untouched)."""
    key = list(key)
    kept = current.join(maybe_broadcast(keys.select(*key).distinct()), key, "left_anti")
    return kept.select(*current.columns)


def latest(history: DataFrame, key=KEY, order: str = ID) -> DataFrame:
    """Newest history row per key. ``max_by`` is a hash aggregate with a
    map-side partial step, so a hot key is pre-reduced in every task
    before the shuffle (unlike a window, which ships all its rows to one)."""
    key = list(key)
    rest = [c for c in history.columns if c not in key]
    agg = history.groupBy(*key).agg(
        F.max_by(F.struct(*[F.col(c) for c in rest]), F.col(order)).alias("_row")
    )
    return agg.select(*key, "_row.*").select(*history.columns)


def guard(current: DataFrame, expected: DataFrame, key=KEY,
          expected_col: str = "revision") -> DataFrame:
    """Keys whose stored revision ``is distinct from`` the expected one. A
    missing stored row equals an expected NULL."""
    key = list(key)
    e = expected.select(*key, F.col(expected_col).alias("expected_revision"))
    c = _stored_rows(current, e.select(*key).distinct(), key).select(
        *key, F.col("revision").alias("stored_revision"))
    j = e.join(c, key, "left")
    return j.filter(~F.col("stored_revision").eqNullSafe(F.col("expected_revision")))


def drift(var_latest: DataFrame, func_latest: DataFrame, key=KEY) -> DataFrame:
    """Var / func comparison per key: one ``both`` row when revision and
    comment are equal (NULL = NULL), else one ``var`` and one ``func`` row;
    a side with no row reports NULLs."""
    key = list(key)
    v = var_latest.select(*key, F.col("revision").alias("v_rev"), F.col("comment").alias("v_com"))
    f = func_latest.select(*key, F.col("revision").alias("f_rev"), F.col("comment").alias("f_com"))
    j = v.join(f, key, "full_outer")
    same = F.col("v_rev").eqNullSafe(F.col("f_rev")) & F.col("v_com").eqNullSafe(F.col("f_com"))
    sides = F.when(same, F.array(F.lit("both"))).otherwise(F.array(F.lit("var"), F.lit("func")))
    out = j.select(*key, "v_rev", "v_com", "f_rev", "f_com", F.explode(sides).alias("kind"))
    is_func = F.col("kind") == "func"
    return out.select(
        *key, "kind",
        F.when(is_func, F.col("f_rev")).otherwise(F.col("v_rev")).alias("revision"),
        F.when(is_func, F.col("f_com")).otherwise(F.col("v_com")).alias("comment"),
    )


def transitions(history: DataFrame, key=KEY, order: str = ID) -> DataFrame:
    """History read as hops: (previous revision -> revision) per key, in id
    order; the first row of a key has a NULL previous revision."""
    key = list(key)
    out = previous_in_group(history, key, [order], ["revision"], prefix="prev_")
    return out.select(*key, order, F.col("prev_revision").alias("from_revision"),
                      F.col("revision").alias("to_revision"))


def _next_id(history: DataFrame) -> int:
    top = history.agg(F.max(ID).alias("m")).first()["m"]
    return 1 if top is None else int(top) + 1


def push(current: DataFrame, history: DataFrame, batch: DataFrame, key=KEY, now=None):
    """Insert ``batch`` into the ledger.

    A batch row whose key is already stored, or whose key appears twice in
    the batch, is a conflict (the primary key refuses it); it is returned,
    not applied. Accepted rows enter ``current`` and get history ids after
    the largest existing one, in key order.

    Returns (new_current, appended_history, conflicts)."""
    key = list(key)
    cols = [c for c in batch.columns if c != ID]
    b = batch.select(*cols)
    if now is not None:
        b = b.withColumn("datetime", F.lit(now))
    dup = b.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*key)
    stored = _stored_rows(current.select(*key), b.select(*key).distinct(), key)
    bad_keys = dup.unionByName(stored).distinct()
    conflicts = b.join(bad_keys, key, "left_semi").select(*b.columns)
    accepted = b.join(bad_keys, key, "left_anti").select(*b.columns)
    appended = assign_ids(accepted, key, ID, _next_id(history)).select(ID, *cols)
    new_current = current.unionByName(appended.select(*current.columns), allowMissingColumns=False)
    return new_current, appended, conflicts


def replace(current: DataFrame, history: DataFrame, batch: DataFrame, key=KEY, now=None):
    """Clean-then-push (T2): the batch replaces the stored rows of its keys
    and extends the history. Returns (new_current, appended_history,
    conflicts); only a key repeated inside the batch can conflict."""
    key = list(key)
    kept = clean(current, batch, key)
    new_current, appended, conflicts = push(kept, history, batch, key, now)
    return new_current, appended, conflicts


def replay_steps(current: DataFrame, history: DataFrame, rows: DataFrame, step: str, key=KEY, now=None):
    """Clean, push, clean, push, ...: many rows of a key, each replacing the
    one before, as an upgrade pushes its hops (G3, T1, T2).

    One pass over all keys: history ids follow the largest existing one in
    (key, ``step``) order, and the last step of a key replaces its stored
    row. A key with two rows of one step has no defined order; all its rows
    are conflicts, returned and not applied. ``now`` is one stamp for the
    whole batch. Returns (new_current, appended_history, conflicts)."""
    key = list(key)
    if now is not None:
        rows = rows.withColumn("datetime", F.lit(str(now)).cast(current.schema["datetime"].dataType))
    tied = rows.groupBy(*key, step).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*key).distinct()
    conflicts = rows.join(tied, key, "left_semi").select(*rows.columns)
    accepted = rows.join(tied, key, "left_anti").select(*rows.columns)
    appended = assign_ids(accepted, [*key, step], ID, _next_id(history))
    last = latest(appended, key).select(*current.columns)
    new_current = clean(current, last, key).unionByName(last)
    return new_current, appended.select(ID, *[c for c in rows.columns if c != step]), conflicts

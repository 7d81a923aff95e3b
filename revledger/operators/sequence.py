"""Dense numbering without a single-partition window (T5, and positions for
W2 / W3 / A6 / O1).

``row_number() over (partition by g order by o)`` sends every row of one
group to one task, and without ``partition by`` it sends the whole table to
one task. That is kept only for groups whose size is checked to be under a
limit. Rows of hot groups (and a global numbering) are range-partitioned
on (group, order) instead, so a hot group is spread over many partitions; each partition reports one small
summary row per group it holds, and prefix sums over those summaries (at
most one row per partition per group) give every row its offset.

Partition ids and in-partition positions are fixed in a written table
before they are used twice, so a recomputed task cannot hand out
different numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revledger.session import limit_conf, shuffles_dropped, written

_PID, _POS, _N, _FIRST, _OFF = "_sq_pid", "_sq_pos", "_sq_n", "_sq_first", "_sq_off"


def _cols(names) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def _tag(df: DataFrame, sort_cols: list[Column]) -> DataFrame:
    ordered = df.repartitionByRange(*sort_cols).sortWithinPartitions(*sort_cols)
    pid = F.spark_partition_id().cast("long")
    tagged = ordered.withColumn(_PID, pid).withColumn(
        _POS, F.monotonically_increasing_id() - F.shiftleft(pid, 33)
    )
    return written(tagged, "numbered")


def _null_safe_on(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


# groups with more rows than this are numbered by range partitioning; the
# rest by a window partitioned on the group (each such task is bounded)
GROUP_ROW_LIMIT = 1_000_000


def split_hot(df: DataFrame, group_cols: list[str], group_row_limit: int):
    """(hot_rows, cold_rows) by group size, or (None, df) when no group is
    over the limit. Hot groups number at most rows / limit, so their key
    list is broadcast (no shuffle of ``df`` for the split). Measuring the
    groups reads only the group columns (column pruning), so the input is
    not copied; a caller whose input is costly to recompute should
    checkpoint it first."""
    sizes = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_sq_size"))
    with shuffles_dropped(df.sparkSession):
        largest = sizes.agg(F.max("_sq_size").alias("m")).first()["m"]
    if largest is None or largest <= group_row_limit:
        return None, df
    hot = sizes.filter(F.col("_sq_size") > group_row_limit).select(*group_cols)
    hot = hot.checkpoint(eager=True)
    hk = F.broadcast(hot.select(*[F.col(g).alias(f"_hk_{g}") for g in group_cols]))
    on = reduce(lambda a, b: a & b, [df[g].eqNullSafe(hk[f"_hk_{g}"]) for g in group_cols])
    return df.join(hk, on, "left_semi"), df.join(hk, on, "left_anti")


def number_rows(df: DataFrame, group_cols: list[str], order_cols: list, out_col: str,
                start: int = 1, group_row_limit: int | None = None) -> DataFrame:
    """Add ``out_col`` = start, start+1, … within each group in ``order_cols``
    order (the order must be total inside a group for a repeatable result).

    Group sizes are counted first (a partial aggregate). Hot groups, those
    over ``group_row_limit`` rows, are numbered by range partitioning. All
    other groups use ``row_number`` over a window partitioned by the group,
    which never holds more than the limit."""
    group_cols = list(group_cols)
    if not group_cols:
        return _number_by_range(df, [], order_cols, out_col, start)
    if group_row_limit is None:
        group_row_limit = limit_conf(df.sparkSession, "groupRowLimit", GROUP_ROW_LIMIT)
    hot_rows, cold_rows = split_hot(df, group_cols, group_row_limit)
    w = Window.partitionBy(*group_cols).orderBy(*_cols(order_cols))
    cold = cold_rows.withColumn(out_col, (F.row_number().over(w) + F.lit(start - 1)).cast("long"))
    if hot_rows is None:
        return cold
    return cold.unionByName(_number_by_range(hot_rows, group_cols, order_cols, out_col, start))


def _number_by_range(df: DataFrame, group_cols: list[str], order_cols: list, out_col: str,
                     start: int) -> DataFrame:
    tagged = _tag(df, _cols(group_cols) + _cols(order_cols))
    summary = tagged.groupBy(_PID, *group_cols).agg(
        F.count(F.lit(1)).alias(_N), F.min(_POS).alias(_FIRST)
    )
    w = Window.partitionBy(*group_cols).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = summary.select(
        _PID, *group_cols, _FIRST, F.coalesce(F.sum(_N).over(w), F.lit(0)).alias(_OFF)
    )
    if group_cols:
        on = _null_safe_on(tagged, offsets, [_PID] + group_cols)
        joined = tagged.join(offsets, on, "inner").select(
            tagged["*"], offsets[_FIRST], offsets[_OFF]
        )
    else:
        # one summary row per partition: a proven bound, so broadcast it
        joined = tagged.join(F.broadcast(offsets), _PID)
    numbered = joined.withColumn(
        out_col, (F.col(_OFF) + F.col(_POS) - F.col(_FIRST) + F.lit(start)).cast("long")
    )
    return numbered.drop(_PID, _POS, _FIRST, _OFF)


def assign_ids(df: DataFrame, order_cols: list, id_col: str, start: int) -> DataFrame:
    """Dense ids ``start, start+1, …`` in ``order_cols`` order (T5)."""
    return number_rows(df, [], order_cols, id_col, start=start)


def previous_in_group(df: DataFrame, group_cols: list[str], order_cols: list,
                      value_cols: list[str], prefix: str = "prev_",
                      group_row_limit: int | None = None) -> DataFrame:
    """``lag`` of ``value_cols`` inside each group. Groups under the limit
    use ``lag`` over a window partitioned by the group. Hot groups are
    numbered by range and joined to themselves on (group, n) = (group,
    n + 1): both sides hash-partition on the row number, so a hot group
    does not land in one task."""
    group_cols = list(group_cols)
    if group_row_limit is None:
        group_row_limit = limit_conf(df.sparkSession, "groupRowLimit", GROUP_ROW_LIMIT)
    hot_rows, cold_rows = split_hot(df, group_cols, group_row_limit)
    w = Window.partitionBy(*group_cols).orderBy(*_cols(order_cols))
    cold = cold_rows.select("*", *[F.lag(v).over(w).alias(prefix + v) for v in value_cols])
    if hot_rows is None:
        return cold
    seq = "_sq_seq"
    numbered = _number_by_range(hot_rows, group_cols, order_cols, seq, 1)
    prev = numbered.select(
        *[F.col(g).alias(f"_pg_{g}") for g in group_cols],
        (F.col(seq) + 1).alias("_pg_seq"),
        *[F.col(v).alias(prefix + v) for v in value_cols],
    )
    on = [numbered[seq] == prev["_pg_seq"]] + [
        numbered[g].eqNullSafe(prev[f"_pg_{g}"]) for g in group_cols
    ]
    hot = numbered.join(prev, reduce(lambda a, b: a & b, on), "left")
    hot = hot.drop("_pg_seq", seq, *[f"_pg_{g}" for g in group_cols])
    return cold.unionByName(hot)

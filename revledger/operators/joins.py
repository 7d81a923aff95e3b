"""Join strategies with a checked size bound.

``broadcast()`` is only used behind a measured size: a side that is proven
small in rows and bytes is broadcast; otherwise the keys of a many-to-many
join whose pairs are too many for one task (a host type, say) are found by
counting, and only those are spread over as many tasks as their size needs.

The size is measured while the side is written once to the checkpoint
folder, each task counting what it writes. No row passes through a single
task, and the side is not computed again, whichever way the join then goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

from revledger.operators.sequence import number_rows
from revledger.session import ensure_checkpoint_dir, limit_conf, shuffles_dropped, written

# a side with at most this many rows and bytes is broadcast
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
# pairs of one key that one task of a join makes
PAIR_LIMIT = 1_000_000
# pairs that one task of a broadcast join makes
TASK_PAIRS = 4_000_000
# rows of the big side that one block of a broadcast join holds
BLOCK_ROWS = 256


def _width(name: str, kind: DataType) -> Column:
    """Bytes of a value: of a text or binary those it has, of a number or time
    eight, of anything nested those of its JSON."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.coalesce(F.length(F.to_json(F.struct(c))), F.lit(0))
    return F.lit(8)


def measured(df: DataFrame) -> tuple[DataFrame, int, int]:
    """(``df`` as written to the checkpoint folder, rows, bytes of its values
    plus eight for each)."""
    ensure_checkpoint_dir(df.sparkSession)
    width = F.lit(8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        width = width + _width(f.name, f.dataType)
    obs = Observation()
    fixed = df.observe(obs, F.count(F.lit(1)).alias("rows"), F.sum(width).alias("bytes")).checkpoint(eager=True)
    return fixed, obs.get["rows"], obs.get["bytes"] or 0


def fits(spark: SparkSession, rows: int, size: int, max_rows: int | None = None) -> bool:
    """Whether a side of so many rows and bytes is under the broadcast limits."""
    if max_rows is None:
        max_rows = limit_conf(spark, "broadcastRows", BROADCAST_ROWS)
    return rows <= max_rows and size <= limit_conf(spark, "broadcastBytes", BROADCAST_BYTES)


def sized(df: DataFrame, max_rows: int | None = None) -> tuple[DataFrame, bool]:
    """(``df`` written once, whether it is under the broadcast limits)."""
    fixed, rows, size = measured(df)
    return fixed, fits(df.sparkSession, rows, size, max_rows)


def bounded(df: DataFrame, max_rows: int | None = None) -> DataFrame | None:
    """``df`` written once when it is under the broadcast limits, else None."""
    fixed, small = sized(df, max_rows)
    return fixed if small else None


def maybe_broadcast(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """``df`` written once; marked for broadcast when proven small."""
    fixed, small = sized(df, max_rows)
    return F.broadcast(fixed) if small else fixed


def split_join(big: DataFrame, small: DataFrame, big_key: str, small_key: str, salt_of: Column,
               how: str = "inner") -> DataFrame:
    """Equi-join ``big[big_key] = small[small_key]`` (inner or left) by
    shuffle, in which a heavy key is no task of its own.

    Rows are counted for each key on both sides, by a partial aggregate that
    reads the key alone. A key with more pairs than the limit gets a fan-out
    of pairs / limit: its ``big`` rows are dealt over so many parts by
    ``salt_of`` (a hash of a unique column) and its ``small`` rows repeated
    for each part. There are at most output / limit such keys; their fan-outs
    are joined to both sides, by broadcast when measured small. All other
    rows are neither salted nor repeated."""
    limit = limit_conf(big.sparkSession, "pairLimit", PAIR_LIMIT)
    left = big.groupBy(F.col(big_key).alias("_key")).agg(F.count(F.lit(1)).alias("_nb"))
    right = small.groupBy(F.col(small_key).alias("_key")).agg(F.count(F.lit(1)).alias("_ns"))
    pairs = F.col("_nb").cast("double") * F.col("_ns")
    heavy = maybe_broadcast(left.join(right, "_key").filter(pairs > limit).select(
        "_key", F.least(F.ceil(pairs / limit), F.col("_nb")).alias("_parts")))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    b = big.join(heavy, big[big_key] == heavy["_key"], "left").withColumn(
        "_salt", F.pmod(salt_of, parts)).drop("_key", "_parts")
    s = small.join(heavy, small[small_key] == heavy["_key"], "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_key", "_parts")
    joined = b.join(s, (b[big_key] == s[small_key]) & (b["_salt"] == s["_salt"]), how)
    return joined.drop(b["_salt"]).drop(s["_salt"])


def blocked_join(big: DataFrame, small: DataFrame, big_key: str, small_key: str, order=()) -> DataFrame | None:
    """Inner equi-join with ``small`` broadcast, for pairs of more than one
    task; None when one task makes them all (counted from the keys alone).

    ``big`` is cut into blocks of rows of one key, in ``order``, each of as
    many rows as one task makes pairs of. Blocks are dealt evenly over as
    many tasks as the pairs need, whatever the files ``big`` is read from: a
    file that is one task's to read may have pairs for a thousand. A task
    lays out a block row of ``small`` by row of ``small``, with all rows of
    the block beside it: columns of ``small`` are long runs of one value and
    those of ``big`` repeat block by block, so that a table of all pairs takes
    a small part of the room of one where every row differs from the last."""
    limit = limit_conf(big.sparkSession, "taskPairs", TASK_PAIRS)
    left = big.groupBy(F.col(big_key).alias("_key")).agg(F.count(F.lit(1)).alias("_nb"))
    right = small.groupBy(F.col(small_key).alias("_key")).agg(F.count(F.lit(1)).alias("_ns"))
    with shuffles_dropped(big.sparkSession):
        pairs = left.join(F.broadcast(right), "_key").agg(
            F.sum(F.col("_nb").cast("double") * F.col("_ns")).alias("n")).first()["n"] or 0
    if pairs <= limit:
        return None
    per = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(limit) / F.col("_ns"))))
    row = F.struct(*[big[c] for c in big.columns]).alias("_row")
    met = big.join(F.broadcast(right), big[big_key] == right["_key"]).select(
        "_key", per.alias("_per"), *[big[c].alias(f"_by{i}") for i, c in enumerate(order)], row)
    met = written(met, "met")
    placed = number_rows(met, ["_key"], [f"_by{i}" for i in range(len(order))] or ["_key"], "_at")
    block = F.floor((F.col("_at") - 1) / F.col("_per"))
    blocks = placed.groupBy("_key", block.alias("_block")).agg(F.collect_list("_row").alias("_rows"))
    blocks = written(blocks.select("_key", "_rows"), "blocks").repartition(int(-(-pairs // limit)))
    out = blocks.join(F.broadcast(small), blocks["_key"] == small[small_key]).select(
        *[small[c] for c in small.columns], F.explode("_rows").alias("_row"))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in big.columns], *[out[c] for c in small.columns])


def fanout_join(big: DataFrame, small: DataFrame, big_key: str, small_key: str,
                salt_of: Column, how: str = "inner", max_rows: int | None = None,
                force_salt: bool = False, order=()) -> DataFrame:
    """Equi-join ``big[big_key] = small[small_key]`` where both sides may hold
    many rows per key: ``small`` is broadcast when it is under the limits, and
    ``big`` dealt by the number of pairs (:func:`blocked_join`, in blocks that
    follow ``order``; an outer join is not); otherwise the heavy keys are split
    (:func:`split_join`)."""
    if not force_salt:
        small, fits_in = sized(small, max_rows)
        if fits_in:
            found = blocked_join(big, small, big_key, small_key, order) if how == "inner" else None
            if found is None:
                found = big.join(F.broadcast(small), big[big_key] == small[small_key], how)
            return found
    return split_join(big, small, big_key, small_key, salt_of, how)

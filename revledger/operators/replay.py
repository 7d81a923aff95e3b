"""Guarded replay of many pushes of a key (J2, K2) as a parallel prefix.

A push says "if the stored revision is E, make it R". Whether it is accepted
depends on every push before it, but the state is a single value: after an
accepted push the stored revision is its R, and the next accepted push is the
next one that expects that R. So the accepted pushes of a key are one path
along ``next`` pointers, and a path is found by doubling the pointers instead
of by walking it.

The same is done on two levels. Inside a chunk of a key's rows, on arrays: the
pointers are one sorted search, and marks spread along them in as many steps
as the logarithm of the chunk. A chunk is then a map of the stored revision
before it to that after it, given for the values that any of its pushes
expects; it leaves all others alone. Keys of several chunks are joined up by
Spark: an entry of a map points to the next later chunk with an entry for its
result, the entries on the path from the ledger's revision are found by
doubling again, and every chunk is replayed with the revision that it starts
from. So the rows of one key, however many, are dealt over tasks by chunk.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revledger.operators.sequence import number_rows, split_hot
from revledger.session import ensure_checkpoint_dir, limit_conf, ship_package, written

EXPECTED, REVISION, STORED = "expected_revision", "revision", "_stored"
_CHUNK, _N, _IN, _OUT, _NEXT = "_rp_chunk", "_rp_n", "_rp_in", "_rp_out", "_rp_next"

#: rows of a key that one task replays as a whole
GUARD_CHUNK_ROWS = 65_536


# ---------------------------------------------------------------------------
# one chunk or several, as arrays


class _Rows:
    """Whole chunks of a sorted table: number of each row's chunk, first row
    of each, and the revisions as numbers (equal ones alike, NULL is one)."""

    def __init__(self, table: pa.Table, key: list[str]):
        self.n = table.num_rows
        self.first = np.flatnonzero(_changes(table, key))
        self.chunk = np.cumsum(_changes(table, key)) - 1
        names = [c for c in (EXPECTED, REVISION, STORED) if c in table.column_names]
        coded = pa.chunked_array([a for c in names for a in table.column(c).chunks],
                                 type=table.schema.field(REVISION).type).combine_chunks().dictionary_encode()
        self.values = coded.dictionary
        codes = pc.fill_null(coded.indices, len(self.values)).to_numpy(zero_copy_only=False).astype(np.int64)
        for name, c in zip(names, np.split(codes, len(names))):
            setattr(self, name, c)
        # expecting rows in the order (chunk, value, row), as one number each
        self.kinds = len(self.values) + 1
        own = self.place(self.chunk, self.expected_revision) + np.arange(self.n)
        self.expecting = np.sort(own)

    def place(self, chunk, value):
        return (chunk * self.kinds + value) * (self.n + 1)

    def next_expecting(self, chunk, value, after):
        """The first row of ``chunk`` later than ``after`` that expects
        ``value``; n if there is none."""
        base = self.place(chunk, value)
        at = np.searchsorted(self.expecting, base + after, side="right")
        found = np.append(self.expecting, np.iinfo(np.int64).max)[at]
        return np.where(found < base + self.n + 1, found - base, self.n)

    def following(self):
        """For each row, the row accepted next if it is; n at the end."""
        return np.append(self.next_expecting(self.chunk, self.revision, np.arange(self.n)), self.n)

    def text(self, codes) -> pa.Array:
        return self.values.take(pa.array(codes, mask=codes == len(self.values)))


def _changes(table: pa.Table, key: list[str]) -> np.ndarray:
    """Where a row's key differs from the row before (NULL equals NULL)."""
    out = np.zeros(table.num_rows, dtype=bool)
    out[:1] = True
    for k in key:
        codes = pc.fill_null(table.column(k).combine_chunks().dictionary_encode().indices, -1)
        codes = codes.to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]
    return out


def _whole_chunks(batches, key: list[str]):
    """Tables of whole chunks out of sorted batches."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        starts = np.flatnonzero(_changes(rest, key))
        if len(starts) > 1:
            yield rest.slice(0, int(starts[-1]))
            rest = rest.slice(int(starts[-1]))
    if rest is not None and rest.num_rows:
        yield rest


def accepted_rows(rows: _Rows) -> np.ndarray:
    """Rows on the path from each chunk's stored revision."""
    mark = np.zeros(rows.n + 1, dtype=bool)
    k = np.arange(len(rows.first))
    mark[rows.next_expecting(k, rows._stored[rows.first], rows.first - 1)] = True
    jump, known = rows.following(), -1
    while (marked := int(mark[:-1].sum())) > known:
        known = marked
        mark[jump[np.flatnonzero(mark)]] = True
        jump = jump[jump]
    return mark[:-1]


def _replay(key: list[str]):
    def run(batches):
        for t in _whole_chunks(batches, key):
            rows = _Rows(t, key)
            ok = accepted_rows(rows)
            last = np.maximum.accumulate(np.where(ok, np.arange(rows.n), -1))
            own = last >= rows.first[rows.chunk]
            after = np.where(own, rows.revision[last], rows._stored)
            out = t.drop_columns([STORED]).append_column("accepted", pa.array(ok)).append_column(
                "stored_after", rows.text(after))
            yield from out.combine_chunks().to_batches()
    return run


def _maps(key: list[str]):
    """The map of each chunk: (key, in, out) for each expected value."""
    def run(batches):
        for t in _whole_chunks(batches, key):
            rows = _Rows(t, key)
            end = rows.following()
            end = np.where(end == rows.n, np.arange(rows.n + 1), end)  # the last row of a path stays
            while (further := end[end]).tolist() != end.tolist():
                end = further
            order = np.argsort(rows.place(rows.chunk, rows.expected_revision), kind="stable")
            pair = rows.place(rows.chunk, rows.expected_revision)[order]
            first = order[np.append(True, pair[1:] != pair[:-1])]
            out = t.select(key).take(first)
            out = out.append_column(_IN, rows.text(rows.expected_revision[first]))
            out = out.append_column(_OUT, rows.text(rows.revision[end[first]]))
            yield from out.combine_chunks().to_batches()
    return run


# ---------------------------------------------------------------------------
# many keys


def _on(left: DataFrame, right: DataFrame, names) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right["r" + n]) for n in names])


def _joined(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on ``names``, NULL being equal to NULL, keeping left's columns."""
    r = right.select(*[F.col(c).alias("r" + c) if c in names else F.col(c) for c in right.columns])
    return left.join(r, _on(left, r, names), how).drop(*["r" + n for n in names])


def _coded(c) -> Column:
    """A revision as a value that is never NULL."""
    return F.coalesce(F.concat(F.lit("="), c), F.lit(""))


def _decoded(c) -> Column:
    return F.when(F.col(c) != "", F.substring(F.col(c), 2, 1 << 30))


def _ddl(df: DataFrame, *more: str) -> str:
    return ", ".join([f"`{n}` {t}" for n, t in df.dtypes] + list(more))


def replay(pushes: DataFrame, stored: DataFrame, key=("application", "schemas_type"),
           order: str = "revision_history_id", chunk_rows: int | None = None) -> DataFrame:
    """``pushes`` (key, ``order``, expected_revision, revision and any other
    columns), each with ``accepted`` and the revision ``stored_after`` it.

    ``stored`` has the revision of each key before the first push; a key
    without a row has NULL. Pushes of a key are taken in ``order``, which is
    unique in a key. NULL expects, and is, NULL."""
    spark = pushes.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    key = list(key)
    if chunk_rows is None:
        chunk_rows = limit_conf(spark, "guardChunkRows", GUARD_CHUNK_ROWS)
    hot, cold = split_hot(pushes, key, chunk_rows)
    seed = stored.select(*key, F.col(REVISION).alias(STORED))
    rows = _joined(cold, seed, key, "left")
    rows = rows.repartition(*key).sortWithinPartitions(*key, order)
    out = rows.mapInArrow(_replay(key), _ddl(pushes, "accepted boolean", "stored_after string"))
    if hot is None:
        return out
    chunk = key + [_CHUNK]
    placed = number_rows(hot, key, [order], _N, start=0, group_row_limit=chunk_rows)
    placed = written(placed.withColumn(_CHUNK, F.floor(F.col(_N) / chunk_rows)), "guard")
    starts = _chunk_starts(placed, seed, key)
    rows = _joined(placed, starts, chunk, "left").repartition(*chunk).sortWithinPartitions(*chunk, _N)
    done = rows.mapInArrow(_replay(chunk), _ddl(placed, "accepted boolean", "stored_after string"))
    return out.unionByName(done.select(*out.columns))


def _chunk_starts(placed: DataFrame, seed: DataFrame, key: list[str]) -> DataFrame:
    """(key, chunk, stored revision before it) of every chunk."""
    chunk, entry = key + [_CHUNK], key + [_CHUNK, _IN]
    dealt = placed.select(*chunk, _N, EXPECTED, REVISION)
    dealt = dealt.repartition(*chunk).sortWithinPartitions(*chunk, _N)
    maps = dealt.mapInArrow(_maps(chunk), _ddl(dealt.select(*chunk), f"{_IN} string", f"{_OUT} string"))
    maps = written(maps.select(*chunk, _coded(F.col(_IN)).alias(_IN), _coded(F.col(_OUT)).alias(_OUT)), "guard")
    chunks = placed.select(*chunk).distinct()
    seeds = written(_joined(chunks.select(*key).distinct(), seed, key, "left").select(
        *key, _coded(F.col(STORED)).alias(_OUT)), "guard")

    # the next later chunk that expects what a chunk (or the ledger: -1) left
    left = maps.select(*chunk, _OUT).distinct().unionByName(seeds.withColumn(_CHUNK, F.lit(-1).cast("long")))
    events = left.select(*key, F.col(_OUT).alias("_value"), _CHUNK, F.lit(0).alias("_wants")).unionByName(
        maps.select(*key, F.col(_IN).alias("_value"), _CHUNK, F.lit(1).alias("_wants")))
    w = (Window.partitionBy(*key, "_value").orderBy(F.col(_CHUNK).desc(), F.col("_wants"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    wanted = F.last(F.when(F.col("_wants") == 1, F.col(_CHUNK)), ignorenulls=True).over(w)
    pointers = written(events.select("*", wanted.alias(_NEXT)).filter("_wants = 0").select(
        *chunk, F.col("_value").alias(_OUT), _NEXT), "guard")

    # entries on the path: the first 2^k of them are known after k rounds
    reached = written(pointers.filter(F.col(_CHUNK) == -1).filter(F.col(_NEXT).isNotNull()).select(
        *key, F.col(_NEXT).alias(_CHUNK), F.col(_OUT).alias(_IN)), "guard")
    jump = written(_joined(maps, pointers, chunk + [_OUT]).select(*entry, _NEXT, _OUT).filter(
        F.col(_NEXT).isNotNull()), "guard")
    while True:
        further = _joined(reached, jump, entry).select(
            *key, F.col(_NEXT).alias(_CHUNK), F.col(_OUT).alias(_IN))
        further = written(further, "guard")
        if further.isEmpty():
            break
        reached = written(reached.unionByName(further), "guard")
        onward = jump.select(*key, F.col(_CHUNK).alias(_NEXT), F.col(_IN).alias(_OUT),
                             F.col(_NEXT).alias("_next2"), F.col(_OUT).alias("_out2"))
        jump = written(_joined(jump, onward, key + [_NEXT, _OUT]).select(
            *entry, F.col("_next2").alias(_NEXT), F.col("_out2").alias(_OUT)), "guard")

    passed = _joined(reached, maps, entry).select(*chunk, _OUT)
    before = Window.partitionBy(*key).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    line = _joined(chunks, passed, chunk, "left").unionByName(
        seeds.withColumn(_CHUNK, F.lit(-1).cast("long")).select(*chunk, _OUT))
    line = line.withColumn(_IN, F.last(_OUT, ignorenulls=True).over(before))
    return line.filter(F.col(_CHUNK) >= 0).select(*chunk, _decoded(_IN).alias(STORED))

"""Helpers shared by the operators: word hashing on Arrow buffers, written
intermediate tables, and size-checked broadcasts."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revledger.session import ensure_checkpoint_dir, new_table_folder, ship_package

#: fixed by the data contract: a word is a run of anything but these bytes
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: a side with at most this many rows of a few longs may be broadcast
BROADCAST_IDS = 500_000


#: rows of an Arrow batch of whole texts. Spark's own default, ten thousand,
#: makes batches of tens of megabytes, of which a task holds several.
ARROW_ROWS = 500
_ARROW_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder set, package importable in Python workers, and Arrow
    batches small enough for long texts unless the session has its own size."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get(_ARROW_CONF, "-1") == "-1":  # not set
        spark.conf.set(_ARROW_CONF, str(ARROW_ROWS))


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder of the shared checkpoint folder."""
    return new_table_folder(spark, f"llm-{name}")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage,
    is computed once, and survives the loss of executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_plain(df: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """``df`` (already written, so that counting reads its footers) marked
    for broadcast when it has at most ``limit`` rows; otherwise unmarked, and
    the join shuffles."""
    return F.broadcast(df) if df.count() <= limit else df


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names, so that extra columns of the
    input, whatever their names, cannot clash."""
    return df.select(*[df[c].alias(k) for k, c in columns.items()])


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row. Catalyst would copy
    the expression of an ordinary column into every place that uses it, also
    into the lambda of a ``transform``, where it would be computed again for
    every element; it does not do so across the generator of an ``explode``
    of one element."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


# ---------------------------------------------------------------------------
# word hashes, computed for many texts at once on their UTF-8 bytes

#: a word is a polynomial in its bytes modulo two primes of 31 bits: unlike
#: modulo a power of two, different words of any make seldom meet
_PRIMES = (2_147_483_647, 2_147_483_629)
_BASES = (1_103_515_253, 1_812_433_261)
#: bytes whose products of 40 bits are added up before the sum is reduced
_SUM_BYTES = 1 << 23
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SEPARATORS)] = False
_PLAIN = np.arange(1, 257, dtype=np.uint64)
_LOWER = _PLAIN.copy()
_LOWER[65:91] = _PLAIN[97:123]
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _power(base: int, p: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo p, by doubling."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), p)) % np.uint64(p)])
    return out[:n].astype(np.uint32)


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime, the powers of its base and of the base's inverse."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [(_power(b, p, size), _power(pow(b, -1, p), p, size)) for b, p in zip(_BASES, _PRIMES)]
    return [(up[:n], down[:n]) for up, down in _POWERS]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(texts: list[bytes], lower: bool = False):
    """For UTF-8 ``texts`` laid end to end: (hash, first byte, end) of each
    word in order, and the first word index of each text plus the total.
    ``lower`` folds A-Z before hashing."""
    lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lens)
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if not len(data):
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, first
    word = _IS_WORD[data]
    start, stop = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    stop[:-1] &= ~word[1:]
    inner = ends[ends < len(data)]
    inner = inner[inner > 0]
    start[inner] = word[inner]
    stop[inner - 1] = word[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    values = (_LOWER if lower else _PLAIN)[data]
    h = (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    for k, (up, down) in enumerate(_powers(len(data) + 1)):
        p = np.uint64(_PRIMES[k])
        np.multiply(values, up[:-1], out=total[1:])
        for at in range(0, len(data), _SUM_BYTES):
            part = total[at : at + _SUM_BYTES + 1]
            np.cumsum(part, out=part)
            if at + _SUM_BYTES < len(data):
                part %= p
        word_sum = (total[e] + p - total[s] % p) % p
        h ^= (word_sum * down[s] % p) << np.uint64(32 * k)
    first[1:] = np.searchsorted(s, ends, side="left")
    return mix(h), s, e, first


def hash_words(texts: list[bytes], lower: bool = False):
    """(hash of each word, first word index of each text plus the total)."""
    h, _, _, first = word_spans(texts, lower)
    return h, first


def text_groups(texts: list, budget: int = 1 << 20):
    """Ranges of ``texts`` (str or None) as UTF-8, about ``budget`` bytes a
    group; a longer text is a group of its own."""
    group, size, begin = [], 0, 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if group and size + len(b) > budget:
            yield begin, group
            group, size, begin = [], 0, i
        group.append(b)
        size += len(b)
    if group:
        yield begin, group


def window_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (empty if fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    mult = np.uint64(0xFF51AFD7ED558CCD)
    for i in range(k):
        out *= mult
        out += words[i : i + n]
    return mix(out)

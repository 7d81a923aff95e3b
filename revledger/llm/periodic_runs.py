"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period q that is at least
``max(LEAST, TIMES * q)`` long and cannot be extended. Periods up to
``DIRECT`` are read off by comparing each word with that q words on. Above,
dyadic scales t = 8, 16, 32, ... find the periods in (t, 2t]:

- Every window of t words has a name (exact: names are doubled from the words
  on, equal windows and only they share one), and every name a hash.
- Position i is in the synchronising set if the least hash of the windows
  that begin in [i, i + t] is that of the first or the last of them. That is
  decided by the words in [i, i + 2t), so equal contexts are chosen alike.
- Windows whose own period is at most t / 4 are left out of the minimum;
  otherwise a long stretch of a small period would put all its positions in
  the set. They lie in runs that smaller scales have found.
- Two positions of the set with equal contexts of 2t words and none of that
  context between them, t < d <= 2t words apart, propose the period d there.
  The stretch is then measured word by word.

No run is missed. A run of period q in (t, 2t] has windows that take part (if
all had a period of at most t / 4, so had the run). The least hash among them
occurs at some m in its first q words and again at m + q; both are in the set,
for the windows after m in the run have no smaller hash, and m + q + 2t ends
inside the run, since it has 4q words. The context holds a whole period, so
its next occurrence is q words on.

A scale only sees texts with a window of t words that occurs twice in them.
Each text is handled alone in a task: no shuffle.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from revledger.llm.common import mix, only, prepare, text_groups

#: fixed by the data contract
LEAST, TIMES = 6, 4
#: largest period found by direct comparison, and the first scale
DIRECT = 8
#: bytes of texts whose words are handled together
GROUP_BYTES = 2 << 20
_OUT = np.uint64(0xFFFFFFFFFFFFFFFF)


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end index of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], equal, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def _forward(x: np.ndarray, i: int, d: int, end: int) -> int:
    """The first j >= i where x[j] and x[j + d] differ, or end - d."""
    step = 64
    while i + d < end:
        k = min(step, end - d - i)
        bad = x[i : i + k] != x[i + d : i + d + k]
        if bad.any():
            return i + int(bad.argmax())
        i, step = i + k, step * 2
    return i


def _backward(x: np.ndarray, i: int, d: int, begin: int) -> int:
    """The least j <= i with x equal to x[d:] on [j, i)."""
    step = 64
    while i > begin:
        k = min(step, i - begin)
        bad = x[i - k : i] != x[i - k + d : i + d]
        if bad.any():
            return i - int(bad[::-1].argmax())
        i, step = i - k, step * 2
    return i


def _window_min(h: np.ndarray, t: int) -> np.ndarray:
    """The least of h[i .. i + t], t a power of two; beyond the end nothing."""
    low, size = h, 1
    while size < t:
        low = np.minimum(low, np.concatenate((low[size:], np.full(min(size, len(low)), _OUT))))
        size *= 2
    return np.minimum(low, np.concatenate((h[t:], np.full(min(t, len(h)), _OUT))))


class _Windows:
    """Names of the windows of ``size`` words in some texts laid end to end:
    ``name`` (-1 where a window leaves its text), ``doc`` and ``place`` (in
    the whole group) of each word, ``left`` words to the end of its text."""

    def __init__(self, name, doc, place, left):
        self.size, self.name, self.doc, self.place, self.left = 1, name, doc, place, left

    def double(self) -> np.ndarray:
        """Name the windows of twice the size; the texts that hold one more
        than once."""
        k = self.size
        at = np.flatnonzero(self.left >= 2 * k)
        pair = self.name[at] * (self.name.max(initial=0) + 1) + self.name[at + k]
        order = np.argsort(pair, kind="stable")
        pair, at = pair[order], at[order]
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = pair[1:] != pair[:-1]
        self.name = np.full(len(self.left), -1, dtype=np.int64)
        self.name[at] = np.cumsum(fresh) - 1
        self.size = 2 * k
        doc = self.doc[at]
        return np.unique(doc[1:][~fresh[1:] & (doc[1:] == doc[:-1])])

    def keep(self, docs: np.ndarray) -> None:
        some = np.isin(self.doc, docs)
        self.name, self.doc, self.place, self.left = (
            a[some] for a in (self.name, self.doc, self.place, self.left))


def find_runs(words: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period) by start and period of each text that has
    any; text k is words[first[k]:first[k + 1]], equal numbers being equal
    words."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    left = np.repeat(first[1:], n) - np.arange(len(words))
    found: dict[tuple[int, int], int] = {}  # (start, length) -> least period

    def add(start: int, length: int, period: int) -> None:
        if length >= max(LEAST, TIMES * period):
            found[start, length] = min(period, found.get((start, length), period))

    for q in range(1, DIRECT + 1):
        a, b = _stretches((words[:-q] == words[q:]) & (doc[:-q] == doc[q:]))
        size = b - a + q
        for i in np.flatnonzero(size >= max(LEAST, TIMES * q)):
            add(int(a[i]), int(size[i]), q)

    w = _Windows(words, doc, np.arange(len(words)), left)
    twice = np.flatnonzero(n >= TIMES * (DIRECT + 1))
    while w.size < DIRECT and len(twice):
        w.keep(twice)
        twice = w.double()
    while len(twice):
        w.keep(twice[n[twice] >= TIMES * (w.size + 1)])
        if not len(w.doc):
            break
        t, name = w.size, w.name
        hashed = mix(name.astype(np.uint64))
        hashed[(name < 0) | _covered(w, found)] = _OUT
        twice = w.double()
        low = _window_min(hashed, t)
        last = np.concatenate((hashed[t:], np.full(min(t, len(hashed)), _OUT)))
        chosen = np.flatnonzero((w.name >= 0) & (low != _OUT) & ((hashed == low) | (last == low)))
        order = chosen[np.argsort(w.name[chosen], kind="stable")]
        a, b = order[:-1], order[1:]
        apart = w.place[b] - w.place[a]
        pairs = (w.name[a] == w.name[b]) & (w.doc[a] == w.doc[b]) & (apart > t) & (apart <= 2 * t)
        reach: dict[tuple[int, int], int] = {}  # (text, period) -> last equal place
        a, apart = a[pairs], apart[pairs]
        by_place = np.argsort(a, kind="stable")
        for i, d, k in zip(w.place[a[by_place]].tolist(), apart[by_place].tolist(), w.doc[a[by_place]].tolist()):
            if i < reach.get((k, d), -1):
                continue  # inside a stretch of this period already measured
            stop = _forward(words, i, d, int(first[k + 1]))
            begin = _backward(words, i, d, int(first[k]))
            reach[k, d] = stop
            add(begin, stop + d - begin, d)

    out: dict[int, list[tuple[int, int, int]]] = {}
    for (start, length), period in sorted(found.items(), key=lambda x: (x[0][0], x[1])):
        k = int(doc[start])
        out.setdefault(k, []).append((start - int(first[k]), length, period))
    return out


def _covered(w: _Windows, found: dict) -> np.ndarray:
    """Windows inside a known run with a period of at most a quarter of
    theirs."""
    out = np.zeros(len(w.place) + 1, dtype=np.int64)
    runs = [(s, s + n - w.size + 1) for (s, n), q in found.items() if 4 * q <= w.size <= n]
    if runs:
        begin, end = np.searchsorted(w.place, np.array(runs).T)
        np.add.at(out, begin, 1)
        np.add.at(out, end, -1)
    return np.cumsum(out[:-1]) > 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; of equal ones the first."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without what any run repeats after its first period."""
    out, at = [], 0
    for a, b in sorted((s + q, s + n) for s, n, q in runs):
        if b > at:
            out += words[at : max(a, at)]
            at = b
    return out + words[at:]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUN_SQL = "struct<start:long,length:long,period:long>"


def _as_struct(r):
    return None if r is None else {"start": r[0], "length": r[1], "period": r[2]}


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, ``runs`` by start and period, ``best``, ``collapsed``)
    of every row: word numbers count from 0, ``best`` is the run with the
    greatest length / period (ties: the first), ``collapsed`` the words that
    no run repeats, joined by one space.

    A null, empty or blank text has no run, a null ``best`` and an empty
    ``collapsed``. Repeated rows and rows that share an id stay apart, an
    empty table gives an empty result, extra columns are ignored."""
    prepare(docs.sparkSession)
    base = only(docs, doc_id=id_col, text=text_col)

    def run(batches):
        for b in batches:
            rows = []
            for _, raw in text_groups(b.column("text").to_pylist(), GROUP_BYTES):
                texts = [t.split() for t in raw]  # bytes: the six ASCII separators
                number: dict[bytes, int] = {}
                first = np.cumsum([0, *map(len, texts)])
                ids = np.fromiter((number.setdefault(x, len(number)) for t in texts for x in t),
                                  dtype=np.int64, count=int(first[-1]))
                runs = find_runs(ids, first)
                for k, t in enumerate(texts):
                    own = runs.get(k, [])
                    rows.append((len(t), [_as_struct(r) for r in own], _as_struct(strongest(own)),
                                 b" ".join(collapsed(t, own))))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(_RUN)),
                 pa.array(cols[2], _RUN), pa.array(cols[3], pa.string())],
                names=["doc_id", "n_words", "runs", "best", "collapsed"])

    return base.mapInArrow(
        run, f"doc_id {dict(base.dtypes)['doc_id']}, n_words long, runs array<{_RUN_SQL}>, "
        f"best {_RUN_SQL}, collapsed string")


def planted(words: list, doc_id) -> list:
    """``words`` with the repetition that the contract of the query puts into
    a tenth of all texts, by the hash of the id."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def plant_repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with ``planted`` words; other texts stay as they are."""
    prepare(docs.sparkSession)
    base = only(docs, doc_id=id_col, text=text_col)

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, d in enumerate(b.column("doc_id").to_pylist()):
                if texts[i] and d is not None and zlib.crc32(str(d).encode()) % 10 == 0:
                    texts[i] = b" ".join(planted(texts[i].encode().split(), d)).decode()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])

    return base.mapInArrow(run, base.schema)

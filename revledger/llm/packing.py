"""Bounded-space online packing of token sequences.

Each task tokenizes its documents one after another and keeps a fixed
number of open windows. What is left of a document after whole windows of
its own goes to the open window that it fits best. When it fits none and no
window may be opened, its head tops up the fullest window, which is
emitted, and its tail is placed again. At the end of a task the open windows
are left over; groups of tasks' leftovers are packed again by the same rule,
level by level, until one group remains, whose leftovers become the last
sequences.

Memory in a task is the open windows plus one batch of texts. Leftovers are
at most ``OPEN_WINDOWS`` windows a task, ``FAN_IN`` tasks to a group.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revledger.llm.common import only, prepare, saved, word_spans

WINDOW = 2048
OPEN_WINDOWS = 16
FAN_IN = 16
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: characters whose words are looked up together, and texts hashed at once
RUN_CHARS = 8 << 20
SPAN_TEXTS = 256

# ---------------------------------------------------------------------------
# tokens


class WordTokenizer:
    """Token ids of texts by the ``tokenizers`` library, as arrays.

    This vocabulary's pipeline works inside words: it drops white space, and
    neither its normaliser nor its pre-tokenizer looks across it. So ids are
    looked up by word, and only words not seen before are encoded, many in
    one call. A text with anything that could break this (characters beyond
    Latin-1, white space that Python and the library might see differently,
    the mark of a special token) is encoded whole. Lower-casing first, as the
    library does itself, makes more words meet; so does taking off a final
    stop or comma, which is a token of its own after a letter."""

    #: whole texts with these are encoded as they are
    WHOLE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0Ā-\U0010ffff]")
    MARK = "<|"
    #: words in a generation of the cache, about 130 MB; there are two, so
    #: that the frequent words stay
    CACHE_WORDS = 600_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        #: tokens that end a run of letters
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.final = {c.encode(): self.packed(self.encode(c)) for c in ".,"
                      if self.encode("a" + c) == self.encode("a") + self.encode(c)}

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def learn(self, words: list[bytes]) -> None:
        """Encode words and put them into the young generation. Words of
        letters are encoded in one call: each is one run of letters, which
        ends at the next token that ends one."""
        young = self.young
        plain, rest = [], []
        for w in words:
            (plain if w.isalpha() or w.decode().isalpha() else rest).append(w)
        if plain:
            ids = np.array(self.encode(b" ".join(plain).decode()), dtype="<u4")
            ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(ends) == len(plain):
                raw, at = ids.tobytes(), 0
                for w, e in zip(plain, ends):
                    young[w] = raw[at:e]
                    at = e
            else:
                rest = words
        rest_ids = self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
        for w, e in zip(rest, rest_ids):
            young[w] = self.packed(e.ids)

    def lookup(self, missing: list[bytes]) -> None:
        """Bring words into the young generation, from the old one or by
        encoding them or what is left without a final sign."""
        young, old, final = self.young, self.old, self.final
        new, cut = set(), []
        for w in missing:
            ids = old.get(w)
            if ids is not None:
                young[w] = ids
            elif w[-1:] in final and w[:-1].decode().isalpha():
                cut.append(w)
                if w[:-1] not in young:
                    new.add(w[:-1])
            else:
                new.add(w)
        self.learn([w for w in new if w not in young])
        for w in cut:
            young[w] = young[w[:-1]] + final[w[-1:]]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.young) > self.CACHE_WORDS:
            self.young, self.old = {}, self.young
        whole = [self.MARK in t or self.WHOLE.search(t) is not None for t in texts]
        raw = [b"" if w else t.lower().encode() for t, w in zip(texts, whole)]
        data = b"".join(raw)
        hashes, begin, end, first, base = [], [], [], [0], 0
        for i in range(0, len(raw), SPAN_TEXTS):
            part = raw[i:i + SPAN_TEXTS]
            h, s, e, f = word_spans(part)
            hashes.append(h)
            begin.append(s + base)
            end.append(e + base)
            first += (f[1:] + first[-1]).tolist()
            base += sum(map(len, part))
        begin, end = np.concatenate(begin), np.concatenate(end)
        _, pick, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        words = [data[s:e] for s, e in zip(begin[pick].tolist(), end[pick].tolist())]
        ids = list(map(self.young.get, words))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            self.lookup([words[i] for i in missing])
            for i in missing:
                ids[i] = self.young[words[i]]
        # the ids of each distinct word, laid out in the order of the words
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        start = np.cumsum(size) - size
        length = size[which]
        place = np.concatenate([[0], np.cumsum(length)])
        out = flat[np.repeat(start[which] - place[:-1], length) + np.arange(place[-1])]
        cuts = place[first].tolist()
        return [np.array(self.encode(t), dtype="<u4") if w else out[a:b]
                for t, w, a, b in zip(texts, whole, cuts, cuts[1:])]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def vocabulary_tokens(name: str = VOCABULARY) -> Callable[[list[str]], list[np.ndarray]]:
    """The tokenizer of a public vocabulary file, one for each worker."""
    import public_tokenizers

    if name not in _TOKENIZERS:
        _TOKENIZERS[name] = WordTokenizer(public_tokenizers.path(name))
    return _TOKENIZERS[name]


# ---------------------------------------------------------------------------
# packing


def text_runs(texts: list[str | None], budget: int = RUN_CHARS):
    """(first index, texts) of runs of about ``budget`` characters."""
    run, size, begin = [], 0, 0
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > budget:
            yield begin, run
            run, size, begin = [], 0, i
        run.append(t)
        size += len(t)
    if run:
        yield begin, run


class Piece:
    """Ids [start, start + len(ids)) of one document."""

    __slots__ = ("doc_id", "start", "ids", "doc_tokens")

    def __init__(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int):
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return (Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens),
                Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens))


class Packer:
    """Open windows of ``window`` tokens, at most ``open_windows`` of them."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window, self.limit = window, open_windows
        self.open: list[tuple[int, list[Piece]]] = []

    def add(self, p: Piece) -> Iterator[list[Piece]]:
        """Place a piece; yields the sequences that became full."""
        while len(p.ids) >= self.window:
            head, p = p.cut(self.window)
            yield [head]
        while len(p.ids):
            n = len(p.ids)
            best = None
            for i, (space, _) in enumerate(self.open):
                if space >= n and (best is None or space < self.open[best][0]):
                    best = i
            if best is None and len(self.open) < self.limit:
                self.open.append((self.window - n, [p]))
                return
            if best is None:
                best = min(range(len(self.open)), key=lambda i: self.open[i][0])
            space, pieces = self.open[best]
            head, p = p.cut(min(space, n))
            pieces.append(head)
            if space == len(head.ids):
                del self.open[best]
                yield pieces
            else:
                self.open[best] = (space - len(head.ids), pieces)

    def flush(self) -> Iterator[list[Piece]]:
        """The open windows as one run of tokens, cut into full windows and
        then into powers of two, which need no padding."""
        pieces = [p for _, w in sorted(self.open, key=lambda w: w[0]) for p in w]
        self.open = []
        left = sum(len(p.ids) for p in pieces)
        while left:
            size = min(self.window, 1 << (left.bit_length() - 1)) if left < self.window else self.window
            left -= size
            out = []
            while size:
                p = pieces.pop(0)
                if len(p.ids) > size:
                    p, rest = p.cut(size)
                    pieces.insert(0, rest)
                out.append(p)
                size -= len(p.ids)
            yield out


ROWS = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
        "offset long, unit long, leftover int, ids binary")


def _rows(doc_ids, batch, id_type, schema_names) -> pa.RecordBatch:
    cols = list(zip(*batch)) if batch else [()] * 9
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, id_type), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
        names=schema_names)


class Output:
    """Rows of one packing unit: sequences numbered from the unit's id."""

    def __init__(self, level: int, unit: int, id_type, keep_ids: bool):
        self.unit, self.id_type, self.keep_ids = unit, id_type, keep_ids
        self.next_id = (level << 58) | (unit << 28)
        self.doc_ids, self.rows = [], []
        self.names = ["doc_id", *[c.split()[0] for c in ROWS.split(", ")]]

    def put(self, pieces: list[Piece], leftover: int | None = None) -> None:
        offset = 0
        for p in pieces:
            raw = p.ids.tobytes()
            self.doc_ids.append(p.doc_id)
            keep = leftover is not None or self.keep_ids
            self.rows.append((p.start, len(p.ids), zlib.crc32(raw), p.doc_tokens,
                              None if leftover is not None else self.next_id, offset, self.unit,
                              leftover, raw if keep else None))
            offset += len(p.ids)
        if leftover is None:
            self.next_id += 1

    def take(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield _rows(self.doc_ids, self.rows, self.id_type, self.names)
            self.doc_ids, self.rows = [], []


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         tokens: Callable[[], Callable[[list[str]], list[np.ndarray]]] = vocabulary_tokens,
         window: int = WINDOW, open_windows: int = OPEN_WINDOWS, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, with ``keep_ids``, the ids as little-endian
    32-bit integers. ``tokens`` is called once in a task and gives the
    function from texts to arrays of ids; id 1 ends every document.

    A null or empty text is the end id alone. Repeated rows are documents of
    their own. An empty table gives no pieces. Extra columns are ignored."""
    prepare(docs.sparkSession)
    base = only(docs, doc_id=id_col, text=text_col)
    schema = f"doc_id {dict(base.dtypes)['doc_id']}, {ROWS}"

    def first(batches):
        encode, end = tokens(), np.array([END_ID], dtype="<u4")
        packer = Packer(window, open_windows)
        out = None
        for b in batches:
            out = out or Output(0, TaskContext.get().partitionId(), b.column("doc_id").type, keep_ids)
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for i, group in text_runs(texts):
                for d, own in zip(ids[i:i + len(group)], encode(group)):
                    own = np.concatenate([own, end])
                    for full in packer.add(Piece(d, 0, own, len(own))):
                        out.put(full)
                yield from out.take(4096)
        if out is not None:
            for k, (_, pieces) in enumerate(packer.open):
                out.put(pieces, k)
            yield from out.take()

    def again(level: int, last: bool):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            packer = Packer(window, open_windows)
            out = Output(level, key[0].as_py(), table.schema.field("doc_id").type, keep_ids)
            pieces = table.to_pylist()
            pieces.sort(key=lambda r: (r["unit"], r["leftover"], r["offset"]))
            for r in pieces:
                p = Piece(r["doc_id"], r["start"], np.frombuffer(r["ids"], dtype="<u4"), r["doc_tokens"])
                for full in packer.add(p):
                    out.put(full)
            if last:
                for full in packer.flush():
                    out.put(full)
            else:
                for k, (_, w) in enumerate(packer.open):
                    out.put(w, k)
            return pa.Table.from_batches(list(out.take(0)))
        return run

    done = saved(base.mapInArrow(first, schema), "packed")
    result, level = done.filter(F.col("leftover").isNull()), 0
    left = done.filter(F.col("leftover").isNotNull())
    units = left.agg(F.max("unit").alias("m")).first()["m"]
    while units is not None:
        level, last = level + 1, units < FAN_IN
        grouped = left.withColumn("_group", F.floor(F.col("unit") / FAN_IN).cast("long"))
        done = saved(grouped.groupBy("_group").applyInArrow(again(level, last), schema), "repacked")
        result = result.unionByName(done.filter(F.col("leftover").isNull()))
        left = done.filter(F.col("leftover").isNotNull())
        units = None if last else units // FAN_IN
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return result.select(*names, *(["ids"] if keep_ids else []))

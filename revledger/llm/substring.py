"""Repeated passages by sharded FM-indexes.

A window of ``WINDOW`` words is a repeat if the same words start earlier
(in a smaller doc_id, or earlier in the same document); every word covered by
a repeat is removed.

Equal windows are brought to the same shard by their content: the smallest
hash among a window's short word runs is its anchor. Consecutive windows
with one anchor form a segment. Only segments whose anchor occurs more than
once can hold a repeat; equal segments of all documents are one class,
represented by the first. The class texts of a shard, in document order, are
indexed by an FM-index over words, and each text is streamed through it:
for each of its windows, backward search gives the interval of its
occurrences and the first of them. A window of the representative is a
repeat if an occurrence lies before its own; all other members of a class
come after the representative, so every window that the index found is one.

An anchor that is common beyond ``HEAVY`` segments (a phrase of a third of
all documents) would make one shard large. Its windows are segments of
their own, spread by the hash of the whole window, so that no shard holds
more than the classes of a bounded number of occurrences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revledger.llm.common import (WORD, hash_words, mix, only, prepare, saved, small_or_plain,
                                  text_groups, window_hash)
from revledger.llm.fm_index import FMIndex

WINDOW = 20
#: words of the runs whose hashes choose the anchors
ANCHOR_WORDS = 5
#: occurrences above which an anchor's windows are spread; grows with the
#: input so that at most HEAVY_ANCHORS anchors are heavy
HEAVY = 20_000
HEAVY_ANCHORS = 1_000_000
#: words in one FM-index, about
SHARD_WORDS = 400_000

_PLACE_BITS = 21
_MULT = np.uint64(0xD1342543DE82EF95)
_MULT_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))


def anchors(runs: np.ndarray, count: int, span: int) -> np.ndarray:
    """For each of ``count`` windows, the place of the smallest of its
    ``span`` run hashes (the first of equal ones). ``span`` is any number;
    minima over powers of two are combined. The high bits of a hash decide,
    the low bits carry the place, counted inside a chunk."""
    out = np.empty(count, dtype=np.int64)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    step = (1 << _PLACE_BITS) - span
    for base in range(0, count, step):
        part = runs[base:base + step + span - 1]
        key = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while 2 * size <= span:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < span:
            key = np.minimum(key[:len(key) - (span - size)], key[span - size:])
        n = min(step, count - base)
        out[base:base + n] = (key[:n] & low).astype(np.int64) + base
    return out


def segments(words: np.ndarray, first: np.ndarray, heavy: np.ndarray, window: int = WINDOW):
    """(text, anchor, segment hash, first window, windows, is heavy) arrays
    for the word hashes of several texts (``first``: first word of each, and
    the total); ``heavy`` are sorted anchors whose segments are cut up.
    None if no text has a window."""
    count = len(words) - window + 1
    if count <= 0:
        return None
    runs = window_hash(words, ANCHOR_WORDS)
    where = anchors(runs, count, window - ANCHOR_WORDS + 1)
    # windows that lie inside one text
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:count]
    inside = np.arange(count) + window <= first[1:][text]
    same = np.zeros(count, dtype=bool)
    same[1:] = (where[1:] == where[:-1]) & (text[1:] == text[:-1]) & inside[:-1]
    begin = np.flatnonzero(inside & ~same)
    if not len(begin):
        return None
    last = inside.copy()
    last[:-1] &= ~(same[1:] & inside[1:])
    end = np.flatnonzero(last) + 1
    anchor = runs[where[begin]]
    is_heavy = np.isin(anchor, heavy) if len(heavy) else np.zeros(len(begin), dtype=bool)
    if is_heavy.any():
        size = np.where(is_heavy, end - begin, 1)
        shift = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        begin, end = np.repeat(begin, size) + shift, np.repeat(end, size)
        anchor, is_heavy = np.repeat(anchor, size), np.repeat(is_heavy, size)
        end = np.where(is_heavy, begin + 1, end)
    up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(words), _MULT)]))
    down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(words), _MULT_INV)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(words * up[:-1])])
    seg = mix((total[end + window - 1] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    if is_heavy.any():
        anchor = np.where(is_heavy, mix(seg + np.uint64(7)), anchor)
    return text[begin], anchor, seg, begin - first[text[begin]], end - begin, is_heavy


def _first_two(text: np.ndarray, anchor: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Indexes of the first two occurrences of each (text, anchor, seg)."""
    order = np.lexsort((seg, anchor, text))  # stable: in order of occurrence
    t, a, s = text[order], anchor[order], seg[order]
    more = np.zeros(len(order), dtype=bool)
    more[2:] = (t[2:] == t[:-2]) & (a[2:] == a[:-2]) & (s[2:] == s[:-2])
    return np.sort(order[~more])


def occurrences(docs: DataFrame, heavy: list[int], window: int) -> DataFrame:
    """(anchor, seg, doc_id, start, windows, heavy) of every segment; of equal
    segments of one document, the first two."""
    sorted_heavy = np.sort(np.array(heavy, dtype=np.int64).view(np.uint64))
    names = ["anchor", "seg", "doc_id", "at"]

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            known = np.array([i is not None for i in ids], dtype=bool)
            ids = np.array([i or 0 for i in ids], dtype=np.int64)
            for start, group in text_groups(b.column("text").to_pylist()):
                words, first = hash_words(group)
                found = segments(words, first, sorted_heavy, window)
                if found is None:
                    continue
                text, anchor, seg, begin, size, is_heavy = found
                keep = _first_two(text, anchor, seg)
                keep = keep[known[start + text[keep]]]
                # start, number of windows and the heavy mark in one long
                at = (begin << 8) | (size << 1) | is_heavy
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (anchor[keep].view(np.int64), seg[keep].view(np.int64),
                                           ids[start + text[keep]], at[keep])], names=names)

    return docs.mapInArrow(run, "anchor long, seg long, doc_id long, at long")


def packed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, packed) for the rows whose id is in ``ids`` (_id); texts are
    compressed before they are shuffled."""
    found = docs.join(small_or_plain(ids), docs["doc_id"] == ids["_id"], "left_semi")

    def run(batches):
        coder = zstd.ZstdCompressor(level=3)
        for b in batches:
            packed = [coder.compress((t or "").encode("utf-8", "surrogatepass"))
                      for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(packed, pa.binary())],
                                             names=["doc_id", "packed"])

    return found.mapInArrow(run, "doc_id long, packed binary")


def _unpack(coder: zstd.ZstdDecompressor, packed: bytes) -> str:
    return coder.decompress(packed).decode("utf-8", "surrogatepass")


def class_texts(docs: DataFrame, classes: DataFrame, window: int) -> DataFrame:
    """(anchor, seg, doc_id, at, words): each class with the words of its
    representative, joined by one space."""
    ids = saved(classes.select(F.col("doc_id").alias("_id")).distinct(), "class-docs")
    by_doc = classes.groupBy(F.col("doc_id").alias("_doc")).agg(
        F.collect_list(F.struct("anchor", "seg", "at")).alias("parts"))
    texts = packed_texts(docs, ids).join(by_doc, F.col("doc_id") == F.col("_doc")).drop("_doc")
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("doc_id", pa.int64()),
                        ("at", pa.int64()), ("words", pa.string())])

    def run(batches):
        coder = zstd.ZstdDecompressor()
        for b in batches:
            rows = []
            for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "packed", "parts"))):
                words = WORD.findall(_unpack(coder, r[1]))
                for p in r[2]:
                    start, size = p["at"] >> 8, (p["at"] >> 1) & 127
                    rows.append((p["anchor"], p["seg"], r[0], p["at"],
                                 " ".join(words[start:start + size + window - 1])))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return texts.mapInArrow(run, "anchor long, seg long, doc_id long, at long, words string")


def search_shard(rows: dict[str, list], window: int) -> tuple[list[int], list[int]]:
    """For each class of one shard, in document order: bits of its windows
    that the index found, and of those found at an earlier place."""
    words, first = hash_words([t.encode("utf-8", "surrogatepass") for t in rows["words"]])
    lengths = np.diff(first)
    if not len(words):
        return [0] * len(lengths), [0] * len(lengths)
    vocabulary, symbols = np.unique(words, return_inverse=True)
    # a separator after each class text
    starts = first[:-1] + np.arange(len(lengths))
    text = np.zeros(len(words) + len(lengths), dtype=np.int64)
    text[np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)] = symbols + 1
    index = FMIndex(text, window)
    low, high, offset = index.stream(text, starts, lengths)
    place = index.first_positions(low, high)
    count = np.diff(offset)
    own = np.repeat(starts, count) + np.arange(offset[-1]) - np.repeat(offset[:-1], count)
    bit = np.left_shift(np.int64(1), np.arange(offset[-1]) - np.repeat(offset[:-1], count))
    lane = np.repeat(np.arange(len(lengths)), count)
    found, earlier = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    np.bitwise_or.at(found, lane, np.where(place >= 0, bit, 0))
    np.bitwise_or.at(earlier, lane, np.where((place >= 0) & (place < own), bit, 0))
    return found.tolist(), earlier.tolist()


def searched_classes(texts: DataFrame, shards: int, window: int) -> DataFrame:
    """(anchor, seg, doc_id, at, found, earlier) of every class."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("at", "ascending")])
        # repeated rows of a document bring its classes more than once
        place = np.column_stack([table.column(c).to_numpy() for c in ("doc_id", "at")])
        new = np.ones(len(place), dtype=bool)
        new[1:] = (place[1:] != place[:-1]).any(axis=1)
        table = table.filter(pa.array(new))
        found, earlier = search_shard({"words": table.column("words").to_pylist()}, window)
        return table.select(["anchor", "seg", "doc_id", "at"]).append_column(
            "found", pa.array(found, pa.int64())).append_column("earlier", pa.array(earlier, pa.int64()))

    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards))
    return texts.withColumn("shard", shard).groupBy("shard").applyInArrow(
        run, "anchor long, seg long, doc_id long, at long, found long, earlier long")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, at, bits): segments with repeated windows; ``bits`` says which
    of its windows. ``docs`` has doc_id long and text."""
    counts = occurrences(docs, [], window).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    counts = saved(counts.filter("n > 1"), "anchors")
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(HEAVY, total // HEAVY_ANCHORS)
    heavy = [r["anchor"] for r in counts.filter(F.col("n") > limit).select("anchor").collect()]
    seen = occurrences(docs, heavy, window)
    shared = counts.filter(F.col("n") <= limit).select(F.col("anchor").alias("_anchor"))
    # cut windows have an anchor of their own; they are all looked up
    hits = seen.join(shared, seen["anchor"] == shared["_anchor"], "left").filter(
        F.col("_anchor").isNotNull() | (F.col("at").bitwiseAND(F.lit(1)) == 1))
    hits = saved(hits.select("anchor", "seg", "doc_id", "at"), "hits")
    classes = saved(hits.groupBy("anchor", "seg").agg(F.min(F.struct("doc_id", "at")).alias("f"))
                    .select("anchor", "seg", "f.doc_id", "f.at"), "classes")
    size = F.shiftright("at", 1).bitwiseAND(F.lit(127)) + (window - 1)
    words = classes.agg(F.sum(size)).first()[0] or 0
    found = saved(searched_classes(class_texts(docs, classes, window), words // SHARD_WORDS + 1, window),
                  "searched")
    found = found.select(F.col("anchor").alias("_a"), F.col("seg").alias("_s"), F.col("doc_id").alias("_d"),
                         F.col("at").alias("_at"), "found", "earlier")
    joined = hits.join(found, (F.col("anchor") == F.col("_a")) & (F.col("seg") == F.col("_s")))
    is_first = (F.col("doc_id") == F.col("_d")) & (F.col("at") == F.col("_at"))
    bits = F.when(is_first, F.col("earlier")).otherwise(F.col("found"))
    return joined.select("doc_id", "at", bits.alias("bits")).filter("bits <> 0")


def keep_words(words: list[str], parts: list[dict], window: int) -> list[str]:
    """``words`` without those covered by a repeated window: the windows
    named in ``parts`` (at, bits), and those that occurred before in the
    same text, of which only the first two are looked up."""
    n = len(words)
    gone = np.zeros(n + 1, dtype=np.int32)

    def cover(starts: np.ndarray) -> None:
        starts = starts[(starts >= 0) & (starts + window <= n)]
        np.add.at(gone, starts, 1)
        np.add.at(gone, starts + window, -1)

    for p in parts:
        bits = p["bits"]
        cover((p["at"] >> 8) + np.array([j for j in range(bits.bit_length()) if bits >> j & 1], dtype=np.int64))
    hashes, _ = hash_words([" ".join(words).encode("utf-8", "surrogatepass")])
    windows = window_hash(hashes, window)
    _, first, which = np.unique(windows, return_index=True, return_inverse=True)
    cover(np.flatnonzero(first[which] != np.arange(len(windows))))
    covered = np.cumsum(gone[:n]) > 0
    return [w for w, g in zip(words, covered.tolist()) if not g]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row; ``kept`` is the kept
    words joined by one space.

    Null and empty texts have no words. Texts shorter than a window keep all
    of theirs. Rows without doc_id come before nothing and are kept whole.
    Repeated rows start at the same place, so none removes the other; rows
    that share a doc_id are taken as one document. An empty table gives an
    empty result; extra columns are ignored."""
    prepare(docs.sparkSession)
    docs = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    parts = saved(repeated_windows(docs, window), "repeats")
    ids = saved(parts.select(F.col("doc_id").alias("_id")).distinct(), "repeat-docs")
    schema = "doc_id long, n_words long, n_removed long, kept string"
    names = ["doc_id", "n_words", "n_removed", "kept"]

    def row_batch(ids, rows):
        n, gone, kept = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                           pa.array(kept, pa.string())], names=names)

    def whole(batches):
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                words = WORD.findall(t or "")
                rows.append((len(words), 0, " ".join(words)))
            yield row_batch(b.column("doc_id"), rows)

    def cut(batches):
        coder = zstd.ZstdDecompressor()
        for b in batches:
            rows = []
            for packed, p in zip(b.column("packed").to_pylist(), b.column("parts").to_pylist()):
                words = WORD.findall(_unpack(coder, packed))
                kept = keep_words(words, p, window)
                rows.append((len(words), len(words) - len(kept), " ".join(kept)))
            yield row_batch(b.column("doc_id"), rows)

    by_doc = parts.groupBy(F.col("doc_id").alias("_doc")).agg(
        F.collect_list(F.struct("at", "bits")).alias("parts"))
    touched = packed_texts(docs, ids).join(by_doc, F.col("doc_id") == F.col("_doc")).select(
        "doc_id", "packed", "parts")
    untouched = docs.join(small_or_plain(ids), docs["doc_id"] == ids["_id"], "left_anti")
    return untouched.mapInArrow(whole, schema).unionByName(touched.mapInArrow(cut, schema))


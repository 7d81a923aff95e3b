"""MinHash near-duplicates by a multi-index Hamming join.

A document is the set of its word shingles. Documents with equal sets are
one class from the start. Each class gets a signature of b-bit MinHash
values (``BITS`` each); the share of differing positions estimates one minus
the Jaccard similarity.

Two signatures within the scheme's distance must, by the pigeonhole
principle, differ in at most ``errors`` positions of one of the chunks. So
the index has, for every chunk, one key for each choice of ``errors``
positions to leave out: two classes with such a chunk agree on the key that
leaves out where they differ. Every pair within the distance meets under
some key.

A key may be shared by very many classes, so pairs of a bucket are not
enumerated. First every bucket compares its members with one pivot, its
smallest class: candidates within the signature distance are confirmed on
the full sets, and the links give components. In a group of near copies
that joins nearly all. Buckets whose other members still are in several
components are joined to clusters, which hold every pair that is not
settled. A cluster is cut into blocks of a bounded number of shingles and classes; each
pair of blocks is compared in one task on the full sets by a sparse matrix
product, and only the links that join components leave the task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revledger.llm.common import (hash_words, mix, only, prepare, saved, small_or_plain,
                                  text_groups, window_hash)

BITS = 16
#: shingles and classes in a block of an unsettled cluster, about
BLOCK_SHINGLES, BLOCK_CLASSES = 400_000, 1024
#: classes compared at once inside a task
TILE = 128
#: positions are grouped in chunks of five
CHUNK = 5


@dataclass(frozen=True)
class Scheme:
    """What counts as similar, and the index that finds it. ``similarity`` is
    in hundredths: 100 * intersection >= similarity * union. ``chunks`` of
    five positions, ``errors`` of which may differ in one chunk."""

    words: int = 3
    similarity: int = 85
    chunks: int = 12
    errors: int = 1

    @property
    def positions(self) -> int:
        return self.chunks * CHUNK

    @property
    def max_distance(self) -> int:
        return self.chunks * (self.errors + 1) - 1

    @property
    def keys(self) -> list[list[int]]:
        """The positions that each index key is made of."""
        return [[c * CHUNK + i for i in range(CHUNK) if i not in out]
                for c in range(self.chunks) for out in combinations(range(CHUNK), self.errors)]

    def permutations(self) -> tuple[np.ndarray, np.ndarray]:
        seed = np.arange(1, self.positions + 1, dtype=np.uint64)
        return (mix(seed * np.uint64(0xA0761D6478BD642F)),
                mix(seed * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1))


#: three words, 0.85: a pair at the threshold is missed with probability 3e-6
THREE_WORDS = Scheme()
#: five words, 0.8: a pair at the threshold is missed with probability 4e-5
FIVE_WORDS = Scheme(words=5, similarity=80, chunks=15)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes; fewer than
    ``k`` words are one shingle."""
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    k = min(k, len(words))
    return np.unique(window_hash(words, k) + np.uint64(k))


def signature(sets: np.ndarray, xor: np.ndarray, mul: np.ndarray) -> np.ndarray:
    """The mixed minimum under each permutation, ``BITS`` bits of it."""
    best = np.full(len(xor), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(sets), 512):
        part = (sets[None, i:i + 512] ^ xor[:, None]) * mul[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return (mix(best) >> np.uint64(64 - BITS)).astype("<u2")


def set_hash(sets: np.ndarray) -> bytes:
    return hashlib.blake2b(sets.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(doc_id, n_shingles, set_hash, signature) for every row of
    (doc_id, text); A-Z is folded."""
    id_type = dict(docs.dtypes)["doc_id"]
    xor, mul = scheme.permutations()

    def run(batches):
        for b in batches:
            ids, rows = b.column("doc_id"), []
            for _, group in text_groups(b.column("text").to_pylist()):
                words, first = hash_words(group, lower=True)
                for i in range(len(group)):
                    s = shingles(words[first[i]:first[i + 1]], scheme.words)
                    rows.append((len(s), set_hash(s), signature(s, xor, mul).tobytes()) if len(s) else (0, None, None))
            n, h, sig = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(h, pa.binary()), pa.array(sig, pa.binary())],
                names=["doc_id", "n_shingles", "set_hash", "signature"])

    return docs.mapInArrow(run, f"doc_id {id_type}, n_shingles long, set_hash binary, signature binary")


def index_keys(reps: DataFrame, scheme: Scheme) -> DataFrame:
    """(key, rep): every index key of every class."""
    choices = scheme.keys

    def run(batches):
        for b in batches:
            sig = b.column("signature").to_pylist()
            if not sig:
                continue
            m = np.frombuffer(b"".join(sig), dtype="<u2").reshape(len(sig), -1).astype(np.uint64)
            keys = np.empty((len(sig), len(choices)), dtype=np.uint64)
            for j, kept in enumerate(choices):
                h = np.full(len(sig), j + 1, dtype=np.uint64)
                for p in kept:
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + m[:, p] + np.uint64(1))
                keys[:, j] = h
            rep = np.repeat(np.array(b.column("rep").to_pylist(), dtype=np.int64), len(choices))
            keys = keys.reshape(-1).view(np.int64)
            for i in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[i:i + 200_000]), pa.array(rep[i:i + 200_000])], names=["key", "rep"])

    return reps.select("rep", "signature").mapInArrow(run, "key long, rep long")


def within_distance(pairs: DataFrame, max_distance: int) -> DataFrame:
    """The (a, b) whose signatures sa, sb differ in few enough positions."""
    def run(batches):
        for b in batches:
            x, y = (b.column(c).to_pylist() for c in ("sa", "sb"))
            if not x:
                continue
            x, y = (np.frombuffer(b"".join(v), dtype="<u2").reshape(len(v), -1) for v in (x, y))
            near = pa.array((x != y).sum(axis=1) <= max_distance)
            yield b.select(["a", "b"]).filter(near)

    return pairs.mapInArrow(run, "a long, b long")


def candidates(pairs: DataFrame, reps: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs (a, b) of classes that may be similar: sizes allow it and
    the signatures are within the distance."""
    a = reps.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"),
                    F.col("signature").alias("sa"))
    b = reps.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"),
                    F.col("signature").alias("sb"))
    both = pairs.join(b, "b").join(a, "a").filter(
        100 * F.least("na", "nb") >= scheme.similarity * F.greatest("na", "nb"))
    return within_distance(both.select("a", "b", "sa", "sb"), scheme.max_distance)


def shingle_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(rep, shingles) for the classes in ``wanted`` (rep, set_hash), from
    the text of their representative."""
    found = docs.join(small_or_plain(wanted), docs["doc_id"] == wanted["rep"]).select(
        "rep", "set_hash", "text")

    def run(batches):
        for b in batches:
            reps, hashes = b.column("rep").to_pylist(), b.column("set_hash").to_pylist()
            for begin, group in text_groups(b.column("text").to_pylist()):
                words, first = hash_words(group, lower=True)
                out_rep, out_set = [], []
                for i in range(len(group)):
                    s = shingles(words[first[i]:first[i + 1]], k)
                    if set_hash(s) == hashes[begin + i]:
                        out_rep.append(reps[begin + i])
                        out_set.append(s.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_rep, pa.int64()), pa.array(out_set, pa.list_(pa.int64()))],
                    names=["rep", "shingles"])

    return found.mapInArrow(run, "rep long, shingles array<long>")


def confirmed(cands: DataFrame, docs: DataFrame, reps: DataFrame, scheme: Scheme) -> DataFrame:
    """The candidate pairs that are similar on their full sets."""
    ids = cands.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = saved(ids.join(reps.select("rep", "set_hash"), "rep"), "wanted")
    sets = saved(shingle_sets(docs, wanted, scheme.words), "sets")
    b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("tb"))
    a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("ta"))
    common = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - common
    return cands.join(b, "b").join(a, "a").filter(100 * common >= scheme.similarity * union).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(id, comp) with the smallest id reachable, for ids in ``links`` (a, b).

    In each round every vertex points to its smallest neighbour, pointers are
    followed to their ends (in steps that double), and the links are
    contracted to the ends, so their number falls with every round."""
    edges = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                  .filter("a <> b").distinct(), "edges")
    labels = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        parent = saved(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")), "parent")
        while True:
            end = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
            step = saved(parent.join(end, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p"))
                                                      .alias("moved")), "jump")
            moved = not step.filter("moved").isEmpty()
            parent = step.select("u", "p")
            if not moved:
                break
        if labels is None:
            labels = parent.select(F.col("u").alias("id"), F.col("p").alias("comp"))
        else:
            up = parent.select(F.col("u").alias("comp"), "p")
            labels = saved(labels.join(up, "comp", "left").select(
                "id", F.coalesce("p", "comp").alias("comp")), "labels")
        to_a = parent.select(F.col("u").alias("a"), F.col("p").alias("x"))
        to_b = parent.select(F.col("u").alias("b"), F.col("p").alias("y"))
        edges = saved(edges.join(to_a, "a").join(to_b, "b").filter("x <> y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels


def unsettled(open_members: DataFrame, comps: DataFrame) -> DataFrame:
    """(cluster, rep, comp) of the classes that have pairs left: members of
    buckets with several components, joined over common members."""
    labelled = open_members.join(comps, open_members["rep"] == comps["id"], "left").select(
        "key", "rep", F.coalesce("comp", "rep").alias("comp"))
    labelled = saved(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"),
                                        F.min("rep").alias("_first"))
    mixed = mixed.filter(F.col("_low") != F.col("_high")).select("key", "_first")
    left = saved(labelled.join(mixed, "key").select("rep", "comp", "_first").distinct(), "open")
    clusters = components(left.filter("rep <> _first").select(
        F.col("_first").alias("a"), F.col("rep").alias("b")).distinct())
    return left.select("rep", "comp").distinct().join(
        clusters.withColumnRenamed("comp", "cluster"), F.col("rep") == F.col("id")).select(
        "cluster", "rep", "comp")


def tile_links(sets: list[np.ndarray], left: range, right: range, similarity: int) -> np.ndarray:
    """(i, j) rows, i of ``left`` and j of ``right``, of the similar sets. The
    intersections are the product of two 0-1 matrices over the shingles that
    both tiles have."""
    a, b = (np.concatenate([sets[i] for i in t]) for t in (left, right))
    na, nb = (np.array([len(sets[i]) for i in t]) for t in (left, right))
    vocabulary = np.intersect1d(a, b)
    inter = np.zeros((len(left), len(right)), dtype=np.float32)
    for begin in range(0, len(vocabulary), 8192):
        part = vocabulary[begin:begin + 8192]
        both = []
        for values, sizes in ((a, na), (b, nb)):
            at = np.searchsorted(part, values)
            at[at == len(part)] = 0
            hit = part[at] == values
            m = np.zeros((len(sizes), len(part)), dtype=np.float32)
            m[np.repeat(np.arange(len(sizes)), sizes)[hit], at[hit]] = 1
            both.append(m)
        inter += both[0] @ both[1].T
    inter = inter.astype(np.int64)
    near = 100 * inter >= similarity * (na[:, None] + nb[None, :] - inter)
    return np.argwhere(near) + np.array([left.start, right.start])


def block_links(reps: list[int], comps: list[int], sets: list[np.ndarray], first: np.ndarray,
                similarity: int) -> list[tuple[int, int]]:
    """Links that join different components, as few as join them all, among
    the classes of one block (``first`` all true) or between the classes
    with and without ``first``."""
    parent = {c: c for c in comps}

    def top(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    n = len(reps)
    cut = int(first.sum())
    tiles = [range(i, min(i + TILE, stop)) for begin, stop in ((0, cut), (cut, n))
             for i in range(begin, stop, TILE)]
    out = []
    for x, left in enumerate(tiles):
        for right in tiles[x:]:
            within = cut == n
            if not within and (left.start >= cut or right.start < cut):
                continue
            if len({top(comps[i]) for i in (*left, *right)}) < 2:
                continue
            for i, j in tile_links(sets, left, right, similarity).tolist():
                a, b = top(comps[i]), top(comps[j])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((reps[i], reps[j]))
    return out


def cluster_links(clusters: DataFrame, docs: DataFrame, reps: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b): links between the components of each cluster."""
    wanted = saved(clusters.select("rep").join(reps.select("rep", "set_hash"), "rep"), "wanted")
    sets = saved(shingle_sets(docs, wanted, scheme.words), "sets")
    sizes = sets.select("rep", F.size("shingles").alias("n")).join(clusters.select("rep", "cluster"), "rep")
    blocks = saved(sizes.groupBy("cluster").agg(
        (F.floor(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("n") / BLOCK_CLASSES)) + 1)
        .cast("int").alias("blocks")), "blocks")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    rows = clusters.join(blocks, "cluster").withColumn("block", block).join(sets, "rep")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("rep", "comp", "shingles", "cluster", "block", F.least("block", "other").alias("lo"),
                       F.greatest("block", "other").alias("hi"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("block").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        shingles_of = table.column("shingles").combine_chunks()
        values, offsets = shingles_of.flatten().to_numpy(), shingles_of.offsets.to_numpy()
        offsets = offsets - offsets[0]
        parts = [values[i:j] for i, j in zip(offsets, offsets[1:])]
        first = table.column("block").to_numpy() == key[1].as_py()
        links = block_links(table.column("rep").to_pylist(), table.column("comp").to_pylist(), parts,
                            first, scheme.similarity)
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("cluster", "lo", "hi").applyInArrow(run, "a long, b long")


def id_links(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): the classes of rows that share a doc_id, linked with the
    first of them. Ids of one class, nearly all, are left out before any join."""
    several = signed.filter(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("set_hash").alias("low"), F.max("set_hash").alias("high"), F.collect_set("set_hash").alias("sets"))
    several = several.filter(F.col("low") != F.col("high")).select("doc_id", F.explode("sets").alias("set_hash"))
    reps = several.join(classes.select("set_hash", "rep"), "set_hash")
    first = reps.groupBy(F.col("doc_id").alias("_id")).agg(F.min("rep").alias("a"))
    return reps.join(first, F.col("doc_id") == F.col("_id")).select("a", F.col("rep").alias("b")).filter(
        "a <> b").distinct()


def link_classes(docs: DataFrame, reps: DataFrame, scheme: Scheme, known: DataFrame) -> DataFrame:
    """(id, comp) of the classes that are linked with another; ``known``
    links (a, b) are taken as given."""
    keys = index_keys(reps, scheme)
    shared = keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("top"))
    shared = shared.filter(F.col("pivot") != F.col("top")).select("key", "pivot")
    members = saved(keys.join(shared, "key").filter("rep <> pivot"), "members")
    pairs = members.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    cands = saved(candidates(pairs, reps, scheme), "candidates")
    links = saved(confirmed(cands, docs, reps, scheme).unionByName(known), "links")
    comps = components(links)
    clusters = saved(unsettled(members.select("key", "rep"), comps), "clusters")
    if clusters.isEmpty():
        return comps
    more = cluster_links(clusters, docs, reps, scheme)
    return components(saved(links.unionByName(more), "links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    scheme: Scheme = THREE_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Rows without words (null and empty texts too) have no shingles, are
    linked with nothing and kept. Rows that share a doc_id are one document,
    linked with whatever one of its texts is linked with: they share its
    component (a row's n_shingles is its own). A row without doc_id is its
    own and kept.
    Ties need no rule: a component is named by its smallest doc_id. An empty
    table gives an empty result; extra columns are ignored."""
    prepare(docs.sparkSession)
    docs = only(docs, doc_id=id_col, text=text_col)
    signed = saved(signatures(docs, scheme), "signatures")
    classes = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = saved(classes.groupBy("set_hash").agg(
        F.min("doc_id").cast("long").alias("rep"), F.count(F.lit(1)).alias("rows"),
        F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "classes")
    comps = link_classes(docs, classes.select("rep", "set_hash", "n_shingles", "signature"), scheme,
                         id_links(signed, classes))
    named = classes.join(comps, F.col("rep") == F.col("id"), "left").select(
        F.col("set_hash").alias("_set"), F.coalesce("comp", "rep").alias("_comp"), "rows", "rep")
    named = saved(named.filter((F.col("rows") > 1) | (F.col("_comp") != F.col("rep")))
                  .select("_set", "_comp"), "named")
    joined = signed.select("doc_id", "n_shingles", "set_hash").join(
        named, (F.col("set_hash") == F.col("_set")) & F.col("doc_id").isNotNull(), "left")
    comp = F.coalesce("_comp", "doc_id").alias("component_id")
    out = joined.select("doc_id", "n_shingles", comp)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         scheme: Scheme = THREE_WORDS) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns unchanged. Of equal
    doc_ids among them one row stays (that with the smallest text)."""
    verdict = saved(near_duplicates(docs, id_col, text_col, scheme), "verdicts")
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key = f"c{names.index(id_col)}"
    gone = saved(verdict.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    rest = flat.join(small_or_plain(gone), F.col(key) == F.col("_gone"), "left_anti")
    again = saved(verdict.filter(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("_again")), "again")
    if not again.isEmpty():
        again = small_or_plain(again)
        once = rest.join(again, F.col(key) == F.col("_again"), "left_anti")
        others = [c for c in rest.columns if c != key]
        text = F.col(f"c{names.index(text_col)}").alias("_text")
        several = rest.join(again, F.col(key) == F.col("_again"), "left_semi").groupBy(key).agg(
            F.min(F.struct(text, *others)).alias("_row"))
        several = several.select(*[key if c == key else F.col("_row")[c].alias(c) for c in rest.columns])
        rest = once.unionByName(several)
    return rest.toDF(*names)

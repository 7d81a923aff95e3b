"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of at most ``CHUNK`` characters is counted in one task: pre-token by
pre-token, each different one encoded once, where plain signs leave no doubt
about the cut, otherwise as a whole. A longer one is cut into overlapping chunks that are encoded apart, by as many tasks as there
are, with offsets. Two neighbours are spliced at a boundary that both have in
their overlap and that is proven to be one of the whole text:

- The first step of a byte-level vocabulary finds the marks of its special
  tokens, the second cuts the text between them into pre-tokens by one
  left-to-right scan, the third works inside a pre-token. The scan keeps no
  state beyond its position, so two scans that share the start of a pre-token
  agree from there on.
- A scan that began at a true start finds only true starts, as long as it
  could see enough: a pre-token is decided by at most ``LOOKAHEAD`` characters
  behind its end, and a mark cut off by the end of the chunk begins less than
  its own length before that end. So every start that lies ``margin`` or more
  before the end of a chunk is true.

By induction the left chunk of a junction is true from its own junction on,
and a start that the right chunk shares is true there too. The tokens that
the two count twice are taken off. Where a junction finds no common start (a
run of letters longer than the overlap), the whole text is cut again with
wider overlaps and chunks, until it aligns or is one chunk.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revledger.llm.common import only, prepare, saved, small_or_plain

VOCABULARY = "byte_bpe_50k.json"
#: characters of a chunk without its overlap, of an overlap, and the factor
#: by which both widen
CHUNK, OVERLAP, WIDEN = 1 << 16, 512, 16
#: characters behind its end that decide a pre-token: the letters of a
#: contraction after its apostrophe, or the sign after the last white space
LOOKAHEAD = 3
#: characters of one call of the library, and bytes of chunks in one task
CALL_CHARS, TASK_BYTES = 1 << 20, 8 << 20
#: different pre-tokens in a generation of the cache; there are two, so that
#: the frequent ones stay
CACHE_WORDS = 400_000

# The pre-token pattern of byte-level vocabularies (a fixed value), with its
# classes written out for Latin-1: letters, numbers and white space there are
# the same for every version of Unicode.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r\x20"
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: signs beyond these are left to the library
NOT_PLAIN = "[^\t-\r\x20-\x7e\xa1-\xff]"


class Encoder:
    """The library of a vocabulary file: ``tokenizers`` for .json,
    ``sentencepiece`` for .model. ``margin`` is None when nothing is proven
    about boundaries, and every text is then encoded whole."""

    margin: int | None = None

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.counts = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task a core
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.counts = self.encoded
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        first, marks = parts["pre_tokenizer"] or {}, parts["added_tokens"]
        if (first.get("type") == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"]
                and parts["normalizer"] is None and parts["post_processor"] is None
                and not any(m["lstrip"] or m["rstrip"] or m["single_word"] for m in marks)):
            self.margin = LOOKAHEAD + max((len(m["content"]) for m in marks), default=0)
            self.doubt = re.compile("|".join([NOT_PLAIN, *(re.escape(m["content"]) for m in marks)]))
            self.young, self.old = {}, {}
            self.counts = self.looked_up

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def looked_up(self, texts: list[str]) -> list[int]:
        """Counts by pre-token. The library works inside pre-tokens, and one
        by itself is cut as it is in the text."""
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        words = [None if self.doubt.search(t) else PRE_TOKEN.findall(t) for t in texts]
        young, old = self.young, self.old
        new = []
        for w in set().union(*filter(None, words)).difference(young):
            if w in old:
                young[w] = old[w]
            else:
                new.append(w)
        young.update(zip(new, self.encoded(new)))
        whole = iter(self.encoded([t for t, w in zip(texts, words) if w is None]))
        return [next(whole) if w is None else sum(map(young.__getitem__, w)) for w in words]

    def starts(self, text: str) -> tuple[int, list[tuple[int, int]]]:
        """(tokens, (place, tokens before) of each pre-token)."""
        e = self.library.encode(text, add_special_tokens=False)
        words, offsets = e.word_ids, e.offsets
        return len(words), [(offsets[i][0], i) for i in range(len(words)) if not i or words[i] != words[i - 1]]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _calls(texts: list[str]):
    """``texts`` in lists of about ``CALL_CHARS``."""
    call, size = [], 0
    for t in texts:
        if call and size + len(t) > CALL_CHARS:
            yield call
            call, size = [], 0
        call.append(t)
        size += len(t)
    if call:
        yield call


def _short(path: str, chunk: int):
    """Rows with the bytes of the text, and its tokens if it is short or its
    digest if it is huge."""
    def run(batches):
        enc = encoder(path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            whole = [enc.margin is None or len(t) <= chunk for t in texts]
            counted = iter([n for c in _calls([t for t, w in zip(texts, whole) if w]) for n in enc.counts(c)])
            raw = [t.encode("utf-8") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(map(len, raw), pa.int64()),
                 pa.array([next(counted) if w else None for w in whole], pa.int64()),
                 pa.array([None if w else hashlib.sha256(r).hexdigest() for r, w in zip(raw, whole)],
                          pa.string())], names=["doc_id", "n_bytes", "n_tokens", "digest"])
    return run


def _cut(chunk: int, overlap: int):
    """Chunks of the texts of a task, each different text once."""
    def run(batches):
        seen = set()
        for b in batches:
            for digest, text in zip(b.column("digest").to_pylist(), b.column("text").to_pylist()):
                if digest in seen:
                    continue
                seen.add(digest)
                for no, at in enumerate(range(0, len(text), chunk)):
                    last = at + chunk + overlap >= len(text)
                    yield pa.RecordBatch.from_pydict(
                        {"digest": [digest], "no": [no], "at": [at], "last": [last],
                         "piece": [text[at : at + chunk + overlap]]}, schema=PIECES)
                    if last:
                        break
    return run


PIECES = pa.schema([("digest", pa.string()), ("no", pa.int64()), ("at", pa.int64()),
                    ("last", pa.bool_()), ("piece", pa.string())])
_PLACES = pa.list_(pa.struct([("place", pa.int64()), ("before", pa.int64())]))
CHUNKS = pa.schema([("digest", pa.string()), ("no", pa.int64()), ("last", pa.bool_()),
                    ("tokens", pa.int64()), ("head", _PLACES), ("tail", _PLACES)])


def _encode(path: str, chunk: int, overlap: int):
    """Tokens of each chunk, with the starts in its two overlaps; the chunks
    of repeated texts, which meet in one task, once."""
    def run(batches):
        enc, seen = encoder(path), set()
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if (r["digest"], r["no"]) in seen:
                    continue
                seen.add((r["digest"], r["no"]))
                tokens, starts = enc.starts(r["piece"])
                at, end = r["at"], len(r["piece"])
                places = [{"place": at + p, "before": n} for p, n in starts]
                rows.append({"digest": r["digest"], "no": r["no"], "last": r["last"], "tokens": tokens,
                             "head": [p for p in places if p["place"] < at + overlap and r["no"]],
                             "tail": [] if r["last"] else
                             [p for p in places if at + chunk <= p["place"] <= at + end - enc.margin]})
            yield pa.RecordBatch.from_pylist(rows, schema=CHUNKS)
    return run


def _spliced(chunks: DataFrame) -> DataFrame:
    """(digest, tokens) of each text; null where a junction has no start that
    both sides know."""
    left = chunks.filter(~F.col("last")).select("digest", (F.col("no") + 1).alias("no"), "tail",
                                                F.col("tokens").alias("left_tokens"))
    joined = chunks.filter("no > 0").select("digest", "no", "head").join(left, ["digest", "no"])
    known = F.map_from_entries("head")
    joined = joined.withColumn("meet", F.get(
        F.filter("tail", lambda t: F.map_contains_key(known, t["place"])), F.lit(0)))
    twice = F.col("left_tokens") - F.col("meet.before") + F.element_at(known, F.col("meet.place"))
    lost = joined.groupBy("digest").agg(F.sum(twice).alias("twice"), F.count_if(F.col("meet").isNull()).alias("open"))
    total = chunks.groupBy("digest").agg(F.sum("tokens").alias("tokens"))
    return total.join(lost, "digest", "left").select(
        "digest", F.when(F.coalesce("open", F.lit(0)) == 0,
                         F.col("tokens") - F.coalesce("twice", F.lit(0))).alias("tokens"))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs``: bytes of UTF-8,
    and the tokens that the vocabulary's library gives for the whole text,
    without added special tokens.

    A null or empty text has 0 of both. Repeated rows stay repeated (a huge
    text is counted once for all its copies), rows with one id and different
    texts are counted apart, a null id is an id like others, an empty table
    gives an empty result, extra columns are ignored."""
    import public_tokenizers

    spark = docs.sparkSession
    prepare(spark)
    path = public_tokenizers.path(vocabulary)
    base = only(docs, doc_id=id_col, text=text_col)
    counted = saved(base.mapInArrow(
        _short(path, chunk),
        f"doc_id {dict(base.dtypes)['doc_id']}, n_bytes long, n_tokens long, digest string"), "token-counts")
    huge = counted.filter(F.col("digest").isNotNull())
    size = huge.agg(F.sum("n_bytes")).first()[0]
    if not size:
        return counted.drop("digest")
    tasks = size // TASK_BYTES + 1
    texts = base.filter(F.length("text") > chunk).select(F.sha2("text", 256).alias("digest"), "text")
    done, wanted = [], None
    while True:
        some = texts if wanted is None else texts.join(small_or_plain(wanted), "digest", "left_semi")
        pieces = some.mapInArrow(_cut(chunk, overlap), "digest string, no long, at long, last boolean, piece string")
        chunks = saved(pieces.repartition(tasks, "digest", "no").mapInArrow(
            _encode(path, chunk, overlap), "digest string, no long, last boolean, tokens long, "
            "head array<struct<place:long,before:long>>, tail array<struct<place:long,before:long>>"), "token-chunks")
        totals = saved(_spliced(chunks), "token-totals")
        done.append(totals.filter(F.col("tokens").isNotNull()))
        wanted = totals.filter(F.col("tokens").isNull()).select("digest")
        if wanted.isEmpty():
            break
        overlap *= WIDEN
        chunk = max(chunk, 4 * overlap)
    totals = done[0]
    for more in done[1:]:
        totals = totals.unionByName(more)
    long = huge.drop("n_tokens").join(small_or_plain(totals), "digest").select(
        "doc_id", "n_bytes", F.col("tokens").alias("n_tokens"))
    return counted.filter(F.col("digest").isNull()).drop("digest").unionByName(long)

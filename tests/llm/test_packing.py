"""Packing and tokens: exact round trips."""

import zlib

import numpy as np
import pytest

from revledger.llm import packing
from tests.llm.conftest import documents, prose

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def words():
    return packing.WordTokenizer(public_tokenizers.path(packing.VOCABULARY))


TEXTS = ["", " ", "Hello, world. It's 2020; don't", "a.b,c !! .,", "É à ß ÿ × ÷ ª º µ", "x\x0by\x1cz\x85w\xa0v",
         "Σίγμας İstanbul 😀", "<|endoftext|> <|ENDOFTEXT|> a<|b", "0 10 200 a0b", "THE!! the&&& it's, 'll",
         "é Å", prose(3, 400)]


@pytest.mark.parametrize("limit", [600_000, 5])
def test_word_lookup_equals_library(words, limit, monkeypatch):
    monkeypatch.setattr(words, "CACHE_WORDS", limit)
    want = [e.ids for e in words.tokenizer.encode_batch(TEXTS, add_special_tokens=False)]
    for _ in range(2):
        assert [x.tolist() for x in words(TEXTS)] == want
        assert [words([t])[0].tolist() for t in TEXTS] == want


def check(rows, ids, window=packing.WINDOW):
    """Each id in exactly one piece, gapless sequences, no padding."""
    pieces, sequences = {}, {}
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        raw = own[r["start"]:r["start"] + r["length"]].astype("<u4").tobytes()
        assert zlib.crc32(raw) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in (pieces, sequences):
        for p in parts.values():
            at = 0
            for start, length in sorted(p):
                assert start == at and length > 0
                at += length
    for d, p in pieces.items():
        assert sum(n for _, n in p) == len(ids[d])
    sizes = [sum(n for _, n in s) for s in sequences.values()]
    assert all(n <= window and (n == window or n & (n - 1) == 0) for n in sizes)
    assert set(pieces) == set(ids)


def test_round_trip(spark, words):
    rows = [(i, prose(i, 37 * (i % 9) + 1) if i % 11 else None, "s") for i in range(150)]
    rows += [(900, prose(900, 9000), "s")]
    docs = documents(spark, rows).repartition(40)
    ids = {i: np.append(words([t or ""])[0], packing.END_ID) for i, t, _ in rows}
    check(packing.pack(docs).collect(), ids)


def test_ids_can_be_kept(spark, words):
    docs = documents(spark, [(1, prose(1, 3000), "s"), (2, "", "s")])
    out = packing.pack(docs, keep_ids=True).orderBy("doc_id", "start").collect()
    raw = b"".join(bytes(r["ids"]) for r in out if r["doc_id"] == 1)
    assert np.frombuffer(raw, "<u4").tolist() == [*words([prose(1, 3000)])[0].tolist(), packing.END_ID]


def test_packer_best_fit():
    p = packing.Packer(window=10, open_windows=2)

    def add(n):
        return [[len(x.ids) for x in s] for s in p.add(packing.Piece(0, 0, np.zeros(n, "<u4"), n))]
    assert add(6) == [] and add(7) == []
    assert add(3) == [[7, 3]]            # the tighter of the two that fit
    assert add(5) == []                  # a window is free again
    assert add(9) == [[6, 4], [5, 5]]    # none fits: the fullest is topped up, the rest fits the other
    assert add(7) == [] and [[len(x.ids) for x in s] for s in p.flush()] == [[4], [2], [1]]


def test_packing_odd_rows(spark, odd_rows):
    out = packing.pack(documents(spark, odd_rows)).collect()
    assert sum(r["length"] for r in out if r["doc_id"] == 1) == 1
    assert sum(r["length"] for r in out if r["doc_id"] == 8) == 2 * next(
        r["doc_tokens"] for r in out if r["doc_id"] == 8)
    assert packing.pack(documents(spark, [])).collect() == []

"""Token counts against the library on whole texts."""

import random

import pytest

from revledger.llm import token_counts as tc
from tests.llm.conftest import documents, prose

public_tokenizers = pytest.importorskip("public_tokenizers")

PARTS = ["don't", "'re", "'r", "!!'s", "'", "  ", " ", "\n\n", "\t ", "\r\n", "<|endoftext|>", "<|endof", "text|>",
         "<|", "é", "😀👍🏽", "漢字かな", "١٢٣", "2024", "abc", "x" * 70, "ABC", "...", " ", " ", "\x1c",
         "é", "_", "'ll'd", "Straße", "İ"]


def odd_text(r, n):
    return "".join(r.choice(PARTS) for _ in range(n))


@pytest.fixture(scope="module")
def encoder():
    return tc.encoder(public_tokenizers.path(tc.VOCABULARY))


def test_margin(encoder):
    assert encoder.margin == len("<|endoftext|>") + tc.LOOKAHEAD


def test_true_starts_of_a_chunk_are_those_of_the_text(encoder):
    """What the splice relies on, for every cut of odd texts."""
    r = random.Random(3)
    for _ in range(12):
        text = odd_text(r, 25)
        whole = {p for p, _ in encoder.starts(text)[1]}
        for end in range(1, len(text)):
            cut = {p for p, _ in encoder.starts(text[:end])[1]}
            assert {p for p in cut if p <= end - encoder.margin} == {p for p in whole if p <= end - encoder.margin}


def test_counts_by_pre_token_equal_the_library(encoder, monkeypatch):
    r = random.Random(11)
    signs = [chr(c) for c in range(256)] + ["'s", "'re", "'ll", "don't", "  ", "<|endoftext|>", "<|", "é", "ﬁ"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += [odd_text(r, r.randrange(50)) for _ in range(1000)] + [prose(i, 300) for i in range(20)] + ["", " ", "\n"]
    for words in (400_000, 50):
        monkeypatch.setattr(tc, "CACHE_WORDS", words)
        for i in range(0, len(texts), 100):
            assert encoder.counts(texts[i:i + 100]) == encoder.encoded(texts[i:i + 100])
    assert sum(encoder.doubt.search(t) is None for t in texts) > 100


@pytest.mark.parametrize("chunk,overlap", [(64, 32), (100, 20), (300, 100)])
def test_spliced_counts_equal_the_library(spark, encoder, chunk, overlap):
    r = random.Random(chunk)
    rows = [(i, odd_text(r, r.randrange(400)), "s") for i in range(60)]
    rows += [(100, "a" * 5000, "s"), (101, " " * 3000, "s"), (102, "ab " * 2000 + "y" * 700 + " z" * 900, "s"),
             (103, "!" * 999, "s"), (104, "<|endoftext|>" * 200, "s"), (105, prose(1, 3000), "s")]
    rows += [(r.randrange(50), t, s) for _, t, s in rows[::3]]
    got = tc.count_tokens(documents(spark, rows), chunk=chunk, overlap=overlap).collect()
    want = [(i, len(t.encode()), len(encoder.library.encode(t, add_special_tokens=False).ids)) for i, t, _ in rows]
    assert sorted(map(tuple, got)) == sorted(want)


def test_odd_rows(spark, encoder, odd_rows):
    got = tc.count_tokens(documents(spark, odd_rows), chunk=1000, overlap=64).collect()
    want = [(i, len((t or "").encode()), len(encoder.library.encode(t or "", add_special_tokens=False).ids))
            for i, t, _ in odd_rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tc.count_tokens(documents(spark, odd_rows).limit(0)).collect() == []


def test_widened_chunks_count_as_a_whole(spark, monkeypatch):
    """A run longer than the overlap fails to align and is cut again."""
    rounds = []
    cut = tc._cut
    monkeypatch.setattr(tc, "_cut", lambda c, o: rounds.append((c, o)) or cut(c, o))
    rows = [(1, "b " * 100 + "a" * 900 + " c" * 100, "s"), (2, "d e " * 300, "s")]
    got = dict((r["doc_id"], r["n_tokens"]) for r in tc.count_tokens(
        documents(spark, rows), chunk=200, overlap=24).collect())
    enc = tc.encoder(public_tokenizers.path(tc.VOCABULARY))
    assert got == {i: enc.counts([t])[0] for i, t, _ in rows}
    assert len(rounds) > 1 and rounds[1][1] == 24 * tc.WIDEN


def test_a_vocabulary_without_proof_is_encoded_whole(spark):
    enc = tc.encoder(public_tokenizers.path("piece_bpe_32k.model"))
    assert enc.margin is None
    text = prose(2, 500)
    got = tc.count_tokens(documents(spark, [(1, text, "s")]), vocabulary="piece_bpe_32k.model", chunk=100).first()
    assert got["n_tokens"] == enc.counts([text])[0]

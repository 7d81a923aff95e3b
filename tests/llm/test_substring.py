"""Repeated passages against brute force, and the FM-index against counting."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from revledger.llm import substring
from revledger.llm.fm_index import FMIndex
from tests.llm.conftest import documents, prose

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """kept words by row index; windows are judged on the input."""
    first, out = {}, []
    order = sorted((i for i, r in enumerate(rows) if r[0] is not None), key=lambda i: rows[i][0])
    for i in order:
        w = W.findall(rows[i][1] or "")
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j:j + window]), (rows[i][0], j))
    for d, t, _ in rows:
        w = W.findall(t or "")
        gone = set()
        for j in range(len(w) - window + 1):
            if d is not None and first[tuple(w[j:j + window])] < (d, j):
                gone.update(range(j, j + window))
        out.append((d, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def rows_of(seed):
    r = random.Random(seed)
    passages = [prose(1000 + i, 30 + 7 * i) for i in range(6)]
    rows = []
    for i in range(60):
        parts = [prose(i, r.randrange(40))]
        for _ in range(r.randrange(4)):
            p = r.choice(passages).split(" ")
            a = r.randrange(len(p) // 2)
            parts += [" ".join(p[a:a + r.randrange(10, len(p))]), prose(r.randrange(10 ** 6), r.randrange(25))]
        rows.append((r.randrange(10 ** 6), " ".join(parts), "s"))
    rows += [(10 ** 7 + i, rows[i][1], "s") for i in range(4)]  # whole copies
    rows += [(10 ** 8, "der " * 90 + prose(5, 30) + " der" * 50, "s"), (10 ** 8 + 1, "der " * 30, "s"),
             (10 ** 8 + 2, "a b c d e f g " * 30, "s")]
    return rows


@pytest.mark.parametrize("seed,heavy", [(1, 4000), (2, 3), (3, 1)])
def test_matches_brute_force(spark, seed, heavy, monkeypatch):
    monkeypatch.setattr(substring, "HEAVY", heavy)
    monkeypatch.setattr(substring, "SHARD_WORDS", 400 if heavy == 3 else 400_000)
    rows = rows_of(seed)
    got = substring.dedup_substrings(documents(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, substring.WINDOW)


def test_odd_rows(spark, odd_rows):
    got = substring.dedup_substrings(documents(spark, odd_rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(odd_rows, substring.WINDOW)
    assert substring.dedup_substrings(documents(spark, [])).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=6, max_size=120), st.integers(1, 5), st.data())
def test_index_counts_and_places(symbols, depth, data):
    text = np.array([*symbols, 0], dtype=np.int64)
    index = FMIndex(text, depth)
    pattern = data.draw(st.lists(st.integers(1, 6), min_size=depth, max_size=depth))
    low, high = index.search(np.array([pattern]))
    where = [i for i in range(len(symbols) - depth + 1) if symbols[i:i + depth] == pattern]
    assert int(high[0] - low[0]) == len(where)
    assert sorted(index.suffixes[low[0]:high[0]].tolist()) == where
    assert index.first_positions(low, high).tolist() == [where[0] if where else -1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=4, max_size=80), st.lists(st.integers(1, 4), min_size=1, max_size=60),
       st.integers(1, 4))
def test_stream_reports_each_window(symbols, streamed, depth):
    """Also pieces that are not in the index, where matches break off."""
    index = FMIndex(np.array([*symbols, 0], dtype=np.int64), depth)
    cut = len(streamed) // 2
    low, high, offset = index.stream(np.array(streamed), np.array([0, cut]), np.array([cut, len(streamed) - cut]))
    found = (high > low).tolist()
    want = [streamed[i:i + depth] for a, b in ((0, cut), (cut, len(streamed))) for i in range(a, b - depth + 1)]
    inside = {tuple(symbols[i:i + depth]) for i in range(len(symbols) - depth + 1)}
    assert found == [tuple(w) in inside for w in want]


def test_words_that_meet_modulo_a_power_of_two(spark):
    """Different words of 1024 letters that a polynomial hash modulo 2^64
    cannot tell apart: no window repeats."""
    x = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    y = x.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{x} {rest}", "s"), (2, f"{y} {rest}", "s"), (3, f"{x} {rest} end", "s")]
    got = {r["doc_id"]: r["n_removed"] for r in substring.dedup_substrings(documents(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 20}

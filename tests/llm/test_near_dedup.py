"""Near-duplicates against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from revledger.llm import near_dedup as nd
from tests.llm.conftest import documents, prose

W = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k, similarity):
    sets, parent = {}, {}
    for i, t, _ in rows:
        w = W.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
        parent[i] = i

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= similarity * (len(sets[a]) + len(sets[b]) - c):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def edited(text, seed, n):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10 ** 6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def families():
    """Copies, near copies at every distance, chains, and many texts that
    share a passage without being similar."""
    rows = [(i, prose(i, 60), "s") for i in range(40)]
    base = prose(500, 120)
    rows += [(100 + i, edited(base, i, i % 14), "s") for i in range(160)]
    chain = prose(600, 100)
    for i in range(12):
        rows.append((400 + i, chain, "s"))
        chain = edited(chain, i, 2)
    shared = prose(700, 60)
    rows += [(500 + i, shared + " " + prose(900 + i, 10 + i), "s") for i in range(60)]
    rows += [(700 + i, prose(3, 60).upper(), "s") for i in range(3)]
    random.Random(4).shuffle(rows)
    return rows


@pytest.mark.parametrize("scheme", [nd.THREE_WORDS, nd.FIVE_WORDS])
@pytest.mark.parametrize("block", [400_000, 300])
def test_matches_brute_force(spark, families, scheme, block, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(nd, "TILE", 16 if block == 300 else 128)
    got = nd.near_duplicates(documents(spark, families), scheme=scheme).collect()
    want = brute(families, scheme.words, scheme.similarity)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_index_meets_every_pair_within_distance():
    """The pigeonhole promise, for errors placed anywhere."""
    scheme, r = nd.THREE_WORDS, random.Random(2)
    for _ in range(300):
        wrong = set(r.sample(range(scheme.positions), scheme.max_distance))
        assert any(not wrong & set(kept) for kept in scheme.keys)
    worst = {c * nd.CHUNK + i for c in range(scheme.chunks) for i in range(2)}
    assert not any(not worst & set(kept) for kept in scheme.keys)  # one more than the distance


@settings(max_examples=60, deadline=None)
@given(st.lists(st.frozensets(st.integers(1, 30), min_size=1), min_size=2, max_size=12), st.integers(1, 100))
def test_tile_product_counts_intersections(sets, similarity):
    arrays = [np.array(sorted(s), dtype=np.int64) for s in sets]
    cut = len(sets) // 2
    got = {tuple(p) for p in nd.tile_links(arrays, range(cut), range(cut, len(sets)), similarity).tolist()}
    want = {(i, j) for i in range(cut) for j in range(cut, len(sets))
            if 100 * len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])}
    assert got == want


def test_odd_rows(spark, odd_rows):
    docs = documents(spark, odd_rows)
    out = nd.near_duplicates(docs).collect()
    assert len(out) == len(odd_rows)
    comp = {r["doc_id"]: r["component_id"] for r in out}
    assert comp[5] == 4 and comp[11] == 10 and comp[1] == 1 and comp[2] == 2 and comp[None] is None
    kept = nd.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [1, 2, 3, 4, 6, 7, 8, 9, 10, None, None]))


def test_empty_table(spark):
    assert nd.near_duplicates(documents(spark, [])).collect() == []
    assert nd.drop_near_duplicates(documents(spark, [])).collect() == []


def test_components_of_long_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r["id"]: r["comp"] for r in nd.components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_rows_that_share_an_id_are_one_document(spark):
    a, b, c = prose(41, 60), prose(42, 60), prose(43, 60)
    rows = [(3, a, "s"), (7, a, "s"), (7, b, "s"), (9, edited(b, 1, 1), "s"), (11, c, "s"), (12, c, "s"), (12, None, "s"),
            (20, prose(44, 60), "s"), (20, prose(45, 60), "s")]
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in nd.near_duplicates(documents(spark, rows)).collect()]
    assert sorted(x for x in got if x[0] not in (12, 20)) == [
        (3, 3, True), (7, 3, False), (7, 3, False), (9, 3, False), (11, 11, True)]
    assert sorted(x for x in got if x[0] == 20) == [(20, 20, True)] * 2
    # a row without words is linked with nothing, whatever shares its id
    assert sorted(x for x in got if x[0] == 12) == [(12, 11, False), (12, 12, True)]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n)), "".join("ba"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_meet_modulo_a_power_of_two(spark):
    x, y = thue_morse(1024)
    rest = " ".join(f"w{i}" for i in range(2))
    got = nd.near_duplicates(documents(spark, [(1, f"{x} {rest}", "s"), (2, f"{y} {rest}", "s")])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 2)]

"""Quality rules and personal data: brute force, traps, odd rows."""

import re

import pytest

from revledger.llm import pii, quality_rules
from tests.llm.conftest import documents, prose

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repeats(text):
    w = W.findall(text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i:i + 3]), []).append(i)
    return len({p for v in at.values() if len(v) > 1 for i in v for p in (i, i + 1, i + 2)})


@pytest.mark.parametrize("text", ["", "a b c a b c", "a a a a", "a a a", "x y z x y z x y", prose(5, 300)])
def test_measures_match_brute_force(text):
    m = dict(zip(quality_rules.MEASURES, quality_rules.measure(text)))
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if W.search(x) and x in lines[:i])
    assert m["n_repeat_words"] == brute_repeats(text)
    assert m["n_dup_lines"] == dup
    assert m["word_chars"] == sum(map(len, W.findall(text)))


def test_capitals_count_outside_ascii():
    m = dict(zip(quality_rules.MEASURES, quality_rules.measure("ÉA été straße #")))
    assert (m["n_upper"], m["n_cased"], m["n_symbols"]) == (2, 11, 1)


def test_rules_odd_rows(spark, odd_rows):
    out = quality_rules.quality_rules(documents(spark, odd_rows)).collect()
    assert len(out) == len(odd_rows)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["n_words"] == by[2]["n_words"] == by[3]["n_words"] == 0
    assert by[1]["base_failed"] and not by[1]["kept"]
    assert by[10]["kept"]


def test_rules_empty_table(spark):
    assert quality_rules.quality_rules(documents(spark, [])).collect() == []
    assert quality_rules.keep_documents(documents(spark, [])).collect() == []


def test_bad_host_is_rejected_and_others_stay(spark):
    rows = [(i, "bad $$$ ### %%% " * 30, "spam") for i in range(60)]
    rows += [(100 + i, prose(i, 90), "spam" if i == 0 else "good") for i in range(200)]
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(documents(spark, rows)).collect()}
    assert out[100]["host_rejected"] and not out[100]["kept"] and out[100]["broken"] == []
    assert all(out[100 + i]["kept"] for i in range(1, 200))


def test_keep_documents_agrees_and_keeps_columns(spark, odd_rows):
    docs = documents(spark, odd_rows)
    kept = quality_rules.keep_documents(docs)
    assert kept.columns == docs.columns
    verdict = [r["doc_id"] for r in quality_rules.quality_rules(docs).filter("kept").collect()]
    assert sorted(map(str, verdict)) == sorted(str(r["doc_id"]) for r in kept.collect())


BASE = [
    ("a.b+c@d-e.org, x", ["email:0:13"]), ("a@b", []), ("ip 10.0.0.255 and 10.0.0.256", ["ip:3:13"]),
    ("4111 1111-1111 1111", ["card:0:19"]), ("4111 1111 1111 1112", []), ("+1 (555) 123-4567.", ["phone:0:17"]),
    ("+12", []), ("1.2.3.4.5", ["ip:0:7"]),
]


@pytest.mark.parametrize("text,spans", BASE)
def test_plain_identifiers(text, spans):
    assert pii.join_spans(pii.find(text)).split(",") == (spans or [""])


DISGUISED = [
    ("mail bob [at] example [dot] org now", "bob [at] example [dot] org", "email"),
    ("mail bob at example dot org now", "bob at example dot org", "email"),
    ("bоb@example.org", "bоb@example.org", "email"),
    ("call plus four four two zero seven nine four six zero nine five eight ok",
     "plus four four two zero seven nine four six zero nine five eight", "phone"),
    ("at 10 dot 0 dot 0 dot 1 here", "10 dot 0 dot 0 dot 1", "ip"),
    ("４１１１ 1111 1111 1111", "４１１１ 1111 1111 1111", "card"),
]


@pytest.mark.parametrize("text,part,kind", DISGUISED)
def test_disguises_map_back(text, part, kind):
    _, spans = pii.all_spans(text)
    assert (text.index(part), text.index(part) + len(part), kind) in spans
    assert part not in pii.mask_text(text)


@pytest.mark.parametrize("text", [
    "look at example.org for more", "we met at noon. dot the line", "one two three", prose(8, 500),
    "Привет мир, как дела", "one at a time, two at a time", ""])
def test_clean_text_stays(text):
    assert pii.all_spans(text) == ([], [])
    assert pii.mask_text(text) == text


def test_base_spans_stay_beside_disguised_ones():
    text = "a@b.org and bob (at) c (dot) org"
    base, spans = pii.all_spans(text)
    assert base == [(0, 7, "email")] and set(base) < set(spans)


def test_pii_odd_rows(spark, odd_rows):
    docs = documents(spark, odd_rows)
    assert pii.find_pii(docs).count() == len(odd_rows)
    masked = pii.mask_pii(docs, "text", "n_chars")
    assert masked.columns == docs.columns and masked.schema == docs.schema
    assert sorted(map(str, masked.select("text").collect())) == sorted(map(str, docs.select("text").collect()))
    assert pii.find_pii(documents(spark, [])).collect() == []


@pytest.mark.parametrize("text,source,kind", [
    ("he wrote \u201cb\u043eb@example.org\u201d to us", "b\u043eb@example.org", "email"),
    ("call +1\u2011555\u2011010\u20119999 now", "+1\u2011555\u2011010\u20119999", "phone"),
    ("caf\u00e9:b\u043eb@example.org", "b\u043eb@example.org", "email"),
    ("\u90ae\u7bb1\uff42\uff4f\uff42\uff20\uff58\uff0e\uff4f\uff52\uff47\u3002\u8c22\u8c22",
     "\uff42\uff4f\uff42\uff20\uff58\uff0e\uff4f\uff52\uff47", "email"),
    ("\u7535\u8bdd+\uff18\uff16\uff11\uff13\uff18\uff10\uff10\uff11\uff13\uff18\uff10\uff10\uff10\u8bf7",
     "+\uff18\uff16\uff11\uff13\uff18\uff10\uff10\uff11\uff13\uff18\uff10\uff10\uff10", "phone"),
    ("mail a.b.c.d.e.f.g [at] h.i.j.k.l.m.org now", "a.b.c.d.e.f.g [at] h.i.j.k.l.m.org", "email")])
def test_disguises_beside_other_signs(text, source, kind):
    at = text.index(source)
    assert (at, at + len(source), kind) in pii.all_spans(text)[1]
    assert source not in pii.mask_text(text)


def test_words_of_other_scripts_beside_an_address_stay():
    text = "\u0441\u043b\u043e\u0432\u043ebob@example.org"
    assert pii.all_spans(text)[0] == pii.all_spans(text)[1] == [(5, 20, "email")]

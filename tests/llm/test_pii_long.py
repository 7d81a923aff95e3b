"""Personal data: the linear finder against the contract's patterns, and long
texts without a break."""

import random
import re
import time

import pytest

from revledger.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def by_patterns(text):
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@pytest.mark.parametrize("signs", ["ab@.", "a@.-_ ", "012.", "025. ", "0 1-2", "+1 ().-9", "a1@.+ -\n", "é@a.1٣"])
def test_finder_equals_the_patterns(signs):
    r = random.Random(signs)
    for n in [*range(30)] * 60:
        text = "".join(r.choice(signs) for _ in range(n))
        assert pii.find(text) == by_patterns(text), text
    cards = " ".join("".join(r.choice("0123456789- ") for _ in range(18)) for _ in range(400))
    assert pii.find(cards) == by_patterns(cards)


def met_one_by_one(text):
    """Added spans by comparing each with all others."""
    base, tape = pii.find(text), pii.Tape(text)
    for step in pii.TRANSDUCERS:
        tape = step(tape)
    spans = list(base)
    for s, e, kind in pii.find(tape.text) if tape.text != text else []:
        a, b = tape.source(s, e)
        met = [x for x in spans if a < x[1] and x[0] < b]
        if all(k == kind and a <= x and y <= b and (x, y) != (a, b) for x, y, k in met):
            spans.append((a, b, kind))
    return base, sorted(spans, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_spans_equal_comparing_all():
    r = random.Random(5)
    parts = ["bob", " at ", " dot ", "com", "@", ".", "one two three four ", "plus one ", "5", "é", "о", "10", "[.]",
             " (at) ", "４", "+1 ", "555-0100 ", "10.0.0.1", " ", "​", "4111 1111 1111 1111", "x.org", "a@b.cd "]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randrange(30)))
        assert pii.all_spans(text) == met_one_by_one(text), text


def test_digits_longer_than_an_integer():
    assert pii.find("0" * 5000 + ".1.1.1") == [(0, 5006, "ip")]
    assert pii.find("1" * 5000 + ".1.1.1") == []


@pytest.mark.parametrize("text", [
    "7" * 1_000_000, "deadbeef" * 125_000, "a" * 1_000_000 + "@", "@" + "a" * 1_000_000, "a@" * 300_000,
    "1." * 400_000, "one two three " * 70_000, "one" * 300_000, " " * 1_000_000 + "at x dot y", "+1" + "(" * 1_000_000,
    "a.b" * 300_000 + "@x", "bob@x.org " * 20_000 + " bob (at) x (dot) org " * 10_000,
    "漢" * 300_000, "漢字 a@b.cd" * 50_000, "x" * 1_000_000 + "о", "о" * 300_000 + " 1", "4111 1111 1111 1111 " * 30_000],
    ids=lambda t: f"{t[:9]!r}{len(t)}")
def test_long_runs_are_linear(text):
    start = time.time()
    pii.all_spans(text)
    assert time.time() - start < 8


def test_long_top_level_domains_and_bracketed_dots():
    assert pii.all_spans("bob (at) example (dot) international")[1] == [(0, 36, "email")]
    assert pii.all_spans("see 10[.]0[.]0[.]1 now")[1] == [(4, 18, "ip")]

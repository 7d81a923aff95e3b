"""Personal data with offset-preserving deobfuscation.

Identifiers are first found in the text as it is. Then a chain of small
transducers rewrites disguises (look-alike letters and digits, spelled
digits, "at" and "dot" in their usual brackets) while carrying, for each
output character, the span of source characters that it came from.
Identifiers found in the rewritten text are mapped back to source spans and
added where they overlap none found before, or hold more of the same one.

Each text is handled alone inside a task: no shuffle, any size.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from revledger.llm.common import only, prepare

KINDS = ("email", "ip", "card", "phone")

#: fixed by the data contract: email local part and domain, the groups of an
#: address (four in a row are one), card and phone
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
GROUPS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: look-alikes of Latin letters that compatibility folding leaves alone
HOMOGLYPHS = dict(zip("аеорсухіјѕԁɡһοαεικνρτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТХІЈЅ",
                      "aeopcyxijsdghoaeiknptuABEZHIKMNOPTYXABEKMHOPCTXIJS"))
#: hyphens and dashes that compatibility folding leaves alone, and the minus
HYPHENS = frozenset("\u2010\u2011\u2012\u2013\u2212")
ZERO_WIDTH = frozenset("\u200b\u200c\u200d\u2060\ufeff\u00ad")

SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
           "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_DIGIT_WORD = "|".join(SPELLED)
#: a run of at least four spelled or written digits with at least one spelled
_SPELLED_RUN = re.compile(
    rf"(?<![A-Za-z0-9])(?:plus[\x20-]+)?(?:(?:{_DIGIT_WORD}|[0-9]+)[\x20-]+){{3,}}"
    rf"(?:{_DIGIT_WORD}|[0-9]+)(?![A-Za-z0-9])", re.I)
_SPELLED_PART = re.compile(rf"plus[\x20-]+|(?:{_DIGIT_WORD})|[0-9]+|[\x20-]+", re.I)
#: a bracketed "at" / "dot", or the bare words between word characters; as
#: many dots as an address can have (64 and 253 characters)
_AT = r"[\x20]*[\[({<][\x20]*(?:at|@)[\x20]*[\])}>][\x20]*|[\x20]+at[\x20]+|[\x20]*@[\x20]*"
_DOT = r"[\x20]*[\[({<][\x20]*(?:dot|\.)[\x20]*[\])}>][\x20]*|[\x20]+dot[\x20]+"
_DISGUISED_EMAIL = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:(?:{_DOT}|\.)[A-Za-z0-9_%+-]+){{0,31}}(?P<at>{_AT})"
    rf"[A-Za-z0-9-]+(?:(?:{_DOT}|\.)[A-Za-z0-9-]+){{0,126}}(?:{_DOT}|\.)[A-Za-z]{{2,63}}(?![A-Za-z0-9])",
    re.I)
_DISGUISED_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:{_DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9.])", re.I)
_AT_RE, _DOT_RE = re.compile(_AT, re.I), re.compile(_DOT, re.I)
_HINT = re.compile(r"@|\bat\b|\bdot\b|[\[({<]\x20*\.\x20*[\])}>]", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str):
    """A match begins where the run of local signs before its "@" begins, or
    where the match before ends: one look back from each "@"."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = done + len(text[done:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def _addresses(text: str):
    """Groups of digits joined by single dots, four at a time."""
    if text.count(".") < 3:
        return
    for m in GROUPS.finditer(text):
        groups = m[0].split(".")
        if len(groups) < 4:
            continue
        at = m.start()
        for i in range(0, len(groups) - 3, 4):
            four = groups[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(g := p.lstrip("0")) <= 3 and int(g or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the identifiers written plainly in ``text``:
    leftmost, not overlapping within a kind, failing matches dropped. Time is
    linear in the text, whatever runs it has."""
    out = []
    if "@" in text:
        out += [(s, e, "email") for s, e in _emails(text)]
    out += [(s, e, "ip") for s, e in _addresses(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=_by_start)


def _by_start(span):
    return span[0], KINDS.index(span[2])


class Tape:
    """A rewritten text with the source span of every character, as two
    arrays; without them, character i came from source character i."""

    def __init__(self, text: str, begin: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text, self.begin, self.end = text, begin, end

    def source(self, start: int, end: int) -> tuple[int, int]:
        if self.begin is None:
            return start, end
        return int(self.begin[start]), int(self.end[end - 1])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> "Tape":
        """Replace the given (start, end, new) parts, in order."""
        if not edits:
            return self
        n = len(self.text)
        begin = np.arange(n) if self.begin is None else self.begin
        end = np.arange(1, n + 1) if self.end is None else self.end
        text, at = [], 0
        for s, e, new in edits:
            text += [self.text[at:s], new]
            at = e
        text.append(self.text[at:])
        first, last, size = np.array([(s, e, len(new)) for s, e, new in edits]).T
        gone = np.zeros(n + 1, dtype=np.int64)
        gone[first] += 1
        np.subtract.at(gone, last, 1)
        kept = np.cumsum(gone[:-1]) == 0
        place = np.repeat(np.cumsum(kept)[first] - kept[first], size)
        return Tape("".join(text), np.insert(begin[kept], place, np.repeat(begin[first], size)),
                    np.insert(end[kept], place, np.repeat(end[last - 1], size)))


#: beyond ASCII and the Latin letters with marks
_FOREIGN = re.compile("[^\x00-\x7fÀ-ſ]")


def fold_char(c: str) -> str:
    if c in ZERO_WIDTH:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if c in HYPHENS:
        return "-"
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    k = unicodedata.normalize("NFKC", c)
    return k if k.isascii() and k and not k.isspace() else c


def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0] if c.isalpha() else ""


def _runs(word: str, folded: list[str]):
    """(start, end) of the runs of ``word`` that fold to ASCII. Look-alikes
    at the edge of a run stay with a neighbour of their own script: they are
    the rest of its word."""
    start = 0
    for stop in [*(i for i, f in enumerate(folded) if not f.isascii()), len(word)]:
        a, b = start, stop
        if a:
            script = _script(word[a - 1])
            while a < b and script and word[a] in HOMOGLYPHS and _script(word[a]) == script:
                a += 1
        if stop < len(word):
            script = _script(word[stop])
            while a < b and script and word[b - 1] in HOMOGLYPHS and _script(word[b - 1]) == script:
                b -= 1
        if a < b:
            yield a, b
        start = stop + 1


def homoglyphs(t: Tape) -> Tape:
    """Look-alike letters, digits of other scripts, hyphens and full-width
    forms to ASCII; invisible characters go. This is done in every run of
    characters that fold to ASCII, whatever stands beside it (quotes,
    accented letters, scripts without spaces), but not within words of other
    scripts."""
    if t.text.isascii():
        return t
    edits = []
    for m in re.finditer(r"\S+", t.text):
        w = m[0]
        if w.isascii() or not _FOREIGN.search(w):
            continue
        folded = [fold_char(c) if ord(c) > 127 else c for c in w]
        if folded != list(w):
            edits += [(m.start() + i, m.start() + i + 1, folded[i])
                      for a, b in _runs(w, folded) for i in range(a, b) if folded[i] != w[i]]
    return t.rewrite(edits)


def spelled_digits(t: Tape) -> Tape:
    """Runs of spelled digits to digits: single separators between them go,
    wider ones become one space; a leading "plus" becomes the sign."""
    edits = []
    for m in _SPELLED_RUN.finditer(t.text):
        if not re.search(_DIGIT_WORD, m[0], re.I):
            continue
        for p in _SPELLED_PART.finditer(m[0]):
            s, e = m.start() + p.start(), m.start() + p.end()
            low = p[0].lower()
            new = "+" if low.startswith("plus") else SPELLED.get(low)
            if new is None and not low.isdigit():
                new = ""
            if new is not None:
                edits.append((s, e, new))
    return t.rewrite(edits)


def at_dot(t: Tape) -> Tape:
    """Disguised "at" and "dot" to signs, inside what then is an address.
    The bare word "at" counts only before a domain with a disguised or
    written dot."""
    if not _HINT.search(t.text):
        return t
    edits = []
    for pattern in (_DISGUISED_EMAIL, _DISGUISED_IP):
        for m in pattern.finditer(t.text):
            parts = []
            if "at" in m.re.groupindex:
                bare = m["at"].strip().lower()
                plain_dots = not _DOT_RE.search(t.text, m.end("at"), m.end())
                if plain_dots and bare == "at":
                    continue  # "look at example.org" is prose
                parts = [(m.start("at"), m.end("at"), "@")]
                gaps = [(m.start(), m.start("at")), (m.end("at"), m.end())]
            else:
                gaps = [(m.start(), m.end())]
            for a, b in gaps:
                parts += [(d.start(), d.end(), ".") for d in _DOT_RE.finditer(t.text, a, b)]
            edits += parts
    edits.sort()
    clean, reach = [], -1
    for e in edits:
        if e[0] >= reach:
            clean.append(e)
            reach = e[1]
    return t.rewrite(clean)


TRANSDUCERS = (homoglyphs, spelled_digits, at_dot)


def all_spans(text: str) -> tuple[list, list]:
    """(plain spans, plain and deobfuscated spans), each by start and kind."""
    base = find(text)
    tape = Tape(text)
    for step in TRANSDUCERS:
        tape = step(tape)
    if tape.text == text:
        return base, base
    # spans of a kind, plain or added, follow one another, so those that a
    # new span meets are found by bisection
    known = {(k, new): ([], []) for k in KINDS for new in (False, True)}
    for s, e, kind in base:
        known[kind, False][0].append(s)
        known[kind, False][1].append(e)
    spans = list(base)
    for s, e, kind in find(tape.text):
        a, b = tape.source(s, e)
        if all(k == kind and a <= x and y <= b and (x, y) != (a, b) for k, x, y in _met(known, a, b)):
            spans.append((a, b, kind))
            known[kind, True][0].append(a)
            known[kind, True][1].append(b)
    return base, sorted(spans, key=_by_start)


def _met(known: dict, a: int, b: int):
    """(kind, start, end) of the known spans that overlap [a, b)."""
    for (kind, _), (starts, ends) in known.items():
        for i in range(bisect_right(ends, a), len(starts)):
            if starts[i] >= b:
                break
            yield kind, starts[i], ends[i]


def join_spans(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts of plain identifiers by kind, ``base``, ``spans``) for
    every row; spans are kind:start:end in code points of the source.

    A null or empty text has none. Repeated rows stay repeated, an empty
    table gives an empty result, extra columns are ignored."""
    prepare(docs.sparkSession)
    base = only(docs, doc_id=id_col, text=text_col)

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                plain, every = all_spans(t or "")
                text = join_spans(plain)
                rows.append((*[sum(s[2] == k for s in plain) for k in KINDS],
                             hashlib.sha256(text.encode()).hexdigest(), text, join_spans(every)))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "base", "spans"])

    return base.mapInArrow(
        run, f"doc_id {dict(base.dtypes)['doc_id']}, " + ", ".join(f"n_{k} long" for k in KINDS)
        + ", base_sha256 string, base string, spans string")


def mask_text(text: str | None) -> str | None:
    """``text`` with every span replaced by its kind in angle brackets.
    Overlapping spans are replaced together, under the first one's kind."""
    if not text:
        return text
    _, spans = all_spans(text)
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if spans else text


def mask_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with the identifiers in ``text_col`` masked; every row and
    column stays. ``length_col``, if named, is set to the new length in code
    points (null for a null text)."""
    prepare(docs.sparkSession)
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    t = names.index(text_col)
    n = names.index(length_col) if length_col in names else None

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            new = [mask_text(x) for x in cols[t].to_pylist()]
            cols[t] = pa.array(new, cols[t].type)
            if n is not None:
                cols[n] = pa.array([None if x is None else len(x) for x in new], cols[n].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return flat.mapInArrow(run, flat.schema).toDF(*names)

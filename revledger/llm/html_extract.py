"""Main text of web pages by page differencing.

A page is cut into text blocks ("lines"). Blocks inside elements that never
hold main text (menus, footers, forms, adverts, ...) are dropped by their
tag, role or class. What pages of a host repeat is found by differencing:
within each host, pages are ordered by URL path, each page is paired with
the nearest on either side that is no copy of it, the lines of a pair are
aligned by longest common subsequence, and aligned lines are deleted.

Pages of a host with equal lines are one page, whatever their URLs. Two pages
are copies, not two pages in one frame, if what either has apart is little
beside the long lines that both have: frames are short lines beside texts of
their own, copies long lines beside next to nothing.

Blocks inside an ``article`` or ``main`` element are taken as declared and
are not deleted; what stands beside them is no main text of that page, but it
is read as the frame that neighbours without such an element share. Of several such elements, that with most text is the main
text; one that is next to nothing beside the rest of the page (a teaser)
declares nothing.

Only line hashes are shuffled for the alignment. A global order by
(host, path) is numbered and cut into runs of ``RUN`` pages, each with
``REACH`` more pages on either side, so that a host with a third of all pages
is many tasks and the result does not depend on partitions. A page with only
copies in reach is led on, from copy to copy, to the page behind them.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import reduce
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revledger.llm.common import only, prepare, saved, small_or_plain
from revledger.operators.sequence import number_rows

RUN, REACH = 64, 4
#: characters of a long line; what copies have apart, as a share of the long
#: lines that they have in common
LONG_LINE, APART = 80, 0.2
#: share of the text outside that a declared element has to have at least
TEASER = 0.05

# Element names and class words with a fixed meaning in HTML practice.
SKIP_TAGS = frozenset("script style noscript template head title nav footer aside form button select "
                      "option textarea input label iframe object embed svg math canvas audio video "
                      "map menu dialog datalist".split())
MAIN_TAGS = frozenset(("article", "main"))
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt "
                       "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup "
                       "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
                       "thead tr ul caption".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset(("script", "style"))
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert "
                       "alertdialog form toolbar".split())
SKIP_CLASSES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo "
                         "promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
                         "sidebar aside widget widgets footer masthead topbar cookie cookies consent "
                         "gdpr notice notices notification alert popup modal overlay newsletter "
                         "subscribe subscription signup login comment comments respond replies "
                         "disqus social share sharing related recommended pagination pager toc "
                         "copyright disclaimer legal search hidden".split())
#: words that say where a frame's part is or how it looks, not what it holds
FRAME_WORDS = frozenset("site main page left right top bottom global primary secondary header list box bar wrapper "
                        "wrap container content area slot section block link links item items inner outer unit "
                        "sticky floating fixed panel column col row group module mobile desktop thread icon icons "
                        "buttons button image text area div".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: elements that a new one of their kind ends, and what holds them
SIBLINGS = {**dict.fromkeys(("li",), (("li",), ("ul", "ol", "menu", "dir"))),
            **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))),
            **dict.fromkeys(("td", "th"), (("td", "th"), ("tr", "table"))),
            **dict.fromkeys(("tr",), (("tr",), ("table", "thead", "tbody", "tfoot"))),
            **dict.fromkeys(("option",), (("option",), ("select", "datalist")))}
_CLASS_WORD = re.compile(r"[a-z]+")


def names_frame(token: str) -> bool:
    """Whether a class or id names a part that is no main text: one of the
    words, or a compound of them with nothing but words of place or form."""
    if token in SKIP_CLASSES:
        return True
    words = _CLASS_WORD.findall(token)
    return len(words) > 1 and any(w in SKIP_CLASSES for w in words) and all(
        w in SKIP_CLASSES or w in FRAME_WORDS for w in words)


def skipped(tag: str, attrs: list[tuple[str, str | None]], in_main: bool) -> bool:
    """Whether an element and all inside it is no main text."""
    if tag in SKIP_TAGS or tag == "header" and not in_main:
        return True
    if not attrs or tag in ("html", "body") or tag in MAIN_TAGS:
        return False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value and value.lower() in SKIP_ROLES:
            return True
        if name == "style" and value and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name == "class" and value and any(names_frame(t) for t in value.lower().split()):
            return True
        # inside declared main text an id is mostly the anchor of a section
        if name == "id" and value and tag not in HEADINGS:
            t = value.lower()
            if t in SKIP_CLASSES if in_main else names_frame(t):
                return True
    return False


class Blocks(HTMLParser):
    """Collects (text, number of the declared element or 0) blocks in page
    order; an element inside a declared one belongs to it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []  # tag, skipped, main
        self.skip = self.main = self.declared = 0
        self.text: list[str] = []
        self.blocks: list[tuple[str, int]] = []

    def end_block(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text = []
            if text:
                self.blocks.append((text, self.declared if self.main else 0))

    def end_siblings(self, tag: str) -> None:
        """What the start of ``tag`` ends by itself: an open paragraph, with
        whatever inline elements are open in it, and an open element of the
        same kind up to the one that holds both."""
        for i in range(len(self.stack) - 1, -1, -1):
            open_tag = self.stack[i][0]
            if open_tag == "p":
                self.pop_to(i)
            if open_tag == "p" or open_tag in BLOCK_TAGS:
                break
        kinds, holders = SIBLINGS.get(tag, ((), ()))
        for i in range(len(self.stack) - 1, -1, -1) if kinds else ():
            if self.stack[i][0] in holders:
                break
            if self.stack[i][0] in kinds:
                self.pop_to(i)
                break

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            if not self.skip:
                self.text.append(" ")
            return
        if tag in BLOCK_TAGS or tag in SIBLINGS:
            if tag in BLOCK_TAGS:
                self.end_block()
            self.end_siblings(tag)
        if tag in VOID_TAGS:
            return
        skip, main = skipped(tag, attrs, self.main > 0), tag in MAIN_TAGS
        self.declared += main and not self.main
        self.stack.append((tag, skip, main))
        self.skip += skip
        self.main += main

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS and tag not in RAW_TAGS:
            self.handle_endtag(tag)

    def pop(self) -> str:
        tag, skip, main = self.stack.pop()
        self.skip -= skip
        self.main -= main
        return tag

    def pop_to(self, i: int) -> None:
        while len(self.stack) > i:
            self.pop()

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.end_block()
        if any(t == tag for t, _, _ in self.stack):
            while self.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def page_blocks(html: str | None) -> list[tuple[str, bool, bool]]:
    """(text, declared main, may be main text) of all blocks that differencing
    reads: those beside declared main text too, which neighbours that declare
    none have in their frames."""
    if not html:
        return []
    p = Blocks()
    p.feed(html)
    p.close()
    p.end_block()
    size: dict[int, int] = {}
    for text, n in p.blocks:
        size[n] = size.get(n, 0) + len(text)
    outside = size.pop(0, 0)
    best = max(size, key=lambda n: (size[n], -n), default=0)
    if not best or size[best] < TEASER * outside:
        return [(text, False, True) for text, _ in p.blocks]
    # a page that declares its main text has no other
    return [(text, n == best, n == best) for text, n in p.blocks]


def blocks(html: str | None) -> list[tuple[str, bool]]:
    """(text, declared main) of the blocks that may be main text."""
    return [(text, main) for text, main, kept in page_blocks(html) if kept]


def url_parts(url: str | None) -> tuple[str, str]:
    """(host, path) in lower case, without scheme, port, query and fragment."""
    rest = (url or "").split("#", 1)[0].split("?", 1)[0]
    rest = rest.split("://", 1)[-1]
    host, _, path = rest.partition("/")
    return host.rpartition("@")[2].split(":", 1)[0].lower(), path.strip("/").lower()


def line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(),
                          "little", signed=True)


def page_key(host: str, hashes: list[int]) -> bytes:
    """Pages of a host with equal lines share their key."""
    h = hashlib.blake2b(host.encode("utf-8", "surrogatepass") + b"\0", digest_size=16)
    h.update(struct.pack(f"<{len(hashes)}q", *hashes))
    return h.digest()


#: bits of alignment rows that are held at once
_ROW_BITS = 1 << 29


def _rows(a: list[int], b: list[int], keep: bool) -> list[int]:
    """Bit rows of the longest common subsequence of ``a`` and ``b``: bit j of
    row i is 0 where b[j] makes that of a[:i + 1] and b[:j + 1] longer. The
    last row only, unless ``keep``. One step a line, on whole rows at once."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    mask = (1 << len(b)) - 1
    row, rows = mask, []
    for x in a:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & mask
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _lengths(row: int, n: int) -> np.ndarray:
    """Lengths for every beginning of b, from none on."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """(i, j) of a longest common subsequence. Rows that would not fit are
    not held: the halves of ``a`` are then aligned with the parts of ``b``
    that give the longest in all."""
    if not a or not b:
        return []
    if len(a) * len(b) > _ROW_BITS and len(a) > 1:
        half = len(a) // 2
        front = _lengths(_rows(a[:half], b, False)[0], len(b))
        back = _lengths(_rows(a[half:][::-1], b[::-1], False)[0], len(b))
        cut = int(np.argmax(front + back[::-1]))
        return _aligned(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in _aligned(a[half:], b[cut:])]
    rows, out = _rows(a, b, True), []
    i, j = len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            out.append((i, j))
            i, j = i - 1, j - 1
    return out[::-1]


def common_lines(a: list[int], b: list[int]) -> tuple[set[int], set[int]]:
    """Indexes in ``a`` and in ``b`` of a longest common subsequence. Equal
    ends are taken off first; only lines that both sides have take part."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    sa, sb = set(a[lo:len(a) - hi]), set(b[lo:len(b) - hi])
    x = [i for i in range(lo, len(a) - hi) if a[i] in sb]
    y = [j for j in range(lo, len(b) - hi) if b[j] in sa]
    found = _aligned([a[i] for i in x], [b[j] for j in y])
    left, right = {x[i] for i, _ in found}, {y[j] for _, j in found}
    left |= {*range(lo), *range(len(a) - hi, len(a))}
    right |= {*range(lo), *range(len(b) - hi, len(b))}
    return left, right


def page_lines(pages: DataFrame) -> DataFrame:
    """(key, host, path, hashes, sizes, main) of the different pages of each
    host; of equal ones the first path."""
    def run(batches):
        for b in batches:
            rows = []
            for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
                found = page_blocks(html)
                host, path = url_parts(url)
                hashes = [line_hash(t) for t, _, _ in found]
                rows.append((page_key(host, hashes), host, path, hashes,
                             [len(t) for t, _, _ in found], [m for _, m, _ in found]))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.binary(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()),
                     pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["key", "host", "path", "hashes", "sizes", "main"])

    lines = pages.mapInArrow(run, "key binary, host string, path string, hashes array<long>, "
                             "sizes array<int>, main array<boolean>")
    # equal lines may be declared on one page only: all of them are one page
    lines = lines.filter(F.size("hashes") > 0)
    return lines.groupBy("key").agg(F.min("path").alias("path"), *[
        F.first(c).alias(c) for c in ("host", "hashes", "sizes", "main")])


def are_copies(p: dict, q: dict, left: set[int], right: set[int]) -> bool:
    """Whether one of two pages has little apart from the long lines, aligned
    as ``left`` and ``right``, that both have."""
    long = sum(p["sizes"][i] for i in left if p["sizes"][i] >= LONG_LINE)
    apart = min(sum(n for i, n in enumerate(x["sizes"]) if i not in own) for x, own in ((p, left), (q, right)))
    return apart < APART * long or not apart


def shared_lines(p: dict, q: dict) -> list[int] | None:
    """Indexes of the lines that ``p`` has in common with ``q`` and that it
    does not declare as main text; None if the two are copies."""
    left, right = common_lines(p["hashes"], q["hashes"])
    if are_copies(p, q, left, right):
        return None
    return sorted(k for k in left if not p["main"][k])


def difference_run(own: int, rows: list[dict]) -> list[tuple]:
    """(n, key, indexes of deleted lines, partner before, partner behind) for
    the pages of one run; ``rows`` are its pages in order, with ``REACH`` more
    on either side. A partner is (place, whether it is but the last of
    ``REACH`` copies, behind which the nearest other page is still to be
    found); none where the host ends."""
    out = []
    known: dict[tuple[int, int], tuple] = {}

    def pair(i: int, j: int):
        if (i, j) not in known:
            left, right = common_lines(rows[i]["hashes"], rows[j]["hashes"])
            known[i, j] = (left, right, are_copies(rows[i], rows[j], left, right))
        return known[i, j]

    for i, p in enumerate(rows):
        if p["n"] // RUN != own:
            continue
        gone, partners = set(), []
        for step in (-1, 1):
            partner = None
            for j in range(i + step, i + step * (REACH + 1), step):
                if not 0 <= j < len(rows) or rows[j]["host"] != p["host"]:
                    partner = None
                    break
                left, right, copies = pair(min(i, j), max(i, j))
                partner = (rows[j]["n"], copies)
                if not copies:  # the nearest that is no copy
                    gone.update(k for k in (left if i < j else right) if not p["main"][k])
                    break
            partners.append(partner)
        out.append((p["n"], p["key"], sorted(gone), *partners))
    return out


_PARTNER = "struct<place:bigint,open:boolean>"
_LINES = ("hashes", "sizes", "main")


def _partners(found: DataFrame) -> DataFrame:
    """(n, key, step, place, open) of every page that has a partner before or
    behind."""
    sides = F.array(F.struct(F.lit(-1).alias("step"), F.col("before").alias("to")),
                    F.struct(F.lit(1).alias("step"), F.col("behind").alias("to")))
    flat = found.select("n", "key", F.explode(sides).alias("s")).filter(F.col("s.to").isNotNull())
    return flat.select("n", "key", "s.step", "s.to.place", "s.to.open")


def _followed(open_: DataFrame, ends: DataFrame) -> DataFrame:
    """Where the partner of the page at ``place`` on the same side is; pages
    behind which the host ends are left out."""
    nxt = ends.select(F.col("n").alias("_n"), F.col("step").alias("_step"), F.col("place").alias("_place"),
                      F.col("open").alias("_open"))
    j = open_.join(nxt, (F.col("place") == F.col("_n")) & (F.col("step") == F.col("_step")))
    return j.select("n", "key", "step", F.col("_place").alias("place"), F.col("_open").alias("open"))


def _met(todo: DataFrame, numbered: DataFrame) -> DataFrame:
    """``todo`` with the lines shared with the page at ``place``; open where
    the two are copies."""
    p = todo.join(numbered.select(F.col("n").alias("_p"), *_LINES), F.col("n") == F.col("_p"))
    places = todo.select(F.col("place").alias("_q")).distinct()
    q = places.join(numbered.select("n", *[F.col(c).alias("q_" + c) for c in _LINES]), F.col("_q") == F.col("n"))
    # a long row of copies meets one page: its lines go to every task
    both = p.join(small_or_plain(q.drop("n")), F.col("place") == F.col("_q"))
    both = both.select("n", "key", "step", "place", *_LINES, *["q_" + c for c in _LINES])

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            found = [shared_lines(r, {c: r["q_" + c] for c in _LINES}) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in ("n", "key", "step", "place")], pa.array([f is None for f in found], pa.bool_()),
                 pa.array([f or [] for f in found], pa.list_(pa.int32()))],
                names=["n", "key", "step", "place", "open", "gone"])

    return both.mapInArrow(run, "n long, key binary, step int, place long, open boolean, gone array<int>")


def _beyond_reach(found: DataFrame, numbered: DataFrame) -> list[DataFrame]:
    """(key, gone) of the pages with nothing but copies in reach on a side.

    The partner of such a page is that of the last copy in reach: all pages of
    a row of copies are led to the page behind it by pointer doubling. A page
    that is a copy of that one too goes on to its partner, and so on to the
    end of the host."""
    ends = saved(_partners(found), "partners")
    pending = ends.filter("open").select("n", "step")
    if pending.isEmpty():
        return []
    cols, parts = ends.columns, []
    while not ends.filter("open").isEmpty():
        ends = saved(ends.filter(~F.col("open")).unionByName(_followed(ends.filter("open"), ends)), "partners")
    todo = saved(ends.join(pending, ["n", "step"], "left_semi").select(*cols), "partners")
    while not todo.isEmpty():
        met = saved(_met(todo, numbered), "met")
        parts.append(met.filter(~F.col("open")).select("key", "gone"))
        todo = saved(_followed(met.filter("open").select(*cols), ends), "partners")
    return parts


def deleted_lines(pages: DataFrame) -> DataFrame:
    """(key, gone): the lines that each page shares with a neighbour."""
    order = ["host", "path", "key"]
    numbered = number_rows(page_lines(pages), [], order, "n", start=0)
    group, place = F.floor(F.col("n") / RUN), F.col("n") % RUN
    groups = F.array_compact(F.array(
        group, F.when((place < REACH) & (group > 0), group - 1), F.when(place >= RUN - REACH, group + 1)))
    spread = numbered.withColumn("run", F.explode(groups))
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int32())] + 2 * [
        pa.struct([("place", pa.int64()), ("open", pa.bool_())])]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["n"])
        cols = list(zip(*[(n, k, g, *[t and {"place": t[0], "open": t[1]} for t in to])
                          for n, k, g, *to in difference_run(key[0].as_py(), rows)])) or [()] * 5
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("n", "key", "gone", "before", "behind"), cols, kinds)})

    found = saved(spread.groupBy("run").applyInArrow(
        run, f"n long, key binary, gone array<int>, before {_PARTNER}, behind {_PARTNER}"), "differences")
    out = found.filter(F.size("gone") > 0).select("key", "gone")
    more = _beyond_reach(found, numbered)
    if more:
        out = reduce(DataFrame.unionByName, more, out).groupBy("key").agg(
            F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row.

    White space inside a block is one space; blocks are joined in page order
    by an empty line. A null or empty html, or a page without main text, has
    an empty text. A null url is a page of the host without a name. Repeated
    rows stay repeated; they, and all pages of a host with equal lines, are
    one page for the differencing. An empty
    table gives an empty result; extra columns are ignored."""
    prepare(pages.sparkSession)
    pages = only(pages, page_id=id_col, url=url_col, html=html_col)
    gone = saved(deleted_lines(pages), "gone-lines")

    def run(batches):
        for b in batches:
            urls = b.column("url").to_pylist()
            texts = [page_blocks(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"),
                 pa.array([page_key(url_parts(u)[0], [line_hash(t) for t, _, _ in found])
                           for u, found in zip(urls, texts)], pa.binary()),
                 # lines that cannot be main text keep their place, not their text
                 pa.array([[t if kept else None for t, _, kept in found] for found in texts], pa.list_(pa.string()))],
                names=["page_id", "url", "key", "lines"])

    lines = pages.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, key binary, "
                             "lines array<string>")
    if not gone.isEmpty():
        lines = lines.join(small_or_plain(gone), "key", "left").withColumn("lines", F.filter(
            "lines", lambda x, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False))))
    text = F.array_join("lines", "\n\n")
    return lines.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))

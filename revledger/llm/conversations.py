"""Conversation structure repair over a suffix-shared automaton.

A row's fault (blank, duplicate, truncated) and the initial of its role make a
symbol, the rows of a conversation in order a signature. The cheapest repair
of a conversation depends on its signature alone, and the cost from one row to
the end on the rest of the signature alone. So all signatures of all
conversations are minimised from the end into one automaton: a node is a
different suffix, shared by every conversation that ends so. Cost-to-go and
the best audit suffix are computed once a node and state of the role grammar.

Distinct signatures are range-partitioned by their reversal and sorted; a task
then walks the automaton of its range depth first, the nodes on the way from
the end to the current suffix on a stack. Neighbours share what their
reversals have in common, so no node is visited twice, but for the first path
of a range.

A conversation longer than ``SEGMENT`` rows has a signature for each segment.
Segments before the last get the cost between any two states. These tables are
joined up by a tree: of equal cost between the same two states, no audit of a
segment is the beginning of another (it would have inserts more, and cost
more), so the least audits of the parts make the least audit of the whole.

Only thin rows (numbers, digests, flags) take part until the audits are known;
texts are shuffled once, beside the audit of their conversation.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revledger.llm.common import prepare, saved
from revledger.operators.sequence import number_rows

#: fixed by the data contract
BLANK, OPEN_END = r"^[\x20\x09-\x0D]*\z", r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"
RETYPE, REMOVE, ADD, CUT_OFF = 2, 3, 2, 1
#: grammar s?(ua)+ or nothing: states are before, after s, after u, after a
START, AFTER_S, AFTER_U, AFTER_A = STATES = range(4)
#: state after a kept row of this initial, and after an inserted or retyped row
KEPT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U,
        (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
WRITTEN = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
ENDS = (START, AFTER_A)
#: a symbol is the initial (o: any other), upper case if the row is
#: truncated, or x if it has to go
MUST_GO, OTHER = "x", "o"

#: rows of a signature, segments joined up by one call, bytes of tables broadcast
SEGMENT, FAN_IN, TABLE_BYTES = 256, 8, 16 << 20
_FAR = 1 << 60
#: bytes that repaired rows may have in one Arrow batch
BATCH_BYTES = 4 << 20

# ---------------------------------------------------------------------------
# the automaton: a node's table is [(cost, audit)] by state


def _least(*choices):
    return min(choices)


def _with_inserts(plain: list) -> list:
    """The table when rows may be inserted first: more than two would only
    come back to the same state."""
    out = []
    for g in STATES:
        one = WRITTEN[g]
        two = WRITTEN[one]
        out.append(_least(plain[g], (ADD + plain[one][0], "I" + plain[one][1]),
                          (2 * ADD + plain[two][0], "II" + plain[two][1])))
    return out


def end_tables(last: bool) -> list[list]:
    """Tables of the empty suffix: one that has to end in the grammar, or one
    for each state in which the next segment may begin."""
    if last:
        return [_with_inserts([(0, "") if g in ENDS else (_FAR, "") for g in STATES])]
    return [[(0, "") if g == to else (_FAR, "") for g in STATES] for to in STATES]


def before(symbol: str, rest: list) -> list:
    """The table of ``symbol`` and then the suffix whose table is ``rest``."""
    plain = []
    extra = CUT_OFF if symbol.isupper() else 0
    for g in STATES:
        cost, audit = rest[g]
        ways = [(REMOVE + cost, "D" + audit)]
        if symbol != MUST_GO:
            cost, audit = rest[WRITTEN[g]]
            ways.append((RETYPE + extra + cost, "R" + audit))
            to = KEPT.get((g, symbol.lower()))
            if to is not None:
                cost, audit = rest[to]
                ways.append((extra + cost, "K" + audit))
        plain.append(_least(*ways))
    return _with_inserts(plain)


def joined(left: list[list], right: list[list]) -> list[list]:
    """Tables of two segments as one."""
    return [[min((left[mid][g][0] + r[mid][0], left[mid][g][1] + r[mid][1]) for mid in STATES)
             for g in STATES] for r in right]


def walk(signatures):
    """(signature, last, tables) of (signature, last) sorted by ``last`` and
    reversal: a node of the automaton is computed once while its suffix is
    on the stack."""
    path, stack, kind = "", [], None
    for signature, last in signatures:
        back = signature[::-1]
        if last is not kind:
            path, stack, kind = "", [end_tables(last)], last
        same = len(commonprefix([path, back]))
        del stack[same + 1 :]
        for symbol in back[same:]:
            stack.append([before(symbol, t) for t in stack[-1]])
        path = back
        yield signature, last, stack[-1]


def roles_of(audit: str) -> tuple[int, int]:
    """(rows that stay or come, whether the first is the system's): an odd
    number means s?(ua)+ with its s, so the audit alone fixes every role."""
    n = len(audit) - audit.count("D")
    return n, n % 2


# ---------------------------------------------------------------------------
# faults and signatures (thin rows)


def _same(left: DataFrame, right: DataFrame, names: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in names.items()])


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def _faults(rows: DataFrame) -> DataFrame:
    """(conv, pos, turn, initial, fault, symbol) of every row, written."""
    thin = rows.select("conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"),
                       F.col("text").rlike(BLANK).alias("blank"), F.col("text").rlike(OPEN_END).alias("open"))
    placed = saved(number_rows(thin, ["conv"], _order(), "pos", start=0), "conversation-rows")
    first = placed.groupBy("conv", "role", "digest").agg(F.min("pos").alias("pos"))
    first = first.select(F.col("conv").alias("conv_"), F.col("pos").alias("pos_"))
    flagged = placed.join(first, _same(placed, first, {"conv": "conv_", "pos": "pos_"}), "left")
    fault = (F.when(F.col("blank"), "blank").when(F.col("pos_").isNull(), "duplicate")
             .when(F.col("open"), "truncated").otherwise(""))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise(OTHER)
    symbol = (F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO)
              .when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial")))
    return flagged.select("conv", "pos", "turn", kind.alias("initial"), fault.alias("fault")).withColumn(
        "symbol", symbol)


def _segments(faults: DataFrame) -> DataFrame:
    """(conv, seg, signature, counts) of every ``SEGMENT`` rows, written."""
    seg = F.floor(F.col("pos") / SEGMENT)
    row = F.struct("pos", "initial", "symbol")
    s = faults.groupBy("conv", seg.alias("seg")).agg(
        F.sort_array(F.collect_list(row)).alias("rows"),
        *[F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")])
    text = {k: F.array_join(F.col(f"rows.{k}"), "") for k in ("initial", "symbol")}
    return saved(s.select("conv", "seg", text["symbol"].alias("signature"), text["initial"].alias("initials"),
                          "blank", "duplicate", "truncated"), "conversation-segments")


def _illegal(segments: DataFrame) -> DataFrame:
    """(conv, illegal): neighbours whose initials are not su, ua or au; the
    first initial of a segment counts with the last of the one before."""
    following = segments.filter("seg > 0").select(F.col("conv").alias("conv_"), (F.col("seg") - 1).alias("seg_"),
                                                  F.substring("initials", 1, 1).alias("next"))
    s = segments.join(following, _same(segments, following, {"conv": "conv_", "seg": "seg_"}), "left")
    line = F.concat("initials", F.coalesce("next", F.lit("")))
    legal = F.size(F.filter(F.sequence(F.lit(1), F.length(line)),
                            lambda i: F.substring(line, i, F.lit(2)).isin("su", "ua", "au")))
    return s.groupBy(s["conv"]).agg(F.sum(F.length(line) - 1 - legal).alias("illegal"))


# ---------------------------------------------------------------------------
# costs

_TABLE = "tables array<array<struct<cost:long,audit:string>>>"
_ARROW_TABLE = pa.list_(pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())])))


def _plain(tables) -> list[list]:
    return [[(c["cost"], c["audit"]) for c in t] for t in tables]


def _structs(tables: list[list]) -> list:
    return [[{"cost": c, "audit": a} for c, a in t] for t in tables]


def _costs(segments: DataFrame) -> DataFrame:
    """(conv, cost, audit) of every conversation."""
    spark = segments.sparkSession
    ends = segments.groupBy("conv").agg(F.max("seg").alias("end"))
    ends = ends.select(F.col("conv").alias("conv_"), "end")
    s = segments.join(ends, _same(segments, ends, {"conv": "conv_"})).select(
        "conv", "seg", "signature", (F.col("seg") == F.col("end")).alias("last"))
    back = F.reverse("signature")
    distinct = s.select("signature", "last").distinct()

    def cost(batches):
        def pairs():
            for b in batches:
                yield from zip(b.column("signature").to_pylist(), b.column("last").to_pylist())
        part = []
        for item in walk(pairs()):
            part.append(item)
            if len(part) == 1000:
                yield batch(part)
                part = []
        yield batch(part)

    def batch(part):
        a, b, c = zip(*part) if part else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.string()), pa.array(b, pa.bool_()), pa.array(map(_structs, c), _ARROW_TABLE)],
            names=["signature", "last", "tables"])

    tables = saved(distinct.repartitionByRange("last", back).sortWithinPartitions("last", back).mapInArrow(
        cost, f"signature string, last boolean, {_TABLE}"), "conversation-tables")
    # a signature that most conversations have is one key: a small side is
    # broadcast, a larger one leaves the key to AQE's skew join
    size = tables.agg(F.sum(F.length("signature") * F.when(F.col("last"), 8).otherwise(32) + 200)).first()[0]
    priced = s.join(F.broadcast(tables) if (size or 0) <= TABLE_BYTES else tables, ["signature", "last"])
    one = F.col("tables")[0][START]
    whole = priced.filter("last and seg = 0").select("conv", one["cost"].alias("cost"), one["audit"].alias("audit"))
    many = saved(priced.filter("not last or seg > 0").select("conv", "seg", "last", "tables"), "conversation-parts")
    top = many.agg(F.max("seg")).first()[0]
    if top is None:
        return whole

    def together(pdf):
        pdf = pdf.sort_values("seg")
        tables = reduce(joined, map(_plain, pdf["tables"]))
        out = pdf.iloc[-1:].copy()
        out["seg"] = out["seg"] // FAN_IN
        out["tables"] = [_structs(tables)]
        return out

    level = 0
    while top > 0:
        many = saved(many.groupBy("conv", F.floor(F.col("seg") / FAN_IN)).applyInPandas(
            together, many.schema), f"conversation-level{level}")
        top, level = top // FAN_IN, level + 1
    return whole.unionByName(many.select("conv", one["cost"].alias("cost"), one["audit"].alias("audit")))


# ---------------------------------------------------------------------------
# repaired rows


def _apply(batches):
    """Edited rows of a stream sorted by conversation, in which the audit
    stands before the rows that it is about."""
    schema = pa.schema([("conv", pa.null()), ("n", pa.int64()), ("edit", pa.string()), ("role", pa.string()),
                        ("text", pa.string())])
    out, size = [], 0
    audit, at, no, odd, number = "", 0, 0, 0, 0
    for b in batches:
        schema = schema.set(0, pa.field("conv", b.schema.field("conv").type))
        for r in b.to_pylist():
            if r["audit"] is not None:
                audit, at, no, number = r["audit"], 0, 0, 0
                odd = roles_of(audit)[1]
                rest = len(audit) - audit.count("I")  # rows to come
                continue
            todo = []
            while audit[at] == "I":
                todo.append("I")
                at += 1
            todo.append(audit[at])
            at, rest = at + 1, rest - 1
            if not rest:
                todo += audit[at:]
            for edit in todo:
                role = ("user", "assistant")[(no - odd) % 2]
                text = "" if edit == "I" else r["text"]
                out.append((r["conv"], number, edit, r["role"] if edit in "KD" else role, text))
                number += 1
                no += edit != "D"
                size += len(text) + 64
        if size > BATCH_BYTES:
            yield _edited(out, schema)
            out, size = [], 0
    if out:
        yield _edited(out, schema)


def _edited(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


@dataclass
class Repair:
    """``conversations``: (conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit) of every conversation with rows. ``rows``: (conv_id, n, edit,
    role, text), every row of the input and every inserted one in order, with
    its edit (K, R, D, I) and the repaired role; a conversation is within one
    partition, in order."""

    conversations: DataFrame
    rows: DataFrame


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> Repair:
    """Cheapest repair of every conversation to role initials ``(s?(ua)+)?``.

    Rows are taken by turn, nulls first; rows of one turn by role and digest
    of the text, which are a defined order of ties. A null role or text is
    one space (so the text is blank, the role none of the grammar); a null
    conversation id is a conversation of its own; null turns count in no gap.
    Repeated rows are duplicates but for the first. An empty table gives two
    empty tables, extra columns are ignored.

    Faults, signatures and costs of a conversation of any length are spread
    over tasks; its repaired rows are streamed through one task in order."""
    prepare(rows.sparkSession)
    space = F.lit(" ")
    rows = rows.select(rows[conv_col].alias("conv"), rows[turn_col].cast("long").alias("turn"),
                       F.coalesce(rows[role_col], space).alias("role"),
                       F.coalesce(rows[text_col], space).alias("text"))
    faults = _faults(rows)
    turns = faults.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    segments = _segments(faults)
    counts = segments.groupBy("conv").agg(
        *[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")])
    costs = saved(_costs(segments), "conversation-costs")
    out = costs
    for more in (turns, counts, _illegal(segments)):
        more = more.withColumnRenamed("conv", "conv_")
        out = out.join(more, _same(out, more, {"conv": "conv_"})).drop("conv_")
    conversations = out.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated",
                               "illegal", "cost", "audit")
    null = F.lit(None).cast("string")
    stream = rows.select("*", F.unhex(F.sha2("text", 256)).alias("digest"), null.alias("audit")).unionByName(
        costs.select("conv", F.lit(None).cast("long").alias("turn"), null.alias("role"), null.alias("text"),
                     F.lit(None).cast("binary").alias("digest"), "audit"))
    stream = stream.repartition("conv").sortWithinPartitions("conv", F.col("audit").isNull(), *_order())
    edited = stream.select("conv", "role", "text", "audit").mapInArrow(
        _apply, f"conv {dict(rows.dtypes)['conv']}, n long, edit string, role string, text string")
    return Repair(conversations, edited.withColumnRenamed("conv", "conv_id"))


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``Repair.rows``: SHA-256 of the rows that
    stay as ``role:text``, joined by newlines. A SHA-256 is a chain, so one
    task feeds a conversation's rows through it in order, one at a time."""
    def run(batches):
        now, has, h, fresh, kind = None, False, hashlib.sha256(), True, None
        for b in batches:
            ids, shas, kind = [], [], b.schema.field("conv_id").type
            for r in b.to_pylist():
                if has and r["n"] == 0:
                    ids.append(now)
                    shas.append(h.hexdigest())
                if r["n"] == 0:
                    now, has, h, fresh = r["conv_id"], True, hashlib.sha256(), True
                if r["edit"] != "D":
                    h.update(f"{'' if fresh else chr(10)}{r['role']}:{r['text']}".encode())
                    fresh = False
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(shas, pa.string())],
                                             names=["conv_id", "repaired_sha256"])
        if has:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([h.hexdigest()])],
                                             names=["conv_id", "repaired_sha256"])

    return rows.mapInArrow(run, f"conv_id {dict(rows.dtypes)['conv_id']}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with the damage that the contract of
    the query does by the hash of conversation and turn."""
    space = F.lit(" ")
    part = {c: F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn", "role", "text")}
    rows = conversations.select(
        "conv_id", "turn", part["role"].alias("role"), part["text"].alias("text"),
        (F.crc32(F.concat(part["conv_id"], F.lit(":"), part["turn"]).cast("binary")) % 20).alias("_code")).filter("_code > 0")
    text = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(
        F.col("text"))
    role = F.when(F.col("_code") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")

"""Host-level quality rules.

Every document is measured against a few rules. Failures are added up by
host (the ``source`` column), each host's failure rate is shrunk towards
the corpus rate with a beta prior fitted to the hosts' own rates, and the
host's verdict is joined back to its documents. A document is kept when it
breaks no rule and its host is not rejected.

Counts are made per text inside the tasks; only (host, count, failures)
partial sums are shuffled before the hosts' table is built, so a host with
a third of all rows costs no more than any other.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from revledger.llm.common import WORD, only, prepare, saved, small_or_plain

MIN_WORDS = 50
#: share of words in repeated three-word windows
MAX_REPEATED = 0.5
#: markup-like symbols for each word
MAX_SYMBOLS = 0.1
#: share of lines equal to an earlier one
MAX_DUP_LINES = 0.3
#: fewer repeated lines than this are no sign of anything
LEAST_DUP_LINES = 5
#: share of cased letters that are capitals
MAX_CAPITALS = 0.5
#: a host is rejected when its shrunk failure rate is above this
MAX_HOST_RATE = 0.8
#: the prior counts as at most so many documents
MAX_PRIOR_DOCS = 10000.0

SYMBOLS = frozenset("#*$%&|<>")

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_upper", "n_cased")


def measure(text: str | None) -> tuple[int, ...]:
    """The counts named in :data:`MEASURES` for one whole text."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    seen, twice = set(), set()
    trigrams = list(zip(words, words[1:], words[2:]))
    for t in trigrams:
        (twice if t in seen else seen).add(t)
    repeated = 0
    if twice:
        reach = 0
        for i, t in enumerate(trigrams):
            if t in twice:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    lines, old, dup = 0, set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            if line in old:
                dup += 1
            old.add(line)
    symbols = sum(text.count(c) for c in SYMBOLS)
    low, up = text.lower(), text.upper()
    if len(low) == len(text) == len(up):
        upper = sum(a != b for a, b in zip(text, low)) if low != text else 0
        cased = upper + (sum(a != b for a, b in zip(text, up)) if up != text else 0)
    else:
        upper = sum(c.isupper() for c in text)
        cased = upper + sum(c.islower() for c in text)
    return n, sum(map(len, words)), symbols, dup, repeated, lines, upper, cased


def document_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      host_col: str = "source") -> DataFrame:
    """(doc_id, host, measures) for every row. A null text has no words; a
    null host is a host of its own; repeated rows stay repeated."""
    prepare(docs.sparkSession)
    base = only(docs, doc_id=id_col, host=host_col, text=text_col)
    schema = f"doc_id {dict(base.dtypes)['doc_id']}, host {dict(base.dtypes)['host']}, " + ", ".join(
        f"{m} long" for m in MEASURES)

    def run(batches):
        for b in batches:
            rows = [measure(t) for t in b.column("text").to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("host"), *[pa.array(c, pa.int64()) for c in cols]],
                names=["doc_id", "host", *MEASURES])

    return base.mapInArrow(run, schema)


def rules() -> dict[str, Column]:
    """Rule name -> condition of failure, over the measures."""
    words = F.col("n_words")
    return {
        "short": words < MIN_WORDS,
        "repeated": 100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * words,
        "symbols": F.col("n_symbols") > MAX_SYMBOLS * words,
        "dup_lines": (F.col("n_dup_lines") >= LEAST_DUP_LINES)
        & (F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines")),
        "capitals": F.col("n_upper") > MAX_CAPITALS * F.col("n_cased"),
    }


def host_verdicts(measured: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate, host_rejected).

    The beta prior's mean is the pooled failure rate. Its weight comes from
    the spread of the host rates around it (method of moments: the spread
    beyond what sampling alone gives, at least one document and at most
    :data:`MAX_PRIOR_DOCS`). Two scalars reach the driver.
    With one host, or hosts that differ no more than chance, the prior is
    at its heaviest and no host stands out."""
    hosts = saved(measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.col("failed").cast("long")).alias("n_failed")), "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    pooled = hosts.agg((F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
                       F.sum("n_docs").alias("docs"), F.count(F.lit(1)).alias("hosts")).first()
    mean, weight = pooled["mean"] or 0.0, MAX_PRIOR_DOCS
    gap = rate - F.lit(mean)
    spread = hosts.agg(F.sum(F.col("n_docs") * gap * gap).alias("s")).first()["s"] or 0.0
    noise = mean * (1 - mean)
    between = (spread - (pooled["hosts"] - 1) * noise) / (pooled["docs"] or 1)
    if between > 0:
        weight = min(MAX_PRIOR_DOCS, max(1.0, noise / between - 1))
    shrunk = (F.col("n_failed") + F.lit(weight * mean)) / (F.col("n_docs") + F.lit(weight))
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("shrunk_rate"),
                        (shrunk > MAX_HOST_RATE).alias("host_rejected"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  host_col: str = "source") -> DataFrame:
    """One row for each input row: its measures, the rules it breaks, its
    host's verdict and ``kept``.

    Nulls: a null text has zero words and breaks ``short``; a null host is
    one host. An empty table gives an empty result. Extra columns are
    ignored. The measures are written once to the shared folder, so texts
    are read once; the host table is broadcast only if it is small."""
    measured = document_measures(docs, id_col, text_col, host_col)
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules().items()]))
    measured = saved(measured.withColumn("broken", broken).withColumn("failed", F.size("broken") > 0),
                     "rules")
    hosts = saved(host_verdicts(measured), "verdicts").withColumnRenamed("host", "_host")
    joined = measured.join(small_or_plain(hosts), F.col("host").eqNullSafe(F.col("_host")), "left")
    base = F.array_contains("broken", "short") | F.array_contains("broken", "repeated")
    return joined.select(
        "doc_id", "host", *MEASURES, "broken", base.alias("base_failed"), "shrunk_rate",
        F.coalesce("host_rejected", F.lit(False)).alias("host_rejected"),
        (~F.col("failed") & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"))


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns unchanged. Texts are
    measured twice (once for the hosts' rates, once to filter where they
    are read) instead of being shuffled to meet their verdicts."""
    spark = docs.sparkSession
    prepare(spark)
    verdicts = quality_rules(docs, id_col, text_col, host_col)
    rejected = saved(verdicts.filter(F.col("host_rejected")).select("host").distinct(), "rejected")
    rejected = rejected.withColumnRenamed("host", "_host")
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    t = f"c{names.index(text_col)}"

    def run(batches):
        for b in batches:
            rows = [measure(x) for x in b.column(t).to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *[pa.array(c, pa.int64()) for c in cols]],
                names=[*b.schema.names, *MEASURES])

    schema = StructType(flat.schema.fields + [StructField(m, LongType()) for m in MEASURES])
    out = flat.mapInArrow(run, schema)
    for c in rules().values():
        out = out.filter(~c)
    host = F.col(f"c{names.index(host_col)}")
    out = out.join(small_or_plain(rejected), host.eqNullSafe(F.col("_host")), "left_anti")
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])

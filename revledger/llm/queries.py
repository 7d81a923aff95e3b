"""One query per operator, over its whole table, and DuckDB SQL where SQL can
say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revledger.llm import (conversations, decontam, html_extract, licenses, near_dedup, packing,
                           periodic_runs, pii, quality_model, quality_rules, substring, token_counts,
                           warc)
from revledger.llm.oracles import ORACLES  # noqa: F401
from revledger.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back by byte ranges."""
    records = warc.warc_round_trip(read_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type",
                          "refers_to", "digest_ok")


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids packed into sequences of 2048."""
    return packing.pack(read_table(spark, sf_dir, "documents"))


@query
def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def corpus_files(docs: DataFrame) -> DataFrame:
    """Stand-in file tree (file_id, path, text): a document's folder is its
    source, its language below that, and numbered folders below that by its
    id; the shortest documents are named like licence files."""
    i = F.col("doc_id")
    deep = F.concat_ws("/", "source", "lang", F.concat(F.lit("p"), F.floor(i / 500).cast("string")),
                       F.concat(F.lit("q"), F.floor(i / 20).cast("string")))
    folder = F.when(F.length("text") < 1000, F.concat_ws("/", "source", "lang")).otherwise(deep)
    name = F.when(F.length("text") < 500, F.concat(F.lit("LICENSE."), i.cast("string"))).otherwise(
        F.concat(F.lit("f"), i.cast("string"), F.lit(".txt")))
    return docs.select(i.alias("file_id"), F.concat_ws("/", folder, name).alias("path"), "text")


@query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or inherited by directory."""
    found = licenses.scan(corpus_files(read_table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("file_id", "doc_id")


@query
def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression score of every document, learned from labels that are not
    held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = quality_model.score(docs, model)
    return scored.select("doc_id", quality_model.held_out().alias("held_out"), "score",
                         (F.col("score") >= quality_model.THRESHOLD).cast("int").alias("predicted"))


@query
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 20-word windows that occur earlier."""
    out = substring.dedup_substrings(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, with the spans of disguised ones."""
    found = pii.find_pii(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256", "spans")


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, base failure and host-aware verdict of every document."""
    out = quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept",
                      F.array_join("broken", ",").alias("broken"), "host_rejected")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item, verbatim or re-parameterised."""
    return decontam.leaks(read_table(spark, sf_dir, "documents"),
                          read_table(spark, sf_dir, "benchmark")).filter("leak")


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, a tenth of them planted."""
    docs = periodic_runs.plant_repetition(read_table(spark, sf_dir, "documents"))
    found = periodic_runs.periodic_runs(docs)
    line = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in (
        "start", "length", "period")]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, huge ones spliced from overlapping chunks."""
    counts = token_counts.count_tokens(read_table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged, then repaired at the least cost."""
    table = read_table(spark, sf_dir, "conversations")
    fixed = conversations.repair(conversations.damaged(table))
    ids = table.select("conv_id").distinct()
    found = fixed.conversations.withColumnRenamed("conv_id", "c")
    hashes = conversations.digests(fixed.rows).withColumnRenamed("conv_id", "d")
    out = ids.join(found, ids["conv_id"].eqNullSafe(found["c"]), "left")
    out = out.join(hashes, out["conv_id"].eqNullSafe(hashes["d"]), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

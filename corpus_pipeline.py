"""The corpus pipeline: documents through the operators of ``revledger.llm``.

Each stage takes (spark, docs, sf_dir), works on every row that its
predecessor kept, and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revledger.llm import decontam, near_dedup, packing, pii, quality_rules
from revledger.llm.common import new_folder
from revledger.session import read_table, table_scope


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules by host: documents that they reject go."""
    return quality_rules.keep_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group of documents linked by a similarity
    of 0.8 on five-word shingles, that with the smallest id stays."""
    return near_dedup.drop_near_duplicates(docs, scheme=near_dedup.FIVE_WORDS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that leak an item go."""
    return decontam.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, plain or disguised, is masked; n_chars follows."""
    return pii.mask_pii(docs, "text", "n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents packed into sequences of 2048."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", drop_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: masking disguised identifiers and packing tokens are beyond SQL; the
#: stages are tested against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows. What a stage
    wrote on its way goes once its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"stage-{name}")
        with table_scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(folder)
        docs = spark.read.schema(out.schema).parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)

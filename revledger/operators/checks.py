"""Integrity checks over descriptor tables.

Each check returns the violating rows (a DataFrame) rather than raising. All are
single-pass aggregates or joins; counts use map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revledger.operators.joins import maybe_broadcast


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once (A1): key columns + ``n``."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def at_most_one(df: DataFrame, parent: list[str], flag: Column, label: str) -> DataFrame:
    """Parents holding more than one row flagged ``flag`` (A2)."""
    return (df.groupBy(*parent)
            .agg(F.count_if(flag).alias("n"))
            .filter(F.col("n") > 1)
            .withColumn("rule", F.lit(label)))


def domain(df: DataFrame, id_cols: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per (row, broken rule) (A3). ``rules`` maps a rule name to a
    boolean column that is true when the row breaks it. All rules are
    evaluated in one pass; only broken ones are exploded."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return (df.select(*id_cols, broken.alias("_broken"))
            .filter(F.size("_broken") > 0)
            .select(*id_cols, F.explode("_broken").alias("rule")))


def inherit_type(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str,
                 child_type: str = "type", parent_type: str = "type",
                 out: str = "effective_type") -> DataFrame:
    """Child type defaults to its parent's."""
    p = maybe_broadcast(parent.select(F.col(parent_key).alias("_pk"),
                                      F.col(parent_type).alias("_ptype")))
    j = child.join(p, child[child_key] == p["_pk"], "left")
    return j.withColumn(out, F.coalesce(F.col(child_type), F.col("_ptype"))).drop("_pk", "_ptype")


def inherited(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str,
              child_type: str = "type", parent_type: str = "type") -> DataFrame:
    """Children whose own type differs from a parent that has one (A4). A
    child without a type inherits the parent's, so it never conflicts."""
    p = maybe_broadcast(parent.select(F.col(parent_key).alias("_pk"),
                                      F.col(parent_type).alias("parent_type")))
    j = child.join(p, child[child_key] == p["_pk"], "inner")
    bad = (F.col("parent_type").isNotNull() & F.col(child_type).isNotNull()
           & (F.col(child_type) != F.col("parent_type")))
    return j.filter(bad).drop("_pk")


def split_by_pattern(df: DataFrame, col: str, pattern: str):
    """Banned-pattern constraint (P3): a row whose ``col`` matches
    ``pattern`` case-insensitively (SQL ILIKE) is rejected; NULL passes, as
    a CHECK constraint lets NULL through. Returns (accepted, rejected)."""
    hit = F.coalesce(F.col(col).ilike(pattern), F.lit(False))
    return df.filter(~hit), df.filter(hit)

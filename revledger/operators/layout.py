"""Layout migration of ledger tables.

The old layout keys its tables by application only; the new one adds a
schemas type. Migrating application A moves its rows out of the old
tables: old history rows (in old id order) and then its old current row
enter the new history under a constant schemas type, and the old current
row becomes the new current row. Other applications stay where they are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revledger.operators.sequence import assign_ids, number_rows
from revledger.sources.ledger_io import put_if_absent

ID = "revision_history_id"


def migrate_layout(old_current: DataFrame, old_history: DataFrame, new_history: DataFrame,
                   application: str, schemas_type: str, old_id: str = "id"):
    """Returns (new_current_rows, new_history_rows, rest_current, rest_history).

    ``new_history_rows`` get ids after the largest id of ``new_history``,
    old history first (by old id), then the old current row."""
    mine = F.col("application") == F.lit(application)
    # every column moves; one that only one of the tables has is NULL in the other's rows
    hist = old_history.filter(mine).select(
        F.lit(0).alias("_rank"), F.col(old_id).cast("long").alias("_old_id"),
        *[c for c in old_history.columns if c != old_id], F.lit("history").alias("source"))
    cur = old_current.filter(mine).select(
        F.lit(1).alias("_rank"), F.lit(None).cast("long").alias("_old_id"), *old_current.columns,
        F.lit("current").alias("source"))
    moving = hist.unionByName(cur, allowMissingColumns=True).withColumn("schemas_type", F.lit(schemas_type))
    top = new_history.agg(F.max(ID).alias("m")).first()["m"]
    start = 1 if top is None else int(top) + 1
    rows = assign_ids(moving, ["_rank", "_old_id"], ID, start).drop("_rank", "_old_id")
    new_current = old_current.filter(mine).select(
        "application", F.lit(schemas_type).alias("schemas_type"),
        *[c for c in old_current.columns if c != "application"])
    return (new_current, rows, old_current.filter(~mine), old_history.filter(~mine))


#: tables of a written migration: what enters the new layout, what stays
TABLES = ("history", "current", "rest_history", "rest_current")
MIGRATED = ("table string, kind string, revision_history_id long, id long, application string, "
            "schemas_type string, datetime timestamp_ntz, revision string, comment string")


def migrate_tables(old_current: DataFrame, old_history: DataFrame, new_history: DataFrame, root: str,
                   application: str, schemas_type: str) -> DataFrame:
    """The same for the var and the func tables at once (T3), written under
    ``root`` as one table for each kind and target.

    Rows of all old tables carry their ``kind``. One scan of them routes
    every row: of the moved application history and current rows enter the
    new history of their kind, ids following that kind's largest, and current
    rows the new current table too; all others go to the rest. Nothing of it
    counts before its commit, published last and only once; a second run of a
    committed migration returns what the first wrote."""
    spark = old_current.sparkSession
    mine = F.col("application") == F.lit(application)
    order = [F.col("_rank"), F.col("id")]
    both = old_history.withColumn("_rank", F.lit(0)).unionByName(
        old_current.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    top = new_history.groupBy(F.col("kind").alias("_kind")).agg(F.max(ID).alias("_top"))
    moved = number_rows(both.filter(mine), ["kind"], order, "_n")
    moved = moved.join(F.broadcast(top), F.col("kind") == F.col("_kind"), "left")
    target = F.when(F.col("_rank") == 0, F.array(F.lit("history"))).otherwise(
        F.array(F.lit("history"), F.lit("current")))
    moved = moved.select("*", F.explode(target).alias("table")).select(
        "table", "kind", (F.coalesce("_top", F.lit(0)) + F.col("_n")).alias(ID), F.lit(None).cast("long").alias("id"),
        "application", F.lit(schemas_type).alias("schemas_type"), "datetime", "revision", "comment")
    moved = moved.withColumn(ID, F.when(F.col("table") == "history", F.col(ID)))
    rest = both.filter(~F.coalesce(mine, F.lit(False))).select(
        F.when(F.col("_rank") == 0, "rest_history").otherwise("rest_current").alias("table"), "kind",
        F.lit(None).cast("long").alias(ID), "id", "application", F.lit(None).cast("string").alias("schemas_type"),
        "datetime", "revision", "comment")
    attempt = uuid.uuid4().hex
    moved.unionByName(rest).write.partitionBy("table", "kind").parquet(f"{root}/attempt={attempt}")
    put_if_absent(spark, f"{root}/commits/0.json", json.dumps({"attempt": attempt}))
    won = spark.read.schema("attempt string").json(f"{root}/commits").first()["attempt"]
    return spark.read.schema(MIGRATED).parquet(f"{root}/attempt={won}")

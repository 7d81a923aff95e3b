"""Drop targets.

Schemas to drop for a key are the recorded ones (ledger ``schemas``)
united with the declared ones, distinct; a NULL array adds nothing.
Without cascade, each routine of a dropped schema is dropped first, with
the statement word chosen by server version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revledger.operators.joins import fanout_join

# fixed values: servers whose version text matches this drop 'function',
# newer ones drop 'routine'
OLD_SERVER = r"^PostgreSQL (8|9|10)\."


def drop_targets(recorded: DataFrame, declared: DataFrame, key: list[str],
                 schemas: str = "schemas", out: str = "schema_name") -> DataFrame:
    r = recorded.select(*key, F.explode(schemas).alias(out))
    d = declared.select(*key, F.explode(schemas).alias(out))
    return r.unionByName(d).distinct()


def cascade_refusals(targets: DataFrame, kind: str = "kind", cascade: str = "cascade") -> DataFrame:
    """Var schemas may only be dropped with cascade."""
    return targets.filter((F.col(kind) == "var") & ~F.coalesce(F.col(cascade), F.lit(False)))


def drop_routines(targets: DataFrame, routines: DataFrame, versions: DataFrame, key: list[str],
                  schema: str = "schema_name", version: str = "server_version") -> DataFrame:
    """Routines to drop per target schema, with 'function' or 'routine' (J8).
    A schema name that many applications drop, or with many routines, is
    split over tasks on the target's key."""
    j = fanout_join(targets, routines.withColumnRenamed(schema, "_schema"), schema, "_schema",
                    F.xxhash64(*key)).drop("_schema")
    j = j.join(versions, key, "left")
    word = F.when(F.col(version).rlike(OLD_SERVER), F.lit("function")).otherwise(F.lit("routine"))
    return j.withColumn("drop_kind", word).drop(version)


def missing_required(required: DataFrame, catalog: DataFrame, key: str = "object_id") -> DataFrame:
    """Required objects the catalog no longer has."""
    gone = required.join(catalog.select(key).distinct(), key, "left_anti")
    return gone.select(*required.columns)

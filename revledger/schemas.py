"""Fixed StructTypes of the ledger and descriptor tables (read with an
explicit schema, never inferred)."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, LongType, StringType,
                               StructField, StructType, TimestampNTZType)

_S = StringType()

LEDGER_CURRENT = StructType([
    StructField("application", _S, False),
    StructField("schemas_type", _S, False),
    StructField("kind", _S, False),
    StructField("datetime", TimestampNTZType(), False),
    StructField("revision", _S, False),
    StructField("comment", _S, True),
    StructField("schemas", ArrayType(_S), True),
])

LEDGER_HISTORY = StructType([StructField("revision_history_id", LongType(), False)]
                            + LEDGER_CURRENT.fields)

EDGES = StructType([
    StructField("application", _S, False),
    StructField("to_rev", _S, False),
    StructField("from_rev", _S, False),
])

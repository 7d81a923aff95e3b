"""Scalar-or-list normalisation.

Descriptor fields may hold one string or a list of strings. Stored as JSON
text, a list starts with ``[``; anything else is a single value, also a text
that starts with ``[`` and is no JSON list (a file name, say). NULL stays
NULL (an absent field is not an empty list).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_list(x) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    trimmed = F.ltrim(c)
    return (
        F.when(c.isNull(), F.lit(None).cast("array<string>"))
        .when(trimmed.startswith("["), 
              F.coalesce(F.from_json(c, "array<string>"), F.array(c)))
        .otherwise(F.array(c))
    )

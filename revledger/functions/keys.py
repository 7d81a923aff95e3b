"""Key and identifier expressions (F1, F2, F9): plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ident_key(x) -> Column:
    """Identifier form of an application / type name: '-' -> '_', lower case."""
    return F.lower(F.translate(_c(x), "-", "_"))


def file_safe_key(x) -> Column:
    """File-name-safe form of a key part: '/' and '.' -> '-'."""
    return F.translate(_c(x), "/.", "--")


def distinct_from(a, b) -> Column:
    """SQL ``a is distinct from b``: NULL equals NULL."""
    return ~_c(a).eqNullSafe(_c(b))

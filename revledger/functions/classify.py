"""Entry classification (F6): a directory holding several marker files is
classified by the first marker in the fixed order init > schema > late >
safeguard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: marker file names in precedence order, and the kind each gives
MARKERS = (("init.yaml", "init"), ("schema.yaml", "schema"), ("late.yaml", "late"),
           ("safeguard.yaml", "safeguard"))


def entry_kind(has: dict[str, Column]) -> Column:
    """``has`` maps a kind to a boolean column telling whether the marker is there."""
    expr = None
    for _, kind in MARKERS:
        flag = has[kind]
        expr = F.when(flag, F.lit(kind)) if expr is None else expr.when(flag, F.lit(kind))
    return expr

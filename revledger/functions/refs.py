"""Leading include-reference parsing.

An include entry may start with ``${name}`` or ``$name`` (name = longest run
of ``[A-Za-z0-9_]``); only a reference at the very start counts and the
rest of the text is kept as is. The pattern below is the fixed rule of the
descriptor format.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the include-reference syntax
REF_PATTERN = r"(?s)^(\$\{([A-Za-z0-9_]+)\}|\$([A-Za-z0-9_]+))(.*)$"


def ref_name(x) -> Column:
    """Referenced name, or NULL when the entry does not start with a reference."""
    c = F.col(x) if isinstance(x, str) else x
    braced = F.regexp_extract(c, REF_PATTERN, 2)
    bare = F.regexp_extract(c, REF_PATTERN, 3)
    name = F.when(braced != "", braced).otherwise(bare)
    return F.when(c.rlike(REF_PATTERN), name)


def ref_rest(x) -> Column:
    """Text after the leading reference (the whole entry when there is none)."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.rlike(REF_PATTERN), F.regexp_extract(c, REF_PATTERN, 4)).otherwise(c)

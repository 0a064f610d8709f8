"""Normal forms of keys and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, in Java's and RE2's spelling.
OUTER_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def clean_id(c: Column | str) -> Column:
    """An id without outer white space, in lower case; null stays null."""
    return F.lower(F.regexp_replace(c, OUTER_SPACE, ""))


def clean_digest(c: Column | str) -> Column:
    """A digest in lower case without a ``sha256:`` in front; blank counts as null."""
    return F.nullif(F.regexp_replace(clean_id(c), r"^sha256:\s*", ""), F.lit(""))

"""Text expressions with the comparison rules of the source reports.

The reports ran on a server whose default text comparison ignores letter case and
trailing blanks, and where ``x <> ''`` is not true for NULL. These helpers make those
rules explicit instead of relying on a collation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_empty(c: Column) -> Column:
    """True when ``c`` has a character other than trailing blanks; NULL counts as empty."""
    return F.coalesce(F.rtrim(c) != F.lit(""), F.lit(False))


def text_key(c: Column) -> Column:
    """What the server's default comparison sees of a text: two texts are equal there if their keys are.

    Grouping and joins on such texts use the key, an ordinary (hashable) string; results keep a stored text.
    """
    return F.lower(F.rtrim(c))


def text_is(c: Column, literal: str) -> Column:
    """Case- and trailing-blank-insensitive equality with a literal; NULL is not equal."""
    return F.coalesce(text_key(c) == F.lit(literal.rstrip().lower()), F.lit(False))


def number_text(c: Column) -> Column:
    """A double as the report prints it inside text: 120.0 -> '120', 120.5 -> '120.5'."""
    return F.when(c == F.floor(c), F.floor(c).cast("long").cast("string")).otherwise(c.cast("string"))

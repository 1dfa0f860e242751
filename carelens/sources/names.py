"""Column names as they are stored: quoting, and helper names that cannot clash with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column name for use in expressions (dots, blanks and backticks are part of the name)."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> list[Column]:
    """Every column of ``df``."""
    return [F.col(quoted(c)) for c in df.columns]


def free_name(wanted: str, *taken: DataFrame) -> str:
    """``wanted``, or with the first number that makes it no column of ``taken`` (case does not count)."""
    names = {c.lower() for df in taken for c in df.columns}
    out, i = wanted, 0
    while out.lower() in names:
        i += 1
        out = f"{wanted}_{i}"
    return out


def renamed(df: DataFrame, *taken: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under column names that ``taken`` lacks, and the new name of each old one."""
    names = {c: free_name(f"_{c}", *taken) for c in df.columns}
    return df.select(*[F.col(quoted(c)).alias(n) for c, n in names.items()]), names

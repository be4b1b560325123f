"""Shared text expressions and helpers.

A *word* is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``.
Inside Python tasks ``bytes.split()`` has exactly this meaning, and
``bytes.lower()`` lower-cases exactly A-Z.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole(col: Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


def split_words(col: Column, spaces: str = "[\\x20\\x09-\\x0D]+") -> Column:
    """array<string> of words, in order; no empty strings."""
    return F.filter(F.split(whole(col), spaces), lambda w: w != F.lit(""))


def sql_list(values) -> str:
    """Values as the inside of a SQL list, quoted."""
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def long_table(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Deal rows out evenly before a Python step over few input files."""
    n = parts or 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n)

"""A fixed-size bit table as a plan constant, to skip values that cannot match.

It holds one bit per hashed value of a small table.  Its size is a parameter
and does not depend on the data; with many values it fills up and skips
less, never wrongly.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 20


def bitmap(values: DataFrame, column: str, bits: int = BITS) -> Column:
    """array<bigint> constant with the bits of ``column`` (long, no nulls)."""
    place = F.col(column).bitwiseAND(bits - 1)
    words = (values.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 AS int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).collect())  # at most bits / 64 rows
    table = [0] * (bits >> 6)
    for r in words:
        table[r["w"]] = r["b"]
    return F.from_json(F.lit(json.dumps(table)), "array<bigint>")


def maybe(table: Column, value: Column, bits: int = BITS) -> Column:
    """False only if ``value`` was not among the values."""
    word = F.get(table, F.shiftright(value.bitwiseAND(bits - 1), 6).cast("int"))
    return F.call_function("shiftright", word, value.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

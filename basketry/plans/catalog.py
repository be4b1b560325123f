"""Registry of named queries: ``key -> (spark builder, oracle SQL or None)``.

Keys follow the operator IDs of the survey's inventory.  Builders take
``(spark, sf_dir)`` and return a lazy DataFrame; nothing here collects.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    key: str
    build: Builder
    sql: str | None
    doc: str = ""


CATALOG: dict[str, Entry] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if key in CATALOG:
            raise ValueError(f"duplicate query key {key}")
        CATALOG[key] = Entry(key, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    # importing the modules fills CATALOG
    from basketry.plans import q_retail, q_customers, q_models, q_streams, q_extras  # noqa: F401
    return CATALOG

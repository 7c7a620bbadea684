"""Queries by the names of the operator inventory."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veredas.plans.tables import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _shown(df: DataFrame, lists: tuple[str, ...], maps: tuple[str, ...]) -> DataFrame:
    """Arrays and maps as text, so that two engines' results compare by value."""
    as_text = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in lists}
    for c in maps:
        entries = F.transform(F.array_sort(F.map_entries(F.col(c))), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string")))
        as_text[c] = F.array_join(entries, ",")
    return df.withColumns(as_text) if as_text else df


def query(name: str, oracle: str | None = None, lists: tuple[str, ...] = (), maps: tuple[str, ...] = ()):
    """Registers f(spark, dir) under a name, with the SQL that gives the same rows.

    Columns named in ``lists`` and ``maps`` are shown as text by both.
    """

    def add(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            return _shown(f(spark, d), lists, maps)

        QUERIES[name] = run
        if oracle:
            shown = [f"array_to_string({c}, ',') AS {c}" for c in lists]
            shown += [f"array_to_string(list_transform(list_sort(map_entries({c})), lambda e: e.key || '=' || e.value), ',') AS {c}" for c in maps]
            full = sql(oracle)
            ORACLE[name] = f"SELECT * REPLACE ({', '.join(shown)}) FROM ({full})" if shown else full
        return f

    return add

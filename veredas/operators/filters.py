"""Predicates: optional filters, visibility rules, reasons for being ineligible."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(*conditions: Column | None) -> Column:
    """Those that are given, all together; none: true."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def equal_where_given(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.filter(all_of(*[F.col(k) == v for k, v in values.items() if v is not None]))


def any_ilike(pattern: str, *columns: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).ilike(pattern) for c in columns])


def contains(column: str, part: str) -> Column:
    """The part anywhere, in any case; its % and _ stand for themselves."""
    return F.lower(column).contains(part.lower())


def blank(column: Column) -> Column:
    """Null, empty or white space only."""
    return F.trim(F.translate(F.coalesce(column, F.lit("")), "\t\n\r\x0b\x0c", "     ")) == ""


def allowed_or_blank(df: DataFrame, content: str, allowed: DataFrame, code: str) -> DataFrame:
    """Rows whose content is allowed, and those that name none. No allowed code at all means no restriction."""
    codes = allowed.select(F.col(code).alias("_code")).distinct()
    unrestricted = codes.agg((F.count(F.lit(1)) == 0).alias("_open"))  # one row
    met = df.join(codes, F.col(content) == F.col("_code"), "left").crossJoin(F.broadcast(unrestricted))
    return met.filter(blank(F.col(content)) | F.col("_code").isNotNull() | F.col("_open")).drop("_code", "_open")


def json_text(column: str, key: str) -> Column:
    return F.get_json_object(column, f"$.{key}")


def since(column: str, at, interval: str) -> Column:
    """Not older than the interval, seen from a given moment (never the wall clock)."""
    return F.col(column) >= F.expr(f"timestamp_ntz'{at}' - interval {interval}")


def between_half_open(column: str, start, end) -> Column:
    return all_of(F.col(column) >= F.lit(start).cast("timestamp_ntz") if start else None, F.col(column) < F.lit(end).cast("timestamp_ntz") if end else None)


def between_closed(column: str, start: str | None, end: str | None) -> Column:
    """Both ends included; an end that is no date doesn't filter."""
    at = lambda x: F.try_to_timestamp(F.lit(x)).cast("timestamp_ntz")
    return all_of(F.coalesce(F.col(column) >= at(start), F.lit(True)) if start else None, F.coalesce(F.col(column) <= at(end), F.lit(True)) if end else None)


def question_visible(school: int | None, classroom: str | None) -> Column:
    """Rules in order: public; ownerless platform questions; private to owner or school; school; classroom; legacy."""
    own_school = F.coalesce(F.col("school_id") == F.lit(school), F.lit(False))
    own = F.coalesce(F.col("owner") == F.lit(f"o{school}"), F.lit(False))
    return (
        F.when(F.col("visibility") == "PUBLIC", True)
        .when(F.col("school_id").isNull() & F.col("owner").isNull() & F.col("origin").isin("PLATFORM", "IMPORTED", "GENERATED"), True)
        .when(F.col("visibility") == "PRIVATE", own | own_school)
        .when(F.col("visibility") == "SCHOOL", own_school)
        .when(F.col("visibility") == "CLASSROOM", own_school & F.coalesce(F.col("content") == F.lit(classroom), F.lit(False)))
        .otherwise(F.col("visibility").isNull() & own_school)
    )


def reasons(**rules: Column) -> Column:
    """The names of the rules that are broken, in the order given."""
    return F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]), lambda x: x.isNotNull())


def availability(status: str, start: str, end: str, at) -> Column:
    now = F.expr(f"timestamp_ntz'{at}'")
    return (
        F.when(F.col(status) != "ACTIVE", F.col(status))
        .when(F.col(start).isNotNull() & (now < F.col(start)), "WAITING")
        .when(F.col(end).isNotNull() & (now > F.col(end)), "CLOSED")
        .otherwise("OPEN")
    )


def sort_column(asked: str | None, allowed: Mapping[str, str], default: str) -> str:
    """A sort column from a list of allowed ones; any other is the default."""
    return allowed.get(asked or "", default)

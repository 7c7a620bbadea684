"""Aggregations: score metrics by cut, conditional counters, grains of several levels, histograms as maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veredas.operators.selection import medians


def score_metrics(df: DataFrame, score: str, band: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, median, population deviation, and the share of each band (in percent), for each cut or overall."""
    n = df.groupBy(*by, band).agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(band, "_n")))).alias("_bands"))
    stats = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg(score), F.lit(0.0)), 2).alias("mean"), F.round(F.coalesce(F.stddev_pop(score), F.lit(0.0)), 2).alias("deviation"),
    )
    met = stats
    for part in (n.select(*by, "_bands"), medians(df, score, by).withColumnRenamed("median", "_median")):
        other = part.withColumnsRenamed({k: f"_{k}" for k in by})
        met = met.join(other, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by] or F.lit(True), "left").drop(*[f"_{k}" for k in by])  # without a cut one row each
    bands = F.transform_values("_bands", lambda _, v: F.round(v * 100.0 / F.col("n"), 1))
    return met.select(*by, "n", "mean", F.coalesce("_median", F.lit(0.0)).alias("median"), "deviation", bands.alias("bands"))


def counters(**conditions: Column) -> list[Column]:
    return [F.count_if(c).alias(name) for name, c in conditions.items()]


def histogram(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """For each key a map from value to count: counted first, so a key gathers one entry a value."""
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "_n")))).alias(out))


def bucket_by_average(df: DataFrame, member: str, score: str, limits: Sequence[tuple[float, str]], rest: str) -> DataFrame:
    """Members by the bucket of their average: averages first, so each member counts once."""
    mean = df.groupBy(member).agg(exact_mean(score).alias("_mean"))
    label = F.lit(rest)
    for below, name in reversed(limits):
        label = F.when(F.col("_mean") < below, name).otherwise(label)
    return mean.groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def two_grains(df: DataFrame, by: Sequence[str], coarse: str, fine: str, aggregates: Sequence[Column]) -> DataFrame:
    """(coarse) and (coarse, fine) in one pass; rows without a fine value count in the coarse grain only."""
    keys = [F.col(k) for k in (*by, coarse, fine)]
    sets = [[F.col(k) for k in (*by, coarse)], keys]
    every = df.groupingSets(sets, *keys).agg(F.grouping(fine).alias("_whole"), *aggregates)
    return every.filter((F.col("_whole") == 1) | F.col(fine).isNotNull()).withColumn("grain", F.when(F.col("_whole") == 1, coarse).otherwise(fine)).drop("_whole")


def exact_mean(score: str, scale: int = 2, value: Column | None = None) -> Column:
    """The mean of numbers of ``scale`` decimals: from a sum of integers, so it depends on no order of rows."""
    parts = F.round((F.col(score) if value is None else value) * 10**scale).cast("long")
    return F.try_divide(F.sum(parts).cast("double"), F.count(parts) * float(10**scale))


def rounded_mean(score: str, digits: int = 2, scale: int = 2) -> Column:
    """The same, rounded half up without a double between: numbers of zero or more."""
    parts = F.round(F.col(score) * 10**scale).cast("long") * 10 ** max(0, digits - scale)
    unit = 10 ** max(0, scale - digits)
    n = F.count(parts) * unit
    halves = (F.sum(parts) * 2 + n).cast("decimal(38,0)")
    return F.when(n > 0, F.floor(halves / (n * 2)).cast("long") / float(10**digits))


def share_at_least(score: str, limit: int) -> Column:
    return F.round(100.0 * F.count_if(F.col(score) >= limit) / F.count(F.lit(1)), 1)


def weighted_share(weight: Column, hit: Column, scale: float = 100.0, digits: int = 2) -> Column:
    return F.round(F.try_divide(F.sum(F.when(hit, weight).otherwise(0.0)), F.sum(weight)) * scale, digits)


def nested(df: DataFrame, by: Sequence[str], fields: Sequence[str], out: str) -> DataFrame:
    """The rows of a key as a sorted array of structs."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(out))


def means_of(columns: Mapping[str, str], digits: int = 1) -> list[Column]:
    return [F.round(F.coalesce(F.avg(c), F.lit(0.0)), digits).alias(name) for name, c in columns.items()]


def hierarchy(rooms: DataFrame, levels: Sequence[str], name: str, mean: str, members: str) -> DataFrame:
    """levels, mean, members ..., classrooms: a row for each level of a tree of classrooms, and one for all.

    A level's mean is the plain one of its classrooms' means (of one decimal), whatever their size; members are summed.
    ``classrooms``: struct(name, mean, members) in the order of names, at the lowest level only, where they are few.
    """
    lowest = F.grouping(levels[-1]) == 0
    held = F.collect_list(F.struct(name, mean, members))
    found = rooms.rollup(*levels).agg(rounded_mean(mean, 1, 1).alias("mean"), F.sum(members).alias("students"), lowest.alias("_lowest"))
    leaves = rooms.groupBy(*levels).agg(F.array_sort(held).alias("classrooms"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in levels]
    met = found.join(leaves.select(*[F.col(c).alias(f"_{c}") for c in levels], "classrooms"), [*same, F.col("_lowest")], "left")
    return met.drop("_lowest", *[f"_{c}" for c in levels])


def retrieval_metrics(gold: DataFrame, found: DataFrame, case: str, node: str, place: str, k: int) -> DataFrame:
    """covered, recall, precision, top_1, top_<k> over all cases, in one row.

    ``gold`` and ``found`` have a row for each (case, node) with its place from 1. Covered cases have gold; of those, recall is the share with
    any of it found, top_1 that of which the first found is the first gold, top_k that with gold among the first k. Precision is the share of what was
    found that is gold, over all cases, and 1 where nothing was found.
    """
    one, two = gold.select(case, node, F.col(place).alias("_g")), found.select(case, node, F.col(place).alias("_f"))
    both = one.join(two, [case, node], "full")
    hit = F.col("_g").isNotNull() & F.col("_f").isNotNull()
    cases = both.groupBy(case).agg(
        F.count("_g").alias("_gold"), F.count("_f").alias("_found"), F.count_if(hit).alias("_hits"), F.max(hit & (F.col("_f") <= k)).alias("_near"), F.max(hit & (F.col("_g") == 1) & (F.col("_f") == 1)).alias("_first")
    )
    covered = F.count_if(F.col("_gold") > 0)
    share = lambda c: F.round(F.try_divide(F.count_if((F.col("_gold") > 0) & c), covered), 4)
    precision = F.round(F.coalesce(F.try_divide(F.sum("_hits"), F.sum("_found")), F.lit(1.0)), 4)
    return cases.agg(covered.alias("covered"), share(F.col("_hits") > 0).alias("recall"), precision.alias("precision"), share(F.col("_first")).alias("top_1"), share(F.col("_near")).alias(f"top_{k}"))

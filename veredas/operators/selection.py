"""Exact order statistics and ranges of near equal size, without sorting a table in one task or holding a group in one buffer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veredas.sources.shared import remove, written

RANGES = 64  # ranges that a round counts
ACCURACY = 2000  # of the splitters: each range is within 1 / ACCURACY of its share
MOST_VALUES = 10_000  # distinct values of a group that one window may sort


def splitters(column: str, parts: int) -> Column:
    """An aggregate: the values that cut a column into ``parts`` ranges of near equal size, from a summary of bounded size of all rows."""
    return F.percentile_approx(column, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(ACCURACY))


def range_of(value: Column, cuts: Column) -> Column:
    """The number of the range that a value falls in, from 0: how many cuts are at or below it. Equal values share a range."""
    return F.size(F.filter(cuts, lambda c: c <= value))


def _same(by: Sequence[str], left: str, right: str) -> Column:
    on = F.lit(True)
    for k in by:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def medians(df: DataFrame, value: str, by: Sequence[str] = (), most: int = MOST_VALUES, ranges: int = RANGES) -> DataFrame:
    """by ..., median: the middle value of each group's rows with a value, or the mean of the middle two, as a double; exact.

    Values are counted first, so ties are one row. Where a group has more than ``most`` distinct values, they are counted in
    ``ranges`` by splitters that follow their distribution, for all groups at once; only the range that holds the middle is
    kept, and counted again until it has few enough. Each round cuts what is left to a ``ranges``-th or so, whatever the outliers.
    """
    keys = list(by)
    values = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    values = values.select(*keys, F.col("v").cast("double").alias("v"), "n")
    if values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_values")).filter(F.col("_values") > most).isEmpty():
        place = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        placed = values.withColumns({"_upto": F.sum("n").over(place), "_rows": F.sum("n").over(Window.partitionBy(*keys))})
        hits = lambda r: ((F.col("_upto") - F.col("n") <= r) & (r < F.col("_upto"))).cast("int")
        times = hits(F.floor((F.col("_rows") - 1) / 2)) + hits(F.floor(F.col("_rows") / 2))
        return placed.groupBy(*keys).agg((F.sum(F.col("v") * times) / 2).alias("median"))
    values = written(values, "values")
    # one or two ranks a group, each with what it looks among, and how many rows lie below that
    total = values.groupBy(*keys).agg(F.sum("n").alias("_rows"))
    ranks = total.select(*keys, F.explode(F.array_distinct(F.array(F.floor((F.col("_rows") - 1) / 2), F.floor(F.col("_rows") / 2)))).alias("rank"))
    ranks = ranks if keys else F.broadcast(ranks)
    held = values.alias("v").join(ranks.alias("r"), _same(keys, "v", "r")).select(*[F.col(f"v.{k}").alias(k) for k in keys], "rank", "v", "n", F.lit(0).cast("long").alias("below"))
    held, old = written(held, "held"), values
    group = [*keys, "rank"]
    while True:
        wide = held.groupBy(*group).agg(F.count(F.lit(1)).alias("_values")).filter(F.col("_values") > most)
        if wide.isEmpty():
            break
        open_ = held.alias("v").join(wide.alias("w"), _same(group, "v", "w"), "left_semi")
        cuts = open_.groupBy(*group).agg(splitters("v", ranges).alias("cuts"))
        cuts = written(cuts, "cuts")
        ranged = held.alias("v").join(F.broadcast(cuts).alias("c") if cuts.count() <= 1000 else cuts.alias("c"), _same(group, "v", "c"), "left")
        ranged = ranged.select(*[F.col(f"v.{k}").alias(k) for k in group], "v.v", "n", "below", F.coalesce(range_of(F.col("v.v"), F.col("cuts")), F.lit(0)).alias("range"))
        counts = ranged.groupBy(*group, "range").agg(F.sum("n").alias("rows"), F.first("below").alias("below"))  # at most ``ranges`` rows a group
        before = F.coalesce(F.sum("rows").over(Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        middle = counts.withColumn("low", F.col("below") + before).filter((F.col("low") <= F.col("rank")) & (F.col("rank") < F.col("low") + F.col("rows")))
        middle = middle.select(*group, "range", "low")
        kept = ranged.alias("v").join(middle.alias("m"), _same([*group, "range"], "v", "m")).select(*[F.col(f"v.{k}").alias(k) for k in group], "v.v", "v.n", F.col("m.low").alias("below"))
        step = written(kept, "held")
        remove(held), remove(cuts)
        held = step
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("below")
    found = held.withColumn("low", before).filter((F.col("low") <= F.col("rank")) & (F.col("rank") < F.col("low") + F.col("n")))
    found = written(found.groupBy(*keys).agg((F.sum("v") / F.count(F.lit(1))).alias("median")), "medians")
    remove(held), remove(old)
    return found


def places(counts: DataFrame, value: str, n: str, ranges: int = 256) -> DataFrame:
    """value, above: for each distinct value the sum of ``n`` over all greater ones; nulls come last.

    Values go to ranges by splitters of their distribution, so one outlier doesn't empty the others; each range is
    summed by a window, and the ranges by their totals.
    """
    known = counts.filter(F.col(value).isNotNull())
    cuts = known.agg(splitters(value, ranges).alias("_cuts"))  # one row
    ranged = counts.join(F.broadcast(cuts)).withColumn("_range", F.coalesce(range_of(F.col(value), F.col("_cuts")), F.lit(-1))).drop("_cuts")
    totals = ranged.groupBy("_range").agg(F.sum(n).alias("_total"))  # at most ``ranges`` rows
    above = totals.select("_range", F.coalesce(F.sum("_total").over(Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"))
    inside = Window.partitionBy("_range").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    met = ranged.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(F.broadcast(above), "_range")
    return met.select(value, (F.col("_above") + F.col("_inside")).cast("long").alias("above"))

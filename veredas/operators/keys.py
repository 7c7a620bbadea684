"""Rows by key: the newest, the first, a page, the first of each value in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def n_rows() -> Column:
    return F.count(F.lit(1))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in an order that should be total. ``rank`` names their number, if wanted."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n)
    return ranked.withColumnRenamed("_rank", rank) if rank else ranked.drop("_rank")


def latest_per_key(df: DataFrame, keys: Sequence[str], at: str, *ties: str) -> DataFrame:
    """The newest row of each key, rows without a time first of all, as a descending order has them in the source."""
    return first_per_key(df, keys, [F.col(at).desc_nulls_first(), *[F.col(t).desc() for t in ties]])


def cascade_fill(items: DataFrame, seen: DataFrame, student: str, key: str, item: str, order: Sequence[Column], n: int, wanted: Column | None = None) -> DataFrame:
    """(student, key, item, stage): the ``n`` items for each student and each key of which they have seen items, in order of stage.

    Stage 1 is new and wanted, 2 new, 3 wanted and seen, 4 the rest, only where nothing is in 3. Without ``wanted`` all
    are, so that new ones are filled up with seen ones. ``order`` should be total within a key. Null keys and items,
    and seen items that aren't in ``items``, count for nothing.

    Each list (key, wanted or not) is ranked once. A student needs of it only the first n and one more for each item seen there,
    so the lists' heads meet one row for each student and key, which has the places that were seen; of these heads the
    places are counted off in that row. A row holds what one student has seen of one key, and n items.
    """
    ok = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    place = F.row_number().over(Window.partitionBy(key, "_wanted").orderBy(*order))
    ranked = items.filter(F.col(key).isNotNull() & F.col(item).isNotNull()).withColumn("_wanted", ok).select(key, item, "_wanted", place.alias("_place"))
    lists = {"_again": F.col("_wanted"), "_rest": ~F.col("_wanted")}
    own = lambda of: F.array_sort(F.collect_list(F.when(of & F.col(student).isNotNull(), F.struct("_place", F.col(item).alias("_item")))))
    had = seen.select(student, item).distinct().join(ranked, item).groupBy(student, key).agg(*[own(of).alias(c) for c, of in lists.items()])
    most = had.groupBy(key).agg(F.max(F.greatest(*map(F.size, lists))).alias("_most"))
    near = ranked.join(most, key).filter(F.col("_place") <= F.col("_most") + n).groupBy(key)
    heads = near.agg(*[F.transform(F.array_sort(F.collect_list(F.when(of, F.struct("_place", F.col(item).alias("_item"))))), lambda x: x["_item"]).alias(f"{c}_head") for c, of in lists.items()])

    def unseen(c: str, stage: int) -> Column:
        to = F.least(F.size(c) + n, F.size(f"{c}_head"))
        free = F.array_except(F.sequence(F.lit(1), to), F.transform(c, lambda x: x["_place"]))
        found = F.transform(F.slice(free, 1, n), lambda p: F.struct(F.lit(stage).alias("stage"), F.element_at(f"{c}_head", p).alias("_item")))
        return F.when(to > 0, found).otherwise(F.slice(found_again(c, stage), 1, 0))

    def found_again(c: str, stage: int) -> Column:
        return F.transform(F.slice(c, 1, n), lambda x: F.struct(F.lit(stage).alias("stage"), x["_item"].alias("_item")))

    last = F.slice(found_again("_rest", 4), 1, F.when(F.size("_again") > 0, 0).otherwise(n))
    filled = F.slice(F.concat(unseen("_again", 1), unseen("_rest", 2), found_again("_again", 3), last), 1, n)
    rows = had.join(heads, key).select(student, key, F.explode(filled).alias("_x"))
    return rows.select(student, key, F.col("_x._item").alias(item), F.col("_x.stage").alias("stage"))


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20, most: int = 100) -> DataFrame:
    """A page of a sorted table: filter and deduplicate before, so that pages are full."""
    number, size = max(1, number), max(1, min(most, size))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def with_total(df: DataFrame, key: str) -> DataFrame:
    """One row: the number of distinct keys that paging goes over."""
    return df.agg(F.count_distinct(key).alias("total"))

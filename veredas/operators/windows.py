"""Window operators: ranks, halves, runs, recent rows, running states."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from veredas.functions import scoring as S
from veredas.operators.selection import places


def supersede(df: DataFrame, keys: Sequence[str], order: Sequence[Column], status: str) -> DataFrame:
    """All but a key's first row get SUPERSEDED."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(status, F.when(rank > 1, "SUPERSEDED").otherwise(F.col(status)))


def competition_rank(df: DataFrame, score: str, out: str, by: Sequence[str] = (), bands: int = 256) -> DataFrame:
    """Ties share a rank and the next one skips; rows without a score come last, together. No task sorts all rows.

    Scores are counted first; a rank is one more than the count of all higher scores, summed in ranges of near equal size.
    """
    if by:
        return df.withColumn(out, F.rank().over(Window.partitionBy(*by).orderBy(F.desc(score))))
    counts = df.groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    ranks = places(counts, score, "_n", bands).select(F.col(score).alias("_score"), (F.col("above") + 1).alias(out))
    return df.join(ranks, F.col(score).eqNullSafe(F.col("_score"))).drop("_score")


def half_trend(df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: Column, least: int = 4, step: float = 10.0) -> DataFrame:
    """IMPROVING, DECLINING or STABLE: the later half against the first floor(n / 2) outcomes, in percent."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_hit", F.when(hit, 100.0).otherwise(0.0))
    early = F.col("_i") <= F.floor(F.col("_n") / 2)
    halves = rows.groupBy(*keys).agg(F.max("_n").alias("n"), F.avg(F.when(early, F.col("_hit"))).alias("_a"), F.avg(F.when(~early, F.col("_hit"))).alias("_b"))
    change = F.round(F.col("_b") - F.col("_a"), 2)
    trend = F.when(F.col("n") < least, "INSUFFICIENT_EVIDENCE").when(change >= step, "IMPROVING").when(change <= -step, "DECLINING").otherwise("STABLE")
    return halves.select(*keys, "n", trend.alias("trend"))


def runs(df: DataFrame, keys: Sequence[str], place: str, value: str) -> DataFrame:
    """Maximal runs of consecutive places with the same value; a null value and a gap end a run."""
    known = df.filter(F.col(value).isNotNull())
    island = F.col(place) - F.row_number().over(Window.partitionBy(*keys, value).orderBy(place))
    return known.withColumn("_island", island).groupBy(*keys, value, "_island").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")).drop("_island")


def missing(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """The numbers left out between consecutive ones."""
    before = F.lag(number).over(Window.partitionBy(*keys).orderBy(number))
    gaps = df.select(*keys, number).distinct().withColumn("_before", before).filter(F.col(number) - F.col("_before") > 1)
    return gaps.select(*keys, F.explode(F.sequence(F.col("_before") + 1, F.col(number) - 1)).alias("missing"))


def last_all_equal(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, k: int, out: str) -> DataFrame:
    """Whether the last k values up to each row are there and all the same."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(k - 1), 0)
    seen = F.collect_list(value).over(w)
    return df.withColumn(out, (F.size(seen) == k) & (F.size(F.array_distinct(seen)) == 1))


def recent_distinct(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, rows: int, limit: int) -> DataFrame:
    """The first ``limit`` distinct values among the newest ``rows`` rows of each key, with their rank."""
    ranked = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_i") <= rows)
    firsts = ranked.groupBy(*keys, value).agg(F.min("_i").alias("_i"))
    return firsts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_i"))).filter(F.col("rank") <= limit).drop("_i")


def running_mastery(df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: str) -> DataFrame:
    """Counters, score, confidence and level after each answer. The level steps from the one before it: a fold per key.

    A key's answers are folded as an array in one row: answers of one student in one content.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("answered", F.count(F.lit(1)).over(w)).withColumn("correct", F.sum(F.when(F.col(hit), 1).otherwise(0)).over(w))
    rows = rows.withColumn("score", F.round(F.col("correct") * 100.0 / F.col("answered"), 2)).withColumn("confidence", S.confidence_curve(F.col("answered")))
    steps = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("answered", "correct", "score", "confidence"))).alias("steps"))
    level = F.aggregate("steps", F.lit("EASY"), lambda level, x: S.next_level(level, x["score"], x["confidence"]))
    last = F.element_at("steps", -1)
    return steps.select(*keys, last["answered"].alias("answered"), last["correct"].alias("correct"), last["score"].alias("score"), F.round(last["confidence"], 4).alias("confidence"), level.alias("level"))


def fifo_chunks(df: DataFrame, queue: str, order: Sequence[str], size: str, limit: int, rows: int, group: int = 1, out: str = "chunk") -> DataFrame:
    """The rows with the number of their chunk in their queue, from 0: in order, a chunk closed before it would pass either limit.

    Each ``group`` consecutive rows of a queue stay together, and a group over a limit has a chunk to itself. A queue is
    sorted by the shuffle and streamed through one task, which keeps a chunk's number, size and rows, and one group.
    """
    columns = df.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: object = None
        number = taken = count = 0

        def place(name: object, total: int, n: int) -> int:
            nonlocal at, number, taken, count
            if name != at:
                at, number, taken, count = name, 0, 0, 0
            elif count + n > rows or taken + total > limit:
                number, taken, count = number + 1, 0, 0
            taken, count = taken + total, count + n
            return number

        def cut(batch: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
            names, sizes, i, placed = [("q", None if pd.isna(q) else q) for q in batch[queue]], batch[size].tolist(), 0, []
            while i < len(names):
                j = i + 1
                while j < len(names) and j - i < group and names[j] == names[i]:
                    j += 1
                if j == len(names) and j - i < group and not last:  # the group may go on
                    break
                placed += [place(names[i], sum(sizes[i:j]), j - i)] * (j - i)
                i = j
            return batch.iloc[:i].assign(**{out: placed}), batch.iloc[i:]

        rest = None
        for batch in batches:
            done, rest = cut(batch if rest is None else pd.concat([rest, batch], ignore_index=True), False)
            yield done
        if rest is not None and len(rest):
            yield cut(rest, True)[0]

    schema = StructType([*df.schema.fields, StructField(out, IntegerType())])
    return df.repartition(queue).sortWithinPartitions(queue, *order).select(*columns).mapInPandas(fold, schema)

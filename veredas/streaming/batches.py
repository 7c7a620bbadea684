"""Resumable micro-batches over files: pending rows, idempotent application, sampling, latest runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veredas.functions.hashing import unit_interval

# States that a run never leaves.
TERMINAL = ("completed", "failed", "expired", "cancelled")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows without an output yet."""
    return rows.join(done.select(key), key, "left_anti")


def apply_once(results: DataFrame, sink: DataFrame, key: str) -> DataFrame:
    """The results to add: one for each key, none that the sink has."""
    return pending(results.dropDuplicates([key]), sink, key)


def paired(results: DataFrame, key: str, region: str, value: str) -> DataFrame:
    """Header and body results of a page side by side. A page without a body stays pending; the header may be missing."""
    both = results.groupBy(key).agg(*[F.max(F.when(F.col(region) == r, F.col(value))).alias(r) for r in ("header", "body")])
    return both.filter(F.col("body").isNotNull())


def review(identifier: Column, alerts: Column, scored: Column, rate: float) -> Column:
    """Rows with alerts or without scores are always reviewed, of the others a fixed share by their hash."""
    return F.when((alerts > 0) | ~scored, "REVIEW").when(unit_interval(identifier) < rate, "REVIEW").otherwise("APPROVE")


def run_available(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Processes what is there in micro-batches and ends; the next call goes on where this one stopped."""
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def deduplicated(stream: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """An event log without repeated events, as far as they come within the time given."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])

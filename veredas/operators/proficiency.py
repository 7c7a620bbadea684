"""Proficiency from evidence, with the estimator and the policy of what suffices as parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veredas.functions import scoring as S
from veredas.operators.aggregates import weighted_share


class Estimator(Protocol):
    """Aggregates over the evidence of a group. Another model gives its own score and confidence."""

    def score(self, hit: Column, difficulty: Column) -> Column: ...

    def confidence(self) -> Column: ...


@dataclass(frozen=True)
class WeightedShare:
    """The share of right answers, weighted by difficulty; confidence grows with their number up to ``full``."""

    weights: Mapping[str, float] = field(default_factory=lambda: dict(S.DIFFICULTY_WEIGHT))
    full: int = 10

    def score(self, hit: Column, difficulty: Column) -> Column:
        return weighted_share(S.lookup(difficulty, self.weights, 1.0), hit)

    def confidence(self) -> Column:
        return F.round(F.least(F.lit(1.0), F.count(F.lit(1)) / self.full), 4)


@dataclass(frozen=True)
class CoveragePolicy:
    """How much evidence says something of a content, and from which scores on it does."""

    evidence: int = 3
    difficulties: int = 2
    consolidated: float = 90.0
    gap: float = 40.0

    def status(self, n: Column, levels: Column, outcomes: Column, score: Column) -> Column:
        return (
            F.when(n == 0, "NOT_EVALUATED").when(outcomes > 1, "IN_PROGRESS").when((n < self.evidence) | (levels < self.difficulties), "INSUFFICIENT_EVIDENCE")
            .when(score >= self.consolidated, "CONSOLIDATED").when(score <= self.gap, "POSSIBLE_GAP").otherwise("SUFFICIENT_EVIDENCE")
        )

    def investigate(self, n: Column, score: Column) -> Column:
        return (n >= self.evidence) & (score <= self.gap)


def estimates(evidence: DataFrame, keys: Sequence[str], hit: str, difficulty: str, estimator: Estimator = WeightedShare(), **more: Column) -> DataFrame:
    """keys, score, confidence, n, levels, outcomes, band, and ``more`` aggregates; a null hit counts as wrong.

    Evidence is shuffled by its keys before it is aggregated, and one column alone is counted distinct: so a task holds the
    groups of its partition once, and no rows are made for each column counted (a group's evidence comes to one task).
    """
    right = F.coalesce(F.col(hit), F.lit(False))
    outcomes = F.coalesce(F.max(F.col(hit).cast("long")), F.lit(0)) + F.coalesce(F.max((~F.col(hit)).cast("long")), F.lit(0))
    rows = evidence.repartition(*keys).groupBy(*keys).agg(
        estimator.score(right, F.col(difficulty)).alias("score"), estimator.confidence().alias("confidence"), F.count(F.lit(1)).alias("n"),
        F.count_distinct(difficulty).alias("levels"), outcomes.alias("outcomes"), *[c.alias(n) for n, c in more.items()],
    )
    return rows.withColumn("band", S.steps(F.col("score"), S.PROFICIENCY_BANDS, "CONSOLIDATED_MASTERY"))


def coverage(found: DataFrame, policy: CoveragePolicy = CoveragePolicy()) -> DataFrame:
    """``estimates`` with ``status`` and ``investigate``."""
    n, score = F.col("n"), F.col("score")
    return found.withColumns({"status": policy.status(n, F.col("levels"), F.col("outcomes"), score), "investigate": policy.investigate(n, score)})

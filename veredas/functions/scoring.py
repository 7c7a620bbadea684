"""Scoring policies as column expressions. A policy's numbers are the domain's fixed values."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain.
ESSAY_BANDS = ((0, 399, "Muito baixo"), (400, 599, "Baixo"), (600, 799, "Adequado"), (800, 899, "Alto"), (900, 1000, "Muito alto"))
LEVELS = ("EASY", "MEDIUM", "HARD")
LEAST_SCORE = {"EASY": 70.0, "MEDIUM": 70.0, "HARD": 60.0}
DROP_BELOW = {"MEDIUM": 50.0, "HARD": 40.0}
LEAST_CONFIDENCE = 0.6
DIFFICULTY_WEIGHT = {"EASY": 1.0, "MEDIUM": 1.2, "HARD": 1.4}
PROFICIENCY_BANDS = ((40, "NEEDS_DEVELOPMENT"), (60, "INITIAL_DEVELOPMENT"), (75, "DEVELOPING"), (90, "CONSISTENT_MASTERY"))
SOURCE_BONUS = {"TEACHER": 18.0, "COORDINATION": 12.0, "SCHOOL_PLAN": 8.0}
SOURCE_WEIGHT = {"TEACHER": 100.0, "COORDINATION": 90.0, "SCHOOL_PLAN": 80.0, "AUTONOMOUS": 50.0}
# Soft and hard limits of a diagnostic, in seconds.
DIAGNOSTIC_LIMITS = {"ENEM": (2400, 2700), "GLOBAL": (2100, 2400), "UNSPECIFIED": (2100, 2400)}
DISCIPLINE_LIMITS = (1320, 1500)
SOURCE_ORDER = ("TEACHER", "COORDINATION", "SCHOOL_PLAN", "AUTONOMOUS")


def lookup(column: Column, values: Mapping[str, float], default: float | None) -> Column:
    out = reduce(lambda w, kv: w.when(column == kv[0], F.lit(kv[1])), values.items(), F.when(F.lit(False), F.lit(None)))
    return out.otherwise(F.lit(default))


def steps(value: Column, below: tuple[tuple[float, str], ...], rest: str) -> Column:
    """The label of the first limit that the value is below; the rest otherwise."""
    return reduce(lambda w, kv: w.when(value < kv[0], kv[1]), below, F.when(F.lit(False), F.lit(None))).otherwise(rest)


def accuracy(correct: Column, answered: Column, digits: int = 4) -> Column:
    """Null without answers."""
    return F.round(F.try_divide(correct, answered), digits)


def accuracy_band(answered: Column, share: Column, sample: int = 3, strong: float = 0.8, weak: float = 0.6) -> Column:
    return (
        F.when(answered < sample, "DADOS_INSUFICIENTES")
        .when(share.isNull(), "SEM_DADOS")
        .when(share >= strong, "PONTO_FORTE")
        .when(share < weak, "PONTO_MELHORIA")
        .otherwise("DESEMPENHO_INTERMEDIARIO")
    )


def mastery_state(score: Column, confidence: Column, evidence: Column) -> Column:
    return (
        F.when((evidence == 0) | score.isNull(), "NOT_EVALUATED")
        .when(confidence < 0.3, "LOW_EVIDENCE")
        .when(score < 40, "GAP")
        .when((score >= 85) & (confidence >= 0.6), "MASTERED")
        .otherwise("DEVELOPING")
    )


def confidence_curve(n: Column) -> Column:
    """0 to 1 by the number of answers: straight lines that meet at 3, 10, 20 and 70."""
    return (
        F.when(n == 0, 0.0)
        .when(n < 3, F.least(F.lit(0.3), n * 0.1))
        .when(n < 10, 0.3 + (n - 3) / 7 * 0.3)
        .when(n < 20, 0.6 + (n - 10) / 10 * 0.25)
        .otherwise(F.least(F.lit(1.0), 0.85 + (n - 20) / 50 * 0.15))
    )


def mastery_score(answered: Column, correct: Column, recent_correct: Column | None = None, recent_answered: Column | None = None) -> Column:
    overall = F.coalesce(F.try_divide(correct * 100.0, answered), F.lit(0.0))
    if recent_correct is None or recent_answered is None:
        return overall
    recent = F.coalesce(F.try_divide(recent_correct * 100.0, recent_answered), F.lit(0.0))
    mixed = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 0.6 * recent + 0.4 * overall))
    return F.when(answered == 0, 0.0).when(recent_correct.isNull() | recent_answered.isNull(), overall).otherwise(mixed)


def next_level(level: Column, score: Column, confidence: Column) -> Column:
    """One step of difficulty, up on enough mastery, down if it fell far; none on little evidence."""
    return (
        F.when(confidence < LEAST_CONFIDENCE, level)
        .when((level == "EASY") & (score >= LEAST_SCORE["EASY"]), "MEDIUM")
        .when((level == "MEDIUM") & (score >= LEAST_SCORE["MEDIUM"]), "HARD")
        .when((level == "MEDIUM") & (score < DROP_BELOW["MEDIUM"]), "EASY")
        .when((level == "HARD") & (score < DROP_BELOW["HARD"]), "MEDIUM")
        .otherwise(level)
    )


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level) - 1


def qualifies(level: Column, score: Column, confidence: Column) -> Column:
    return (confidence >= LEAST_CONFIDENCE) & (score >= lookup(level, LEAST_SCORE, 70.0))


def next_best_action(score: Column, confidence: Column, evidence: Column, trend: Column) -> Column:
    """struct(action, base): what to do next in a content without a doubtful prerequisite."""
    act = lambda a, b: F.struct(F.lit(a).alias("action"), F.lit(b).alias("base"))
    return (
        F.when((evidence == 0) | score.isNull(), act("COMPLETE_MISSING_EVIDENCE", 90.0))
        .when(confidence < 0.3, act("COMPLETE_MISSING_EVIDENCE", 85.0))
        .when(score < 40, act("PRACTICE_CONTENT", 80.0))
        .when(score < 70, act("REINFORCE_CONTENT", 65.0))
        .when(trend == "DECLINING", act("REVIEW_CONTENT", 60.0))
        .when((score >= 85) & (confidence >= 0.6), act("ADVANCE_CONTENT", 30.0))
        .otherwise(act("REVIEW_CONTENT", 45.0))
    )


def prerequisite_action(evidence: Column, confidence: Column, score: Column, status: Column) -> Column:
    """struct(action, base) if the prerequisite, not refuted, should come first; else null."""
    act = lambda a, b: F.struct(F.lit(a).alias("action"), F.lit(b).alias("base"))
    relevant = F.coalesce(status != "REFUTED", F.lit(True))
    return F.when(relevant & ((evidence == 0) | (confidence < 0.3)), act("COMPLETE_MISSING_EVIDENCE", 110.0)).when(relevant & (score < 40), act("STUDY_PREREQUISITE", 105.0))


def action_bonus(source: Column, aligned: Column, trend: Column, recent: Column) -> Column:
    return (
        lookup(source, SOURCE_BONUS, 0.0) + F.when(aligned, 12.0).otherwise(0.0) + F.when(trend == "DECLINING", 8.0).otherwise(0.0)
        - F.least(F.lit(15.0), recent * 3.0)
    )


def recommendation_score(source: Column, score: Column, n_sources: Column, repeated: Column) -> Column:
    need = F.when(score < 50, 40.0).when(score < 70, 30.0).when(score < 85, 20.0).otherwise(-30.0)
    return lookup(source, SOURCE_WEIGHT, 50.0) + need + F.when(n_sources > 1, 20.0).otherwise(0.0) + F.when(repeated, -50.0).otherwise(0.0)


def path_score(low_evidence: Column, weak: Column, blocker: Column, context: Column, stale: Column, blocked: Column, provisional: Column) -> Column:
    """Each factor 0 to 1; provisional evidence halves weakness at most; the sum is held in 0 to 1."""
    total = 0.35 * low_evidence + 0.30 * weak * (1 - 0.5 * provisional) + 0.25 * blocker + 0.15 * context + 0.10 * stale - 0.50 * blocked
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)


def diagnostic_decision(mode: Column, elapsed: Column, gap: Column, enough: Column, stop: Column | None = None, wide: Column | None = None, limits: Mapping[str, tuple[int, int]] = DIAGNOSTIC_LIMITS, rest: tuple[int, int] = DISCIPLINE_LIMITS) -> Column:
    """struct(action, reason, high_information_only): whether a diagnostic goes on.

    ``gap`` says that a prerequisite needs a look, ``enough`` that the content is covered, ``stop`` that the whole
    diagnostic is, ``wide`` that it goes over all disciplines. Past the soft limit only questions that tell much are asked.
    """
    soft, hard = (lookup(mode, {k: v[i] for k, v in limits.items()}, rest[i]) for i in (0, 1))
    late, no = elapsed >= soft, F.lit(False)
    told = lambda action, reason, few=no: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"), few.alias("high_information_only"))
    return (
        F.when(elapsed >= hard, told("FINISH_TIME", "HARD_LIMIT_REACHED"))
        .when(no if stop is None else stop, told("FINISH_SUFFICIENT", "GLOBAL_SUFFICIENCY_REACHED"))
        .when(no if wide is None else wide, told("CONTINUE", "GLOBAL_COVERAGE_INCOMPLETE", late))
        .when(gap, told("CONTINUE_PREREQUISITE_INVESTIGATION", "POSSIBLE_PREREQUISITE_GAP", late))
        .when(enough, told("FINISH_SUFFICIENT", "CONTENT_SUFFICIENCY_REACHED"))
        .when(late, told("CONTINUE", "SOFT_LIMIT_HIGH_INFORMATION_ONLY", F.lit(True)))
        .otherwise(told("CONTINUE", "INSUFFICIENT_EVIDENCE"))
    )


def global_stop(evidence: Column, covered: Column, critical: Column, confidence: Column, least: int, most: int, target: float) -> Column:
    """struct(stop, reason): whether a diagnostic over all disciplines has enough evidence."""
    told = lambda stop, reason: F.struct(F.lit(stop).alias("stop"), F.lit(reason).alias("reason"))
    enough = (evidence >= least) & covered & ~critical & (confidence >= target)
    return F.when(evidence >= most, told(True, "MAXIMUM_EVIDENCE_REACHED")).when(enough, told(True, "GLOBAL_SUFFICIENCY_REACHED")).otherwise(told(False, "CONTINUE"))


MOST_QUESTIONS = 50  # fixed value: of one list


def quota_verdict(quantity: Column, distribution: Column, most: int = MOST_QUESTIONS) -> Column:
    """VALID, or why a distribution (an array of struct(level, n)) doesn't fit the quantity that is asked for; the first reason counts.

    A level that isn't named counts as none, one that is named twice as both.
    """
    total = F.aggregate(distribution, F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return (
        F.when(quantity > most, "TOO_MANY").when(F.exists(distribution, lambda x: ~x["level"].isin(*LEVELS)), "UNKNOWN_LEVEL")
        .when((quantity <= 0) | F.exists(distribution, lambda x: x["n"] < 0), "NEGATIVE").when(total != quantity, "SUM_DIFFERS").otherwise("VALID")
    )

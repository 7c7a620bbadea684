"""Points of resources and videos for a student. A policy holds the numbers; the inputs are columns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from veredas.functions.scoring import lookup

# Fixed values of the domain: points by the part that a resource plays in a lesson.
ROLE_POINTS = {"THEORY": 10.0, "EXPLANATION": 8.0, "REVIEW": 5.0, "VIDEO": 5.0, "PRACTICE": 3.0, "REFERENCE": 2.0}
AUTHORED = ("AUTHOR", "SCHOOL")
EXAMPLE_WORDS = r"exemplo|exercício"


@dataclass(frozen=True)
class ResourcePolicy:
    direct: float = 30.0
    institution: float = 25.0
    authored: float = 20.0
    level: float = 15.0
    repeated: float = -40.0
    roles: Mapping[str, float] = field(default_factory=lambda: dict(ROLE_POINTS))
    other_role: float = 2.0


@dataclass(frozen=True)
class VideoPolicy:
    direct: float = 35.0
    related: float = 25.0
    level: float = 20.0
    institution: float = 25.0
    authored: float = 20.0
    platform: float = 15.0
    good_length: float = 10.0
    long_and_easy: float = -15.0
    unwatched: float = 15.0
    begun: float = 20.0
    finished: float = -30.0
    liked: float = 30.0
    disliked: float = -60.0
    wrong_level: float = -40.0
    too_fast: float = -30.0
    examples: float = 25.0
    good_seconds: tuple[int, int] = (180, 900)
    long_seconds: int = 1800
    short_seconds: int = 300


def _points(*rules: tuple[Column, float]) -> Column:
    """Of the first rule that holds; a rule on a null doesn't hold."""
    out = F
    for holds, points in rules:
        out = out.when(holds, F.lit(float(points)))
    return out.otherwise(F.lit(0.0))


def resource_score(direct: Column, institution: Column, origin: Column, level: Column, role: Column, recent: Column, policy: ResourcePolicy = ResourcePolicy()) -> Column:
    """``direct``: is on the wanted node; ``institution``: belongs to the student's; ``level``: has the wanted one; ``recent``: was recommended lately."""
    return (
        _points((direct, policy.direct)) + _points((institution, policy.institution)) + _points((origin.isin(*AUTHORED), policy.authored))
        + _points((level, policy.level)) + lookup(F.upper(role), policy.roles, policy.other_role) + _points((recent, policy.repeated))
    )


def video_score(
    direct: Column, related: Column, institution: Column, origin: Column, level: Column, wanted_level: Column, seconds: Column, progress: Column, watched: Column,
    verdict: Column, reason: Column, about: Column, dislikes: Mapping[str, Column], policy: VideoPolicy = VideoPolicy(),
) -> Column:
    """Points of a video; excluded ones are the caller's filter, as they have no row.

    ``verdict`` and ``reason`` are the student's own feedback on it; ``dislikes`` counts the student's reasons
    over all videos (TOO_FAST, TOO_BASIC, TOO_ADVANCED, NEEDS_EXAMPLES); ``about`` is title and description.
    """
    long, told = F.nullif(seconds, F.lit(0)), lambda name: F.coalesce(dislikes.get(name, F.lit(0)), F.lit(0)) > 0
    done = F.coalesce(progress.cast("double"), F.lit(0.0))
    return (
        _points((direct, policy.direct), (related, policy.related)) + _points((institution, policy.institution))
        + _points((F.upper(origin).isin(*AUTHORED), policy.authored), (F.upper(origin) == "PLATFORM", policy.platform)) + _points((level == wanted_level, policy.level))
        + _points((long.between(*policy.good_seconds), policy.good_length), ((long > policy.long_seconds) & (wanted_level == "EASY"), policy.long_and_easy))
        + _points((done >= 100, policy.finished), (done > 0, policy.begun), (~F.coalesce(watched, F.lit(False)), policy.unwatched))
        + _points((F.upper(verdict) == "LIKED", policy.liked), (F.upper(verdict) == "DISLIKED", policy.disliked))
        + _points((F.upper(reason).isin("TOO_BASIC", "TOO_ADVANCED"), policy.wrong_level), (F.upper(reason) == "TOO_FAST", policy.too_fast))
        + _points((told("TOO_FAST") & (long < policy.short_seconds), policy.too_fast))
        + _points((told("TOO_BASIC") & (level == "EASY"), policy.wrong_level)) + _points((told("TOO_ADVANCED") & (level == "HARD"), policy.wrong_level))
        + _points((told("NEEDS_EXAMPLES") & F.lower(about).rlike(EXAMPLE_WORDS), policy.examples))
    )

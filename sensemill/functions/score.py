"""Scores: priority, quality, ranking fusion, learning state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ------------------------------------------------------------------------------------
LEVELS = ["A1", "A2", "B1", "B2", "C1", "C2"]
LEARNER = {"A1": 1.0, "A2": 0.9, "B1": 0.78, "B2": 0.68, "C1": 0.60, "C2": 0.55}
PRIORITIES = [("VERY HIGH", 0.70), ("HIGH", 0.55), ("MEDIUM", 0.40), ("LOW", 0.25), ("VERY LOW", 0.0)]
HARD_MARKERS = ["obsolete", "archaic", "historical", "rare", "rare-sense", "derogatory", "offensive", "slur"]
SOFT_MARKERS = [
    "technical", "specialized", "slang", "vulgar", "internet", "alt-of", "initialism", "abbreviation", "misspelling",
    "pronunciation-spelling", "obsolete-sense", "archaic-sense",
]
BANDS = {"top1000": 1000, "top2000": 2000, "top3000": 3000}
RRF_K = 60
#: Added before rounding to four places, so that a half that binary arithmetic puts a little below is rounded up.
_HALF = 1e-9
GRADES = {"HARD": 1, "MEDIUM": 2, "EASY": 3}
# -------------------------------------------------------------------------------------------------


def ordinal(c: Column, values: list[str]) -> Column:
    """Place of a value in an ordered list, from 1; null for others."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), c), F.lit(0))


def frequency_component(rank: Column) -> Column:
    return F.when(rank.isNull(), 0.5).when(rank < 1, 1.0).when(rank >= 50_000, 0.30).otherwise(F.round(F.pow(rank.cast("double"), F.lit(-0.07)), 4))


def learner_component(level: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in LEARNER.items() for x in p]), level), F.lit(0.5))


def polish_component(confidences: Column) -> Column:
    """Mean of the confidences that are known, one half without any."""
    known = F.filter(confidences, lambda c: c.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, c: a + c) / F.size(known)
    return F.when(F.size(known) > 0, F.round(mean, 4)).otherwise(0.5)


def quality_component(examples: Column, depth: Column, linked: Column) -> Column:
    return (
        F.when(examples > 0, 0.4).otherwise(0.0) + F.when(depth >= 3, 0.3).when(depth >= 1, 0.15).otherwise(0.0) + F.when(linked, 0.3).otherwise(0.0)
    )


def penalty(tags: Column) -> Column:
    own = F.array_distinct(F.transform(tags, lambda t: F.lower(F.trim(t))))
    hard, soft = (F.array(*[F.lit(m) for m in ms]) for ms in (HARD_MARKERS, SOFT_MARKERS))
    return F.greatest(F.lit(0.25), F.when(F.arrays_overlap(own, hard), 0.5).otherwise(1.0) * F.pow(F.lit(0.75), F.size(F.array_intersect(own, soft)).cast("double")))


def priority_score(frequency: Column, learner: Column, polish: Column, quality: Column, penalised: Column) -> Column:
    raw = (0.35 * frequency + 0.15 * learner + 0.20 * polish + 0.30 * quality) * penalised
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(raw + _HALF, 4)))


def priority_level(score: Column) -> Column:
    out = F.lit(PRIORITIES[-1][0])
    for name, least in reversed(PRIORITIES[:-1]):
        out = F.when(score >= least, name).otherwise(out)
    return F.when(score.isNotNull(), out)


def quality_score(confidence: Column, definition: Column, examples: Column, level: Column, frequency: Column) -> Column:
    """Each part from 0 to 1, examples and the others as counts or nulls: unknown evidence counts as nothing."""
    raw = 0.30 * confidence + 0.25 * definition + 0.20 * F.least(F.lit(1.0), examples / 2.0) + 0.15 * level.isNotNull().cast("double") + 0.10 * frequency.isNotNull().cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(raw + _HALF, 4)))


def quality_indicators(confidence: Column, depth: Column, examples: Column, level: Column, frequency: Column, category: Column) -> dict[str, Column]:
    """The eight indicators of a sense by name. confidence: mean of its translations, null without any; depth: tokens of
    its gloss; examples: their number; category: its confidence, from 0 to 1. Missing evidence is false or 0."""
    mean = F.coalesce(F.round(confidence + _HALF, 4), F.lit(0.0))
    defined, examples = F.coalesce(depth >= 1, F.lit(False)), F.coalesce(examples, F.lit(0))
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(category, F.lit(0.0))))
    return {
        "translation_available": confidence.isNotNull(), "translation_confidence": mean, "definition_available": defined, "example_available": examples > 0,
        "cefr_available": level.isNotNull(), "frequency_available": frequency.isNotNull(), "category_confidence": F.round(bounded + _HALF, 4),
        "sense_confidence": quality_score(mean, defined.cast("double"), examples, level, frequency),
    }


def band(rank: Column) -> Column:
    out = F.lit("beyond")
    for name, most in reversed(BANDS.items()):
        out = F.when(rank <= most, name).otherwise(out)
    return F.when(rank.isNotNull(), out)


def rrf(rank: Column) -> Column:
    return F.coalesce(1.0 / (rank + RRF_K), F.lit(0.0))


def metadata_bonus(rank: Column, level: Column) -> Column:
    return F.when(rank <= 3000, 0.5).otherwise(0.0) + F.when(level.isin("VERY HIGH", "HIGH"), 0.5).otherwise(0.0)


def hybrid_score(lexical: Column, semantic: Column, topic: Column, prefix: Column, meta: Column) -> Column:
    boost = F.when(prefix & lexical.isNotNull(), 0.25).otherwise(0.0)
    return 0.50 * (rrf(lexical) + boost) + 0.25 * rrf(semantic) + 0.20 * rrf(topic) + 0.05 * meta


def learning_state(active: Column, repetitions: Column, last_grade: Column) -> Column:
    return F.when(~active | (F.coalesce(repetitions, F.lit(0)) == 0), "NEW").when(last_grade == 1, "LEARNING").when(repetitions <= 1, "ENCOUNTERED").otherwise("REVIEWING")


def day_end(ts: Column) -> Column:
    return F.date_trunc("DAY", ts) + F.expr("interval 1 day") - F.expr("interval '0.000001' second")


def cosine_distance(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return 1.0 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))

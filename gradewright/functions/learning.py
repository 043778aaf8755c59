"""Expressions of the ability, retention and priority models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewright import config as C


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def mastery(theta: Column) -> Column:
    return logistic(theta - C.MASTERY_LOGIT)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def k_theta(attempts: Column) -> Column:
    return clamp(C.K_BASE / (1 + attempts), C.K_MIN, C.K_MAX)


def k_question(attempts: Column) -> Column:
    return C.KQ_BASE / (1 + attempts)


def confidence_weight(correct: Column, confidence: Column) -> Column:
    """Weight of an outcome by how sure the learner was; a null confidence counts as guessing."""
    out = None
    for (outcome, level), weight in C.CONFIDENCE.items():
        if level == "guessing":
            continue
        hit = (correct if outcome == "correct" else ~correct) & (confidence == level)
        out = F.when(hit, weight) if out is None else out.when(hit, weight)
    return out.when(correct, C.CONFIDENCE["correct", "guessing"]).otherwise(C.CONFIDENCE["wrong", "guessing"])


def retrievability(stability: Column, days: Column) -> Column:
    return F.when(stability <= 0, 0.0).otherwise(F.exp(-F.greatest(F.lit(0.0), days) / stability))


def days_until_due(stability: Column) -> Column:
    return F.when(stability <= 0, 0.0).otherwise(-stability * F.log(F.lit(C.DUE_R)))


def stability_factor(theta_after: Column, correct: Column, confidence: Column) -> Column:
    """What one attempt multiplies stability by, before the floor."""
    weight = confidence_weight(correct, confidence)
    grow = C.GROW_BASE + (C.GROW_MASTERY - C.GROW_BASE) * mastery(theta_after)
    return F.when(correct, 1 + (grow - 1) * weight).otherwise(C.FAIL_MULT / weight)


def card_factor(grade: Column) -> Column:
    """What a card's grade of 1 (wrong), 2 (right) or 3 (right and sure) multiplies stability by; null for others."""
    grow = C.GROW_MASTERY - 1
    return F.when(grade == 1, C.FAIL_MULT / C.CONFIDENCE["wrong", "sure"]).when(grade == 2, 1 + grow * C.CONFIDENCE["correct", "unsure"]).when(grade == 3, 1 + grow * C.CONFIDENCE["correct", "sure"])


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days, not below 0."""
    return F.greatest(F.lit(0.0), (F.unix_micros(later) - F.unix_micros(earlier)) / 8.64e10)


def priority(theta: Column, stability: Column, days: Column, misconception: Column, attempts: Column) -> Column:
    """How much a concept needs study; one never seen is fully due."""
    overdue = F.when(days.isNull(), 1.0).otherwise(1 - retrievability(stability, days))
    return (
        C.WEIGHT_WEAK * (1 - mastery(theta)) + C.WEIGHT_OVERDUE * overdue
        + C.WEIGHT_MISCONCEPTION * F.when(misconception, 1.0).otherwise(0.0) + C.WEIGHT_NOVELTY / (1 + attempts)
    )


def hashed_uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts only, the same on every engine that has md5."""
    head = F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double")
    return (head + 0.5) / 4294967296.0


def seed(*parts: Column) -> Column:
    """A whole number of 32 bits that depends on the parts only."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def counted_uniform(start: Column, n: Column) -> Column:
    """The n-th number in (0, 1) of a seed: n steps of 2^32 / golden ratio, then two rounds of xor-shift and multiplication in 32 bits.

    Plain integer arithmetic, the same on every engine; no digest a number.
    """
    mask = F.lit(4294967295)
    x = (start + n.cast("long") * F.lit(2654435769)).bitwiseAND(mask)
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(73244475)).bitwiseAND(mask)
    return (x.bitwiseXOR(F.shiftright(x, 16)) + 0.5) / 4294967296.0


def expected_value(p: Column, marks: Column) -> Column:
    """Marks expected from an item that is attempted only above break-even."""
    gain = p * marks - (1 - p) * C.NEGATIVE * marks
    return F.when(p >= C.NEGATIVE / (1 + C.NEGATIVE), gain).otherwise(0.0)

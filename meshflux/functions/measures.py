"""Scalar column expressions shared by the operators."""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshflux.settings import CHANNEL_PRIOR, GATE_EXPONENTS, GATE_K, GATE_LAMBDA

TINY = 1e-12


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clip01(value: Column | str) -> Column:
    """Value held to 0..1; null stays null (``least`` alone would skip it)."""
    v = _col(value).cast("double")
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def strength_to_distance(strength: Column | str) -> Column:
    """``1 / strength``; a missing, infinite or non-positive strength is unreachable."""
    s = _col(strength).cast("double")
    bad = s.isNull() | F.isnan(s) | (s <= 0) | (s == F.lit(float("inf")))
    return F.when(bad, F.lit(float("inf"))).otherwise(F.lit(1.0) / F.greatest(s, F.lit(TINY)))


def hill_survival(baseline: Column | str, survival: Column | str, exponent: float = 2) -> Column:
    """Baseline left after Hill inhibition at a surviving fraction."""
    lost = F.lit(1.0) - _col(survival)
    power = F.pow(lost, F.lit(float(exponent)))
    return _col(baseline) * (F.lit(1.0) - power / (F.lit(0.5 ** exponent) + power))


def neighbour_boost(survival: Column | str, boost: float = 0.10) -> Column:
    """Boost that grows smoothly with the inhibited fraction."""
    square = F.pow(F.lit(1.0) - _col(survival), F.lit(2.0))
    return F.lit(boost) * square / (F.lit(0.25) + square)


def hill(value: Column | str, k: Column | float, exponent: float) -> Column:
    powered = F.pow(clip01(value), F.lit(float(exponent)))
    k = F.lit(float(k)) if isinstance(k, (int, float)) else k
    return powered / (F.pow(k, F.lit(float(exponent))) + powered)


def corroboration_bonus(
    evidence: Column | str,
    text: Column | str,
    *,
    gate: str = "G1",
    k_text: Column | float = GATE_K[0],
    k_evidence: Column | float = GATE_K[1],
    exponents: tuple[float, float] = GATE_EXPONENTS,
    strength: Column | float = GATE_LAMBDA,
) -> Column:
    """``1 + strength x gate``: text support counts only where other evidence agrees."""
    by_text = hill(text, k_text, exponents[0])
    by_evidence = hill(evidence, k_evidence, exponents[1])
    gated = {
        "G1": by_text * by_evidence,
        "G2": by_text * F.sqrt(by_evidence),
        "G3": by_text * (F.lit(2.0) * by_evidence / (F.lit(1.0) + by_evidence)),
    }
    if gate not in gated:
        raise ValueError("gate must be G1, G2 or G3")
    strength = F.lit(float(strength)) if isinstance(strength, (int, float)) else strength
    return F.lit(1.0) + strength * gated[gate]


def combine_channels(scores: Sequence[Column | str], prior: float = CHANNEL_PRIOR) -> Column:
    """Independent-channel probability with a shared prior; scores in 0..1, zeros skipped."""
    missed = F.lit(1.0)
    for score in scores:
        s = _col(score).cast("double")
        own = F.greatest(F.lit(0.0), (s - F.lit(prior)) / F.lit(1.0 - prior))
        missed = missed * F.when(s > 0, F.lit(1.0) - own).otherwise(F.lit(1.0))
    return F.lit(prior) + F.lit(1.0 - prior) * (F.lit(1.0) - missed)


def percent_change(before: Column | str, after: Column | str, *, undefined: float | None = 0.0) -> Column:
    """Change in percent of ``before``; a zero baseline gives ``undefined``."""
    b, a = _col(before), _col(after)
    return F.when(b != 0, (a - b) / b * F.lit(100.0)).otherwise(F.lit(undefined).cast("double"))


def safe_ratio(part: Column | str, whole: Column | str) -> Column:
    """Ratio, null on a zero or missing denominator."""
    return F.try_divide(_col(part).cast("double"), _col(whole).cast("double"))


def direction(delta: Column | str, threshold: float = 0.0) -> Column:
    d = _col(delta)
    return F.when(d > threshold, "gain").when(d < -threshold, "loss").when(d.isNotNull(), "no change")


def banded_sign(value: Column | str, threshold: float) -> Column:
    v = _col(value)
    return F.when(v > threshold, "POSITIVE").when(v < -threshold, "NEGATIVE").when(v.isNotNull(), "NEUTRAL")


# Words read as true.
TRUE_WORDS = ("true", "1", "yes", "evet", "✓")


def strict_true(value: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(_col(value).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


# Named attenuation levels.
SEVERITIES = {"Mild": 0.50, "Moderate": 0.20, "Strong": 0.05, "Near-complete": 0.001}


def severity_fraction(name: Column | str) -> Column:
    out = F.lit(None).cast("double")
    for label, fraction in SEVERITIES.items():
        out = F.when(_col(name) == label, F.lit(fraction)).otherwise(out)
    return out


def severity_name(fraction: Column | str, tolerance: float = 1e-12) -> Column:
    out = F.lit("Custom")
    for label, value in SEVERITIES.items():
        out = F.when(F.abs(_col(fraction) - F.lit(value)) <= tolerance, label).otherwise(out)
    return out


def evidence_status(stimulation: Column | str, inhibition: Column | str, directed: Column | str) -> Column:
    up, down, way = (F.coalesce(_col(c), F.lit(False)) for c in (stimulation, inhibition, directed))
    return (
        F.when(up & down, "conflicting_evidence")
        .when(up, "consensus_stimulation")
        .when(down, "consensus_inhibition")
        .when(way, "direction_only")
        .otherwise("unsupported_direction")
    )


def canonical_sign(stimulation: Column | str, inhibition: Column | str) -> Column:
    up, down = (F.coalesce(_col(c), F.lit(False)) for c in (stimulation, inhibition))
    return F.when(up & ~down, 1).when(down & ~up, -1).otherwise(0).cast("tinyint")


def normal_tail(z: Column | str) -> Column:
    """Upper tail of the standard normal to double precision.

    The series of the error function up to 2, its continued fraction beyond.
    """
    z = _col(z)
    x = F.abs(z) / F.lit(2.0 ** 0.5)
    start = F.struct(x.alias("term"), x.alias("sum"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), start,
        lambda s, k: F.struct((s["term"] * x * x * 2.0 / (k * 2 + 1)).alias("term"), (s["sum"] + s["term"] * x * x * 2.0 / (k * 2 + 1)).alias("sum")))["sum"]
    gauss = F.exp(-x * x) / F.lit(math.sqrt(math.pi))
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x, lambda f, k: x + k / (f * 2.0))
    half = F.when(x <= 2.0, F.lit(0.5) - series * gauss).otherwise(gauss / fraction / 2.0)
    return F.when(z.isNull(), None).when(z >= 0, half).otherwise(F.lit(1.0) - half)


def confidence_score(has_delta, has_baseline, annotations, directed) -> Column:
    """How much evidence a finding rests on, 0.20 to 0.95."""
    points = (
        F.lit(0.20)
        + F.when(_col(has_delta), 0.30).otherwise(0.0)
        + F.when(_col(has_baseline), 0.20).otherwise(0.0)
        + F.least(F.lit(0.20), _col(annotations) * F.lit(0.05))
        + F.least(F.lit(0.10), _col(directed) * F.lit(0.05))
    )
    return F.least(F.lit(0.95), points)


def confidence_label(score: Column | str) -> Column:
    s = _col(score)
    return F.when(s >= 0.70, "high").when(s >= 0.45, "medium").otherwise("low")

"""Risk scores as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ETA = 0.5


def _d(x: float) -> Column:
    return F.lit(float(x))


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(_d(lo), F.least(_d(hi), x))


def low_confidence() -> Column:
    return _d(1) - F.col("conf")


def weighted_risk() -> Column:
    """Mean, least and dropped confidence, with a bonus beyond each of two gates."""
    base = _d(0.5) * (_d(1) - F.col("mean_conf")) + _d(0.3) * (_d(1) - F.col("min_conf")) + _d(0.2) * F.col("drop")
    base = base + F.when(F.col("min_conf") < _d(0.35), _d(0.10)).otherwise(_d(0))
    return base + F.when(F.col("drop") > _d(0.20), _d(0.10)).otherwise(_d(0))


def strategy(name: str, eta: float = ETA) -> Column:
    """The score of a strategy over conf, mean_conf, min_conf, drop and r_d."""
    known = {
        "GCR": lambda: low_confidence(),
        "DGCR": lambda: low_confidence() + F.col("r_d"),
        "WUR": lambda: weighted_risk(),
        "DWUR": lambda: weighted_risk() + _d(eta) * F.col("r_d"),
    }
    if name not in known:
        raise ValueError(f"unknown strategy {name}")
    return known[name]()


def rule_risk(mean_conf: Column, b_edge: Column, drop: Column) -> Column:
    return clip(_d(0.5) * (_d(1) - mean_conf) + _d(0.3) * b_edge + _d(0.2) * drop)


def edge_blank(stats: Column) -> Column:
    """The larger of the two edges' blank figures (mean and peak, 6 to 4); 0 for invalid statistics."""
    side = lambda s: _d(0.6) * stats[f"blank_mean_{s}"] + _d(0.4) * stats[f"blank_peak_{s}"]
    return F.when(F.coalesce(stats["valid"], F.lit(False)), F.greatest(side("L"), side("R"))).otherwise(_d(0))


def scaled_entropy(v: Column, lo: float, hi: float) -> Column:
    """Min-max scaled to [0, 1]; 0.5 for a range that is none."""
    return _d(0.5) if hi <= lo else clip((v - _d(lo)) / _d(hi - lo))


def boundary_score(stats: Column, entropy: Column, drop: Column, lo: float = 0.0, hi: float = 5.0) -> Column:
    """Thirds of scaled entropy times blank, blank and drop; 0.5 for invalid statistics."""
    b, v = edge_blank(stats), F.coalesce(scaled_entropy(entropy, lo, hi), _d(0))
    third = _d(1.0 / 3.0)
    return F.when(F.coalesce(stats["valid"], F.lit(False)), clip(third * (v * b) + third * b + third * drop)).otherwise(_d(0.5))


def missing_share(expected: Column, found: Column) -> Column:
    """Share of expected characters that are missing; 0 without an expectation."""
    return F.when(expected > 0, F.greatest(_d(0), (expected - found).cast("double") / expected.cast("double"))).otherwise(_d(0))


def ambiguity_score(status: Column, first: Column, second: Column, gap_mean: Column, first_mean: Column) -> Column:
    """One minus the least margin between the two best classes, by the best figures there are."""
    margin = F.array_min(F.zip_with(first, second, lambda p, q: p - q))
    known = F.coalesce(status, F.lit("missing")) == "available"
    return (
        F.when(known & first.isNotNull() & second.isNotNull(), clip(_d(1) - margin))
        .when(known & gap_mean.isNotNull(), clip(_d(1) - F.greatest(_d(0), gap_mean - _d(0.1))))
        .when(first.isNotNull(), clip(_d(1) - F.array_min(first)))
        .when(first_mean.isNotNull(), clip(_d(1) - F.greatest(_d(0), first_mean - _d(0.15))))
        .otherwise(_d(0.8))
    )


def route(s_b: Column, s_a: Column, threshold: Column) -> Column:
    b, a = s_b >= threshold, s_a >= threshold
    return F.when(b & a, "both").when(b, "boundary").when(a, "ambiguity").otherwise("none")


def priority(s_b: Column, s_a: Column, r_d: Column, eta: float = ETA) -> Column:
    return F.greatest(s_b, s_a) + _d(eta) * r_d


def suspicious(first: Column, second: Column) -> Column:
    """0-based place of the least margin, the first of equal ones."""
    margins = F.zip_with(first, second, lambda p, q: p - q)
    return (F.array_position(margins, F.array_min(margins)) - 1).cast("int")


def risk_level(visual: Column, semantic: Column, high: tuple[float, float] = (0.8, 3.0), low: tuple[float, float] = (0.5, 2.0)) -> Column:
    """Two tiers over visual entropy and an optional semantic figure."""
    over = lambda t: (visual > t[0]) | F.coalesce(semantic > t[1], F.lit(False))
    return F.when(over(high), "high").when(over(low), "medium").otherwise("low")


def end_risk(confidences: Column, threshold: float = 0.6) -> Column:
    """Whether the mean confidence of the first or last two characters is low."""
    mean = lambda a: F.aggregate(a, _d(0), lambda s, x: s + x, lambda s: s / F.greatest(F.lit(1), F.size(a)))
    n = F.size(confidences)
    ends = F.least(mean(F.slice(confidences, 1, 2)), mean(F.slice(confidences, F.greatest(n - 1, F.lit(1)), F.lit(2))))
    return F.when(n > 0, ends < _d(threshold)).otherwise(False)


def logistic(features: Sequence[Column], weights: Sequence[float], bias: float) -> Column:
    """Logistic score in single precision, its argument clipped to ±500."""
    z = F.lit(float(bias)).cast("float")
    for x, w in zip(features, weights, strict=True):
        z = (z + x.cast("float") * F.lit(float(w)).cast("float")).cast("float")
    return _d(1) / (_d(1) + F.exp(-clip(z.cast("double"), -500, 500)))


def padded_logistic(features: Column, weights: Sequence[float], bias: float) -> Column:
    """Logistic score of a feature array that is cut to the weights or filled with zeros."""
    w = F.array(*[F.lit(float(x)).cast("float") for x in weights])
    x = F.slice(F.concat(F.transform(features, lambda v: v.cast("float")), F.array_repeat(F.lit(0.0).cast("float"), len(weights))), 1, len(weights))
    z = F.aggregate(F.zip_with(x, w, lambda a, b: (a * b).cast("float")), F.lit(float(bias)).cast("float"), lambda acc, v: (acc + v).cast("float"))
    return _d(1) / (_d(1) + F.exp(-clip(z.cast("double"), -500, 500)))

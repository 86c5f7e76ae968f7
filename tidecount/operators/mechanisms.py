"""Noise mechanisms over a table of true values, with 95 % intervals and Rényi points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.noise import Z_95, laplace, normal, noise_seed, seed_text, seeded_laplace, seeded_normal


def _positive(epsilon: float, delta: float | None = None) -> None:
    if epsilon <= 0:
        raise ValueError("epsilon must be above 0")
    if delta is not None and not 0 < delta < 1:
        raise ValueError("delta must lie in (0, 1)")


def laplace_scale(epsilon: float, sensitivity: float = 1.0) -> float:
    _positive(epsilon)
    return sensitivity / epsilon


def gaussian_sigma(epsilon: float, delta: float, sensitivity: float = 1.0) -> float:
    """The classic calibration, proven for epsilon under 1."""
    _positive(epsilon, delta)
    return math.sqrt(2 * math.log(1.25 / delta)) * sensitivity / epsilon


def laplace_half_width(scale: float, alpha: float = 0.05) -> float:
    """A tail of ``alpha / 2`` of each side's exponential, so wider than the exact two-sided quantile."""
    return -scale * math.log(alpha / 2)


def release(values: DataFrame, metric: str, epsilon: float, delta: float, seed: int, sensitivity: float = 1.0, value: str = "users", parity: bool = False) -> DataFrame:
    """Adds ``estimate, lower_95, upper_95, mechanism`` to rows with ``day`` and a true value, Gaussian if delta is above 0, else Laplace.

    Noise is a function of (metric, day, seed), drawn in the JVM. ``parity`` draws from Python's generator instead, seeded alike.
    """
    text = seed_text(metric, F.col("day"), seed)
    if delta > 0:
        sigma = gaussian_sigma(epsilon, delta, sensitivity)
        half, kind = Z_95 * sigma, "gaussian"
        noise = seeded_normal(noise_seed(metric, F.col("day"), seed), F.lit(sigma)) if parity else normal(text, F.lit(sigma))
    else:
        scale = laplace_scale(epsilon, sensitivity)
        half, kind = laplace_half_width(scale), "laplace"
        noise = seeded_laplace(noise_seed(metric, F.col("day"), seed), F.lit(scale)) if parity else laplace(text, F.lit(scale))
    noisy = values.withColumn("estimate", F.col(value) + noise)
    return noisy.withColumn("lower_95", F.col("estimate") - half).withColumn("upper_95", F.col("estimate") + half).withColumn("mechanism", F.lit(kind))


def gaussian_rdp(alpha: Column, sigma: Column, sensitivity: float = 1.0) -> Column:
    return alpha * sensitivity**2 / (2 * sigma * sigma)


def laplace_rdp(alpha: Column, epsilon: Column, tight: bool = False) -> Column:
    """A curve for the Laplace mechanism: the simple one by default, or the exact one (Mironov 2017)."""
    if not tight:
        return alpha / (alpha - 1) * epsilon
    return F.log(alpha / (2 * alpha - 1) * F.exp((alpha - 1) * epsilon) + (alpha - 1) / (2 * alpha - 1) * F.exp(-alpha * epsilon)) / (alpha - 1)


def rdp_points(releases: DataFrame, orders: tuple[float, ...], sensitivity: float = 1.0) -> DataFrame:
    """(metric, day, period, alpha, rdp): a point for each release and order over 1."""
    sigma = F.sqrt(2 * F.log(1.25 / F.col("delta"))) * sensitivity / F.col("epsilon")
    curve = F.when(F.col("delta") > 0, gaussian_rdp(F.col("alpha"), sigma, sensitivity)).otherwise(laplace_rdp(F.col("alpha"), F.col("epsilon")))
    spread = releases.withColumn("alpha", F.explode(F.array(*(F.lit(float(a)) for a in orders if a > 1))))
    return spread.select(*(c for c in ("id",) if c in releases.columns), "metric", "day", "period", "alpha", curve.alias("rdp"))

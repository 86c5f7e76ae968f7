"""Release noise as a function of a seed string, so that every engine and every rerun draws the same value."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z_95 = 1.959963984540054


def seed_text(metric: Column | str, day: Column, seed: int) -> Column:
    metric = F.lit(metric) if isinstance(metric, str) else metric
    return F.concat_ws(":", metric, F.date_format(day, "yyyy-MM-dd"), F.lit(str(seed)))


def noise_seed(metric: Column | str, day: Column, seed: int) -> Column:
    """The first 63 bits after the sign of the seed text's SHA-256, as a long."""
    number = F.conv(F.substring(F.sha2(F.encode(seed_text(metric, day, seed), "UTF-8"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (number % F.lit(str(2**63)).cast("decimal(20,0)")).cast("long")


def uniform(text: Column, offset: int) -> Column:
    """A number in (0, 1) from 13 hex digits of the text's SHA-256, beginning at ``offset`` (from 1)."""
    return (F.conv(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), offset, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def laplace(text: Column, scale: Column) -> Column:
    u = uniform(text, 1) - 0.5
    return -scale * F.signum(u) * F.log(1 - 2 * F.abs(u))


def normal(text: Column, sigma: Column) -> Column:
    return sigma * F.sqrt(-2 * F.log(uniform(text, 1))) * F.cos(2 * math.pi * uniform(text, 14))


@F.pandas_udf(T.DoubleType())
def seeded_laplace(seed: pd.Series, scale: pd.Series) -> pd.Series:
    """The draw of Python's seeded generator, for parity on result rows (never on events)."""

    def draw(s: int, b: float) -> float:
        u = random.Random(s).random() - 0.5
        return b * math.copysign(1, u) * math.log(1 - 2 * abs(u))  # against the sign of u

    return pd.Series([draw(int(s), b) for s, b in zip(seed, scale, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def seeded_normal(seed: pd.Series, sigma: pd.Series) -> pd.Series:
    return pd.Series([random.Random(int(s)).gauss(0, b) for s, b in zip(seed, sigma, strict=True)], dtype=float)

"""Errors of released or estimated counts against true ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import activity, mechanisms, sketches, turnstile


def errors(rows: DataFrame, estimate: str = "estimate", exact: str = "exact") -> DataFrame:
    """Adds ``ae``, the absolute error, and ``re``, relative to at least 1."""
    ae = F.abs(F.col(estimate) - F.col(exact))
    return rows.withColumn("ae", ae).withColumn("re", ae / F.greatest(F.lit(1.0), F.col(exact).cast("double")))


def error_stats(rows: DataFrame, *group: str) -> DataFrame:
    """Median, 90th and 95th percentile and maximum of both errors, and the share of intervals that hold the true value."""
    stats = [f(c).alias(f"{c}_{name}") for c in ("ae", "re") for name, f in (("median", F.median), ("p90", lambda c: F.percentile(c, F.lit(0.9))), ("p95", lambda c: F.percentile(c, F.lit(0.95))), ("max", F.max))]
    if "lower_95" in rows.columns:
        stats.append(F.avg(F.col("exact").between(F.col("lower_95"), F.col("upper_95")).cast("double")).alias("coverage"))
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *stats)


def sweep(rows: DataFrame, names: tuple[str, ...], epsilons: tuple[float, ...], window_days: int, delta: float, seed: int, epsilon_mau: float = 0.0, shards: int = 1) -> DataFrame:
    """(sketch, epsilon, metric, day, exact, estimate): the last day's releases for every sketch and epsilon.

    Daily counts are released from exact counts, window counts from the sketch, as a release would; those cost ``epsilon_mau`` at least.
    Each shard of the users has its own sketch: ``sketches.shard_count`` of them leave no error but the noise.
    Where no user is active, 0 is released with its noise; null is no user; a table without rows has no last day and no releases.
    """
    pairs = turnstile.active_pairs(rows).filter("user_id IS NOT NULL")
    day = rows.agg(F.max("day")).first()[0]
    last = rows.sparkSession.createDataFrame([] if day is None else [(day,)], "day date")
    end = F.lit(day).cast("date")
    today = activity.rolling(pairs, last, 1).withColumn("metric", F.lit("dau"))
    window = pairs.filter(F.col("day").between(F.date_sub(end, window_days - 1), end)).select("user_id", end.alias("day"))
    exact = last.join(activity.daily(window).withColumnRenamed("users", "exact"), "day", "left")
    out = []
    for name in names:
        estimate = sketches.merged(sketches.daily_sketches(window, name, shards=shards), ["day"], name).select("day", F.col("estimate").alias("users"))
        counts = exact.join(estimate, "day", "left").fillna(0)
        for epsilon in epsilons:
            daily = mechanisms.release(today.withColumn("exact", F.col("users")), "dau", epsilon, 0.0, seed)
            month = mechanisms.release(counts, "mau", max(epsilon_mau, epsilon), delta, seed).withColumn("metric", F.lit("mau"))
            for part in (daily, month):
                out.append(part.select(F.lit(name).alias("sketch"), F.lit(float(epsilon)).alias("epsilon"), "metric", "day", F.col("exact").cast("double").alias("exact"), F.col("estimate").cast("double").alias("estimate")))
    return reduce(DataFrame.union, out)


def write_results(swept: DataFrame, path: str) -> None:
    """A sweep as JSON lines, one for each sketch and epsilon, with the releases of both metrics by name."""
    answer = F.struct("metric", F.struct("day", "exact", "estimate"))
    swept.groupBy("sketch", "epsilon").agg(F.map_from_entries(F.array_sort(F.collect_list(answer))).alias("releases")).select("sketch", "epsilon", "releases.dau", "releases.mau").write.json(path)

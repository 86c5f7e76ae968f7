"""Synthetic turnstile workloads, a function of their seed alone: any partitioning writes the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.noise import uniform
from ..sources.events import NO_DAYS


def _draw(seed: int, what: str, *keys: Column) -> Column:
    return uniform(F.concat_ws(":", F.lit(str(seed)), F.lit(what), *(k.cast("string") for k in keys)), 1)


def _grid(spark: SparkSession, users: int, days: int, start: str) -> DataFrame:
    first = F.to_date(F.lit(start))
    return spark.range(users).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("d")).withColumn("day", F.date_add(first, F.col("d").cast("int")))


def _numbered(rows: DataFrame, days: int) -> DataFrame:
    """Arrival order: by day, user and step; numbers are unique but not dense, so that no task needs another's count."""
    return rows.withColumn("seq", (F.col("d").cast("long") * F.lit(2) + F.col("step")) * F.lit(1 << 40) + F.col("u"))


def _rows(rows: DataFrame, name: str = "user-") -> DataFrame:
    return rows.select("seq", F.concat(F.lit(name), F.col("u").cast("string")).alias("user_id"), "day", "op", "days")


def synthetic(spark: SparkSession, users: int = 100, days: int = 7, p_active: float = 0.2, delete_rate: float = 0.1, seed: int = 1, start: str = "2025-01-01") -> DataFrame:
    """Each day a user is active with ``p_active``; one with active days then deletes all of them with ``delete_rate``, by listed days."""
    grid = _grid(spark, users, days, start)
    plus = grid.filter(_draw(seed, "active", F.col("u"), F.col("d")) <= p_active).withColumn("step", F.lit(0)).withColumn("op", F.lit("+")).withColumn("days", F.expr(NO_DAYS))
    deletes = grid.filter(_draw(seed, "delete", F.col("u"), F.col("d")) <= delete_rate).withColumn("step", F.lit(1)).withColumn("op", F.lit("-")).withColumn("days", F.expr(NO_DAYS))
    both = plus.union(deletes)
    # active days since the last deletion
    order = Window.partitionBy("u").orderBy("d", "step")
    era = F.coalesce(F.sum(F.when(F.col("op") == "-", 1)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    live = both.withColumn("era", era).withColumn("live", F.collect_list(F.when(F.col("op") == "+", F.col("day"))).over(Window.partitionBy("u", "era").orderBy("d", "step")))
    kept = live.filter("op = '+' OR size(live) > 0").withColumn("days", F.when(F.col("op") == "-", F.col("live")).otherwise(F.col("days")))
    return _rows(_numbered(kept, days))


def simulate(spark: SparkSession, users: int = 10_000, days: int = 60, p_active: float = 0.2, delete_rate: float = 0.05, seed: int = 1, start: str = "2025-01-01") -> DataFrame:
    """As ``synthetic``, but an active user deletes on the same day and lists no days."""
    grid = _grid(spark, users, days, start).filter(_draw(seed, "active", F.col("u"), F.col("d")) <= p_active)
    gone = _draw(seed, "delete", F.col("u"), F.col("d")) <= delete_rate
    ops = grid.withColumn("x", F.explode(F.when(gone, F.array(F.struct(F.lit(0).alias("step"), F.lit("+").alias("op")), F.struct(F.lit(1).alias("step"), F.lit("-").alias("op")))).otherwise(F.array(F.struct(F.lit(0).alias("step"), F.lit("+").alias("op"))))))
    return _rows(_numbered(ops.select("u", "d", "day", "x.step", "x.op").withColumn("days", F.expr(NO_DAYS)), days))


def adversarial(spark: SparkSession, users: int = 500, window: int = 30, flips: int = 2, seed: int = 1, start: str = "2025-01-01") -> DataFrame:
    """Users that insert and delete in turn, ``flips`` times, each time on a random day; deletions list no days."""
    base = spark.range(users).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(flips - 1))).alias("k"))
    d = F.floor(_draw(seed, "day", F.col("u"), F.col("k")) * window).cast("int")
    rows = base.withColumn("day", F.date_add(F.to_date(F.lit(start)), d)).withColumn("op", F.when(F.col("k") % 2 == 0, "+").otherwise("-"))
    return _rows(rows.withColumn("seq", F.col("k").cast("long") * F.lit(1 << 40) + F.col("u")).withColumn("days", F.expr(NO_DAYS)), "adv-")


def sample_traffic(spark: SparkSession, days: int = 30, daily_users: int = 50, seed: int = 1, start: str = "2025-01-01") -> DataFrame:
    """New users each day; with a chance of 0.3 one of a day's users deletes that day."""
    grid = _grid(spark, daily_users, days, start)
    plus = grid.withColumn("step", F.lit(0)).withColumn("op", F.lit("+")).withColumn("days", F.expr(NO_DAYS))
    gone = grid.filter((F.col("u") == F.floor(_draw(seed, "who", F.col("d")) * daily_users)) & (_draw(seed, "gone", F.col("d")) < 0.3)).withColumn("step", F.lit(1)).withColumn("op", F.lit("-")).withColumn("days", F.array("day"))
    rows = _numbered(plus.union(gone), days)
    return rows.select("seq", F.concat_ws("-", F.lit("ci-user"), "d", "u").alias("user_id"), "day", "op", "days")


def load_sample(spark: SparkSession, events: int = 100_000, users: int = 100_000, days: int = 30, delete_rate: float = 0.1, seed: int = 1, start: str = "2025-01-01") -> DataFrame:
    """Events of random users on random days; a share are deletions that list their day and the two before."""
    rows = spark.range(events).select(F.col("id").alias("seq"))
    rows = rows.withColumn("u", F.floor(_draw(seed, "user", F.col("seq")) * users)).withColumn("day", F.date_add(F.to_date(F.lit(start)), F.floor(_draw(seed, "day", F.col("seq")) * days).cast("int")))
    rows = rows.withColumn("op", F.when(_draw(seed, "op", F.col("seq")) > delete_rate, "+").otherwise("-"))
    listed = F.when(F.col("op") == "-", F.array("day", F.date_sub("day", 1), F.date_sub("day", 2))).otherwise(F.expr(NO_DAYS))
    return _rows(rows.withColumn("days", listed), "load-user-")


def beta_population(spark: SparkSession, users: int = 10_000, days: int = 30, deleting: float = 0.05, seed: int = 1, start: str = "2025-01-01") -> DataFrame:
    """Activity rates from Beta(0.5, 5) for each user; a share ``deleting`` erases all days on one day from the tenth on.

    Beta(1/2, 5) is the squared length of one of eleven normal coordinates over the squared length of all.
    """
    def square(i: int) -> Column:
        text = F.concat_ws(":", F.lit(str(seed)), F.lit(f"beta{i}"), F.col("u").cast("string"))
        return -2 * F.log(uniform(text, 1)) * F.pow(F.cos(2 * math.pi * uniform(text, 14)), 2)

    total = square(0)
    for i in range(1, 11):
        total = total + square(i)
    people = spark.range(users).select(F.col("id").alias("u")).withColumn("rate", square(0) / total)
    grid = people.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).withColumn("day", F.date_add(F.to_date(F.lit(start)), F.col("d").cast("int")))
    plus = grid.filter(_draw(seed, "active", F.col("u"), F.col("d")) <= F.col("rate")).withColumn("step", F.lit(0)).withColumn("op", F.lit("+")).drop("rate")
    when = F.lit(9) + F.floor(_draw(seed, "when", F.col("u")) * max(1, days - 9)).cast("int")
    gone = people.filter(_draw(seed, "deletes", F.col("u")) <= deleting).withColumn("d", F.least(when, F.lit(days - 1))).withColumn("day", F.date_add(F.to_date(F.lit(start)), F.col("d"))).withColumn("step", F.lit(1)).withColumn("op", F.lit("-")).drop("rate")
    return _rows(_numbered(plus.unionByName(gone).withColumn("days", F.expr(NO_DAYS)), days))

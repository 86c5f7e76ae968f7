"""Daily, weekly, monthly and any rolling count of distinct active users."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily(pairs: DataFrame, user: str = "user_id", unique: bool = False) -> DataFrame:
    """(day, users) for days with an active user; ``unique`` says that no (user, day) is repeated, so that counting is enough."""
    return pairs.groupBy("day").agg((F.count(user) if unique else F.count_distinct(user)).alias("users"))


def spine(rows: DataFrame, column: str = "day") -> DataFrame:
    """Every day from the first to the last."""
    ends = rows.agg(F.min(column).alias("a"), F.max(column).alias("b")).filter("a IS NOT NULL")
    return ends.select(F.explode(F.sequence("a", "b")).alias("day"))


def daily_filled(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(day, users) for every day between the log's first and last, without gaps."""
    return spine(rows).join(daily(pairs, unique=True), "day", "left").select("day", F.coalesce("users", F.lit(0)).cast("long").alias("users"))


def window_count(pairs: DataFrame, end: str, window_days: int, user: str = "user_id") -> DataFrame:
    """(end_day, window_days, users) for the one window that ends on ``end``."""
    last = F.to_date(F.lit(end))
    inside = pairs.filter(F.col("day").between(F.date_sub(last, window_days - 1), last))
    return inside.agg(F.count_distinct(user).alias("users")).select(last.alias("end_day"), F.lit(window_days).alias("window_days"), "users")


def rolling(pairs: DataFrame, days: DataFrame, window_days: int, user: str = "user_id") -> DataFrame:
    """(day, users): distinct users in the ``window_days`` days up to each of ``days``.

    An active day adds its user from that day until the next active day or the window's end, whichever comes first; the
    intervals don't overlap, so a running sum of their ends counts users. Rows stay as many as pairs, where
    spreading each pair over its windows would make ``window_days`` times as many. The running sum is over days only.
    """
    own = Window.partitionBy(user).orderBy("day")
    spans = pairs.select(user, "day").distinct().withColumn("next", F.lead("day").over(own))
    until = F.least(F.coalesce("next", F.date_add("day", window_days)), F.date_add("day", window_days))
    steps = spans.select(F.explode(F.array(F.struct(F.col("day").alias("day"), F.lit(1).alias("step")), F.struct(until.alias("day"), F.lit(-1).alias("step")))).alias("s")).select("s.*")
    change = steps.groupBy("day").agg(F.sum("step").alias("step")).union(days.select("day", F.lit(0).cast("long"))).groupBy("day").agg(F.sum("step").alias("step"))
    counted = change.withColumn("users", F.sum("step").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
    return counted.join(days, "day", "left_semi").select("day", "users")


def rolling_exploded(pairs: DataFrame, days: DataFrame, window_days: int, user: str = "user_id") -> DataFrame:
    """As ``rolling`` by spreading each pair over the windows that hold it: ``window_days`` times the rows, for comparison."""
    ends = pairs.select(user, F.explode(F.sequence("day", F.date_add("day", window_days - 1))).alias("day")).distinct()
    return days.join(ends.groupBy("day").agg(F.count(user).alias("users")), "day", "left").select("day", F.coalesce("users", F.lit(0)).cast("long").alias("users"))


def weekly(pairs: DataFrame, days: DataFrame) -> DataFrame:
    return rolling(pairs, days, 7)

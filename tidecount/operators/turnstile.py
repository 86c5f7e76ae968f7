"""Turnstile state: which (user, day) pairs are active after insertions, deletions and retroactive erasures.

The log is never replayed row by row. Within a (user, day) the last operation wins, so state is a function of maxima of
``seq``: the pair's last insertion, the last deletion that names the day, and the user's last deletion of all known days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _named(rows: DataFrame) -> DataFrame:
    """Each row once for every day it names itself: its own, and for a deletion its listed days."""
    days = F.when(F.col("op") == "-", F.array_distinct(F.concat(F.array("day"), "days"))).otherwise(F.array("day"))
    return rows.select("seq", "user_id", "op", (F.size("days") == 0).alias("all_days"), F.explode(days).alias("day"))


def pair_state(rows: DataFrame) -> DataFrame:
    """(user_id, day, last_seq, active) for every pair that some row names; one shuffle by pair, one small join by user.

    ``rows`` are turnstile rows. A deletion without listed days removes all days known when it arrives, among them later
    days that are already in the log; a day inserted afterwards is active again.
    """
    cells = _named(rows).groupBy("user_id", "day").agg(F.max(F.when(F.col("op") == "+", F.col("seq"))).alias("plus"), F.max(F.when(F.col("op") == "-", F.col("seq"))).alias("minus"))
    cover = rows.filter("op = '-' AND size(days) = 0").groupBy("user_id").agg(F.max("seq").alias("cover"))
    gone = F.greatest("minus", "cover")  # ignores nulls
    return cells.join(cover, "user_id", "left").select("user_id", "day", F.greatest("plus", "minus").alias("last_seq"), F.coalesce((F.col("plus") > gone) | (F.col("plus").isNotNull() & gone.isNull()), F.lit(False)).alias("active"))


def active_pairs(rows: DataFrame) -> DataFrame:
    """(user_id, day) pairs that are active at the end of the log."""
    return pair_state(rows).filter("active").select("user_id", "day")


def known_days(rows: DataFrame) -> DataFrame:
    """(user_id, day, first_seq): when each day of a user came to be known to the log, by a row of it or a deletion that lists it."""
    return _named(rows).groupBy("user_id", "day").agg(F.min("seq").alias("first_seq"))


def tombstones(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(seq, user_id, source_day, day): what each deletion removes, one row for each day.

    A deletion without listed days removes all days of its user known by then, from these rows or as ``known`` (user_id, day, first_seq). The join is on the user, whose days number
    as many as the calendar's.
    """
    gone = rows.filter("op = '-'").select("seq", "user_id", F.col("day").alias("source_day"), "days")
    listed = gone.filter("size(days) > 0").select("seq", "user_id", "source_day", F.explode(F.array_distinct(F.concat(F.array("source_day"), "days"))).alias("day"))
    days = known_days(rows)
    if known is not None:
        days = days.unionByName(known).groupBy("user_id", "day").agg(F.min("first_seq").alias("first_seq"))
    rest = gone.filter("size(days) = 0").drop("days").join(days, "user_id").filter("first_seq <= seq").select("seq", "user_id", "source_day", "day")
    return listed.union(rest)


def expanded_log(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(seq, step, user_id, day, op): the log with every deletion's tombstones right behind it."""
    base = rows.select("seq", F.lit(0).alias("step"), "user_id", "day", "op")
    return base.union(tombstones(rows, known).select("seq", F.lit(1).alias("step"), "user_id", "day", F.lit("-").alias("op")))


def day_fold(log: DataFrame) -> DataFrame:
    """(user_id, day) pairs whose last operation in an expanded log is an insertion."""
    return log.groupBy("user_id", "day").agg(F.max_by("op", F.struct("seq", "step")).alias("op")).filter("op = '+'").select("user_id", "day")


def erasures(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(erasure_id, user_id, days): one audit row for each deletion, with its affected days in order."""
    return tombstones(rows, known).groupBy(F.col("seq").alias("erasure_id"), "user_id").agg(F.array_sort(F.collect_set("day")).alias("days"))


def dirty_days(rows: DataFrame) -> DataFrame:
    """The days whose state some of these rows touch."""
    return expanded_log(rows).select("day").distinct()


def flips(rows: DataFrame) -> DataFrame:
    """(user_id, flips): how often a user's state changes over all days, from inactive, in an expanded log."""
    order = Window.partitionBy("user_id", "day").orderBy("seq", "step")
    changed = expanded_log(rows).withColumn("before", F.lag("op", 1, "-").over(order)).filter("op <> before")
    users = rows.select("user_id").distinct()
    return users.join(changed.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).cast("long").alias("flips"))

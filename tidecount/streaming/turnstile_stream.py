"""Streams of turnstile rows.

Lateness is unlimited (any row may touch any day), so the exact stream keeps its state in tables: each micro-batch is stored under
its batch id, and only the days it touches are counted again. A live view with a watermark gives approximate counts at once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity, turnstile
from ..sources.sinks import overwrite_partitions

ROWS = "seq long, user_id string, day date, op string, days array<date>"
COUNTS = "day date, users long"


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that finished batches have stored."""
    return spark.read.schema(f"{ROWS}, batch long").parquet(f"{folder}/log").drop("batch")


def counts(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(COUNTS).parquet(f"{folder}/daily").select("day", "users")
    except AnalysisException:  # nothing counted yet
        return spark.createDataFrame([], COUNTS)


def _apply(folder: str):
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # a batch that is run again replaces its own rows
        overwrite_partitions(batch.withColumn("batch", F.lit(batch_id).cast("long")), f"{folder}/log", "batch")
        log = stored(spark, folder)
        fresh = spark.read.schema(f"{ROWS}, batch long").parquet(f"{folder}/log").filter(F.col("batch") == batch_id).drop("batch")
        named = fresh.select("day").union(fresh.select(F.explode("days").alias("day")))
        # a deletion without a list touches all days that its user has in the log
        whole = fresh.filter("op = '-' AND size(days) = 0").select("user_id").distinct()
        users = turnstile.known_days(log.join(whole, "user_id", "left_semi")).select("day")
        touched = named.union(users).distinct()
        days = [r.day for r in touched.collect()]  # at most the calendar's
        if not days:
            return
        # only rows that name a touched day, or remove all days, can change a count
        listed = F.array(*map(F.lit, days))
        part = log.filter(F.arrays_overlap(listed, F.concat(F.array("day"), "days")) | ((F.col("op") == "-") & (F.size("days") == 0)))
        counted = activity.daily(turnstile.active_pairs(part).filter(F.col("day").isin(*days)))
        overwrite_partitions(touched.join(counted, "day", "left").select(F.coalesce("users", F.lit(0)).cast("long").alias("users"), "day"), f"{folder}/daily", "day")

    return apply


def keep_daily_counts(stream: DataFrame, folder: str, **trigger):
    """Starts a query that keeps ``folder/log`` and ``folder/daily`` up to date; returns it."""
    writer = stream.writeStream.foreachBatch(_apply(folder)).option("checkpointLocation", f"{folder}/checkpoint").outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def live_counts(events: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "2 days", sketch: str = "hll") -> DataFrame:
    """(start, end, users): approximate distinct users of a stream of insertions (ts timestamp, user_id) in tumbling or sliding windows."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    users = F.approx_count_distinct("user_id") if sketch == "hll" else F.theta_sketch_estimate(F.theta_sketch_agg("user_id"))
    return events.withWatermark("ts", late).groupBy(span.alias("w")).agg(users.alias("users")).select("w.start", "w.end", "users")


def first_of_day(events: DataFrame, late: str = "2 days") -> DataFrame:
    """The first event of each (user, day) in a stream of insertions only; deletions would need the later ones."""
    return events.withColumn("day", F.to_date("ts")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "day"])

"""The append-only ledger: pseudonymous activity, erasure requests and their status, as parquet tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import Config
from ..functions.pseudonym import user_root, with_user_key
from ..sources.schema import ACTIVITY, ERASURE, RDP_RELEASE, RELEASE, RESET, SNAPSHOT
from ..sources.sinks import after_reset, append, current, overwrite_partitions
from ..sources.sinks import numbered as sinks_numbered
from . import accountant, mechanisms, sketches, turnstile


def activity(rows: DataFrame, config: Config, known: DataFrame | None = None) -> DataFrame:
    """The log that is stored: the rows and their tombstones under each day's own salt, with the erasure key."""
    log = turnstile.expanded_log(rows, known)
    source = turnstile.tombstones(rows, known).select("seq", "user_id", "day", "source_day")
    log = log.join(source, ["seq", "user_id", "day"], "left")
    keyed = with_user_key(log, config.hash_salt_secret, config.hash_salt_rotation_days).withColumn("user_root", user_root(F.col("user_id"), config.root_secret))
    note = F.when(F.col("step") == 1, F.to_json(F.struct(F.lit(True).alias("tombstone"), F.date_format("source_day", "yyyy-MM-dd").alias("source_day"))))
    return keyed.select("seq", "step", "day", "user_key", "user_root", "op", note.alias("metadata"))


@dataclass
class Ledger:
    """Tables under one folder: ``activity`` by day, ``erasures``, ``releases`` and ``rdp_releases``."""

    spark: SparkSession
    path: str

    def _read(self, name: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def record(self, rows: DataFrame, config: Config) -> None:
        """Append turnstile rows, and a pending erasure for each deletion.

        ``seq`` goes on from one call to the next. A deletion of all known days takes in those that are stored already.
        """
        users = rows.filter("op = '-' AND size(days) = 0").select("user_id").distinct().withColumn("user_root", user_root(F.col("user_id"), config.root_secret))
        # read before anything is appended
        known = self.activity().join(users, "user_root").groupBy("user_id", "day").agg(F.min("seq").alias("first_seq"))
        log, asked = activity(rows, config, known), turnstile.erasures(rows, known)
        append(log, f"{self.path}/activity", "day")
        asked = asked.withColumn("user_root", user_root(F.col("user_id"), config.root_secret))
        stored = [r.day for r in self.snapshots().select("day").distinct().collect()]  # at most the calendar's
        dirty = [r.day for r in log.select("day").distinct().filter(F.col("day").isin(*stored)).collect()] if stored else []
        append(asked.select("erasure_id", "user_root", "days", F.lit(True).alias("pending"), F.lit(0).cast("long").alias("version")), f"{self.path}/erasures")
        if dirty:
            self.refresh(dirty, config.sketch_impl, config.sketch_k)

    def activity(self, *days: str) -> DataFrame:
        """The activity of some days; other days' folders are not read."""
        log = self._read("activity", ACTIVITY)
        return log.filter(F.col("day").isin(*(F.to_date(F.lit(d)) for d in days))) if days else log

    def erasures(self, pending: bool | None = None) -> DataFrame:
        log = current(self._read("erasures", ERASURE), "erasure_id")
        return log if pending is None else log.filter(F.col("pending") == pending)

    def replay(self) -> list:
        """The days of pending erasures, which are marked processed."""
        waiting = self.erasures(pending=True)
        days = [r[0] for r in waiting.select(F.explode("days").alias("d")).distinct().orderBy("d").collect()]  # at most the calendar's
        done = waiting.select("erasure_id", "user_root", "days", F.lit(False).alias("pending"), (F.col("version") + 1).alias("version"))
        append(done, f"{self.path}/erasures")
        return days

    def refresh(self, days: list, sketch: str = "kmv", k: int = 4096) -> None:
        """Count ``days`` again and replace their snapshots; other days' stay as they are."""
        spine = self.spark.createDataFrame([(d,) for d in days], "day date")
        active = self.active().filter(F.col("day").isin(*days)) if days else self.active().limit(0)
        if sketch == "kmv":  # no more than k hashes of a day are gathered
            made = sketches.daily_kmv(active.select("day", sketches.key_hash(F.col("user_key")).alias("h")), ["day"], k).withColumnRenamed("sketch", "s")
        else:
            made = active.groupBy("day").agg(sketches.backend(sketch).build("user_key").alias("s"))
        made = active.groupBy("day").agg(F.count("user_key").alias("exact_count")).join(made.select("day", F.to_json(F.struct("s")).alias("sketch")), "day")
        full = spine.join(made, "day", "left").select(F.coalesce("exact_count", F.lit(0)).cast("long").alias("exact_count"), "sketch", F.lit(sketch).alias("sketch_impl"), "day")
        overwrite_partitions(full, f"{self.path}/snapshots", "day")

    def day_count(self, day, config: Config) -> int:
        """The day's active users from its snapshot, which is made where missing. Days that later rows touch were refreshed when these were recorded or replayed."""
        held = self.snapshots().filter(F.col("day") == F.lit(day)).select("exact_count").first()
        if held is None:
            self.refresh([day], config.sketch_impl, config.sketch_k)
            held = self.snapshots().filter(F.col("day") == F.lit(day)).select("exact_count").first()
        return held.exact_count

    def snapshots(self) -> DataFrame:
        return self._read("snapshots", SNAPSHOT)

    # Budgets. One writer appends at a time; ids are arrival numbers within a log.

    def _next(self, log: DataFrame) -> int:
        return (log.agg(F.max("id")).first()[0] or 0) + 1

    def _all_releases(self) -> DataFrame:
        return self._read("releases", RELEASE)

    def releases(self, metric: str | None = None, period: str | None = None) -> DataFrame:
        """The releases since each month's last reset, by metric and month if given."""
        log = after_reset(self._all_releases(), self._read("resets", RESET))
        for name, value in (("metric", metric), ("period", period)):
            log = log if value is None else log.filter(F.col(name) == value)
        return log

    def record_releases(self, released: DataFrame, config: Config) -> None:
        """Append releases (metric, day, period, epsilon, delta, mechanism) and their Rényi points."""
        start = self._next(self._all_releases())
        ordered = sinks_numbered(released, start, "metric", "day").withColumn("seed", F.lit(config.default_seed).cast("long"))
        append(ordered.select("id", "metric", "day", "period", "epsilon", "delta", "mechanism", "seed"), f"{self.path}/releases")
        written = self._all_releases().filter(F.col("id") >= start)
        self.record_rdp(mechanisms.rdp_points(written, config.rdp_orders, config.sensitivity))

    def record_rdp(self, points: DataFrame) -> None:
        """Append Rényi points (id, metric, day, period, alpha, rdp); an order of at most 1 or a negative value is an error."""
        checked = points.withColumn("alpha", F.when(F.col("alpha") > 1, F.col("alpha")).otherwise(F.raise_error(F.lit("alpha must be above 1")).cast("double"))).withColumn("rdp", F.when(F.col("rdp") >= 0, F.col("rdp")).otherwise(F.raise_error(F.lit("a Rényi value can't be negative")).cast("double")))
        append(checked.select("id", "metric", "day", "period", "alpha", F.col("rdp").alias("epsilon")), f"{self.path}/rdp_releases")

    def rdp(self) -> DataFrame:
        """(metric, day, period, alpha, rdp) since each month's last reset."""
        log = after_reset(self._read("rdp_releases", RDP_RELEASE), self._read("resets", RESET))
        return log.select("metric", "day", "period", "alpha", F.col("epsilon").alias("rdp"))

    def reset(self, metric: str, period: str) -> None:
        """Start a month's budget anew: a mark above which releases count. Nothing is deleted."""
        mark = self._next(self._all_releases()) - 1
        append(self.spark.createDataFrame([(metric.lower(), period, mark)], RESET), f"{self.path}/resets")

    def budget(self, config: Config, months: DataFrame | None = None) -> DataFrame:
        """The accountant's snapshot of all months with releases, or of ``months(metric, period)``."""
        metrics = ("dau", "mau")
        return accountant.snapshot(self.releases(), self.rdp(), {m: config.cap(m) for m in metrics}, config.rdp_orders, {m: config.delta_of(m) for m in metrics}, config.advanced_delta, months)

    def backup(self, path: str) -> None:
        """A copy of every table."""
        for name, schema in (("activity", ACTIVITY), ("erasures", ERASURE), ("releases", RELEASE), ("rdp_releases", RDP_RELEASE), ("resets", RESET), ("snapshots", SNAPSHOT)):
            self._read(name, schema).write.mode("overwrite").parquet(f"{path}/{name}")

    def active(self) -> DataFrame:
        """(day, user_key) pairs active by the ordered fold, deletions by their tombstones."""
        folded = self.activity().groupBy("day", "user_key").agg(F.max_by("op", F.struct("seq", "step")).alias("op"))
        return folded.filter("op = '+'").select("day", "user_key")

"""Release plans: a table of requests in, a table of gated, noisy answers out."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import Config
from ..operators import accountant, activity, mechanisms, sketches, turnstile
from ..operators.ledger import Ledger

METRICS = ("dau", "mau")


def metric_name(metric: str) -> str:
    """The metric in lower case; an unknown one is an error."""
    if metric.lower() not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    return metric.lower()


class BudgetExceeded(Exception):
    """A release would cost more than the month has left; ``next_reset`` says when there is budget again."""

    def __init__(self, metric: str, day: dt.date):
        self.metric, self.next_reset = metric, dt.date(day.year + day.month // 12, day.month % 12 + 1, 1)
        super().__init__(f"the {metric} budget of {day:%Y-%m} is exhausted until {self.next_reset}")


def _caps(config: Config) -> dict[str, float]:
    return {m: config.cap(m) for m in ("dau", "mau")}


def requests_for(days: DataFrame, metric: str, config: Config, window_days: int | None = None) -> DataFrame:
    """One request for each day, numbered in day order by the day itself."""
    delta = config.delta_of(metric)
    window = (window_days or config.mau_window_days) if metric == "mau" else 1
    return days.select(
        F.unix_date("day").cast("long").alias("req_seq"), F.lit(metric).alias("metric"), "day", accountant.period().alias("period"),
        F.lit(window).alias("window_days"), F.lit(config.epsilon(metric)).alias("epsilon"), F.lit(delta).alias("delta"),
    )


def true_counts(rows: DataFrame, days: DataFrame, metric: str, config: Config, window_days: int | None = None) -> DataFrame:
    """(day, users) without noise; not to be published. Window counts are those of the configured sketch."""
    pairs = turnstile.active_pairs(rows)
    if metric == "mau" and config.sketch_impl == "kmv":
        return sketches.rolling_kmv(pairs, days, window_days or config.mau_window_days, config.sketch_k)
    return activity.rolling(pairs, days, 1 if metric == "dau" else window_days or config.mau_window_days)


def _spent(n: Column, metric: str, config: Config) -> Column:
    """What ``n`` releases of a metric have spent by the composition it reports."""
    epsilon, delta = config.epsilon(metric), config.delta_of(metric)
    if not delta:
        return n * epsilon
    sigma = mechanisms.gaussian_sigma(epsilon, delta, config.sensitivity)
    at = [n * (a * config.sensitivity**2 / (2 * sigma**2)) + math.log(1 / delta) / (a - 1) for a in config.rdp_orders]
    return F.least(*at) if len(at) > 1 else at[0]


def release(rows: DataFrame, metric: str, config: Config, days: DataFrame | None = None, window_days: int | None = None, parity: bool = False, debug_exact: bool = False) -> DataFrame:
    """The answers for each of ``days`` (default: the log's), in day order within the month's budget.

    (metric, day, window_days, status, estimate, lower_95, upper_95, epsilon_used, delta, mechanism, sketch_impl, budget_remaining, next_reset). A request beyond the budget
    has status ``budget_exhausted`` and no estimate. The true count is left out unless ``debug_exact``.
    """
    metric = metric_name(metric)
    days = activity.spine(rows) if days is None else days
    asked = accountant.gate(requests_for(days, metric, config, window_days), _caps(config))
    counts = true_counts(rows, days, metric, config, window_days)
    delta = config.delta_of(metric)
    noisy = mechanisms.release(asked.join(counts, "day"), metric, config.epsilon(metric), delta, config.default_seed, config.sensitivity, parity=parity)
    shown = [F.when(F.col("released"), F.col(c)).alias(c) for c in ("estimate", "lower_95", "upper_95")]
    exact = [F.col("users").alias("exact_value")] if debug_exact else []
    done = F.sum(F.col("released").cast("int")).over(Window.partitionBy("period").orderBy("req_seq").rowsBetween(Window.unboundedPreceding, 0))
    noisy = noisy.withColumn("budget_remaining", F.greatest(F.lit(0.0), F.lit(config.cap(metric)) - _spent(done, metric, config)))
    return noisy.select(
        "metric", "day", "window_days", F.when(F.col("released"), "released").otherwise("budget_exhausted").alias("status"), *shown,
        F.when(F.col("released"), F.col("epsilon")).otherwise(0.0).alias("epsilon_used"), "delta", "mechanism", F.lit(config.sketch_impl).alias("sketch_impl"), "budget_remaining", accountant.next_reset().alias("next_reset"), *exact,
    )


def releases_of(answers: DataFrame) -> DataFrame:
    """The budget log's rows for answers that were released."""
    return answers.filter("status = 'released'").select("metric", "day", accountant.period().alias("period"), F.col("epsilon_used").alias("epsilon"), "delta", "mechanism")


def budget_summary(releases: DataFrame, config: Config, months: DataFrame | None = None) -> DataFrame:
    """The accountant's snapshot of releases that aren't in a ledger; it spends nothing."""
    points = mechanisms.rdp_points(releases, config.rdp_orders, config.sensitivity)
    return accountant.snapshot(releases, points, _caps(config), config.rdp_orders, {m: config.delta_of(m) for m in METRICS}, config.advanced_delta, months)


def release_stored(ledger: Ledger, metric: str, day: dt.date, config: Config, window_days: int | None = None) -> dict:
    """One release from a ledger: pending erasures are replayed, the count is taken, the stored budget is checked, and the release is recorded.

    Daily counts use rotating keys, of which a day has one for each user; window counts use the keys that don't rotate,
    so that a user counts once whatever the window.
    """
    metric = metric_name(metric)
    ledger.refresh(ledger.replay(), config.sketch_impl, config.sketch_k)
    period, epsilon = f"{day:%Y-%m}", config.epsilon(metric)
    spent = ledger.releases(metric, period).agg(F.sum("epsilon")).first()[0] or 0.0
    if spent + epsilon > config.cap(metric) + accountant.SLACK:
        raise BudgetExceeded(metric, day)
    window = 1 if metric == "dau" else window_days or config.mau_window_days
    start = day - dt.timedelta(days=window - 1)
    if metric == "dau":
        count = ledger.spark.createDataFrame([(day, ledger.day_count(day, config))], "day date, users long")
    else:
        state = ledger.activity().filter(F.col("day").between(F.lit(start), F.lit(day))).groupBy("day", "user_key").agg(F.max_by("op", F.struct("seq", "step")).alias("op"), F.first("user_root").alias("user_root")).filter("op = '+'")
        if config.sketch_impl == "kmv":
            users = sketches.kmv_count(state.select(F.lit(1).alias("g"), sketches.key_hash(F.col("user_root")).alias("h")), ["g"], config.sketch_k).agg(F.coalesce(F.max("estimate"), F.lit(0.0)).alias("users"))
        else:
            users = state.agg(F.count_distinct("user_root").alias("users"))
        count = users.withColumn("day", F.lit(day))
    delta = config.delta_of(metric)
    noisy = mechanisms.release(count, metric, epsilon, delta, config.default_seed, config.sensitivity).first()
    released = ledger.spark.createDataFrame([(metric, day, period, epsilon, delta, noisy.mechanism)], "metric string, day date, period string, epsilon double, delta double, mechanism string")
    ledger.record_releases(released, config)
    budget = ledger.budget(config).filter((F.col("metric") == metric) & (F.col("period") == period)).first()
    return {
        "metric": metric, "day": day, "window_days": window, "estimate": noisy.estimate, "lower_95": noisy.lower_95, "upper_95": noisy.upper_95, "epsilon_used": epsilon,
        "delta": delta, "mechanism": noisy.mechanism, "sketch_impl": config.sketch_impl, "budget_remaining": budget.remaining, "budget": budget.asDict(recursive=True),
    }


def budget_report(summary: DataFrame, at: dt.datetime) -> DataFrame:
    """One row of JSON: when it was made, and each metric's months."""
    months = summary.groupBy("metric").agg(F.array_sort(F.collect_list(F.struct("period", *(c for c in summary.columns if c not in ("metric", "period")))), lambda x, y: F.when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0)).alias("months"))
    packed = months.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "months")), lambda x, y: F.when(x["metric"] < y["metric"], -1).otherwise(1))).alias("metrics"))
    return packed.select(F.to_json(F.struct(F.lit(at.isoformat()).alias("generated_at"), "metrics")).alias("report"))

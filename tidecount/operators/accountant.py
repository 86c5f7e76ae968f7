"""Privacy budgets by metric and month: spending, gating, and naive, advanced and Rényi composition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONTH = ["metric", "period"]
SLACK = 1e-9


def period(day: str = "day") -> Column:
    return F.date_format(day, "yyyy-MM")


def next_reset(day: str = "day") -> Column:
    return F.add_months(F.trunc(day, "MM"), 1)


def caps(table: DataFrame, cap: dict[str, float]) -> Column:
    """The cap of each row's metric; an unknown metric is an error."""
    known = F.create_map(*(F.lit(x) for pair in cap.items() for x in pair))
    return F.coalesce(F.element_at(known, F.lower("metric")), F.raise_error(F.concat(F.lit("unknown metric "), F.col("metric"))).cast("double"))


def spent(releases: DataFrame, cap: dict[str, float]) -> DataFrame:
    """(metric, period, spent, releases, remaining): the naive sum."""
    sums = releases.groupBy(*MONTH).agg(F.sum("epsilon").alias("spent"), F.count(F.lit(1)).alias("releases"))
    return sums.withColumn("remaining", F.greatest(F.lit(0.0), caps(sums, cap) - F.col("spent")))


def gate(requests: DataFrame, cap: dict[str, float]) -> DataFrame:
    """``requests`` with ``spent_before`` and ``released``, where all requests of a metric cost the same.

    The running cost then decides: once a request doesn't fit, no later one does.
    """
    order = Window.partitionBy(*MONTH).orderBy("req_seq").rowsBetween(Window.unboundedPreceding, 0)
    total = requests.withColumn("total", F.sum("epsilon").over(order))
    return total.withColumn("released", F.col("total") <= caps(requests, cap) + SLACK).drop("total")


def gate_varying(requests: DataFrame, cap: dict[str, float]) -> DataFrame:
    """As ``gate`` for any costs: a refused request costs nothing, so a later, cheaper one may pass. One fold for each month's requests."""
    ordered = F.array_sort(F.collect_list(F.struct("req_seq", "epsilon")))
    limit = F.col("cap") + SLACK
    fold = F.aggregate(
        "r", F.struct(F.lit(0.0).alias("spent"), F.array().cast("array<bigint>").alias("ok")),
        lambda a, x: F.struct(F.when(a["spent"] + x["epsilon"] <= limit, a["spent"] + x["epsilon"]).otherwise(a["spent"]).alias("spent"), F.when(a["spent"] + x["epsilon"] <= limit, F.array_append(a["ok"], x["req_seq"].cast("bigint"))).otherwise(a["ok"]).alias("ok")),
        lambda a: a["ok"],
    )
    passed = requests.groupBy(*MONTH).agg(ordered.alias("r")).withColumn("cap", caps(requests, cap)).select(*MONTH, F.explode(fold).alias("req_seq"), F.lit(True).alias("passed"))
    return requests.join(passed, [*MONTH, "req_seq"], "left").withColumn("released", F.coalesce("passed", F.lit(False))).drop("passed")


def rdp_totals(points: DataFrame, orders: tuple[float, ...]) -> DataFrame:
    """(metric, period, alpha, rdp) summed over the month, every order present."""
    months = points.select(*MONTH).distinct()
    every = months.withColumn("alpha", F.explode(F.array(*(F.lit(float(a)) for a in orders))))
    sums = points.groupBy(*MONTH, "alpha").agg(F.sum("rdp").alias("rdp"))
    return every.join(sums, [*MONTH, "alpha"], "left").fillna(0.0, ["rdp"])


def rdp_epsilon(totals: DataFrame, delta: float) -> DataFrame:
    """(metric, period, rdp_epsilon, best_alpha): the best conversion over all orders."""
    if not 0 < delta < 1:
        raise ValueError("delta must lie in (0, 1)")
    converted = totals.withColumn("e", F.col("rdp") + math.log(1 / delta) / (F.col("alpha") - 1))
    return converted.groupBy(*MONTH).agg(F.min("e").alias("rdp_epsilon"), F.min_by("alpha", F.struct("e", "alpha")).alias("best_alpha"))


def advanced(releases: DataFrame, slack_delta: float) -> DataFrame:
    """(metric, period, advanced_epsilon, advanced_delta) by advanced composition."""
    if not 0 < slack_delta < 1:
        raise ValueError("the slack delta must lie in (0, 1)")
    sums = releases.groupBy(*MONTH).agg(F.sum(F.col("epsilon") * F.col("epsilon")).alias("squares"), F.sum(F.col("epsilon") * F.expm1("epsilon")).alias("linear"), F.sum("delta").alias("delta"))
    return sums.select(*MONTH, (F.sqrt(2 * math.log(1 / slack_delta) * F.col("squares")) + F.col("linear")).alias("advanced_epsilon"), (F.col("delta") + slack_delta).alias("advanced_delta"))


def day_epsilon(releases: DataFrame) -> DataFrame:
    return releases.groupBy("metric", "day").agg(F.sum("epsilon").alias("epsilon"))


def _private(releases: DataFrame, keys: list[str]) -> DataFrame:
    """Naive sums by ``keys``, with the delta that says whether Rényi points count."""
    return releases.groupBy(*keys).agg(F.sum("epsilon").alias("naive"), F.max("delta").alias("delta"))


def _converted(points: DataFrame, keys: list[str], delta: float) -> DataFrame:
    sums = points.groupBy(*keys, "alpha").agg(F.sum("rdp").alias("rdp"))
    return sums.groupBy(*keys).agg(F.min(F.col("rdp") + math.log(1 / delta) / (F.col("alpha") - 1)).alias("rdp_epsilon"))


def reported(releases: DataFrame, points: DataFrame, delta: float, keys: tuple[str, ...] = ("metric", "period")) -> DataFrame:
    """(keys..., epsilon): what was spent by month, or by day, as the Rényi bound where releases have a delta, else as the naive sum."""
    if not 0 < delta < 1:
        raise ValueError("delta must lie in (0, 1)")
    by = list(keys)
    both = _private(releases, by).join(_converted(points, by, delta), by, "left")
    return both.select(*by, F.when(F.col("delta") > 0, F.coalesce("rdp_epsilon", "naive")).otherwise(F.col("naive")).alias("epsilon"))


def snapshot(releases: DataFrame, points: DataFrame, cap: dict[str, float], orders: tuple[float, ...], delta: dict[str, float], slack_delta: float, months: DataFrame | None = None) -> DataFrame:
    """One row for each metric and month of ``releases``, or of ``months(metric, period)``, which may lie unused.

    ``spent`` is the naive sum; ``epsilon_spent`` and ``remaining`` go by the composition that the metric reports: the best Rényi
    conversion where its ``delta`` is above 0, else the sum. A month without releases has a curve of zeros, so its best conversion is not 0.
    """
    by = ["metric", "period"]
    every = (releases if months is None else months).select(*by).distinct()
    curve = every.withColumn("alpha", F.explode(F.array(*(F.lit(float(a)) for a in orders)))).join(points.groupBy(*by, "alpha").agg(F.sum("rdp").alias("rdp")), [*by, "alpha"], "left").fillna(0.0, ["rdp"])
    of = F.element_at(F.create_map(*(F.lit(x) for pair in delta.items() for x in pair)), F.lower("metric"))
    curve = curve.withColumn("delta", of).withColumn("e", F.when(F.col("delta") > 0, F.col("rdp") + F.log(1 / F.col("delta")) / (F.col("alpha") - 1)))
    best = curve.groupBy(*by).agg(
        F.max("delta").alias("delta"), F.min("e").alias("rdp_epsilon"), F.min_by(F.when(F.col("e").isNotNull(), F.col("alpha")), F.struct(F.col("e").isNull(), "e", "alpha")).alias("best_alpha"),
        F.array_sort(F.collect_list(F.struct("alpha", "rdp"))).alias("curve"),
    )
    rows = best.join(releases.groupBy(*by).agg(F.sum("epsilon").alias("spent"), F.count(F.lit(1)).alias("releases")), by, "left").fillna(0, ["spent", "releases"]).join(advanced(releases, slack_delta), by, "left")
    private = F.col("rdp_epsilon").isNotNull()
    rows = rows.withColumn("cap", caps(rows, cap)).withColumn("epsilon_spent", F.when(private, F.col("rdp_epsilon")).otherwise(F.col("spent")))
    return rows.select(
        *by, "cap", "spent", "epsilon_spent", F.greatest(F.lit(0.0), F.col("cap") - F.col("epsilon_spent")).alias("remaining"), "delta", "releases", "rdp_epsilon", "best_alpha",
        F.map_from_entries("curve").alias("rdp_curve"), F.transform("curve", lambda c: c["alpha"]).alias("rdp_orders"), "advanced_epsilon", "advanced_delta", F.when(private, "rdp").otherwise("naive").alias("composition"),
        F.when(private, "Rényi points of the month, converted at the best order").otherwise("delta is 0, so epsilons are added").alias("notes"),
    )

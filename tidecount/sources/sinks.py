"""Writers of event files and of the append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _metadata(rows: DataFrame) -> DataFrame:
    days = F.when(F.size("days") > 0, F.transform("days", lambda d: F.date_format(d, "yyyy-MM-dd")))
    return rows.withColumn("d", days).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    _metadata(rows).select("seq", "user_id", "op", "day", F.struct(F.col("d").alias("days")).alias("metadata")).write.json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Lists as JSON, absent values empty; a map column ``metadata`` gives one column for each key of any row, in order."""
    out = _metadata(rows).withColumn("metadata.days", F.to_json("d"))
    keys = [k for k in metadata_keys(rows) if k != "days"] if "metadata" in rows.columns else []
    columns = sorted([("days", F.col("`metadata.days`")), *((k, F.element_at("metadata", k)) for k in keys)], key=lambda c: c[0])
    out.select("seq", "user_id", "op", "day", *(c.alias(f"metadata.{k}") for k, c in columns)).write.option("header", True).option("escape", '"').csv(path)


MOST_KEYS = 1000


def metadata_keys(rows: DataFrame, column: str = "metadata") -> list[str]:
    """The keys of a map column over all rows, in order; columns of a file, so their number is checked."""
    keys = [r[0] for r in rows.select(F.explode(F.map_keys(column)).alias("k")).distinct().orderBy("k").limit(MOST_KEYS + 1).collect()]
    if len(keys) > MOST_KEYS:
        raise ValueError(f"over {MOST_KEYS} metadata keys")
    return keys


def flatten_metadata(rows: DataFrame, column: str = "metadata") -> DataFrame:
    """A map column as one column ``metadata.<key>`` for each key of any row, sorted by key."""
    rest = [F.col(c) for c in rows.columns if c != column]
    return rows.select(*rest, *(F.element_at(column, k).alias(f"{column}.{k}") for k in metadata_keys(rows, column)))


def append(rows: DataFrame, path: str, *partitions: str) -> None:
    rows.write.mode("append").partitionBy(*partitions).parquet(path)


def overwrite_partitions(rows: DataFrame, path: str, *partitions: str) -> None:
    """Replaces just the partitions that ``rows`` touches."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def current(log: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The newest row for each key of an append-only status log."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(key, "r.*")


def after_reset(log: DataFrame, resets: DataFrame) -> DataFrame:
    """The rows of a release log above the newest reset mark (metric, period, id) of their month."""
    marks = resets.groupBy("metric", "period").agg(F.max("id").alias("mark"))
    return log.join(marks, ["metric", "period"], "left").filter("mark IS NULL OR id > mark").drop("mark")


def numbered(rows: DataFrame, start: int, *order: str) -> DataFrame:
    """``id`` from ``start`` on, in order, for small logs with a single writer."""
    return rows.withColumn("id", F.row_number().over(Window.orderBy(*order)) + F.lit(start - 1).cast("long"))

"""Turnstile events from JSON lines, CSV, request envelopes and the driver's event table.

A turnstile row is (seq, user_id, day, op, days): ``seq`` is the arrival order, which a file's rows must carry themselves, as a
distributed table has none; ``days`` names the days a deletion covers besides its own, empty for "all known days".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import ENVELOPE

COLUMNS = ("seq", "user_id", "day", "op", "days")
NO_DAYS = "cast(array() AS array<date>)"


def _days(json: Column) -> Column:
    """The days of a JSON list, null and invalid lists as none."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def _checked(rows: DataFrame, *more: str, metadata: Column | None = None) -> DataFrame:
    """Fails on an unknown op or a malformed day."""
    rows = rows.withColumn("metadata", metadata) if more else rows
    op = F.when(F.col("op").isin("+", "-"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("op must be + or -: "), F.coalesce("op", F.lit("null")))))
    day = F.coalesce(F.try_to_date("day", "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.expr("try_to_timestamp(day, 'yyyy-MM-dd')").cast("date"), F.raise_error(F.concat(F.lit("malformed day: "), F.coalesce("day", F.lit("null")))).cast("date"))
    return rows.select("seq", F.col("user_id"), day.alias("day"), op.alias("op"), F.transform("days", lambda d: F.to_date(d, "yyyy-MM-dd")).alias("days"), *more)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with user_id, op, day, seq and an optional object ``metadata``; a line that doesn't parse fails the read."""
    schema = "seq long, user_id string, op string, day string, metadata string"
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return _checked(rows.withColumn("days", _days(F.get_json_object("metadata", "$.days"))))


def read_csv(spark: SparkSession, path: str, keep: bool = False) -> DataFrame:
    """CSV with a header; columns ``metadata.<key>`` hold metadata, lists as JSON, empty for absent. All columns are read as text.

    ``keep`` adds the metadata but ``days`` as a map ``metadata`` without empty values.
    """
    rows = spark.read.option("header", True).option("mode", "FAILFAST").option("escape", '"').csv(path).withColumn("seq", F.col("seq").cast("long"))
    keys = [c.removeprefix("metadata.") for c in rows.columns if c.startswith("metadata.")]
    listed = F.col("`metadata.days`") if "days" in keys else F.lit(None).cast("string")
    out = _checked(rows.withColumn("days", _days(listed)), *(["metadata"] if keep else []), metadata=metadata_map({k: F.col(f"`metadata.{k}`") for k in keys if k != "days"}))
    return out


def read_events(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """By ``kind`` (csv, jsonl) or else by the path's ending."""
    kind = kind or path.rstrip("/").rpartition(".")[2].lower()
    readers = {"csv": read_csv, "jsonl": read_jsonl, "json": read_jsonl, "ndjson": read_jsonl}
    if kind not in readers:
        raise ValueError(f"no reader for {kind!r}; known: {', '.join(sorted(readers))}")
    return readers[kind](spark, path)


def metadata_map(columns: dict[str, Column]) -> Column:
    """Columns as one map, without null and empty values."""
    if not columns:
        return F.create_map().cast("map<string,string>")
    pairs = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(c.cast("string") for c in columns.values())))
    return F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != ""))


def open_envelopes(bodies: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """(events, rejected): the events of JSON bodies ``{"event": E}`` or ``{"events": [E, ...]}``.

    A body with neither, both, an empty list, or an event with an unknown op or malformed day is rejected as a whole. ``bodies``
    carries ``seq``; events of one body follow each other in (seq, place).
    """
    parsed = bodies.withColumn("e", F.from_json(column, ENVELOPE))
    listed = parsed.withColumn("list", F.coalesce("e.events", F.when(F.col("e.event").isNotNull(), F.array("e.event"))))
    one = (F.col("e.event").isNotNull().cast("int") + F.col("e.events").isNotNull().cast("int")) == 1
    good = F.forall("list", lambda x: x["user_id"].isNotNull() & x["op"].rlike(r"^[+\-]$") & x["day"].rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(x["day"], F.lit("yyyy-MM-dd")).isNotNull())
    marked = listed.withColumn("ok", F.coalesce(one & (F.size("list") > 0) & good, F.lit(False)))
    opened = marked.filter("ok").select("seq", F.posexplode("list").alias("place", "x"))
    events = opened.select("seq", "place", "x.user_id", F.to_date("x.day", "yyyy-MM-dd").alias("day"), "x.op", F.transform(_days(F.get_json_object("x.metadata", "$.days")), lambda d: F.to_date(d)).alias("days"))
    return events, marked.filter("NOT ok").select(*bodies.columns)


def turnstile(events: DataFrame) -> DataFrame:
    """The driver's event table as turnstile rows: an error of value over 60 deletes, with an even k for the two days before only."""
    day = F.col("ts").cast("date")
    gone = F.coalesce((F.col("event_type") == "error") & (F.col("value") > 60), F.lit(False))
    listed = gone & (F.get_json_object("props", "$.k").cast("int") % 2 == 0)
    return events.select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("user_id"), day.alias("day"), F.when(gone, "-").otherwise("+").alias("op"),
        F.when(listed, F.array(F.date_sub(day, 1), F.date_sub(day, 2))).otherwise(F.expr(NO_DAYS)).alias("days"),
    )

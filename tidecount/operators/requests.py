"""Service metrics over a request log: totals, server errors, cumulative latency histograms, request rates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
LIMIT, SPAN_S = 600, 60


def totals(log: DataFrame) -> DataFrame:
    return log.groupBy("handler", "method", "status").agg(F.count(F.lit(1)).alias("requests"))


def server_errors(log: DataFrame) -> DataFrame:
    """(handler, method, errors), 0 where there were none."""
    return log.groupBy("handler", "method").agg(F.sum(F.col("status").between(500, 599).cast("long")).alias("errors"))


def latency_histogram(log: DataFrame, buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(handler, method, le, requests): requests of at most ``le`` seconds; the last bucket, +Inf, holds all."""
    counts = [F.struct(F.lit(str(b)).alias("le"), F.sum((F.col("duration_s") <= b).cast("long")).alias("requests")) for b in buckets]
    every = F.array(*counts, F.struct(F.lit("+Inf").alias("le"), F.count(F.lit(1)).alias("requests")))
    return log.groupBy("handler", "method").agg(every.alias("b")).select("handler", "method", F.explode("b").alias("b")).select("handler", "method", "b.*")


def latency_sums(log: DataFrame) -> DataFrame:
    return log.groupBy("handler", "method").agg(F.sum("duration_s").alias("seconds"), F.count(F.lit(1)).alias("requests"))


def client_key(api_key: Column, forwarded: Column, host: Column) -> Column:
    """Whom a request counts for: the first eight characters of its API key, else the first forwarded address, else the host."""
    return F.when(api_key != "", F.concat(F.lit("key:"), F.substring(api_key, 1, 8))).when(forwarded != "", F.concat(F.lit("ip:"), F.trim(F.split(forwarded, ",")[0]))).otherwise(F.coalesce(F.concat(F.lit("ip:"), host), F.lit("unknown")))


def request_rate(log: DataFrame, span_s: int = SPAN_S) -> DataFrame:
    """``log`` with ``recent``: the client's requests in the last ``span_s`` seconds, this one included."""
    order = Window.partitionBy("client").orderBy(F.unix_timestamp("ts")).rangeBetween(-(span_s - 1), 0)
    return log.withColumn("recent", F.count(F.lit(1)).over(order))


def rate_limit(log: DataFrame, limit: int = LIMIT, span_s: int = SPAN_S) -> DataFrame:
    """``client, ts, allowed`` in time order for each client; refused requests don't count towards the limit.

    Whether a request counts depends on those before it, so each client's requests pass through one fold that holds the last ``limit``
    accepted times; rows stream through it in order and are never gathered.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import deque

        client, recent = None, deque()
        for batch in batches:
            allowed = []
            for who, at in zip(batch["client"], batch["t"], strict=True):
                if who != client:
                    client, recent = who, deque()
                while recent and recent[0] <= at - span_s:
                    recent.popleft()
                allowed.append(len(recent) < limit)
                if allowed[-1]:
                    recent.append(at)
            yield pd.DataFrame({"client": batch["client"], "ts": batch["ts"], "allowed": allowed})

    rows = log.select("client", "ts", F.unix_micros("ts").alias("u")).withColumn("t", F.col("u") / 1e6)
    return rows.repartition("client").sortWithinPartitions("client", "u").mapInPandas(fold, "client string, ts timestamp, allowed boolean")

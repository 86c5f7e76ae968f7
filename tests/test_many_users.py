"""Queries on sketches against their SQL, with more users than one sketch holds."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_queries import QUERIES, SQL, tidy
from tidecount.operators import sketches


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """10,000 users: some of the first half of the month only, some of its end only, some of both, and a last day of 9,000; every 50th event deletes."""
    folder = tmp_path_factory.mktemp("crowd")
    user, again = F.col("id") % 10_000, F.floor(F.col("id") / 10_000)
    day = F.when(again == 2, 29).when((again == 1) & (user % 3 == 0), user % 5 + 20).otherwise(user % 15)
    kept = spark.range(30_000).filter((again < 2) | (user >= 1_000))
    gone = F.col("id") % 50 == 7
    kept.select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1704067200 + day * 86400 + F.col("id") % 80_000).cast("timestamp_ntz").alias("ts"), user.alias("user_id"),
        F.when(gone, "error").otherwise("view").alias("event_type"), F.when(gone, 70.0).otherwise(5.0).alias("value"), F.format_string('{"k": %d}', F.col("id") % 4).alias("props"),
    ).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["release_sweep", "sweep_results", "theta_a_not_b", "sketch_kmv_day", "theta_day", "theta_mau"])
def test_matches_sql_beyond_one_sketch(spark, crowd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{crowd}/events.parquet/*.parquet'")
    assert con.execute("SELECT count(DISTINCT user_id) FROM events").fetchone()[0] > 2 * 4096
    assert tidy(QUERIES[name](spark, crowd).toPandas()) == tidy(con.execute(SQL[name]).df())


def test_shards(spark):
    rows = spark.range(10_000).selectExpr("CAST(id AS STRING) AS user_id", "DATE '2024-01-01' AS day")
    assert sketches.shard_count(rows, "theta") == 5 and sketches.shard_count(rows.limit(0), "theta") == 1
    for name in ("set", "kmv", "theta"):
        assert sketches.merged(sketches.daily_sketches(rows.union(rows), name, shards=5)).collect() == [(10_000.0,)]
    with pytest.raises(ValueError, match="hll"):
        sketches.shard_count(rows, "hll")


def test_theta_without_rows(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["theta_day"](spark, str(tmp_path)).collect() == []
    assert QUERIES["theta_mau"](spark, str(tmp_path)).collect() == [(0.0,)]
    assert QUERIES["theta_a_not_b"](spark, str(tmp_path)).collect() == [(0, 0)]

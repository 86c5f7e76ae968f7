"""The sweep's results file against its SQL where a count is empty or a user unknown."""

import duckdb
import pytest

from tests.test_queries import QUERIES, SQL, tidy

GONE = ("event_id", "ts", "user_id", "'error' AS event_type", "70.0D AS value", """'{"k": 1}' AS props""")
LATER = ("event_id", "ts + INTERVAL 90 DAYS AS ts", *GONE[2:])
ODD = {
    "nobody_left": lambda events: events.selectExpr(*GONE),
    "nobody_in_window": lambda events: events.filter("ts < '2024-01-30'").union(events.filter("ts >= '2024-01-30'").selectExpr(*LATER)),
    "null_users": lambda events: events.selectExpr("event_id", "ts", "if(user_id % 5 = 0, NULL, user_id) AS user_id", "event_type", "value", "props"),
    "no_rows": lambda events: events.limit(0),
}


@pytest.mark.parametrize("case", ODD)
def test_matches_sql(spark, sf, tmp_path, case):
    ODD[case](spark.read.parquet(f"{sf}/events.parquet")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(SQL["sweep_results"]).df()
    assert len(want) == (0 if case == "no_rows" else 4)
    assert tidy(QUERIES["sweep_results"](spark, str(tmp_path)).toPandas()) == tidy(want)

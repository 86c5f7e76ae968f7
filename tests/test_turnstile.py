"""Turnstile semantics against a sequential replay."""

import datetime as dt
import random

import pytest

from tidecount.operators import activity, turnstile

D = dt.date(2025, 10, 1)
SCHEMA = "seq long, user_id string, day date, op string, days array<date>"


def day(k):
    return D + dt.timedelta(days=k)


def table(spark, rows):
    return spark.createDataFrame([(i + 1, u, day(d), op, [day(x) for x in days]) for i, (u, d, op, days) in enumerate(rows)], SCHEMA)


def replay(rows):
    """The log row by row: state and what is known."""
    active, known, gone = set(), {}, []
    for u, d, op, days in rows:
        own = known.setdefault(u, set())
        own.add(d)
        if op == "+":
            active.add((u, d))
            continue
        hit = ({d} | set(days)) if days else set(own)
        own |= hit
        gone.append((u, frozenset(hit)))
        active -= {(u, x) for x in hit}
    return active, gone


CASES = {
    "plus": [("a", 0, "+", []), ("a", 1, "+", [])],
    "plus minus plus": [("a", 0, "+", []), ("a", 0, "-", []), ("a", 0, "+", [])],
    "retroactive": [("a", 0, "+", []), ("a", 1, "+", []), ("a", 1, "-", [0, 1])],
    "later day known": [("a", 5, "+", []), ("a", 1, "-", [])],
    "unseen user": [("a", 0, "+", []), ("b", 1, "-", [])],
    "only a deletion": [("a", 0, "-", [])],
    "listed day becomes known": [("a", 0, "-", [3]), ("a", 1, "-", []), ("a", 3, "+", [])],
    "empty": [],
}


def check(spark, rows):
    t = table(spark, rows)
    active, gone = replay(rows)
    assert {(r.user_id, (r.day - D).days) for r in turnstile.active_pairs(t).collect()} == active
    assert {(r.user_id, (r.day - D).days) for r in turnstile.day_fold(turnstile.expanded_log(t)).collect()} == active
    got = sorted((r.user_id, sorted((x - D).days for x in r.days)) for r in turnstile.erasures(t).collect())
    assert got == sorted((u, sorted(s)) for u, s in gone)


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    check(spark, CASES[name])


@pytest.mark.parametrize("seed", range(6))
def test_random_logs(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("abcd"), r.randrange(6), r.choice("++-"), r.sample(range(6), r.randrange(3)) if r.random() < 0.5 else []) for _ in range(40)]
    check(spark, [(u, d, op, days if op == "-" else []) for u, d, op, days in rows])


@pytest.mark.parametrize("window", [1, 3, 7, 30])
def test_rolling(spark, window):
    r = random.Random(window)
    pairs = sorted({(r.choice("abcdefg"), r.randrange(25)) for _ in range(60)})
    df = spark.createDataFrame([(u, day(d)) for u, d in pairs], "user_id string, day date")
    got = {(x.day - D).days: x.users for x in activity.rolling(df, activity.spine(df), window).collect()}
    low, high = min(d for _, d in pairs), max(d for _, d in pairs)
    assert got == {e: len({u for u, d in pairs if e - window < d <= e}) for e in range(low, high + 1)}


def test_empty_log(spark):
    t = table(spark, [])
    pairs = turnstile.active_pairs(t)
    assert activity.daily_filled(pairs, t).count() == 0
    assert activity.rolling(pairs, activity.spine(t), 30).count() == 0
    assert activity.window_count(pairs, "2025-10-01", 30).first().users == 0


def test_zero_fill_counts_every_day(spark, tmp_path):
    """From Friday to Tuesday, without events on Sunday."""
    from tidecount.plans import queries

    at = [dt.datetime(2025, 10, d, 9) for d in (3, 4, 4, 6, 7)]
    rows = [(i, t, u, "view", 1.0, "{}") for i, (t, u) in enumerate(zip(at, (1, 1, 2, 1, 2), strict=True))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.day.day: r.users for r in queries.queries()["dau_zero_fill"](spark, str(tmp_path)).collect()} == {3: 1, 4: 2, 5: 0, 6: 1, 7: 1}


def test_registered_workloads_have_their_full_size(spark):
    from tidecount.plans import queries

    made = queries.queries()
    assert made["simulated_workload"](spark, "").count() == 60 and made["adversarial_workload"](spark, "").select("user_id").distinct().count() == 500


def test_flips(spark):
    rows = [("a", 0, "+", []), ("a", 0, "-", []), ("a", 0, "+", []), ("b", 0, "+", []), ("b", 0, "+", []), ("c", 0, "-", [])]
    assert {r.user_id: r.flips for r in turnstile.flips(table(spark, rows)).collect()} == {"a": 3, "b": 1, "c": 0}

"""Sources, pseudonyms, sketches, mechanisms, budgets, ledger, streams and the command line."""

import datetime as dt
import hashlib
import hmac
import math
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidecount.functions import noise, pseudonym
from tidecount.functions.config import Config
from tidecount.operators import accountant, mechanisms, requests, sketches
from tidecount.operators.ledger import Ledger
from tidecount.plans import release
from tidecount.sources import events, sinks

C = Config(hash_salt_secret="s")


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_jsonl_and_csv(spark, tmp_path):
    j = write(tmp_path, "a.jsonl", '{"seq":1,"user_id":"007","op":"+","day":"2025-10-01"}\n{"seq":2,"user_id":"é","op":"-","day":"2025-10-02","metadata":{"days":["2025-10-01"]}}\n')
    c = write(tmp_path, "a.csv", 'seq,user_id,op,day,metadata.days\n1,007,+,2025-10-01,\n2,é,-,2025-10-02,"[""2025-10-01""]"\n')
    want = [(1, "007", dt.date(2025, 10, 1), "+", []), (2, "é", dt.date(2025, 10, 2), "-", [dt.date(2025, 10, 1)])]
    for path in (j, c):
        assert [tuple(r) for r in events.read_events(spark, path).orderBy("seq").collect()] == want
    with pytest.raises(ValueError):
        events.read_events(spark, "x.xml")


@pytest.mark.parametrize("line", ['{"seq":1,"user_id":"a","op":"*","day":"2025-10-01"}', '{"seq":1,"user_id":"a","op":"+","day":"yesterday"}', '{"seq":1,"user_id"'])
def test_bad_lines_fail(spark, tmp_path, line):
    path = write(tmp_path, "b.jsonl", line + "\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        events.read_events(spark, path).collect()


def test_envelopes(spark):
    e = '{"user_id":"a","op":"+","day":"2025-10-01"}'
    bodies = [f'{{"event":{e}}}', f'{{"events":[{e},{e}]}}', f'{{"event":{e},"events":[{e}]}}', '{"events":[]}', "{}", "no", '{"event":{"user_id":"a","op":"x","day":"2025-10-01"}}', '{"event":{"user_id":"a","op":"+","day":"2025-13-01"}}', None]
    good, bad = events.open_envelopes(spark.createDataFrame(list(enumerate(bodies)), "seq long, body string"))
    assert sorted((r.seq, r.place) for r in good.collect()) == [(0, 0), (1, 0), (1, 1)]
    assert sorted(r.seq for r in bad.collect()) == [2, 3, 4, 5, 6, 7, 8]


def test_metadata_map(spark):
    row = spark.range(1).select(events.metadata_map({"a": F.lit("x"), "b": F.lit(""), "c": F.lit(None)}).alias("m")).first()
    assert row.m == {"a": "x"}


def test_hmac_and_epochs(spark):
    rows = [("alice", dt.date(2025, 10, 1)), ("alice", dt.date(2025, 10, 7)), ("zoë", dt.date(2025, 10, 1)), ("alice", dt.date(2025, 10, 2))]
    got = {(r.user_id, r.day): (r.epoch, r.user_key) for r in pseudonym.with_user_key(spark.createDataFrame(rows, "user_id string, day date"), "b64:c2VjcmV0", 30).collect()}
    for (user, day), (epoch, key) in got.items():
        assert epoch == day.toordinal() // 30
        salt = hmac.new(b"secret", f"epoch::{epoch}".encode(), hashlib.sha256).digest()
        assert key == hmac.new(salt, user.encode(), hashlib.sha256).hexdigest()
    keys = {d: k for (u, d), (_, k) in got.items() if u == "alice"}
    assert keys[rows[0][1]] == keys[rows[3][1]] != keys[rows[1][1]]  # the epoch turns on 10-06
    root = spark.range(1).select(pseudonym.user_root(F.lit("a"), "k" * 100).alias("r")).first().r
    assert root == hmac.new(b"k" * 100, b"a", hashlib.sha256).hexdigest()
    assert pseudonym.mint_secret().startswith("b64:") and len(pseudonym.secret_bytes(pseudonym.mint_secret())) == 32


def test_config():
    assert Config.from_env({"HASH_SALT_SECRET": "x", "EPSILON_DAU": "{{EPSILON_DAU}}", "RDP_ORDERS": "[1, 2, 4]", "AUTOSCALE": "yes"}).rdp_orders == (2.0, 4.0)
    with pytest.raises(ValueError):
        Config.from_env({})
    for bad in ({"w_bound": 0}, {"sketch_impl": "x"}, {"epsilon_dau": 0}, {"delta": 1.0}, {"sketch_k": 0}):
        with pytest.raises(ValueError):
            Config(**bad)
    assert Config(autoscale=True).cap("dau") == pytest.approx(9.3) and Config(autoscale=True).cap("mau") == 15.5 and Config().cap("dau") == 3.0


@pytest.mark.parametrize(("n", "k"), [(10, 32), (31, 32), (32, 32), (33, 32), (5000, 512)])
def test_kmv(spark, n, k):
    rows = spark.range(n).select(F.lit(1).alias("g"), sketches.key_hash(F.col("id").cast("string")).alias("h"))
    got = sketches.kmv_count(rows.union(rows), ["g"], k).first().estimate
    hashes = sorted(int(hashlib.sha256(str(i).encode()).hexdigest()[:16], 16) for i in range(n))
    want = n if n < k else (k - 1) / (hashes[k - 1] / (2**64 - 1))
    assert got == pytest.approx(want, rel=1e-9)
    assert n < k or abs(got - n) / n < 0.25 or n < 100


def test_kmv_difference_is_scaled(spark):
    a = spark.range(0, 20_000).select(sketches.key_hash(F.col("id").cast("string")).alias("h"))
    b = spark.range(10_000, 30_000).select(sketches.key_hash(F.col("id").cast("string")).alias("h"))
    assert sketches.kmv_difference(a, b, 1024).first().estimate == pytest.approx(10_000, rel=0.15)
    small = spark.range(0, 20).select(sketches.key_hash(F.col("id").cast("string")).alias("h"))
    assert sketches.kmv_difference(small, a.limit(0), 1024).first().estimate == 20


def test_backends(spark):
    pairs = spark.range(600).select(F.col("id").cast("string").alias("user_id"), F.expr("date_add(DATE'2025-01-01', cast(id % 3 as int))").alias("day"))
    for name in ("set", "kmv", "theta", "hll"):
        assert sketches.merged(sketches.daily_sketches(pairs, name)).first().estimate == pytest.approx(600, rel=0.05), name
    with pytest.raises(KeyError):
        sketches.backend("nope")
    with pytest.raises(TypeError):
        sketches.merged(sketches.daily_sketches(pairs, "set").select("sketch_impl", "day", F.lit(b"x").alias("sketch")).union(sketches.daily_sketches(pairs, "hll").select("sketch_impl", "day", "sketch")))
    hashes = ["00" * 8, "ff" * 8]
    assert sketches.unpack(sketches.pack(hashes, 4)) == hashes and sketches.unpack(sketches.pack(hashes, 4), 1) == hashes[:1]
    with pytest.raises(ValueError):
        sketches.unpack(b"short")


def test_blake2b(spark):
    got = spark.createDataFrame([("a",)], "k string").select(sketches.key_hash_blake2b(b"other")("k").alias("h")).first().h
    assert got == hashlib.blake2b(b"a", digest_size=8, person=b"other").hexdigest()


def test_golden_noise(spark):
    day = spark.createDataFrame([(dt.date(2025, 10, 1), 0.0)], "day date, users double")
    assert day.select(noise.noise_seed("dau", F.col("day"), 20251009).alias("s")).first().s == 8503648477579216544
    assert mechanisms.release(day, "dau", 0.3, 0.0, 20251009, parity=True).first().estimate == pytest.approx(4.001175263090454)
    assert mechanisms.release(day, "mau", 0.5, 1e-6, 20251009, parity=True).first().estimate == pytest.approx(2.425526607882577)


def test_native_noise_statistics(spark):
    days = spark.range(4000).select(F.date_add(F.lit(dt.date(1990, 1, 1)), F.col("id").cast("int")).alias("day"), F.lit(0.0).alias("users"))
    for epsilon, delta, sd in ((0.3, 0.0, math.sqrt(2) / 0.3), (0.5, 1e-6, mechanisms.gaussian_sigma(0.5, 1e-6))):
        row = mechanisms.release(days, "x", epsilon, delta, 1).agg(F.avg("estimate").alias("m"), F.stddev("estimate").alias("s"), F.avg((F.lit(0.0).between(F.col("lower_95"), F.col("upper_95"))).cast("double")).alias("c")).first()
        assert abs(row.m) < 4 * sd / math.sqrt(4000) and row.s == pytest.approx(sd, rel=0.06) and row.c == pytest.approx(0.95 if delta else 0.975, abs=0.015)
    assert mechanisms.laplace_half_width(mechanisms.laplace_scale(0.3)) == pytest.approx(12.296, abs=0.01)
    for bad in (lambda: mechanisms.laplace_scale(0), lambda: mechanisms.gaussian_sigma(1, 1), lambda: mechanisms.gaussian_sigma(1, 0)):
        with pytest.raises(ValueError):
            bad()


def test_varying_gate(spark):
    rows = [(i + 1, "dau", "2025-10", e) for i, e in enumerate((0.3, 0.5, 0.4, 0.2, 0.1))]
    out = accountant.gate_varying(spark.createDataFrame(rows, "req_seq long, metric string, period string, epsilon double"), {"dau": 1.0})
    assert sorted(r.req_seq for r in out.filter("released").collect()) == [1, 2, 4]
    with pytest.raises(PySparkException):
        accountant.gate(spark.createDataFrame([(1, "x", "2025-10", 0.1)], "req_seq long, metric string, period string, epsilon double"), {"dau": 1.0}).collect()


def test_accounting(spark):
    rel = spark.createDataFrame([("dau", dt.date(2025, 10, d), "2025-10", 0.2, 0.0) for d in (1, 2, 3)], "metric string, day date, period string, epsilon double, delta double")
    row = accountant.spent(rel, {"dau": 1.0}).first()
    assert row.spent == pytest.approx(0.6) and row.releases == 3 and row.remaining == pytest.approx(0.4)
    adv = accountant.advanced(rel, 1e-7).first()
    assert adv.advanced_epsilon == pytest.approx(math.sqrt(2 * math.log(1e7) * 0.12) + 3 * 0.2 * math.expm1(0.2))
    totals = accountant.rdp_totals(mechanisms.rdp_points(rel, (2.0, 4.0)), (2.0, 4.0, 8.0))
    assert {r.alpha: r.rdp for r in totals.collect()} == pytest.approx({2.0: 1.2, 4.0: 0.8, 8.0: 0.0})
    best = accountant.rdp_epsilon(totals, 1e-6).first()
    assert best.best_alpha == 8.0 and best.rdp_epsilon == pytest.approx(math.log(1e6) / 7)
    tight = spark.range(1).select(mechanisms.laplace_rdp(F.lit(2.0), F.lit(0.3), tight=True).alias("x")).first().x
    assert 0 < tight < 0.6


def test_release_hides_counts_and_gates(spark):
    rows = spark.createDataFrame([(i, f"u{i % 9}", dt.date(2025, 10, 1 + i % 20), "+", []) for i in range(60)], "seq long, user_id string, day date, op string, days array<date>")
    out = release.release(rows, "dau", C)
    assert "exact_value" not in out.columns and "users" not in out.columns
    got = {r.day.day: r for r in out.collect()}
    assert [got[d].status for d in range(1, 12)] == ["released"] * 10 + ["budget_exhausted"] and got[11].estimate is None and got[11].epsilon_used == 0
    assert got[1].next_reset == dt.date(2025, 11, 1)
    exact = release.release(rows, "mau", C, debug_exact=True, window_days=5).filter("status = 'released'").collect()
    assert all(abs(r.estimate - r.exact_value) < 60 and r.window_days == 5 for r in exact)
    summary = release.budget_summary(release.releases_of(out), C).first()
    assert summary.spent == pytest.approx(3.0) and summary.composition == "naive"


def test_ledger(spark, tmp_path):
    day = lambda d: dt.date(2025, 10, d)
    rows = [(1, "a", day(1), "+", []), (2, "a", day(8), "+", []), (3, "b", day(8), "+", []), (4, "a", day(8), "-", [])]
    t = spark.createDataFrame(rows, "seq long, user_id string, day date, op string, days array<date>")
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.activity().count() == 0
    ledger.record(t, C)
    assert [(r.day, len(r.user_key)) for r in ledger.active().collect()] == [(day(8), 64)]
    assert ledger.activity("2025-10-01").count() == 2
    assert ledger.erasures(pending=True).count() == 1
    assert ledger.replay() == [day(1), day(8)]
    assert ledger.erasures(pending=True).count() == 0 and ledger.erasures().count() == 1
    plan = ledger.activity("2025-10-01")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_ledger_deletion_of_days_stored_before(spark, tmp_path):
    day = lambda d: dt.date(2025, 10, d)
    table = lambda rows: spark.createDataFrame(rows, "seq long, user_id string, day date, op string, days array<date>")
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.record(table([(1, "a", day(1), "+", []), (2, "a", day(8), "+", []), (3, "b", day(8), "+", [])]), C)
    ledger.record(table([(4, "a", day(9), "-", [])]), C)
    assert [r.day for r in ledger.active().collect()] == [day(8)]
    assert [sorted(r.days) for r in ledger.erasures().collect()] == [[day(1), day(8), day(9)]]
    assert ledger.replay() == [day(1), day(8), day(9)]


def test_rotated_secret_still_erases(spark, tmp_path):
    day = lambda d: dt.date(2025, 10, d)
    table = lambda rows: spark.createDataFrame(rows, "seq long, user_id string, day date, op string, days array<date>")
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.record(table([(1, "a", day(1), "+", []), (2, "b", day(1), "+", [])]), C)
    later = C.rotated("t")
    assert later.hash_salt_secret == "t" and later.root_secret == "s" and later.rotated("u").root_secret == "s"
    ledger.record(table([(3, "a", day(2), "-", [])]), later)
    assert [sorted(r.days) for r in ledger.erasures().collect()] == [[day(1), day(2)]]


def test_reported_budget_by_points(spark):
    """One window release of 0.5 under a cap of 3.5: what remains goes by the best order; a month without releases isn't free of spending."""
    rel = spark.createDataFrame([("mau", dt.date(2025, 10, 1), "2025-10", 0.5, 1e-6)], "metric string, day date, period string, epsilon double, delta double")
    row = release.budget_summary(rel, C).first()
    sigma = mechanisms.gaussian_sigma(0.5, 1e-6)
    want = min(a / (2 * sigma**2) + math.log(1e6) / (a - 1) for a in (2, 4, 8, 16, 32))
    assert row.composition == "rdp" and row.spent == 0.5 and row.epsilon_spent == pytest.approx(want) and row.remaining == pytest.approx(3.5 - want)
    assert row.rdp_curve[2.0] == pytest.approx(1 / sigma**2) and row.rdp_orders == [2.0, 4.0, 8.0, 16.0, 32.0]
    months = spark.createDataFrame([("mau", "2025-12"), ("dau", "2025-12")], "metric string, period string")
    got = {r.metric: r for r in release.budget_summary(rel, C, months).collect()}
    assert got["mau"].releases == 0 and got["mau"].epsilon_spent == pytest.approx(math.log(1e6) / 31) and got["dau"].remaining == 3.0 and got["dau"].rdp_epsilon is None


def test_snapshots_are_read_and_kept_up_to_date(spark, tmp_path):
    day = lambda d: dt.date(2025, 10, d)
    table = lambda rows: spark.createDataFrame(rows, "seq long, user_id string, day date, op string, days array<date>")
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.record(table([(i, f"u{i}", day(1), "+", []) for i in range(9)]), C)
    assert ledger.day_count(day(1), C) == 9 and ledger.snapshots().count() == 1
    ledger.record(table([(20, "u1", day(3), "-", []), (21, "x", day(1), "+", [])]), C)
    assert {r.day: r.exact_count for r in ledger.snapshots().collect()} == {day(1): 9}
    assert ledger.day_count(day(2), C) == 0


def test_epochs_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(pseudonym, "MOST_EPOCHS", 3)
    rows = spark.range(200).select(F.lit("a").alias("user_id"), F.expr("date_add(DATE'2025-01-01', cast(id as int))").alias("day"))
    with pytest.raises(ValueError):
        pseudonym.with_user_key(rows, "s", 30)


def test_dynamic_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.append(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, "p")
    sinks.overwrite_partitions(spark.createDataFrame([(3, "b")], "v int, p string"), path, "p")
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 3]


def test_rate_limit_matches_a_queue(spark):
    r = random.Random(5)
    times = sorted(r.randrange(300) for _ in range(200))
    rows = [(dt.datetime(2025, 1, 1) + dt.timedelta(seconds=t), f"c{i % 3}") for i, t in enumerate(times)]
    out = requests.rate_limit(spark.createDataFrame(rows, "ts timestamp, client string"), limit=5, span_s=60)
    got = {c: n for c, n in out.groupBy("client").agg(F.sum(F.col("allowed").cast("int"))).collect()}
    want = {}
    for c in ("c0", "c1", "c2"):
        kept = []
        for i, t in enumerate(times):
            if f"c{i % 3}" == c and sum(1 for k in kept if k > t - 60) < 5:
                kept.append(t)
        want[c] = len(kept)
    assert got == want


def test_command_line(spark, tmp_path, capsys):
    from tidecount import cli

    path = write(tmp_path, "e.jsonl", '{"seq":1,"user_id":"a","op":"+","day":"2025-10-01"}\n')
    assert cli.main(["exact", path, "--window", "1"], spark) == 0
    assert '"users":1' in capsys.readouterr().out
    assert cli.main(["secret"], spark) == 0 and "b64:" in capsys.readouterr().out
    assert cli.main(["dau", path, "--secret", "x"], spark) == 0
    assert '"status":"released"' in capsys.readouterr().out
    assert cli.main(["generate", str(tmp_path / "w.jsonl"), "--users", "20", "--days", "3"], spark) == 0
    assert events.read_events(spark, str(tmp_path / "w.jsonl")).count() > 0


def test_stored_releases(spark, tmp_path):
    day = lambda d: dt.date(2025, 10, d)
    rows = [(i, f"u{i % 7}", day(1 + i % 8), "+", []) for i in range(40)] + [(50, "u1", day(8), "-", [])]
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    config = Config(hash_salt_secret="s", dau_budget_total=0.6, mau_budget_total=10.0)
    ledger.record(spark.createDataFrame(rows, "seq long, user_id string, day date, op string, days array<date>"), config)
    first = release.release_stored(ledger, "DAU", day(3), config)
    assert first["epsilon_used"] == 0.3 and first["budget_remaining"] == pytest.approx(0.3) and "users" not in first
    assert ledger.erasures(pending=True).count() == 0 and {r.day for r in ledger.snapshots().collect()} >= {day(8)}
    release.release_stored(ledger, "dau", day(3), config)
    with pytest.raises(release.BudgetExceeded) as e:
        release.release_stored(ledger, "dau", day(4), config)
    assert e.value.next_reset == dt.date(2025, 11, 1)
    month = release.release_stored(ledger, "mau", day(8), config, window_days=3)
    assert month["mechanism"] == "gaussian" and month["window_days"] == 3
    assert ledger.releases("dau").count() == 2 and ledger.rdp().filter("metric = 'mau'").count() == 5
    assert {r.metric: r.composition for r in ledger.budget(config).collect()} == {"dau": "naive", "mau": "rdp"}
    ledger.reset("dau", "2025-10")
    assert ledger.releases("dau").count() == 0 and ledger.releases("mau").count() == 1
    assert release.release_stored(ledger, "dau", day(4), config)["budget_remaining"] == pytest.approx(0.3)
    report = release.budget_report(ledger.budget(config), dt.datetime(2025, 11, 1)).first().report
    assert '"generated_at":"2025-11-01T00:00:00"' in report and '"dau"' in report
    ledger.backup(str(tmp_path / "copy"))
    assert Ledger(spark, str(tmp_path / "copy")).releases("dau").count() == 1
    with pytest.raises(ValueError):
        release.release_stored(ledger, "wau", day(4), config)
    with pytest.raises(PySparkException):
        ledger.record_rdp(spark.createDataFrame([(1, "dau", day(1), "2025-10", 1.0, 0.1)], "id long, metric string, day date, period string, alpha double, rdp double"))


def test_csv_metadata_of_any_key(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", dt.date(2025, 10, 1), "+", [], {"b": 'x,"y"', "a": ""}), (2, "a", dt.date(2025, 10, 2), "-", [dt.date(2025, 10, 1)], None)], "seq long, user_id string, day date, op string, days array<date>, metadata map<string,string>")
    path = str(tmp_path / "m.csv")
    sinks.write_csv(rows, path)
    got = {r.seq: r for r in events.read_csv(spark, path, keep=True).collect()}
    assert got[1].metadata == {"b": 'x,"y"'} and got[2].metadata == {} and got[2].days == [dt.date(2025, 10, 1)] and got[1].days == []


def test_client_keys(spark):
    rows = [("0123456789", "1.2.3.4", "h"), ("", " 1.2.3.4 , 5", "h"), (None, None, "h"), (None, "", None)]
    df = spark.createDataFrame(rows, "k string, f string, h string")
    assert [r.c for r in df.select(requests.client_key(F.col("k"), F.col("f"), F.col("h")).alias("c")).collect()] == ["key:01234567", "ip:1.2.3.4", "ip:h", "unknown"]


def test_metadata_columns(spark, tmp_path):
    rows = spark.createDataFrame([(1, {"b": "x"}), (2, {"a": "y"}), (3, None)], "seq long, metadata map<string,string>")
    flat = sinks.flatten_metadata(rows)
    assert flat.columns == ["seq", "metadata.a", "metadata.b"]
    assert sorted(tuple(r) for r in flat.collect() if r.seq < 3) == [(1, None, "x"), (2, "y", None)]


def test_ledger_commands(spark, tmp_path, capsys):
    from tidecount import cli

    path = write(tmp_path, "e.jsonl", '{"seq":1,"user_id":"a","op":"+","day":"2025-10-01"}\n{"seq":2,"user_id":"a","op":"-","day":"2025-10-02"}\n')
    ledger = str(tmp_path / "ledger")
    assert cli.main(["ingest", ledger, path, "--secret", "x"], spark) == 0
    assert cli.main(["flush-deletes", ledger, "--secret", "x"], spark) == 0
    assert '"2025-10-01", "2025-10-02"' in capsys.readouterr().out
    for _ in range(10):
        assert cli.main(["release", ledger, "dau", "2025-10-01", "--secret", "x"], spark) == 0
    assert cli.main(["release", ledger, "dau", "2025-10-01", "--secret", "x"], spark) == 3
    assert "2025-11-01" in capsys.readouterr().out
    assert cli.main(["reset-budget", ledger, "dau", "2025-10", "--secret", "x"], spark) == 0
    assert cli.main(["release", ledger, "dau", "2025-10-01", "--secret", "x"], spark) == 0
    assert cli.main(["budget-report", ledger, "--secret", "x"], spark) == 0
    assert '"spent":0.3' in capsys.readouterr().out


def test_stream_late_deletions(spark, tmp_path):
    """Batches in arrival order, among them a deletion of all days: counts equal the whole log's."""
    from tidecount.operators import activity, turnstile
    from tidecount.streaming import turnstile_stream

    r = random.Random(2)
    schema = "seq long, user_id string, day date, op string, days array<date>"
    rows = [(i, r.choice("abc"), dt.date(2025, 10, 1 + r.randrange(5)), r.choice("+++-"), [dt.date(2025, 10, 1)] if r.random() < 0.3 else []) for i in range(40)]
    rows = [(s, u, d, op, days if op == "-" else []) for s, u, d, op, days in rows]
    folder = str(tmp_path / "s")
    (tmp_path / "s" / "in").mkdir(parents=True)
    stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        turnstile_stream.keep_daily_counts(stream, folder).awaitTermination()
        want = {x.day: x.users for x in activity.daily(turnstile.active_pairs(spark.createDataFrame(rows[: k * 10 + 10], schema))).collect()}
        assert {x.day: x.users for x in turnstile_stream.counts(spark, folder).filter("users > 0").collect()} == want


def test_live_windows(spark, tmp_path):
    from tidecount.streaming import turnstile_stream

    path = str(tmp_path / "e")
    spark.createDataFrame([(dt.datetime(2025, 10, d, 12), f"u{u}") for d in (1, 2, 2, 3) for u in range(d * 2)], "ts timestamp, user_id string").write.parquet(path)
    source = lambda: spark.readStream.schema("ts timestamp, user_id string").parquet(path)
    for kind in ("hll", "theta"):
        turnstile_stream.live_counts(source(), sketch=kind).writeStream.format("memory").queryName(f"live_{kind}").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        assert [r.users for r in spark.table(f"live_{kind}").orderBy("start").collect()] == [2, 4, 6]
    turnstile_stream.first_of_day(source()).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("firsts").count() == 12

"""For each registered query that SQL can express: the same rows by another engine's SQL, written from the definitions.

These statements don't mirror the plans: deletions are applied through explicit tombstones and an ordered fold, rolling counts through a
join of days and pairs, sketches through full sorts.
"""

from __future__ import annotations

import math

from ..functions.pseudonym import epoch_salt, pads, secret_bytes
from .fixed import BUCKET_K, CAPS, END_DAY, SECRET, SEED

T = """t AS (
  SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS DATE) AS day,
         CASE WHEN event_type = 'error' AND value > 60 THEN '-' ELSE '+' END AS op,
         CASE WHEN event_type = 'error' AND value > 60 AND CAST(json_extract(props, '$.k') AS INT) % 2 = 0
              THEN [CAST(ts AS DATE) - 1, CAST(ts AS DATE) - 2] ELSE CAST([] AS DATE[]) END AS days
  FROM events)"""
NAMED = T + """, named AS (
  SELECT DISTINCT seq, user_id, op, len(days) = 0 AS whole, day AS source_day, unnest(list_distinct(list_append(days, day))) AS day FROM t)"""
TOMBS = NAMED + """, tombs AS (
  SELECT seq, user_id, source_day, day FROM named WHERE op = '-' AND NOT whole
  UNION ALL
  SELECT DISTINCT d.seq, d.user_id, d.day, n.day FROM t d JOIN named n ON n.user_id = d.user_id AND n.seq <= d.seq WHERE d.op = '-' AND len(d.days) = 0)"""
LOG = TOMBS + """, log AS (
  SELECT seq, 0 AS step, user_id, day, op FROM t UNION ALL SELECT seq, 1, user_id, day, '-' FROM tombs)"""
ACTIVE = LOG + """, active AS (
  SELECT user_id, day FROM (SELECT user_id, day, op, row_number() OVER (PARTITION BY user_id, day ORDER BY seq DESC, step DESC) AS n FROM log)
  WHERE n = 1 AND op = '+')"""
SPINE = """spine AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM t), (SELECT max(day) FROM t), INTERVAL 1 DAY)) AS DATE) AS day)"""
HASHED = ACTIVE + ", hashed AS (SELECT *, substr(sha256(user_id), 1, 16) AS h FROM active)"
# the same over a log of deletions only
GONE = TOMBS.replace("FROM events)", "FROM events WHERE event_type = 'error' AND value > 60)", 1)
TEXT_DAYS = "array_to_string([strftime(x, '%Y-%m-%d') FOR x IN list_sort(days)], ',') AS days"

LISTED = f"WITH {T} SELECT seq, user_id, day, op, {TEXT_DAYS} FROM t"
DAU = f"WITH {ACTIVE} SELECT day, count(DISTINCT user_id) AS users FROM active GROUP BY day"


def _rolling(window: int) -> str:
    return f"WITH {ACTIVE}, {SPINE} SELECT s.day, count(DISTINCT a.user_id) AS users FROM spine s LEFT JOIN active a ON a.day BETWEEN s.day - {window - 1} AND s.day GROUP BY s.day"


def _hmac(key: str, inner: str, outer: str) -> str:
    return f"sha256(unhex({outer}) || unhex(sha256(unhex({inner}) || encode({key}))))"


def _salts() -> str:
    """Salts of the epochs from 2023 to 2025."""
    secret = secret_bytes(SECRET)
    rows = ", ".join(f"({e}, '{a}', '{b}')" for e in range(738521 // 30, 739617 // 30 + 1) for a, b in [pads(epoch_salt(secret, e))])
    return f"salts(epoch, a, b) AS (VALUES {rows})"


EPOCH = "(date_diff('day', DATE '1970-01-01', day) + 719163) // 30"


def _u(text: str, offset: int) -> str:
    return f"((('0x' || substr(sha256({text}), {offset}, 13))::UBIGINT)::DOUBLE + 0.5) / 4503599627370496::DOUBLE"


def _seed(metric: str) -> str:
    return f"('{metric}:' || strftime(day, '%Y-%m-%d') || ':{SEED}')"


def _noisy(source: str, metric: str, epsilon: float, delta: float) -> str:
    text = _seed(metric)
    if delta:
        sigma = math.sqrt(2 * math.log(1.25 / delta)) / epsilon
        noise, half, kind = f"{sigma!r}::DOUBLE * sqrt(-2 * ln({_u(text, 1)})) * cos(2 * pi() * ({_u(text, 14)}))", 1.959963984540054 * sigma, "gaussian"
    else:
        scale = 1 / epsilon
        u = f"({_u(text, 1)} - 0.5::DOUBLE)"
        noise, half, kind = f"-({scale!r}::DOUBLE) * sign({u}) * ln(1 - 2 * abs({u}))", -scale * math.log(0.05 / 2), "laplace"
    return f"SELECT day, users + {noise} AS e, {half!r}::DOUBLE AS half, '{kind}' AS mechanism FROM ({source})"


def _noisy_rows(*args) -> str:
    return f"SELECT day, round(e, 6) AS estimate, round(e - half, 6) AS lower_95, round(e + half, 6) AS upper_95, mechanism FROM ({_noisy(*args)})"


REQUESTS = f"""WITH {T}, {SPINE}, asked AS (
  SELECT date_diff('day', DATE '1970-01-01', day)::BIGINT AS req_seq, m.metric, day, strftime(day, '%Y-%m') AS period, m.epsilon, m.delta, m.cap
  FROM spine, (VALUES ('dau', 0.3::DOUBLE, 0::DOUBLE, {CAPS['dau']}::DOUBLE), ('mau', 0.5::DOUBLE, 1e-6::DOUBLE, {CAPS['mau']}::DOUBLE)) m(metric, epsilon, delta, cap)
), gated AS (
  SELECT *, sum(epsilon) OVER (PARTITION BY metric, period ORDER BY req_seq) <= cap + 1e-9 AS released FROM asked
), rel AS (SELECT * FROM gated WHERE released)"""
SPENT = REQUESTS + ", spent AS (SELECT metric, period, sum(epsilon) AS spent, count(*) AS releases, greatest(0, max(cap) - sum(epsilon)) AS remaining, max(cap) AS cap, max(delta) AS delta FROM rel GROUP BY ALL)"
ORDERS = "(VALUES (2::DOUBLE), (4::DOUBLE), (8::DOUBLE), (16::DOUBLE), (32::DOUBLE)) o(alpha)"
POINTS = SPENT + f""", points AS (
  SELECT metric, day, period, alpha, CASE WHEN delta > 0 THEN alpha / (2 * pow(sqrt(2 * ln(1.25::DOUBLE / delta)) / epsilon, 2)) ELSE alpha / (alpha - 1) * epsilon END AS rdp
  FROM rel, {ORDERS}
), totals AS (SELECT metric, period, alpha, sum(rdp) AS rdp FROM points GROUP BY ALL
), best AS (
  SELECT metric, period, min(rdp + ln(1e6::DOUBLE) / (alpha - 1)) AS rdp_epsilon, arg_min(alpha, rdp + ln(1e6::DOUBLE) / (alpha - 1)) AS best_alpha FROM totals GROUP BY ALL
), adv AS (
  SELECT metric, period, sqrt(2 * ln(1e7::DOUBLE) * sum(epsilon * epsilon)) + sum(epsilon * (exp(epsilon) - 1)) AS advanced_epsilon, sum(delta) + 1e-7::DOUBLE AS advanced_delta
  FROM rel GROUP BY ALL)"""
KMV = f"""CASE WHEN n < {BUCKET_K} THEN n::DOUBLE ELSE {BUCKET_K - 1} / (('0x' || kth)::UBIGINT::DOUBLE / 18446744073709551615::DOUBLE) END"""


def _kmv(group: str, source: str = "hashed") -> str:
    return f"SELECT {group}, n, round({KMV}, 6) AS estimate FROM (SELECT {group}, count(*) AS n, max(h) AS kth FROM (SELECT {group}, h, row_number() OVER (PARTITION BY {group} ORDER BY h) AS rank FROM (SELECT DISTINCT {group}, h FROM {source})) WHERE rank <= {BUCKET_K} GROUP BY {group})"


LOG_TABLE = """requests AS (
  SELECT ts, event_type AS handler, 'POST' AS method, CASE WHEN event_type = 'error' THEN CASE WHEN value > 60 THEN 500 ELSE 400 END ELSE 200 END AS status,
         value / 100 AS duration_s, CAST(user_id AS VARCHAR) AS client FROM events)"""


def _left(metric: str) -> str:
    """What a month has left after n releases, by the composition that the metric reports."""
    if metric == "dau":
        return f"greatest(0, {CAPS['dau']} - 0.3 * n)"
    sigma = math.sqrt(2 * math.log(1.25 / 1e-6)) / 0.5
    at = ", ".join(f"n * {a / (2 * sigma * sigma)!r} + {math.log(1e6) / (a - 1)!r}" for a in (2, 4, 8, 16, 32))
    return f"greatest(0, {CAPS['mau']} - least({at}))"


def _answers(metric: str, source: str, epsilon: float, delta: float, window: int) -> str:
    shown = ", ".join(f"CASE WHEN g.released THEN round({e}, 6) END AS {n}" for e, n in (("e", "estimate"), ("e - half", "lower_95"), ("e + half", "upper_95")))
    gated = REQUESTS.replace("WITH ", "", 1)
    return f"""WITH noisy AS ({_noisy(source, metric, epsilon, delta)}), {gated}
      SELECT '{metric}' AS metric, g.day, {window} AS window_days, CASE WHEN g.released THEN 'released' ELSE 'budget_exhausted' END AS status, {shown},
             CASE WHEN g.released THEN g.epsilon ELSE 0 END AS epsilon_used, mechanism, round({_left(metric)}, 6) AS budget_remaining, CAST(date_trunc('month', g.day) + INTERVAL 1 MONTH AS DATE) AS next_reset
      FROM (SELECT *, count(*) FILTER (released) OVER (PARTITION BY metric, period ORDER BY req_seq) AS n FROM gated) g JOIN noisy ON noisy.day = g.day WHERE g.metric = '{metric}'"""


_A, _B = (f"(SELECT DISTINCT h FROM hashed WHERE day {c}) ORDER BY h LIMIT {BUCKET_K}" for c in ("< DATE '2024-01-16'", ">= DATE '2024-01-20'"))
A_NOT_B = f"""WITH {HASHED}, a AS (SELECT h FROM {_A}), b AS (SELECT h FROM {_B}),
  lim AS (SELECT least((SELECT CASE WHEN count(*) < {BUCKET_K} THEN 'g' ELSE max(h) END FROM a), (SELECT CASE WHEN count(*) < {BUCKET_K} THEN 'g' ELSE max(h) END FROM b)) AS l),
  k AS (SELECT count(*) AS survivors FROM a, lim WHERE h < l AND h NOT IN (SELECT h FROM b))
  SELECT survivors, round(CASE WHEN l = 'g' THEN survivors::DOUBLE ELSE survivors / (('0x' || l)::UBIGINT::DOUBLE / 18446744073709551615::DOUBLE) END, 6) AS estimate FROM k, lim"""
BLOOM = f"SELECT day, bits, CAST(greatest(1, round_even(bits / greatest(users, 1) * {math.log(2)!r}::DOUBLE, 0)) AS BIGINT) AS hashes FROM (SELECT day, users, CAST(greatest(8, ceil(-users * {math.log(0.01)!r}::DOUBLE / {math.log(2) ** 2!r}::DOUBLE)) AS BIGINT) AS bits FROM ({DAU}))"
VARYING = f"""WITH RECURSIVE {REQUESTS.replace('WITH ', '', 1)}, n AS (
  SELECT metric, period, req_seq, (req_seq % 5 + 1) / 10.0::DOUBLE AS epsilon, cap, row_number() OVER (PARTITION BY metric, period ORDER BY req_seq) AS i FROM asked
), walk AS (
  SELECT metric, period, 0::BIGINT AS i, 0::BIGINT AS req_seq, 0::DOUBLE AS epsilon, 0::DOUBLE AS spent, false AS released FROM n WHERE i = 1
  UNION ALL
  SELECT n.metric, n.period, n.i, n.req_seq, n.epsilon, CASE WHEN w.spent + n.epsilon <= n.cap + 1e-9 THEN w.spent + n.epsilon ELSE w.spent END, w.spent + n.epsilon <= n.cap + 1e-9
  FROM walk w JOIN n ON n.metric = w.metric AND n.period = w.period AND n.i = w.i + 1
) SELECT metric, req_seq, epsilon, released FROM walk WHERE i > 0"""
STATS = f"""WITH est AS (WITH {HASHED} {_kmv('day')}), ex AS ({DAU}), e AS (
  SELECT abs(estimate - users) AS ae, abs(estimate - users) / greatest(1, users) AS re FROM est JOIN ex USING (day))
  SELECT 'kmv' AS sketch, count(*) AS n, """ + ", ".join(f"round({f}, 6) AS {c}_{n}" for c in ("ae", "re") for n, f in (("median", f"median({c})"), ("p90", f"quantile_cont({c}, 0.9)"), ("p95", f"quantile_cont({c}, 0.95)"), ("max", f"max({c})"))) + " FROM e"
HISTOGRAM = f"WITH {LOG_TABLE} SELECT handler, method, le, sum(CASE WHEN le = '+Inf' OR duration_s <= CAST(CASE WHEN le = '+Inf' THEN '0' ELSE le END AS DOUBLE) THEN 1 ELSE 0 END)::BIGINT AS requests FROM requests, (VALUES ('0.05'), ('0.1'), ('0.25'), ('0.5'), ('1.0'), ('2.5'), ('5.0'), ('+Inf')) b(le) GROUP BY ALL"


def _sweep() -> str:
    parts = []
    for sketch in ("set", "kmv"):
        for epsilon in (0.3, 1.0):
            for metric, days, delta in (("dau", 1, 0.0), ("mau", 30, 1e-6)):
                counts = f"SELECT * FROM ({_rolling(days)}) WHERE day = (SELECT max(CAST(ts AS DATE)) FROM events)"
                spent = epsilon if metric == "dau" else max(0.5, epsilon)
                parts.append(f"SELECT '{sketch}' AS sketch, {epsilon}::DOUBLE AS epsilon, '{metric}' AS metric, n.day, users::DOUBLE AS exact, round(e, 6) AS estimate FROM ({_noisy(counts, metric, spent, delta)}) n JOIN ({counts}) c ON c.day = n.day")
    return " UNION ALL ".join(parts)


# the sketches hold more keys than any test table has users, so both estimate the exact count
SWEEP = _sweep()


SWEEP_FILE = f"SELECT sketch, epsilon, day, max(estimate) FILTER (metric = 'dau') AS dau, max(estimate) FILTER (metric = 'mau') AS mau FROM ({SWEEP}) GROUP BY sketch, epsilon, day"


def _snapshot(source: str) -> str:
    """From rows (metric, period, cap, spent, releases, advanced_epsilon, curve: list of alpha and rdp): the budget by the composition that a metric reports."""
    return f"""SELECT metric, period, releases::BIGINT AS releases, CASE WHEN metric = 'mau' THEN best_alpha END AS best_alpha, CASE WHEN metric = 'mau' THEN 'rdp' ELSE 'naive' END AS composition,
      round(spent, 6) AS spent, round(CASE WHEN metric = 'mau' THEN e ELSE spent END, 6) AS epsilon_spent, round(greatest(0, cap - CASE WHEN metric = 'mau' THEN e ELSE spent END), 6) AS remaining,
      round(CASE WHEN metric = 'mau' THEN e END, 6) AS rdp_epsilon, round(advanced_epsilon, 6) AS advanced_epsilon, round(cap, 6) AS cap, curve FROM ({source})"""


CURVE = "string_agg(printf('%.0f:%.4f', alpha, rdp), ',' ORDER BY alpha) AS curve"
SNAPSHOT = _snapshot(POINTS + f", cv AS (SELECT metric, period, {CURVE} FROM totals GROUP BY ALL) SELECT s.*, best.rdp_epsilon AS e, best_alpha, advanced_epsilon, curve FROM spent s JOIN best USING (metric, period) JOIN adv USING (metric, period) JOIN cv USING (metric, period)")
UNUSED = _snapshot(f"SELECT metric, '2024-02' AS period, cap, 0::DOUBLE AS spent, 0 AS releases, ln(1e6::DOUBLE) / 31 AS e, 32::DOUBLE AS best_alpha, NULL::DOUBLE AS advanced_epsilon, '2:0.0000,4:0.0000,8:0.0000,16:0.0000,32:0.0000' AS curve FROM (VALUES ('dau', {CAPS['dau']}::DOUBLE), ('mau', {CAPS['mau']}::DOUBLE)) v(metric, cap)")


def _draw(what: str, *keys: str) -> str:
    return _u("('1:" + what + "' || " + " || ".join(f"':' || CAST({k} AS VARCHAR)" for k in keys) + ")", 1)


def _grid(users: int, days: int) -> str:
    return f"grid AS (SELECT u.i AS u, d.i AS d, DATE '2025-01-01' + d.i::INT AS day FROM range({users}) u(i), range({days}) d(i))"


def _survivors(users: int, days: int, rate: str, gone: str) -> str:
    """Users of each day that were active and didn't delete on it or later; ``gone(u, d)`` holds the deletions."""
    return f"""WITH {_grid(users, days)}, act AS (SELECT * FROM grid WHERE {_draw('active', 'u', 'd')} <= {rate}), gone AS ({gone}), last AS (SELECT u, max(d) AS l FROM gone GROUP BY u)
      SELECT day, count(*) AS users FROM act LEFT JOIN last USING (u) WHERE l IS NULL OR d > l GROUP BY day"""


def _square(i: int) -> str:
    text = f"('1:beta{i}:' || CAST(u AS VARCHAR))"
    return f"(-2 * ln({_u(text, 1)}) * pow(cos(2 * pi() * ({_u(text, 14)})), 2))"


def _beta(users: int, deleting: float) -> str:
    people = f"people AS (SELECT i AS u FROM range({users}) t(i)), rated AS (SELECT u, s0 / s AS rate FROM (SELECT u, {_square(0)} AS s0, {' + '.join(map(_square, range(11)))} AS s FROM people))"
    return f"""WITH {_grid(users, 30)}, {people}, act AS (SELECT grid.* FROM grid JOIN rated USING (u) WHERE {_draw('active', 'u', 'd')} <= rate),
      last AS (SELECT u, least(9 + floor({_draw('when', 'u')} * 21), 29) AS l FROM people WHERE {_draw('deletes', 'u')} <= {deleting})
      SELECT day, count(*) AS users FROM act LEFT JOIN last USING (u) WHERE l IS NULL OR d > l GROUP BY day"""


ADVERSARIAL = f"t AS (SELECT (k.i * 1099511627776 + u.i)::BIGINT AS seq, 'adv-' || u.i AS user_id, DATE '2025-01-01' + floor({_draw('day', 'u.i', 'k.i')} * 30)::INT AS day, CASE WHEN k.i % 2 = 0 THEN '+' ELSE '-' END AS op, CAST([] AS DATE[]) AS days FROM range(500) u(i), range(5) k(i))"
LOADED = f"""t AS (SELECT *, CASE WHEN op = '-' THEN [day, day - 1, day - 2] ELSE CAST([] AS DATE[]) END AS days FROM (
  SELECT i::BIGINT AS seq, 'load-user-' || floor({_draw('user', 'i')} * 100000)::BIGINT AS user_id, DATE '2025-01-01' + floor({_draw('day', 'i')} * 30)::INT AS day, CASE WHEN {_draw('op', 'i')} > 0.1 THEN '+' ELSE '-' END AS op FROM range(100000) r(i)))"""
TRAFFIC = f"WITH {_grid(50, 30)} SELECT day, count(*) AS users FROM grid WHERE NOT (u = floor({_draw('who', 'd')} * 50) AND {_draw('gone', 'd')} < 0.3) GROUP BY day"
FLIPS = f"WITH {LOG}, ch AS (SELECT user_id, op, lag(op, 1, '-') OVER (PARTITION BY user_id, day ORDER BY seq, step) AS before FROM log) SELECT user_id, count(*) FILTER (op <> before) AS flips FROM ch GROUP BY user_id"


def _limited(limit: int, span: int) -> str:
    """Each client's requests one after the other, with the accepted times of the last ``span`` seconds."""
    return f"""WITH RECURSIVE {LOG_TABLE}, n AS (SELECT client, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY client ORDER BY ts) AS i FROM requests),
      walk AS (
        SELECT client, 0::BIGINT AS i, CAST([] AS DOUBLE[]) AS held, 0::BIGINT AS allowed FROM (SELECT DISTINCT client FROM n)
        UNION ALL
        SELECT client, i, CASE WHEN len(held) < {limit} THEN list_append(held, t) ELSE held END, CASE WHEN len(held) < {limit} THEN allowed + 1 ELSE allowed END
        FROM (SELECT w.client, n.i, n.t, list_filter(w.held, lambda x: x > n.t - {span}) AS held, w.allowed FROM walk w JOIN n ON n.client = w.client AND n.i = w.i + 1)
      ) SELECT client, max(allowed)::BIGINT AS allowed FROM walk GROUP BY client"""


ROOT = _hmac("user_id", *(f"'{p}'" for p in pads(secret_bytes(SECRET))))


def _salts_of(secret: str) -> str:
    rows = ", ".join(f"({e}, '{a}', '{b}')" for e in range(738521 // 30, 739617 // 30 + 1) for a, b in [pads(epoch_salt(secret_bytes(secret), e))])
    return f"salts(epoch, a, b) AS (VALUES {rows})"


KMV_ROLLING = f"""WITH {HASHED}, {SPINE}, w AS (SELECT DISTINCT s.day, a.h FROM spine s JOIN hashed a ON a.day BETWEEN s.day - 29 AND s.day), k AS ({_kmv('day', 'w').replace(f'round({KMV}, 6)', KMV)})
  SELECT s.day, coalesce(estimate, 0)::DOUBLE AS users FROM spine s LEFT JOIN k ON k.day = s.day"""
BOTTOM = f"bottom AS (SELECT day, h FROM (SELECT day, h, row_number() OVER (PARTITION BY day ORDER BY h) AS n FROM (SELECT DISTINCT day, h FROM hashed)) WHERE n <= {BUCKET_K})"


def _more() -> dict[str, str]:
    """The stored ledger, workloads and the rest."""
    ids = "row_number() OVER (ORDER BY metric, day)::BIGINT AS id, metric, day, period, epsilon, delta, CASE WHEN delta > 0 THEN 'gaussian' ELSE 'laplace' END AS mechanism"
    note = "CASE WHEN step = 1 THEN '{\"tombstone\":true,\"source_day\":\"' || strftime(source_day, '%Y-%m-%d') || '\"}' END AS metadata"
    full = LOG + f", noted AS (SELECT seq, 0 AS step, user_id, day, op, NULL::DATE AS source_day FROM t UNION ALL SELECT seq, 1, user_id, day, '-', source_day FROM tombs), {_salts()}"
    distinct = f"WITH {ACTIVE} SELECT count(DISTINCT user_id)"
    split = f"WITH {ACTIVE}, a AS (SELECT DISTINCT user_id FROM active WHERE day < DATE '2024-01-16'), b AS (SELECT DISTINCT user_id FROM active WHERE day >= DATE '2024-01-20')"
    return {
        "dau_zero_fill": _rolling(1),
        "mau_all_ends_exploded": _rolling(30),
        "hll_mau": f"{distinct} AS users, true AS near FROM active",
        "approx_dau": f"SELECT day, users, true AS near FROM ({DAU})",
        "theta_day": f"SELECT day, users::DOUBLE AS estimate FROM ({DAU})",
        "theta_mau": f"{distinct}::DOUBLE AS estimate FROM active",
        "theta_a_not_b": split + " SELECT (SELECT count(*) FROM a ANTI JOIN b USING (user_id)) AS estimate, (SELECT count(*) FROM a SEMI JOIN b USING (user_id)) AS both",
        "union_hierarchy": f"SELECT day, users::DOUBLE AS estimate FROM ({DAU})",
        "sketch_set_serialised": f"WITH {ACTIVE} SELECT day, string_agg(DISTINCT user_id, ',' ORDER BY user_id) AS sketch, 'set' AS sketch_impl FROM active GROUP BY day",
        "kmv_packed": f"WITH {HASHED}, {BOTTOM} SELECT day, printf('%08x%08x', {BUCKET_K}, count(*)) || string_agg(h, '' ORDER BY h) AS packed FROM bottom GROUP BY day",
        "kmv_unpacked": f"WITH {HASHED}, {BOTTOM}, r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY h) AS n FROM bottom) SELECT day, string_agg(h, ',' ORDER BY h) AS hashes FROM r WHERE n <= 5 GROUP BY day",
        "kmv_rolling_estimate": f"SELECT day, round(users, 6) AS users FROM ({KMV_ROLLING})",
        "key_truncated": f"WITH {T} SELECT DISTINCT user_id, substr({ROOT}, 1, 16) AS short FROM t",
        "user_key_rotated_secret": f"WITH {T}, {_salts_of(SECRET + '-2')} SELECT DISTINCT user_id, day, {_hmac('user_id', 'a', 'b')} AS user_key, {ROOT} AS user_root FROM t JOIN salts ON salts.epoch = {EPOCH} WHERE seq <= 500",
        "laplace_release_flips": _noisy_rows(DAU, "dau", 0.15, 0.0),
        "budget_settings": f"SELECT * FROM (VALUES ('dau', {CAPS['dau']}::DOUBLE, 9.3::DOUBLE, 1), ('mau', {CAPS['mau']}::DOUBLE, 15.5::DOUBLE, 1)) v(metric, cap, scaled, sensitivity)",
        "budget_snapshot_unused": UNUSED,
        "budget_report_months": SPENT + " SELECT '2024-02-01T00:00:00' AS generated_at, metric, period, round(spent, 6) AS spent, releases FROM spent",
        "release_mau_kmv": _answers("mau", KMV_ROLLING, 0.5, 1e-6, 30),
        "ledger_log": f"WITH {full} SELECT seq, step, day, op, {_hmac('user_id', 'a', 'b')} AS user_key, {ROOT} AS user_root, {note} FROM noted JOIN salts ON salts.epoch = {EPOCH}",
        "ledger_two_batches_dau": DAU,
        "ledger_day_scan": f"WITH {LOG} SELECT seq, step, day, op FROM log WHERE day = DATE '2024-01-10'",
        "ledger_erasures": f"WITH {TOMBS} SELECT erasure_id, {ROOT} AS user_root, {TEXT_DAYS} FROM (SELECT seq AS erasure_id, user_id, list(DISTINCT day) AS days FROM tombs GROUP BY ALL)",
        "ledger_replayed_days": f"WITH {TOMBS} SELECT DISTINCT day, 0 AS pending FROM tombs",
        "ledger_snapshots": f"WITH {ACTIVE}, {SPINE}, c AS (SELECT day, count(DISTINCT user_id) AS n FROM active GROUP BY day) SELECT spine.day, coalesce(n, 0)::BIGINT AS exact_count, least(coalesce(n, 0), {BUCKET_K})::INT AS kept, 'kmv' AS sketch_impl FROM spine LEFT JOIN c ON c.day = spine.day",
        "ledger_releases": REQUESTS + f" SELECT {ids}, {SEED}::BIGINT AS seed FROM rel",
        "ledger_rdp_points": POINTS + " SELECT metric, day, period, alpha, round(rdp, 9) AS rdp FROM points",
        "ledger_budget_after_reset": f"SELECT metric, period, releases, spent, remaining FROM ({SNAPSHOT}) WHERE metric = 'mau'",
        "ledger_backup": f"WITH {LOG} SELECT 'activity' AS name, count(*) AS n FROM log UNION ALL SELECT 'erasures', count(DISTINCT seq) FROM tombs UNION ALL SELECT 'releases', 0",
        "sweep_results": SWEEP_FILE,
        "csv_metadata": f"""WITH {T} SELECT seq, t.user_id, day, op, {TEXT_DAYS}, 'a,"b"' || CASE WHEN seq % 2 = 0 THEN '|' || CAST(seq AS VARCHAR) ELSE '' END || '|' || event_type AS metadata FROM t JOIN events e ON e.event_id = t.seq""",
        "latency_totals": f"WITH {LOG_TABLE} SELECT handler, method, round(sum(duration_s), 6) AS seconds, count(*) AS requests FROM requests GROUP BY ALL",
        "client_keys": "SELECT CASE event_id % 3 WHEN 0 THEN 'key:' || substr('key-' || user_id || '-secret', 1, 8) WHEN 1 THEN 'ip:10.0.0.' || user_id ELSE 'ip:host-' || user_id END AS client, count(*) AS requests FROM events GROUP BY ALL",
        "rate_limit_exact": _limited(3, 3600 * 24),
        "rate_limit_default": _limited(600, 60),
        "synthetic_workload": _survivors(200, 10, "0.2", f"SELECT u, d FROM grid WHERE {_draw('delete', 'u', 'd')} <= 0.1"),
        "simulated_workload": _survivors(10_000, 60, "0.2", f"SELECT u, d FROM act WHERE {_draw('delete', 'u', 'd')} <= 0.05"),
        "adversarial_workload": f"WITH {ADVERSARIAL} SELECT seq, user_id, day, op FROM t",
        "adversarial_flips": FLIPS.replace(T, ADVERSARIAL),
        "sample_traffic": TRAFFIC,
        "load_sample": DAU.replace(T, LOADED),
        "beta_workload": _beta(10_000, 0.05),
        "beta_workload_large": _beta(100_000, 0.2),
        "stream_live_approx": "SELECT s::DATE AS first_day, count(DISTINCT user_id) AS exact, true AS near FROM (SELECT user_id, unnest(generate_series(ts::DATE - 6, ts::DATE, INTERVAL 1 DAY)) AS s FROM events) GROUP BY ALL",
        "stream_first_of_day": "SELECT ts::DATE AS day, count(DISTINCT user_id) AS users FROM events GROUP BY ALL",
    }


def oracle_sql() -> dict[str, str]:
    return _first() | _more()


def _first() -> dict[str, str]:
    window = f"day BETWEEN DATE '{END_DAY}' - 29 AND DATE '{END_DAY}'"
    return {
        "turnstile_view": LISTED,
        "source_jsonl": LISTED,
        "source_csv": LISTED,
        "envelope_events": LISTED,
        "metadata_map": """SELECT event_id, '{"type":"' || event_type || '"}' AS metadata FROM events""",
        "active_pairs": f"WITH {ACTIVE} SELECT * FROM active",
        "tombstones_expanded": f"WITH {TOMBS} SELECT * FROM tombs",
        "erasure_audit": f"WITH {TOMBS} SELECT erasure_id, user_id, {TEXT_DAYS} FROM (SELECT seq AS erasure_id, user_id, list(DISTINCT day) AS days FROM tombs GROUP BY ALL)",
        "day_fold_max_by": f"WITH {ACTIVE} SELECT * FROM active",
        "dirty_days": f"WITH {GONE} SELECT DISTINCT day FROM (SELECT day FROM t UNION ALL SELECT day FROM tombs)",
        "flippancy_per_user": f"WITH {LOG}, ch AS (SELECT user_id, op, lag(op, 1, '-') OVER (PARTITION BY user_id, day ORDER BY seq, step) AS before FROM log) SELECT user_id, count(*) FILTER (op <> before) AS flips FROM ch GROUP BY user_id",
        "distinct_days_per_user": f"WITH {NAMED} SELECT user_id, count(DISTINCT day) AS n_days FROM named GROUP BY user_id",
        "erasure_status": f"WITH {T} SELECT seq AS erasure_id, seq % 2 <> 0 AS pending FROM t WHERE op = '-'",
        "dau_exact": DAU,
        "dau_spine_zero_fill": f"WITH {ACTIVE}, {SPINE} SELECT s.day, count(DISTINCT a.user_id) AS users FROM spine s LEFT JOIN active a ON a.day = s.day AND isodow(a.day) < 6 GROUP BY s.day",
        "mau_single_end": f"WITH {ACTIVE} SELECT DATE '{END_DAY}' AS end_day, 30 AS window_days, count(DISTINCT user_id) AS users FROM active WHERE {window}",
        "mau_all_ends_delta": _rolling(30),
        "wau_all_ends": _rolling(7),
        "mau_by_epoch_key": f"WITH {ACTIVE} SELECT DATE '{END_DAY}' AS end_day, 30 AS window_days, count(DISTINCT (user_id, {EPOCH})) AS users FROM active WHERE {window}",
        "dau_orders": "SELECT CAST(o_orderdate AS DATE) AS day, count(DISTINCT o_custkey) AS users FROM orders GROUP BY ALL",
        "rotation_epoch": f"WITH {T} SELECT DISTINCT day, ({EPOCH})::BIGINT AS epoch FROM t",
        "user_key_hmac": f"WITH {T}, {_salts()} SELECT DISTINCT salts.epoch::BIGINT AS epoch, user_id, day, {_hmac('user_id', 'a', 'b')} AS user_key FROM t JOIN salts ON salts.epoch = {EPOCH}",
        "user_root_hmac": "WITH " + T + " SELECT DISTINCT user_id, {} AS user_root FROM t".format(_hmac("user_id", *(f"'{p}'" for p in pads(secret_bytes(SECRET))))),
        "set_union": f"WITH {ACTIVE} SELECT DISTINCT user_id FROM active",
        "set_a_not_b": f"WITH {ACTIVE} SELECT user_id FROM active WHERE day < DATE '2024-01-16' EXCEPT SELECT user_id FROM active WHERE day >= DATE '2024-01-16'",
        "kmv_bottom_k": f"WITH {HASHED} SELECT day, h, rank FROM (SELECT day, h, row_number() OVER (PARTITION BY day ORDER BY h) AS rank FROM (SELECT DISTINCT day, h FROM hashed)) WHERE rank <= {BUCKET_K}",
        "kmv_estimate_day": f"WITH {HASHED} {_kmv('day')}",
        "kmv_mau_estimate": f"WITH {HASHED}, w AS (SELECT DATE '{END_DAY}' AS end_day, h FROM hashed WHERE {window}) {_kmv('end_day', 'w')}",
        "kmv_a_not_b_theta": A_NOT_B,
        "bloom_sizing": BLOOM,
        "sketch_set_day": f"WITH {ACTIVE} SELECT count(DISTINCT user_id)::DOUBLE AS estimate FROM active",
        "sketch_kmv_day": f"SELECT day, users::DOUBLE AS estimate FROM ({DAU})",
        "noise_seed": f"WITH {T} SELECT DISTINCT day, " + ", ".join(f"(('0x' || substr(sha256({_seed(m)}), 1, 16))::UBIGINT & 9223372036854775807::UBIGINT)::BIGINT AS {m}_seed" for m in ("dau", "mau")) + " FROM t",
        "laplace_release_native": _noisy_rows(DAU, "dau", 0.3, 0.0),
        "gaussian_release_native": _noisy_rows(_rolling(30), "mau", 0.5, 1e-6),
        "budget_gate": REQUESTS + " SELECT metric, req_seq, day, released FROM gated",
        "budget_gate_varying": VARYING,
        "budget_spent": SPENT + " SELECT metric, period, round(spent, 6) AS spent, releases, round(remaining, 6) AS remaining FROM spent",
        "budget_after_reset": SPENT + ", r AS (SELECT *, row_number() OVER (PARTITION BY metric, period ORDER BY req_seq) AS n FROM rel) SELECT metric, period, round(sum(epsilon), 6) AS spent, count(*) AS releases FROM r WHERE n > 5 GROUP BY ALL",
        "rdp_points": POINTS + " SELECT metric, day, period, alpha, round(rdp, 9) AS rdp FROM points",
        "rdp_totals": POINTS + " SELECT metric, period, alpha, round(rdp, 6) AS rdp FROM totals",
        "rdp_best_epsilon": POINTS + " SELECT metric, period, round(rdp_epsilon, 6) AS rdp_epsilon, best_alpha FROM best",
        "advanced_composition": POINTS + " SELECT metric, period, round(advanced_epsilon, 6) AS advanced_epsilon, round(advanced_delta, 12) AS advanced_delta FROM adv",
        "day_epsilon": REQUESTS + " SELECT metric, day, sum(epsilon) AS epsilon FROM rel GROUP BY ALL",
        "budget_reported_month": POINTS + " SELECT metric, period, round(CASE WHEN delta > 0 THEN rdp_epsilon ELSE spent END, 6) AS epsilon FROM spent JOIN best USING (metric, period)",
        "budget_reported_day": POINTS + ", c AS (SELECT metric, day, min(rdp + ln(1e6::DOUBLE) / (alpha - 1)) AS e FROM points GROUP BY ALL) SELECT metric, day, round(CASE WHEN delta > 0 THEN e ELSE epsilon END, 6) AS epsilon FROM rel JOIN c USING (metric, day)",
        "metadata_columns": "SELECT event_id, " + ", ".join(f"CASE WHEN event_type = '{k}' THEN CAST(event_id AS VARCHAR) END AS \"metadata.{k}\"" for k in ("click", "error", "view")) + " FROM events",
        "release_sweep": SWEEP,
        "budget_snapshot": SNAPSHOT,
        "budget_next_reset": f"WITH {T} SELECT DISTINCT day, strftime(day, '%Y-%m') AS period, CAST(date_trunc('month', day) + INTERVAL 1 MONTH AS DATE) AS next_reset FROM t",
        "release_dau": _answers("dau", _rolling(1), 0.3, 0.0, 1),
        "release_mau": _answers("mau", _rolling(30), 0.5, 1e-6, 30),
        "release_error_stats": STATS,
        "http_totals": f"WITH {LOG_TABLE} SELECT handler, method, status, count(*) AS requests FROM requests GROUP BY ALL",
        "http_5xx": f"WITH {LOG_TABLE} SELECT handler, method, count(*) FILTER (status BETWEEN 500 AND 599) AS errors FROM requests GROUP BY ALL",
        "latency_histogram": HISTOGRAM,
        "rate_limit_window": f"WITH {LOG_TABLE}, r AS (SELECT client, count(*) OVER (PARTITION BY client ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS recent FROM requests) SELECT client, max(recent) AS most FROM r GROUP BY client",
        "last_day": f"WITH {T} SELECT max(day) AS day FROM t",
        "stream_ledger_dau": DAU,
    }

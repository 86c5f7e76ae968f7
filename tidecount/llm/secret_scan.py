"""Secret scans with built-in functions only: three base patterns, and a battery of randomness tests for the rest.

Every run of 20 or more encoding characters that no base span touches is a candidate. Its encoding is inferred
(hexadecimal, base 32, base 64; plain numbers are none) and its characters become codes. Against the null "random":
a chi-squared test of a uniform alphabet, a test of the runs above and below the middle, and one of the serial correlation of
neighbours; each must not reject at |z| > 3.29. Against the null "text", base 64 has a p-value from the same chi-squared
statistic, as letters of text collide more often. The smaller alphabets are too near a random one for that; theirs is one over the
likelihood ratio of a uniform alphabet to text written in it, words (and in hexadecimal numbers, whichever fits better), which bounds
the p-value. A document's candidates are reported at a false-discovery rate of 1 % (Benjamini and Hochberg) within
each class: hexadecimal, base 32, base 64, and base 64 of one letter case without digits, as plain words are, so that those don't raise
the bar for others. Each p-value is divided by a weight in proportion to the candidate's length, as long runs carry more evidence.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import LEAST, MOST, running

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
GATE = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[A-Za-z0-9+/_=-]{20}"

ALPHABETS = {
    16: "0123456789abcdef",
    32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
COLLIDE = 0.066  # chance that two letters of a text are equal
# Letters of text, in thousandths, over some languages in Latin script.
LETTERS = dict(zip("eansirtoldhcumpgbfvywqkzjx", (140, 88, 78, 72, 74, 68, 70, 58, 47, 43, 28, 33, 42, 28, 24, 18, 15, 14, 12, 9, 9, 7, 7, 6, 4, 4), strict=True))
DIGITS = 0.1  # share of digits in words written in hexadecimal
STRAY = 0.03  # share of letters in numbers, and of digits in words written in base 32
LIMIT = 3.29  # two-sided 0.1 %
RATE = 0.01


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _spans(rows: DataFrame, name: str, pattern: str, kind: str, order: int, length: str, least: str = "true", group: int = 0) -> DataFrame:
    """Adds ``name``: the spans of ``pattern`` in ``text``, measured by the function ``length``: pieces between matches and the matches' lengths add up."""
    quoted = _quoted(pattern)
    rows = rows.withColumn("m_", _gated(f"regexp_extract_all(text, {quoted}, 0)", "array<string>"))
    rows = rows.withColumn("g_", _gated(f"regexp_extract_all(text, {quoted}, {group})", "array<string>") if group else F.col("m_"))
    rows = rows.withColumn("gap_", F.expr(f"CASE WHEN size(m_) > 0 THEN transform(slice(split(text, {quoted}, -1), 1, size(m_)), x -> cast({length}(x) AS bigint)) ELSE cast(array() AS array<bigint>) END"))
    rows = rows.withColumn("both_", F.expr(f"zip_with(gap_, m_, (g, m) -> g + {length}(m))"))
    rows = rows.withColumn("at_", F.expr(running("both_")))
    # columns are arguments only, never inside a lambda: there the optimiser may put their definitions, to be worked out for each element
    found = f"transform(arrays_zip(zip_with(at_, gap_, (a, g) -> a + g), zip_with(at_, both_, (a, b) -> a + b), g_), x -> struct(x.`0` AS start, {order} AS kind_order, x.`1` AS stop, '{kind}' AS kind, x.g_ AS token))"
    return rows.withColumn(name, F.expr(f"filter({found}, x -> {least})")).drop("m_", "g_", "gap_", "both_", "at_")


def _scores(k: int, digits: float) -> str:
    """SQL for an array with, for each code of an alphabet, the log of how much likelier it is at random than in text with this share of digits."""
    letters = [a.lower() for a in ALPHABETS[k] if a.isalpha()]
    each = {a: (1 - digits) * LETTERS[a] / sum(LETTERS[b] for b in letters) for a in letters}
    if digits > 0.5:  # numbers, whose few letters are any
        each = dict.fromkeys(letters, (1 - digits) / len(letters))
    other = digits / (k - len(letters))
    return "array(" + ", ".join(f"{log(1 / k / each.get(a.lower(), other)):.4f}D" for a in ALPHABETS[k]) + ")"


def _gated(value: str, kind: str) -> Column:
    return F.expr(f"CASE WHEN gate THEN {value} ELSE cast(array() AS {kind}) END")


def _normal(z: str) -> str:
    """SQL for the normal distribution function, within 2e-4 in the middle; tails keep their order."""
    return f"(1 / (1 + exp(-least(greatest(1.5976 * ({z}) + 0.07056 * ({z}) * ({z}) * ({z}), -700D), 700D))))"


def _untouched(rows: DataFrame) -> DataFrame:
    """Adds ``c1``: the candidates that no base span overlaps. Both are put in order once; running extremes then tell the last end before each and the first start after it."""
    rows = rows.withColumn("line_", F.expr("array_sort(concat(transform(base, b -> struct(b.start AS start, 0 AS own, b.stop AS stop, '' AS token)), transform(runs, c -> struct(c.start AS start, 1 AS own, c.stop AS stop, c.token AS token))))"))
    rows = rows.withColumn("ends_", F.expr("transform(line_, x -> if(x.own = 0, x.stop, 0L))"))
    rows = rows.withColumn("starts_", F.expr("reverse(transform(line_, x -> if(x.own = 0, x.start, 9223372036854775807L)))"))
    rows = rows.withColumn("before_", F.expr(running("ends_", MOST))).withColumn("after_", F.expr(f"reverse({running('starts_', LEAST, '9223372036854775807L')})"))
    return rows.withColumn("c1", F.expr("transform(filter(arrays_zip(line_, before_, after_), x -> x.line_.own = 1 AND x.before_ <= x.line_.start AND x.after_ >= x.line_.stop), x -> x.line_)")).drop("line_", "ends_", "starts_", "before_", "after_")


def _random(rows: DataFrame, length: str) -> DataFrame:
    """Adds ``random``: spans of candidates that pass the battery. Time is in proportion to the text, but for sorting."""
    alphabet = "CASE c.k " + " ".join(f"WHEN {k} THEN '{letters}'" for k, letters in ALPHABETS.items()) + " END"
    total = lambda k, digits: f"aggregate(transform(c.x, v -> {_scores(k, digits)}[cast(v AS int)]), 0D, (a, v) -> a + v)"
    # runs that no base span touches, without padding, with the size of their alphabet
    rows = _untouched(_spans(rows, "runs", CANDIDATE, "random", 4, length))
    steps = {
        "c2": "transform(c1, c -> struct(c.start, c.stop, trim(TRAILING '=' FROM c.token) AS token, CASE WHEN c.token RLIKE '^[0-9]+=*$' THEN 10 WHEN c.token RLIKE '^([0-9a-f]+|[0-9A-F]+)=*$' THEN 16 WHEN c.token RLIKE '^[A-Z2-7]+=*$' THEN 32 ELSE 64 END AS k))",
        "c3": f"transform(filter(c2, c -> c.k > 10 AND char_length(c.token) >= 16), c -> struct(c.start, c.stop, c.k, char_length(c.token) AS n, CASE c.k WHEN 16 THEN lower(c.token) WHEN 32 THEN c.token ELSE translate(c.token, '-_', '+/') END AS token, {alphabet} AS alphabet, CASE WHEN c.k < 64 THEN c.k WHEN c.token RLIKE '^([^0-9A-Z]+|[^0-9a-z]+)$' THEN 0 ELSE 64 END AS class))",
        # one scan of the token for each letter counts it; codes come from one split, as picking letters by place would be quadratic
        "c4": "transform(transform(c3, c -> struct(c AS c, transform(regexp_extract_all(c.token, '.', 0), l -> cast(instr(c.alphabet, l) - 1 AS double)) AS x)), d -> struct(d.c.start, d.c.stop, d.c.k, d.c.n, d.c.class, d.x, aggregate(d.x, 0D, (a, v) -> a + v) / d.c.n AS mean, size(filter(d.x, v -> v < d.c.k / 2)) AS low,"
        " d.c.k * aggregate(regexp_extract_all(d.c.alphabet, '.', 0), 0D, (a, l) -> a + power(d.c.n - char_length(replace(d.c.token, l, '')), 2)) / d.c.n - d.c.n AS chi))",
        "c5": "transform(c4, c -> struct(c.start, c.stop, c.k, c.n, c.class, c.chi, (c.chi - (c.k - 1)) / sqrt(2D * (c.k - 1)) AS z_uniform,"
        f" CASE c.k WHEN 16 THEN least({total(16, DIGITS)}, {total(16, 1 - STRAY)}) WHEN 32 THEN {total(32, STRAY)} END AS ratio,"
        " 2D * c.low * (c.n - c.low) / c.n AS m,"
        " 1 + aggregate(zip_with(slice(c.x, 1, c.n - 1), slice(c.x, 2, c.n - 1), (a, b) -> CASE WHEN (a < c.k / 2) = (b < c.k / 2) THEN 0 ELSE 1 END), 0, (a, v) -> a + v) AS runs,"
        " sqrt(c.n) * aggregate(zip_with(slice(c.x, 1, c.n - 1), slice(c.x, 2, c.n - 1), (a, b) -> (a - c.mean) * (b - c.mean)), 0D, (a, v) -> a + v)"
        "   / nullif(aggregate(c.x, 0D, (a, v) -> a + (v - c.mean) * (v - c.mean)), 0D) AS z_serial))",
        # a constant half or constant code has no variance and fails
        "c6": "transform(c5, c -> struct(c.start, c.stop, c.n, c.class, c.z_uniform, c.z_serial, (c.runs - 1 - c.m) / nullif(sqrt(c.m * (c.m - 1) / (c.n - 1)), 0D) AS z_runs,"
        f" CASE WHEN c.k < 64 THEN exp(-greatest(0D, least(c.ratio, 700D))) ELSE {_normal(f'(c.chi - (c.k * (1 + (c.n - 1) * {COLLIDE}D) - c.n)) / sqrt(2D * (c.k - 1) + 4D * c.n * (c.k * {COLLIDE}D - 1))')} END AS p))",
        # by class: the mean length, then the p-values with their weights, then these in order and the largest that is reported
        "classes": "transform(filter(transform(array(0, 16, 32, 64), g -> filter(c6, c -> c.class = g)), f -> size(f) > 0), f -> struct(f AS f, cast(aggregate(f, 0D, (a, v) -> a + v.n) AS double) / size(f) AS usual))",
        "families": "transform(classes, g -> transform(g.f, c -> struct(c.start, c.stop, c.z_uniform, c.z_serial, c.z_runs, c.p * g.usual / c.n AS p)))",
        "ranked": "transform(families, f -> array_sort(transform(f, c -> c.p)))",
        "cut": f"transform(ranked, f -> array_max(transform(f, (p, i) -> CASE WHEN p <= {RATE}D * (i + 1) / size(f) THEN p ELSE -1D END)))",
        "c7": "flatten(zip_with(families, cut, (f, t) -> filter(f, c -> c.p <= t)))",
        "random": f"transform(filter(c7, c -> coalesce(abs(c.z_uniform) <= {LIMIT} AND abs(c.z_runs) <= {LIMIT} AND abs(c.z_serial) <= {LIMIT}, false)), c -> struct(c.start AS start, 4 AS kind_order, c.stop AS stop, 'random' AS kind, '' AS token))",
    }
    for name, step in steps.items():
        rows = rows.withColumn(name, F.expr(step))
    return rows.drop("runs", "c1", *(name for name in steps if name != "random"))


def secret_spans(docs: DataFrame, length: str = "char_length") -> DataFrame:
    """``docs`` with ``base`` and ``random``: sorted arrays of (start, kind_order, stop, kind, token); ``text`` null becomes empty.

    Places are code points, or bytes of the UTF-8 text with ``length`` as ``octet_length``.
    """
    rows = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("gate", F.col("text").rlike(GATE))
    rows = _spans(rows, "b1", ASSIGN, "assign", 1, length, "char_length(x.token) >= 6", 2)
    rows = _spans(_spans(rows, "b2", ACCESS, "access", 2, length), "b3", HEX, "hex", 3, length)
    rows = rows.withColumn("base", F.expr("array_sort(concat(b1, b2, b3))")).drop("b1", "b2", "b3")
    return _random(rows, length).drop("gate")


def _listed(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.stop)), ',')"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) for each row of ``docs(doc_id, text, ...)``. No shuffle.

    Null and empty texts have no spans. Positions are code points, the end exclusive. Repeated rows give repeated results.
    """
    rows = secret_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    count = lambda kind: F.expr(f"cast(size(filter(base, x -> x.kind = '{kind}')) AS bigint)").alias(f"n_{kind}")
    return rows.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.expr(f"sha2(cast({_listed('base')} AS binary), 256)").alias("base_sha256"),
        F.expr(_listed("array_sort(concat(base, random))")).alias("spans"), F.expr("cast(size(random) AS bigint)").alias("n_random"),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with each secret in ``text`` replaced by ``mark`` (overlapping ones by one), and ``n_chars`` brought up to date.

    Null and empty texts stay as they are, repeated rows change alike, an empty table gives no rows.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = secret_spans(docs.select(whole.alias("row"), F.col("text")), "octet_length")
    rows = rows.withColumn("every", F.expr("array_sort(concat(base, random))")).withColumn("ends", F.expr("transform(every, x -> x.stop)"))
    rows = rows.withColumn("before", F.expr(running("ends", MOST))).withColumn("raw", F.col("text").cast("binary"))
    # a span that begins inside an earlier one is part of its mark
    pieces = f"transform(filter(zip_with(every, before, (x, b) -> struct(b AS a, x.start AS b)), p -> p.b >= p.a), p -> concat(cast(substring(raw, cast(p.a + 1 AS int), cast(p.b - p.a AS int)) AS string), '{mark}'))"
    new = F.when(F.expr("size(every) > 0"), F.expr(f"concat(array_join({pieces}, ''), cast(substring(raw, cast(array_max(ends) + 1 AS int)) AS string))")).otherwise(F.col("row.text"))
    out = rows.select("row", new.alias("new"))
    columns = [F.col("new").alias("text") if c == "text" else F.when(F.col("new").eqNullSafe(F.col("row.text")), F.col("row.n_chars")).otherwise(F.char_length("new").cast(docs.schema["n_chars"].dataType)).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return out.select(*columns)

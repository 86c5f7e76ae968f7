"""License scans with built-in functions only: ordered signature rules behind keyword filters.

A text that may speak of licences (a few substring searches decide) becomes its lower-case words, joined by single spaces.
Rules (``license_rules``) are regular expressions over such words, each with a keyword that must occur before its expression is tried, a
priority and a confidence. Detections are intervals of words. One that lies within another of higher priority, or of the same
priority and longer, is suppressed (on the same words: of higher confidence, then of the earlier label); base detections always stay.
Priorities rise with exactness, so that a licence's version is not lost to a longer sentence without it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import MOST, running
from .license_rules import parsed

# The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

OTHER = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
# A text without any of these, and without "cc" before "by", "0", "zero" or "attribution", is not looked at further. Every match of every rule holds one.
GATE = (
    "licen", "lizenz", "copyright", "copyleft", "copying", "spdx", "domain", "dominio", "gemeinfrei", "reserv", "vorbehalten", "droits", "commons", "cc0", "gpl", "gnu", "bsd", "apache", "hereby", "redistribut", "permission",
    "warranty", "merchantab", "endorse", "advertising", "unencumber", "proprietary", "evil", "reproduced", "gfdl", "wtfpl", "openrail", "eupl", "cddl", "sspl", "busl", "gemma",
)
SHORT = rf"cc[{OTHER}]+(?:by|0|zero|attribution)"


def rules() -> list[tuple[str, int, float, str, str]]:
    """All rules in order: label, priority, confidence, keyword, pattern over `` word word ``; the base phrases come first, with priority 100."""
    base = [(label, 100, 0.7, phrase.split()[0], phrase) for phrase, label in BASE]
    return [(label, priority, confidence, key, f" (?:{pattern})(?= )") for label, priority, confidence, key, pattern in base + parsed()]


def _quoted(text: str) -> str:
    return "r'" + text + "'"  # no pattern holds a quote



def _words(text: str) -> str:
    """SQL for the number of words in a piece of `` word word``: each has one space before it."""
    return f"cast(char_length({text}) - char_length(replace({text}, ' ', '')) AS bigint)"


def detect(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words`` and ``found``: detections (first and last word, label, priority, confidence) that are not suppressed; base rules have priority 100."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    # words are the pieces between runs of other characters, but for an empty first and last one; matching the words themselves,
    # a complement of many ranges, is over ten times slower
    rows = rows.withColumn("pieces", F.split("text", f"[{OTHER}]+", -1))
    rows = rows.withColumn("n_words", F.expr("cast(greatest(0, size(pieces) - if(pieces[0] = '', 1, 0) - if(pieces[size(pieces) - 1] = '', 1, 0)) AS bigint)")).withColumn("low", F.lower("text")).drop("pieces")
    # plain substring searches, each far cheaper than one pattern of alternatives
    rows = rows.withColumn("gate", F.expr(" OR ".join(f"contains(low, '{k}')" for k in GATE) + f" OR (contains(low, 'cc') AND low RLIKE r'{SHORT}')"))
    words = f"concat(' ', trim(regexp_replace(translate(text, '{upper}', '{lower}'), r'[{OTHER}]+', ' ')), ' ')"
    rows = rows.withColumn("words", F.expr(f"CASE WHEN gate THEN {words} END"))
    # each rule's keyword and pattern are literals, so patterns are compiled once; only those of the few that match are needed again
    every = rules()
    hits = "array(" + ", ".join(f"CASE WHEN contains(words, '{key}') AND words RLIKE {_quoted(pattern)} THEN {i} END" for i, (_, _, _, key, pattern) in enumerate(every)) + ")"
    rows = rows.withColumn("hits", F.expr(f"CASE WHEN gate THEN {hits} END"))
    table = "array(" + ", ".join(f"struct('{label}' AS label, {priority} AS priority, {confidence}D AS confidence, {_quoted(pattern)} AS pattern)" for label, priority, confidence, _, pattern in every) + ")"
    # of each rule the matches and the pieces between them, and from the words in both the intervals of words
    rows = rows.withColumn("cut", F.expr(f"transform(transform(filter(hits, h -> h IS NOT NULL), h -> {table}[h]), r -> struct(r.label AS label, r.priority AS priority, r.confidence AS confidence, regexp_extract_all(words, r.pattern, 0) AS m, split(words, r.pattern, -1) AS p))"))
    rows = rows.withColumn("counted", F.expr(f"transform(cut, c -> struct(c AS c, transform(c.m, x -> {_words('x')}) AS m, transform(slice(c.p, 1, size(c.m)), x -> {_words('x')}) AS p))"))
    rows = rows.withColumn("placed", F.expr(f"transform(counted, d -> struct(d.c AS c, arrays_zip({running('zip_with(d.p, d.m, (a, b) -> a + b)')}, d.p, d.m) AS x))"))
    spans = "flatten(transform(placed, d -> transform(d.x, x -> struct(x.`0` + x.p AS first, x.`0` + x.p + x.m - 1 AS last, d.c.label AS label, d.c.priority AS priority, d.c.confidence AS confidence))))"
    rows = rows.withColumn("all", F.expr(f"CASE WHEN gate THEN {spans} ELSE cast(array() AS array<struct<first:bigint,last:bigint,label:string,priority:int,confidence:double>>) END"))
    rows = rows.withColumn("base_", F.expr("filter(all, d -> d.priority = 100)"))
    # what contains a detection, or ranks before it on the same words, comes before it in this order
    rows = rows.withColumn("line", F.expr("array_sort(transform(filter(all, d -> d.priority < 100), d -> struct(d.first AS first, -d.last AS to, -d.priority AS p, -d.confidence AS c, d.label AS label)))"))
    levels = sorted({priority for _, priority, _, _, _ in every if priority < 100})
    for level in levels:  # the furthest end so far of a detection of at least this priority
        rows = rows.withColumn(f"far_{level}", F.expr(running(f"transform(line, d -> if(-d.p >= {level}, -d.to, -1L))", MOST, "-1L")))
    far = "CASE -x.line.p " + " ".join(f"WHEN {level} THEN x.far_{level}" for level in levels) + " END"
    stay = f"transform(filter(arrays_zip(line, {', '.join(f'far_{level}' for level in levels)}), x -> {far} < -x.line.to), x -> struct(x.line.first AS first, -x.line.to AS last, x.line.label AS label, -x.line.p AS priority, -x.line.c AS confidence))"
    rows = rows.withColumn("found", F.expr(f"concat(base_, {stay})"))
    return rows.drop("low", "gate", "words", "hits", "cut", "counted", "placed", "all", "base_", "line", *(f"far_{level}" for level in levels))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of ``docs(doc_id, text, ...)``. No shuffle.

    ``score`` is the highest confidence of a detection, 0 without one. Null and empty texts have no words and no labels;
    repeated rows give repeated results.
    """
    rows = detect(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = rows.withColumn("base", F.expr("filter(found, d -> d.priority = 100)"))
    listed = lambda a: F.expr(f"array_join(array_sort(array_distinct(transform({a}, d -> d.label))), ',')")
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.expr("array_min(transform(base, d -> d.first))").alias("first_word"), F.expr("array_max(transform(base, d -> d.first))").alias("last_word"),
        listed("base").alias("base_labels"), listed("found").alias("labels"),
        F.expr("coalesce(array_max(transform(found, d -> d.confidence)), 0D)").alias("score"),
    )

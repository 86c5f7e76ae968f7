"""Mixing sources to target weights by hash-threshold histograms, with built-in functions only.

Each document has a hash from its doc_id. A source that must give r times its size takes every document
floor(r) times, and once more those whose hash lies under a threshold, chosen so that the extra words meet the rest of the budget.
The threshold is found by histograms: words are summed by (source, leading hash bits), the running sum names the
bucket in which the budget ends, and only documents of that boundary bucket are summed again by the next bits. Nothing is
sorted by hash, each histogram has a bounded number of buckets for a source, and thresholds are nested: a larger budget keeps
all documents that a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialise

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3  # times its size that a source, or a document, can give
LEVELS, BITS = 4, 10
WORD = r"[^\x20\x09-\x0D]+"


def word_count(column: str = "text"):
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def hash_bits():
    """40 bits of a document's hash; a null doc_id hashes like an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, LEVELS * BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sources in code point order, null last, weigh ``weights`` in turn. All sizes are shared by weight; a source stops at ``most`` times
    its size and the excess is shared again. That ends with the sources of the least most*size/weight at
    their limit and one share per weight for all others, which two running sums find.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weigh = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size") * most
    ranked = sizes.withColumn("weight", weigh).withColumn("ratio", limit / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    share = (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(by_ratio), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
    # the share if all sources before this one are at their limit; the first source that it doesn't fill sets it for good
    shared = ranked.withColumn("share", share).withColumn("fits", F.col("share") <= F.col("ratio"))
    first = shared.withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("ratio"), F.col("source").isNull().alias("o"), F.col("source"), F.col("share").alias("s")))).over(everything)["s"])
    return first.select("source", "source_size", F.when(F.col("level").isNull(), limit.cast("double")).otherwise(F.least(limit.cast("double"), F.col("level") * F.col("weight"))).alias("target"))


def thresholds(docs: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, source_size, target, base, upto): full copies of each document, and the hash under which one more is taken.

    ``docs(source, size, h)``. After the last level the boundary bucket, documents of one 40-bit hash, is taken whole if
    that brings the source nearer to its target.
    """
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = goal.withColumn("base", full).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")).withColumn("upto", F.lit(0).cast("long"))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    for level in range(1, LEVELS + 1):
        width = 1 << (BITS * (LEVELS - level))
        inside = docs.alias("d").join(state.alias("s"), same("d", "s") & (F.col("d.h") >= F.col("s.upto")) & (F.col("d.h") < F.col("s.upto") + width * (1 << BITS)))
        sums = inside.groupBy("d.source", F.floor(F.col("d.h") / width).cast("long").alias("bucket")).agg(F.sum("d.size").alias("words"))
        upto = Window.partitionBy("source").orderBy("bucket")
        running = sums.withColumn("done", F.sum("words").over(upto))
        met = running.alias("r").join(state.alias("s"), same("r", "s")).filter(F.col("done") > F.col("rest")).groupBy("s.source").agg(F.min(F.struct("bucket", (F.col("done") - F.col("r.words")).alias("before"), F.col("r.words").alias("words"))).alias("at"))
        # without a bucket beyond the budget (a source without words) all of the range fits
        state = materialise(state.alias("s").join(met.alias("m"), same("s", "m"), "left").select(
            "s.source", "source_size", "target", "base",
            (F.col("rest") - F.coalesce("at.before", F.lit(0))).alias("rest"),
            F.coalesce(F.col("at.bucket") * width, F.col("upto") + width * (1 << BITS)).alias("upto"),
            F.col("at.words").alias("words"),
        ))
    nearer = F.col("words").isNotNull() & (2 * F.col("rest") >= F.col("words")) & (F.col("base") < MOST)
    return state.select("source", "source_size", "target", "base", (F.col("upto") + nearer.cast("long")).alias("upto"))


def _limits(docs: DataFrame) -> DataFrame:
    rows = materialise(docs.select(F.col("source").cast("string").alias("source"), word_count().alias("size"), hash_bits().alias("h")))
    return thresholds(rows, materialise(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))))


def _taken(size, h):
    return size * (F.col("l.base") + (h < F.col("l.upto")).cast("long"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs(doc_id, source, text, ...)``.

    Null texts have no words; a null source is a source of its own, last in order; sources without words have target 0.
    Rows that share a doc_id share a hash, so they are taken alike; reruns agree. Empty tables give no rows.
    """
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), hash_bits().alias("h")))
    limits = thresholds(rows, materialise(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))))
    joined = rows.alias("d").join(limits.alias("l"), F.col("d.source").eqNullSafe(F.col("l.source")))
    return joined.select("doc_id", "size", "source_size", "target", _taken(F.col("size"), F.col("h")).alias("taken"))


def mixture(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns and ``taken``, the words it takes of each (repeats counted)."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(whole.alias("row"), F.col("source").cast("string").alias("source"), word_count().alias("size"), hash_bits().alias("h"))
    joined = rows.alias("d").join(_limits(docs).alias("l"), F.col("d.source").eqNullSafe(F.col("l.source")))
    return joined.select("row", _taken(F.col("size"), F.col("h")).alias("taken")).filter("taken > 0").select("row.*", "taken")


# The mix as one SQL statement: the rule in hash order, without histograms.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 10))::UBIGINT::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s
), r AS (
  SELECT *, (source_size * 3)::DOUBLE / weight AS ratio FROM w
), q AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER o, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS share
  FROM r WINDOW o AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lv AS (
  SELECT arg_min(share, (ratio, source IS NULL, source)) AS level FROM q WHERE share <= ratio
), t AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN (source_size * 3)::DOUBLE ELSE least((source_size * 3)::DOUBLE, level * weight) END AS target
  FROM q, lv
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM t
), g AS (
  SELECT source, h, sum(size)::BIGINT AS words FROM d GROUP BY source, h
), c AS (
  SELECT g.source, h, words, target - base * source_size AS rest, base,
         sum(words) OVER (PARTITION BY g.source ORDER BY h) AS done
  FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source
), f AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) AS n FROM c WHERE done > rest
), k AS (
  SELECT source, h + CASE WHEN 2 * (rest - (done - words)) >= words AND base < 3 THEN 1 ELSE 0 END AS upto FROM f WHERE n = 1
)
SELECT d.doc_id, d.size, b.source_size, b.target,
       (d.size * (b.base + CASE WHEN k.upto IS NULL OR d.h < k.upto THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""

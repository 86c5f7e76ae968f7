"""Distinct-count backends: exact sets, bottom-k hashes (KMV) with scaled difference, and Spark's Theta and HLL sketches.

A bottom-k sketch of a group is its ``k`` smallest distinct 64-bit hashes, as 16 hex digits, whose order is the
order of unsigned numbers. The bottom k of a union is the bottom k of the parts' bottom k, so sketches merge in any order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOP = 18446744073709551615.0


def key_hash(key: Column) -> Column:
    return F.substring(F.sha2(F.encode(key, "UTF-8"), 256), 1, 16)


def key_hash_blake2b(person: bytes = b"tidecount"):
    """A function of a key column: 64-bit BLAKE2b under a personalisation, where hashes must agree with sketches made elsewhere."""

    @F.pandas_udf(T.StringType())
    def hashed(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: hashlib.blake2b(k.encode(), digest_size=8, person=person).hexdigest(), na_action="ignore")

    return hashed


def unsigned(hex16: Column) -> Column:
    return F.conv(hex16, 16, 10).cast("decimal(20,0)").cast("double")


def bottom_k(rows: DataFrame, group: list[str], k: int, h: str = "h") -> DataFrame:
    """(group..., h, rank): the k smallest distinct hashes of each group; Spark limits each task's rows before the shuffle."""
    order = Window.partitionBy(*group).orderBy(h)
    return rows.select(*group, h).distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def kmv_estimate(n: Column, kth: Column, k: int) -> Column:
    """Exact below k hashes; from k on (k-1) over the k-th as a fraction of the hash range."""
    return F.when((n < k) | (unsigned(kth) <= 0), n.cast("double")).otherwise((k - 1) / (unsigned(kth) / F.lit(TOP)))


def kmv_count(rows: DataFrame, group: list[str], k: int, h: str = "h") -> DataFrame:
    """(group..., n, estimate) of a bottom-k sketch for each group."""
    kept = bottom_k(rows, group, k, h).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.max(h).alias("kth"))
    return kept.select(*group, "n", kmv_estimate(F.col("n"), F.col("kth"), k).alias("estimate"))


def daily_kmv(rows: DataFrame, group: list[str], k: int, h: str = "h") -> DataFrame:
    """(group..., sketch): the sorted bottom-k hashes of each group as an array; at most k of them are ever gathered."""
    return bottom_k(rows, group, k, h).groupBy(*group).agg(F.array_sort(F.collect_list(h)).alias("sketch"))


def rolling_kmv(pairs: DataFrame, days: DataFrame, window_days: int, k: int, user: str = "user_id") -> DataFrame:
    """(day, users): the bottom-k estimate of distinct users in the ``window_days`` days up to each of ``days``.

    Days' sketches are merged, so at most k rows a day are spread over windows, however many users there are.
    """
    own = bottom_k(pairs.select("day", key_hash(F.col(user)).alias("h")), ["day"], k).select("h", F.explode(F.sequence("day", F.date_add("day", window_days - 1))).alias("day"))
    counted = kmv_count(own.join(days, "day", "left_semi"), ["day"], k).select("day", F.col("estimate").alias("users"))
    return days.join(counted, "day", "left").select("day", F.coalesce("users", F.lit(0.0)).alias("users"))


def union_hierarchy(pairs: DataFrame, edge: str, gateways: int, name: str) -> DataFrame:
    """(day, estimate): sketches made at each edge, united at its gateway, and the gateways' united in the middle."""
    kind = backend(name)
    edges = pairs.groupBy("day", edge).agg(kind.build("user_id").alias("sketch"))
    gate = edges.groupBy("day", F.pmod(F.xxhash64(edge), F.lit(gateways)).alias("gateway")).agg(kind.merge("sketch").alias("sketch"))
    return gate.groupBy("day").agg(kind.merge("sketch").alias("sketch")).select("day", kind.estimate("sketch").alias("estimate"))


def packed(sketch: Column, k: int) -> Column:
    """A sketch of 16-digit hashes as ``pack`` would write it, in hex."""
    return F.concat(F.lit(f"{k:08x}"), F.lower(F.lpad(F.hex(F.size(sketch)), 8, "0")), F.array_join(sketch, ""))


def unpacked(text: Column, k: int) -> Column:
    """The first ``k`` hashes of a packed sketch in hex; a length that doesn't fit is an error."""
    n = F.conv(F.substring(text, 9, 8), 16, 10).cast("int")
    whole = F.when(F.length(text) == 16 + 16 * n, text).otherwise(F.raise_error(F.lit("not a packed sketch")).cast("string"))
    return F.slice(F.regexp_extract_all(F.substring(whole, 17, 1 << 30), F.lit("([0-9a-f]{16})"), F.lit(1)), 1, k)


def kmv_difference(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(survivors, estimate) of A without B, each a table of hashes ``h``.

    Only hashes under both sketches' thresholds are compared, and the survivors are scaled by the smaller threshold; counting
    them unscaled would be off by the sampling rate.
    """
    left, right = bottom_k(a, [], k).select("h"), bottom_k(b, [], k).select("h")

    def theta(side: DataFrame) -> DataFrame:
        return side.agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("kth")).select(F.when(F.col("n") < k, F.lit("g")).otherwise(F.col("kth")).alias("limit"))

    limit = theta(left).union(theta(right)).agg(F.min("limit").alias("limit"))  # "g" lies above all hashes
    one = F.broadcast(limit.withColumn("one", F.lit(1)))  # a single row, met by a constant key
    kept = left.join(right, "h", "left_anti").withColumn("one", F.lit(1)).join(one, "one").filter("h < limit")
    n = kept.agg(F.count(F.lit(1)).alias("survivors")).withColumn("one", F.lit(1)).join(one, "one")
    return n.select("survivors", F.when(F.col("limit") == "g", F.col("survivors").cast("double")).otherwise(F.col("survivors") / (unsigned(F.col("limit")) / F.lit(TOP))).alias("estimate"))


def bloom_size(n: Column, rate: float) -> tuple[Column, Column]:
    """Bits and hash functions of a Bloom filter for n keys at a false-positive rate."""
    p = min(max(rate, 1e-6), 1 - 1e-6)
    bits = F.greatest(F.lit(8), F.ceil(-n * math.log(p) / (math.log(2) ** 2))).cast("long")
    return bits, F.greatest(F.lit(1), F.rint(bits / F.greatest(n, F.lit(1)) * math.log(2))).cast("long")


@dataclass(frozen=True)
class Backend:
    """How to count distinct keys: an aggregate that makes a sketch, one that merges sketches, and an estimate of one.

    ``room`` is the number of keys that a sketch holds as they are, so that its estimate is their count; 0 where it may be off for any number.
    """

    build: Callable[[str], Column]
    merge: Callable[[str], Column]
    estimate: Callable[[str], Column]
    room: int = 0


BACKENDS: dict[str, Backend] = {}


def register(name: str, backend: Backend) -> None:
    BACKENDS[name] = backend


def backend(name: str) -> Backend:
    if name not in BACKENDS:
        raise KeyError(f"no sketch {name!r}; known: {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name]


def _kmv(k: int) -> Backend:
    """A KMV sketch as a sorted array in one column, for groups whose distinct keys fit a row; ``bottom_k`` has no such bound."""
    cut = lambda a: F.slice(F.array_sort(F.array_distinct(a)), 1, k)
    return Backend(
        build=lambda key: cut(F.collect_set(key_hash(F.col(key)))),
        merge=lambda s: cut(F.flatten(F.collect_list(s))),
        estimate=lambda s: kmv_estimate(F.size(s), F.element_at(s, -1), k),
        room=k - 1,
    )


def _set() -> Backend:
    """Sets are exact at any size; their room is what a row should hold."""
    return Backend(
        build=lambda key: F.array_sort(F.collect_set(key)),
        merge=lambda s: F.array_sort(F.array_distinct(F.flatten(F.collect_list(s)))),
        estimate=lambda s: F.size(s).cast("double"),
        room=4096,
    )


register("set", _set())
register("kmv", _kmv(4096))
register("theta", Backend(lambda key: F.theta_sketch_agg(key), lambda s: F.theta_union_agg(s), lambda s: F.theta_sketch_estimate(s).cast("double"), room=4096))
register("hll", Backend(lambda key: F.hll_sketch_agg(key), lambda s: F.hll_union_agg(s), lambda s: F.hll_sketch_estimate(s).cast("double")))


def shard_count(rows: DataFrame, *names: str, key: str = "user_id") -> int:
    """How many shards of the keys of ``rows`` leave the named sketches exact: a shard takes half of a sketch's room on average.

    Keys are dealt by their hashes, so a shard of twice the average, some 2,000 keys, doesn't occur.
    """
    room = min(backend(name).room for name in names)
    if room < 2:
        raise ValueError(f"no number of shards makes these sketches exact: {', '.join(names)}")
    return max(1, math.ceil(rows.agg(F.count_distinct(key)).first()[0] / (room // 2)))


def shard(key: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards))


def daily_sketches(pairs: DataFrame, name: str, key: str = "user_id", shards: int = 1) -> DataFrame:
    """(day, sketch, sketch_impl); (day, shard, sketch, sketch_impl) with several shards of the keys."""
    by = ["day", shard(key, shards).alias("shard")] if shards > 1 else ["day"]
    return pairs.groupBy(*by).agg(backend(name).build(key).alias("sketch")).withColumn("sketch_impl", F.lit(name))


def merged(sketches: DataFrame, group: list[str] | None = None, empty: str = "set") -> DataFrame:
    """The union of sketches of one kind, for each group; mixed kinds are an error. Of shards, which share no key, the sum of the estimates is left.

    A table without rows is read as sketches of the kind ``empty``.
    """
    kinds = [r[0] for r in sketches.select("sketch_impl").distinct().limit(2).collect()]
    if len(kinds) > 1:
        raise TypeError(f"sketches of different kinds: {', '.join(sorted(kinds))}")
    kind = backend(kinds[0] if kinds else empty)
    by, shards = group or [], [c for c in sketches.columns if c == "shard"]
    out = sketches.groupBy(*by, *shards).agg(kind.merge("sketch").alias("sketch")).withColumn("estimate", kind.estimate("sketch"))
    return out.groupBy(*by).agg(F.coalesce(F.sum("estimate"), F.lit(0.0)).alias("estimate")) if shards else out


def pack(hashes: Iterator[str], k: int) -> bytes:
    """A sketch as bytes: k and the number of hashes, then the hashes, all big-endian."""
    body = b"".join(bytes.fromhex(h) for h in hashes)
    return k.to_bytes(4, "big") + (len(body) // 8).to_bytes(4, "big") + body


def unpack(raw: bytes, k: int | None = None) -> list[str]:
    """The hashes of packed bytes, no more than ``k``; truncated bytes are an error."""
    if len(raw) < 8 or len(raw) != 8 + 8 * int.from_bytes(raw[4:8], "big"):
        raise ValueError("not a packed sketch")
    return [raw[i : i + 8].hex() for i in range(8, len(raw), 8)][: k or int.from_bytes(raw[:4], "big")]

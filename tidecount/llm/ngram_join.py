"""Similarity join on word shingles: documents whose Jaccard similarity reaches a threshold, and their components.

1. Each text becomes the sorted set of its distinct shingle hashes. Equal sets collapse to one class, so copies are never
   paired with each other. A class keeps a hashed bitmap of its set (two to four bits a shingle).
2. Classes that share a band key (40 keys of 3 minhashes) share a tile. A pair at similarity 0.75 has no common key with
   probability below 4e-10; that is the only chance in the method, and no tile is capped.
3. A tile's members are first compared with its smallest member alone: with one such leader each, then, where that left
   two members of a tile unconnected, with its other leaders. Work and copies of sets grow with the members, not with their pairs.
4. Tiles whose members are still not all connected are cut by size band; where one is large, by hash too, into tiles that meet in
   pairs. The bitmaps alone cross that exchange: bits set in one and not in the other bound the overlap from above.
   Only members with a partner within the bound, and not connected with it, go on to exact intersections of the sorted arrays.
   Tiles return spanning edges only, never all pairs.
5. Connected components of those edges, and of the classes that rows of one doc_id hold.

Null and empty texts have the empty set and link with nothing. Rows that share a doc_id are one document: what links with any of its texts links
with it, whatever the order of the rows; its rows without words keep its own doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import among, as_bytes, bit_filter, materialise
from ._text import U, chunks, hash_words, join_words, mix, space_words
from .components import components

BANDS, ROWS = 40, 3
TILE = 200_000  # shingles in a tile, a member counting as MEMBER of them at least
MEMBER = 200
ALONE = 2  # members of a tile whose leader settles it

_SEED = np.random.Generator(np.random.PCG64(20240229))
_FACTORS = _SEED.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)
_POWERS = _SEED.integers(0, 2**63, 64, dtype=np.uint64) * U(2) + U(1)


def shingle_sets(raws: list[bytes | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words has none."""
    words, ends = join_words([r.lower() if r else r for r in raws], space_words)
    hashes = hash_words(words)
    grams = np.zeros(max(0, len(hashes) - width + 1), U)
    for k in range(width):
        grams += hashes[k : k + len(grams)] * _POWERS[k]
    grams = mix(grams)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            short = hashes[a:b]
            out.append(mix((short * _POWERS[width : width + b - a]).sum(keepdims=True) + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def _bits(n: int) -> int:
    return 1 << max(8, min(17, math.ceil(math.log2(2 * n))))


def _bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """A set's hashed bitmap; half as many bits are the two halves of it, joined by or."""
    flags = np.zeros(bits, bool)
    flags[(s >> U(40)).astype(np.int64) & (bits - 1)] = True
    return np.packbits(flags, bitorder="little")


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "raw"):
            sets = shingle_sets(batch.column("raw").to_pylist(), width)
            n = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(n)
            values = np.concatenate(sets) if len(some) else np.zeros(0, U)
            starts = np.concatenate([[0], np.cumsum(n[some])[:-1]]).astype(np.int64) if len(some) else np.zeros(0, np.int64)
            d1, d2 = np.zeros(len(n), U), np.zeros(len(n), U)
            least = np.zeros((len(n), BANDS * ROWS), U)
            if len(some):
                d1[some] = np.add.reduceat(mix(values), starts)
                d2[some] = np.add.reduceat(mix(values ^ U(0x9E3779B97F4A7C15)), starts)
                for k, factor in enumerate(_FACTORS):
                    least[some, k] = np.minimum.reduceat(values * factor, starts)
            least = mix(least)
            bands = np.zeros((len(n), BANDS), U)
            for r in range(ROWS):
                bands += least[:, r::ROWS] * _POWERS[32 + r]
            bands = mix(bands + np.arange(BANDS, dtype=U) * _POWERS[40])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("t"), batch.column("u"), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                    pa.array([_bitmap(s, _bits(len(s))).tobytes() if len(s) else b"" for s in sets], pa.binary()), pa.array([row.tobytes() for row in bands], pa.binary()),
                ],
                [c.split()[0] for c in SIGNED.split(", ")],
            )

    return run


SIGNED = "doc_id long, t long, u long, n long, d1 long, d2 long, bitmap binary, bands binary"


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, id) for each key of each class."""
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column("id").to_numpy(), BANDS))], ["band", "id"])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "raw"):
            sets = shingle_sets(batch.column("raw").to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "held"])

    return run


class _Forest:
    """Components of a few rows, each with the smallest row as its label."""

    def __init__(self, labels: np.ndarray):
        self.label = np.unique(labels, return_index=True, return_inverse=True)
        self.label = self.label[1][self.label[2]]

    def join(self, i: int, j: int) -> None:
        a, b = sorted((self.label[i], self.label[j]))
        self.label[self.label == b] = a


def _fits(low: int, high: np.ndarray, common: np.ndarray, ones_low: int, ones_high: np.ndarray, percent: int) -> np.ndarray:
    """Whether the overlap can reach the threshold: a bit that only one bitmap has stands for an element that only one set has."""
    bound = np.minimum(low - ones_low + common, high - ones_high + common)
    return (100 + percent) * bound >= percent * (low + high)


def linked(sets: list[np.ndarray], side: np.ndarray | None, percent: int, labels: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Spanning edges of the rows whose similarity is ``percent`` or more; with ``side`` only across its two values. Rows of one label are connected already."""
    order = np.array(sorted(range(len(sets)), key=lambda i: len(sets[i])), int)
    size = np.array([len(sets[i]) for i in order])
    bits = 2 * _bits(int(size[-1]))
    bitmap = np.stack([_bitmap(sets[i], bits) for i in order]).view(np.uint64)
    ones = np.bitwise_count(bitmap).sum(1).astype(np.int64)
    forest = _Forest(order if labels is None else labels[order])
    across = side[order] if side is not None else None
    for i in range(len(order) - 1):
        if not size[i]:
            continue
        end = np.searchsorted(size, size[i] * 100 // percent, side="right")
        js = np.arange(i + 1, end)
        js = js[forest.label[js] != forest.label[i]]
        if across is not None:
            js = js[across[js] != across[i]]
        for part in np.array_split(js, max(1, len(js) * bitmap.shape[1] // 4_000_000)):
            if not len(part):
                continue
            common = np.bitwise_count(bitmap[part] & bitmap[i]).sum(1).astype(np.int64)
            for j in part[_fits(size[i], size[part], common, ones[i], ones[part], percent)].tolist():
                if forest.label[i] == forest.label[j]:
                    continue
                both = len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True))
                if 100 * both >= percent * (size[i] + size[j] - both):
                    forest.join(i, j)
                    yield int(order[i]), int(order[j])


def partners(bitmaps: list[bytes], size: np.ndarray, side: np.ndarray | None, labels: np.ndarray, percent: int) -> np.ndarray:
    """Whether each row has a row of another label (and side) that the bitmaps can't rule out. Rows are compared within their size band and with the next."""
    out = np.zeros(len(size), bool)
    band = np.floor(np.log(size) / -math.log(percent / 100) + 1e-9).astype(int)
    for b in np.unique(band):
        at = np.flatnonzero((band == b) | (band == b + 1))
        at = at[np.argsort(size[at], kind="stable")]
        wide = min(len(bitmaps[i]) for i in at)
        held = np.stack([np.bitwise_or.reduce(np.frombuffer(bitmaps[i], np.uint8).reshape(-1, wide)) for i in at]).view(np.uint64)
        ones = np.bitwise_count(held).sum(1).astype(np.int64)
        n = size[at]
        for i in range(int((band[at] == b).sum())):
            js = np.arange(i + 1, np.searchsorted(n, n[i] * 100 // percent, side="right"))
            js = js[labels[at[js]] != labels[at[i]]]
            if side is not None:
                js = js[side[at[js]] != side[at[i]]]
            for part in np.array_split(js, max(1, len(js) * held.shape[1] // 4_000_000)):
                if len(part):
                    common = np.bitwise_count(held[part] & held[i]).sum(1).astype(np.int64)
                    good = part[_fits(n[i], n[part], common, ones[i], ones[part], percent)]
                    if len(good):
                        out[at[good]] = out[at[i]] = True
    return out


def _grouped(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """The groups of a tile: name, rows and, where there are two, sides."""
    groups, sides = table.column("grp").to_numpy(), table.column("side").to_numpy()
    order = np.argsort(groups, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1):
        yield groups[at[0]], at, sides[at] if (sides[at] != sides[at[0]]).any() else None


def _exact(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids, labels, held = table.column("id").to_numpy(), table.column("label").to_numpy(), table.column("held").to_pylist()
        left, right = [], []
        for _, at, side in _grouped(table):
            for i, j in linked([np.frombuffer(held[k], U) for k in at], side, percent, labels[at]) if len(at) > 1 else ():
                left.append(ids[at[i]])
                right.append(ids[at[j]])
        return pa.table([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _bounded(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids, labels, bitmaps, size = table.column("id").to_numpy(), table.column("label").to_numpy(), table.column("bitmap").to_pylist(), table.column("n").to_numpy()
        group, left = [], []
        for g, at, side in _grouped(table):
            for k in at[partners([bitmaps[k] for k in at], size[at], side, labels[at], percent)]:
                group.append(g)
                left.append(ids[k])
        return pa.table([pa.array(group, pa.int64()), pa.array(left, pa.int64())], names=["grp", "id"])

    return run


def _weight(n: str = "n"):
    return F.greatest(F.col(n), F.lit(MEMBER))


def _packs(rows: DataFrame) -> int:
    """How many tiles share the groups of at most a quarter of one."""
    return max(1, math.ceil((rows.agg(F.sum(_weight())).first()[0] or 0) / TILE * 2))


def _stars(pairs: DataFrame) -> DataFrame:
    """(id, grp, tile, side) from ``pairs(lead, id, n)``: each leader meets its members, in parts of bounded size."""
    total = materialise(pairs.groupBy("lead").agg(F.ceil(F.sum(_weight()) / (TILE // 4)).alias("q")))
    placed = materialise(pairs.join(total, "lead").withColumn("grp", F.xxhash64("lead", F.pmod(F.xxhash64("id"), F.col("q")))))
    every = placed.select("id", "grp", F.lit(1).alias("side")).union(placed.select("lead", "grp", F.lit(0)).distinct())
    return every.withColumn("tile", F.pmod(F.xxhash64("grp", F.lit(1)), F.lit(_packs(placed))).cast("string"))


def _tiles(member: DataFrame, percent: int) -> DataFrame:
    """(id, grp, tile, side) from ``member(id, grp, n)``: small groups share a tile, others have one of their own; one of over two tiles' weight is cut by size band and hash into tiles that meet in pairs.

    A band spans one threshold ratio of sizes, so linked rows lie in the same or the next band.
    """
    total = materialise(member.groupBy("grp").agg(F.sum(_weight()).alias("weight")))
    member = member.join(total, "grp")
    little = member.filter(F.col("weight") <= TILE // 4)
    small = little.select("id", "grp", F.concat_ws(":", F.lit("s"), F.pmod(F.xxhash64("grp"), F.lit(_packs(little)))).alias("tile"), F.lit(0).alias("side"))
    own = member.filter((F.col("weight") > TILE // 4) & (F.col("weight") <= 2 * TILE)).select("id", "grp", F.concat_ws(":", F.lit("g"), "grp").alias("tile"), F.lit(0).alias("side"))
    band = F.floor(F.log(F.greatest("n", F.lit(1)) + F.lit(0.0)) / F.lit(-math.log(percent / 100)) + 1e-9).cast("int")
    large = member.filter(F.col("weight") > 2 * TILE).withColumn("band", band)
    cut = materialise(large.groupBy("grp", "band").agg(F.ceil(F.sum(_weight()) / F.lit(TILE)).cast("int").alias("q")))
    upper = cut.select("grp", (F.col("band") - 1).alias("band"), F.col("q").alias("up"))
    lower = cut.select("grp", (F.col("band") + 1).alias("band"), F.col("q").alias("down"))
    part = F.pmod(F.xxhash64("id"), F.col("q")).cast("int")
    placed = large.join(cut, ["grp", "band"]).join(upper, ["grp", "band"], "left").join(lower, ["grp", "band"], "left").withColumn("part", part)
    same = F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda x: F.struct(F.col("band").alias("b1"), F.least(x, "part").alias("p1"), F.col("band").alias("b2"), F.greatest(x, "part").alias("p2"), (F.col("part") > x).cast("int").alias("side")))
    above = F.when(F.col("up").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("up") - 1), lambda x: F.struct(F.col("band").alias("b1"), F.col("part").alias("p1"), (F.col("band") + 1).alias("b2"), x.alias("p2"), F.lit(0).alias("side"))))
    below = F.when(F.col("down").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda x: F.struct((F.col("band") - 1).alias("b1"), x.alias("p1"), F.col("band").alias("b2"), F.col("part").alias("p2"), F.lit(1).alias("side"))))
    meet = placed.select("id", "grp", F.explode(F.concat(same, F.coalesce(above, F.array()), F.coalesce(below, F.array()))).alias("t"))
    return small.union(own).union(meet.select("id", "grp", F.concat_ws(":", F.lit("l"), "grp", "t.b1", "t.p1", "t.b2", "t.p2").alias("tile"), "t.side"))


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    return rows.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _label(links: DataFrame) -> DataFrame:
    """(id, label) of the classes in components of more than one."""
    found = components(links)
    return materialise(found.select(F.col("a").alias("id"), F.col("b").alias("label")))


def _verified(tiles: DataFrame, sets: DataFrame, label: DataFrame | None, percent: int) -> DataFrame:
    """The edges (a, b) found in ``tiles(id, grp, tile, side)``."""
    rows = _labelled(tiles, label) if label is not None else tiles.withColumn("label", F.col("id"))
    return materialise(rows.join(sets, "id").groupBy("tile").applyInArrow(_exact(percent), "a long, b long"))


def _roots(reps: DataFrame, raw: DataFrame, bound: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, label) of the components of all linked classes of ``reps(id, n, t, u, bitmap, bands)`` and of the edges ``bound(a, b)``, those of one class left out."""
    spread = reps.select("id", "bands").mapInArrow(_opened, "band long, id long")
    shared = materialise(spread.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("lead")).filter("c > 1"))
    held = bit_filter(shared, "band")
    rows = materialise(among(spread, "band", held).join(shared, "band"))
    held.drop()
    # the sets of the classes that share a key with another
    needed = materialise(reps.join(rows.select("id").distinct(), "id", "left_semi").select("id", "t", "u"))
    held = bit_filter(needed, "t")
    texts = among(raw.select("t", "u", "raw"), "t", held).groupBy("t", "u").agg(F.first("raw").alias("raw"))
    sets = materialise(texts.join(needed, ["t", "u"]).select("id", "raw").mapInArrow(_sets(width), "id long, held binary"))
    held.drop()
    sizes = reps.select("id", "n")

    member = rows.filter("id <> lead")
    first = member.groupBy("id").agg(F.min("lead").alias("lead"))
    links = _verified(_stars(materialise(first.join(sizes, "id"))), sets, None, percent)
    # each has one leader so far, whose own leader need not be followed: labels only save work
    label = materialise(links.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("label")))
    pairs = _labelled(member.select("id", "lead").distinct(), label).withColumnRenamed("label", "mine")
    pairs = pairs.join(label.select(F.col("id").alias("lead"), "label"), "lead", "left").filter(F.col("mine") != F.coalesce("label", "lead")).select("id", "lead")
    others = materialise(pairs.join(first, ["id", "lead"], "left_anti").join(sizes, "id"))
    links = links.union(_verified(_stars(others), sets, label, percent))
    label = _label(links)

    rest = materialise(_labelled(rows.filter(F.col("c") > ALONE).select("band", "id"), label))
    mixed = rest.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h")).filter("lo < hi")
    once = materialise(mixed.groupBy("lo", "hi", "m", "h").agg(F.min("band").alias("band")).select("band"))  # tiles of the same members are one
    left = materialise(rest.join(once, "band").join(sizes, "id").select("id", F.col("band").alias("grp"), "n"))
    tiles = _labelled(_tiles(left, percent), label).join(reps.select("id", "n", "bitmap"), "id")
    near = tiles.groupBy("tile").applyInArrow(_bounded(percent), "grp long, id long").distinct()
    again = _tiles(materialise(near.join(sizes, "id")), percent)
    # the graph of what is connected so far has few edges left
    edges = _verified(again, sets, label, percent).union(bound)
    ends = _labelled(_labelled(edges.withColumnRenamed("a", "id"), label).select("label", F.col("b").alias("id")).withColumnRenamed("label", "a"), label).select("a", F.col("label").alias("b"))
    late = _label(ends)
    every = _labelled(reps.select("id"), label).select("id", F.col("label").alias("l"))
    return every.join(late.select(F.col("id").alias("l"), F.col("label").alias("top")), "l", "left").select("id", F.coalesce("top", "l").alias("label")).filter("id <> label")


def similarity_components(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs(doc_id, text, ...)``.

    Two documents link when their distinct ``width``-word shingles have a Jaccard similarity of
    ``percent`` % or more; component_id is the smallest doc_id that links reach. A null doc_id is
    reached by nothing and has the smallest that its text reaches, or null. Empty tables give no rows.
    """
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("raw"))
    raw = raw.withColumn("t", F.xxhash64("raw")).withColumn("u", F.xxhash64(F.lit("u"), "raw"))
    signed = materialise(raw.select("doc_id", "t", "u", "raw").mapInArrow(_signatures(width), SIGNED))
    full = signed.filter("n > 0")
    same = full.groupBy("d1", "d2").agg(F.min(F.struct("t", "u")).alias("k"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.first("bands").alias("bands"))
    # the classes' numbers are whatever this table says, once it is written
    reps = materialise(same.select(F.monotonically_increasing_id().alias("id"), "d1", "d2", "k.t", "k.u", "least", "n", "bitmap", "bands"))
    # classes that one doc_id holds
    torn = materialise(full.filter("doc_id is not null").groupBy("doc_id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi"), F.min("d2").alias("lo2"), F.max("d2").alias("hi2")).filter("lo < hi OR lo2 < hi2").select("doc_id"))
    held = materialise(full.join(torn, "doc_id").select("doc_id", "d1", "d2").join(reps.select("id", "d1", "d2"), ["d1", "d2"]).select("doc_id", "id").distinct())
    bound = held.join(held.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b"))
    root = materialise(_labelled(reps.select("id", "d1", "d2", "least"), _roots(reps, raw, bound, width, percent)))
    least = materialise(root.groupBy("label").agg(F.min("least").alias("component_id")))
    named = materialise(root.join(least, "label").select("d1", "d2", "component_id"))
    rows = signed.select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that represent their component: its smallest doc_id, once.

    Documents without words all stay, as do rows with a null doc_id, which nothing can tell apart. Of rows that share a doc_id the one whose columns have the
    least hash stays, whatever their order.
    """
    kept = similarity_components(docs, width, percent).filter("doc_id = component_id").select("doc_id").distinct()
    whole, nulls = F.struct(*(F.col(f"`{c}`") for c in docs.columns)), docs.filter("doc_id is null")
    rows = docs.select("doc_id", whole.alias("row"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("h")).join(kept, "doc_id", "left_semi")
    return rows.groupBy("doc_id").agg(F.min_by("row", "h").alias("row")).select("row.*").union(nulls)

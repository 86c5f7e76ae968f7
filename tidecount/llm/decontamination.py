"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` turns the documents into segments of a few megabytes of text and stores, for each, its terms and their
postings: ascending token positions, as gaps. Segments are partitioned by document, so building and searching shuffle nothing, and
a stored index answers any number of benchmarks.

``search`` answers each benchmark window of ten words from its rarest terms: the rarest one's postings, less its offset in the
window, are the candidate starts; the postings of the next rarest, adjusted alike, are intersected with them, until all terms
agree (phrase match) or no start is left. A proximity match asks for a window's three terms that are rarest in the whole index (its stored counts are
added up first), the second and third each within 20 words of the first.

Items are sent to the segments in blocks of at most ``BLOCK_BYTES`` of text, so what is broadcast has a fixed bound however many there are.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import as_bytes, materialise, share
from ._text import alnum_words, chunks, join_words

WIDTH = 10
SPAN = 20
CHUNK = 6 << 20  # of text in one segment
BLOCK_BYTES = 2 << 20  # of item text in one broadcast block: some 400,000 windows of 40 bytes on a worker
SEGMENT = "segment string, doc_ids array<long>, ends array<int>, terms binary, counts binary, gaps binary"
MATCHES = "segment string, place int, doc_id long, n_words long, hits array<long>, items array<string>, near_items array<string>"


class Queries:
    """The distinct windows of a block of benchmark items, as one matrix of term numbers (-1 behind a shorter item's), with the items that hold each."""

    def __init__(self, items: list[tuple[str, bytes]], width: int = WIDTH):
        number: dict[bytes, int] = defaultdict(count().__next__)
        parts, owner = [np.zeros((0, width), np.int32)], []
        self.names = sorted({item for item, _ in items})
        place = {item: i for i, item in enumerate(self.names)}
        for item, raw in items:
            ids = np.array([number[w] for w in alnum_words(raw)], np.int32)
            if len(ids):
                ids = np.concatenate([ids, np.full(max(0, width - len(ids)), -1, np.int32)])
                parts.append(np.lib.stride_tricks.sliding_window_view(ids, width))
                owner.append(np.full(len(parts[-1]), place[item]))
        self.terms = list(number)
        every, at = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
        self.windows = np.ascontiguousarray(every)
        held = np.unique(np.stack([at.reshape(-1), np.concatenate(owner)]), axis=1) if owner else np.zeros((2, 0), np.int64)
        self.first, self.held = np.searchsorted(held[0], np.arange(len(every) + 1)), held[1].astype(np.int32)
        self.keys = np.zeros((0, 3), np.int32)
        self.near = np.zeros(0, np.int64)

    def rank(self, counts: dict[int, int]) -> Queries:
        """Sets for each window its three rarest distinct terms, by their counts in the corpus, then by bytes; windows with the same ones are asked once."""
        order = sorted(range(len(self.terms)), key=lambda t: (counts.get(t, 0), self.terms[t]))
        rank = np.empty(len(order) + 1, np.int32)
        rank[order] = np.arange(len(order))
        rank[-1] = len(order)  # for -1
        ranks = np.sort(rank[self.windows], axis=1)
        ranks[:, 1:][ranks[:, 1:] == ranks[:, :-1]] = len(order)
        back = np.array([*order, -1], np.int32)
        self.keys, at = np.unique(back[np.sort(ranks, axis=1)[:, :3]], axis=0, return_inverse=True)
        self.near = at.reshape(-1)
        return self

    def items(self, windows: np.ndarray) -> set[int]:
        return {int(i) for w in windows for i in self.held[self.first[w] : self.first[w + 1]]}

    def bound(self, number: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of ``table`` of which a segment holds all terms, and these by the segment's numbers."""
        here = np.where(table < 0, -2, number[table]) if len(number) else np.full(table.shape, -1)
        rows = np.flatnonzero((here != -1).all(1))
        return rows, here[rows]


class Postings:
    """A segment: for each term its ascending token positions; ``ends`` bound the documents' tokens."""

    def __init__(self, ends: np.ndarray, terms: list[bytes], counts: np.ndarray, positions: np.ndarray):
        self.ends, self.terms, self.counts, self.positions = ends, terms, counts, positions
        self.first = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])

    @classmethod
    def of_texts(cls, raws: list[bytes | None]) -> Postings:
        words, ends = join_words(raws, alnum_words)
        number: dict[bytes, int] = defaultdict(count().__next__)
        token = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
        return cls(ends, list(number), np.bincount(token, minlength=len(number)), np.argsort(token, kind="stable"))

    @classmethod
    def stored(cls, ends: list[int], terms: bytes, counts: bytes, gaps: bytes) -> Postings:
        number = np.frombuffer(counts, np.int32).astype(np.int64)
        run = np.cumsum(np.frombuffer(gaps, np.int32), dtype=np.int64)
        start = np.cumsum(number) - number
        base = np.where(start > 0, run[start - 1], 0) if len(number) else run
        return cls(np.array(ends, np.int64), terms.split(), number, run - np.repeat(base, number))

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """Terms, counts and gaps; the first gap of a term is its first position."""
        gaps = np.diff(self.positions, prepend=0)
        heads = self.first[:-1]
        gaps[heads] = self.positions[heads]
        return b" ".join(self.terms), self.counts.astype(np.int32).tobytes(), gaps.astype(np.int32).tobytes()

    def owner(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends[1:], position, side="right")

    def of(self, term: int) -> np.ndarray:
        return self.positions[self.first[term] : self.first[term + 1]]

    def phrases(self, window: np.ndarray) -> np.ndarray:
        """Starts of the exact window, given by this segment's terms."""
        order = np.argsort(self.counts[window], kind="stable")
        start = self.of(window[order[0]]) - order[0]
        for k in order[1:]:
            if not len(start):
                return start
            there = self.of(window[k])
            at = np.searchsorted(there, start + k)
            start = start[there[np.minimum(at, len(there) - 1)] == start + k]
        start = start[start >= 0]
        return start[self.owner(start) == self.owner(start + len(window) - 1)]

    def near(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the first key around which each other one occurs in the same text, under ``SPAN`` words away."""
        at = self.of(keys[0])
        for term in keys[1:]:
            if term < 0 or not len(at):
                return at
            text = self.owner(at)
            low, high = np.maximum(at - SPAN + 1, self.ends[text]), np.minimum(at + SPAN - 1, self.ends[text + 1] - 1)
            there = self.of(term)
            at = at[np.searchsorted(there, low, "left") < np.searchsorted(there, high, "right")]
        return at

    def bound(self, queries: Queries) -> np.ndarray:
        """This segment's number of each query term, -1 where it doesn't occur."""
        place = {t: i for i, t in enumerate(self.terms)}
        return np.array([place.get(t, -1) for t in queries.terms], np.int64)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "raw", CHUNK):
        index = Postings.of_texts(batch.column("raw").to_pylist())
        terms, counts, gaps = index.packed()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([uuid.uuid4().hex]), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([index.ends.tolist()], pa.list_(pa.int32())),
                pa.array([terms], pa.binary()), pa.array([counts], pa.binary()), pa.array([gaps], pa.binary()),
            ],
            ["segment", "doc_ids", "ends", "terms", "counts", "gaps"],
        )


def build_index(docs: DataFrame) -> DataFrame:
    """The stored segments of ``docs(doc_id, text, ...)``, in the shared folder."""
    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("raw")).mapInArrow(_build, SEGMENT), codec="zstd")


def _search(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = block()
        names = queries.names
        for row in (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows)):
            index = Postings.stored(row["ends"], row["terms"], row["counts"], row["gaps"])
            n = len(row["doc_ids"])
            bound = index.bound(queries)
            hit = np.zeros(index.ends[-1] + 1, np.int64)
            items: dict[int, set[int]] = {}
            close: dict[int, set[int]] = {}
            rows, here = queries.bound(bound, queries.windows)
            for at, window in zip(rows.tolist(), here, strict=True):
                window = window[window >= 0]
                start = index.phrases(window)
                if len(start):
                    np.add.at(hit, start, 1)
                    np.add.at(hit, start + len(window), -1)
                    held = queries.items([at])
                    for d in np.unique(index.owner(start)).tolist():
                        items.setdefault(d, set()).update(held)
            rows, here = queries.bound(bound, queries.keys)
            met: dict[int, list[int]] = {}
            for at, keys in zip(rows.tolist(), here, strict=True):
                for d in np.unique(index.owner(index.near(keys))).tolist():
                    met.setdefault(d, []).append(at)
            for d, some in met.items():
                close[d] = queries.items(np.flatnonzero(np.isin(queries.near, some)))
            covered = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
            where = np.split(covered, np.searchsorted(covered, index.ends[1:-1]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["segment"]] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(np.diff(index.ends)),
                    pa.array([(w - a).tolist() for w, a in zip(where, index.ends.tolist(), strict=False)], pa.list_(pa.int64())),
                    pa.array([[names[i] for i in sorted(items.get(d, ()))] for d in range(n)], pa.list_(pa.string())),
                    pa.array([[names[i] for i in sorted(close.get(d, ()))] for d in range(n)], pa.list_(pa.string())),
                ],
                [c.split()[0] for c in MATCHES.split(", ")],
            )

    return run


def _counted(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sums = {t: i for i, t in enumerate(terms())}, defaultdict(int)
        for batch in batches:
            for words, raw in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                for word, n in zip(words.split(), np.frombuffer(raw, np.int32).tolist(), strict=True):
                    if word in place:
                        sums[place[word]] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.int64())], ["term", "n"])

    return run


def _ranked(index: DataFrame, items: list[tuple[str, bytes]]) -> Queries:
    """A block's windows, with the counts of its terms over the whole index: as many rows at most as the block has terms."""
    queries = Queries(items)
    terms = share(index.sparkSession, queries.terms)
    rows = index.select("terms", "counts").mapInArrow(_counted(terms), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    terms.drop()
    return queries.rank({r.term: r.n for r in rows})


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of bounded size, one at a time on the driver; at least one block, which may be empty."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), as_bytes().alias("raw")).filter("item_id is not null and raw is not null")
    held, size = [], 0
    for row in rows.toLocalIterator():
        if held and size + len(row.raw) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((row.item_id, bytes(row.raw)))
        size += len(row.raw)
    yield held


def search(index: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(segment, place, doc_id, n_words, hits, items, near_items) for each document of an index: word positions hit, items matched exactly, items near.

    One pass over the index for each block of items; with several, each pass writes its rows, which are merged by document.
    """
    spark, parts, held = index.sparkSession, [], None
    for items in blocks(benchmark):
        if held is not None:
            parts.append(_pass(index, held))
        held = items
    if not parts:
        return index.mapInArrow(_search(share(spark, _ranked(index, held))), MATCHES)
    every = _pass(index, held)
    for part in parts:
        every = every.union(part)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    merged = every.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), union("hits"), union("items"), union("near_items"))
    return merged.select(*(c.split()[0] for c in MATCHES.split(", ")))


def _pass(index: DataFrame, items: list[tuple[str, bytes]]) -> DataFrame:
    block = share(index.sparkSession, _ranked(index, items))
    done = materialise(index.mapInArrow(_search(block), MATCHES))
    block.drop()
    return done


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: n_words, n_hit, n_items, items_sha256, contaminated, and n_near_items.

    Null and empty texts have no words and no hits; items without words, and items with a null item_id, match nothing, as in the SQL; repeated item_ids
    count once; repeated rows give repeated results. An empty benchmark leaves every document clean.
    """
    return search(build_index(docs), benchmark).select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in whose text no window of an item with an item_id occurs, with all columns as they were.

    Null and empty texts stay; repeated rows stay or go together; empty tables give all rows, or none.

    Each task indexes the texts it reads and drops rows at once, so that whole texts need not be joined with a stored index's matches.
    """
    raw, held = docs.withColumn("text", as_bytes()), None
    for items in blocks(benchmark):
        if held is not None:  # several blocks: each is done, and its broadcast dropped, before the next
            block = share(docs.sparkSession, Queries(held))
            raw = materialise(raw.mapInArrow(_without(block), raw.schema))
            block.drop()
        held = items
    return raw.mapInArrow(_without(share(docs.sparkSession, Queries(held))), raw.schema).withColumn("text", F.col("text").cast("string"))


def _without(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = block()
        for batch in chunks(batches, "text", CHUNK):
            index = Postings.of_texts(batch.column("text").to_pylist())
            bound = index.bound(queries)
            bad = np.zeros(batch.num_rows, bool)
            for window in queries.bound(bound, queries.windows)[1]:
                bad[index.owner(index.phrases(window[window >= 0]))] = True
            yield batch.filter(pa.array(~bad))

    return run

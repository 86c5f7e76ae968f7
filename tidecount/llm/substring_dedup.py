"""Removal of long word runs that an earlier document already has, found by recompression.

Recompression replaces, round by round, maximal runs of one symbol and then adjacent pairs (left symbol, right symbol)
by new symbols. A new symbol's name is a 64-bit hash of what it stands for, so every task names the same run or
pair alike and no dictionary has to be exchanged. Equal substrings then hold the same symbols except near
their ends: which symbols of a window are sure (formed alike wherever the window stands) follows from the window alone.

1. Each window of 50 words picks its anchor: the smallest-named phrase of three sure symbols after three rounds
   (of plain words where a window has fewer sure symbols, as inside long runs). Equal windows have equal anchors.
   Consecutive windows with one anchor form a block (about one for 18 words), named by its anchor and a hash of its words.
2. Anchors that only one document has reveal no repeat and are dropped. For the others the smallest document of each block is
   found: every other document loses all windows of that block.
3. Where an anchor has several different blocks, windows may still agree in part. One document for each
   such block, its smallest, sends the block's window hashes (128 bits); windows that a smaller document sends are lost too.
4. Each document gets the names of its lost blocks and windows and removes the words they cover.

Only hashes are exchanged in 1 to 3, counts are pre-aggregated, and hot blocks are never gathered. Blocks and windows are compared across documents
by 128 bits, and inside a document by 64 with the few names that it has lost; both come from 64-bit hashes of words. Two unequal windows pass for
equal with a probability of about 2^-64 a pair that differs in one word only, and 2^-120 otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import as_bytes, materialise
from ._text import U, chunks, hash_words, join_words, mix, space_words

WINDOW = 50
ROUNDS = 3
GRAM = 3

_BASE = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
_INVERSE = tuple(U(pow(int(b), -1, 2**64)) for b in _BASE)


@dataclass
class Blocks:
    """Blocks of consecutive windows: first window start, number of windows, text index, names."""

    start: np.ndarray
    count: np.ndarray
    owner: np.ndarray
    anchor: np.ndarray
    name: np.ndarray


class Recompressed:
    """Some texts' words, their symbols and their windows' anchors."""

    def __init__(self, raws: list[bytes | None], window: int = WINDOW, rounds: int = ROUNDS):
        self.window = window
        self.words, self.ends = join_words(raws, space_words)
        self.hash = hash_words(self.words)
        n = len(self.hash)
        self.owner = np.repeat(np.arange(len(raws)), np.diff(self.ends))
        total = max(0, n - window + 1)
        self.starts = np.flatnonzero(self.owner[:total] == self.owner[window - 1 :]) if total else np.zeros(0, np.int64)
        self._sums()
        if len(self.starts):
            self._anchors(rounds)

    def _sums(self) -> None:
        n = len(self.hash)
        self._prefix, self._scale = [], []
        for base, inverse, salt in zip(_BASE, _INVERSE, (0, 0x5851F42D4C957F2D), strict=True):
            power, scale = np.full(n + 1, base, U), np.full(n + 1, inverse, U)
            power[0] = scale[0] = 1
            power, scale = np.multiply.accumulate(power), np.multiply.accumulate(scale)
            self._prefix.append(np.concatenate([[U(0)], np.add.accumulate(mix(self.hash + U(salt)) * power[:n])]))
            self._scale.append(scale)

    def names(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """A hash of the words from start to end."""
        held = (self._prefix[which][end] - self._prefix[which][start]) * self._scale[which][start]
        return mix(held + (end - start).astype(U) * U(0xD6E8FEB86659FD93))

    def _anchors(self, rounds: int) -> None:
        symbol, owner, place = self.hash, self.owner, np.arange(len(self.hash))
        first, end = self.starts.copy(), self.starts + self.window  # of each window's sure symbols
        for level in range(rounds):
            salt = mix(np.array([level + 1], U))[0]
            # runs of one symbol
            new = np.ones(len(symbol), bool)
            new[1:] = (symbol[1:] != symbol[:-1]) | (owner[1:] != owner[:-1])
            head = np.flatnonzero(new)
            length = np.diff(np.append(head, len(symbol)))
            at = np.cumsum(new) - 1
            some = end > first
            low, high = np.where(some, first, 0), np.where(some, end, 1)
            first, end = at[low] + 1, np.where(some, at[high - 1], 0)  # a run at either end may go on outside
            symbol, owner, place = np.where(length > 1, mix(symbol[head] + length.astype(U) * salt), symbol[head]), owner[head], place[head]
            # pairs of a left and a right symbol
            right = (mix(symbol ^ salt) & U(1)).astype(bool)
            pair = np.zeros(len(symbol), bool)
            pair[:-1] = ~right[:-1] & right[1:] & (owner[1:] == owner[:-1])
            keep = np.ones(len(symbol), bool)
            keep[1:] = ~pair[:-1]
            head = np.flatnonzero(keep)
            at = np.cumsum(keep) - 1
            some = end > first
            low, high = np.where(some, first, 0), np.where(some, end, 1)
            low = low + right[low]  # it may belong to the symbol before the window
            high = high - ~right[high - 1]  # it may belong to the symbol after it
            some &= high > low
            low, high = np.where(some, low, 0), np.where(some, high, 1)
            first, end = at[low], at[high - 1] + 1
            first, end = np.where(some, first, 1), np.where(some, end, 1)
            follow = np.append(symbol[1:], U(0))
            named = mix(mix(symbol + salt) + follow * U(0x9E3779B97F4A7C15))
            symbol, owner, place = np.where(pair, named, symbol)[head], owner[head], place[head]
        deep = end - first >= GRAM
        chosen = np.zeros(len(self.starts), np.int64)
        anchor = np.zeros(len(self.starts), U)
        for which, values, low, high, salt in ((deep, symbol, first, end, U(3)), (~deep, self.hash, self.starts, self.starts + self.window, U(5))):
            if which.any():
                grams = mix(mix(values[:-2] + salt) + mix(values[1:-1] * U(3) + salt) * U(7) + values[2:] * U(0xC2B2AE3D27D4EB4F)) if len(values) >= GRAM else np.zeros(0, U)
                got = _leftmost_least(grams, low[which], high[which] - GRAM + 1)
                anchor[which] = grams[got]
                chosen[which] = got * 2 + int(salt == U(3))
        edge = np.ones(len(chosen), bool)
        edge[1:] = (chosen[1:] != chosen[:-1]) | (np.diff(self.starts) != 1)
        head = np.flatnonzero(edge)
        count = np.diff(np.append(head, len(chosen)))
        start = self.starts[head]
        anchor = anchor[head]
        self.blocks = Blocks(start, count, self.owner[start], anchor.view(np.int64), mix(self.names(start, start + count + self.window - 1, 0) + anchor).view(np.int64))

    def of_windows(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each window that begins at ``start``."""
        return tuple(self.names(start, start + self.window, k).view(np.int64) for k in (0, 1))


def _leftmost_least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The index of the least value from low to high (exclusive, not empty), the leftmost of equals."""
    table = [np.arange(len(values))]
    span = 1
    longest = int((high - low).max())
    while span * 2 <= longest:
        left, right = table[-1][:-span], table[-1][span:]
        table.append(np.where(values[left] <= values[right], left, right))
        span *= 2
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    out = np.zeros(len(low), np.int64)
    for k, best in enumerate(table):
        at = np.flatnonzero(level == k)
        if len(at):
            left, right = best[low[at]], best[high[at] - (1 << k)]
            out[at] = np.where(values[left] <= values[right], left, right)
    return out


def _repeated(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start+1, ... (count of them) for each row, one after the other."""
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(start, count) + inner


def _emit_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "raw"):
        text = Recompressed(batch.column("raw").to_pylist())
        if len(text.starts):
            b = text.blocks
            yield pa.RecordBatch.from_arrays([pa.array(b.anchor), pa.array(b.name), batch.column("doc_id").take(pa.array(b.owner))], ["anchor", "name", "doc_id"])


def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "raw"):
        text = Recompressed(batch.column("raw").to_pylist())
        if len(text.starts):
            b, keep = text.blocks, []
            bounds = np.searchsorted(b.owner, np.arange(batch.num_rows + 1))
            for i, names in enumerate(batch.column("names").to_pylist()):
                part = slice(bounds[i], bounds[i + 1])
                keep.append(np.isin(b.name[part], np.array(names, np.int64)))
            keep = np.concatenate(keep)
            start = _repeated(b.start[keep], b.count[keep])
            one, two = text.of_windows(start)
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), batch.column("doc_id").take(pa.array(text.owner[start]))], ["w1", "w2", "doc_id"])


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "raw"):
        raws, lost = batch.column("raw").to_pylist(), batch.column("lost").to_pylist()
        touched = [i for i, names in enumerate(lost) if names]
        gone: dict[int, np.ndarray] = {}
        if touched:
            text = Recompressed([raws[i] for i in touched])
            cover = np.zeros(len(text.words) + 1, np.int64)
            if len(text.starts):
                b = text.blocks
                bounds = np.searchsorted(b.owner, np.arange(len(touched) + 1))
                for k, i in enumerate(touched):
                    names = np.array(lost[i], np.int64)
                    part = slice(bounds[k], bounds[k + 1])
                    whole = np.isin(b.name[part], names)
                    rest = _repeated(b.start[part][~whole], b.count[part][~whole])
                    if len(rest):
                        rest = rest[np.isin(text.of_windows(rest)[1], names)]
                    for start, end in ((b.start[part][whole], (b.start + b.count)[part][whole] - 1), (rest, rest)):
                        np.add.at(cover, start, 1)
                        np.add.at(cover, end + text.window, -1)
            covered = np.cumsum(cover[:-1]) > 0
            for k, i in enumerate(touched):
                gone[i] = covered[text.ends[k] : text.ends[k + 1]]
        n, removed, kept = [], [], []
        for i, raw in enumerate(raws):
            words = space_words(raw)
            n.append(len(words))
            if i in gone and gone[i].any():
                words = [w for w, out in zip(words, gone[i].tolist(), strict=True) if not out]
            removed.append(n[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of ``docs(doc_id, text, ...)``; ``kept`` holds the kept words as bytes, joined by one space.

    A word goes when a window of 50 words over it also starts in a document with a smaller doc_id. Null and
    empty texts have no words; texts under 50 words keep all; rows that share a doc_id never
    remove each other's words; a null doc_id neither removes nor loses words.
    """
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("raw"))
    known = raw.filter("doc_id is not null")
    blocks = materialise(known.mapInArrow(_emit_blocks, "anchor long, name long, doc_id long"))  # recompressed once
    least = blocks.groupBy("anchor", "name").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    # written, as windows below, so that the join reads both sides from exchanges and an anchor with many blocks can be split
    anchors = materialise(least.groupBy("anchor").agg(F.count(F.lit(1)).alias("names"), F.min("lo").alias("least"), F.max("hi").alias("most")).filter("least < most").select("anchor", "names"))
    shared = materialise(least.join(anchors, "anchor"))
    copied = shared.filter("lo < hi").select("anchor", "name", "lo")
    lost_blocks = blocks.join(copied, ["anchor", "name"]).filter("doc_id > lo").select("doc_id", "name")
    asked = shared.filter("names > 1").groupBy(F.col("lo").alias("doc_id")).agg(F.collect_list("name").alias("names"))
    windows = known.join(asked, "doc_id").mapInArrow(_emit_windows, "w1 long, w2 long, doc_id long")
    windows = materialise(windows.distinct())
    # written, so that the join below reads both sides from exchanges and hot windows can be split
    first = materialise(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("w1", "w2", "lo"))
    lost_windows = windows.join(first, ["w1", "w2"]).filter("doc_id > lo").select("doc_id", F.col("w2").alias("name"))
    lost = lost_blocks.union(lost_windows).groupBy("doc_id").agg(F.collect_set("name").alias("lost"))
    return raw.join(lost, "doc_id", "left").select("doc_id", "raw", "lost").mapInArrow(_strip, "doc_id long, n_words long, n_removed long, kept binary")

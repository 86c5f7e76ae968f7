"""Words and 64-bit hashes of them, a few megabytes of text at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array

CHUNK_BYTES = 2 << 20
U = np.uint64

# For words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of ASCII-lowered text: every other byte becomes a space.
ALNUM = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def space_words(raw: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; bytes.split() knows exactly these six separators."""
    return raw.split() if raw else []


def alnum_words(raw: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z (bytes.lower() changes nothing else)."""
    return raw.lower().translate(ALNUM).split() if raw else []


def chunks(batches: Iterable[pa.RecordBatch], column: str, budget: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``budget`` bytes in ``column``; a longer value is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        start, held = 0, 0
        for i, n in enumerate(sizes.to_pylist()):
            if held and held + n > budget:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def hash_words(words: list[bytes]) -> np.ndarray:
    """A fixed 64-bit hash of each word (SipHash with a constant key, the same on every machine)."""
    if not words:
        return np.zeros(0, U)
    return hash_array(np.array(words, dtype=object), categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: bijective, every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def join_words(raws: list[bytes | None], words_of) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts in one list, and the offsets at which each text's words begin (one more at the end)."""
    words: list[bytes] = []
    ends = [0]
    for raw in raws:
        words += words_of(raw)
        ends.append(len(words))
    return words, np.array(ends, np.int64)

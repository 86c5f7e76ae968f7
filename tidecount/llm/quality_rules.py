"""Line-first quality rules: lines are judged one by one, then a document that loses too much of its text is rejected.

A line fails when one of these holds (a line without a word is neither kept nor failed):

* ``symbols``: over 30 characters of ``#*$%&|<>{}~^`` for each 100 words, or doubled ``!!``/``??`` after over 30 % of its words
* ``navigation``: a fifth of its words are separators (``|``, ``»``, ``›``, ``•``, ``·``), or at most six words without an end mark that name a menu entry
* ``boilerplate``: at most 40 words with a notice that sites repeat (cookies, rights, scripts, terms)
* ``punctuation``: 25 or more words without any mark of punctuation
* ``shouting``: ten or more words, over 70 % of the cased letters upper case
* ``monotone``: ten or more words of which one makes up over half, or over 30 % equal the next
* ``fragment``: fewer than three words and no end mark
* ``repeated``: equal to an earlier line of the document

A document is kept when the base rules pass and its failed lines hold at most half of its words. Its failed lines are then removed. Lines are
judged in every document, whatever the base rules say.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import as_bytes
from ._text import U, chunks, hash_words, join_words, mix, space_words

# Fixed values of the rules.
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
NOISE = re.compile(r"[#*$%&|<>{}~^]")
DOUBLED = re.compile(r"(?:!!|\?\?)")
SEPARATORS = frozenset("|»›•·")
END_MARKS = tuple(".!?:;…。！？؟।\"”»')]")
MARK = re.compile("[.,;:!?…。，、；：！？؟।]")
MENU = re.compile(r"(?ia)\b(?:home|menu|login|log in|sign (?:in|up)|register|subscribe|search|next|previous|share|contact|sitemap|read more|click here|back to top|accueil|connexion|startseite|anmelden|inicio|buscar)\b")
NOTICE = re.compile(r"(?ia)\b(?:cookies?|privacy policy|all rights reserved|terms of (?:use|service)|lorem ipsum|javascript|newsletter|advertisement|powered by)\b")

MAX_LOST = 0.5
WINDOW = 8
_POWERS = mix(np.arange(1, WINDOW + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_failed_lines long, n_failed_words long, cleaned binary"


def repeated_words(words: list[bytes], ends: np.ndarray) -> np.ndarray:
    """For each text, how many of its words lie in a window of eight that occurs twice or more in it."""
    cover = np.zeros(len(words) + 1, np.int64)
    total = len(words) - WINDOW + 1
    if total > 0:
        hashes = hash_words(words)
        owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        key = np.zeros(total, U)
        for k in range(WINDOW):
            key += hashes[k : k + total] * _POWERS[k]
        inside = np.flatnonzero(owner[:total] == owner[WINDOW - 1 :])
        key = mix(key[inside] + owner[inside].astype(U) * U(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        same = np.flatnonzero(ranked[1:] == ranked[:-1])
        if len(same):
            a, b = inside[order[same]], inside[order[same + 1]]
            sure = owner[a] == owner[b]
            for k in range(WINDOW):
                sure &= hashes[a + k] == hashes[b + k]
            starts = np.unique(np.concatenate([a[sure], b[sure]]))
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return covered[ends[1:]] - covered[ends[:-1]]


def failure(line: str, words: list[str]) -> str | None:
    """The rule that ``line`` fails, if any."""
    n = len(words)
    if sum(w in SEPARATORS for w in words) * 5 >= n:
        return "navigation"
    if len(NOISE.findall(line)) * 100 > 30 * n or len(DOUBLED.findall(line)) * 100 > 30 * n:
        return "symbols"
    ended = line.rstrip(SPACES).endswith(END_MARKS)
    if n <= 6 and not ended and MENU.search(line):
        return "navigation"
    if n <= 40 and NOTICE.search(line):
        return "boilerplate"
    if n >= 25 and not MARK.search(line):
        return "punctuation"
    if n >= 10:
        if line != line.lower():
            cased = sum(map(str.islower, line)), sum(map(str.isupper, line))
            if cased[1] * 10 > 7 * sum(cased):
                return "shouting"
        if Counter(words).most_common(1)[0][1] * 2 > n or sum(map(str.__eq__, words, words[1:])) * 100 > 30 * n:
            return "monotone"
    if n < 3 and not ended:
        return "fragment"
    return None


def _walk(text: str) -> tuple[list[str], list[tuple[str, str]], int, set[int]]:
    """As ``clean_lines``, with the failed lines' places."""
    kept, failed, lost, places, seen = [], [], 0, set(), set()
    for i, line in enumerate(text.split("\n")):
        words = re.findall(r"[^\x20\t-\r]+", line)
        if not words:
            continue
        rule = "repeated" if line in seen else failure(line, words)
        seen.add(line)
        if rule:
            failed.append((line, rule))
            places.add(i)
            lost += len(words)
        else:
            kept.append(line)
    return kept, failed, lost, places


def clean_lines(text: str) -> tuple[list[str], list[tuple[str, str]], int]:
    """The lines that stay, the failed ones with their rule, and the number of words in the failed ones."""
    return _walk(text)[:3]


def _cleaned(raw: bytes, places: set[int]) -> bytes:
    """``raw`` without the lines at these places; the others, those without a word too, stay as they are."""
    return b"\n".join(line for i, line in enumerate(raw.split(b"\n")) if i not in places) if places else raw


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "raw"):
        raws = batch.column("raw").to_pylist()
        words, ends = join_words(raws, space_words)
        repeats = repeated_words(words, ends)
        rows = []
        for raw, n, again in zip(raws, np.diff(ends).tolist(), repeats.tolist(), strict=True):
            text = (raw or b"").decode("utf-8", "replace")
            lines = [x for x in text.split("\n") if x.strip(SPACES)]
            bad = n < 20 or 100 * again > 30 * n
            _, failed, lost, places = _walk(text)
            kept = not bad and lost <= MAX_LOST * n
            rows.append((n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), again, bad, kept, len(lines), len(failed), lost, _cleaned(raw, places) if kept else None))
        columns = [list(c) for c in zip(*rows, strict=True)]
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 3 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, ...)``: counts, ``base_failed``, ``kept`` and ``cleaned``, the text without failed lines. No shuffle.

    Null and empty texts have no words, so they fail the base rules. ``cleaned`` is null where the document isn't kept. Other columns of ``docs`` are ignored; repeated rows give repeated results.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("raw")).mapInArrow(_judge, SCHEMA).withColumn("cleaned", F.col("cleaned").cast("string"))


def _accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        raws = [raw or b"" for raw in batch.column("text").to_pylist()]
        words, ends = join_words(raws, space_words)
        repeats = repeated_words(words, ends)
        keep, new = [], []
        for raw, n, again in zip(raws, np.diff(ends).tolist(), repeats.tolist(), strict=True):
            bad = n < 20 or 100 * again > 30 * n
            lost, places = (0, set()) if bad else _walk(raw.decode("utf-8", "replace"))[2:]
            keep.append(not bad and lost <= MAX_LOST * n)
            new.append(_cleaned(raw, places) if keep[-1] else None)
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type)).filter(pa.array(keep, pa.bool_()))


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text the rules keep, without the text's failed lines; ``n_chars`` is brought up to date where lines went.

    Null and empty texts fail the base rules and go; repeated rows are judged alike; an empty table gives no rows.
    """
    raw = docs.withColumn("text", as_bytes())
    if "n_chars" not in docs.columns:
        return raw.mapInArrow(_accept, raw.schema).withColumn("text", F.col("text").cast("string"))
    marked = raw.withColumn("size_before_", F.octet_length("text"))
    out = marked.mapInArrow(_accept, marked.schema)
    gone = F.octet_length("text") < F.col("size_before_")
    out = out.withColumn("n_chars", F.when(gone, F.char_length(F.col("text").cast("string")).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("text").cast("string")).drop("size_before_")

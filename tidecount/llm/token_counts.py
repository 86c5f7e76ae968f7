"""Token counts behind a digest cache.

Counts are kept in a table (tokenizer, digest, n_tokens), keyed by a digest of the normalised content and one of the tokenizer
(model file and library version). A run digests every text, drops what the table knows, encodes one text for each
distinct digest left, appends those counts to the table and joins all rows with it. A bit filter of fixed size over the digests left
decides in the reading task which texts are sent on at all.

The model's normaliser changes no character, so the normalised content is the text itself, null as empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import shared_dir
from ._spark import among, bit_filter, materialise
from ._text import chunks

MEMO = 400_000  # units whose counts a task remembers; more make it start anew
CACHE = "tokenizer string, digest binary, n_tokens long"
UNIT = re.compile(r" +[^ ]+| +")


class PieceCounter:
    """Counts pieces of texts as the library does, over units between spaces that it remembers.

    No piece holds a space mark after another character and every merge yields a piece, so no merge crosses from a
    unit to the spaces of the next, and the counts of units add up. ``check`` proves the premise for a model;
    a model without it, and a text that spells the space mark itself, are encoded whole.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.by_unit = self.check(self.encoder)
        self.memo: dict[str, int] = {}

    @staticmethod
    def check(encoder) -> bool:
        pieces = [encoder.id_to_piece(i) for i in range(encoder.get_piece_size())]
        # a space before plain text must be one mark, kept as often as it stands, with one mark put in front
        plain = len(encoder.encode("a  a", out_type=str)) >= 3 and encoder.decode(encoder.encode(" a  b ")) == " a  b "
        return plain and not any(re.search("[^▁]▁", p) for p in pieces)

    def count(self, texts: list[str]) -> list[int]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, units, whole = self.memo, [], []
        for i, text in enumerate(texts):
            if self.by_unit and "▁" not in text:
                units.append(UNIT.findall(f" {text}") if text else [])
            else:
                units.append(None)
                whole.append(i)
        fresh = list({u for held in units if held for u in held if u not in memo})
        # the library puts a space in front of what it encodes; a lone space is one piece
        for unit, ids in zip(fresh, self.encoder.encode([u[1:] for u in fresh], num_threads=1), strict=True):
            memo[unit] = len(ids) if unit != " " else 1
        out = [sum(map(memo.__getitem__, held)) if held is not None else 0 for held in units]
        for i, ids in zip(whole, self.encoder.encode([texts[i] for i in whole], num_threads=1), strict=True):
            out[i] = len(ids)
        return out


def _encode(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model.value)
        for batch in chunks(batches, "text"):
            n = counter.count([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return run


def tokenizer_version(model: bytes) -> str:
    import sentencepiece

    return hashlib.sha256(model + sentencepiece.__version__.encode()).hexdigest()


def default_cache(spark) -> str:
    """The cache that all runs with one shared folder use."""
    return f"{shared_dir(spark)}/tidecount/token-counts"


def token_counts(docs: DataFrame, model: bytes, limit: int = 4096, cache: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs(doc_id, text, ...)``; ``model`` is the tokenizer's file.

    ``cache`` is the folder of the cache table, made where missing; by default one that lasts in the shared folder. Null and
    empty texts have no bytes and no tokens. Each distinct text that the cache doesn't know is encoded once, however many rows hold it;
    of the others only digests are exchanged, and their texts don't leave the task that reads them.
    """
    spark = docs.sparkSession
    cache = cache or default_cache(spark)
    version = tokenizer_version(model)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    narrow = rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    wanted = narrow.select("digest").distinct()
    try:
        known = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version).select("digest")
        wanted = wanted.join(known, "digest", "left_anti")
    except AnalysisException:  # no such table yet
        pass
    wanted = materialise(wanted.withColumn("k", F.xxhash64("digest")))
    bits = bit_filter(wanted, "k")
    misses = among(rows.select("text", "digest", F.xxhash64("digest").alias("k")), "k", bits).groupBy("digest").agg(F.first("text").alias("text")).join(wanted, "digest", "left_semi")
    counted = misses.mapInArrow(_encode(spark.sparkContext.broadcast(model)), "digest binary, n_tokens long")
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    bits.drop()
    stored = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version)
    # one count a digest, even if another run appended some meanwhile; written, so that a text that many rows share can be split
    counts = materialise(stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    return narrow.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

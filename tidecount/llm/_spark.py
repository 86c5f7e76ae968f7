"""Shared storage and small plan helpers."""

from __future__ import annotations

import pickle
import sys
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_dir

# Functions of this package travel to the executors by value, so these need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])


_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """The tables that ``materialise`` writes inside are deleted at the end, but for those made with ``outer``, which belong to the scope around this one."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, codec: str = "snappy", outer: bool = False) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it again, which cuts its lineage.

    The files live outside any executor, so a lost executor costs no recomputation. Outside of a ``scratch`` they stay, as a result may still read them.
    """
    path = f"{shared_dir(df.sparkSession)}/tidecount/{uuid.uuid4().hex}"
    scopes = _OPEN[:-1] if outer else _OPEN
    if scopes:
        scopes[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: str = "text"):
    """The text as UTF-8 bytes; null stays null. Bytes cross to Python without being decoded there."""
    return F.col(column).cast("binary")


def share(spark: SparkSession, value):
    """A function that returns ``value`` on the executors, sent to each once. Plain broadcasts can't carry this package's own classes there."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get():
        return pickle.loads(sent.value)

    get.drop = sent.unpersist
    return get


BITS = 26


def bit_filter(keys: DataFrame, column: str):
    """Which values of a long column may be among ``keys``, as 2^26 bits (8 MB whatever the input): a broadcast for ``among``."""
    at = F.pmod(F.col(column), F.lit(1 << BITS))
    rows = keys.groupBy((at.cast("long") / 32768).cast("int").alias("bucket")).agg(F.bitmap_construct_agg((at % 32768).cast("long")).alias("bits")).collect()  # at most 2048
    held = np.zeros((1 << BITS) // 8, np.uint8)
    for r in rows:
        held[r.bucket * 4096 : r.bucket * 4096 + 4096] = np.frombuffer(r.bits, np.uint8)
    return share(keys.sparkSession, held)


def among(rows: DataFrame, column: str, bits) -> DataFrame:
    """The rows whose ``column`` may be among the keys of a ``bit_filter``; all of them that are, and few others while the keys are few against 2^26."""

    def run(batches):
        held = bits()
        for batch in batches:
            at = batch.column(column).to_numpy(zero_copy_only=False) & ((1 << BITS) - 1)
            yield batch.filter(pa.array((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)

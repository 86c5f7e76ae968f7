"""Pseudonymous user keys: HMAC-SHA256 with a salt that rotates by epoch, all in built-in functions.

Spark has no hmac(). A key's two pads are worked out on the driver (one pair for each epoch, a handful of rows), and
the two nested SHA-256 calls run in the JVM.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_EPOCHS = 10_000  # some 800 years of 30 days each
FIRST_ORDINAL = 719163  # proleptic Gregorian ordinal of 1970-01-01


def secret_bytes(secret: str) -> bytes:
    """``b64:`` marks base 64, anything else is UTF-8."""
    return base64.b64decode(secret[4:]) if secret.startswith("b64:") else secret.encode()


def mint_secret() -> str:
    return "b64:" + base64.b64encode(secrets.token_bytes(32)).decode()


def pads(key: bytes) -> tuple[str, str]:
    """The inner and outer pad of an HMAC-SHA256 key, in hex."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def epoch_salt(secret: bytes, epoch: int) -> bytes:
    return hmac.new(secret, f"epoch::{epoch}".encode(), hashlib.sha256).digest()


def rotation_epoch(day: Column, rotation_days: int) -> Column:
    return F.floor((F.unix_date(day) + FIRST_ORDINAL) / max(rotation_days, 1)).cast("long")


def hmac_sha256(message: Column, inner: Column, outer: Column) -> Column:
    """HMAC-SHA256 of a string as lower-case hex, from the key's pads in hex."""
    first = F.sha2(F.concat(F.unhex(inner), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(outer), F.unhex(first)), 256)


def user_root(user_id: Column, secret: str) -> Column:
    """A key that does not rotate, under which erasures find a user's rows."""
    inner, outer = pads(secret_bytes(secret))
    return hmac_sha256(user_id, F.lit(inner), F.lit(outer))


def with_user_key(df: DataFrame, secret: str, rotation_days: int, day: str = "day", user: str = "user_id") -> DataFrame:
    """Adds ``epoch`` and ``user_key``. The salt table has one row for each epoch in the data; over ``MOST_EPOCHS`` of them are an error."""
    spark, key = df.sparkSession, secret_bytes(secret)
    rows = df.withColumn("epoch", rotation_epoch(F.col(day), rotation_days))
    epochs = [r[0] for r in rows.select("epoch").filter("epoch IS NOT NULL").distinct().limit(MOST_EPOCHS + 1).collect()]
    if len(epochs) > MOST_EPOCHS:
        raise ValueError(f"over {MOST_EPOCHS} salt epochs")
    salts = spark.createDataFrame([(e, *pads(epoch_salt(key, e))) for e in epochs], "epoch long, inner string, outer string")
    joined = rows.join(F.broadcast(salts), "epoch", "left")
    return joined.withColumn("user_key", hmac_sha256(F.col(user), F.col("inner"), F.col("outer"))).drop("inner", "outer")


def truncated(key: Column, hex_digits: int) -> Column:
    return F.substring(key, 1, hex_digits)

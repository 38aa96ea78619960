"""A seeded hash of a key that any SQL engine computes alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fifteen hexadecimal digits of an MD5: a non-negative 60-bit number.
HASH_BITS = 60


def stable_hash(key: str, seed: int) -> Column:
    text = F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def stable_hash_sql(key: str, seed: int) -> str:
    """The same in DuckDB's SQL."""
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, {HASH_BITS // 4}) AS BIGINT)"

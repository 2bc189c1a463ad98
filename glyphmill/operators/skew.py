"""Joins whose left side may hold a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64


def spread_join(left: DataFrame, keys: list[str], by: str, right: DataFrame, how: str = "inner", keys_of: DataFrame | None = None, salts: int = SALTS) -> DataFrame:
    """left joined with right (at most one row a key) without a task that holds all rows of a key.

    Rows are dealt out by their key and a hash of the column ``by``; each (key, salt) that occurs gets a copy of right's row, so
    there are never more copies than rows of left.  keys_of: a cheaper table with the keys and ``by`` of left.
    """
    salt = F.pmod(F.xxhash64(by), F.lit(salts)).cast("int").alias("_salt")
    copies = (left if keys_of is None else keys_of).select(*keys, salt).distinct().join(right, keys)
    return left.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")

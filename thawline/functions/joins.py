"""Joins of a large table to a per-key table when one key may hold much of it."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SALTS = 32


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: list[str], how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """Join `small` (few rows per key) to `big`, each key's rows spread over `salts` tasks.

    The salt is a hash of the `spread` columns, so a repeated task gives the same rows.
    `small` is copied once per salt; where it turns out to be below the broadcast
    threshold at run time, Spark broadcasts it instead of moving `big`. Salting is
    explicit because adaptive execution does not split a skewed join whose result is
    then grouped by the same key.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")

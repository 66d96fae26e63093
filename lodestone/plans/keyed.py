"""Keeping or dropping rows by lists of keys, without moving the rows where the list is short."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast at most; a longer list is joined by a shuffle.
MAX_BROADCAST_KEYS = 1_000_000


def content_key(*columns: Column) -> Column:
    """128 bits, as two longs, that tell rows with different values in ``columns`` apart.

    The hash functions skip nulls, so whether a value is null is hashed before it. Two of
    10^12 different rows share a key with probability 10^-15.
    """
    told = [part for column in columns for part in (column.isNull(), column)]
    return F.struct(F.xxhash64(*told).alias("k1"), F.xxhash64(F.lit(7), *told).alias("k2"))


def filter_by_keys(
    rows: DataFrame, keys: DataFrame, on: str | Sequence[str], keep: bool = True, limit: int = MAX_BROADCAST_KEYS
) -> DataFrame:
    """``rows`` whose columns ``on`` are (``keep``) or are not among ``keys``, which has as many columns.

    The list is counted first, so it should be a table that has been written.
    """
    on = [on] if isinstance(on, str) else list(on)
    known = keys.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys.columns)])
    if known.count() <= limit:
        known = F.broadcast(known)
    same = F.lit(True)
    for i, column in enumerate(on):
        same = same & (F.col(column) == F.col(f"__key{i}"))
    return rows.join(known, same, "left_semi" if keep else "left_anti")


def drop_rows(rows: DataFrame, key: Column, gone: DataFrame, repeated: DataFrame, limit: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """``rows`` without those whose ``content_key`` is in ``gone``, and with one of each key in ``repeated``.

    Both lists have columns ``k1, k2``. Columns are unchanged, and only rows of repeated
    keys meet others of their key.
    """
    columns = rows.columns
    keyed = rows.withColumn("__key", key).select(*columns, F.col("__key.k1").alias("__k1"), F.col("__key.k2").alias("__k2"))
    left = filter_by_keys(keyed, gone, ["__k1", "__k2"], keep=False, limit=limit)
    if repeated.isEmpty():
        return left.select(*columns)
    once = filter_by_keys(left, repeated, ["__k1", "__k2"], limit=limit).dropDuplicates(["__k1", "__k2"])
    others = filter_by_keys(left, repeated, ["__k1", "__k2"], keep=False, limit=limit)
    return others.select(*columns).unionByName(once.select(*columns))

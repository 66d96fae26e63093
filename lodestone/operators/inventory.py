"""A tree's inventory: what is analysed, what is skipped and why, what was never fetched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import classify, gitignore

ENTRY = ("path", "size", "analyzed", "skip_reason")


def classify_files(
    files: DataFrame, *, ignore_lines: Sequence[str] = (), extra_globs: Sequence[str] = (),
    max_bytes: int = classify.MAX_FILE_BYTES, binary: Column | None = None,
) -> DataFrame:
    """``files`` with ``analyzed`` and ``skip_reason``; by extension where no ``binary`` test is given.

    Files in folders that are never read are left out, as a walk leaves them out.
    """
    path = F.col("path")
    reason = classify.skip_reason(
        path, F.col("size"), gitignore.ignored(path, ignore_lines), gitignore.ignored(path, extra_globs),
        classify.binary_by_name(path) if binary is None else binary, max_bytes,
    )
    kept = files.where(~classify.in_skipped_folder(path)).withColumn("skip_reason", reason)
    return kept.withColumn("analyzed", F.col("skip_reason") == "")


def unfetched(seen: DataFrame, head: DataFrame, sizes: DataFrame) -> DataFrame:
    """Entries for the paths of ``head`` that ``seen`` lacks: oversize, of size -1 where unknown."""
    missing = head.select("path").join(seen.select("path"), "path", "left_anti")
    return missing.join(sizes.select("path", "size"), "path", "left").select(
        "path",
        F.coalesce("size", F.lit(-1)).cast("long").alias("size"),
        F.lit(False).alias("analyzed"),
        F.lit("oversize").alias("skip_reason"),
    )


def head_listing(lines: DataFrame) -> DataFrame:
    """Blob paths of a listing of lines ``mode type id<tab>path`` (column ``value``)."""
    parts = F.split("value", "\t", 2)
    return lines.where(F.get(F.split(F.get(parts, F.lit(0)), " "), F.lit(1)) == "blob").select(F.get(parts, F.lit(1)).alias("path"))


def planned_bytes(inventory: DataFrame, cap: int) -> DataFrame:
    """One row: bytes of the files that a fetch with this cap would read."""
    return inventory.agg(F.coalesce(F.sum(F.when((F.col("size") > 0) & (F.col("size") <= cap), F.col("size"))), F.lit(0)).alias("planned_bytes"))


def batch_outcome(batch: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The batch's paths that were fetched, and those that were not."""
    return batch.join(fetched, "path", "left_semi"), batch.join(fetched, "path", "left_anti")


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files whose path and content digest were not there before."""
    return now.join(before.select("path", "sha256"), ["path", "sha256"], "left_anti")

"""Facts that change: a log of versions per path, facts of the version that counts, rollups kept by differences.

A change of a path is a row ``path, version, live``: a version with facts, or, where it is not
live, the path's end. Facts carry the version that they belong to and are never rewritten; those
that count are the ones of a path's latest version if that is live. A rollup is a sum of signed
rows, one more for what a version brings and one less for what it replaces, so that it is kept
up by the changes alone and can be read as of any version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(versions: DataFrame, upto: Column | int | None = None) -> DataFrame:
    """One row per path: its last version, at or before ``upto`` where that is given."""
    rows = versions if upto is None else versions.where(F.col("version") <= upto)
    others = [c for c in rows.columns if c not in ("path", "version")]
    return rows.groupBy("path").agg(F.max_by(F.struct("version", *others), "version").alias("last")).select("path", "last.*")


def counting(facts: DataFrame, versions: DataFrame, upto: Column | int | None = None) -> DataFrame:
    """The rows of ``facts`` (with ``path, version``) that belong to the live version of their path."""
    live = latest(versions, upto).where("live").select(F.col("path").alias("__path"), F.col("version").alias("__version"))
    return facts.join(live, (F.col("path") == F.col("__path")) & (F.col("version") == F.col("__version")), "left_semi")


def differences(versions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``version, sign, columns``: what each version brings (1) and what it replaces (-1).

    ``versions`` has ``columns`` of what a path counts for while the version is the last one. A
    path's changes meet in one window, and only they.
    """
    own = F.when(F.col("live"), F.struct(*columns))
    before = F.lag(own).over(Window.partitionBy("path").orderBy("version"))
    each = versions.select("version", F.array(F.struct(F.lit(1).alias("sign"), own.alias("x")), F.struct(F.lit(-1).alias("sign"), before.alias("x"))).alias("both"))
    return each.select("version", F.explode("both").alias("d")).where("d.x is not null").select("version", "d.sign", "d.x.*")


def summed(signed: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """``by, file_count`` and ``sums`` of signed rows; what comes to no files is left out."""
    out = signed.groupBy(*by).agg(F.sum("sign").cast("long").alias("file_count"), *[F.sum(F.col("sign") * F.col(c)).cast("long").alias(c) for c in sums])
    return out.where("file_count <> 0")

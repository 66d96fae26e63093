"""Global ranks and running totals without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.durable import durable

_ROW_BITS = (1 << 33) - 1


def _ranged(df: DataFrame, order_by: Sequence[Column]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(parts, *order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("__at", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__at", 33).cast("int"))
    )
    return durable(ranged, "ranged")


def global_rank(df: DataFrame, order_by: Sequence[Column], out: str) -> DataFrame:
    """``df`` with ``out``, the 0-based position of each row in the given total order.

    Rows are range-partitioned and sorted; only one count per partition meets in
    one place, so the window and the broadcast are as small as the partition count.
    """
    ranged = _ranged(df, order_by)
    starts = (
        ranged.groupBy("__part")
        .count()
        .select(
            F.col("__part"),
            F.coalesce(
                F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ).alias("__start"),
        )
    )
    return (
        ranged.join(F.broadcast(starts), "__part")
        .withColumn(out, F.col("__start") + F.col("__at").bitwiseAND(F.lit(_ROW_BITS)))
        .drop("__part", "__at", "__start")
    )


def running_total(df: DataFrame, order_by: Sequence[Column], value: Column, out: str) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over this row and all before it.

    Each range partition sums its own rows; one total per partition is added up
    front, so no task sees more than its range.
    """
    ranged = _ranged(df.withColumn("__value", value.cast("long")), order_by)
    starts = (
        ranged.groupBy("__part")
        .agg(F.sum("__value").alias("__sum"))
        .select(
            "__part",
            F.coalesce(
                F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ).alias("__start"),
        )
    )
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("__run", F.sum("__value").over(inside))
        .join(F.broadcast(starts), "__part")
        .withColumn(out, F.col("__start") + F.col("__run"))
        .drop("__part", "__at", "__start", "__run", "__value")
    )

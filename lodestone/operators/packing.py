"""First-fit-decreasing bins per job, planned on distinct sizes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.ordered import global_rank


class _Rooms:
    """Bins' rooms in order, with the largest of each half, so that the first bin with room is found by going down."""

    def __init__(self) -> None:
        self.width, self.count = 1, 0
        self.most = [-1, -1]

    def add(self, room: int) -> int:
        if self.count == self.width:
            leaves = self.most[self.width :]
            self.width *= 2
            self.most = [-1] * self.width + leaves + [-1] * (self.width - self.count)
            for node in range(self.width - 1, 0, -1):
                self.most[node] = max(self.most[2 * node], self.most[2 * node + 1])
        self.count += 1
        self.set(self.count - 1, room)
        return self.count - 1

    def set(self, bin_: int, room: int) -> None:
        node = self.width + bin_
        self.most[node] = room
        while node > 1:
            node //= 2
            self.most[node] = max(self.most[2 * node], self.most[2 * node + 1])

    def first(self, size: int) -> tuple[int, int] | None:
        """The first bin with so much room, and its room."""
        if self.most[1] < size:
            return None
        node = 1
        while node < self.width:
            node = 2 * node if self.most[2 * node] >= size else 2 * node + 1
        return node - self.width, self.most[node]


def plan_bins(sizes: list[tuple[int, int]], limit: int) -> list[tuple[int, int, int]]:
    """``(size, bin, how many)`` for ``(size, count)`` in falling order of size.

    Items of one size go to the first bins with room, as one by one they would: a bin
    takes as many as fit before the next is looked at, and is found in logarithmic time.
    """
    out: list[tuple[int, int, int]] = []
    rooms = _Rooms()
    for size, count in sizes:
        while count:
            found = rooms.first(size)
            bin_, room = found or (rooms.add(limit), max(limit, size))
            fits = count if size == 0 else min(count, room // size)
            rooms.set(bin_, limit - size if size > limit else room - fits * size)
            out.append((size, bin_, fits))
            count -= fits
    return out


def first_fit_bins(items: DataFrame, limit: int, job: str = "job_id", item: str = "path") -> DataFrame:
    """``items`` (``job, item, size``) with ``bin``, from 0 per job; a limit of 0 or less: one bin.

    What a job's plan reads is a row per distinct size, not per item; items then take
    their places by rank inside their size, which comes from ranges of a global order.
    """
    if limit <= 0:
        return items.withColumn("bin", F.lit(0))
    counts = items.groupBy(job, "size").agg(F.count(F.lit(1)).alias("n"))

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("size", ascending=False)
        rows = plan_bins(list(zip(ordered["size"].tolist(), ordered["n"].tolist(), strict=True)), limit)
        out = pd.DataFrame(rows, columns=["__size", "bin", "__n"])
        out["__upto"] = out.groupby("__size")["__n"].cumsum()
        out.insert(0, "__job", group[job].iloc[0])
        return out

    kind = items.schema[job].dataType.simpleString()
    bins = counts.groupBy(job).applyInPandas(plan, f"__job {kind}, __size bigint, bin int, __n bigint, __upto bigint")
    placed = global_rank(items, [F.col(job), F.col("size"), F.col(item)], "__rank")
    firsts = placed.groupBy(F.col(job).alias("__j"), F.col("size").alias("__s")).agg(F.min("__rank").alias("__first"))
    ranked = placed.join(firsts, F.col(job).eqNullSafe(F.col("__j")) & (F.col("size") == F.col("__s"))).withColumn(
        "__place", F.col("__rank") - F.col("__first") + 1
    )
    mine = F.col("__place").between(F.col("__upto") - F.col("__n") + 1, F.col("__upto"))
    on = F.col(job).eqNullSafe(F.col("__job")) & (F.col("size") == F.col("__size")) & mine
    return ranked.join(bins, on).select(*items.columns, "bin")

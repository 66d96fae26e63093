"""Fetching a tree too large to hold: bin by bin, each fetched, analysed and let go.

Files are packed into bins of at most ``limit`` bytes. A stream offers the bins one a batch (its
offset is a bin's number, so a restart goes on where it was), the batch's files are fetched by
tasks, analysed, and their facts written as a version; what was fetched is deleted before the
next bin is begun. No more than a bin's bytes are held at any time. What was planned and never
analysed is an anti join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lodestone.operators import packing
from lodestone.streaming import ingest

LIMIT = 100 * 1024 * 1024


class _BinReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.count, self.seen = int(options["count"]), int(options.get("done", 0))

    def initialOffset(self) -> dict:
        return {"bin": 0}

    def latestOffset(self) -> dict:
        # The next bin is offered once the one before was taken.
        return {"bin": min(self.seen + 1, self.count)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.seen = max(self.seen, end["bin"])
        return [InputPartition(k) for k in range(start["bin"], end["bin"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield (partition.value,)


class BinSource(DataSource):
    """``spark.readStream.format("bins").option("count", n)``: the numbers of bins, one a batch."""

    @classmethod
    def name(cls) -> str:
        return "bins"

    def schema(self) -> str:
        return "bin int"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _BinReader(self.options)


def plan(entries: DataFrame, out: str, limit: int = LIMIT) -> int:
    """Pack ``entries`` (``path, size``) into bins, write them under ``out/bins``, and return how many there are.

    A file larger than the limit has a bin of its own.
    """
    packed = packing.first_fit_bins(entries.select(F.lit(0).alias("job_id"), "path", "size"), limit)
    packed.select("path", "size", "bin").repartition("bin").write.mode("overwrite").partitionBy("bin").parquet(f"{out}/bins")
    return (bins(entries.sparkSession, out).agg(F.max("bin")).first()[0] + 1) if not entries.isEmpty() else 0


def bins(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("path string, size long, bin int").parquet(f"{out}/bins")


def run(spark: SparkSession, count: int, fetch: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, after: Callable[[int, dict], None] | None = None) -> None:
    """Fetch (``fetch``: ``path, size`` to ``path, content``) and analyse all bins that are not done yet.

    ``after`` is called with each bin's number and counts when it is done.
    """
    spark.dataSource.register(BinSource)
    versions = ingest._table(spark, out, "versions", ingest.VERSION)
    done = 0 if versions is None else (versions.agg(F.max("version")).first()[0] or -1) + 1

    def one(batch: DataFrame, batch_id: int) -> None:
        for row in batch.collect():
            files = bins(spark, out).where(F.col("bin") == row["bin"])
            counts = ingest.ingest_batch(fetch(files.select("path", "size")).where("content is not null").select("path", "content"), row["bin"], out)
            if after:
                after(row["bin"], counts)

    if count:
        offered = spark.readStream.format("bins").option("count", count).option("done", done).load()
        query = offered.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()


def failures(spark: SparkSession, out: str) -> DataFrame:
    """``path, size, bin`` of planned files that were not analysed."""
    seen = ingest._table(spark, out, "versions", ingest.VERSION)
    planned = bins(spark, out)
    return planned if seen is None else planned.join(seen.where("live").select("path").distinct(), "path", "left_anti")

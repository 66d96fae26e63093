"""Source files that keep arriving, change and go: each micro-batch is analysed, and its facts become a version.

Under ``out`` every table has a folder per batch that a retry overwrites: ``versions`` (what
changed), the fact tables, ``files`` (what the changed files count for) and ``differences``
(the same as signed rows). A batch is complete when its ``versions`` are there, which come last.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from lodestone.functions import text
from lodestone.operators import analysis, rollup
from lodestone.plans.durable import durable, temporary_tables
from lodestone.plans.keyed import filter_by_keys
from lodestone.streaming import versions

TABLES = ("symbols", "imports", "exports", "references", "literals", "chunks", "metrics", "parse", "docs")
VERSION = "path string, live boolean, sha256 string, language string, bytes long, loc long"
#: What a file counts for in the languages' rollup.
COUNTED = ("language", "bytes", "loc")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _table(spark: SparkSession, out: str, name: str, schema: str | None = None) -> DataFrame | None:
    """A table of all complete batches, its batch as ``version``."""
    folder = os.path.join(out, name)
    if not _exists(spark, folder):
        return None
    read = spark.read.schema(f"{schema}, batch long") if schema else spark.read
    rows = read.parquet(folder).withColumnRenamed("batch", "version")
    if name == "versions":
        return rows
    done = spark.read.schema(f"{VERSION}, batch long").parquet(os.path.join(out, "versions")).select(F.col("batch").alias("version")).distinct()
    return filter_by_keys(rows, done, "version")


def ingest_batch(batch: DataFrame, batch_id: int, out: str) -> dict:
    """Analyse the files of a batch (``path, content``) that are not as their last version was, and write their facts.

    Null content is the end of a path. Of a path that comes twice in a batch the longer content
    counts. Returns counts of the batch, which the writing itself took.
    """
    spark = batch.sparkSession
    with temporary_tables(spark):
        once = batch.groupBy("path").agg(F.max(F.struct(F.length("content").alias("size"), "content")).alias("x")).select("path", "x.content")
        arrived = durable(once.select("path", "content", F.when(F.col("content").isNotNull(), text.digest(text.decoded(F.col("content")))).alias("sha256")), "batch")
        known = _table(spark, out, "versions", VERSION)
        if known is not None:
            mine = filter_by_keys(known.where(F.col("version") < batch_id), arrived.select("path"), "path")
            known = durable(versions.latest(mine).where("live"), "known")
        else:
            known = spark.createDataFrame([], f"version long, {VERSION}")
        was = known.select(F.col("path").alias("p"), F.col("sha256").alias("old"), *[F.col(c).alias(f"old_{c}") for c in COUNTED])
        changed = durable(arrived.join(was, F.col("path") == F.col("p"), "left").where(~F.col("sha256").eqNullSafe(F.col("old"))), "changed")
        facts = analysis.analyze(changed.where("content is not null").select("path", "content"))
        for name in TABLES:
            getattr(facts, name).write.mode("overwrite").parquet(os.path.join(out, name, f"batch={batch_id}"))
        facts.files.drop("text").write.mode("overwrite").parquet(os.path.join(out, "files", f"batch={batch_id}"))
        now = facts.files.select(F.col("path").alias("q"), *COUNTED)
        rows = changed.join(now, F.col("path") == F.col("q"), "left")
        brings, takes = (rows.where(test).select(F.lit(sign).alias("sign"), *[F.col(f"{before}{c}").alias(c) for c in COUNTED])
                         for test, sign, before in (("sha256 is not null", 1, ""), ("old is not null", -1, "old_")))
        brings.unionByName(takes).write.mode("overwrite").parquet(os.path.join(out, "differences", f"batch={batch_id}"))
        counted = Observation("ingest")
        live = F.col("sha256").isNotNull()
        new = rows.select("path", live.alias("live"), "sha256", *COUNTED).observe(
            counted, F.count_if("live").alias("analysed"), F.count_if(~F.col("live")).alias("ended"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")
        )
        new.write.mode("overwrite").parquet(os.path.join(out, "versions", f"batch={batch_id}"))
        return counted.get


def current(spark: SparkSession, out: str, name: str, upto: int | None = None) -> DataFrame:
    """A fact table as it is now, or was after batch ``upto``."""
    return versions.counting(_table(spark, out, name), _table(spark, out, "versions", VERSION), upto)


def languages(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame:
    """The rollup of languages from the batches' differences alone."""
    rows = _table(spark, out, "differences")
    rows = rows if upto is None else rows.where(F.col("version") <= upto)
    name = F.when(F.col("language") == "", "unknown").otherwise(F.col("language"))
    return versions.summed(rows.withColumn("language", name), ["language"], ["bytes", "loc"])


def languages_again(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame:
    """The same from all files that count."""
    return rollup.languages(current(spark, out, "files", upto))


class Arrivals(StreamingQueryListener):
    """Counts of what a stream of files brought, from the batches themselves: ``files, ended, bytes``."""

    def __init__(self) -> None:
        self.counts = {"files": 0, "ended": 0, "bytes": 0}

    def onQueryProgress(self, event) -> None:
        if (row := event.progress.observedMetrics.get("arrivals")) is not None:
            for name in self.counts:
                self.counts[name] += row[name] or 0

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Run what has arrived of ``stream`` (``path, content``) through ``ingest_batch``, then stop.

    A listener of the kind ``Arrivals`` sees the counts of each batch.
    """
    gone = F.col("content").isNull()
    counted = stream.observe("arrivals", F.count_if(~gone).alias("files"), F.count_if(gone).alias("ended"), F.sum(F.length("content")).alias("bytes"))
    return (
        counted.writeStream.foreachBatch(lambda batch, batch_id: ingest_batch(batch, batch_id, out))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )

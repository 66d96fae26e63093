"""Rollups over per-file summaries, tree entries and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def languages(summaries: DataFrame) -> DataFrame:
    """Files, bytes and lines per language; files of no known language are ``unknown``."""
    name = F.when(F.col("language") == "", "unknown").otherwise(F.col("language"))
    return summaries.groupBy(name.alias("language")).agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("bytes").cast("long").alias("bytes"), F.sum("loc").cast("long").alias("loc")
    )


def languages_by_count(summaries: DataFrame) -> DataFrame:
    """Files per language, most first; here no known language stays the empty string."""
    return summaries.groupBy("language").agg(F.count(F.lit(1)).alias("file_count")).orderBy(F.desc("file_count"), "language")


def manifest(summaries: DataFrame) -> DataFrame:
    """One row of counts in a single pass."""
    n = lambda flag, name: F.count_if(F.col(flag)).alias(name)
    return summaries.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("total_bytes"),
        F.count_if(~F.col("parse_ok")).alias("parse_errors_count"),
        n("is_test", "test_file_count"), n("is_config", "config_file_count"), n("is_generated", "generated_file_count"),
    )


def entry_points(summaries: DataFrame) -> DataFrame:
    return summaries.where("has_main_guard").select("path").orderBy("path")


def skipped_by_reason(entries: DataFrame) -> DataFrame:
    reason = F.when(F.col("skip_reason") == "", "other").otherwise(F.col("skip_reason"))
    return entries.where(~F.col("analyzed")).groupBy(reason.alias("skip_reason")).agg(F.count(F.lit(1)).alias("n"))


def parse_errors(summaries: DataFrame) -> DataFrame:
    return summaries.where(~F.col("parse_ok")).select(
        "path", "language", "error_nodes", "missing_nodes", F.coalesce("parse_reason", F.lit("")).alias("reason")
    )


def all_symbols(analysis: DataFrame) -> DataFrame:
    """``qualified_name, kind, name, language, file, span`` from files' ``symbols`` arrays, in order."""
    one = analysis.select("path", "language", F.explode("symbols").alias("s"))
    return one.select("s.qualified_name", "s.kind", "s.name", "language", F.col("path").alias("file"), "s.span").orderBy("qualified_name", "file")


def top_level(symbols: DataFrame) -> DataFrame:
    return symbols.where(~F.contains("qualified_name", F.lit(".")) & (F.col("kind") != "module"))


def artifact_index(summaries: DataFrame, rollups: DataFrame, base_url: str, job_id: str) -> DataFrame:
    """``name, kind, size_bytes, url`` of rollups, of the index itself (size unknown) and of every file's artifact."""
    url = f"{base_url.rstrip('/')}/outputs/{job_id}"
    own = summaries.sparkSession.range(1).select(
        F.lit("analysis_index.json").alias("name"), F.lit("rollup").alias("kind"), F.lit(None).cast("long").alias("size_bytes"),
        F.lit(f"{url}/analysis_index.json").alias("url"),
    )
    listed = rollups.select(
        "name", F.when(F.endswith("name", F.lit(".jsonl")), "log").otherwise("rollup").alias("kind"),
        F.col("size_bytes").cast("long"), F.concat(F.lit(url + "/"), F.col("name")).alias("url"),
    )
    name = F.concat(F.lit("files/"), F.col("path"), F.lit(".json"))
    files = summaries.select(
        name.alias("name"), F.lit("per_file").alias("kind"), F.col("size_bytes").cast("long"), F.concat(F.lit(url + "/file/"), name).alias("url")
    )
    return listed.unionByName(own).unionByName(files)


def artifact_totals(index: DataFrame) -> DataFrame:
    """One row: how many artefacts there are, and their bytes; one of unknown size adds none."""
    return index.agg(F.count(F.lit(1)).alias("artifacts"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("total_size_bytes"))


def progress(events: DataFrame) -> DataFrame:
    """Files done and files with errors per language, from a log's ``file_done`` events."""
    done = events.where("event = 'file_done'")
    name = F.when(F.coalesce("language", F.lit("")) == "", "unknown").otherwise(F.col("language"))
    return done.groupBy(name.alias("language")).agg(F.count(F.lit(1)).alias("files_done"), F.count_if(~F.col("parse_ok")).alias("errors_count"))


def supported_languages(spark) -> DataFrame:
    """``id, display_name, has_full_support`` of every language that a path or a shebang can name, by id."""
    from lodestone.functions import classify
    from lodestone.operators import rules

    known = [(x,) for table in (classify.EXTENSIONS, classify.NAMES, classify.INTERPRETERS) for x in table.values()]
    ids = spark.createDataFrame(known, "id string").unionByName(spark.createDataFrame([(x,) for x in rules.FAMILY], "id string")).distinct()
    names = spark.createDataFrame(list(classify.DISPLAY_NAMES.items()), "id string, display_name string")
    return ids.join(names, "id", "left").select(
        "id", F.coalesce("display_name", F.initcap(F.replace("id", F.lit("_"), F.lit(" ")))).alias("display_name"), F.col("id").isin(*rules.FAMILY).alias("has_full_support")
    ).orderBy("id")

"""Filtered reads; every filter is a predicate that a Parquet scan takes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.gitignore import glob_matches, path_regex

SECTIONS = ("file", "module_doc", "symbols", "imports", "exports", "references", "literals_of_interest", "chunks", "metrics", "parse")


def tree(entries: DataFrame, path_prefix: str = "", analyzed_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """The entries asked for, by path, and one row of totals: of these and of the whole tree."""
    prefix = path_prefix.lstrip("/")
    wanted = F.startswith("path", F.lit(prefix)) & (F.col("analyzed") | F.lit(not analyzed_only))
    totals = entries.agg(
        F.count_if(wanted).alias("returned"),
        F.coalesce(F.sum(F.when(wanted, F.col("size"))), F.lit(0)).cast("long").alias("returned_bytes"),
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"),
    )
    return entries.where(wanted).orderBy("path"), totals


def _wanted(prefix: str, kind: str, file_prefix: str) -> Column:
    out = F.lit(True)
    if prefix:
        out = out & F.startswith("qualified_name", F.lit(prefix))
    if kind:
        out = out & (F.col("kind") == kind)
    if file_prefix := file_prefix.lstrip("/"):
        out = out & F.startswith("file", F.lit(file_prefix))
    return out


def symbols(table: DataFrame, prefix: str = "", kind: str = "", file_prefix: str = "") -> DataFrame:
    """Symbols that pass all filters given; an empty filter is none."""
    return table.where(_wanted(prefix, kind, file_prefix))


def symbol_totals(table: DataFrame, prefix: str = "", kind: str = "", file_prefix: str = "") -> DataFrame:
    """One row: how many symbols there are, and how many pass the filters."""
    return table.agg(F.count(F.lit(1)).alias("total_in_repo"), F.count_if(_wanted(prefix, kind, file_prefix)).alias("total_returned"))


def file_analysis(analysis: DataFrame, path: str, sections: Sequence[str] = ()) -> DataFrame:
    """One file's row, with the sections asked for (none named: all)."""
    if unknown := sorted(set(sections) - set(SECTIONS)):
        raise ValueError(f"unknown sections: {', '.join(unknown)}")
    return analysis.where(F.col("path") == path).select(*(s for s in SECTIONS if not sections or s in sections))


def list_files(entries: DataFrame, glob: str = "") -> DataFrame:
    return entries.where(glob_matches(F.col("path"), glob)).select("path").orderBy("path")


def expand(entries: DataFrame, pattern: str) -> DataFrame:
    """Paths that a glob by segments names, in order."""
    return entries.where(F.col("path").rlike(path_regex(pattern))).select("path").orderBy("path")


def jobs(table: DataFrame, state: str = "", limit: int = 100, most: int = 1000) -> DataFrame:
    """Newest jobs first, of one state if given; the limit lies between 1 and ``most``."""
    chosen = table.where(F.col("state") == state) if state else table
    return chosen.orderBy(F.desc("started_at"), "job_id").limit(max(1, min(limit, most)))


def expired(dirs: DataFrame, active: DataFrame, now: float, days: float) -> DataFrame:
    """Job folders older than ``days`` that no active job owns; 0 days: none."""
    if days <= 0:
        return dirs.limit(0)
    return dirs.where(F.col("mtime") <= now - days * 86400).join(active.select("job_id"), "job_id", "left_anti")

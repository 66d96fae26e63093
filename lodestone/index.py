"""From a source (a folder or a hosted repository) to written fact tables and rollups."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import classify
from lodestone.operators import analysis, inventory, rollup
from lodestone.plans.durable import durable
from lodestone.sources import artifacts, hosted, tree, walk

ROLLUPS = ("languages", "all_symbols", "top_level_symbols", "entry_points", "skipped_by_reason", "errors", "tree", "manifest")


def _local(spark: SparkSession, root: str, respect_ignore: bool, extra: Sequence[str], max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """All entries of a folder, and the files that are analysed."""
    root = tree.checked_root(root)
    lines: list[str] = []
    own = os.path.join(root, ".gitignore")
    if respect_ignore and os.path.isfile(own):
        with open(own, encoding="utf-8", errors="replace") as f:
            lines = f.read().splitlines()
    files = durable(walk.read_files(walk.walk(spark, root, lines, extra), root, max_bytes), "tree")
    marked = inventory.classify_files(files, ignore_lines=lines, extra_globs=extra, max_bytes=max_bytes, binary=classify.looks_binary(F.col("content")))
    return marked.select(*inventory.ENTRY), marked.where("analyzed").select("path", "content")


def _hosted(spark: SparkSession, repo: hosted.Repository, ref: str, respect_ignore: bool, extra: Sequence[str], max_bytes: int, get) -> tuple[DataFrame, DataFrame]:
    """The same for a repository that is fetched file by file; what can't be fetched is not analysed."""
    ref = hosted.checked_ref(ref) or hosted.default_branch(repo, get) or ""
    listing = hosted.inventory(spark, repo, ref, get)
    if listing is None:
        raise ValueError(f"no full listing of {repo.owner}/{repo.name}")
    own = (get(hosted.raw_url(repo, ref, ".gitignore"), hosted.headers(repo), None) or b"") if respect_ignore else b""
    lines = own.decode("utf-8", "replace").splitlines()
    entries = durable(inventory.classify_files(listing, ignore_lines=lines, extra_globs=extra, max_bytes=max_bytes), "entries")
    files = durable(hosted.fetch(entries.where("analyzed"), repo, ref, get), "fetched")
    return entries.select(*inventory.ENTRY), files.where("content is not null").select("path", "content")


def index(
    spark: SparkSession, source: str, out: str, *, ref: str = "", respect_ignore: bool = True, extra_globs: Sequence[str] = (),
    max_file_bytes: int = classify.MAX_FILE_BYTES, include_chunks: bool = True, chunk_max_tokens: int = analysis.CHUNK_TOKENS, get=hosted.http_get,
    artifact_folder: str = "",
) -> DataFrame:
    """Analyse ``source`` and write facts and rollups under ``out``; returns the manifest's row.

    Rollups come first, facts after them, the index of all tables last: where it is, all is.
    ``artifact_folder``: a mounted folder that gets a JSON file per source file, under its path.
    """
    repo = hosted.repository(source)
    if repo is None and "://" in source:
        raise ValueError(f"unsupported source {source!r}")
    entries, files = _hosted(spark, repo, ref, respect_ignore, extra_globs, max_file_bytes, get) if repo else _local(spark, source, respect_ignore, extra_globs, max_file_bytes)
    facts = analysis.analyze(files, include_chunks, chunk_max_tokens)
    sums = durable(analysis.summaries(facts), "summaries")
    named = facts.symbols.select("qualified_name", "kind", "name", "language", F.col("path").alias("file"), "span")
    counts = entries.agg(F.count(F.lit(1)).alias("tree_total"), F.count_if(~F.col("analyzed")).alias("skipped_count")).first()
    manifest = rollup.manifest(sums).withColumns({name: F.lit(counts[name]) for name in counts.asDict()})
    tables = {
        "languages": rollup.languages(sums),
        "all_symbols": named.orderBy("qualified_name", "file"),
        "top_level_symbols": rollup.top_level(named).orderBy("qualified_name", "file"),
        "entry_points": rollup.entry_points(sums),
        "skipped_by_reason": rollup.skipped_by_reason(entries),
        "errors": rollup.parse_errors(sums),
        "tree": entries.orderBy("path"),
        "manifest": manifest,
    }
    for name in ROLLUPS:
        tables[name].write.mode("overwrite").parquet(f"{out}/rollups/{name}")
    if artifact_folder:
        artifacts.write_artifacts(analysis.artifacts(facts), artifact_folder)
    analysis.write(facts, out)
    return spark.read.parquet(f"{out}/rollups/manifest")

"""The files of a folder, found level by level: folders are rows, and each wave lists those of the last.

A folder that is never read or that an ignore rule names is left out before it is entered, so
nothing below it is listed or recorded. Listings are made by tasks and stay in tables; the driver
learns only whether a wave found more folders. The folder is one that driver and tasks all mount.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import gitignore
from lodestone.functions.classify import MAX_FILE_BYTES, SKIPPED_FOLDERS
from lodestone.plans.durable import durable
from lodestone.schema import FILES

#: Files whose content goes to Spark at once, by bytes.
BATCH_BYTES = 16 * 1024 * 1024


def _listing(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = []
                try:
                    with os.scandir(os.path.join(root, folder)) as entries:
                        for e in entries:
                            path = f"{folder}/{e.name}" if folder else e.name
                            if e.is_dir(follow_symlinks=False):
                                rows.append((path, True, 0))
                            elif e.is_file():
                                rows.append((path, False, e.stat().st_size))
                except OSError:
                    pass  # a folder that can't be read has no entries
                columns = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.int64())], ["path", "is_folder", "size"])

    return run


def walk(spark: SparkSession, root: str, ignore_lines: Sequence[str] = (), extra_globs: Sequence[str] = ()) -> DataFrame:
    """``path, size`` of all files under ``root`` but for those below skipped or ignored folders.

    A file that a rule names itself is listed; links to folders are not followed.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frontier = spark.createDataFrame([("",)], "folder string")
    found = spark.createDataFrame([], "path string, size long")
    inside = F.concat("path", F.lit("/"))
    pruned = F.element_at(F.split("path", "/"), -1).isin(*SKIPPED_FOLDERS) | gitignore.ignored(inside, ignore_lines) | gitignore.ignored(inside, extra_globs)
    while True:
        wave = durable(frontier.repartition(parts, "folder").mapInArrow(_listing(root), "path string, is_folder boolean, size long"), "wave")
        found = found.unionByName(wave.where("not is_folder").select("path", "size"))
        frontier = wave.where("is_folder").where(~pruned).select(F.col("path").alias("folder"))
        if frontier.isEmpty():
            return found


def read_files(files: DataFrame, root: str, max_bytes: int = MAX_FILE_BYTES, tasks: int | None = None) -> DataFrame:
    """``path, size, content`` of ``files`` (``path, size``) under ``root``; content is null where a file is too large or can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                content = None
                if size <= max_bytes:
                    try:
                        with open(os.path.join(root, path), "rb") as f:
                            content = f.read()
                    except OSError:
                        content = None
                rows.append((path, size, content))
                held += len(content or b"")
                if held >= BATCH_BYTES:
                    yield _contents(rows)
                    rows, held = [], 0
            yield _contents(rows)

    spread = files.select("path", "size").repartition(tasks or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(run, FILES)


def _contents(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()))], ["path", "size", "content"])

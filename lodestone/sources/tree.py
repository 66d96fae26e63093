"""A folder of source files as a DataFrame, hidden and underscored names included.

Spark's own binary reader leaves out every path with a part that begins with ``_`` or
``.``; this source lists with ``os.walk`` and packs files into partitions of like size.
It reads a folder that the driver and the executors both mount.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.functions.classify import MAX_FILE_BYTES, SKIPPED_FOLDERS
from lodestone.schema import FILES

PARTITION_BYTES = 64 * 1024 * 1024


class _Slice(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        super().__init__(len(files))
        self.files = files


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.most = int(options.get("max_file_bytes", MAX_FILE_BYTES))
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        found = []
        for folder, names, files in os.walk(self.root):
            names[:] = sorted(n for n in names if n not in SKIPPED_FOLDERS)
            for name in files:
                full = os.path.join(folder, name)
                if os.path.isfile(full):
                    found.append((os.path.relpath(full, self.root).replace(os.sep, "/"), os.path.getsize(full)))
        slices, held = [[]], 0
        for path, size in sorted(found):
            if held and held + min(size, self.most) > self.partition_bytes:
                slices.append([])
                held = 0
            slices[-1].append((path, size))
            held += min(size, self.most) + 4096
        return [_Slice(s) for s in slices]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for path, size in partition.files:
            content = None
            if size <= self.most:
                try:
                    with open(os.path.join(self.root, path), "rb") as f:
                        content = f.read()
                except OSError:
                    content = None
            yield path, size, content


class TreeSource(DataSource):
    """``spark.read.format("source_tree").load(folder)``: ``path, size, content``."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


def checked_root(root: str) -> str:
    """An absolute folder that is there."""
    if not os.path.isabs(root) or ".." in root.split(os.sep) or not os.path.isdir(root):
        raise ValueError(f"not an absolute folder: {root!r}")
    return root


def read_tree(spark: SparkSession, root: str, **options: int) -> DataFrame:
    """Files under ``root``; content is null where a file is too large or can't be read.

    The driver lists the folder; ``sources.walk`` does that in tasks.
    """
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").options(**options).load(checked_root(root))

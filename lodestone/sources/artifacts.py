"""One JSON file per source file, under its path: all of a write's files appear, or none does.

Tasks write into a staging folder of the write; the commit moves the files of the tasks that
count to their places, and an aborted write removes the staging folder and leaves nothing. The
folder is one that driver and tasks all mount.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

_MOVERS = 32


@dataclass
class _Written(WriterCommitMessage):
    """The folder of a task that ended well, and how many files are in it."""

    folder: str
    files: int


def _below(root: str, path: str) -> str:
    """Where the artefact of ``path`` stands; a path that leads out of ``root`` is an error."""
    full = os.path.normpath(os.path.join(root, path + ".json"))
    if not path or os.path.isabs(path) or not full.startswith(os.path.normpath(root) + os.sep):
        raise ValueError(f"not a path below the folder: {path!r}")
    return full


class _ArtifactWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.root = os.path.abspath(options["path"])
        self.staging = os.path.join(self.root, f".staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        folder = os.path.join(self.staging, uuid.uuid4().hex)
        os.makedirs(folder, exist_ok=True)
        files = 0
        for row in iterator:
            full = _below(folder, row["path"])
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "w", encoding="utf-8") as f:
                f.write(row["body"])
            files += 1
        return _Written(folder, files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        def move(pair: tuple[str, str]) -> None:
            os.makedirs(os.path.dirname(pair[1]), exist_ok=True)
            os.replace(*pair)

        def staged() -> Iterator[tuple[str, str]]:
            for message in filter(None, messages):
                for folder, _, names in os.walk(message.folder):
                    for name in names:
                        full = os.path.join(folder, name)
                        yield full, os.path.join(self.root, os.path.relpath(full, message.folder))

        with ThreadPoolExecutor(_MOVERS) as pool:
            for _ in pool.map(move, staged()):
                pass
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class ArtifactSink(DataSource):
    """``df.write.format("code_artifacts").mode("append").save(folder)`` of ``path, body``."""

    @classmethod
    def name(cls) -> str:
        return "code_artifacts"

    def schema(self) -> str:
        return "path string, body string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ArtifactWriter(self.options)


def write_artifacts(artifacts: DataFrame, folder: str) -> None:
    """A file ``<folder>/<path>.json`` per row of ``artifacts`` (``path, body``); an older one is replaced whole."""
    artifacts.sparkSession.dataSource.register(ArtifactSink)
    artifacts.select("path", "body").write.format("code_artifacts").mode("append").save(folder)

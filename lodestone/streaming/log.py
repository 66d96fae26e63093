"""An append-only event log: one JSON object per line, read by byte offset."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lodestone.plans.ordered import running_total
from lodestone.schema import LOG_EVENT

LIMIT = 100_000
#: Bytes of a log that a task reads.
RANGE_BYTES = 8 * 1024 * 1024


def _event(line: bytes) -> tuple | None:
    """``ts, event, line`` of a line that is a JSON object."""
    try:
        event = json.loads(line)
        return (float(event.get("ts") or 0.0), event.get("event"), line.decode("utf-8", "replace").rstrip("\n")) if isinstance(event, dict) else None
    except (ValueError, TypeError):
        return None


def read_from(path: str, offset: int, limit: int = LIMIT) -> tuple[list[tuple], int]:
    """Events after ``offset`` and the offset behind them.

    A last line without its end is left for the next read; a line that is no JSON object
    is passed over. For a short look at a log; ``tail`` reads one of any length.
    """
    rows: list[tuple] = []
    if not os.path.exists(path):
        return rows, offset
    with open(path, "rb") as f:
        f.seek(offset)
        while len(rows) < limit:
            line = f.readline()
            if not line.endswith(b"\n"):
                break
            offset += len(line)
            if (row := _event(line)) is not None:
                rows.append((*row, offset))
    return rows, offset


class _Range(InputPartition):
    """Lines whose end is a byte from ``start`` on and before ``end``."""

    def __init__(self, start: int, end: int) -> None:
        super().__init__((start, end))
        self.start, self.end = start, end


def _line_start(f, at: int, block: int = 1 << 16) -> int:
    """Where the line that goes on at byte ``at`` began."""
    while at > 0:
        low = max(0, at - block)
        f.seek(low)
        found = f.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def read_range(path: str, start: int, end: int) -> Iterator[tuple]:
    """Events of the lines that end in a range of bytes; what has no end yet belongs to a later range."""
    if not os.path.exists(path):
        return
    with open(path, "rb") as f:
        at = _line_start(f, start)
        f.seek(at)
        while at < end:
            line = f.readline()
            at += len(line)
            if not line.endswith(b"\n") or at > end:
                return
            if (row := _event(line)) is not None:
                yield (*row, at)


def _ranges(low: int, high: int, width: int) -> list[_Range]:
    return [_Range(at, min(at + width, high)) for at in range(low, high, width)]


def _size(path: str) -> int:
    return os.path.getsize(path) if os.path.exists(path) else 0


class _BatchReader(DataSourceReader):
    """All of a log file by ranges of bytes."""

    def __init__(self, options: dict) -> None:
        self.path, self.width = options["path"], max(1, int(options.get("range_bytes", RANGE_BYTES)))

    def partitions(self) -> Sequence[InputPartition]:
        return _ranges(0, _size(self.path), self.width) or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        return read_range(self.path, partition.start, partition.end)


class _RangeReader(DataSourceStreamReader):
    """A log file that grows: the driver knows its size only, tasks find the lines."""

    def __init__(self, options: dict) -> None:
        self.path, self.width = options["path"], max(1, int(options.get("range_bytes", RANGE_BYTES)))
        self.most = int(options.get("max_bytes", 0))
        self.seen = 0

    def initialOffset(self) -> dict:
        return {"byte": 0}

    def latestOffset(self) -> dict:
        size = _size(self.path)
        # What was read is known from the first batch on, so only that one may be larger.
        self.seen = max(self.seen, min(size, self.seen + self.most) if self.most else size)
        return {"byte": self.seen}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.seen = max(self.seen, end["byte"])
        return _ranges(start["byte"], end["byte"], self.width)

    def read(self, partition: _Range) -> Iterator[tuple]:
        return read_range(self.path, partition.start, partition.end)

    def commit(self, end: dict) -> None:
        self.seen = max(self.seen, end["byte"])


class LogSource(DataSource):
    """``spark.readStream.format("event_log").load(file)``, or ``spark.read``: ``ts, event, line, next_offset``."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return LOG_EVENT

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _RangeReader(self.options)

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options)


def tail(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, max_bytes: int = 0) -> DataFrame:
    """The log as a stream of events; a task reads ``range_bytes``, a batch ``max_bytes`` (0: all there is)."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format("event_log").option("range_bytes", range_bytes).option("max_bytes", max_bytes).load(path)


#: What a file's end in the log of an analysis says.
DONE = "ts double, event string, path string, language string, n_symbols bigint, parse_ok boolean, bytes bigint"


def append(events: DataFrame, folder: str) -> None:
    """``events`` as further lines of JSON in a log that is a folder: each write adds files and changes none."""
    events.write.mode("append").json(folder)


def follow(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """A log that is a folder as a stream; executors read it, the driver lists it."""
    return spark.readStream.schema(DONE).option("maxFilesPerTrigger", files_a_batch).json(folder)


def offsets(lines: DataFrame, order: str, line: str = "line") -> DataFrame:
    """``lines`` with ``next_offset``, the byte behind each line in a log written in this order."""
    return running_total(lines, [F.col(order)], F.octet_length(line) + 1, "next_offset")


def window_of(lines: DataFrame, order: str, from_offset: int, limit: int, line: str = "line") -> DataFrame:
    """The first ``limit`` lines that begin at ``from_offset`` or later."""
    placed = offsets(lines, order, line)
    return placed.where(F.col("next_offset") - F.octet_length(line) - 1 >= from_offset).orderBy(order).limit(max(1, min(limit, LIMIT)))


def event_rates(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and window of a stream (or a table) with column ``ts``; late rows are dropped in a stream."""
    kind = events.schema["ts"].dataType
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").cast(kind).alias("window_start"), "event_type", "n"
    )

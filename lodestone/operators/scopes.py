"""What encloses each statement and where each block ends, by one pass over a file's statements.

Statements are dealt by file and sorted; a task streams them with the stack of blocks that are
open. It holds no more than that stack, however long a file or deep its nesting, and each
statement costs the same at any depth, but for the named scopes that it is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, s long, level int, scopes array<struct<kind:string,name:string,s:long>>, after_typedef boolean, block_end int, block_line int"
_TYPES = [
    ("path", pa.string()), ("s", pa.int64()), ("level", pa.int32()),
    ("scopes", pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("s", pa.int64())]))),
    ("after_typedef", pa.bool_()), ("block_end", pa.int32()), ("block_line", pa.int32()),
]


class _File:
    """One file's open blocks, outermost first, and the rows that are done."""

    def __init__(self, done: list[list]):
        self.done, self.open, self.named, self.recent = done, [], [], {}
        self.last: tuple[int | None, int | None] = None, None

    def close(self, level: int, end: int | None = None, line: int | None = None) -> None:
        """End all open blocks from ``level`` inwards."""
        while self.open and self.open[-1][0] >= level:
            _, row, named = self.open.pop()
            if named:
                self.named.pop()
            self.done.append([*row, end, line])

    def enter(self, level: int, row: list, kind: str | None, name: str | None) -> None:
        if name:
            self.named.append({"kind": kind, "name": name, "s": row[1]})
        self.open.append((level, row, bool(name)))

    def outer(self, level: int) -> list[dict]:
        """The named blocks that are open on levels outside of ``level``."""
        inside = sum(named for at, _, named in self.open if at >= level) if self.open and self.open[-1][0] >= level else 0
        return self.named[: len(self.named) - inside]

    def indented(self, r: dict) -> None:
        if not r["shown"]:
            self.done.append([r["path"], r["s"], 0, [], False, None, None])
            return
        self.close(r["lead"], *self.last)
        self.last = r["end"], r["end_line"]
        self.enter(r["lead"], [r["path"], r["s"], len(self.open), list(self.named), False], r["kind"], r["name"])

    def braced(self, r: dict) -> None:
        level = max(r["depth"], 0)
        row = [r["path"], r["s"], level, self.outer(level), self.recent.get(level, False)]
        if r["closes"]:
            self.close(level - 1, r["end"], r["end_line"])
        if r["opens"]:
            self.close(level)
            self.recent[level] = r["typedef"]
            self.enter(level, row, r["kind"], r["name"])
        else:
            self.done.append([*row, None, None])


def _nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[list] = []
    path, file = None, _File(done)
    for batch in batches:
        for row in batch.to_pylist():
            if row["path"] != path:
                file.close(-1, *file.last)
                path, file = row["path"], _File(done)
            file.indented(row) if row["indented"] else file.braced(row)
        yield _batch(done)
        done.clear()
    file.close(-1, *file.last)
    yield _batch(done)


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in _TYPES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _TYPES)], [n for n, _ in _TYPES])


def nest(statements: DataFrame) -> DataFrame:
    """``path, s, level, scopes, after_typedef, block_end, block_line`` of statements with ``path, s, indented,
    shown, lead, depth, opens, closes, typedef, start, line, end, end_line, kind, name``.

    A block in braces lasts from a statement that opens one to the one that closes it, and has no
    end where nothing does; in an indented language every statement lasts as long as those after
    it are further in. ``after_typedef``: the last block on this level was a ``typedef``'s.
    """
    rows = statements.select(
        "path", F.col("s").cast("long").alias("s"), "indented", "shown", "lead", "depth", "opens", "closes", "typedef", "start", "line", "end", "end_line", "kind", "name",
    )
    return rows.repartition("path").sortWithinPartitions("path", "s").mapInArrow(_nest, SCHEMA)

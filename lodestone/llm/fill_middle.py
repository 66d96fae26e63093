"""Fill-in-the-middle transformation over seekable compressed frames.

A text is stored once as independent zstandard frames of a fixed number of code points, one
behind the other (so the blob is a valid zstandard file), with the count of units that end
before each frame. A cut after ``c`` units lies in the frame whose counts enclose ``c``; only
that frame is decompressed to find its place. Output, its digest and the way back are streamed
frame by frame in order, so besides the compressed text no more than a few frames are held.

A unit is a word with the white space before it; white space at the end is one unit. A text
becomes ``<P>prefix<S>suffix<M>middle`` (psm), ``<S>suffix<P>prefix<M>middle`` (spm) or stays
as it is (plain).

Defined cases: null text is the empty text; an empty text and one that holds a mark are plain;
a null id is hashed as the empty string; repeated rows each give a row; texts may be of any
length, and a unit may be longer than a frame; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.durable import durable

#: Code points of a frame.
FRAME_CHARS = 16_384
LEVEL = 3
#: What stands before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The parts of the text (prefix 0, middle 1, suffix 2) in the order in which each form has them, and the mark before each.
ORDERS = {"psm": ((0, 0), (2, 1), (1, 2)), "spm": ((2, 1), (0, 0), (1, 2))}


def check_marks(marks: Sequence[str]) -> tuple[str, ...]:
    """Marks that can be told apart wherever they stand: none is empty, inside another, or overlaps one."""
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            overlaps = any(a.endswith(b[:k]) for k in range(1, len(b)))
            if not a or overlaps or (i != j and a in b):
                raise ValueError(f"marks {a!r} and {b!r} can be mistaken for each other")
    return tuple(marks)


# The frames of one text. -----------------------------------------------------------------------


class Frames:
    """One text's blob, the byte at which each frame begins, and the units that end up to there."""

    def __init__(self, blob: bytes, offsets: Sequence[int], units: Sequence[int], n: int, n_chars: int, size: int):
        self.blob, self.offsets, self.units, self.n, self.n_chars, self.size = blob, offsets, units, n, n_chars, size
        self._reader = zstandard.ZstdDecompressor()

    @classmethod
    def of(cls, text: str, size: int = FRAME_CHARS, writer: zstandard.ZstdCompressor | None = None) -> Frames:
        writer = writer or zstandard.ZstdCompressor(level=LEVEL)
        blob, offsets, units = bytearray(), [], []
        ends = [m.end() for m in WORD.finditer(text)]
        for start in range(0, len(text), size):
            offsets.append(len(blob))
            units.append(bisect_left(ends, start + 1))
            blob += writer.compress(text[start : start + size].encode())
        n = len(ends) + (bool(text) and (not ends or ends[-1] < len(text)))
        return cls(bytes(blob), offsets, units, n, len(text), size)

    def frame(self, k: int) -> str:
        end = self.offsets[k + 1] if k + 1 < len(self.offsets) else len(self.blob)
        return self._reader.decompress(self.blob[self.offsets[k] : end]).decode()

    def place(self, count: int) -> int:
        """The code point at which the first ``count`` units end; one frame is decompressed at most."""
        if count <= 0:
            return 0
        if count >= self.n:
            return self.n_chars
        k = bisect_left(self.units, count) - 1
        left = count - self.units[k]
        for m in WORD.finditer(self.frame(k)):
            left -= 1
            if not left:
                return k * self.size + m.end()
        raise ValueError(f"the index has a unit {count} in frame {k}, the frame has not")

    def read(self, start: int, end: int) -> Iterator[str]:
        """The text from ``start`` to ``end``, in pieces of a frame at most."""
        for k in range(start // self.size, -(-end // self.size)) if end > start else ():
            yield self.frame(k)[max(start - k * self.size, 0) : end - k * self.size]

    def output(self, form: str, cuts: tuple[int, int], marks: Sequence[str] = MARKS) -> Iterator[str]:
        """The transformed text, in order."""
        if form == "plain":
            yield from self.read(0, self.n_chars)
            return
        bounds = ((0, cuts[0]), cuts, (cuts[1], self.n_chars))
        for part, mark in ORDERS[form]:
            yield marks[mark]
            yield from self.read(*bounds[part])


def sections(pieces: Iterable[str], marks: Sequence[str]) -> Iterator[tuple[int, str]]:
    """A stream cut at ``marks``, which it holds once each and in this order: pieces with the number of their section.

    As much as a mark less one character is held back, for a mark that is itself cut.
    """
    at, held = -1, ""
    for piece in pieces:
        held += piece
        while at + 1 < len(marks) and (found := held.find(marks[at + 1])) >= 0:
            yield at, held[:found]
            held = held[found + len(marks[at + 1]) :]
            at += 1
        keep = len(marks[at + 1]) - 1 if at + 1 < len(marks) else 0
        if len(held) > keep:
            yield at, held[: len(held) - keep]
            held = held[len(held) - keep :]
    yield at, held


def restored(output: Callable[[], Iterable[str]], form: str, marks: Sequence[str] = MARKS) -> Iterator[str]:
    """The text that ``output`` was made of, from its form alone; the stream is read once for each part."""
    if form == "plain":
        yield from output()
        return
    order = ORDERS[form]
    for part in (0, 1, 2):
        wanted = next(i for i, (p, _) in enumerate(order) if p == part)
        yield from (piece for at, piece in sections(output(), [marks[m] for _, m in order]) if at == wanted)


def _digest(pieces: Iterable[str]) -> str:
    total = hashlib.sha256()
    for piece in pieces:
        total.update(piece.encode())
    return total.hexdigest()


# Tables. ---------------------------------------------------------------------------------------

_STORED = "n long, n_chars long, marked boolean, frame_chars int, offsets array<long>, units array<long>, blob binary"


def _pack(size: int, marks: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for value in batch.column(1):
                text = value.as_py() or ""
                frames = Frames.of(text, size, writer)
                row = (frames.n, frames.n_chars, any(m in text for m in marks), size, frames.offsets, frames.units, frames.blob)
                for column, x in zip(columns, row):
                    column.append(x)
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "n_chars", "marked", "frame_chars", "offsets", "units", "blob"])

    return run


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_chars: int = FRAME_CHARS, marks: Sequence[str] = MARKS) -> DataFrame:
    """Every text as frames: ``id, n, n_chars, marked, frame_chars, offsets, units, blob``, written once."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return durable(rows.mapInArrow(_pack(frame_chars, check_marks(marks)), f"id {kind}, {_STORED}"), "frames")


def plan(stored: DataFrame, salt: str = "42:", share: int = 50, spm_share: int = 80) -> DataFrame:
    """``stored`` with ``form`` and the cuts ``lo`` and ``hi`` in units, all drawn from the id's digest.

    ``share`` of a hundred texts are transformed, ``spm_share`` of a hundred of these as spm.
    """
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    first, second = (x % (F.col("n") + 1) for x in h[:2])
    form = F.when((F.col("n_chars") == 0) | F.col("marked") | (h[2] % 100 >= share), "plain").when(h[3] % 100 < spm_share, "spm").otherwise("psm")
    return stored.select("*", form.alias("form"), F.least(first, second).alias("lo"), F.greatest(first, second).alias("hi"))


def _each(give: Callable, names: Sequence[str], types: Sequence[pa.DataType], marks: Sequence[str]):
    """Rows of a plan as frames, one by one, to ``give``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in types]
            get = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                row = {name: get[name][i].as_py() for name in get if name != "id"}
                frames = Frames(row["blob"], row["offsets"], row["units"], row["n"], row["n_chars"], row["frame_chars"])
                form = row["form"]
                cuts = (0, 0) if form == "plain" else (frames.place(row["lo"]), frames.place(row["hi"]))
                for column, x in zip(columns, give(frames, form, cuts, marks)):
                    column.append(x)
            arrays = [batch.column("id"), batch.column("n"), batch.column("form"), *(pa.array(c, t) for c, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "form", *names])

    return run


def _digests(frames: Frames, form: str, cuts: tuple[int, int], marks: Sequence[str]) -> tuple:
    sizes = (None, None) if form == "plain" else (cuts[0], cuts[1] - cuts[0])
    output = lambda: frames.output(form, cuts, marks)
    return *sizes, _digest(output()), _digest(restored(output, form, marks))


def _text(frames: Frames, form: str, cuts: tuple[int, int], marks: Sequence[str]) -> tuple:
    return ("".join(frames.output(form, cuts, marks)),)


def _apply(planned: DataFrame, give: Callable, schema: str, types: Sequence[pa.DataType], marks: Sequence[str]) -> DataFrame:
    kind = planned.schema["id"].dataType.simpleString()
    rows = planned.select("id", "n", "n_chars", "frame_chars", "offsets", "units", "blob", "form", "lo", "hi")
    names = [column.split()[0] for column in schema.split(", ")]
    return rows.mapInArrow(_each(give, names, types, check_marks(marks)), f"id {kind}, n long, form string, {schema}")


def digests(planned: DataFrame, marks: Sequence[str] = MARKS) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``, all from streamed frames."""
    schema = "prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return _apply(planned, _digests, schema, (pa.int64(), pa.int64(), pa.string(), pa.string()), marks)


def outputs(planned: DataFrame, marks: Sequence[str] = MARKS) -> DataFrame:
    """``id, n, form, output``: the texts to train on."""
    return _apply(planned, _text, "output string", (pa.string(),), marks)


def restore(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that ``output`` was made of, as a column."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks))
    joined = lambda *at: F.concat(*[F.element_at(parts, i) for i in at])
    return F.when(form == "psm", joined(2, 4, 3)).when(form == "spm", joined(3, 4, 2)).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_chars: int = FRAME_CHARS, **draw) -> DataFrame:
    """Store ``docs`` as frames and draw forms and cuts; give the plan to ``digests`` or ``outputs``."""
    return plan(store(docs, id_col, text_col, frame_chars), **draw)

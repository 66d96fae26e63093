"""Measures of a file's text: bytes, lines, digest, token estimate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All line separators, and lines of white space only, by Unicode.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
BLANK = r"(?U)^[\s\x1c-\x1f]*$"


def decoded(content: Column) -> Column:
    """Bytes as text, with the replacement character where they are no UTF-8."""
    return F.make_valid_utf8(content.cast("string"))


def lines(text: Column) -> Column:
    parts = F.split(text, LINE_END, -1)
    return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def n_lines(text: Column) -> Column:
    return F.size(lines(text)).cast("int")


def n_blank(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda x: x.rlike(BLANK))).cast("int")


def measured(text: Column) -> Column:
    """``struct<loc, blank>``: lines and blank lines, from one cut of the text."""

    def counted(parts: Column) -> Column:
        ends = F.when(F.get(parts, F.size(parts) - 1) == "", 1).otherwise(0)
        blank = F.size(F.filter(parts, lambda x: x.rlike(BLANK)))
        return F.struct((F.size(parts) - ends).cast("int").alias("loc"), (blank - ends).cast("int").alias("blank"))

    return F.get(F.transform(F.array(F.split(text, LINE_END, -1)), counted), F.lit(0))


def n_bytes(text: Column) -> Column:
    return F.octet_length(text)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.floor((F.octet_length(text) + 3) / 4).cast("int"))

"""Places of pattern matches in a text, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places are added up in blocks, so a text with very many costs little more for each.
BLOCK = 256
_EMPTY = "array<struct<at:int,end:int,text:string>>"


def located(text: Column, pattern: str) -> Column:
    """``array<struct<at, end, text>>`` of all matches, in characters from 0, ends exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    before = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    steps = F.zip_with(before, found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))
    empty = F.array().cast(_EMPTY)
    start = lambda to: F.struct(to.alias("to"), empty.alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        at = acc["to"] + x["gap"]
        end = at + F.length(x["m"])
        span = F.struct(at.alias("at"), end.alias("end"), x["m"].alias("text"))
        return F.struct(end.alias("to"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def add_block(acc: Column, first: Column) -> Column:
        return F.aggregate(
            F.slice(steps, first, BLOCK), start(acc["to"]), add,
            lambda got: F.struct(got["to"].alias("to"), F.concat(acc["spans"], got["spans"]).alias("spans")),
        )

    blocks = F.sequence(F.lit(1), F.size(found), F.lit(BLOCK))
    return F.when(F.size(found) > 0, F.aggregate(blocks, start(F.lit(0)), add_block, lambda acc: acc["spans"])).otherwise(empty)

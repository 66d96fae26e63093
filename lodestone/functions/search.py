"""Looking values up in sorted constants, by halving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def found_at(key: Column, keys: Column, count: int) -> Column:
    """The 0-based place of ``key`` among ``count`` different sorted ``keys``, or -1."""
    span = F.struct(F.lit(0).alias("lo"), F.lit(count).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        under = (s["lo"] < s["hi"]) & (F.get(keys, middle) < key)
        return F.struct(F.when(under, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(under, s["hi"]).otherwise(middle).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(max(1, count.bit_length())))
    return F.aggregate(steps, span, halve, lambda s: F.when(F.get(keys, s["lo"]) == key, s["lo"]).otherwise(-1))


def looked_up(probes: Column, table: dict[str, int]) -> Column:
    """The greatest value that ``table`` has for one of ``probes``, null for none. The table is a constant of the plan."""
    keys = sorted(table)
    names, values = _constant(keys, "string"), _constant([str(table[k]) for k in keys], "int")
    one = lambda p: F.get(values, F.nullif(found_at(p, names, len(keys)), F.lit(-1)))
    return F.array_max(F.transform(probes, one))


def _constant(items: Sequence[str], kind: str) -> Column:
    """A literal array; one text that is cut up once, when the plan is made. No item holds a line's end."""
    return F.split(F.lit("\n".join(items)), "\n").cast(f"array<{kind}>")

"""Brackets that do not match, as a sum that can be taken in any grouping.

A run of brackets comes down, for each type, to how many close nothing in it and how many it
leaves open. Two runs behind one another combine to one: what the first leaves open, the second
closes. That is associative, so a text may be cut anywhere, its runs reduced where they are and
combined pairwise, in one row or over many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIRS = ("()", "[]", "{}")
#: Brackets of a run.
RUN = 4096
#: How often neighbours that match are taken out of a run before what is left of it is folded.
ROUNDS = 8
_STATE = "struct<" + ",".join(f"c{i}:int,o{i}:int" for i in range(len(PAIRS))) + ">"


def _zero() -> Column:
    return F.struct(*[F.lit(0).alias(f"{side}{i}") for i in range(len(PAIRS)) for side in "co"])


def combine(left: Column, right: Column) -> Column:
    """What two runs behind one another leave."""
    parts = []
    for i in range(len(PAIRS)):
        met = F.least(left[f"o{i}"], right[f"c{i}"])
        parts += [(left[f"c{i}"] + right[f"c{i}"] - met).alias(f"c{i}"), (left[f"o{i}"] + right[f"o{i}"] - met).alias(f"o{i}")]
    return F.struct(*parts)


def _one_type(run: Column, opened: str, closed: str) -> Column:
    """``struct<c, o>`` of one type's brackets, the others gone.

    Neighbours that match go first, by plain replacement; what is left is folded by stretches of
    equal brackets, and not one by one.
    """
    for _ in range(ROUNDS):
        run = F.replace(run, F.lit(opened + closed), F.lit(""))

    def step(state: Column, stretch: Column) -> Column:
        n, opens = F.length(stretch), F.startswith(stretch, F.lit(opened))
        met = F.least(state["o"], n)
        return F.struct(
            F.when(opens, state["c"]).otherwise(state["c"] + n - met).alias("c"),
            F.when(opens, state["o"] + n).otherwise(state["o"] - met).alias("o"),
        )

    stretches = F.regexp_extract_all(run, F.lit(f"\\{opened}++|\\{closed}++"), F.lit(0))
    return F.aggregate(stretches, F.struct(F.lit(0).alias("c"), F.lit(0).alias("o")), step)


def reduce_run(run: Column) -> Column:
    """``struct<c0, o0, ...>`` of a text of brackets: per type, how many close nothing and how many stay open."""
    every, types = "".join(PAIRS), []
    for i, (opened, closed) in enumerate(PAIRS):
        others = every.replace(opened, "").replace(closed, "")
        types.append(_one_type(F.translate(run, others, ""), opened, closed).alias(f"t{i}"))
    # Bound to a variable, as each type's two numbers are asked for.
    bound = F.transform(F.array(F.struct(*types)), lambda t: F.struct(*[t[f"t{i}"][side].alias(f"{side}{i}") for i in range(len(PAIRS)) for side in "co"]))
    return F.get(bound, F.lit(0))


def reduce_text(marks: Column, run: int = RUN) -> Column:
    """The same of a text of brackets of any length, run by run."""

    def reduced(text: Column) -> Column:
        starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text), F.lit(run))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(F.transform(starts, lambda s: reduce_run(F.substring(text, s, F.lit(run)))), _zero(), combine)

    # Bound to a variable: the text is made once, and not again for each run.
    return F.get(F.transform(F.array(marks), reduced), F.lit(0))


def only_brackets(text: Column) -> Column:
    return F.regexp_replace(text, r"[^()\[\]{}]+", "")


def combined(runs: DataFrame, by: str, order: str, state: str = "state") -> DataFrame:
    """``by, state``: the runs of each text, in ``order``, combined to one.

    A run is six numbers, so what meets for one text is small beside it.
    """
    gathered = runs.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, state))).alias("runs"))
    return gathered.select(by, F.aggregate(F.transform("runs", lambda r: r[state]), _zero(), combine).alias("state"))


def unclosed(state: Column) -> Column:
    """Brackets that stay open: as many closing ones are missing."""
    return sum((state[f"o{i}"] for i in range(1, len(PAIRS))), state["o0"])


def unopened(state: Column) -> Column:
    """Brackets that close nothing."""
    return sum((state[f"c{i}"] for i in range(1, len(PAIRS))), state["c0"])

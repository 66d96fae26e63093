"""Lists inside of one statement, taken apart by a fold over its tokens.

The fold carries a stack: of prefixes where a list in braces belongs to what stands before it
(``a::{b, c::{d, e}}``), or of open brackets where only commas outside of all of them separate
(``a = f(1, 2), b = [3, 4]``). Nesting may have any depth.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTED = r"\"(?:\\.|[^\"\\])*+\"|'(?:\\.|[^'\\])*+'|`(?:\\.|[^`\\])*+`"
_TREE = r"[{},]|[^{},]+"
_FLAT = rf"(?s){_QUOTED}|=>|[()\[\]{{}},]|[^()\[\]{{}},\"'`=]+|."
_COMMANDS = rf"(?s){_QUOTED}|\$\{{[^}}]*\}}|\|\||&&|\|&|>&|&>|\$\(|<\(|[|&()]|[^|&()\"'`$<>]+|."
_NONE = "array<string>"


def _empty() -> Column:
    return F.array().cast(_NONE)


def _with(out: Column, item: Column, when: Column | None = None) -> Column:
    kept = item != ""
    return F.when(kept if when is None else kept & when, F.concat(out, F.array(item))).otherwise(out)


def expand_tree(text: Column, joint: str = "::") -> Column:
    """The leaves of a tree of names in braces, each with all prefixes before it, in order."""
    bare = lambda x: F.regexp_replace(F.trim(x), f"(?:{joint})?\\s*$", "")
    under = lambda top, name: F.when(name == "", top).when(top == "", name).otherwise(F.concat(top, F.lit(joint), name))
    zero = F.struct(F.array(F.lit("")).alias("stack"), F.lit("").alias("now"), _empty().alias("out"))

    def step(state: Column, token: Column) -> Column:
        top, now = F.element_at(state["stack"], -1), bare(state["now"])
        leaf = F.when(F.trim(state["now"]) == "", "").otherwise(under(top, F.trim(state["now"])))
        opens, ends = token == "{", token.isin(",", "}")
        return F.struct(
            F.when(opens, F.concat(state["stack"], F.array(under(top, now))))
            .when((token == "}") & (F.size(state["stack"]) > 1), F.slice(state["stack"], 1, F.size(state["stack"]) - 1))
            .otherwise(state["stack"]).alias("stack"),
            F.when(opens | ends, "").otherwise(F.concat(state["now"], token)).alias("now"),
            F.when(ends, _with(state["out"], leaf)).otherwise(state["out"]).alias("out"),
        )

    def finish(state: Column) -> Column:
        top = F.element_at(state["stack"], -1)
        return _with(state["out"], F.when(F.trim(state["now"]) == "", "").otherwise(under(top, F.trim(state["now"]))))

    return F.aggregate(F.regexp_extract_all(text, F.lit(_TREE), F.lit(0)), zero, step, finish)


def split_outside(text: Column) -> Column:
    """The parts between commas that stand outside of all brackets and quotes, trimmed, in order."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), _empty().alias("out"))

    def step(state: Column, token: Column) -> Column:
        cut = (token == ",") & (state["depth"] <= 0)
        depth = state["depth"] + F.when(token.isin("(", "[", "{"), 1).when(token.isin(")", "]", "}"), -1).otherwise(0)
        return F.struct(
            depth.alias("depth"), F.when(cut, "").otherwise(F.concat(state["now"], token)).alias("now"),
            F.when(cut, _with(state["out"], F.trim(state["now"]))).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(F.regexp_extract_all(text, F.lit(_FLAT), F.lit(0)), zero, step, lambda s: _with(s["out"], F.trim(s["now"])))


def commands(text: Column, words: Sequence[str]) -> Column:
    """The simple commands of a shell line: parts of pipes, of lists by ``&&`` and ``||``, of subshells and substitutions.

    ``words`` may stand before a command; so may assignments. What follows a closed substitution is
    an argument, what stands in ``name=( )`` an array.
    """
    zero = F.struct(F.lit(True).alias("fresh"), F.array().cast("array<boolean>").alias("stack"), F.lit("").alias("now"), _empty().alias("out"))

    def step(state: Column, token: Column) -> Column:
        cut, opens, closes = token.isin("|", "||", "&&", "|&", "&"), token.isin("$(", "<(", "("), token == ")"
        array = (token == "(") & state["now"].rlike(r"=\s*$")
        done = F.trim(state["now"])
        inner = F.when(token == "(", state["fresh"] & ~array).otherwise(True)
        return F.struct(
            F.when(cut, True).when(opens, inner).when(closes, False).otherwise(state["fresh"]).alias("fresh"),
            F.when(opens, F.concat(state["stack"], F.array(token != "("))).when(closes & (F.size(state["stack"]) > 0), F.slice(state["stack"], 1, F.size(state["stack"]) - 1)).otherwise(state["stack"]).alias("stack"),
            F.when(cut | opens | closes, "").otherwise(F.concat(state["now"], token)).alias("now"),
            F.when(cut | opens | closes, _with(state["out"], done, state["fresh"])).otherwise(state["out"]).alias("out"),
        )

    parts = F.aggregate(F.regexp_extract_all(text, F.lit(_COMMANDS), F.lit(0)), zero, step, lambda s: _with(s["out"], F.trim(s["now"]), s["fresh"]))
    ahead = "|".join(words)
    named = rf"^(?:(?:{ahead}|!|\{{)\s+)*(?:[A-Za-z_]\w*=[^\s]*\s+)*([A-Za-z_./][\w./-]*)(?=\s|$)"
    return F.filter(F.transform(parts, lambda p: F.regexp_extract(p, named, 1)), lambda c: c != "")

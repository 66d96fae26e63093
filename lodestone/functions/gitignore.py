"""Ignore patterns and shell globs as regular expressions over paths."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.search import looked_up


def _segment(text: str) -> str:
    """One path segment with ``*``, ``?`` and ``[...]``, none of which crosses a slash."""
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := text.find("]", i + 2)) > 0:
            body = text[i + 1 : end]
            negated = body[0] in "!^"
            out += "[" + ("^" if negated else "") + body[negated:].replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(text):
            i += 1
            out += re.escape(text[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def rule(line: str) -> tuple[str, bool] | None:
    """``(regex, ignores)`` of one line, None for blanks and comments."""
    line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\n"))
    if not line or line.startswith("#"):
        return None
    ignores = not line.startswith("!")
    line = line if ignores else line[1:]
    only_folder = line.endswith("/")
    line = line.rstrip("/") if only_folder else line
    anchored = "/" in line
    parts = [p for p in line.lstrip("/").split("/") if p != ""]
    if not parts:
        return None
    body = "" if anchored else "(?:.*/)?"
    for i, part in enumerate(parts):
        last = i + 1 == len(parts)
        if part == "**":
            body += ".*" if last else "(?:.*/)?"
        else:
            body += _segment(part) + ("" if last else "/")
    return f"^{body}{'/' if only_folder else '(?:/|$)'}", ignores


_WILD = re.compile(r"[*?\[\\]")


def _kind(line: str) -> tuple[str, str, bool]:
    """How one line's paths can be looked up: ``(kind, key, only folders)``.

    ``name``: a part of the path is the key; ``end``: a part ends in the key, which begins with a
    dot; ``start``: a part begins with the key; ``root``: the path begins with the key's parts;
    else ``regex``.
    """
    line = line[1:] if line.startswith("!") else line
    only_folder = line.endswith("/")
    body = line.rstrip("/")
    if "/" not in body:
        if not _WILD.search(body):
            return "name", body, only_folder
        if body.startswith("*.") and not _WILD.search(body[1:]):
            return "end", body[1:], only_folder
        if body.endswith("*") and len(body) > 1 and not _WILD.search(body[:-1]):
            return "start", body[:-1], only_folder
    elif not _WILD.search(body):
        return "root", "/".join(p for p in body.lstrip("/").split("/") if p != ""), only_folder
    return "regex", "", only_folder


def ignored(path: Column, lines: Iterable[str]) -> Column:
    """Whether the last line that matches the path ignores it.

    Lines with a plain name, ending, beginning or root are kept as sorted keys with the number of
    the last line that has them, and a path's parts are looked up there; the others, as a rule few,
    are one regular expression for each run of lines that all ignore or all don't. The highest
    number decides, so the work grows with the logarithm of such lines.
    """
    tables: dict[tuple[str, bool], dict[str, int]] = {}
    runs: list[tuple[int, list[str]]] = []
    sign, fresh = None, True
    for number, line in enumerate(lines):
        if (found := rule(line)) is None:
            continue
        regex, ignores = found
        kind, key, only_folder = _kind(re.sub(r"(?<!\\)\s+$", "", line.rstrip("\n")))
        fresh, sign = fresh or ignores != sign, ignores
        if kind != "regex":
            tables.setdefault((kind, only_folder), {})[key] = 2 * number + ignores
            continue
        if fresh:
            runs.append((0, []))
        runs[-1] = (2 * number + ignores, [*runs[-1][1], regex])
        fresh = False
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    probes = {
        "name": lambda xs, _: xs,
        "end": lambda xs, _: F.flatten(F.transform(xs, lambda c: F.regexp_extract_all(c, F.lit(r"(?s)(?=(\..*))"), F.lit(1)))),
        "start": lambda xs, keys: F.flatten(F.transform(xs, lambda c: F.array(*[F.substring(c, 1, n) for n in sorted({len(k) for k in keys})]))),
        "root": lambda xs, _: F.transform(xs, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/")),
    }
    hits = [looked_up(probes[kind](folders if only_folder else parts, keys), keys) for (kind, only_folder), keys in tables.items()]
    hits += [F.when(path.rlike("|".join(f"(?:{r})" for r in regexes)), code) for code, regexes in runs]
    best = F.coalesce(F.greatest(F.lit(-2), F.lit(-2), *hits), F.lit(-2))
    return best % 2 == 1


def glob_regex(pattern: str) -> str:
    """A shell glob over whole paths; here ``*`` and ``?`` do cross slashes."""
    out = _segment(pattern).replace("[^/]*", ".*").replace("[^/]", ".")
    return f"(?s)^{out}$"


def path_regex(pattern: str) -> str:
    """A glob over paths by segments: ``*`` and ``?`` stay in a segment, ``**`` is any number of them."""
    parts = [p for p in pattern.strip("/").split("/") if p not in ("", ".")]
    body = ""
    for i, part in enumerate(parts):
        last = i + 1 == len(parts)
        body += (".*" if last else "(?:[^/]+/)*") if part == "**" else _segment(part) + ("" if last else "/")
    return f"(?s)^{body}$"


def glob_matches(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern)) if pattern else F.lit(True)

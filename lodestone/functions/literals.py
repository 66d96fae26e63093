"""Things of interest inside a string literal: urls, paths, routes, SQL, environment names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.spans import located

# What is looked for.
URL = r"(?U)\b(?:https?|wss?|grpc|postgres|mysql|redis|s3|file)://[^\s\x1c-\x1f'\"<>`]+"
URL_TAIL = ".,;:!?)]}'\""
PATH = r"(?<![A-Za-z0-9_/])(?:/|~/|\./|\.\./)[A-Za-z0-9_./\-]+/[A-Za-z0-9_./\-]+"
ROUTE = r"^/[A-Za-z0-9_\-./{}<>:*?]+$"
SQL_HEADS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE TABLE", "CREATE INDEX", "ALTER TABLE", "DROP TABLE", "WITH")
ENV = r"(?U)\b[A-Z][A-Z0-9_]{2,}\b"
ENV_CONTEXTS = ("getenv", "environ", "env[", "env.get", "process.env")
CONTEXT_CHARS = 64
SPACE = r"(?U)[\s\x1c-\x1f]"


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, rf"^{SPACE}+|{SPACE}+$", "")


def url_spans(value: Column) -> Column:
    """Urls without punctuation at their end, with their places."""
    return F.transform(
        located(value, URL),
        lambda s: F.struct(
            s["at"].alias("at"),
            (s["at"] + F.length(F.rtrim(s["text"], F.lit(URL_TAIL)))).alias("end"),
            F.rtrim(s["text"], F.lit(URL_TAIL)).alias("text"),
        ),
    )


def urls(value: Column) -> Column:
    return F.array_distinct(F.transform(url_spans(value), lambda s: s["text"]))


def paths(value: Column) -> Column:
    """Paths that begin or end in no url. Paths are disjoint, so only urls can claim their place."""
    claims = url_spans(value)
    free = F.filter(
        located(value, PATH),
        lambda p: ~F.exists(
            claims, lambda c: (c["at"] <= p["at"]) & (p["at"] < c["end"]) | (c["at"] < p["end"]) & (p["end"] <= c["end"])
        ),
    )
    return F.array_distinct(F.transform(free, lambda s: s["text"]))


def route(value: Column) -> Column:
    """The whole value where it is a route of two or more slashes, else null."""
    whole = stripped(value)
    return F.when(whole.rlike(ROUTE) & F.contains(F.substring(whole, 2, 1_000_000_000), F.lit("/")), whole)


def sql(value: Column) -> Column:
    """The value with single spaces where it begins like a statement, else null."""
    heads = "|".join(SQL_HEADS)
    return F.when(F.regexp_replace(F.upper(value), rf"^{SPACE}+", "").rlike(f"^(?:{heads})[ \n]"), F.regexp_replace(stripped(value), rf"{SPACE}+", " "))


def env_names(value: Column, context: Column) -> Column:
    """Names in capitals, if the text before the literal reads the environment."""
    near = F.lower(F.right(context, F.lit(CONTEXT_CHARS)))
    reads = F.lit(False)
    for needle in ENV_CONTEXTS:
        reads = reads | F.contains(near, F.lit(needle))
    found = F.array_distinct(F.regexp_extract_all(value, F.lit(ENV), F.lit(0)))
    return F.when(F.coalesce(reads, F.lit(False)), found).otherwise(F.array().cast("array<string>"))


def literals(value: Column, context: Column | None = None) -> Column:
    """``array<struct<kind, value>>`` of all kinds, each pair once."""
    tag = lambda kind: lambda v: F.named_struct(F.lit("kind"), F.lit(kind), F.lit("value"), v)
    one = lambda kind, v: F.transform(F.array_compact(F.array(v)), tag(kind))
    parts = [F.transform(urls(value), tag("url")), F.transform(paths(value), tag("path")), one("route", route(value)), one("sql", sql(value))]
    if context is not None:
        parts.append(F.transform(env_names(value, context), tag("env_var")))
    return F.concat(*parts)

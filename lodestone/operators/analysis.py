"""The analysis of a tree: from files to fact tables, and back to one row per file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lodestone.functions import classify, text
from lodestone.operators import chunking, enclosing, symbols
from lodestone.plans.durable import durable
from lodestone.streaming import log

CHUNK_TOKENS = 800


@dataclass
class Facts:
    """Tables by file path; ``files`` has the texts and what the paths say."""

    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    exports: DataFrame
    references: DataFrame
    literals: DataFrame
    chunks: DataFrame
    metrics: DataFrame
    parse: DataFrame
    docs: DataFrame


def described(files: DataFrame) -> DataFrame:
    """``files`` (``path, content``) with text, language, flags and measures."""
    decoded = files.withColumn("text", text.decoded(F.col("content"))) if "text" not in files.columns else files
    path, body = F.col("path"), F.col("text")
    first_line = F.substring_index("text", "\n", 1)
    return decoded.withColumn("measured", text.measured(body)).select(
        "path", "text", classify.language(path, first_line).alias("language"), text.digest(body).alias("sha256"),
        text.n_bytes(body).alias("bytes"), "measured.loc", "measured.blank",
        (F.col("measured.loc") - F.col("measured.blank")).alias("sloc"), classify.is_generated(path, body).alias("is_generated"),
        classify.is_test(path).alias("is_test"), classify.is_config(path).alias("is_config"),
    )


def _units(declared: DataFrame, max_tokens: int) -> DataFrame:
    """``path, start, end`` of the outermost statements; one over the limit is its inner statements instead, as far down as there are any."""
    order = Window.partitionBy("path").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    count = F.sum(F.col("begins").cast("int")).over(order)
    rows = declared.where("code <> ''").select("path", "s", "level", "start", "end", (F.col("level") == 0).alias("begins"))
    rows, level = durable(rows.withColumn("unit", count), "units"), 0
    while True:
        sizes = rows.groupBy("path", "unit").agg((F.max("end") - F.min("start")).alias("size"), F.max("level").alias("deepest"))
        wide = durable(sizes.where((F.col("size") > max_tokens * 4) & (F.col("deepest") > level)).select("path", "unit", F.lit(True).alias("wide")), "wide")
        if wide.isEmpty():
            break
        level += 1
        opened = F.col("begins") | F.coalesce("wide", F.lit(False)) & (F.col("level") == level)
        split = rows.join(wide, ["path", "unit"], "left").withColumn("begins", opened).drop("unit", "wide")
        rows = durable(split.withColumn("unit", count), "units")
    units = rows.groupBy("path", "unit").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    # The head of a block that was split ends where its first inner statement begins.
    following = F.lead("start").over(Window.partitionBy("path").orderBy("unit"))
    return units.select("path", "start", F.least("end", F.coalesce(following, F.col("end"))).alias("end"))


def chunks(declared: DataFrame, texts: DataFrame, found: DataFrame, max_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """``path, chunk, qualified_name, kind, span, text, token_estimate``: consecutive units merged to the limit.

    A chunk has the name and kind of the innermost symbol that holds its first byte, else
    ``<module>``. A file's text is encoded and cut once for all its chunks.
    """
    ranked = _units(declared, max_tokens).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("units"))
    estimate = F.transform("units", lambda u: F.greatest(F.lit(1), F.floor((u["end"] - u["start"] + 3) / 4).cast("int")))
    bounds = F.transform(chunking.chunk_bounds(estimate, max_tokens), lambda c: F.struct(
        F.element_at("units", c["first"])["start"].alias("start_byte"), F.element_at("units", c["last"])["end"].alias("end_byte")
    ))
    whole = ranked.select("path", bounds.alias("bounds")).join(texts.select("path", "text"), "path")

    def pieces(raw: Column) -> Column:
        piece = lambda at, end: F.decode(F.substring(raw, at + 1, end - at), "UTF-8")
        lines = lambda value: F.length(value) - F.length(F.replace(value, F.lit("\n"), F.lit("")))
        return F.transform("bounds", lambda b, i: F.struct(
            i.alias("chunk"), b["start_byte"].alias("start_byte"), b["end_byte"].alias("end_byte"), piece(b["start_byte"], b["end_byte"]).alias("text"),
            # Line breaks from the end of the chunk before, or from the start of the file, to the start of this one.
            lines(piece(F.coalesce(F.get("bounds", i - 1)["end_byte"], F.lit(0)), b["start_byte"])).alias("ahead"),
        ))

    bound = F.get(F.transform(F.array(F.encode("text", "UTF-8")), pieces), F.lit(0))
    cut = whole.select("path", F.explode(bound).alias("c")).select("path", "c.*")
    own = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    before = Window.partitionBy("path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    # Both are read more than once from here on, and are made once.
    lined = durable(cut.withColumn("start_line", (F.sum(F.col("ahead") + own).over(before) - own + 1).cast("int")).where(F.col("text").rlike(r"\S")), "cut")
    spans = durable(found.select(
        "path", F.struct("qualified_name", "kind").alias("symbol_id"), F.col("span.start_byte").alias("start"), F.col("span.end_byte").alias("end")
    ), "spans")
    points = lined.select("path", F.col("chunk").alias("point_id"), F.col("start_byte").alias("pos"))
    named = enclosing.enclosing_symbol(points, spans, "path").select("path", F.col("point_id").alias("chunk"), "symbol_id")
    span = F.struct("start_byte", "end_byte", "start_line", (F.col("start_line") + own).cast("int").alias("end_line"))
    return lined.join(named, ["path", "chunk"], "left").select(
        "path", "chunk", F.coalesce("symbol_id.qualified_name", F.lit("<module>")).alias("qualified_name"),
        F.coalesce("symbol_id.kind", F.lit("module")).alias("kind"), span.alias("span"), "text",
    ).withColumn("token_estimate", text.tokens(F.col("text")))


def analyze(files: DataFrame, include_chunks: bool = True, chunk_max_tokens: int = CHUNK_TOKENS) -> Facts:
    """All fact tables of ``files`` (``path`` and ``content`` or ``text``)."""
    known = durable(described(files), "files")
    declared = durable(symbols.declarations(known), "declarations")
    found = durable(symbols.symbols(declared), "symbols")
    cut = chunks(declared, known, found, chunk_max_tokens)
    return Facts(
        files=known, symbols=found, imports=symbols.imports(declared), exports=symbols.exports(declared, found),
        references=symbols.references(declared), literals=symbols.string_literals(declared),
        chunks=cut if include_chunks else cut.limit(0), metrics=symbols.metrics(declared, found), parse=symbols.parse_status(known),
        docs=symbols.module_docs(declared),
    )


def summaries(facts: Facts) -> DataFrame:
    """A row per file for the rollups; a file of no known language did not parse."""
    no_parser = F.col("language") == ""
    return (
        facts.files.drop("text", "sha256", "blank", "sloc").join(facts.metrics.select("path", "has_main_guard"), "path", "left").join(facts.parse, "path", "left")
        .select(
            "path", "language", "bytes", "loc", "is_test", "is_generated", "is_config", F.coalesce("has_main_guard", F.lit(False)).alias("has_main_guard"),
            (F.coalesce("parse_ok", F.lit(True)) & ~no_parser).alias("parse_ok"), F.coalesce("error_nodes", F.lit(0)).alias("error_nodes"),
            F.coalesce("missing_nodes", F.lit(0)).alias("missing_nodes"), F.when(no_parser, "no_parser").alias("parse_reason"),
        )
    )


def nested(facts: Facts) -> DataFrame:
    """One row per file with its facts as arrays, as the per-file artefacts have them."""

    def gathered(table: DataFrame, name: str) -> DataFrame:
        own = [c for c in table.columns if c not in ("path", "language")]
        return table.groupBy("path").agg(F.collect_list(F.struct(*own)).alias(name))

    counted = facts.files.drop("text").join(facts.metrics.select("path", F.col("comment_lines").alias("comment")), "path", "left")
    about = [F.coalesce(c, F.lit(0)).alias(c) if c == "comment" else F.col(c) for c in counted.columns]
    out = counted.select("path", "language", F.struct(*about).alias("file"))
    for name, table in (
        ("symbols", facts.symbols), ("imports", facts.imports), ("exports", facts.exports), ("references", facts.references),
        ("literals_of_interest", facts.literals), ("chunks", facts.chunks),
    ):
        out = out.join(gathered(table, name), "path", "left")
    metrics = facts.metrics.select("path", F.struct(*[c for c in facts.metrics.columns if c not in ("path", "comment_lines")]).alias("metrics"))
    parse = facts.parse.select("path", F.struct("parse_ok", "error_nodes", "missing_nodes").alias("parse"))
    return out.join(metrics, "path", "left").join(parse, "path", "left").join(facts.docs, "path", "left")


def artifacts(facts: Facts) -> DataFrame:
    """``path, language, body, size_bytes``: a file's facts as one JSON object, every key there even where it is null."""
    rows = nested(facts)
    body = F.to_json(F.struct(*[c for c in rows.columns if c not in ("path", "language")]), {"ignoreNullFields": "false"})
    return rows.select("path", "language", body.alias("body")).withColumn("size_bytes", F.octet_length("body").cast("long"))


def done_events(facts: Facts) -> DataFrame:
    """A ``file_done`` event per file: ``ts, event, path, language, n_symbols, parse_ok, bytes``."""
    counts = facts.symbols.groupBy("path").agg(F.count(F.lit(1)).alias("n_symbols"))
    return summaries(facts).join(counts, "path", "left").select(
        (F.unix_micros(F.current_timestamp()) / 1e6).alias("ts"), F.lit("file_done").alias("event"), "path", "language",
        F.coalesce("n_symbols", F.lit(0)).cast("long").alias("n_symbols"), "parse_ok", F.col("bytes").cast("long").alias("bytes"),
    )


def _observed(rows: DataFrame, seen: dict[str, Observation], name: str, *more: Column) -> DataFrame:
    """``rows``, counted under ``name`` as they are written."""
    seen[name] = Observation()
    return rows.observe(seen[name], F.count(F.lit(1)).alias("rows"), *more)


def write(facts: Facts, folder: str) -> dict[str, dict]:
    """Fact tables as Parquet, files by language, the files' artefacts, events appended to the log, and last the index of what was written.

    Returns counts by table (``rows``; of files their ``bytes`` and ``loc`` too, of parse states the
    ``errors``), which the writes take themselves.
    """
    seen: dict[str, Observation] = {}
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    files = _observed(facts.files.drop("text"), seen, "files", total("bytes"), total("loc"))
    files.write.mode("overwrite").partitionBy("language").parquet(f"{folder}/files")
    names = ("symbols", "imports", "exports", "references", "literals", "chunks", "metrics", "parse", "docs")
    for name in names:
        more = [F.count_if(~F.col("parse_ok")).alias("errors")] if name == "parse" else []
        _observed(getattr(facts, name), seen, name, *more).write.mode("overwrite").parquet(f"{folder}/{name}")
    _observed(artifacts(facts), seen, "artifacts").write.mode("overwrite").partitionBy("language").parquet(f"{folder}/artifacts")
    log.append(_observed(done_events(facts), seen, "log"), f"{folder}/log")
    counts = {name: one.get for name, one in seen.items()}
    spark = facts.files.sparkSession
    rows = [(n, f"{folder}/{n}", counts[n]["rows"]) for n in counts]
    spark.createDataFrame(rows, "name string, path string, rows long").coalesce(1).write.mode("overwrite").json(f"{folder}/index")
    return counts

"""Benchmark decontamination by a broadcast hash set of normalised n-grams (DataFrame functions only).

Words are runs of letters, digits and non-ASCII characters, with A-Z lower-cased. An
item's windows are its runs of 10 words; an item of fewer words is one window. Every run of
a document of as many words as a window has is hashed and looked up in a hash set of the
windows' hashes that every task holds. Where it hits, the words are cut out and compared as
text with the window, and every word inside a window's occurrence counts once.

The set is broadcast in slices of at most ``MAX_SET`` hashes, one scan for each slice, so its
size bounds no task and changes no method. Hits are rows of numbers by text, copies share
theirs; items stay rows until they are a document's list.

Defined cases: null text has no words; an item without words has no window; a window in
several items counts for each; repeated items and rows count as they are; an empty
benchmark hits nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.durable import durable, temporary_tables
from lodestone.plans.keyed import content_key, drop_rows, filter_by_keys

#: Words, before lower-casing: everything but ASCII that is no letter or digit.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Hashes that are broadcast at once, 16 bytes each.
MAX_SET = 1_000_000


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _word_hash(word: Column) -> Column:
    # Full lower-casing maps all spellings that agree in A-Z to one, which is all a first lookup needs.
    return F.xxhash64(F.lower(word))


def _with_runs(rows: DataFrame, sizes: Iterable[int]) -> DataFrame:
    """``rows`` (with ``h``, the words' hashes) and by size ``n`` a column ``run<n>``: the hash of every run of ``n`` words, by where it starts.

    A run's hash is made of the hashes of two parts, powers of two that all sizes share, so a size
    costs a word as many steps as the size has binary digits. Each power is a projection of its
    own, which the optimizer keeps apart as it is used twice.
    """
    sizes = sorted(sizes)

    def joined(left: Column, right: Column, shift: int) -> Column:
        count = F.greatest(F.lit(0), F.size(right) - shift)
        return F.zip_with(F.slice(left, 1, count), F.slice(right, shift + 1, count), lambda a, b: F.xxhash64(a, b))

    def run(n: int) -> Column:
        high = 1 << (n.bit_length() - 1)
        return F.col(f"run{high}") if n == high else joined(F.col(f"run{high}"), run(n - high), high)

    own, power = rows.columns, 1
    rows = rows.withColumn("run1", F.col("h"))
    while sizes and power * 2 <= sizes[-1]:
        half = F.col(f"run{power}")
        rows, power = rows.withColumn(f"run{power * 2}", joined(half, half, power)), power * 2
    return rows.select(*own, *[run(n).alias(f"run{n}") for n in sizes])


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``item, n, key, text`` per distinct window of an item: its number of words, its hash, its words."""
    items = benchmark.select(
        F.col(id_col).cast("string").alias("item"), F.transform(words(F.col(text_col)), lower_ascii).alias("w")
    ).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    cut = items.select("item", F.explode(F.transform(starts, lambda at: F.slice("w", at, window))).alias("w")).distinct()
    hashed = _with_runs(cut.select("item", F.size("w").alias("n"), "w", F.transform("w", _word_hash).alias("h")), range(1, window + 1))
    key = F.coalesce(*[F.when(F.col("n") == n, F.get(f"run{n}", F.lit(0))) for n in range(1, window + 1)])
    return hashed.select("item", "n", key.alias("key"), F.array_join("w", " ").alias("text"))


def _text_key(text_col: str) -> Column:
    return content_key(F.coalesce(F.col(text_col), F.lit("")))


def find_hits(
    docs: DataFrame, table: DataFrame, text_col: str = "text", max_set: int = MAX_SET
) -> DataFrame:
    """``k1, k2, at, n, text`` of all occurrences (``at`` from 0) of the windows in ``table`` in the distinct texts of ``docs``."""
    spark = docs.sparkSession
    keys = durable(table.select("n", "key").distinct(), "keys")
    sizes = {r["n"]: r["c"] for r in keys.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}  # at most WINDOW rows
    slices = max(1, -(-sum(sizes.values()) // max(1, max_set)))
    hashed = docs.select(_text_key(text_col).alias("k"), F.transform(words(F.col(text_col)), _word_hash).alias("h"))
    by_size = F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"run{n}").alias("keys")) for n in sorted(sizes)])
    found = spark.createDataFrame([], "k1 bigint, k2 bigint, n int, at int, key bigint")
    for part in range(slices) if sizes else ():
        runs = _with_runs(hashed, sizes).select("k.k1", "k.k2", F.explode(by_size).alias("r")).select("k1", "k2", "r.n", F.posexplode("r.keys").alias("at", "key"))
        own = keys.where(F.pmod(F.col("key"), F.lit(slices)) == part) if slices > 1 else keys
        found = found.unionByName(durable(runs.join(F.broadcast(own), ["n", "key"]).select("k1", "k2", "n", "at", "key"), "met"))
    found = durable(found.distinct(), "found")
    texts = durable(found.select("k1", "k2").distinct(), "texts")
    held = filter_by_keys(docs.select(_text_key(text_col).alias("k"), F.col(text_col).alias("text")).select("k.*", "text"), texts, ["k1", "k2"])
    cut = held.dropDuplicates(["k1", "k2"]).select("k1", "k2", words(F.col("text")).alias("w")).join(found, ["k1", "k2"]).select(
        "k1", "k2", "n", "at", "key", F.array_join(F.transform(F.slice("w", F.col("at") + 1, F.col("n")), lower_ascii), " ").alias("text")
    )
    kinds = table.select("n", "key", "text").distinct()
    return cut.join(kinds, ["n", "key", "text"], "left_semi").select("k1", "k2", "at", "n", "text")


def _merged(spans: Column) -> Column:
    """Spans ``(at, end)`` without overlaps, in order."""
    kind = "array<struct<at:int,end:int>>"
    span = lambda at, end: F.struct(at.alias("at"), end.alias("end"))
    zero = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast("struct<at:int,end:int>").alias("open"))

    def add(acc: Column, s: Column) -> Column:
        apart = acc["open"].isNull() | (s["at"] > acc["open"]["end"])
        closed = F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        return F.struct(
            F.when(apart, closed).otherwise(acc["done"]).alias("done"),
            F.when(apart, span(s["at"], s["end"])).otherwise(span(acc["open"]["at"], F.greatest(s["end"], acc["open"]["end"]))).alias("open"),
        )

    return F.aggregate(F.sort_array(spans), zero, add, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def marked_texts(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_set: int = MAX_SET,
) -> DataFrame:
    """``k1, k2, n_hit, items, spans`` per distinct text of ``docs`` that holds a window; spans in words, ends exclusive, without overlaps."""
    table = durable(windows(benchmark, item_col, item_text_col), "windows")
    hits = durable(find_hits(docs, table, text_col, max_set), "hits")
    spans = hits.groupBy("k1", "k2").agg(_merged(F.collect_set(F.struct(F.col("at"), (F.col("at") + F.col("n")).alias("end")))).alias("spans"))
    named = durable(hits.select("k1", "k2", "n", "text").distinct(), "named")
    items = named.join(table.select("n", "text", "item"), ["n", "text"]).groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["at"])
    return durable(spans.join(items, ["k1", "k2"]).select("k1", "k2", covered.alias("n_hit"), "items", "spans"), "marked", keep=True)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", max_set: int = MAX_SET,
) -> DataFrame:
    """``id, n_words, n_hit, n_items, items, spans`` per row of ``docs``; spans in words, ends exclusive, without overlaps."""
    marked = marked_texts(docs, benchmark, text_col, item_col, item_text_col, max_set)
    rows = docs.select(
        F.col(id_col), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("n_words"), _text_key(text_col).alias("k")
    )
    joined = rows.join(marked, (F.col("k.k1") == F.col("k1")) & (F.col("k.k2") == F.col("k2")), "left")
    none = F.array().cast("array<struct<at:int,end:int>>")
    return joined.select(
        id_col, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", none).alias("spans"),
    )


def _without(text: Column, spans: Column) -> Column:
    """``text`` without the words in ``spans`` and what follows each of them up to the next word."""
    gaps, found = F.split(text, WORD, -1), words(text)
    whole = F.zip_with(found, F.slice(gaps, 2, F.size(found)), lambda w, gap: F.concat(w, gap))
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["at"]), F.array(F.size(found)))
    ranges = F.zip_with(starts, ends, lambda at, end: F.struct(at.alias("at"), end.alias("end")))
    kept = lambda x: F.flatten(F.transform(ranges, lambda r: F.slice(x, r["at"] + 1, r["end"] - r["at"])))
    left = F.get(F.transform(F.array(whole), kept), F.lit(0))
    return F.concat(F.get(gaps, F.lit(0)), F.array_join(left, ""))


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, mode: str = "documents", id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``docs`` without the documents that hold a window, or (``mode="spans"``) without the words hit."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    with temporary_tables(docs.sparkSession):
        marked = marked_texts(docs, benchmark, text_col, item_col, item_text_col)
    if mode == "documents":  # what a text holds is the same in all its copies
        gone = marked.select("k1", "k2")
        return drop_rows(docs, _text_key(text_col), gone, gone.limit(0))
    rows = docs.select(F.struct(*docs.columns).alias("own"), _text_key(text_col).alias("k"))
    joined = rows.join(marked.select("k1", "k2", "spans"), (F.col("k.k1") == F.col("k1")) & (F.col("k.k2") == F.col("k2")), "left")
    text = F.col("own").getField(text_col)
    cut = F.when(F.col("spans").isNull(), text).otherwise(_without(text, F.col("spans")))
    return joined.select(*[cut.alias(c) if c == text_col else F.col("own").getField(c).alias(c) for c in docs.columns])

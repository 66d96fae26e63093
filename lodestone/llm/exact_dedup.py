"""Exact deduplication by content-defined chunk recipes.

A text is cut where its own content says so, every chunk gets a verified
identifier, and two texts are equal when their ordered identifier lists (recipes)
are. Only distinct chunks move, once per task that saw them; documents move as
lists of numbers.

An identifier is the chunk's 64-bit hash plus its rank among the different chunks
that share the hash. At 100 TB some chunks do share one, so all distinct chunks are
compared: hashes with a second chunk are found by an aggregate, and only documents
that hold such a chunk get their ranks looked up.

Defined cases: null text is the empty text; texts are compared after each run of
white space became one space; the smallest id stays, a null id only where all ids of
the group are null; repeated ids count as rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.durable import durable, temporary_tables
from lodestone.plans.keyed import content_key, drop_rows

#: A chunk ends after punctuation and a space, from MIN_CHARS on, at MAX_CHARS at last.
MIN_CHARS, MAX_CHARS = 1024, 8192


def squeeze(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` as one space. Single spaces are left as they are."""
    return F.regexp_replace(
        F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*+|\x20[\x20\x09-\x0D]++", " "
    )


def chunks(text: Column, low: int = MIN_CHARS, high: int = MAX_CHARS) -> Column:
    """Content-defined chunks, in order; joined they are the text again."""
    pattern = rf"(?s).{{{low},{high}}}?(?:[.,;:!?|]\x20|\z)|.{{1,{high}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _hash(chunk: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits) if bits < 64 else F.xxhash64(chunk)


def recipes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    low: int = MIN_CHARS, high: int = MAX_CHARS, hash_bits: int = 64,
) -> DataFrame:
    """``row, id, sha256, recipe`` of every row; equal recipes are equal texts.

    ``hash_bits`` under 64 makes hashes collide, for tests.
    """
    def cut_up(rows: DataFrame) -> DataFrame:
        return (
            rows.select("row", "id", squeeze(F.col("text")).alias("text"))
            .select("row", "id", F.sha2("text", 256).alias("sha256"), chunks(F.col("text"), low, high).alias("chunks"))
        )

    hashes = F.transform("chunks", lambda c: _hash(c, hash_bits)).alias("hashes")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    cut = cut_up(rows)
    listed = durable(cut.select("row", "id", "sha256", hashes), "hashes")
    distinct = (
        cut.select(F.explode("chunks").alias("chunk"))
        .groupBy(_hash(F.col("chunk"), hash_bits).alias("h"), "chunk")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    shared = durable(
        distinct.groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("h"),
        "shared",
    )
    if shared.isEmpty():
        return listed.select("row", "id", "sha256", F.transform("hashes", lambda h: F.struct(h.alias("h"), F.lit(0).alias("k"))).alias("recipe"))
    fixed = cut_up(durable(rows, "rows"))
    return _ranked(fixed, durable(fixed.select("row", "id", "sha256", hashes), "hashes"), shared, hash_bits)


def _ranked(cut: DataFrame, listed: DataFrame, shared: DataFrame, hash_bits: int) -> DataFrame:
    """Recipes where some hashes stand for several chunks.

    Chunks with such a hash are fetched once more, numbered by digest inside the
    hash, and their numbers put into the recipes by position.
    """
    parts = cut.select("row", F.posexplode("chunks").alias("at", "chunk")).withColumn(
        "h", _hash(F.col("chunk"), hash_bits)
    )
    met = durable(parts.join(shared.select("h"), "h").select("row", "at", "h", "chunk", F.sha2("chunk", 256).alias("d")), "met")
    kinds = met.select("h", "chunk", "d").distinct()
    names = kinds.groupBy("h").agg(F.sort_array(F.collect_set("d")).alias("all"))
    ranks = met.join(names, "h").select("row", "at", F.array_position("all", F.col("d")).cast("int").alias("k"))
    by_row = ranks.groupBy(F.col("row").alias("r")).agg(
        F.map_from_entries(F.collect_list(F.struct("at", "k"))).alias("ranks")
    )
    joined = listed.join(by_row, F.col("row") == F.col("r"), "left")
    recipe = F.transform(
        "hashes",
        lambda h, i: F.struct(h.alias("h"), F.coalesce(F.element_at(F.col("ranks"), i), F.lit(0)).alias("k")),
    )
    return joined.select("row", "id", "sha256", recipe.alias("recipe"))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64,
    low: int = MIN_CHARS, high: int = MAX_CHARS,
) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256, n_chunks``.

    Groups are counted by partial aggregation and joined back, so a group with a
    third of all rows is counted where its rows are and its join can be split.
    Of repeated rows with the smallest id exactly one is kept.
    """
    known = durable(recipes(docs, id_col, text_col, low, high, hash_bits), "recipes")
    # Written first: a join of two plain exchanges is one that a hot group's rows can be split in.
    groups = durable(
        known.groupBy("recipe")
        .agg(
            F.min("id").alias("keep_id"),
            F.count(F.lit(1)).alias("group_size"),
            F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))).alias("first"),
        )
        .select(F.col("recipe").alias("r"), "keep_id", "group_size", F.col("first.row").alias("keep_row")),
        "groups",
    )
    return known.join(groups, F.col("recipe") == F.col("r")).select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
        F.size("recipe").cast("long").alias("n_chunks"),
        "row",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one row of each group of equal texts, columns unchanged.

    Rows are named by a digest of id and text, so texts stay where they are; of rows
    that agree in both one is kept.
    """
    key = content_key(F.col(id_col), F.col(text_col))
    with temporary_tables(docs.sparkSession):
        keyed = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), key.alias("key")).alias("id"), F.col(text_col).alias("text"))
        known = durable(recipes(keyed, "id", "text").select("id", "recipe"), "recipes")
        first = durable(
            known.groupBy("recipe").agg(F.min("id").alias("first")).select(F.col("recipe").alias("r"), F.col("first.key").alias("stays")), "first"
        )
        rows = durable(known.join(first, F.col("recipe") == F.col("r")).select(F.col("id.key").alias("key"), (F.col("id.key") == F.col("stays")).alias("kept")), "rows")
        gone = durable(rows.where("not kept").select("key.*").distinct(), "gone", keep=True)
        repeated = durable(rows.where("kept").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key.*"), "repeated", keep=True)
    return drop_rows(docs, key, gone, repeated)

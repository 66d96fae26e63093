"""Near copies at a word-shingle similarity: fingerprint links widened by banded sketches.

Texts whose sets of 5-word shingles are 0.8 alike differ in 5 or 6 of 64 fingerprint bits
in the middle and in up to 13, which no table lookup reaches. So the multi-index links of
``simhash`` (2 bits) are joined by candidates from sketches: 64 minima of the same shingle
hashes in 16 bands of 4. Two texts 0.8 alike share a band with probability 0.9998.

A band's bucket emits a few pairs per member: with its most central member, that is the one
whose bands are shared most, and with two members drawn by a hash; in a bucket of ``FEW``
members or less with each of the others. Every pair is verified on the texts' whole shingle
sets.

Where these links leave a larger bucket in more than one group, all pairs of its rows across
groups are found by a prefix filter: two sets that are alike enough share one of the rarest
``n - ceil(similarity * n) + 1`` shingles of each. A bucket that is one group costs a bounded
number of rows per member; what else is compared grows with the pairs that share rare shingles.

Defined cases: null text is the empty text; texts without words are alike to each other
and to no other; a text of fewer words than a shingle is one shingle; of a group the row
with the smallest id stays, a null id only where all are null, and of repeated rows one;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.simhash import SEED, links_within_two
from lodestone.plans.durable import durable, temporary_tables
from lodestone.plans.keyed import content_key, drop_rows, filter_by_keys

SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS, ROUNDS = 16, 4, 3
#: Members of a bucket up to which each is compared with each.
FEW = 8
_A = np.random.default_rng(20).integers(1, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
BLOCK = 16384


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hash of each shingle in order, with repeats; words as in ``simhash``."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, stops, strict=True)), np.uint64, len(starts))


def _print(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashes), BLOCK):
        block = np.ascontiguousarray(hashes[low : low + BLOCK])
        counts += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((counts * 2 > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Band keys: minima under ``BANDS * BAND_ROWS`` multiplications, hashed by band."""
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK, None] * _A
        low = np.minimum(low, (part ^ (part >> np.uint64(29))).min(axis=0))
    bands = low.reshape(BANDS, BAND_ROWS)
    key = np.zeros(BANDS, np.uint64)
    for i in range(BAND_ROWS):
        key = (key ^ bands[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, keys = [], []
        for text in batch.column(2):
            hashes = shingle_hashes(text.as_py())
            prints.append(_print(hashes))
            keys.append(sketch(hashes) if len(hashes) else np.zeros(BANDS, np.int64))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(prints, pa.int64()), lists], ["k1", "k2", "print", "bands"]
        )


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(shingle_hashes(t.as_py())).view(np.int64) for t in batch.column(2)]
        ends = np.cumsum([0, *map(len, sets)])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["k1", "k2", "s"]
        )


def candidates(sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b``: pairs of rows to verify, at most ``FEW`` per row and bucket; and the rows ``band, key, row`` of larger buckets."""
    banded = sketched.select("row", F.posexplode("bands").alias("band", "key"))
    # Sums are written before they are joined back, so that a hot bucket or group can be split.
    sizes = durable(banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    shared = durable(banded.join(sizes, ["band", "key"]), "buckets")
    central = durable(shared.groupBy("row").agg(F.sum("n").alias("shared")), "central")
    ranked = shared.join(central, "row")
    orders = [F.struct("shared", "row"), *[F.struct(F.xxhash64("row", "band", F.lit(i)), "row") for i in range(1, ROUNDS)]]
    heads = durable(
        ranked.groupBy("band", "key").agg(*[F.max(o.cast("struct<o:bigint,row:bigint>")).alias(f"h{i}") for i, o in enumerate(orders)]), "heads"
    )
    pairs = shared.join(heads, ["band", "key"]).select(
        "row", F.explode(F.array_distinct(F.array(*[F.col(f"h{i}.row") for i in range(ROUNDS)]))).alias("head")
    )
    few = shared.where(F.col("n") <= FEW).select("band", "key", "row")
    close_by = few.join(few.withColumnRenamed("row", "head"), ["band", "key"]).where("row < head").select("row", "head")
    prints = durable(sketched.groupBy("print").agg(F.min("row").alias("first")), "first")
    same = sketched.join(prints, "print").select("row", F.col("first").alias("head"))
    close = links_within_two(prints.select("print"))
    one, two = (prints.select(F.col("print").alias(x), F.col("first").alias(f"r{x}")) for x in "ab")
    close = close.join(one, "a").join(two, "b").select(F.col("ra").alias("row"), F.col("rb").alias("head"))
    found = (
        pairs.unionByName(close_by).unionByName(same).unionByName(close).where("row <> head")
        .select(F.least("row", "head").alias("a"), F.greatest("row", "head").alias("b")).distinct()
    )
    return found, shared.where(F.col("n") > FEW).select("band", "key", "row")


def apart(crowded: DataFrame, links: DataFrame) -> DataFrame:
    """``row, root``: rows of the larger buckets that ``links`` leave in more than one group."""
    roots = durable(components(links.select("a", "b")), "grouped")
    placed = durable(
        crowded.join(roots, F.col("row") == F.col("node"), "left").select("band", "key", "row", F.coalesce("root", "row").alias("root")), "placed"
    )
    bounds = placed.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    split = durable(bounds.where("low <> high").select("band", "key"), "split")
    return durable(placed.join(split, ["band", "key"], "left_semi").select("row", "root").distinct(), "apart")


def pairs_across(sets: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: of ``rows`` (``row, root``) all pairs of two roots that can be alike enough.

    Where a shingle is the first that two sets share, both have at most what follows it in common
    besides; pairs for which this is too little at every shingle that they share are none.
    """
    owned = durable(sets.join(rows, "row").select("row", "root", F.size("s").alias("size"), "s"), "owned")
    words = owned.select("row", F.explode("s").alias("x"))
    counts = durable(words.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    ordered = words.join(counts, "x").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("shared"))
    # Shingles of one row alone are the rarest: they fill the prefix first and meet nothing.
    prefix = F.col("size") - F.ceil(F.col("size") * F.lit(similarity) - F.lit(1e-9)) + 1
    left = F.greatest(F.lit(0), prefix - (F.col("size") - F.size("shared"))).cast("int")
    keyed = durable(
        owned.select("row", "root", "size").join(ordered, "row")
        .select("row", "root", "size", F.size("shared").alias("met"), F.posexplode(F.slice("shared", F.lit(1), left)).alias("at", "k"))
        .select("row", "root", "size", "k.x", (F.col("met") - F.col("at")).alias("left")),
        "prefixes",
    )
    # Roots meet before rows do, so that rows of one group are never paired; what no two of their rows can reach is left out.
    groups = durable(keyed.groupBy("x", "root").agg(F.max("left").alias("l"), F.min("size").alias("low"), F.max("size").alias("high")), "groups")
    a, b = (groups.select("x", F.col("root").alias(f"r{i}"), *[F.col(c).alias(c + i) for c in ("l", "low", "high")]) for i in "ab")
    near = (F.col("higha") >= F.col("lowb") * F.lit(similarity) - F.lit(1e-9)) & (F.col("highb") >= F.col("lowa") * F.lit(similarity) - F.lit(1e-9))
    reach = F.least("la", "lb") >= (F.col("lowa") + F.col("lowb")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9)
    meet = a.join(b, "x").where("ra < rb").where(near & reach).select("x", "ra", "rb")
    one, two = (keyed.select("x", F.col("root").alias(f"r{i}"), F.col("row").alias(i), F.col("size").alias(f"n{i}"), F.col("left").alias(f"l{i}")) for i in "ab")
    close = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similarity) - F.lit(1e-9)
    close = close & (F.least("la", "lb") >= (F.col("na") + F.col("nb")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9))
    met = durable(meet, "meet").join(one, ["x", "ra"]).join(two, ["x", "rb"]).where(close)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``a, b, similarity`` of the pairs that are alike enough."""
    one, two = (sets.select(F.col("row").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    size = F.size("sa") + F.size("sb") - both
    alike = F.when(size == 0, 1.0).otherwise(both / size)
    return (
        pairs.join(one, "a").join(two, "b").select("a", "b", alike.alias("similarity"))
        .where(F.col("similarity") >= similarity)
    )


def verified_links(texts: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Rows ``row, k1, k2`` of distinct ``texts`` (``k1, k2, text``), and pairs ``a, b, similarity`` that are alike enough.

    Keys name texts: rows with one key have one text and are one row here.
    """
    made = texts.mapInArrow(_sketch_batches, "k1 bigint, k2 bigint, print bigint, bands array<bigint>")
    sketched = durable(
        durable(made, "sketches").dropDuplicates(["k1", "k2"]).withColumn("row", F.monotonically_increasing_id()), "sketched"
    )
    pairs, crowded = candidates(sketched)
    pairs = durable(pairs, "pairs")
    rows = sketched.select("row", "k1", "k2")
    needed = durable(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct().join(rows, "row"), "needed")
    sets = durable(
        filter_by_keys(texts, needed.select("k1", "k2"), ["k1", "k2"])
        .mapInArrow(_set_batches, "k1 bigint, k2 bigint, s array<bigint>").dropDuplicates(["k1", "k2"])
        .join(needed, ["k1", "k2"]).select("row", "s"),
        "sets",
    )
    links = durable(_alike(pairs, sets, similarity), "links")
    rest = apart(crowded, links)
    if not rest.isEmpty():
        links = links.unionByName(_alike(durable(pairs_across(sets, rest, similarity), "across"), sets, similarity))
    return rows, links


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row, that of the smallest id, of each group of near copies; columns unchanged.

    Texts without words are alike to each other. Rows with the same text are of one
    group; of those that agree in id too one is kept.
    """
    id_, text = F.col(id_col), F.col(text_col)
    key = content_key(id_, text)
    with temporary_tables(docs.sparkSession):
        own = content_key(F.coalesce(text, F.lit("")))
        view = docs.select(own.alias("own"), text.alias("text")).select("own.k1", "own.k2", "text")
        rows, links = verified_links(view, similarity)
        roots = durable(components(durable(links, "alike").select("a", "b")), "roots")
        named = durable(
            rows.join(roots, F.col("row") == F.col("node"), "left")
            .select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.coalesce("root", "row").alias("root")),
            "named",
        )
        place = F.struct(id_.isNull().alias("none"), id_.alias("id"), key.alias("key"))
        ids = docs.select(own.alias("own"), place.alias("place"))
        ids = ids.join(named, (F.col("own.k1") == F.col("o1")) & (F.col("own.k2") == F.col("o2"))).select("root", "place")
        ids = durable(ids, "ids")
        first = durable(ids.groupBy("root").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first")
        judged = durable(
            ids.join(first.select(F.col("root").alias("r"), F.col("first.key").alias("stays")), F.col("root") == F.col("r"))
            .select(F.col("place.key").alias("key"), (F.col("place.key") == F.col("stays")).alias("kept")),
            "judged",
        )
        gone = durable(judged.where("not kept").select("key.*").distinct(), "gone", keep=True)
        repeated = durable(
            judged.where("kept").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key.*"), "repeated", keep=True
        )
    return drop_rows(docs, key, gone, repeated)

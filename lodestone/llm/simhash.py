"""Near-duplicates by SimHash and multi-index hashing.

A text's fingerprint has a bit set where over half of its shingles' hashes have it.
Two fingerprints within 2 bits are found through tables keyed by 48 of the 64 bits:
the fingerprint is four segments of 16 bits, so two differing bits leave at least two
segments equal. Either the bits are in one segment, and the other three are equal; or
they are in two, and then dropping one of these and enumerating the ball of radius 1
around the other hits. Keys of 48 bits keep a bucket to fingerprints that differ in
16 given bits at most, so a cluster of thousands of near copies falls into many small
buckets. Every hit's whole distance is verified.

Copies have one fingerprint and meet as one row: distinct fingerprints are linked, and
documents get their fingerprint's component by a join that can be split.

Defined cases: null text is the empty text; a text without words has fingerprint 0 and
is linked like any other; one with fewer words than a shingle is one shingle; a
component's id is its smallest id, null only if all are null; repeated rows stay; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.plans.durable import durable

SEED = 42
#: Shingles whose bits are counted at once.
BLOCK = 65536


def fingerprint_of(text: str | None, size: int, hashed=None) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    import xxhash

    digest = hashed or xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = len(words) - size + 1
    counts = np.zeros(64, np.int64)
    s, e = starts[:n].tolist(), (ends[size - 1 :] - 1).tolist()
    for low in range(0, n, BLOCK):
        part = min(BLOCK, n - low)
        values = (digest(joined[i:j], SEED) for i, j in zip(s[low : low + part], e[low : low + part], strict=True))
        block = np.fromiter(values, "<u8", part)
        counts += np.unpackbits(block.view(np.uint8).reshape(part, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprint_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            prints = [fingerprint_of(t.as_py(), size, digest) for t in batch.column(batch.num_columns - 1)]
            out = pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], [*names, "print"])

    return run


def fingerprints(docs: DataFrame, keep: list[Column], text_col: str = "text", size: int = 3) -> DataFrame:
    """The columns in ``keep`` and ``print``, the fingerprint as a signed long."""
    chosen = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(_fingerprint_batches(size), f"{schema}, print bigint")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _key(value: Column, without: int) -> Column:
    """The 48 bits outside of segment ``without``, in place."""
    mask = 0xFFFF_FFFF_FFFF_FFFF ^ (0xFFFF << (16 * without))
    return value.bitwiseAND(F.lit(_signed(mask)))


def _one_bit(k: int) -> list[int]:
    return [_signed(1 << (16 * k + i)) for i in range(16)]


def _probe(t: int):
    return lambda bit: F.struct(F.lit(t).alias("t"), _key(F.col("print").bitwiseOR(bit), t).alias("key"))


def links_within_two(prints: DataFrame) -> DataFrame:
    """``a, b``: all pairs of distinct fingerprints (column ``print``) 1 or 2 bits apart.

    Table ``t`` holds fingerprints by all segments but ``t``. A fingerprint looks
    itself up in all four, and in table ``j`` with each unset bit of a segment
    ``i < j`` set: of two that differ in one bit of ``i``, one has it unset.
    """
    table = prints.select(
        "print", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), _key(F.col("print"), t).alias("key")) for t in range(4)])).alias("x")
    ).select(F.col("print").alias("b"), "x.t", "x.key")
    probes = []
    for j in range(4):
        probes.append(F.array(F.struct(F.lit(j).alias("t"), _key(F.col("print"), j).alias("key"))))
        for i in range(j):
            flips = F.array(*[F.lit(x) for x in _one_bit(i)])
            unset = F.filter(flips, lambda bit: F.col("print").bitwiseAND(bit) == 0)
            probes.append(F.transform(unset, _probe(j)))
    asked = prints.select(F.col("print").alias("a"), F.explode(F.flatten(F.array(*probes))).alias("x")).select(
        "a", "x.t", "x.key"
    )
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, 2)
    return (
        asked.join(table, ["t", "key"])
        .where(close)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def grouped_prints(printed: DataFrame, id_col: str = "id") -> DataFrame:
    """``print, component_id, keep`` per distinct fingerprint of ``printed`` (``id, print``)."""
    prints = durable(
        printed.groupBy("print").agg(F.min(id_col).alias("first_id")), "prints"
    )
    roots = durable(components(links_within_two(prints.select("print"))), "roots")
    named = durable(
        prints.join(roots, F.col("print") == F.col("node"), "left").select(
            "print", "first_id", F.coalesce("root", "print").alias("root")
        ),
        "named",
    )
    smallest = durable(named.groupBy(F.col("root").alias("r")).agg(F.min("first_id").alias("component_id")), "smallest")
    return named.join(smallest, F.col("root") == F.col("r")).select(F.col("print").alias("p"), "component_id")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``id, fingerprint, component_id`` per row: documents linked at 2 or fewer differing bits."""
    printed = durable(fingerprints(docs, [F.col(id_col).alias("id")], text_col, size), "printed")
    groups = durable(grouped_prints(printed), "groups")
    return printed.join(groups, F.col("print") == F.col("p")).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )

"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into phrases: each is the shortest piece, from where the last one ended, that
the dictionary lacks, and joins it. Texts that compress well together share phrases. The hashes
of the phrase set are sketched by their smallest ``SIZE`` values, and two sketches give the share
of common phrases among all (Jaccard), exactly where both sets are no larger than a sketch.

A dictionary that reaches ``DICTIONARY`` phrases starts anew, as compressors do, so memory is
bounded while every phrase of the text still counts.

Each text is also compared with an edited one (its last third replaced by the beginning of its
neighbour) and with the neighbour: rows are dealt by ranges of the order, every range is given
the last row of the range before it, and a task streams its range with one neighbour in hand.
The parse of the part that a text and its edited form share is done once.

Defined cases: null text is the empty text, which has no phrases; two empty fingerprints are
alike (1), an empty and another are not (0); the order is by id, null ids last when it falls, equal ids by
their texts' hash, so equal rows are neighbours; the last row's neighbour is the first, so a
single row is its own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Hashes of a fingerprint.
SIZE = 128
#: Phrases of a dictionary.
DICTIONARY = 1 << 20


class Parse:
    """A parse under way: the dictionary, the phrase in hand, and the smallest hashes so far."""

    def __init__(self, size: int = SIZE, dictionary: int = DICTIONARY):
        self.size, self.limit = size, dictionary
        self.known: set[str] = set()
        self.phrase = ""
        self.smallest = np.empty(0, np.uint32)

    def copy(self) -> Parse:
        other = Parse(self.size, self.limit)
        other.known, other.phrase, other.smallest = set(self.known), self.phrase, self.smallest
        return other

    def read(self, text: str) -> Parse:
        """Go on with ``text``."""
        known, limit, phrase, fresh = self.known, self.limit, self.phrase, []
        for letter in text:
            phrase += letter
            if phrase not in known:
                known.add(phrase)
                fresh.append(phrase)
                phrase = ""
                if len(known) >= limit:
                    self._take(fresh)
                    known.clear()
                    fresh = []
        self.phrase = phrase
        self._take(fresh)
        return self

    def _take(self, phrases: list[str]) -> None:
        """Keep the smallest hashes; a few more than are wanted are looked at, all only where too many of these are equal."""
        hashed = np.concatenate([self.smallest, np.fromiter(map(xxhash.xxh32_intdigest, phrases), np.uint32, len(phrases))])
        few = 2 * self.size
        first = np.unique(np.partition(hashed, few)[:few] if len(hashed) > few else hashed)
        if len(first) < self.size and len(hashed) > few:
            first = np.unique(hashed)
        self.smallest = first[: self.size]

    def fingerprint(self) -> str:
        return self.smallest.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Common share of two sets by their smallest hashes, up to where both are known."""
    if not len(a) and not len(b):
        return 1.0
    known = min((s[-1] for s in (a, b) if len(s) >= size), default=0xFFFFFFFF)
    a, b = a[a <= known], b[b <= known]
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _hashes(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4")


def fingerprint(text: str, size: int = SIZE, dictionary: int = DICTIONARY) -> str:
    """The fingerprint of one text, as hexadecimal digits, eight for each hash in rising order."""
    return Parse(size, dictionary).read(text).fingerprint()


def likeness_of(a: str, b: str, size: int = SIZE) -> float:
    """The likeness of two fingerprints."""
    return likeness(_hashes(a), _hashes(b), size)


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


# Fingerprints of a table. ------------------------------------------------------------------------


def _fingerprints(size: int, dictionary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(v.as_py() or "", size, dictionary) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["id", "fingerprint"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, dictionary: int = DICTIONARY) -> DataFrame:
    """``id, fingerprint`` of every row, where the rows are."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints(size, dictionary), f"id {kind}, fingerprint string")


# Neighbours. -------------------------------------------------------------------------------------


def _below(key: Column, tails: Column, count: int) -> Column:
    """How many of the sorted ``tails`` are under ``key``, by halving."""
    span = F.struct(F.lit(0).alias("lo"), F.lit(count).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        under = (s["lo"] < s["hi"]) & (F.element_at(tails, F.least(middle + 1, F.lit(max(count, 1)))) < key)
        return F.struct(F.when(under, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(under, s["hi"]).otherwise(middle).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(max(1, count.bit_length())))
    return F.aggregate(steps, span, halve, lambda s: s["lo"])


def deal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``part, guest, at, id, text``: texts by ranges of the order, each led by a guest, the row before it.

    Only ids and hashes are sorted to find the ranges; their ends, one a partition, come to the
    driver. Texts move once. The first range's guest is the last row of all.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    at = F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id"), F.xxhash64(text).alias("h"))
    rows = docs.select(at.alias("at"), text.alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.select("at").repartitionByRange(parts, "at").groupBy(F.spark_partition_id().alias("p")).agg(F.max("at").alias("at"))
    told = sorted(ranges.select("at", F.to_json("at").alias("told")).select("told", "at.*").collect(), key=lambda r: (r["known"], r["id"] if r["known"] else 0, r["h"]))
    kind = StructType().add("at", ArrayType(rows.schema["at"].dataType))
    tails = F.from_json(F.lit(json.dumps({"at": [json.loads(r["told"]) for r in told]})), kind)["at"]
    count = len(told)
    placed = rows.select(F.least(_below(F.col("at"), tails, count), F.lit(max(count - 1, 0))).alias("part"), "at", "text")
    if not count:
        return placed.select("part", F.lit(False).alias("guest"), "at", "at.id", "text")
    ends = placed.where(F.element_at(tails, F.col("part") + 1).eqNullSafe(F.col("at"))).groupBy("part", "at").agg(F.first("text").alias("text"))
    guests = ends.select(((F.col("part") + 1) % count).alias("part"), F.lit(True).alias("guest"), "at", "text")
    both = placed.select("part", F.lit(False).alias("guest"), "at", "text").unionByName(guests)
    dealt = both.repartitionById(count, F.col("part")).sortWithinPartitions("part", F.col("guest").desc(), "at")
    return dealt.select("part", "guest", "at", "at.id", "text")


_COMPARED = [
    ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]


def _compare(size: int, dictionary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        neighbour, its = "", np.empty(0, np.uint32)
        for batch in batches:
            ids, columns = [], [[] for _ in _COMPARED]
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                if batch.column("guest")[i].as_py():
                    neighbour, its = text, Parse(size, dictionary).read(text).smallest
                    continue
                cut = len(text) - len(text) // 3
                changed = edited(text, neighbour)
                shared = Parse(size, dictionary).read(text[:cut])
                new = shared.copy().read(changed[cut:])
                own = shared.read(text[cut:])
                row = (
                    len(text), hashlib.sha256(changed.encode()).hexdigest(), own.fingerprint(), new.fingerprint(),
                    likeness(own.smallest, new.smallest, size), likeness(own.smallest, its, size),
                )
                ids.append(i)
                for column, x in zip(columns, row):
                    column.append(x)
                neighbour, its = text, own.smallest
            kept = batch.column("id").take(pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept, *(pa.array(c, t) for c, (_, t) in zip(columns, _COMPARED))], ["id", *(n for n, _ in _COMPARED)])

    return run


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, dictionary: int = DICTIONARY) -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness and that to the next text by falling id."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    dealt = deal(docs, id_col, text_col).select("guest", "id", "text")
    return dealt.mapInArrow(_compare(size, dictionary), schema)

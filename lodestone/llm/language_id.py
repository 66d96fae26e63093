"""Language identification by Bayesian evidence fusion.

The evidence is a text's byte pairs, the language that its markup declares, the suffix of
its address and its host. Byte pairs are scored against a table per language, counted over
documents under their declared language: a text is scored with tables of the other half of all
texts, so what it declares itself is not counted twice. Hosts and suffixes have priors: documents
are counted by host, suffix and likeliest language by text alone, and a host's shares are
smoothed with its suffix's, these with the shares over all documents.

The posterior adds the logarithms: text (pairs of a text don't come independently, so more
than ``TEXT_PAIRS`` count as so many), the declaration, right with probability ``TRUST``,
and the prior. ``und`` is the language of texts that none of the known ones explains: whatever
the pair, it is ``UNUSUAL`` less likely (in logarithms) than pairs are on average in the
language with the most even ones. A document is accepted where a known language is the likeliest,
its probability is ``ACCEPT`` or more, and the text has letters to tell by.

Defined cases: null text is the empty text, which is ``und`` and not accepted; unknown or
null declarations, suffixes and hosts are no evidence (a null host shares its suffix's prior);
ties go to the language first in order; repeated rows are judged alike; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.plans.durable import durable

LANGUAGES = ("de", "en", "es", "fr")
TEXT_PAIRS, TRUST, ACCEPT = 60, 0.9, 0.5
#: Documents' worth of the coarser prior in a finer one.
HOST_STRENGTH, SUFFIX_STRENGTH = 20.0, 100.0
UNKNOWN = "und"
#: Prior of ``und``, and the share of the uniform distribution in every language's table.
UNKNOWN_PRIOR, FLOOR, UNUSUAL = 0.02, 0.001, 3.0
#: Hosts whose priors are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST_HOSTS = 100_000
BLOCK_CHARS = 500_000
_PAIRS = 1 << 16


def _letters() -> np.ndarray:
    """ASCII letters in lower case and all bytes of other characters; the rest is a space."""
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    for c in range(97, 123):
        table[c] = table[c - 32] = c
    return table


LETTERS = _letters()


def _pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte pairs of all texts, without pairs of spaces, the text each belongs to, and the half each text is in."""
    import xxhash

    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    half = np.array([xxhash.xxh64_intdigest(r, 42) & 1 for r in raw], np.int64)
    buf = LETTERS[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)]
    pair = (buf[:-1].astype(np.int32) << 8) | buf[1:]
    lengths = np.array([len(r) + 1 for r in raw])
    lengths[0] += len(pair) - lengths.sum() if len(raw) else 0
    owner = np.repeat(np.arange(len(raw)), lengths)
    some = pair != (32 << 8 | 32)
    return pair[some], owner[some], half


def _blocks(values: pa.Array) -> Iterator[list[str]]:
    texts: list[str] = []
    held = 0
    for value in values:
        texts.append(value.as_py() or "")
        held += len(texts[-1])
        if held >= BLOCK_CHARS:
            yield texts
            texts, held = [], 0
    if texts:
        yield texts


def train(docs: DataFrame, text_col: str = "text", declared_col: str = "lang", languages: Sequence[str] = LANGUAGES) -> np.ndarray:
    """Logarithms of byte-pair probabilities for each half of the texts: a row per language and a last one for ``und``.

    A half's tables are counted over the other half, those of a language that has no text
    there over its own. Tasks count in a table of fixed size and hand over its non-zero cells;
    what reaches the driver is at most 131,072 cells per language.
    """
    place = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, len(place), _PAIRS), np.int64)
        for batch in batches:
            names = [place[x] for x in batch.column(0).to_pylist()]
            done = 0
            for texts in _blocks(batch.column(1)):
                pair, owner, half = _pairs(texts)
                which = (half * len(place) + np.array(names[done : done + len(texts)]))[owner]
                counts += np.bincount(which.astype(np.int64) * _PAIRS + pair, minlength=counts.size).reshape(counts.shape)
                done += len(texts)
        flat = counts.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at], pa.int64())], ["cell", "n"])

    cells = (
        docs.where(F.col(declared_col).isin(*languages)).select(declared_col, text_col)
        .mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    )
    table = np.zeros(2 * len(languages) * _PAIRS)
    table[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(float)
    halves = table.reshape(2, len(languages), _PAIRS)
    return np.stack([_logs(np.where(other.sum(axis=1, keepdims=True) > 0, other, own)) for own, other in (halves, halves[::-1])])


def _logs(table: np.ndarray) -> np.ndarray:
    total = table.sum(axis=1, keepdims=True)
    share = np.divide(table, total, out=np.full_like(table, 1 / _PAIRS), where=total > 0)
    share = (1 - FLOOR) * share + FLOOR / _PAIRS
    usual = (share * np.log(share)).sum(axis=1)
    return np.vstack([np.log(share), np.full((1, _PAIRS), usual.min() - UNUSUAL)]).astype(np.float32)


def score_texts(model: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean logarithm per language and text, and the number of pairs of each text."""
    pair, owner, half = _pairs(texts)
    n = np.bincount(owner, minlength=len(texts))
    cell = half[owner] * _PAIRS + pair
    sums = np.stack([np.bincount(owner, model[:, i].ravel()[cell], len(texts)) for i in range(model.shape[1])], axis=1)
    return sums / np.maximum(n, 1)[:, None], n


def _with_scores(docs: DataFrame, model: np.ndarray, columns: Sequence[str], inside: str | None = None) -> DataFrame:
    """``columns`` and ``ll`` (text evidence per language), ``pairs``.

    The text is column ``text``, or field ``inside`` of the first of ``columns``, so that
    a text that is passed on is not passed twice.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)  # languages * 512 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_of = batch.column(0).field(inside) if inside else batch.column(batch.num_columns - 1)
            got = [score_texts(shared.value, texts) for texts in _blocks(texts_of)]
            mean = np.concatenate([g[0] for g in got]) if got else np.zeros((0, shared.value.shape[1]))
            n = np.concatenate([g[1] for g in got]) if got else np.zeros(0)
            ll = mean * np.minimum(n, TEXT_PAIRS)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ll) + 1) * ll.shape[1], pa.int32()), pa.array(ll.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(columns)], lists, pa.array(n.astype(np.int64))], [*columns, "__ll", "__pairs"]
            )

    chosen = docs.select(*columns) if inside else docs.select(*columns, "text")
    fields = [*docs.select(*columns).schema.fields, T.StructField("__ll", T.ArrayType(T.DoubleType())), T.StructField("__pairs", T.LongType())]
    return chosen.mapInArrow(run, T.StructType(fields))


def host_priors(guesses: DataFrame, languages: Sequence[str]) -> DataFrame:
    """``host, suffix, prior`` (array per language): counts smoothed from all to suffix to host.

    ``guesses`` has ``host, suffix, c`` with ``c`` an array of counts per language.
    """
    k = len(languages)
    summed = lambda df, *by: df.groupBy(*by).agg(*[F.sum(F.get("c", F.lit(i))).alias(f"n{i}") for i in range(k)])
    one = summed(guesses).first()
    counts = [float((one[i] if one else 0) or 0) + 1.0 for i in range(k)]
    base = [c / sum(counts) for c in counts]
    total = lambda: sum((F.col(f"n{i}") for i in range(1, k)), F.col("n0"))
    suffixes = summed(guesses, "suffix").select(
        F.col("suffix").alias("s"),
        F.array(*[(F.col(f"n{i}") + SUFFIX_STRENGTH * base[i]) / (total() + SUFFIX_STRENGTH) for i in range(k)]).alias("by_suffix"),
    )
    return (
        summed(guesses, "host", "suffix")
        .join(suffixes, F.col("suffix").eqNullSafe(F.col("s")))
        .select(
            "host", "suffix",
            F.when(F.col("host").isNull(), F.col("by_suffix")).otherwise(
                F.array(*[(F.col(f"n{i}") + HOST_STRENGTH * F.get("by_suffix", F.lit(i))) / (total() + HOST_STRENGTH) for i in range(k)])
            ).alias("prior"),
        )
    )


def _judged(
    docs: DataFrame, text: Column, declared: Column | None, host: Column | None, suffix: Column | None,
    keep: Sequence[str], languages: Sequence[str], inside: str | None = None,
) -> DataFrame:
    """``kept`` (a struct of ``keep``'s columns) and the judgement per row of ``docs``."""
    none = F.lit(None).cast("string")
    declared, host, suffix = (none if x is None else x for x in (declared, host, suffix))
    known = F.when(F.lower(declared).isin(*languages), F.lower(declared))
    view = docs.select(
        F.struct(*keep).alias("kept"), text.alias("text"), known.alias("declared"), host.alias("host"), suffix.alias("suffix")
    )
    model = train(view, "text", "declared", languages)
    names = F.array(*[F.lit(x) for x in (*languages, UNKNOWN)])
    best = lambda scores: (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
    guesses = (
        _with_scores(view, model, ["host", "suffix"])
        .where("__pairs > 0")
        .withColumn("at", best(F.col("__ll")))
        .groupBy("host", "suffix")
        .agg(F.array(*[F.count_if(F.col("at") == i) for i in range(len(languages))]).alias("c"))
    )
    priors = durable(host_priors(durable(guesses, "guesses"), languages), "priors")
    table = priors.select(F.col("host").alias("h"), F.col("suffix").alias("s"), "prior")
    if table.count() <= MAX_BROADCAST_HOSTS:
        table = F.broadcast(table)
    scored = _with_scores(view, model, ["kept", "declared", "host", "suffix"], inside)
    joined = scored.join(table, F.col("host").eqNullSafe(F.col("h")) & F.col("suffix").eqNullSafe(F.col("s")), "left")
    k = len(languages)

    def evidence(i: int) -> Column:
        text_part = F.get("__ll", F.lit(i))
        if i == k:  # what is declared says nothing about it
            any_said = F.when(F.col("declared").isNull(), 0.0).otherwise(float(-np.log(k)))
            return text_part + any_said + float(np.log(UNKNOWN_PRIOR))
        said = F.when(F.col("declared").isNull(), 0.0).otherwise(
            F.when(F.col("declared") == languages[i], float(np.log(TRUST))).otherwise(float(np.log((1 - TRUST) / max(1, k - 1))))
        )
        return text_part + said + F.log(F.coalesce(F.get("prior", F.lit(i)), F.lit(1.0 / k)) * (1 - UNKNOWN_PRIOR))

    fused = joined.withColumn("__post", F.array(*[evidence(i) for i in range(k + 1)]))
    top = F.array_max("__post")
    norm = F.aggregate("__post", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    some = F.col("__pairs") > 0
    judged = fused.select(
        "kept", "declared",
        F.when(some, F.get(names, best(F.col("__post")))).otherwise(F.lit(UNKNOWN)).alias("language"),
        F.when(some, 1 / norm).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(some, F.get(names, best(F.col("__ll")))).otherwise(F.lit(UNKNOWN)).alias("by_text"),
    )
    return judged.select(
        "kept", "language", "confidence", "by_text", F.col("declared").alias("declared_language"),
        ((F.col("language") != UNKNOWN) & (F.col("confidence") >= ACCEPT)).alias("accepted"),
    )


def identify(
    docs: DataFrame, *, text: Column | None = None, declared: Column | None = None, host: Column | None = None,
    suffix: Column | None = None, keep: Sequence[str] = ("doc_id",), languages: Sequence[str] = LANGUAGES,
) -> DataFrame:
    """``keep``'s columns, ``language, confidence, by_text, declared_language, accepted`` per row of ``docs``.

    A kept column with the name of one of these is left out.
    """
    own = ("language", "confidence", "by_text", "declared_language", "accepted")
    keep = [c for c in keep if c.lower() not in own]
    judged = _judged(docs, F.col("text") if text is None else text, declared, host, suffix, keep, languages)
    return judged.select("kept.*", *own)


def identify_pages(pages: DataFrame, languages: Sequence[str] = LANGUAGES, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """``identify`` for raw web pages: declared by ``<html lang>``, host and suffix from the url."""
    page = F.coalesce(F.col("html"), F.lit(""))
    hidden = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"
    host = F.nullif(F.lower(F.regexp_extract("url", r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))
    return identify(
        pages, text=F.regexp_replace(page, hidden, " "), declared=F.regexp_extract(page, r"(?i)<html[^>]*\blang=[\"']?([a-z]+)", 1),
        host=host, suffix=F.substring_index(host, ".", -1), keep=keep, languages=languages,
    )


def keep_identified(docs: DataFrame, declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """``docs`` without rows that no known language explains; columns unchanged."""
    judged = _judged(docs, F.col("text"), F.col(declared_col), F.col(host_col), None, docs.columns, LANGUAGES, "text")
    return judged.where("accepted").select("kept.*")

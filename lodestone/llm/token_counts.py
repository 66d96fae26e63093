"""Token counts through a digest cache.

A text's count is looked up by the digest of its content together with the digest of
the tokenizer file; only distinct texts that the cache lacks are encoded, and their
counts are appended to it. The cache is a Parquet table that any later job can read.

Defined cases: null text is the empty text, which has 0 tokens; equal texts share one
count; repeated rows stay; texts are never cut; special strings inside a text are
handled as the library does by default; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.durable import durable, new_path

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: Texts given to the tokenizer at once, by characters.
BATCH_CHARS = 100_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: another file never meets old counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


@functools.lru_cache(maxsize=1)
def _encoder(path: str):
    """A function from a list of texts to their token counts; a worker loads a tokenizer once."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = _encoder(path)
        for batch in batches:
            counts: list[int] = []
            texts: list[str] = []
            held = 0
            for value in batch.column(1):
                texts.append(value.as_py())
                held += len(texts[-1])
                if held >= BATCH_CHARS:
                    counts += count(texts)
                    texts, held = [], 0
            if texts:
                counts += count(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The cache, empty if nothing was ever appended."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def append_misses(docs: DataFrame, cache_path: str, tokenizer: str, text_col: str = "text") -> None:
    """Encode every distinct text of ``docs`` that the cache lacks, and append the counts."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest")
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    distinct = texts.groupBy(content_digest(F.col("text")).alias("digest"), "text").agg(F.count(F.lit(1)).alias("n"))
    misses = distinct.select("digest", "text").join(known, "digest", "left_anti")
    (
        misses.mapInArrow(_count_batches(tokenizer), "digest binary, n_tokens long")
        .select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
        .write.mode("append")
        .parquet(cache_path)
    )


def token_counts(
    docs: DataFrame, *, tokenizer: str | None = None, cache_path: str | None = None,
    id_col: str = "doc_id", text_col: str = "text", limit: int = 1024,
) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit, text_digest`` per row of ``docs``.

    Without ``cache_path`` the call starts a cache of its own in the shared folder.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    cache_path = cache_path or new_path(spark, "token-cache")
    append_misses(docs, cache_path, tokenizer, text_col)
    # Two jobs may have appended the same text. Written, so that the join below can split a hot digest.
    cache = durable(
        read_cache(spark, cache_path)
        .where(F.col("tokenizer") == tokenizer_version(tokenizer))
        .groupBy("digest")
        .agg(F.min("n_tokens").alias("n_tokens")),
        "counts",
    )
    keyed = docs.select(
        F.col(id_col),
        F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
        content_digest(F.col(text_col)).alias("digest"),
    )
    return keyed.join(cache, "digest").select(
        id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"),
        F.lower(F.hex("digest")).alias("text_digest"),
    )

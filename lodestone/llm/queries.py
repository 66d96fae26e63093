"""The registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import (
    decontaminate, exact_dedup, fill_middle, html_extract, language_id, lz_fingerprint, merkle, mixing, pii, quality, simhash, token_counts, url_filter,
)
from lodestone.llm.oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_chunk_recipe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(_table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, declared=F.col("lang"), host=F.col("source"))


def op5_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2("base", 256).alias("base_sha256"), "spans", "n_secret", "n_added", "n_found",
    )


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(_table(spark, sf_dir, "pages"), keep=["page_id"])
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_extract.extract_pages(pages, html_extract.learn(pages))


def op11_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.compare_neighbours(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    text = F.when(tampered, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    claim = merkle.leaf_digest([*(F.col(c) for c in columns[:-1]), text])
    manifest = merkle.build(_table(spark, sf_dir, "documents"), columns, "lang", "doc_id", claim)
    return merkle.verify(manifest).withColumnRenamed("id", "doc_id")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op4 with all its evidence: pages declare a language and have an address."""
    return language_id.identify_pages(_table(spark, sf_dir, "pages")).drop("url")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in own} | {"language_id_pages": language_id_pages}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

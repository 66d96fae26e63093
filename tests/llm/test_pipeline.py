"""The pipeline's stages, one by one against plain Python, and as a whole."""

import re

import corpus_pipeline

from lodestone.llm import near_copies

from .conftest import documents
from .test_near import brute_components
from .test_text import words


def test_whole_pipeline(spark, data_dir):
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]["text"]), i)
    left = sorted(first.values())
    sets = {i: set(near_copies.shingle_hashes(rows[i]["text"]).tolist()) for i in left}
    links = [(a, b) for a, i in enumerate(left) for b, j in enumerate(left[:a]) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    left = sorted(set(brute_components([(i,) for i in left], links)))
    windows = set()
    for text in items:
        w = words(text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}
    clean = []
    for i in left:
        w = words(rows[i]["text"])
        if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)):
            clean.append(i)
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert sorted(r["doc_id"] for r in docs.collect()) == clean
    mixed = corpus_pipeline.run(spark, data_dir).toPandas()
    assert set(mixed.doc_id) <= set(clean) and mixed["copies"].between(1, 3).all()
    sizes = {i: len(rows[i]["text"].split()) for i in clean}
    assert abs(mixed.taken.sum() - sum(sizes.values())) < 0.1 * sum(sizes.values())
    assert all(t == c * sizes[i] for i, c, t in zip(mixed.doc_id, mixed["copies"], mixed.taken, strict=True))


def test_stages_take_odd_rows_and_none(spark, odd_rows, data_dir):
    for rows in (odd_rows, []):
        docs = documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, data_dir)
            assert name == "mix" or got.columns == docs.columns
            assert got.count() <= 2 * len(rows)

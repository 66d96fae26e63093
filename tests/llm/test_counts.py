"""Mixing, exact copies, token counts: against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, mixing, queries, token_counts

from .conftest import documents

WS = r"[\x20\x09-\x0D]+"


def filled(sizes, weights, cap=3):
    """Targets by weight, none above ``cap`` times its size; what is cut off goes to the rest."""
    total, done = sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in done}
        level = (total - sum(done.values())) / sum(rest.values()) if rest else 0
        over = {s: cap * sizes[s] for s, w in rest.items() if w * level > cap * sizes[s]}
        if not over:
            return done | {s: w * level for s, w in rest.items()}
        done |= over


def test_mix_of_real_documents(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    got = queries.op1_pareto_mix(spark, data_dir).join(docs.select("doc_id", "source", "text"), "doc_id").toPandas()
    assert len(got) == docs.count()
    assert all(got["size"] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in got.text])
    sizes = got.groupby("source")["size"].sum().to_dict()
    names = sorted(sizes)
    want = filled(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    for s, part in got.groupby("source"):
        assert part.target.iloc[0] == pytest.approx(want[s]) and part.source_size.iloc[0] == sizes[s]
        assert abs(part.taken.sum() - want[s]) <= max(part["size"].max() / 2, 0.05 * want[s])
    assert all(got.taken <= 3 * got["size"]) and all(got.taken % got["size"].clip(lower=1) == 0)
    again = queries.op1_pareto_mix(spark, data_dir).toPandas().set_index("doc_id").taken
    assert (again == got.set_index("doc_id").taken.loc[again.index]).all()


def test_mix_caps_small_sources(spark):
    rows = [(i, "w " * 10, "en", "a") for i in range(2)] + [(10 + i, "w " * 10, "en", "b") for i in range(400)] + [(900, "w w", "en", None)]
    got = mixing.mix_sources(documents(spark, rows), keep=["doc_id", "source", "size"]).toPandas()
    assert set(got[got.source == "a"].copies) == {3}
    assert got[got.source.isna()].copies.tolist() == [3]
    assert got[got.source == "b"].taken.sum() == pytest.approx(4022 - 60 - 6, abs=6)


def test_mix_weights_are_odds(spark):
    rows = [(i, "w " * 10, "en", "a") for i in range(3000)]
    docs = documents(spark, rows).withColumn("odds", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    got = mixing.mix_sources(docs, share=0.3, weight_col="odds").toPandas()
    even, odd = got[got.doc_id % 2 == 0].copies.mean(), got[got.doc_id % 2 == 1].copies.mean()
    assert got.taken.sum() == pytest.approx(9000, abs=10) and even / odd == pytest.approx(3, rel=0.25)


def test_mix_odd_rows(spark, odd_rows):
    got = mixing.mix_sources(documents(spark, odd_rows)).toPandas()
    assert len(got) == len(odd_rows) and all(got.copies >= 0) and all(got.copies <= 3)
    assert mixing.mix_sources(documents(spark, [])).count() == 0


def test_mix_with_repeated_and_null_ids_comes_near_its_targets(spark):
    rows = [(i % 40 if i % 3 else None, "w " * (1 + i % 17) + f"x{i}", "en", "abc"[i % 3]) for i in range(1200)]
    got = mixing.mix_sources(documents(spark, rows), keep=["doc_id", "source"]).toPandas()
    for _, own in got.groupby("source"):
        size, target = own["size"].sum(), own.target.iloc[0]
        largest = own.groupby("doc_id", dropna=True)["size"].sum().max() if own.doc_id.notna().any() else own["size"].max()
        assert abs(own.taken.sum() - target) <= max(18, largest / 2) and size == own.source_size.iloc[0]
    assert len(got) == len(rows) and got.copies.between(0, 3).all()


def test_certain_copies_beyond_the_target_leave_nobody_else(spark):
    rows = [(i, "w " * 10, "en", "a") for i in range(100)]
    docs = documents(spark, rows).withColumn("odds", F.when(F.col("doc_id") == 0, 1000.0).otherwise(1.0))
    got = mixing.mix_sources(docs, share=0.02, weight_col="odds").toPandas()
    assert got.taken.sum() <= 30


def brute_groups(rows):
    norm = [re.sub(WS, " ", t or "") for _, t, *_ in rows]
    out = []
    for (i, *_), text in zip(rows, norm, strict=True):
        ids = [r[0] for r, n in zip(rows, norm, strict=True) if n == text]
        known = [x for x in ids if x is not None]
        out.append((i, min(known) if known else None, len(ids), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups(spark, odd_rows, bits):
    got = exact_dedup.exact_groups(documents(spark, odd_rows), hash_bits=bits).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=repr) == brute_groups(odd_rows)
    groups = {r["text_sha256"]: 0 for r in got}
    for r in got:
        groups[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(groups.values()) == {1}


def test_chunks_join_to_the_text(spark, odd_rows):
    docs = documents(spark, odd_rows).select(exact_dedup.squeeze(F.col("text")).alias("t"))
    for r in docs.select("t", exact_dedup.chunks(F.col("t"), 8, 40).alias("c")).collect():
        assert "".join(r["c"]) == r["t"] and all(0 < len(c) <= 42 for c in r["c"])


def test_dropping_exact_copies(spark, odd_rows):
    docs = documents(spark, odd_rows)
    got = exact_dedup.drop_exact_copies(docs)
    assert got.columns == docs.columns and got.count() == len({re.sub(WS, " ", r[1] or "") for r in odd_rows})
    assert exact_dedup.drop_exact_copies(documents(spark, [])).count() == 0


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_tokenizer())


def test_token_counts(spark, odd_rows, tmp_path):
    rows = [*odd_rows, (20, "a <|endoftext|> b", "en", "a"), (21, "  lead", "en", "a")]
    cache, docs, own = str(tmp_path / "cache"), documents(spark, rows), tokenizer()
    want = sorted([(i, len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows], key=repr)
    for _ in range(2):  # cold, then all from the cache
        got = token_counts.token_counts(docs, cache_path=cache).collect()
        assert sorted([(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got], key=repr) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
        stored = token_counts.read_cache(spark, cache)
        assert stored.count() == stored.select("digest").distinct().count() == len({r[1] or "" for r in rows})
    more = documents(spark, [(30, "a new text", "en", "a"), (31, "x", "en", "a")])
    token_counts.append_misses(more, cache, token_counts.default_tokenizer())
    assert token_counts.read_cache(spark, cache).count() == len({r[1] or "" for r in rows}) + 1
    assert token_counts.token_counts(documents(spark, [])).count() == 0


def test_sentencepiece_counts(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = documents(spark, [(1, "Hello  world é", "en", "a")])
    assert token_counts.token_counts(docs, tokenizer=path).first()["n_tokens"] == len(model.encode("Hello  world é"))

"""Near copies and fingerprints: against all pairs in plain Python."""

import random

import xxhash
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, near_copies, simhash
from lodestone.llm.components import components

from .conftest import documents


def brute_print(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows, links):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return [least.get(find(k)) for k in range(len(rows))]


def test_prints_and_components(spark, odd_rows):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 300))] for _ in range(25)]
    rows = list(odd_rows)
    for k, text in enumerate(base):
        for j in range(4):
            copy = list(text)
            for _ in range(j):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((1000 + 10 * k + j, " ".join(copy), "en", "a"))
    prints = [brute_print(r[1]) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = sorted(zip([r[0] for r in rows], [f"{p:016x}" for p in prints], brute_components(rows, links), strict=True), key=repr)
    got = simhash.near_components(documents(spark, rows)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == want
    assert simhash.near_components(documents(spark, [])).count() == 0


def test_all_links_within_two_bits(spark):
    rng = random.Random(9)
    values = {0, 1, 3, 1 << 63, (1 << 63) | 1, (1 << 64) - 1}
    for _ in range(40):
        v = rng.getrandbits(64)
        values |= {v, v ^ (1 << rng.randrange(64)), v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)), v ^ 0b111}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {tuple(sorted(r)) for r in simhash.links_within_two(spark.createDataFrame([(s,) for s in signed], "print long")).collect()}
    want = {tuple(sorted((signed[a], signed[b]))) for a in range(len(values)) for b in range(a) if 1 <= (values[a] ^ values[b]).bit_count() <= 2}
    assert got == want


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(2000, 2300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got[i] for i in range(201)) == {0} and set(got[i] for i in range(2000, 2300)) == {1000} and len(got) == 502


def jaccard(a, b):
    x, y = (set(near_copies.shingle_hashes(t).tolist()) for t in (a, b))
    return 1.0 if not x | y else len(x & y) / len(x | y)


def test_near_copies_are_found_and_others_left(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    rows, group = [], {}
    for k in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(30, 400))]
        for j in range(rng.choice([1, 2, 5])):
            copy = list(text)
            for _ in range(j * len(copy) // 160):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            group[len(rows)] = k
            rows.append((len(rows), " ".join(copy), "en", "a"))
    docs = documents(spark, rows)
    links = [(a, b) for a in range(len(rows)) for b in range(a) if group[a] == group[b] and jaccard(rows[a][1], rows[b][1]) >= 0.8]
    want = set(brute_components(rows, links))
    assert {r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()} == want


def test_one_stays_of_a_large_group(spark):
    rng = random.Random(12)
    text = [f"w{rng.randrange(9000)}" for _ in range(200)]
    rows = []
    for i in range(600):  # every copy is alike to the original, copies less so to each other
        copy = list(text)
        for _ in range(3 if i else 0):
            copy[rng.randrange(200)] = f"x{rng.randrange(9000)}"
        rows.append((i, " ".join(copy), "en", "a"))
    assert [r["doc_id"] for r in near_copies.drop_near_copies(documents(spark, rows)).collect()] == [0]


def drifting(n, seed):
    """Texts that are each alike to one earlier text, less so to that one's other copies."""
    rng = random.Random(seed)
    texts = [[f"w{rng.randrange(9000)}" for _ in range(200)]]
    for _ in range(n - 1):
        copy, at = list(rng.choice(texts)), rng.randrange(190)
        copy[at : at + 10] = [f"x{rng.randrange(10**6)}" for _ in range(10)]
        texts.append(copy)
    return [(i, " ".join(t), "en", "a") for i, t in enumerate(texts)]


def test_one_stays_of_a_drifting_group(spark):
    assert [r["doc_id"] for r in near_copies.drop_near_copies(documents(spark, drifting(2000, 13))).collect()] == [0]


def test_near_copies_of_odd_rows(spark, odd_rows):
    docs = documents(spark, odd_rows)
    got = near_copies.drop_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=repr) == sorted([1, 3, 6, 8, 9, 10, 11], key=repr)
    assert near_copies.drop_near_copies(docs.where(F.lit(False))).count() == 0


def test_no_only_copy_is_lost_where_ids_or_texts_are_null(spark):
    rows = [("abc", None), (None, "abc"), ("zz", "abc"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    for drop in (exact_dedup.drop_exact_copies, near_copies.drop_near_copies):
        got = sorted((tuple(r) for r in drop(docs).collect()), key=repr)
        assert got == [("abc", None), ("zz", "abc")], drop


def test_pairs_across_groups_are_all_that_are_alike(spark):
    """Every pair of two roots that is alike enough is among the pairs, and few others are."""
    draw = random.Random(8)
    sets = []
    for i in range(160):
        base = random.Random(i // 8)
        own = {base.randrange(1 << 40) for _ in range(base.choice([5, 20, 40]))}
        sets.append((i, sorted({x if draw.random() > 0.07 else draw.randrange(1 << 40) for x in own} | {7, 9})))
    roots = [(i, i // 2) for i, _ in sets]
    got = near_copies.pairs_across(spark.createDataFrame(sets, "row bigint, s array<bigint>"), spark.createDataFrame(roots, "row bigint, root bigint"), 0.8)
    got = {(r["a"], r["b"]) for r in got.collect()}
    root = dict(roots)
    alike = {
        (i, j) for i, x in sets for j, y in sets
        if i < j and root[i] != root[j] and len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y))
    }
    assert alike and alike <= got and len(got) < 160 * 159 / 8

"""Phrase fingerprints, the Merkle log and fill-in-middle frames: against plain Python."""

import hashlib
import random
import re
import zlib

import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from lodestone.llm import fill_middle, lz_fingerprint, merkle, queries

from .conftest import documents


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Phrases. ---------------------------------------------------------------------------------------


def brute_phrases(text, limit=1 << 20):
    """Every phrase, by looking for the end of each from where the last one ended."""
    known, out, at = set(), set(), 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in known:
            end += 1
        if end > len(text):
            break
        known.add(text[at:end])
        out.add(text[at:end])
        at = end
        if len(known) >= limit:
            known = set()
    return out


def brute_likeness(a, b, size):
    a, b = (sorted({xxhash.xxh32_intdigest(p.encode()) for p in x}) for x in (a, b))
    if not a and not b:
        return 1.0
    top = min((x[:size][-1] for x in (a, b) if len(x) >= size), default=1 << 32)
    a, b = ({h for h in x[:size] if h <= top} for x in (a, b))
    return len(a & b) / len(a | b)


def brute_compare(rows, size=lz_fingerprint.SIZE):
    rows = sorted(((i is not None, i, t or "") for i, t in rows), key=lambda r: (r[0], r[1] or 0, r[2]))
    out = []
    for k, (_, i, text) in enumerate(rows):
        following = rows[k - 1][2]
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        a, b, c = brute_phrases(text), brute_phrases(changed), brute_phrases(following)
        prints = ["".join(f"{h:08x}" for h in sorted({xxhash.xxh32_intdigest(p.encode()) for p in x})[:size]) for x in (a, b)]
        out.append((i, len(text), sha(changed), *prints, round(brute_likeness(a, b, size), 9), round(brute_likeness(a, c, size), 9)))
    return out


def compared(docs, **kw):
    return [(*r[:-2], round(r[-2], 9), round(r[-1], 9)) for r in (tuple(r) for r in lz_fingerprint.compare_neighbours(docs, **kw).collect())]


def test_neighbours_and_fingerprints_are_as_by_plain_loops(spark, odd_rows, data_dir):
    real = [(r["doc_id"] + 100, r["text"], "en", "a") for r in spark.read.parquet(f"{data_dir}/documents.parquet").limit(60).collect()]
    rows = [r for r in [*odd_rows, *real] if len(r[1] or "") < 50_000]
    spots = [r[:2] for r in rows]
    ids = [i for i, _ in spots]
    unique = [r for r in rows if ids.count(r[0]) == 1]
    assert sorted(compared(documents(spark, unique)), key=repr) == sorted(brute_compare([r[:2] for r in unique]), key=repr)
    got = compared(documents(spark, rows), size=8)
    assert len(got) == len(rows) and {g[0] for g in got} == set(ids)


def test_equal_rows_are_neighbours_and_a_single_row_its_own(spark):
    rows = [(1, "one two one two", "en", "a")] * 3 + [(0, "zero zero", "en", "a"), (2, "", "en", "a"), (3, None, "en", "a")]
    got = sorted(compared(documents(spark, rows)), key=repr)
    assert got == sorted(brute_compare([r[:2] for r in rows]), key=repr)
    assert [g[-1] for g in got if g[0] == 1].count(1.0) == 2
    assert [g[1:3] + g[-2:] for g in compared(documents(spark, [(5, "abcabc", "en", "a")]))] == [(6, sha("abcaab"), 0.6, 1.0)]
    assert compared(documents(spark, [])) == []


def test_every_range_has_its_guest(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10_000), 300)
    rows = [(i, f"{i} " * rng.randint(1, 9), "en", "a") for i in ids]
    for parts in ("1", "7", "64"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = compared(documents(spark, rows))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
        assert sorted(got) == sorted(brute_compare([r[:2] for r in rows]))


def test_a_bounded_dictionary_reads_the_whole_text():
    rng = random.Random(5)
    text = "".join(rng.choice("abcd") for _ in range(5000)) + "zzz" * 20
    for limit in (3, 50, 1 << 20):
        want = sorted({xxhash.xxh32_intdigest(p.encode()) for p in brute_phrases(text, limit)})[:64]
        assert lz_fingerprint.fingerprint(text, 64, limit) == "".join(f"{h:08x}" for h in want)
    half = lz_fingerprint.Parse(64, 50).read(text[:2000])
    other = half.copy().read("q" * 3000).fingerprint()
    assert half.read(text[2000:]).fingerprint() == lz_fingerprint.fingerprint(text, 64, 50) != other
    assert other == lz_fingerprint.fingerprint(text[:2000] + "q" * 3000, 64, 50)


def test_likeness_of_copies_edits_and_strangers(spark, data_dir):
    got = queries.op11_lz_fingerprints(spark, data_dir).toPandas()
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id) and list(got.columns)[:7] == [
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    long = got[got.n_chars > 1000]
    assert (long.near_edited > long.near_next).mean() > 0.97 and long.near_edited.mean() > 0.4
    text = docs.set_index("doc_id").text
    prints = got.set_index("doc_id").fingerprint
    assert prints.groupby(text).nunique().max() == 1
    plain = lz_fingerprint.fingerprints(spark.read.parquet(f"{data_dir}/documents.parquet")).toPandas().set_index("id").fingerprint
    assert (plain == prints.loc[plain.index]).all()


# The Merkle log. --------------------------------------------------------------------------------


def brute_levels(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([merkle.node_hash(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def postorder(levels):
    """``(level, index)`` in postorder, by going down from the root."""

    def walk(level, index):
        if level:
            for child in range(index * 8, min(index * 8 + 8, len(levels[level - 1]))):
                yield from walk(level - 1, child)
        yield level, index

    return list(walk(len(levels) - 1, 0))


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 71, 72, 73, 511, 512])
def test_positions_are_postorder(n):
    digests = [sha(str(i)) for i in range(n)]
    levels = brute_levels(digests)
    order = postorder(levels)
    assert [merkle.position(l, i, n) for l, i in order] == list(range(len(order)))
    log = merkle.append_nodes(digests, len(levels) - 1)
    assert log == [levels[l][i] for l, i in order]
    for leaf in {0, n // 2, n - 1}:
        assert merkle.fold(digests[leaf], merkle.siblings(log, leaf, n, len(levels) - 1)) == levels[-1][0]


def brute_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_manifest(rows):
    """Rows ``(doc_id, source, lang, n_chars, text)``: results per row, by plain recursion."""
    trees = {}
    for row in rows:
        leaf, i, text = brute_leaf(row), row[0], row[4]
        if i is not None and text is not None and zlib.crc32(str(i).encode()) % 3 == 0:
            text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
        trees.setdefault(row[2], []).append((i is not None, i or 0, leaf, brute_leaf((*row[:4], text))))
    names = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    subroots = [brute_levels([x[2] for x in sorted(trees[g])])[-1][0] for g in names]
    tops = brute_levels(subroots)
    root, out = tops[-1][0], []
    for t, g in enumerate(names):
        levels = brute_levels([x[2] for x in sorted(trees[g])])
        for at, (known, i, leaf, claim) in enumerate(sorted(trees[g])):
            folded, proof = claim, ""
            for nodes, place in ((levels, at), (tops, t)):
                for level in nodes[:-1]:
                    run = level[place // 8 * 8 : place // 8 * 8 + 8]
                    proof += "".join(run[: place % 8] + run[place % 8 + 1 :])
                    folded = merkle.node_hash([*run[: place % 8], folded, *run[place % 8 + 1 :]])
                    place //= 8
            out.append((i if known else None, leaf, subroots[t], root, sha(proof), folded, folded == root))
    return sorted(out, key=repr)


def manifest(docs):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    claim = merkle.leaf_digest([*columns_of(columns[:-1]), F.when(tampered, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))])
    return merkle.build(docs, columns, "lang", "doc_id", claim)


def columns_of(names):
    return [F.col(n) for n in names]


def full(rows):
    return [(i, src, lang, None if t is None else len(t), t) for i, t, lang, src in rows]


def test_manifest_of_odd_rows(spark, odd_rows):
    for rows in (odd_rows, odd_rows[:1], [r for r in odd_rows if r[2] is None], [(i, f"T {i}", f"l{i % 11:02d}", "s") for i in range(40)]):
        got = merkle.verify(manifest(documents(spark, rows)))
        assert sorted([tuple(r) for r in got.collect()], key=repr) == brute_manifest(full(rows))
    empty = manifest(documents(spark, []))
    assert empty.root is None and merkle.verify(empty).count() == 0


def test_manifest_of_several_layers(spark):
    sizes = {"a": 1, "b": 512, "c": 513, "d": 4097, None: 70}
    rows = [(k * 10_000 + i, f"Text {i}", lang, "s") for k, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    made = manifest(documents(spark, rows))
    assert len(made.segments) == 2
    assert sorted([tuple(r) for r in merkle.verify(made).collect()], key=repr) == brute_manifest(full(rows))
    found = {(r["tree"], r["position"]): r["digest"] for r in merkle.log(made).collect()}
    names = [r["group"] for r in made.trees.orderBy("tree").collect()]
    assert names == [None, "a", "b", "c", "d"]
    count = 0
    for tree, name in enumerate(names):
        levels = brute_levels([brute_leaf(r) for r in sorted((r for r in full(rows) if r[2] == name), key=lambda r: r[0])])
        order = postorder(levels)
        count += len(order)
        assert all(found[tree, k] == levels[l][i] for k, (l, i) in enumerate(order))
    assert len(found) == count


# Fill in the middle. ----------------------------------------------------------------------------

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def brute_middle(i, text):
    text = text or ""
    units = re.findall(UNIT, text)
    digest = sha("42:" + ("" if i is None else str(i)))
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (i, n, "plain", None, None, text)
    if h[3] % 100 < 80:
        return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("size", [1, 3, 7, 64, fill_middle.FRAME_CHARS])
def test_middles_are_as_by_plain_loops(spark, odd_rows, data_dir, size):
    real = [(r["doc_id"] + 100, r["text"], "en", "a") for r in spark.read.parquet(f"{data_dir}/documents.parquet").limit(200 if size > 7 else 0).collect()]
    hard = ["<P>", "a <S> b", "x<M", "<P <S <M <", " \t ", "  lead", "trail \n", "<<<P", "é\U0001f600 é\x85ö  z", "w" * 500, " " * 500, "a  b " * 40]
    rows = [*odd_rows, *real, *((1000 + k, t, "en", "a") for k, t in enumerate(hard * 6))]
    rows = [r for r in rows if size > 7 or len(r[1] or "") < 2000]
    planned = fill_middle.fill_in_middle(documents(spark, rows), frame_chars=size)
    want = sorted([brute_middle(i, t) for i, t, *_ in rows], key=repr)
    assert sorted([tuple(r) for r in fill_middle.outputs(planned).collect()], key=repr) == sorted([(*w[:3], w[5]) for w in want], key=repr)
    made = [tuple(r) for r in fill_middle.digests(planned).collect()]
    texts = sorted([(*brute_middle(i, t)[:5], sha(brute_middle(i, t)[5]), sha(t or "")) for i, t, *_ in rows], key=repr)
    assert sorted(made, key=repr) == texts
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_way_back_and_frames(spark, odd_rows):
    docs = documents(spark, odd_rows)
    planned = fill_middle.fill_in_middle(docs, share=100, spm_share=50)
    back = fill_middle.outputs(planned).select("id", fill_middle.restore(F.col("output"), F.col("form")).alias("t"))
    assert sorted([tuple(r) for r in back.collect()], key=repr) == sorted([(r[0], r[1] or "") for r in odd_rows], key=repr)
    frames = fill_middle.Frames.of("one two  three four ", 5)
    assert [frames.place(c) for c in range(7)] == [0, 3, 7, 14, 19, 20, 20] and frames.n == 5
    whole = zstandard.ZstdDecompressor().stream_reader(frames.blob, read_across_frames=True).read()
    assert whole == b"one two  three four " and "".join(frames.read(2, 11)) == "e two  th"
    assert fill_middle.digests(fill_middle.fill_in_middle(docs.limit(0))).count() == 0
    for marks in (("a", "a", "b"), ("", "x", "y"), ("ab", "ca", "z"), ("<P>", "<P", "z"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            fill_middle.check_marks(marks)


def test_sections_of_any_pieces():
    text = "<S>su<ff<P>pre<M>mid<"
    for size in range(1, 12):
        pieces = [text[i : i + size] for i in range(0, len(text), size)]
        found = {}
        for at, piece in fill_middle.sections(pieces, ["<S>", "<P>", "<M>"]):
            found[at] = found.get(at, "") + piece
        assert found.get(-1, "") == "" and [found[k] for k in (0, 1, 2)] == ["su<ff", "pre", "mid<"]
    assert "".join(fill_middle.restored(lambda: iter(["<S>x<P>", "y<M", ">z"]), "spm")) == "yzx"

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import chunking, enclosing, inventory, packing, read, rollup
from lodestone.plans.durable import durable, temporary_tables
from lodestone.plans.keyed import content_key, drop_rows, filter_by_keys
from lodestone.plans.ordered import global_rank, running_total
from lodestone.sources.tree import read_tree
from lodestone.streaming import log


def greedy(tokens, limit):
    out, first, total = [], 0, 0
    for i, t in enumerate(tokens):
        if total + t > limit and i > first:
            out.append((first + 1, i, total))
            first, total = i, 0
        total += t
    return out + ([(first + 1, len(tokens), total)] if tokens else [])


def test_chunks_are_as_a_loop(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randint(1, 70) for _ in range(rng.randint(0, 40))]) for i in range(80)]
    got = spark.createDataFrame(rows, "i int, t array<int>").select("i", chunking.chunk_bounds(F.col("t"), 100)).collect()
    assert {r[0]: [tuple(c) for c in r[1]] for r in got} == {i: greedy(t, 100) for i, t in rows}


def first_fit(sizes, limit):
    bins, out = [], []
    for size in sorted(sizes, reverse=True):
        for i, used in enumerate(bins):
            if used + size <= limit:
                bins[i] += size
                break
        else:
            bins.append(size)
            i = len(bins) - 1
        out.append((size, i))
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=60), st.integers(1, 50))
def test_bin_plan_is_as_one_by_one(sizes, limit):
    counts = sorted({s: sizes.count(s) for s in sizes}.items(), reverse=True)
    got = sorted((s, b) for s, b, n in packing.plan_bins(counts, limit) for _ in range(n))
    assert got == first_fit(sizes, limit)


def test_bins_keep_items_and_limits(spark):
    rng = random.Random(1)
    rows = [(f"j{i % 3}", i, rng.randint(0, 900)) for i in range(300)]
    items = spark.createDataFrame(rows, "job_id string, path int, size long")
    got = packing.first_fit_bins(items, 1000).collect()
    assert len(got) == 300
    for job in ("j0", "j1", "j2"):
        mine = [(r["size"], r["bin"]) for r in got if r["job_id"] == job]
        assert sorted(mine) == first_fit([s for s, _ in mine], 1000)
    assert {r["bin"] for r in packing.first_fit_bins(items, 0).collect()} == {0}


def test_innermost_symbol(spark):
    symbols = spark.createDataFrame([("f", 1, 0, 100), ("f", 2, 10, 50), ("f", 3, 10, 20), ("g", 4, 0, 5)], "path string, symbol_id int, start int, end int")
    points = spark.createDataFrame([("f", 1, 15), ("f", 2, 30), ("f", 3, 99), ("f", 4, 100), ("h", 5, 1)], "path string, point_id int, pos int")
    got = {r["point_id"]: r["symbol_id"] for r in enclosing.enclosing_symbol(points, symbols).collect()}
    assert got == {1: 3, 2: 2, 3: 1, 4: None, 5: None}


def test_innermost_of_any_spans(spark):
    import random

    draw = random.Random(5)
    spans = [(f"f{i % 3}", i, a, a + draw.choice([0, 1, 2, 3, 7, 8, 64, 500, 1023, -4])) for i in range(400) for a in [draw.randrange(-40, 900)]]
    spans += [("f0", 900, 0, 1024), ("f0", 901, 0, 1024), ("f1", 902, 5, None), ("f1", 903, None, 9), (None, 904, 0, 50), ("f2", 905, 0, 2_000_000_000)]
    points = [("f%d" % (i % 4), i, draw.randrange(-50, 1100)) for i in range(300)] + [("f2", 400, 1_999_999_999), ("f2", 401, 2_000_000_000), ("f0", 402, None), (None, 403, 3)]
    symbols = spark.createDataFrame(spans, "path string, symbol_id int, start int, end int")
    asked = spark.createDataFrame(points + points[:9], "path string, point_id int, pos int")
    found = enclosing.enclosing_symbol(asked, symbols).collect()
    want = {}
    for file, point, pos in points:
        around = [(a, -b, i) for f, i, a, b in spans if None not in (f, a, b, pos) and f == file and a <= pos < b]
        want[point] = max(around)[2] if around else None
    assert len(found) == len(points) and {r["point_id"]: r["symbol_id"] for r in found} == want
    none = symbols.limit(0)
    assert {r["symbol_id"] for r in enclosing.enclosing_symbol(asked, none).collect()} == {None}
    assert enclosing.enclosing_symbol(asked.limit(0), symbols).count() == 0


@pytest.mark.parametrize("few_symbols, few_points", [(64, 100_000), (4, 100_000), (64, 6), (0, 0)])
def test_innermost_with_files_of_any_size(spark, few_symbols, few_points):
    draw = random.Random(9)
    spans = [(f"f{min(i % 12, 7)}", i, a, a + draw.choice([1, 2, 9, 64])) for i in range(60) for a in [draw.randrange(100)]]
    points = [(f"f{min(i % 14, 9)}", i, draw.randrange(-5, 180)) for i in range(90)]
    symbols = spark.createDataFrame(spans, "path string, symbol_id int, start int, end int")
    asked = spark.createDataFrame(points + points[:7], "path string, point_id int, pos int")
    found = enclosing.enclosing_symbol(asked, symbols, few_symbols=few_symbols, few_points=few_points)
    assert ("Generate" in found._jdf.queryExecution().toString()) == (few_symbols < 64 or few_points < 100_000)
    want = {p: max(((a, -b, i) for f, i, a, b in spans if f == file and a <= pos < b), default=(0, 0, None))[2] for file, p, pos in points}
    got = found.collect()
    assert len(got) == len(points) and {r["point_id"]: r["symbol_id"] for r in got} == want


def test_inventory(spark):
    files = spark.createDataFrame(
        [("a.py", 10), ("b.log", 10), ("node_modules/x.js", 5), ("big.py", 9000), ("i.png", 3), ("k.tmp", 1)], "path string, size long"
    )
    got = {r["path"]: r["skip_reason"] for r in inventory.classify_files(files, ignore_lines=["*.log"], extra_globs=["*.tmp"], max_bytes=100).collect()}
    assert got == {"a.py": "", "b.log": "gitignore", "big.py": "oversize", "i.png": "binary", "k.tmp": "extra_ignore"}
    listing = spark.createDataFrame([("100644 blob abc\tx/y.py",), ("040000 tree def\tx",)], "value string")
    assert [r[0] for r in inventory.head_listing(listing).collect()] == ["x/y.py"]
    head = spark.createDataFrame([("a.py",), ("z.bin",), ("q.py",)], "path string")
    sizes = spark.createDataFrame([("z.bin", 77)], "path string, size long")
    assert {(r["path"], r["size"]) for r in inventory.unfetched(files, head, sizes).collect()} == {("z.bin", 77), ("q.py", -1)}


def test_reads(spark):
    entries = spark.createDataFrame([("a/x.py", 3, True, ""), ("a/y.png", 4, False, "binary"), ("b", 5, True, "")], "path string, size long, analyzed boolean, skip_reason string")
    rows, totals = read.tree(entries, "/a/", True)
    assert [r["path"] for r in rows.collect()] == ["a/x.py"]
    assert tuple(totals.first()) == (1, 3, 3, 12)
    with pytest.raises(ValueError):
        read.file_analysis(entries, "a", ["nope"])
    assert [r[0] for r in rollup.skipped_by_reason(entries).collect()] == ["binary"]


def test_symbol_rollups(spark):
    row = [("f.py", "python", [("B.m", "method", "m", 1), ("B", "class", "B", 0), ("f", "module", "f", 0)])]
    table = spark.createDataFrame(row, "path string, language string, symbols array<struct<qualified_name:string,kind:string,name:string,span:int>>")
    found = rollup.all_symbols(table)
    assert [r["qualified_name"] for r in found.collect()] == ["B", "B.m", "f"]
    assert [r["qualified_name"] for r in rollup.top_level(found).collect()] == ["B"]


def test_tree_source_reads_hidden_names(spark, tmp_path):
    names = ["pkg/__init__.py", "pkg/_base.py", ".gitignore", ".hid/d.py", "x y.py", "e#f.py", "node_modules/a.js"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x" * len(n))
    (tmp_path / "big.py").write_bytes(b"y" * 500)
    got = {r["path"]: r["content"] for r in read_tree(spark, str(tmp_path), max_file_bytes=100, partition_bytes=9000).collect()}
    assert set(got) == {*names[:-1], "big.py"}
    assert got["big.py"] is None and bytes(got["x y.py"]) == b"x" * 6
    with pytest.raises(ValueError):
        read_tree(spark, "relative")


def test_log_tail_holds_back_a_partial_line(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_bytes(b'{"ts": 1.5, "event": "a"}\nnot json\n{"ts": 2, "ev')
    rows, at = log.read_from(str(path), 0)
    assert [r[1] for r in rows] == ["a"] and at == 35
    query = log.tail(spark, str(path)).writeStream.format("memory").queryName("tail").start()
    query.processAllAvailable()
    with path.open("ab") as f:
        f.write(b'ent": "b"}\n')
    query.processAllAvailable()
    query.stop()
    assert sorted(r["event"] for r in spark.table("tail").collect()) == ["a", "b"]
    assert json.loads(log.read_from(str(path), at)[0][0][2])["event"] == "b"


def test_ranks_and_totals_over_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 10**6), rng.randint(0, 9)) for _ in range(3000)]
    table = spark.createDataFrame(rows, "k long, v int").repartition(7)
    ranks = global_rank(table, [F.col("k"), F.col("v")], "rank").orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(3000)) and [r["k"] for r in ranks] == sorted(k for k, _ in rows)
    totals = running_total(table, [F.col("k"), F.col("v")], F.col("v"), "total").orderBy("k", "v", "total").collect()
    run = 0
    for (_, v), r in zip(sorted(rows), totals, strict=True):
        run += v
        assert r["total"] == run


def test_key_filter_either_way(spark):
    rows = spark.range(100).withColumnRenamed("id", "n")
    keys = spark.range(0, 100, 3).withColumnRenamed("id", "k")
    for limit in (0, 1000):
        assert filter_by_keys(rows, keys, "n", True, limit).count() == 34
        assert filter_by_keys(rows, keys, "n", False, limit).count() == 66


def test_rows_are_dropped_by_content(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "b"), (3, None)], "id int, t string")
    key = content_key(F.col("id"), F.col("t"))
    listed = rows.select("id", "t", key.alias("k"))
    gone = listed.where("id = 2").select("k.*")
    repeated = listed.where("id = 1").select("k.*").distinct()
    for limit in (0, 1000):
        got = sorted([tuple(r) for r in drop_rows(rows, key, gone, repeated, limit).collect()], key=repr)
        assert got == sorted([(1, "a"), (None, "b"), (3, None)], key=repr)


def test_temporary_tables_go(spark):
    with temporary_tables(spark):
        lost, kept = durable(spark.range(3)), durable(spark.range(4), keep=True)
        assert lost.count() == 3
    assert kept.count() == 4
    with pytest.raises(Exception, match="FILE|exist"):
        lost.count()


def test_content_keys_tell_nulls_apart(spark):
    rows = [("abc", None), (None, "abc"), ("zz", "abc"), (None, None), ("", None), (None, "")]
    keyed = spark.createDataFrame(rows, "id string, text string").select("id", "text", content_key(F.col("id"), F.col("text")).alias("key"))
    got = keyed.select("key.*").distinct()
    assert got.count() == len(rows) and got.select("k1").distinct().count() == len(rows) and got.select("k2").distinct().count() == len(rows)


def test_only_the_left_out_package_is_forgiven(monkeypatch):
    import importlib

    import __spark_entry__

    def fails(name):
        def load(_):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

        return load

    monkeypatch.setattr(importlib, "import_module", fails("lodestone.llm"))
    assert "lang_rollup" in __spark_entry__.queries() and "pipeline" not in __spark_entry__.queries()
    monkeypatch.setattr(importlib, "import_module", fails("xxhash"))
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import analysis, rollup
from lodestone.plans import durable
from lodestone.sources import walk
from lodestone.streaming import bins, ingest, log

FILES = "path string, content binary"


def test_rates_of_a_stream_are_as_of_a_table(spark, data_dir, tmp_path):
    events = spark.read.parquet(f"{data_dir}/events.parquet").select("ts", "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = log.event_rates(stream).writeStream.outputMode("complete").format("memory").queryName("rates").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, log.event_rates(events).collect()))


def test_batches_are_analysed_once(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def arrive(*rows):
        spark.createDataFrame([(p, bytearray(c)) for p, c in rows], FILES).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest(spark.readStream.schema(FILES).parquet(source), out, state).awaitTermination()

    arrive(("a.py", b"def one(): pass\n"), ("b.go", b"package p\nfunc Two() {}\n"))
    arrive(("a.py", b"def one(): pass\n"), ("c.py", b"class Three: pass\n"), ("b.go", b"package p\nfunc Four() {}\n"))
    files = spark.read.parquet(f"{out}/files").select("batch", "path").collect()
    assert sorted(map(tuple, files)) == [(0, "a.py"), (0, "b.go"), (1, "b.go"), (1, "c.py")]
    names = spark.read.parquet(f"{out}/symbols").where(F.col("kind") != "module").select("batch", "name").collect()
    assert sorted(map(tuple, names)) == [(0, "Two"), (0, "one"), (1, "Four"), (1, "Three")]
    ingest.ingest_batch(spark.createDataFrame([("c.py", bytearray(b"class Three: pass\n"))], FILES), 1, out)
    assert spark.read.parquet(f"{out}/files").where("batch = 1").count() == 1


def rows_of(spark, rows):
    return spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], FILES)


HISTORY = [
    [("a.py", b"def a1(): pass\n"), ("b.go", b"package p\nfunc Two() {}\n"), ("c.py", b"class C: pass\n")],
    [("a.py", b"def a2(): pass\n\n"), ("c.py", None), ("never.py", None)],
    [("a.py", b"def a1(): pass\n"), ("b.go", b"package p\nfunc Two() {}\n"), ("d.py", b"def d(): pass\n")],
    [("c.py", b"class C2: pass\n"), ("d.py", None)],
]


def test_changes_ends_and_returns_equal_a_full_run(spark, tmp_path):
    out, state = str(tmp_path / "out"), {}
    for k, batch in enumerate(HISTORY):
        before = dict(state)
        state.update(batch)
        state = {p: c for p, c in state.items() if c is not None}
        counts = ingest.ingest_batch(rows_of(spark, batch), k, out)
        assert counts["analysed"] == sum(c is not None and before.get(p) != c for p, c in batch) and counts["ended"] == sum(c is None and p in before for p, c in batch)
        if k in (0, 2):
            continue
        facts = analysis.analyze(rows_of(spark, state.items()))
        want = sorted((r["path"], r["name"]) for r in facts.symbols.collect())
        assert sorted((r["path"], r["name"]) for r in ingest.current(spark, out, "symbols").collect()) == want
        again = sorted(map(tuple, ingest.languages_again(spark, out).select("language", "file_count", "bytes", "loc").collect()))
        assert sorted(map(tuple, ingest.languages(spark, out).select("language", "file_count", "bytes", "loc").collect())) == again
        assert again == sorted(map(tuple, rollup.languages(analysis.summaries(facts)).select("language", "file_count", "bytes", "loc").collect()))
        if k == 1:  # a retry changes nothing
            assert ingest.ingest_batch(rows_of(spark, batch), k, out) == counts
            assert sorted((r["path"], r["name"]) for r in ingest.current(spark, out, "symbols").collect()) == want
    assert {r["name"] for r in ingest.current(spark, out, "symbols", upto=1).where("path = 'a.py'").collect()} == {"a2"}
    assert {r["language"]: r["file_count"] for r in ingest.languages(spark, out, upto=0).collect()} == {"python": 2, "go": 1}


def test_a_batch_without_its_versions_does_not_count(spark, tmp_path):
    out = str(tmp_path / "out")
    ingest.ingest_batch(rows_of(spark, HISTORY[0]), 0, out)
    ingest.ingest_batch(rows_of(spark, HISTORY[1]), 1, out)
    shutil.rmtree(f"{out}/versions/batch=1")
    assert {r["name"] for r in ingest.current(spark, out, "symbols").where("path = 'a.py'").collect()} == {"a1"}
    assert sum(r["file_count"] for r in ingest.languages(spark, out).collect()) == 3


def test_arrivals_are_counted_by_the_stream_itself(spark, tmp_path):
    seen = ingest.Arrivals()
    spark.streams.addListener(seen)
    rows_of(spark, HISTORY[0]).coalesce(1).write.parquet(str(tmp_path / "in"))
    ingest.ingest(spark.readStream.schema(FILES).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    began = time.time()
    while seen.counts["files"] < 3 and time.time() - began < 20:
        time.sleep(0.2)
    spark.streams.removeListener(seen)
    assert seen.counts == {"files": 3, "ended": 0, "bytes": sum(len(c) for _, c in HISTORY[0])}


LINES = [b'{"event": "a", "ts": 1.5}\n', b"\n", b"not json\n", b'{"event": "b"}\n', b'[1]\n', '{"event": "é", "ts": 2}\n'.encode(), b'{"event": "' + b"x" * 90 + b'"}\n', b'{"ts": "z"}\n', b'{"event": "last"']


def test_ranges_of_any_size_read_as_in_sequence(tmp_path):
    path = tmp_path / "log"
    path.write_bytes(b"".join(LINES))
    size = path.stat().st_size
    want, end = log.read_from(str(path), 0)
    assert len(want) == 4 and end == size - len(LINES[-1])
    for width in [*range(1, 40), 64, 100, 10_000]:
        got = [r for at in range(0, size, width) for r in log.read_range(str(path), at, min(at + width, size))]
        assert got == want


def test_a_growing_log_is_streamed_once(spark, tmp_path):
    path = tmp_path / "log"
    path.write_bytes(b"".join(LINES))
    stream = log.tail(spark, str(path), range_bytes=16, max_bytes=40)
    query = stream.writeStream.format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        with open(path, "ab") as f:
            f.write(b', "ts": 9}\n{"event": "more"}\n')
        query.processAllAvailable()
    finally:
        query.stop()
    want, _ = log.read_from(str(path), 0)
    got = sorted((tuple(r) for r in spark.table("grown").collect()), key=lambda r: r[3])
    assert got == want and [r[1] for r in want][-2:] == ["last", "more"]
    spark.dataSource.register(log.LogSource)
    whole = spark.read.format("event_log").option("range_bytes", 7).load(str(path)).orderBy("next_offset").collect()
    assert [tuple(r) for r in whole] == want


def test_bins_are_fetched_analysed_and_let_go(spark, tmp_path):
    root, out, limit = tmp_path / "src", str(tmp_path / "out"), 1000
    (root / "pkg").mkdir(parents=True)
    sizes = {}
    for k in range(24):
        body = f"def f{k}(): pass\n" + "#" * (37 * k % 400) + "\n"
        (root / f"pkg/m{k}.py").write_text(body)
        sizes[f"pkg/m{k}.py"] = len(body)
    entries = spark.createDataFrame([*sizes.items(), ("pkg/gone.py", 50)], "path string, size long")
    count = bins.plan(entries, out, limit)
    planned = {r["bin"]: r["sum(size)"] for r in bins.bins(spark, out).groupBy("bin").sum("size").collect()}
    assert sorted(planned) == list(range(count)) and max(planned.values()) <= limit and count < 10
    seen, left = [], []
    scratch = durable.scratch_dir(spark).removeprefix("file://")

    def stop_at(k, counts):
        seen.append((k, counts["bytes"]))
        left.append(sum(len(names) for folder, _, names in os.walk(scratch) if "/batch-" in folder or "/changed-" in folder))
        if k == 1 and len(seen) == 2:
            raise RuntimeError("stopped")

    fetch = lambda files: walk.read_files(files, str(root))
    with pytest.raises(Exception):
        bins.run(spark, count, fetch, out, str(tmp_path / "state"), stop_at)
    bins.run(spark, count, fetch, out, str(tmp_path / "state"), stop_at)
    assert [k for k, _ in seen] == [0, 1, 1, *range(2, count)] and all(b <= limit for _, b in seen) and not any(left)
    names = {r["name"] for r in ingest.current(spark, out, "symbols").collect()}
    assert names == {f"f{k}" for k in range(24)}
    assert [r["path"] for r in bins.failures(spark, out).collect()] == ["pkg/gone.py"]

"""Walking a folder and writing artefacts, against plain loops."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import classify, gitignore
from lodestone.operators import analysis
from lodestone.sources import artifacts, walk

TREE = (
    "a.py", ".hid/b.py", "x y.py", "pkg/__init__.py", "pkg/deep/er/and/deeper/c.go", "node_modules/left/d.js", "pkg/node_modules/e.js", "gen/f.py", "gen/keep/g.py", "build2/h.py",
    "docs/i.md", "docs/api/j.md", "k.log", "logs/l.txt",
)
RULES = ["gen/", "*.log", "!k.log", "docs/api", "logs/**"]


def ignored_by_loop(path, lines):
    out = False
    for line in lines:
        if (found := gitignore.rule(line)) and re.search(found[0], path):
            out = found[1]
    return out


def walked_by_loop(root, lines):
    found = []
    for folder, names, files in os.walk(root):
        base = os.path.relpath(folder, root).replace(".", "", 1) if folder == str(root) else os.path.relpath(folder, root)
        names[:] = [n for n in names if n not in classify.SKIPPED_FOLDERS and not ignored_by_loop(os.path.join(base, n) + "/", lines)]
        found += [(os.path.join(base, n), os.path.getsize(os.path.join(folder, n))) for n in files]
    return sorted(found)


def test_a_walk_by_waves_is_a_walk(spark, tmp_path):
    for name in TREE:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name * 3)
    os.symlink(tmp_path / "pkg", tmp_path / "linked")
    for lines in ([], RULES):
        got = walk.walk(spark, str(tmp_path), lines)
        assert sorted(map(tuple, got.collect())) == walked_by_loop(tmp_path, lines)
    read = {r["path"]: r["content"] for r in walk.read_files(walk.walk(spark, str(tmp_path), RULES), str(tmp_path), max_bytes=30).collect()}
    assert bytes(read["a.py"]) == b"a.pya.pya.py" and read["pkg/__init__.py"] is None and "gen/keep/g.py" not in read
    gone = walk.read_files(spark.createDataFrame([("no.py", 3)], "path string, size long"), str(tmp_path)).collect()
    assert [tuple(r) for r in gone] == [("no.py", 3, None)]


def test_five_thousand_rules_are_as_one_by_one(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    kinds = (
        lambda: rng.choice(words), lambda: "*." + rng.choice(words), lambda: rng.choice(words) + "/", lambda: "/" + rng.choice(words), lambda: f"{rng.choice(words)}/{rng.choice(words)}",
        lambda: rng.choice(words) + "*", lambda: f"*{rng.choice(words)}", lambda: f"{rng.choice(words)}/**/{rng.choice(words)}/", lambda: "# " + rng.choice(words), lambda: f"/{rng.choice(words)}/*.{rng.choice(words)}",
    )
    weights = (20, 20, 10, 5, 5, 3, 0.1, 0.1, 1, 0.1)
    lines = [("!" if rng.random() < 0.3 else "") + rng.choices(kinds, weights)[0]() for _ in range(5000)]
    part = lambda: rng.choice(words) + rng.choice(["", "", ".py", "." + rng.choice(words), "x"])
    paths = ["/".join(part() for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "/"]) for _ in range(200)] + [""]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r[0]: r[1] for r in rows.select("p", gitignore.ignored(F.col("p"), lines)).collect()}
    assert got == {p: ignored_by_loop(p, lines) for p in paths} and 20 < sum(got.values()) < 180
    assert not any(r[0] for r in rows.select(gitignore.ignored(F.col("p"), [])).collect())


def files_under(folder):
    return sorted(os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names)


def test_artefacts_stand_under_their_paths(spark, tmp_path):
    sources = [("a.py", "def f(): pass\n"), ("pkg/deep/b.go", "package p\nfunc G() {}\n"), ("é x/c.xyz", "?")]
    facts = analysis.analyze(spark.createDataFrame(sources, "path string, text string"))
    out = str(tmp_path / "files")
    artifacts.write_artifacts(analysis.artifacts(facts).repartition(3), out)
    assert files_under(out) == sorted(f"{p}.json" for p, _ in sources)
    body = json.loads((tmp_path / "files/a.py.json").read_text())
    assert [s["name"] for s in body["symbols"]] == ["f"] and body["parse"] == {"parse_ok": True, "error_nodes": 0, "missing_nodes": 0}
    artifacts.write_artifacts(spark.createDataFrame([("a.py", "{}")], "path string, body string"), out)
    assert (tmp_path / "files/a.py.json").read_text() == "{}" and len(files_under(out)) == 3


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    out = str(tmp_path / "files")
    rows = spark.createDataFrame([(f"d/f{k}.py", "{}") for k in range(20)] + [("../out.py", "{}")], "path string, body string").repartition(4)
    with pytest.raises(Exception):
        artifacts.write_artifacts(rows, out)
    assert files_under(tmp_path) == []
    with pytest.raises(ValueError):
        artifacts._below("/x", "/etc/passwd")


def test_writes_count_what_they_write(spark, tmp_path):
    sources = [("a.py", "def f(): pass\n"), ("b.py", "def g(:\n"), ("c.xyz", "?")]
    facts = analysis.analyze(spark.createDataFrame(sources, "path string, text string"))
    counts = analysis.write(facts, str(tmp_path / "out"))
    for name, count in counts.items():
        read = spark.read.json if name == "log" else spark.read.parquet
        assert read(str(tmp_path / "out" / name)).count() == count["rows"], name
    assert counts["files"]["bytes"] == sum(len(t) for _, t in sources) and counts["parse"]["errors"] == 1 and counts["symbols"]["rows"] >= 1
    index = {r["name"]: r["rows"] for r in spark.read.json(str(tmp_path / "out/index")).collect()}
    assert index == {n: c["rows"] for n, c in counts.items()}

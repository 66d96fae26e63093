import json

import pytest

from lodestone.index import index
from lodestone.operators import rollup
from lodestone.streaming import log

FILES = {
    "alpha.py": "def hello():\n    return 1\n\nclass A:\n    def m(self):\n        return hello()\n", "pkg/beta.py": "class Beta:\n    def m(self):\n        pass\n",
    "cmd/main.go": "package main\n\nfunc main() {\n    run()\n}\n", "ts/util.ts": "export function util(a: number) { return a; }\n",
    "tests/test_alpha.py": "def test_hello():\n    assert True\n", "README.md": "# hi\n", ".gitignore": "ignored.py\n", "ignored.py": "x = 1\n",
    "node_modules/leftpad/index.js": "x\n", "pkg/__init__.py": "", "gen/big.py": "x = 1\n" * 500,
}


def test_index_of_a_folder(spark, tmp_path):
    for name, body in FILES.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(body)
    (tmp_path / "src/image.py").write_bytes(b"a\x00b")
    out = str(tmp_path / "out")
    row = index(spark, str(tmp_path / "src"), out, max_file_bytes=1000).first()
    assert (row["file_count"], row["tree_total"], row["skipped_count"], row["test_file_count"]) == (8, 11, 3, 1)
    tree = {r["path"]: r["skip_reason"] for r in spark.read.parquet(f"{out}/rollups/tree").collect()}
    assert tree["ignored.py"] == "gitignore" and tree["gen/big.py"] == "oversize" and tree["image.py"] == "binary" and "node_modules/leftpad/index.js" not in tree
    languages = {r["language"]: r["file_count"] for r in spark.read.parquet(f"{out}/rollups/languages").collect()}
    assert languages == {"python": 4, "go": 1, "typescript": 1, "markdown": 1, "unknown": 1}
    top = {r["qualified_name"] for r in spark.read.parquet(f"{out}/rollups/top_level_symbols").collect()}
    assert top == {"hello", "A", "Beta", "util", "test_hello"}
    assert {r["path"] for r in spark.read.parquet(f"{out}/rollups/errors").collect()} == {".gitignore"}
    assert spark.read.json(f"{out}/index").count() == 12
    bodies = {r["path"]: r for r in spark.read.parquet(f"{out}/artifacts").collect()}
    body = json.loads(bodies["alpha.py"]["body"])
    assert [s["qualified_name"] for s in sorted(body["symbols"], key=lambda s: s["span"]["start_byte"])] == ["hello", "A", "A.m"]
    assert body["metrics"]["max_nest_depth"] == 2 and body["file"]["comment"] == 0 and body["parse"]["parse_ok"] and "module_doc" in body
    assert len(bodies) == 8 and all(r["size_bytes"] == len(r["body"].encode()) for r in bodies.values())
    index(spark, str(tmp_path / "src"), out, max_file_bytes=1000)
    stream = log.follow(spark, f"{out}/log").writeStream.format("memory").queryName("followed").trigger(availableNow=True).start()
    stream.awaitTermination()
    done = rollup.progress(spark.table("followed")).collect()
    assert {r["language"]: (r["files_done"], r["errors_count"]) for r in done} == {
        "python": (8, 0), "go": (2, 0), "typescript": (2, 0), "markdown": (2, 0), "unknown": (2, 2)}


def test_index_of_a_hosted_repository(spark, tmp_path):
    def get(url, headers, body):
        if "/git/trees/" in url:
            return json.dumps({"tree": [{"path": "a.py", "type": "blob", "size": 9}, {"path": "b.py", "type": "blob", "size": 9}, {"path": "i.png", "type": "blob", "size": 3}, {"path": "gone/c.py", "type": "blob", "size": 3}]}).encode()
        if url.startswith("https://api."):
            return b'{"default_branch": "main"}'
        if url.endswith("/.gitignore"):
            return b"gone/\n"
        return b"def f(): pass\n" if url.endswith("a.py") else None

    row = index(spark, "https://github.com/o/r", str(tmp_path / "out"), get=get).first()
    assert (row["file_count"], row["tree_total"], row["skipped_count"]) == (1, 4, 2)
    skipped = {r["skip_reason"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out/rollups/skipped_by_reason")).collect()}
    assert skipped == {"binary": 1, "gitignore": 1}
    row = index(spark, "https://github.com/o/r", str(tmp_path / "out3"), respect_ignore=False, get=get).first()
    assert row["skipped_count"] == 1
    with pytest.raises(ValueError):
        index(spark, "ssh://host/x", str(tmp_path / "o2"))

import fnmatch
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import classify, gitignore, literals, spans, text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize(
    "path, test, config, generated",
    [
        ("src/test_a.py", True, False, False), ("src/a_test.go", True, False, False), ("a/tests/x.py", True, False, False),
        ("latest", True, False, False), ("src/a.spec.ts", True, False, False), ("src/contest.py", False, False, False),
        ("Dockerfile", False, True, False), ("x/settings.YAML", False, True, False), ("dist/a.js", False, False, True),
        ("src/build/a.js", False, False, True), ("a.py", False, False, False), ("", False, False, False),
    ],
)
def test_path_flags(spark, path, test, config, generated):
    p = F.col("p")
    got = values(spark, [(path,)], "p string", classify.is_test(p), classify.is_config(p), classify.is_generated(p))
    assert got == [(test, config, generated)]


def test_generated_by_head_only(spark):
    rows = [("// Code generated by x",), ("x" * 2100 + "do not edit",), (None,), ("plain",)]
    got = values(spark, rows, "c string", classify.is_generated(F.lit("a.py"), F.col("c")))
    assert [g[0] for g in got] == [True, False, False, False]


def test_language(spark):
    rows = [
        ("a/B.PY", "", "python"), ("CMakeLists.txt", "", "cmake"), ("run", "#!/usr/bin/env  python3 -u", "python"), ("run", "#! /bin/bash", "bash"),
        ("x.unknown", "", ""), ("Makefile", "", "make"), ("noext", None, ""), ("run", "#!", ""),
    ]
    got = values(spark, [r[:2] for r in rows], "p string, l string", classify.language(F.col("p"), F.col("l")))
    assert [g[0] for g in got] == [r[2] for r in rows]


def test_binary_and_skip_reason(spark):
    rows = [(b"ab\x00c",), (b"abc",), (None,), (b"a" * 9000 + b"\x00",)]
    assert [r[0] for r in values(spark, rows, "c binary", classify.looks_binary(F.col("c")))] == [True, False, True, False]


@pytest.mark.parametrize(
    "lines, path, ignored",
    [
        (["*.log"], "a/b.log", True), (["/a.txt"], "b/a.txt", False), (["build/"], "x/build/y.c", True), (["build/"], "build", False),
        (["*.py", "!keep.py"], "a/keep.py", False), (["a/**/z"], "a/b/c/z", True), (["a/**/z"], "a/z", True), (["doc/*.md"], "doc/x/y.md", False),
        (["# c", "", r"\#x"], "#x", True), (["**/t"], "q/t/u", True), (["[ab].c"], "b.c", True), (["[!ab].c"], "b.c", False),
    ],
)
def test_gitignore(spark, lines, path, ignored):
    assert values(spark, [(path,)], "p string", gitignore.ignored(F.col("p"), lines)) == [(ignored,)]


def test_globs_are_as_fnmatch(spark):
    paths = ["src/c.py", "src/a/b.py", "x.py", "src/c.pyc", "a[b].py", "src/ab/c"]
    for pattern in ["src/*.py", "src/**/*.py", "*.py", "src/?.py", "[as]rc/*", "src/*"]:
        got = values(spark, [(p,) for p in paths], "p string", gitignore.glob_matches(F.col("p"), pattern))
        assert [g[0] for g in got] == [fnmatch.fnmatchcase(p, pattern) for p in paths], pattern


def test_text_measures_are_as_python(spark):
    rng = random.Random(5)
    alphabet = ["a", " ", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " ", "\xa0", "é", "　"]
    texts = ["", "\n", "a"] + ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(400)]
    t = F.col("t")
    got = values(spark, [(x,) for x in texts], "t string", text.n_lines(t), text.n_blank(t), text.n_bytes(t), text.tokens(t), text.digest(t))
    for x, row in zip(texts, got, strict=True):
        lines, raw = x.splitlines(), x.encode()
        assert row == (len(lines), sum(not s.strip() for s in lines), len(raw), max(1, (len(raw) + 3) // 4), hashlib.sha256(raw).hexdigest())


def test_bytes_decode_with_replacement(spark):
    rows = [(b"ab\xffc",), (b"\xef\xbb\xbfx",), (b"\xed\xa0\x80",), (b"",)]
    got = values(spark, rows, "c binary", text.decoded(F.col("c")))
    assert [g[0] for g in got] == [r[0].decode("utf-8", "replace") for r in rows]


def test_spans_are_as_finditer(spark):
    import re

    rng = random.Random(7)
    texts = ["".join(rng.choices("ab1 é\n", k=rng.randint(0, 900))) for _ in range(60)]
    got = values(spark, [(x,) for x in texts], "t string", spans.located(F.col("t"), "[ab]+1?"))
    for x, (found,) in zip(texts, got, strict=True):
        assert [tuple(s) for s in found] == [(m.start(), m.end(), m.group()) for m in re.finditer("[ab]+1?", x)]


def test_literals(spark):
    cases = [
        ("see https://x.io/a/b, now", "", [("url", "https://x.io/a/b")]),
        ("/etc/hosts", "", [("path", "/etc/hosts"), ("route", "/etc/hosts")]),
        ("~/.ssh/config", "", [("path", "~/.ssh/config")]),
        ("/users/{id}/posts", "", [("route", "/users/{id}/posts")]),
        ("/foo", "", []),
        ("  select *\n from t", "", [("sql", "select * from t")]),
        ("WITH love", "", [("sql", "WITH love")]),
        ("DB_URL", "os.getenv(", [("env_var", "DB_URL")]),
        ("DB_URL", "print(", []),
        ("http://a.b/c http://a.b/c", "", [("url", "http://a.b/c")]),
    ]
    got = values(spark, [c[:2] for c in cases], "v string, c string", literals.literals(F.col("v"), F.col("c")))
    for (value, _, want), (found,) in zip(cases, got, strict=True):
        assert [tuple(x) for x in found] == want, value


@pytest.mark.parametrize("pattern, path, fits", [
    ("*.json", "tree.json", True), ("*.json", "files/a.json", False), ("files/**/*.json", "files/a.json", True), ("files/**/*.json", "files/a/b/c.json", True),
    ("**", "a/b", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("[ab].x", "b.x", True), ("[!ab].x", "b.x", False), ("x/**", "x/y/z", True), ("x/**", "y/x", False),
])
def test_globs_by_segments(pattern, path, fits):
    assert bool(re.match(gitignore.path_regex(pattern), path)) is fits

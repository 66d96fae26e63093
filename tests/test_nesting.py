"""Brackets, lists and scopes against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions import classify
from lodestone.operators import brackets, lists, symbols


def files_of(spark, sources):
    return spark.createDataFrame(list(sources.items()), "path string, text string").withColumn("language", classify.language(F.col("path")))


def brute_unmatched(marks):
    closes = opens = 0
    for opened, closed in brackets.PAIRS:
        depth = 0
        for m in marks:
            if m == opened:
                depth += 1
            elif m == closed:
                closes, depth = (closes, depth - 1) if depth else (closes + 1, 0)
        opens += depth
    return closes, opens


def test_any_grouping_of_runs_gives_the_same_sum(spark):
    rng = random.Random(1)
    texts = ["", ")(", "((]", "([)]", *("".join(rng.choice("()[]{}") for _ in range(rng.randint(1, 300))) for _ in range(60))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, marks string")
    want = [brute_unmatched(t) for t in texts]
    for run in (1, 7, 4096):
        state = brackets.reduce_text(F.col("marks"), run)
        got = rows.select("id", brackets.unopened(state), brackets.unclosed(state)).orderBy("id").collect()
        assert [tuple(r)[1:] for r in got] == want
    parts = [(i, k, t[k : k + 5]) for i, t in enumerate(texts) for k in range(0, len(t), 5)]
    cut = spark.createDataFrame(parts, "id int, at int, marks string").repartition(4)
    whole = brackets.combined(cut.select("id", "at", brackets.reduce_run(F.col("marks")).alias("state")), "id", "at")
    got = {r[0]: (r[1], r[2]) for r in whole.select("id", brackets.unopened(F.col("state")), brackets.unclosed(F.col("state"))).collect()}
    assert got == {i: w for i, w in enumerate(want) if texts[i]}


def test_parse_status_of_broken_files(spark):
    sources = {
        "a.go": "package p\nfunc f() { g(f)(; }\n", "b.java": "} class A {", "c.py": "def bad(:\n    x = '('\n# (((\n", "d.ts": "const a = `((`; // [\nfoo()\n",
        "e.sh": "case $x in\n  a) echo 1 ;;\nesac\nf() { x=(1 2); }\n", "f.rs": "fn f<'a>(x: &'a str) { let c = '('; }\n", "g.md": "((", "h.c": "int f( {\n", "i.py": "",
    }
    got = {r["path"]: (r["parse_ok"], r["error_nodes"], r["missing_nodes"]) for r in symbols.parse_status(files_of(spark, sources)).collect()}
    assert got == {
        "a.go": (False, 1, 1), "b.java": (False, 2, 1), "c.py": (False, 1, 1), "d.ts": (True, 0, 0), "e.sh": (True, 0, 0), "f.rs": (True, 0, 0),
        "g.md": (True, 0, 0), "h.c": (False, 2, 2), "i.py": (True, 0, 0),
    }


@pytest.mark.parametrize(("text", "want"), [
    ("a::b", ["a::b"]), ("std::{fmt::{self, Debug}, io}", ["std::fmt::self", "std::fmt::Debug", "std::io"]), ("{a, b::{c}}", ["a", "b::c"]),
    ("a::{ b as c , d::{e::{f, g::{h}}, i} , }", ["a::b as c", "a::d::e::f", "a::d::e::g::h", "a::d::i"]), ("", []), ("a::{}", []), ("a::{b", ["a::b"]), ("a}, b", ["a", "b"]),
])
def test_trees_of_names(spark, text, want):
    assert spark.range(1).select(lists.expand_tree(F.lit(text))).first()[0] == want


@pytest.mark.parametrize(("text", "want"), [
    ("a = 1, b = 2", ["a = 1", "b = 2"]), ("a = f(1, 2), b = [3, {c: 4}], d", ["a = f(1, 2)", "b = [3, {c: 4}]", "d"]), ("a = ',(', b = `,[`", ["a = ',('", "b = `,[`"]),
    ("", []), ("a)", ["a)"]), ("a), b", ["a)", "b"]),
])
def test_parts_outside_of_brackets(spark, text, want):
    assert spark.range(1).select(lists.split_outside(F.lit(text))).first()[0] == want


@pytest.mark.parametrize(("text", "want"), [
    ("grep x | sort", ["grep", "sort"]), ("a && b || c |& d & e", ["a", "b", "c", "d", "e"]), ("x=$(a b | c) d", ["a", "c"]), ("if ! a -q", ["a"]),
    ("V=1 W=2 run x", ["run"]), ("arr=(a b)", []), ("(cd x && y)", ["cd", "y"]), ("echo 'a | b' \"c && d\"", ["echo"]), ("diff <(a) <(b)", ["diff", "a", "b"]), ("a 2>&1 | b", ["a", "b"]),
])
def test_shell_commands(spark, text, want):
    assert spark.range(1).select(lists.commands(F.lit(text), ("if", "then"))).first()[0] == want


def test_lists_give_all_their_names(spark):
    sources = {
        "a.rs": "use std::{fmt::{self, Debug}, io};\nuse a::*;\nuse b::{self as c, d::{e::{f as g}}};\n",
        "b.go": "package p\nconst (\n\tA = 1 // one\n\tB, c = f(\n\t\t1), 2\n)\nvar (\n\tX = T{\n\t\t\"k\": 1,\n\t}\n\ty int\n)\nvar q, Z = 1, 2\nconst one = 3\nfunc F() {\n\tconst inner = 1\n}\n",
        "c.ts": "const K = 3, L = (n) => f(n), M: Map<string, number> = g();\nexport default class { }\nlet f2 = async function (a) { const z = 1; return a; };\n",
        "d.rb": "class A\n  def self.m(a)\n    go(a)\n  end\nend\n",
    }
    declared = symbols.declarations(files_of(spark, sources))
    found = symbols.symbols(declared)
    imports = {(r["module"], r["alias"]) for r in symbols.imports(declared).collect()}
    assert imports == {("std::fmt::Debug", None), ("std::io", None), ("b::self", "c"), ("b::d::e::f", "g")}
    names = {(r["path"], r["qualified_name"], r["kind"]) for r in found.collect()}
    assert {n for n in names if n[0] == "b.go"} == {("b.go", x, k) for x, k in [
        ("p", "module"), ("p.A", "constant"), ("p.B", "constant"), ("p.c", "constant"), ("p.X", "constant"), ("p.Z", "constant"), ("p.one", "constant"), ("p.F", "function")]}
    assert {n[1:] for n in names if n[0] == "c.ts"} == {("K", "constant"), ("L", "function"), ("M", "constant"), ("f2", "function")}
    lines = {r["qualified_name"]: (r["span"]["start_line"], r["signature"]) for r in found.where("path = 'b.go'").collect()}
    assert lines["p.A"] == (3, "A = 1") and lines["p.X"][0] == 8 and lines["p.one"] == (14, "one = 3")
    calls = {(r["path"], r["qualifier"]) for r in symbols.references(declared).where("kind = 'call'").collect()}
    assert calls == {("b.go", "f"), ("c.ts", "f"), ("c.ts", "g"), ("d.rb", "go")}
    assert {(r["path"], r["name"]) for r in symbols.exports(declared, found).where("path = 'c.ts'").collect()} == {("c.ts", "default")}


def brute_scopes(lines):
    """The names around each ``def`` and ``class`` of a Python file, by a stack of leads."""
    stack, out = [], []
    for line in lines:
        lead = len(line) - len(line.lstrip())
        while stack and stack[-1][0] >= lead:
            stack.pop()
        word = line.split()
        name = word[1].split("(")[0].rstrip(":") if word[0] in ("def", "class") else None
        if name:
            out.append(".".join([*(n for _, n in stack if n), name]))
        stack.append((lead, name))
    return out


def test_scopes_of_uneven_indents(spark):
    rng = random.Random(4)
    sources = {}
    for k in range(6):
        lines, lead = [], 0
        for i in range(60):
            lead = rng.choice([0, lead, lead, lead + rng.choice([1, 2, 4, 8]), max(0, lead - 4)])
            lines.append(" " * lead + rng.choice([f"class C{i}:", f"def f{i}(x):", "if x:"]))
        sources[f"f{k}.py"] = "\n".join(lines) + "\n"
    found = symbols.symbols(symbols.declarations(files_of(spark, sources)))
    for path, text in sources.items():
        got = [r["qualified_name"] for r in found.where(F.col("path") == path).orderBy("span.start_line").collect()]
        assert got == brute_scopes(text.splitlines())


def test_deep_nesting_costs_no_more(spark):
    def took(depth):
        text = "".join(f"class C{i} {{ " if i % 10 == 0 else "static { " for i in range(depth)) + "int go(int n) { return 1; } " + "} " * depth
        began = time.perf_counter()
        rows = symbols.symbols(symbols.declarations(files_of(spark, {"A.java": text}))).collect()
        assert len(rows) == -(-depth // 10) + 1 and max(len(r["qualified_name"]) for r in rows) > depth // 4
        return time.perf_counter() - began

    took(3)
    assert took(300) < 2 * took(30) + 2


def test_brackets_of_a_long_file_are_made_once(spark):
    rng = random.Random(5)
    text = "".join(rng.choices("([{)]}", k=600_000)) + "\n// ( [\nx = \"}} ((\"\n"
    want = [0, 0]
    for opened, closed in brackets.PAIRS:
        depth = 0
        for mark in text.split("\n")[0]:
            if mark == opened:
                depth += 1
            elif mark == closed:
                want[0], depth = want[0] + (depth == 0), max(depth - 1, 0)
        want = [want[0], want[1] + depth]
    files = spark.createDataFrame([("a.java", text)], "path string, text string").withColumn("language", F.lit("java"))
    symbols.parse_status(files.limit(0)).collect()
    began = time.time()
    got = symbols.parse_status(files).first()
    assert (got["error_nodes"], got["missing_nodes"]) == (sum(want), want[1])
    assert time.time() - began < 12

"""Facts extracted from small sources of every language."""

import pytest

from lodestone.functions import classify
from lodestone.operators import analysis, rollup, symbols
from pyspark.sql import functions as F

SOURCES = {
    "demo/shop.py": '''"""Shop tools."""
import json
from collections import OrderedDict as OD
from .stock import (
    item,
    shelf,
)

__all__ = ["Shop", "run"]

MAX_ITEMS: int = 10

class Shop(Base):
    """A shop."""

    name: str = "x"

    @classmethod
    async def open(cls, n: int) -> str:
        """Open it."""
        link = "https://shop.example.com/v2/goods"
        return str(n)

    def __init__(self):
        self.n = {"a": 1}

def run(*args):
    # def hidden(): comment
    yield len(args)

def test_it():
    assert True

if __name__ == "__main__":
    run()
''',
    "demo/broken.py": "def fine():\n    return 1\n\ndef bad(:\n    return 2\n\ndef fine2():\n    return 3\n",
    "web/view.ts": '''import { One, Two as T } from "./parts";
import Main from "./main";
export const LIMIT = 5;
export interface Shape { size: number }
export type Id = string | number;
export enum Tone { Low, High }
export class Circle extends Base {
    radius: number = 0;
    static unit = 'cm';
    async draw(n: number): Promise<string> { return render(n); }
}
export function area(r: number): number { return r * r; }
const onClick = (e: Event) => handle(e);
''',
    "web/old.js": 'import X from "./x";\nexport const y = 1;\nexport class D { go() { return 1; } }\nexport function up() { return 1; }\n',
    "cmd/main.go": '''// Package main starts.
package main

import (
    "os"
    x "os"
)

const Rate = 2
var Title = "t"

type Box struct {
    W int
    h int
}
type Opener interface { Open() string }

func grow(a int) string { return "" }
func TestGrow(t *testing.T) {}
func (b *Box) Fill(n int) string {
    os.Exit(n)
    return ""
}
func main() { grow(1) }
''',
    "src/lib.rs": '''//! Crate notes.
use std::fmt::Debug;
use crate::kit::{Tool, Part as P};

pub const SIZE: u32 = 1;
pub type Name = String;

pub struct Rod { pub len: u32 }
pub enum Mode { On, Off(u32) }
pub trait Turn { fn turn(&self) -> String; }

impl Rod {
    pub fn new() -> Self { Rod { len: 0 } }
    pub fn cut(&self, n: u32) -> u32 { n + 1 }
}

pub fn weld(a: u32) -> u32 { a + 1 }
pub async fn load() -> String { String::new() }

fn main() { weld(1); }

#[test]
fn holds() { assert_eq!(1, 1); }
''',
    "app/Car.java": '''package org.demo;

import java.util.Map;
import static java.util.Objects.hash;

public class Car extends Vehicle implements Part {
    private int wheels = 4;
    public static final String KIND = "k";

    public Car() {}
    public Map<String, Integer> parts(int n) { return hash(n); }
}

interface Part { void fit(); }
''',
    "lib/tool.rb": '''require "set"
require_relative "./aid"

module Kit
  DEPTH = 3

  class Saw < Blade
    def initialize
      @teeth = 1
    end

    def cut(wood)
      puts 'cut'
    end
  end
end
''',
    "c/run.c": '''#include <stdlib.h>
#include "own.h"

#define RATE 2.5
typedef struct { int a; int b; } Pair;

static int twice(int n) { return n + n; }

int main(int argc, char *argv[]) {
    printf("%d", twice(2));
    return 0;
}
''',
    "c/space.cpp": "#include <map>\nnamespace sp {\n    int jump(int x) { return x + 1; }\n}\n",
    "net/Lamp.cs": '''using System.Text;
namespace Home {
    public class Lamp {
        public int Watts { get; set; }
        public Lamp() {}
        public void Light() {}
    }
    public interface ILit { void Light(); }
}
''',
    "www/page.php": '''<?php
namespace Site;
use Site\\Kit\\Form;

const DEPTH = 1;

interface Shown { public function show(): string; }

class Page extends Base implements Shown {
    public function __construct() {}
    public function show(): string { return ''; }
}

function link_to(int $a): int { return $a + 1; }
''',
    "bin/do.sh": '''#!/usr/bin/env bash
source ./lib.sh
TARGET="x"

build() {
    echo "made $1"
}

function clean {
    return 0
}

build "all"
''',
}


@pytest.fixture(scope="module")
def facts(spark):
    files = spark.createDataFrame(list(SOURCES.items()), "path string, text string").withColumn("language", classify.language(F.col("path")))
    declared = symbols.declarations(files).cache()
    found = symbols.symbols(declared).cache()
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    yield {
        "symbols": rows(found), "imports": rows(symbols.imports(declared)), "references": rows(symbols.references(declared)),
        "literals": rows(symbols.string_literals(declared)), "exports": rows(symbols.exports(declared, found)), "metrics": rows(symbols.metrics(declared, found)),
    }
    declared.unpersist()
    found.unpersist()


KINDS = {
    "demo/shop.py": {
        "MAX_ITEMS": "constant", "Shop": "class", "Shop.name": "field", "Shop.open": "method", "Shop.__init__": "constructor", "run": "function", "test_it": "function",
    },
    "demo/broken.py": {"fine": "function", "fine2": "function"},
    "web/view.ts": {
        "LIMIT": "constant", "Shape": "interface", "Id": "type_alias", "Tone": "enum", "Circle": "class", "Circle.radius": "field", "Circle.unit": "field",
        "Circle.draw": "method", "area": "function", "onClick": "function",
    },
    "web/old.js": {"y": "constant", "D": "class", "D.go": "method", "up": "function"},
    "cmd/main.go": {
        "main": "module", "main.Rate": "constant", "main.Title": "constant", "main.Box": "class", "main.Box.W": "field", "main.Box.h": "field",
        "main.Opener": "interface", "main.grow": "function", "main.TestGrow": "function", "main.Box.Fill": "method", "main.main": "function",
    },
    "src/lib.rs": {
        "SIZE": "constant", "Name": "type_alias", "Rod": "class", "Rod.len": "field", "Mode": "enum", "Turn": "interface", "Turn.turn": "method", "Rod.new": "constructor",
        "Rod.cut": "method", "weld": "function", "load": "function", "main": "function", "holds": "function",
    },
    "app/Car.java": {
        "org.demo.Car": "class", "org.demo.Car.wheels": "field", "org.demo.Car.KIND": "constant", "org.demo.Car.Car": "constructor",
        "org.demo.Car.parts": "method", "org.demo.Part": "interface", "org.demo.Part.fit": "method",
    },
    "lib/tool.rb": {"Kit": "module", "Kit.DEPTH": "constant", "Kit.Saw": "class", "Kit.Saw.initialize": "constructor", "Kit.Saw.cut": "method"},
    "c/run.c": {"RATE": "constant", "Pair": "type_alias", "twice": "function", "main": "function"},
    "c/space.cpp": {"sp": "module", "sp.jump": "function"},
    "net/Lamp.cs": {
        "Home": "module", "Home.Lamp": "class", "Home.Lamp.Watts": "property", "Home.Lamp.Lamp": "constructor", "Home.Lamp.Light": "method",
        "Home.ILit": "interface", "Home.ILit.Light": "method",
    },
    "www/page.php": {
        "Site.DEPTH": "constant", "Site.Shown": "interface", "Site.Shown.show": "method", "Site.Page": "class", "Site.Page.__construct": "constructor",
        "Site.Page.show": "method", "Site.link_to": "function",
    },
    "bin/do.sh": {"TARGET": "constant", "build": "function", "clean": "function"},
}


@pytest.mark.parametrize("path", sorted(KINDS))
def test_symbols(facts, path):
    got = {s["qualified_name"]: s["kind"] for s in facts["symbols"] if s["path"] == path}
    if path == "demo/broken.py":
        got.pop("bad", None)
    assert got == KINDS[path]


def test_spans_are_where_the_names_are(facts):
    for s in facts["symbols"]:
        raw = SOURCES[s["path"]].encode()
        span = s["span"]
        part = raw[span["start_byte"] : span["end_byte"]].decode()
        assert s["name"] in part and raw[: span["start_byte"]].count(b"\n") + 1 == span["start_line"] <= span["end_line"]
    shop = next(s for s in facts["symbols"] if s["qualified_name"] == "Shop")
    assert "self.n" in SOURCES["demo/shop.py"][shop["span"]["start_byte"] : shop["span"]["end_byte"]]
    assert shop["doc"] == "A shop." and shop["signature"] == "class Shop(Base)"


def test_modifiers(facts):
    by = {(s["path"], s["qualified_name"]): s["modifiers"] for s in facts["symbols"]}
    assert {"async", "classmethod"} <= set(by["demo/shop.py", "Shop.open"])
    assert "async" in by["src/lib.rs", "load"] and "test" in by["src/lib.rs", "holds"] and "static" in by["app/Car.java", "org.demo.Car.KIND"]


def test_imports(facts):
    got = {(i["path"], i["module"], i["alias"], i["kind"]) for i in facts["imports"]}
    assert got == {
        ("demo/shop.py", "json", None, "import"), ("demo/shop.py", "collections.OrderedDict", "OD", "from"), ("demo/shop.py", ".stock.item", None, "from"),
        ("demo/shop.py", ".stock.shelf", None, "from"), ("web/view.ts", "./parts::One", None, "from"), ("web/view.ts", "./parts::Two", "T", "from"),
        ("web/view.ts", "./main::default", "Main", "from"), ("web/old.js", "./x::default", "X", "from"), ("cmd/main.go", "os", None, "import"),
        ("cmd/main.go", "os", "x", "import"), ("src/lib.rs", "std::fmt::Debug", None, "import"), ("src/lib.rs", "crate::kit::Tool", None, "import"),
        ("src/lib.rs", "crate::kit::Part", "P", "import"), ("app/Car.java", "java.util.Map", None, "import"), ("app/Car.java", "java.util.Objects.hash", None, "static"),
        ("lib/tool.rb", "set", None, "import"), ("lib/tool.rb", "./aid", None, "from"), ("c/run.c", "stdlib.h", None, "import"), ("c/run.c", "own.h", None, "import"),
        ("c/space.cpp", "map", None, "import"), ("net/Lamp.cs", "System.Text", None, "import"), ("www/page.php", "Site\\Kit\\Form", None, "import"),
        ("bin/do.sh", "./lib.sh", None, "import"),
    }


def test_references(facts):
    got = {(r["path"], r["kind"], r["qualifier"], r["in_symbol"]) for r in facts["references"]}
    assert got >= {
        ("demo/shop.py", "inherit", "Base", "Shop"), ("demo/shop.py", "call", "str", "Shop.open"), ("demo/shop.py", "call", "len", "run"),
        ("demo/shop.py", "call", "run", "<module>"), ("web/view.ts", "inherit", "Base", "Circle"), ("web/view.ts", "call", "render", "Circle.draw"),
        ("cmd/main.go", "call", "os.Exit", "main.Fill"), ("cmd/main.go", "call", "grow", "main.main"), ("app/Car.java", "inherit", "Vehicle", "org.demo.Car"),
        ("app/Car.java", "inherit", "Part", "org.demo.Car"), ("lib/tool.rb", "inherit", "Blade", "Kit.Saw"), ("c/run.c", "call", "twice", "main"),
        ("www/page.php", "inherit", "Base", "Site.Page"), ("bin/do.sh", "call", "echo", "build"),
    }


def test_literals_exports_and_metrics(facts):
    assert ("demo/shop.py", "url", "https://shop.example.com/v2/goods") in {(x["path"], x["kind"], x["value"]) for x in facts["literals"]}
    names = {(e["path"], e["name"]) for e in facts["exports"]}
    assert {("demo/shop.py", "Shop"), ("demo/shop.py", "run"), ("web/view.ts", "Circle"), ("web/view.ts", "LIMIT"), ("cmd/main.go", "Box"), ("src/lib.rs", "weld"), ("app/Car.java", "Car")} <= names
    assert ("cmd/main.go", "grow") not in names and ("src/lib.rs", "main") not in names
    by = {m["path"]: m for m in facts["metrics"]}
    assert (by["demo/shop.py"]["n_classes"], by["demo/shop.py"]["async_count"], by["demo/shop.py"]["generator_count"], by["demo/shop.py"]["test_count"]) == (1, 1, 1, 1)
    assert all(by[p]["has_main_guard"] for p in ("demo/shop.py", "cmd/main.go", "src/lib.rs", "c/run.c")) and not by["lib/tool.rb"]["has_main_guard"]
    assert by["cmd/main.go"]["test_count"] == 1 and by["src/lib.rs"]["test_count"] == 1


def test_comment_lines_and_nesting(spark):
    code = {
        "a.py": "# one\nx = 1  # two\n# three # still\nclass A:\n    class B:\n        def f(self):\n            def g():\n                pass\n",
        "b.c": "/* a\n b */ /* c */ int f() { return 1; } // d\n\n// e", "c.java": "// a\nclass A { }\n", "d.rs": "// a\nfn f() {}\n",
        "e.ts": "class A { m() { return 1; } }\n", "f.go": "package box\nfunc main() {}\n", "g.cs": "namespace A.B { class C { static void Main() {} } }\n",
        "h.cs": "class C { static void Main() {} }\n", "i.java": "class A { void test_x() {} }\n", "j.php": "<?php\nclass A { }\n", "k.yaml": "# a\na: 1\n",
    }
    files = spark.createDataFrame(list(code.items()), "path string, text string").withColumn("language", classify.language(F.col("path")))
    declared = symbols.declarations(files)
    found = symbols.symbols(declared)
    by = {r["path"]: r for r in symbols.metrics(declared, found).collect()}
    assert [by[p]["comment_lines"] for p in ("a.py", "b.c", "c.java", "d.rs", "k.yaml")] == [3, 3, 0, 0, 0]
    assert [by[p]["max_nest_depth"] for p in ("a.py", "b.c", "c.java", "e.ts")] == [4, 0, 0, 1]
    assert [by[p]["has_main_guard"] for p in ("f.go", "g.cs", "h.cs")] == [False, False, True]
    assert by["i.java"]["test_count"] == 0 and symbols.exports(declared, found).where("path = 'j.php'").isEmpty()


def test_tokens_join_to_the_text(spark):
    files = spark.createDataFrame([*SOURCES.items(), ("x.py", "'''open"), ("y.rs", "'a \"b"), ("z.go", "/* c")], "path string, text string")
    cut = symbols.tokens(files.withColumn("language", classify.language(F.col("path")))).collect()
    for path, text in [*SOURCES.items(), ("x.py", "'''open"), ("y.rs", "'a \"b"), ("z.go", "/* c")]:
        own = sorted((r["i"], r["token"], r["start"]) for r in cut if r["path"] == path)
        assert "".join(t for _, t, _ in own) == text
        assert all(len(text.encode()[:s].decode()) == len("".join(t for _, t, _ in own[:k])) for k, (_, _, s) in enumerate(own))


def test_broken_code_is_told(spark):
    files = spark.createDataFrame(list(SOURCES.items()), "path string, text string").withColumn("language", classify.language(F.col("path")))
    got = {r["path"]: r["parse_ok"] for r in symbols.parse_status(files).collect()}
    assert got.pop("demo/broken.py") is False and all(got.values())


def test_analysis_of_a_tree(spark, tmp_path):
    rows = [(p, bytearray(t.encode())) for p, t in SOURCES.items()] + [("x.unknown", bytearray(b"what")), ("c.yaml", bytearray(b"a: 1"))]
    facts = analysis.analyze(spark.createDataFrame(rows, "path string, content binary"), chunk_max_tokens=40)
    sums = {r["path"]: r for r in analysis.summaries(facts).collect()}
    assert len(sums) == len(rows) and sums["x.unknown"]["parse_reason"] == "no_parser" and not sums["x.unknown"]["parse_ok"]
    assert sums["c.yaml"]["is_config"] and sums["c.yaml"]["parse_ok"] and sums["cmd/main.go"]["has_main_guard"]
    assert {r["path"] for r in rollup.entry_points(analysis.summaries(facts)).collect()} >= {"cmd/main.go", "demo/shop.py"}
    texts, names = dict(SOURCES) | {"c.yaml": "a: 1"}, {}
    for r in facts.chunks.collect():
        raw, (start, end, line, last) = texts[r["path"]].encode(), r["span"]
        assert raw[start:end].decode() == r["text"] and r["text"].strip()
        assert (raw[:start].count(b"\n") + 1, raw[:end].count(b"\n") + 1) == (line, last)
        names.setdefault(r["path"], set()).add((r["qualified_name"], r["kind"]))
    assert set(names) == set(texts) and names["c.yaml"] == {("<module>", "module")}
    known = {(r["path"], r["qualified_name"], r["kind"]) for r in facts.symbols.collect()}
    assert all(x == ("<module>", "module") or (path, *x) in known for path, own in names.items() for x in own)
    files = {r["path"]: r for r in analysis.nested(facts).collect()}
    assert len(files["web/view.ts"]["symbols"]) == len(KINDS["web/view.ts"]) and files["x.unknown"]["symbols"] is None
    analysis.write(facts, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/files")).where("language = 'go'").count() == 1
    assert spark.read.json(str(tmp_path / "out/index")).count() == 12
    docs = {r["path"]: r["module_doc"] for r in facts.docs.collect()}
    assert (docs["demo/shop.py"], docs["cmd/main.go"], docs["src/lib.rs"], docs["web/old.js"]) == ("Shop tools.", "Package main starts.", "Crate notes.", "")
    known = {r["id"]: r["has_full_support"] for r in rollup.supported_languages(spark).collect()}
    assert known["python"] and known["tsx"] and not known["yaml"] and list(known) == sorted(known)


def test_chunks_keep_functions_whole(spark):
    code = "".join(f"def f{i}(a):\n    b = a + {i}\n    return b * 2\n\n" for i in range(20))
    facts = analysis.analyze(spark.createDataFrame([("m.py", code)], "path string, text string"), chunk_max_tokens=40)
    cut = facts.chunks.orderBy("chunk").collect()
    assert len(cut) > 3 and all(c["text"].startswith("def ") and c["text"].count("def ") == c["text"].count("return ") for c in cut)
    assert sum(c["text"].count("def ") for c in cut) == 20
    assert analysis.analyze(spark.createDataFrame([("m.py", code)], "path string, text string"), False).chunks.count() == 0


def test_chunks_go_down_as_far_as_they_must(spark):
    methods = "".join(f"        def m{i}(self):\n            return {i} + 1000\n\n" for i in range(30))
    code = f"import os\n\nclass A:\n    class B:\n{methods}\nx = 1\n"
    deep = "void f() " + "{ if (a) " * 25 + "{ go(); go(); }" + " }" * 25 + "\n"
    files = spark.createDataFrame([("m.py", code), ("d.c", deep), ("n.yaml", "a: 1\nb: 'two'\n"), ("k.unknown", "x")], "path string, text string")
    facts = analysis.analyze(files, chunk_max_tokens=40)
    cut = facts.chunks.where("path = 'm.py'").orderBy("chunk").collect()
    assert "".join(c["text"] for c in cut).count("def ") == 30 and all(c["token_estimate"] <= 60 for c in cut)
    names = [c["qualified_name"] for c in cut]
    assert names[0] == "<module>" and sum(n.startswith("A.B.m") for n in names) >= 8 and cut[0]["text"].startswith("import os")
    assert all(c["text"].count("def ") == c["text"].count("return ") for c in cut)
    assert facts.symbols.where("path = 'd.c'").select("qualified_name").collect()[0][0] == "f"
    assert {r["path"] for r in facts.chunks.select("path").distinct().collect()} == {"m.py", "d.c", "n.yaml"}
    assert facts.references.where("path = 'n.yaml'").count() == 0 and facts.symbols.where("path = 'n.yaml'").count() == 0


def test_the_next_end_is_found_in_deep_nests(spark):
    depth = 16
    code = "".join(" " * i + f"def f{i}():\n" for i in range(depth)) + " " * depth + "pass\n" + "y = 2\n"
    found = analysis.analyze(spark.createDataFrame([("n.py", code)], "path string, text string")).symbols.collect()
    names = {r["name"]: r for r in found}
    assert names[f"f{depth - 1}"]["qualified_name"] == ".".join(f"f{i}" for i in range(depth))
    assert all(names[f"f{i}"]["span"]["end_byte"] == len(code) - len("\ny = 2\n") for i in range(depth))


def test_module_docs_of_texts_with_quotes_equal_sql(spark, tmp_path):
    import duckdb

    from lodestone import catalog

    said = ['say "hi"', '"', 'a """ b', "it's '''", '"""', "'", "", None, 'two\nlines"  ']
    rows = [(5 * k + kind, text) for k, text in enumerate(said) for kind in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in catalog.module_docs(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.execute(catalog.oracle_sql()["module_docs"]).fetchall())


@pytest.mark.parametrize("name, mark, code", [("a.py", "# ", "X = 1\n"), ("a.go", "// ", "package p\n"), ("a.java", "// ", "class A { }\n"), ("a.sh", "# ", "X=1\n"), ("a.rb", "# ", "X = 1\n"), ("a.php", "// ", "class A { }\n")])
def test_lines_of_comment_are_one_token_and_no_statements(spark, name, mark, code):
    lines = 50_000
    text = f"{mark}note\n" * lines + "\n" * 100 + code + f"  {mark}inner\n{mark}last\n"
    files = spark.createDataFrame([(name, text)], "path string, text string").withColumn("language", classify.language(F.col("path")))
    assert symbols.tokens(files).count() < 200
    bare = symbols.tokens(files, comments=False).where("kind = 'comment'").agg(F.max(F.length("token")), F.max("breaks")).first()
    assert tuple(bare) == (0, lines - 1)
    declared = symbols.declarations(files, comments=False)
    assert declared.count() < 12
    found = symbols.symbols(declared).collect()
    assert [r["span"]["start_line"] for r in found] == [lines + 101]
    assert symbols.metrics(declared, symbols.symbols(declared)).first()["comment_lines"] == (0 if name == "a.java" else lines + 2)


def test_blank_statements_are_not_kept_and_neighbours_are(spark):
    code = {"a.go": "package p\n" + "\n" * 40 + "func Go() {\n\n\n}\n" * 10, "b.py": "class A:\n    @property\n    def go(self):\n        'Says go.'\n" + "\n" * 40, "c.py": "\n" * 30}
    files = spark.createDataFrame(list(code.items()), "path string, text string").withColumn("language", classify.language(F.col("path")))
    declared = symbols.declarations(files)
    rows = {r["path"]: r["n"] for r in declared.groupBy("path").agg(F.count("s").alias("n")).collect()}
    assert rows["a.go"] <= 22 and rows["b.py"] == 4 and rows["c.py"] == 1
    found = {r["qualified_name"]: r for r in symbols.symbols(declared).where("path = 'b.py'").collect()}
    assert (found["A.go"]["kind"], found["A.go"]["doc"]) == ("property", "Says go.")
    assert symbols.metrics(declared, symbols.symbols(declared)).count() == 3

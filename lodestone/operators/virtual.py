"""The test tables seen as a source tree: derived paths, contents, symbols and logs.

The derivations are SQL expressions that Spark and DuckDB read alike, so a query and its
SQL start from the same rows and differ in the operator only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import classify, text

FOLDERS = ("", "src/", "tests/", "dist/", "pkg/core/", "node_modules/", "docs/generated/")
NAMES = (
    "mod_#.py", "util_#.ts", "main_#.go", "lib_#.rs", "App#.java", "task_#.rb", "core_#.c", "core_#.cpp", "Svc#.cs",
    "page_#.php", "run_#.sh", "view_#.test.ts", "test_#.py", "svc_#/Dockerfile", "settings_#.yaml", "svc_#/latest", "notes_#.md",
    "data_#.xyz", "image_#.png", "script_#",
)


def _case(value: str, options: tuple[str, ...]) -> str:
    arms = " ".join(f"WHEN {i} THEN replace('{o}', '#', CAST(doc_id AS STRING))" for i, o in enumerate(options))
    return f"CASE {value} {arms} END"


PATH = f"coalesce(source, 'none') || '/' || {_case(f'doc_id % {len(FOLDERS)}', FOLDERS)} || {_case(f'doc_id % {len(NAMES)}', NAMES)}"
#: Scripts without an extension begin with one of these.
FIRST_LINE = "CASE doc_id % 3 WHEN 0 THEN '#!/usr/bin/env python3' WHEN 1 THEN '#!/bin/bash -e' ELSE 'plain' END"
CONTENT = "CASE WHEN doc_id % 11 = 0 THEN '// Code generated by tool. DO NOT EDIT.' ELSE '' END || text"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def files(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """``doc_id, path, size``, and the SQL expressions in ``more``."""
    return documents(spark, sf_dir).selectExpr("doc_id", f"{PATH} AS path", "n_chars AS size", *more)


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per file as an analysis summarises it."""
    base = documents(spark, sf_dir).selectExpr("doc_id", f"{PATH} AS path", f"{FIRST_LINE} AS first_line", f"{CONTENT} AS content")
    path, content = F.col("path"), F.col("content")
    lang = classify.language(path, F.col("first_line"))
    return base.select(
        "doc_id", "path", lang.alias("language"), text.n_bytes(content).cast("long").alias("bytes"), text.n_lines(content).alias("loc"),
        classify.is_test(path).alias("is_test"), classify.is_config(path).alias("is_config"),
        classify.is_generated(path, content).alias("is_generated"), (lang != "").alias("parse_ok"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.inventory import classify_files

    return classify_files(files(spark, sf_dir), ignore_lines=IGNORE, extra_globs=EXTRA, max_bytes=4000)


IGNORE = ("# comment", "*.md", "!notes_1*.md", "pkg/core/run_*.sh")
EXTRA = ("*.rb",)
SYMBOLS = (
    "p_name AS qualified_name",
    "CASE p_size % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'method' ELSE 'module' END AS kind",
    "replace(p_brand, '#', '_') || '/' || p_type AS file",
    "p_partkey AS symbol_id",
)


#: A source file per document: its whole text as comments, ahead of one class or package with as many functions as its id says.
_TIMES = "CAST(doc_id % 5 + 1 AS INT)"
SOURCE_PATH = "CASE doc_id % 3 WHEN 0 THEN 'd' || CAST(doc_id AS STRING) || '.py' WHEN 1 THEN 'd' || CAST(doc_id AS STRING) || '.go' ELSE 'D' || CAST(doc_id AS STRING) || '.java' END"
_SIGN = "CASE doc_id % 3 WHEN 0 THEN '# ' ELSE '// ' END"
_TEXT = f"{_SIGN} || replace(coalesce(text, ''), chr(10), chr(10) || {_SIGN}) || chr(10)"
SOURCE = f"""{_TEXT} || CASE doc_id % 3
  WHEN 0 THEN 'import os' || chr(10) || 'class D' || CAST(doc_id AS STRING) || '(Base):' || chr(10)
    || repeat('    def go(self):' || chr(10) || '        return use(1)' || chr(10), {_TIMES})
  WHEN 1 THEN 'package p' || CAST(doc_id AS STRING) || chr(10) || repeat('func Go() {{ use(1) }}' || chr(10), {_TIMES})
  ELSE 'package a.b;' || chr(10) || 'class D' || CAST(doc_id AS STRING) || ' extends Base {{' || chr(10)
    || repeat('  int go(int n) {{ return use(n); }} // use(' || chr(10), {_TIMES}) || '}}' || chr(10) END"""


#: A source per document in one of 13 languages: its text as comments, then declarations with the document's id for ``@``.
#: Extension, what a comment begins with, what stands before and after the text.
KINDS = (
    ("py", "# ", "", """import os
from a.b import c as d
__all__ = ["D@", "go"]
class D@(Base):
    def go(self):
        return use("https://h.example/@")
def test_go():
    yield use(1)
if __name__ == "__main__":
    test_go()
"""),
    ("ts", "// ", "", """import { One } from "./parts";
export class D@ extends Base {
    async go(n: number): Promise<string> { return use("https://h.example/@"); }
}
export function area(r: number): number { return use(r); }
"""),
    ("tsx", "// ", "", """import { Two as T } from "./parts";
export interface Shape { size: number }
export function area@(r: number): number { return use("https://h.example/@"); }
"""),
    ("js", "// ", "", """import X from "./parts";
export class D@ extends Base {
    go(n) { return use("https://h.example/@"); }
}
export function up() { return 1; }
"""),
    ("go", "// ", "", """package p@
import (
    "os"
)
type Box struct {
    W int
}
func (b *Box) Fill(n int) string {
    return use("https://h.example/@")
}
func TestFill() { use(1) }
"""),
    ("rs", "// ", "", """use std::fmt::Debug;
pub struct Rod { pub len: u32 }
impl Rod {
    pub fn cut(&self, n: u32) -> u32 { join("https://h.example/@") }
}
pub async fn weld@(a: u32) -> u32 { join(a) }
fn main() { join(1); }
"""),
    ("java", "// ", "", """package a.b;
import java.util.Map;
public class D@ extends Base {
    private int n = 4;
    public static int main(int k) { return use("https://h.example/@"); }
}
"""),
    ("rb", "# ", "", """require "set"
module Kit
  class D@ < Base
    def test_go(n)
      use("https://h.example/@")
    end
  end
end
"""),
    ("c", "// ", "", """#include <stdlib.h>
#define RATE 2
static int twice@(int n) { return n + n; }
int main(int n) { return puts("https://h.example/@"); }
"""),
    ("cpp", "// ", "", """#include <map>
namespace sp {
    int jump@(int x) { return use("https://h.example/@"); }
}
"""),
    ("cs", "// ", "", """using System.Text;
namespace Home {
    public class D@ {
        public int Watts { get; set; }
        public void Go() { Use("https://h.example/@"); }
    }
}
"""),
    ("php", "// ", "<?php\n", """namespace Site;
use Form;
class D@ extends Base {
    public function go(): string { return take("https://h.example/@"); }
}
function link_to(int $a): int { return $a + 1; }
"""),
    ("sh", "# ", "", """source ./lib.sh
TARGET="x"
build() {
    echo "https://h.example/@"
}
build all
"""),
)


def _by_kind(value) -> str:
    """SQL that gives each document ``value`` of its kind."""
    arms = " ".join(f"WHEN {i} THEN {value(kind)}" for i, kind in enumerate(KINDS))
    return f"CASE doc_id % {len(KINDS)} {arms} END"


def _literal(code: str) -> str:
    lines = ["'" + line.replace("'", "''") + "'" for line in code.split("\n")]
    return "replace(" + " || chr(10) || ".join(lines) + ", '@', CAST(doc_id AS STRING))"


KIND_PATH = "'k' || CAST(doc_id AS STRING) || " + _by_kind(lambda k: f"'.{k[0]}'")
KIND_SOURCE = _by_kind(lambda k: f"{_literal(k[2])} || '{k[1]}' || replace(coalesce(text, ''), chr(10), chr(10) || '{k[1]}') || chr(10) || {_literal(k[3])}")


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = documents(spark, sf_dir).selectExpr(f"{KIND_PATH} AS path", f"{KIND_SOURCE} AS text")
    return base.withColumn("language", classify.language(F.col("path")))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = documents(spark, sf_dir).selectExpr(f"{SOURCE_PATH} AS path", f"{SOURCE} AS text")
    return base.withColumn("language", classify.language(F.col("path")))


# Sources whose declarations come from the text itself: names from its lines, numbers and depths from their count. -----

_LINES = "split(coalesce(text, ''), chr(10))"
_WORD = "concat('x', regexp_extract(l, '[A-Za-z]+', 0), i)"


def _each(*arms: str, joint: str) -> str:
    """One of ``arms`` per line of the text, in turn, joined; ``x`` in an arm is the line's first word and number."""
    cases = " ".join(f"WHEN {k} THEN {arm.replace('{x}', _WORD)}" for k, arm in enumerate(arms))
    return f"array_join(transform({_LINES}, (l, i) -> CASE i % {len(arms)} {cases} END), {joint})"


#: Rust paths in braces three deep, Go lists in parentheses, several declarators, shell pipes.
LIST_PATH = "concat('q', doc_id, CASE doc_id % 4 WHEN 0 THEN '.rs' WHEN 1 THEN '.go' WHEN 2 THEN '.ts' ELSE '.sh' END)"
LIST_SOURCE = f"""CASE doc_id % 4
  WHEN 0 THEN concat('use top::{{', {_each("{x}", "concat({x}, '::{self, deep', i, '::{Last as L', i, ', *}}')", "concat({x}, ' as R', i)", joint="', '")}, '}};', chr(10), 'fn go() {{ }}', chr(10))
  WHEN 1 THEN concat('package p', chr(10), 'const (', chr(10),
    {_each("concat({x}, ' = ', i)", "concat({x}, 'A, ', {x}, 'B = f(1, 2), ', i)", "concat('// note', chr(10), {x}, 'C')", joint="chr(10)")}, chr(10), ')', chr(10), 'var (', chr(10),
    {_each("concat('X', i, ' = map[string]int{', chr(10), '\"a\": 1,', chr(10), '}')", "concat('low', i, ', Up', i, ' int')", "''", joint="chr(10)")}, chr(10), ')', chr(10), 'type (', chr(10),
    {_each("concat('T', i, ' struct {', chr(10), 'F', i, ' int', chr(10), '}')", "concat('I', i, ' interface {', chr(10), '}')", joint="chr(10)")}, chr(10), ')', chr(10))
  WHEN 2 THEN concat('export const ', {_each("concat({x}, ' = [', i, ', g(1, 2)]')", "concat({x}, ' = (n: number) => use(n, 1)')", joint="', '")}, ';', chr(10),
    'export default ', CASE doc_id % 8 WHEN 2 THEN 'class D' ELSE 'function D' END, doc_id, CASE doc_id % 8 WHEN 2 THEN '' ELSE '()' END, ' {{ }}', chr(10))
  ELSE concat('run() {{', chr(10), {_each("concat({x}, ' | ', {x}, 'b y && ', {x}, 'c')", "concat('V', i, '=$(', {x}, 'd z | ', {x}, 'e)', chr(10), 'if ', {x}, 'f -q; then ', {x}, 'g; fi')", joint="chr(10)")}, chr(10), '}}', chr(10)) END"""

#: A text's letters as brackets: opened and closed in mirror order, or as they come. Comments and strings hold others.
BRACKET_KINDS = KINDS[:12]
_LETTERS = "regexp_replace(lower(coalesce(text, '')), '[^aeiont]', '')"
_OPENED = f"translate(regexp_replace({_LETTERS}, '[^aei]', ''), 'aei', '([{{')"
BRACKET_PATH = "concat('b', doc_id, CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN '.{kind[0]}'" for k, kind in enumerate(BRACKET_KINDS)) + " END)"
_MARK = "CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN '{kind[1]}'" for k, kind in enumerate(BRACKET_KINDS)) + " END"
BRACKET_SOURCE = f"""concat(CASE doc_id % 12 WHEN 11 THEN concat('<?php', chr(10)) ELSE '' END, {_MARK}, '( [', chr(10), 'x = ', chr(34), '}} ((', chr(34), chr(10),
  CASE doc_id % 2 WHEN 0 THEN concat({_OPENED}, translate(reverse({_OPENED}), '([{{', ')]}}')) ELSE translate({_LETTERS}, 'aeiont', '()[]{{}}') END, chr(10))"""

#: Blocks as deep as the text's lines say, every third of which has no name; a class after them.
DEPTH = "1 + size(" + _LINES + ") % 40"
DEEP_PATH = "concat('n', doc_id, CASE doc_id % 2 WHEN 0 THEN '.java' ELSE '.py' END)"
_NESTED = f"transform(sequence(0, {DEPTH} - 1), i -> "
DEEP_SOURCE = f"""CASE doc_id % 2
  WHEN 0 THEN concat(array_join({_NESTED} CASE i % 3 WHEN 2 THEN 'static {{' ELSE concat('class C', i, ' {{') END), chr(10)), chr(10), 'int go(int n) {{ return use(n); }}', chr(10),
    repeat('}}', {DEPTH}), chr(10), 'class Tail {{ int last(int n) {{ return n; }} }}', chr(10))
  ELSE concat(array_join({_NESTED} concat(repeat(' ', i), CASE i % 3 WHEN 2 THEN 'if x:' ELSE concat('class C', i, ':') END)), chr(10)), chr(10), repeat(' ', {DEPTH}), 'def go(self): pass', chr(10),
    'class Tail:', chr(10), '        def last(self):', chr(10), '                pass', chr(10)) END"""

#: A function per line of the text, as long as the line says, and some only a comment apart.
CHUNK_PATH = "concat('h', doc_id, '.py')"
CHUNK_SOURCE = f"""concat({_each("concat('def f', i, '():', chr(10), '    return ', chr(34), repeat('x', length(l) % 60), chr(34))",
    "concat('def f', i, '():', chr(10), '    return ', chr(34), repeat('y', length(l) % 60), chr(34), chr(10), '# note')", joint="chr(10)")}, chr(10))"""

#: The text as the comment or string that a language takes for a file's documentation. A text may end in a quote, so the
#: closing ones stand on a line of their own, and they are the other kind where the text holds three of the first.
_QUOTE = "CASE WHEN contains(text, repeat(chr(34), 3)) THEN chr(39) ELSE chr(34) END"
DOC_PATH = "concat('m', doc_id, CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.ts' WHEN 3 THEN '.rs' ELSE '.java' END)"
DOC_SOURCE = f"""CASE doc_id % 5
  WHEN 0 THEN concat(repeat({_QUOTE}, 3), coalesce(text, ''), chr(10), repeat({_QUOTE}, 3), chr(10), 'x = 1', chr(10))
  WHEN 1 THEN concat({_each("concat('// ', l)", "concat('/* ', l, ' */')", joint="chr(10)")}, chr(10), 'package p', chr(10), '// after', chr(10))
  WHEN 2 THEN concat('/**', chr(10), {_each("concat(' * ', l)", "concat(' ** ', l)", joint="chr(10)")}, chr(10), ' */', chr(10), 'export const a = 1;', chr(10))
  WHEN 3 THEN concat({_each("concat('//! ', l)", "concat('// ', l)", "concat('/// ', l)", joint="chr(10)")}, chr(10), 'fn go() {{ }}', chr(10))
  ELSE concat('/* ', coalesce(text, ''), ' */', chr(10), 'class A {{ }}', chr(10)) END"""


def derived(spark: SparkSession, sf_dir: str, path: str, source: str) -> DataFrame:
    """``path, text, language`` of files whose path and source are SQL over a document."""
    base = documents(spark, sf_dir).selectExpr(f"{path} AS path", f"{source} AS text")
    return base.withColumn("language", classify.language(F.col("path")))

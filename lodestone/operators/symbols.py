"""Symbols, imports, references and string literals of source files, as Spark jobs over tokens.

A file's text is cut into tokens that join to the text again; windows over a file's tokens
give every token its byte and line, its nesting and the statement it belongs to. Statements
are rows; what they declare is a pattern per language (``rules``); what encloses them is the
last block opened on each outer level. There is no syntax tree: heads of declarations are
recognised, broken code around them does not matter, and error counts are brackets that do
not match. A file is a window partition, at most ``MAX_FILE_BYTES`` long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import literals as lit_fn
from lodestone.operators import brackets, lists, rules, scopes
from lodestone.plans.durable import durable


def _analysed() -> Column:
    """Whether a file's language has rules; of others only strings, chunks and parse status are taken."""
    return F.col("language").isin(*rules.FAMILY)


def _by_language(table: dict, value, default: Column) -> Column:
    out = None
    for language, entry in table.items():
        test = F.col("language") == language
        out = F.when(test, value(entry)) if out is None else out.when(test, value(entry))
    return out.otherwise(default)


def tokens(files: DataFrame, comments: bool = True) -> DataFrame:
    """``path, language, i, token, kind, breaks, start, end, line`` of ``files`` (``path, language, text``).

    Without ``comments`` their tokens stay, with their places and line breaks, and their texts do not.
    """
    cut = _by_language(
        rules.FAMILY, lambda f: F.regexp_extract_all(F.col("text"), F.lit(rules.TOKENS[f]), F.lit(0)),
        F.regexp_extract_all(F.col("text"), F.lit(rules.TOKENS["plain"]), F.lit(0)),
    )
    one = files.where("language <> ''").select("path", "language", F.posexplode(cut).alias("i", "token"))
    before = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    newlines = F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit("")))
    # What is asked of a token's text is asked before the tokens are dealt by file.
    comment = F.col("token").rlike(r"^(//|/\*|#)") & ~((F.col("language").isin("c", "cpp")) & F.startswith("token", F.lit("#"))) | (
        F.col("token").rlike("^#") & F.col("language").isin("python", "ruby", "bash", "php")
    )
    kind = (
        F.when((F.col("language") == "go") & F.col("token").rlike(rules.GO_GROUP), "group")
        .when(F.col("token").rlike(r"\A[{}();\n\[\]]\z"), "mark")
        .when(comment & ~F.col("token").rlike(r"^#!?\["), "comment")
        .when(F.col("token").rlike("\\A[\"'`]") & (F.length("token") > 1), "string")
        .otherwise("code")
    )
    told = one.select("path", "language", "i", "token", kind.alias("kind"), F.octet_length("token").alias("bytes"), newlines.alias("breaks"))
    if not comments:
        told = told.withColumn("token", F.when(F.col("kind") == "comment", "").otherwise(F.col("token")))
    start = F.coalesce(F.sum("bytes").over(before), F.lit(0)).cast("int")
    return told.select(
        "path", "language", "i", "token", "kind", "breaks", start.alias("start"), (start + F.col("bytes")).alias("end"),
        (F.coalesce(F.sum("breaks").over(before), F.lit(0)) + 1).cast("int").alias("line"),
    )


def statements(files: DataFrame, comments: bool = True) -> DataFrame:
    """``path, language, s, code, level, opens, closes, strings, comments`` and the span, a row per statement."""
    t = tokens(files, comments)
    order = Window.partitionBy("path").orderBy("i")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    mark = lambda *m: (F.col("kind") == "mark") & F.col("token").isin(*m)
    indented = F.col("language").isin(*rules.INDENTED)
    grouped = F.col("kind") == "group"
    paren = F.when(mark("(", "[") | grouped, 1).when(mark(")", "]"), -1).when(indented & mark("{"), 1).when(indented & mark("}"), -1).otherwise(0)
    brace = F.when(indented, 0).when(mark("{"), 1).when(mark("}"), -1).otherwise(0)
    # A line that can only begin a statement begins one, whatever bracket was left open.
    fresh = (F.col("language") == "python") & F.col("token").rlike(r"^(?:async\s+def|def|class|import|from|@)\b")
    t = t.withColumn("paren", paren).withColumn("fresh", fresh).select(
        "*", F.sum("paren").over(upto).alias("open"), F.coalesce(F.sum(brace).over(before), F.lit(0)).alias("depth"),
        (F.col("fresh") & F.coalesce(F.lag("token").over(order) == "\n", F.lit(False))).alias("anew"),
        ((F.col("token") == "\n") & F.coalesce(F.lead("fresh").over(order), F.lit(False))).alias("cut"),
    )
    # All windows are over a file in order, so its tokens are sorted once; what is open counts from the last line that began anew.
    t = t.withColumn("paren", F.col("open") - F.coalesce(F.last(F.when(F.col("anew"), F.col("open") - F.col("paren")), ignorenulls=True).over(upto), F.lit(0)))
    # A list in parentheses after const, var or type: its lines are statements, each of which means this word.
    group = F.when(grouped, F.regexp_extract("token", r"\w+", 0)).when(mark(")") & (F.col("paren") <= 0), "")
    t = t.withColumn("group", F.coalesce(F.last(group, ignorenulls=True).over(upto), F.lit("")))
    t = t.withColumn("ungroup", mark(")") & (F.col("group") == "") & (F.coalesce(F.lag("group").over(order), F.lit("")) != ""))
    directive = F.col("language").isin("c", "cpp") & (F.col("kind") == "code") & F.col("token").rlike(r"^\s*#") | (F.contains("token", F.lit("import")) | F.contains("token", F.lit("use"))) & F.col("token").rlike(
        r"\A[ \t]*(?:import\b[\s\S]*[\"'];?|(?:pub(?:\([^)]*\))?\s+)?use\s[\s\S]*;)\z"
    )
    ends = (
        mark(";") & ((F.col("paren") <= 0) | ~indented)
        | ~indented & mark("{", "}")
        | (F.col("language").isin(*rules.LINEWISE) | ~_analysed()) & mark("\n") & ((F.col("paren") <= F.when(F.col("group") != "", 1).otherwise(0)) | F.col("cut"))
        | grouped | F.col("ungroup")
        | F.col("own")
    )
    # A directive is a statement of its own, whatever stands before it.
    t = t.withColumn("own", directive).withColumn("ends", ends.cast("int"))
    piece = F.coalesce(F.sum("ends").over(before), F.lit(0)) + F.sum(F.col("own").cast("int")).over(upto)
    solid = (F.col("kind") != "comment") & F.col("token").rlike(r"\S")
    shown = F.col("solid") & ((F.col("ends") == 0) | F.col("own"))
    code = F.when(F.col("kind") == "comment", F.lit(" ")).when((F.col("ends") == 1) & ~F.col("own"), F.lit("")).otherwise(F.col("token"))
    piece_of = t.withColumn("s", piece.cast("int")).withColumn("solid", solid).withColumn("shown", shown)
    pieces = piece_of.groupBy("path", "language", "s").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("i"), code.alias("code")))), lambda x: x["code"]), "").alias("code"),
        F.max(F.when(F.col("shown"), F.col("group"))).alias("group"),
        F.min(F.when(F.col("shown"), F.struct("i", "start", "line", "depth"))).alias("head"),
        F.max(F.struct("i", "end", "line", "depth")).alias("tail"),
        F.max(F.when(F.col("solid"), F.struct("i", "start", "line", "token"))).alias("last"),
        F.max(F.when(mark("{"), 1).otherwise(0)).alias("opens"),
        F.max(F.when(mark("}"), 1).otherwise(0)).alias("closes"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "string", F.struct("i", "token", "start", "line")))).alias("strings"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "comment", F.struct("i", "token", "line", "breaks")))).alias("comments"),
    )
    solid_end = F.col("last.start") + F.octet_length(F.regexp_replace("last.token", r"\s+$", ""))
    pieces = pieces.withColumn("flat", F.trim(F.regexp_replace("code", r"\s+", " ")))
    flat = F.col("flat")
    depth = F.coalesce("head.depth", "tail.depth").cast("int")
    whole = F.when((F.col("group") != "") & (depth == 0) & (flat != ""), F.concat("group", F.lit(" "), flat)).otherwise(flat)
    return pieces.select(
        "path", "language", "s", whole.alias("code"),
        F.coalesce("head.start", "tail.end").alias("start"), F.coalesce("head.line", "tail.line").alias("line"),
        F.coalesce(solid_end, "tail.end").alias("end"), F.coalesce("last.line", "tail.line").alias("end_line"),
        F.length(F.regexp_extract("code", r"(?:^|\n)([ \t]*)\S", 1)).alias("lead"), depth.alias("depth"),
        "opens", "closes", "strings", "comments",
    )


def parse_status(files: DataFrame) -> DataFrame:
    """``path, parse_ok, error_nodes, missing_nodes``: brackets that do not match, and the closing ones that are missing.

    A file's brackets outside of comments and strings are reduced where the file is; nothing is
    shuffled. What ends a case of a shell's ``case`` is no bracket.
    """
    quiet = r"//|/\*|#(?!!?\[)|[\"'`]"

    def marks(family: str) -> Column:
        # One pass over the tokens; those that are no comment and no string are kept.
        token = rules.TOKENS[family]
        kept = F.regexp_replace("text", f"(?:(?!{quiet})({token})|(?:{token}))", "$1")
        return brackets.only_brackets(F.regexp_replace(kept, r"(?m)^[ \t]*[^\s()][^()\n]*\)", "") if family == "bash" else kept)

    state = brackets.reduce_text(_by_language(rules.FAMILY, marks, F.lit("")))
    counted = files.select("path", state.alias("state"))
    errors = brackets.unclosed(F.col("state")) + brackets.unopened(F.col("state"))
    return counted.select("path", (errors == 0).alias("parse_ok"), errors.alias("error_nodes"), brackets.unclosed(F.col("state")).alias("missing_nodes"))


def _declared() -> Column:
    """``struct<kind, name>`` by the first rule of the language that matches, else null."""

    def chain(entry) -> Column:
        out = None
        for pattern, kind in entry:
            what = F.struct(F.lit(kind).alias("kind"), F.regexp_extract("code", pattern, 1).alias("name"))
            out = F.when(F.col("code").rlike(pattern), what) if out is None else out.when(F.col("code").rlike(pattern), what)
        return out

    return F.when(F.col("code") != "", _by_language(rules.RULES, chain, F.lit(None).cast("struct<kind:string,name:string>")))


def declarations(files: DataFrame, comments: bool = True) -> DataFrame:
    """Statements with ``kind``, ``name``, ``scopes`` (what encloses them, outermost first) and their block's end.

    Only ``module_docs`` reads the texts of ``comments``.
    """
    indented, python = F.col("language").isin(*rules.INDENTED), F.col("language") == "python"
    order = Window.partitionBy("path").orderBy("s")
    package = F.last(F.when(F.col("d.kind") == "package", F.col("d.name")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    go_package = F.first(F.when((F.col("language") == "go") & (F.col("d.kind") == "module"), F.col("d.name")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    # What stands beside a statement is taken where its file's statements are made; only decorators and strings of Python are asked for.
    beside = statements(files, comments).withColumn("d", F.when(_analysed(), _declared())).select(
        "*", F.coalesce(go_package, package).alias("package"), F.when(python, F.lag("code", 1).over(order)).alias("code_before"),
        F.when(python, F.lead("code", 1).over(order)).alias("code_after"), F.when(python, F.lead("strings", 1).over(order)).alias("strings_after"),
    )
    marked = (F.col("code") != "") | (F.col("opens") == 1) | (F.col("closes") == 1)
    # Blank ones have done their part, but a file keeps its first.
    s = durable(beside.where(marked | (F.size("comments") > 0) | (F.size("strings") > 0) | (F.col("s") == 0)), "statements")
    nested = scopes.nest(s.where(marked).select(
        "path", "s", indented.alias("indented"), (F.col("code") != "").alias("shown"), "lead", "depth", (F.col("opens") == 1).alias("opens"), (F.col("closes") == 1).alias("closes"),
        F.startswith("code", F.lit("typedef")).alias("typedef"), "start", "line", "end", "end_line", F.col("d.kind").alias("kind"), F.col("d.name").alias("name"),
    )).withColumnRenamed("path", "p").withColumnRenamed("s", "q")
    named = s.join(nested, (F.col("path") == F.col("p")) & (F.col("s") == F.col("q")), "left").withColumn("level", F.coalesce("level", F.lit(0))).withColumn(
        "scopes", F.coalesce("scopes", F.array().cast(nested.schema["scopes"].dataType))
    )
    return named.select(
        "path", "language", "s", "code", "level", "start", "line", "strings", "comments", "package", "code_before", "code_after", "strings_after", "after_typedef",
        F.col("d.kind").alias("raw_kind"), F.col("d.name").alias("name"), "scopes", "opens",
        F.coalesce("block_end", "end").alias("end"), F.greatest("line", F.coalesce("block_line", "end_line")).alias("end_line"),
    )


def _span() -> Column:
    return F.struct(F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), F.col("line").alias("start_line"), F.col("end_line"))


def _segments(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"::|\\|->", "."), r"^\.+|\.+$", "")


_SCRIPTED = ("typescript", "tsx", "javascript")


def _each_name(declared: DataFrame) -> DataFrame:
    """``declared`` with a row for every name that a statement declares: ``const a = 1, b = 2`` has two, ``var A, B int`` in Go too."""
    word = F.regexp_extract("code", r"^((?:export\s+)?(?:const|let|var))\s", 1)
    one = lambda kind, name, code: F.struct(kind.alias("raw_kind"), name.alias("name"), code.alias("code"))
    own = F.array(one(F.col("raw_kind"), F.col("name"), F.col("code")))
    named = r"^([\w$]+)\s*!?\s*(?:[:=]|$)"
    parts = F.filter(F.slice(lists.split_outside(F.regexp_replace("code", r"^(?:export\s+)?(?:const|let|var)\s+", "")), 2, 1_000_000), lambda p: p.rlike(named))
    called = lambda p: F.when(p.rlike(rules.CALLABLE), "function").otherwise("constant")
    scripted = F.col("language").isin(*_SCRIPTED) & (word != "") & F.contains("code", F.lit(",")) & F.col("raw_kind").isin("constant", "function")
    listed = F.split(F.regexp_extract("code", r"^(?:const|var)\s+(\w+(?:\s*,\s*\w+)+)", 1), r"\s*,\s*")
    more = F.filter(listed, lambda n: (n != "") & (n != F.col("name")) & (n != "_") & (~F.startswith("code", F.lit("var")) | n.rlike("^[A-Z]")))
    extra = F.when(scripted, F.transform(parts, lambda p: one(called(p), F.regexp_extract(p, named, 1), F.concat(word, F.lit(" "), p)))).when(
        (F.col("language") == "go") & (F.col("raw_kind") == "constant"), F.transform(more, lambda n: one(F.lit("constant"), n, F.col("code")))
    )
    rows = declared.withColumn("each", F.explode(F.concat(own, F.coalesce(extra, F.array().cast("array<struct<raw_kind:string,name:string,code:string>>")))))
    return rows.select(*[F.col(f"each.{c}").alias(c) if c in ("raw_kind", "name", "code") else F.col(c) for c in declared.columns])


def symbols(declared: DataFrame) -> DataFrame:
    """``path, language`` and a symbol's columns, from ``declarations``."""
    declared = _each_name(declared.where("raw_kind is not null and name <> ''"))
    inside = F.get("scopes", F.size("scopes") - 1)
    parent_kind = inside["kind"]
    direct = (F.size("scopes") == 0) & (F.col("language").isin(*rules.INDENTED) | (F.col("level") == 0))
    kind = (
        F.when((F.col("raw_kind") == "function") & parent_kind.isin("class", "interface", "impl", "enum") & (F.col("name") == F.lit("new")) & (F.col("language") == "rust"), "constructor")
        .when((F.col("raw_kind").isin("function", "method")) & F.col("name").isin("__init__", "__construct", "initialize"), "constructor")
        .when((F.col("raw_kind") == "function") & (F.col("language") == "python") & F.startswith("code_before", F.lit("@property")), "property")
        .when((F.col("raw_kind") == "function") & parent_kind.isin("class", "interface", "impl", "enum"), "method")
        .when((F.col("raw_kind") == "constant") & (parent_kind == "class") & F.col("language").isin("python"), "field")
        .when(F.col("raw_kind") == "typedef_name", "type_alias")
        .otherwise(F.col("raw_kind"))
    )
    receiver = F.when((F.col("language") == "go") & (F.col("raw_kind") == "method"), F.regexp_extract("code", r"^func\s+\(\s*\w*\s*\*?\s*(\w+)", 1))
    prefix = F.when((F.col("raw_kind") == "module") & (F.col("language") == "go") | (F.col("raw_kind") == "package"), F.lit(None)).otherwise(_segments(F.col("package")))
    owners = F.transform("scopes", lambda x: _segments(x["name"]))
    parent = F.array_join(F.array_compact(F.concat(F.array(prefix), owners, F.array(receiver))), ".")
    own = _segments(F.col("name"))
    # Fields and constants count in the file or right inside of a container, members only in one.
    in_container = parent_kind.isin(*rules.CONTAINERS)
    keeps = (
        F.when(F.col("raw_kind") == "impl", False)
        .when(F.col("raw_kind") == "package", False)
        .when((F.col("raw_kind") == "field") & (F.col("language") == "python"), parent_kind == "class")
        .when(F.col("raw_kind") == "typedef_name", F.col("after_typedef"))
        .when(F.col("raw_kind") == "field", parent_kind == "class")
        .when(F.col("raw_kind") == "property", parent_kind.isin("class", "interface"))
        .when(F.col("raw_kind").isin("constructor"), in_container)
        .when((F.col("raw_kind") == "method") & F.col("language").isin("typescript", "tsx", "javascript", "java", "csharp"), in_container)
        .when(F.col("raw_kind").isin(*rules.DIRECT), direct | in_container)
        .otherwise(True)
    )
    words = ["async", "static", "abstract", "public", "private", "protected", "final", "readonly", "override", "unsafe", "const", "pub", "export"]
    modifiers = F.array_compact(F.array(
        *[F.when(F.contains("code", F.lit(w)) & F.col("code").rlike(rf"^(?:#\[[^\]]*\]\s*)*(?:[\w()]+\s+)*?{w}\b(?!\s*\()") & F.col("code").rlike(rf"^[^(={{]*\b{w}\b"), F.lit(w)) for w in words],
        F.when(F.col("code").rlike(r"^#\[[^\]]*test"), F.lit("test")),
        F.when((F.col("language") == "python") & F.startswith("code_before", F.lit("@")), F.regexp_extract("code_before", r"^@([\w.]+)", 1)),
    ))
    doc = F.when(
        (F.col("language") == "python") & F.col("code_after").rlike("^[\"']"),
        F.trim(F.regexp_replace(F.get("strings_after", F.lit(0))["token"], "^(\"\"\"|'''|[\"'])|(\"\"\"|'''|[\"'])$", "")),
    ).otherwise(F.lit(""))
    found = declared.where(F.coalesce(keeps, F.lit(False)))
    return found.select(
        "path", "language", kind.alias("kind"), F.element_at(F.split(own, r"\."), -1).alias("name"),
        F.when(parent == "", own).otherwise(F.concat(parent, F.lit("."), own)).alias("qualified_name"),
        F.regexp_replace(F.when(F.col("language") == "go", F.regexp_replace("code", r"^(?:const|var)\s+", "")).otherwise(F.col("code")), r"\s*:$", "").alias("signature"), _span().alias("span"), doc.alias("doc"), modifiers.alias("modifiers"), parent.alias("parent_qname"),
    )


def imports(declared: DataFrame) -> DataFrame:
    """``path, language, module, alias, kind, span``."""
    code = F.col("code")
    entry = lambda module, alias, kind: F.struct(module.alias("module"), alias.alias("alias"), kind.alias("kind"))
    none = F.lit(None).cast("string")
    alias_of = lambda x: F.nullif(F.regexp_extract(x, r"\bas\s+(\w+)", 1), F.lit(""))
    name_of = lambda x: F.trim(F.regexp_replace(x, r"\bas\s+\w+|[(){};]|\btype\s", ""))

    def listed(names: Column, prefix: Column, joint: str, kind: str) -> Column:
        parts = F.filter(F.split(names, ","), lambda x: name_of(x) != "")
        return F.transform(parts, lambda x: entry(F.concat(prefix, F.lit(joint), name_of(x)), alias_of(x), F.lit(kind)))

    source = F.regexp_extract(code, "[\"']([^\"']*)[\"']", 1)
    braces = F.regexp_extract(code, r"\{([^}]*)\}", 1)
    # A leaf that is only ``self`` names no item of its own, and a star none at all.
    leaves = F.when(F.col("language") == "rust", lists.expand_tree(F.regexp_extract(code, r"use\s+([^;]*)", 1)))
    from_part = F.regexp_extract(code, r"^from\s+(\S+)\s+import\b", 1)
    from_joint = F.when(F.endswith(from_part, F.lit(".")), from_part).otherwise(F.concat(from_part, F.lit(".")))
    star = F.regexp_extract(code, r"^import\s+(?:type\s+)?([\w$]+)", 1)
    found = (
        F.when((F.col("language") == "python") & code.rlike(r"^import\s"), F.transform(
            F.split(F.regexp_replace(code, r"^import\s+", ""), ","), lambda x: entry(name_of(x), alias_of(x), F.lit("import"))))
        .when((F.col("language") == "python") & code.rlike(r"^from\s+\S+\s+import\b"), listed(F.regexp_replace(code, r"^from\s+\S+\s+import\s*", ""), from_joint, "", "from"))
        .when(F.col("language").isin("typescript", "tsx", "javascript") & code.rlike("^import\\b"), F.concat(
            F.when(code.rlike("^import\\s*[\"']"), F.array(entry(source, none, F.lit("side_effect")))).otherwise(F.array().cast("array<struct<module:string,alias:string,kind:string>>")),
            F.when((star != "") & (star != "from"), F.array(entry(F.concat(source, F.lit("::default")), star, F.lit("from")))).otherwise(F.array().cast("array<struct<module:string,alias:string,kind:string>>")),
            F.when(code.rlike(r"\*\s+as\s+"), F.array(entry(source, F.regexp_extract(code, r"\*\s+as\s+(\w+)", 1), F.lit("import")))).otherwise(F.array().cast("array<struct<module:string,alias:string,kind:string>>")),
            listed(braces, source, "::", "from")))
        .when((F.col("language") == "rust") & code.rlike(r"^(?:pub(?:\([^)]*\))?\s+)?use\s"), F.transform(
            F.filter(leaves, lambda x: (F.contains(x, F.lit(" as ")) | ~x.rlike(r"(?:^|::)(?:self|super|crate)$")) & ~F.contains(x, F.lit("*"))),
            lambda x: entry(name_of(x), alias_of(x), F.lit("import"))))
        .when((F.col("language") == "php") & code.rlike(r"^(?:<\?php\s*)?use\s"), F.array(
            entry(name_of(F.regexp_replace(code, r"^(?:<\?php\s*)?use\s+(?:function\s+|const\s+)?", "")), alias_of(code), F.lit("import"))))
        .when((F.col("language") == "go") & code.rlike(r"^import\b"), F.transform(
            F.regexp_extract_all(code, F.lit(r"(?:(?:\w+|\.)\s+)?\"[^\"]+\""), F.lit(0)),
            lambda x: entry(F.regexp_extract(x, "\"([^\"]+)\"", 1), F.nullif(F.nullif(F.regexp_extract(x, r"^(\w+|\.)\s", 1), F.lit("")), F.lit("import")), F.lit("import"))))
        .otherwise(_by_language({k: v for k, v in rules.IMPORTS.items() if k != "go"}, _simple_imports, F.lit(None).cast("array<struct<module:string,alias:string,kind:string>>")))
    )
    return declared.select("path", "language", F.explode(found).alias("m"), _span().alias("span")).select("path", "language", "m.module", "m.alias", "m.kind", "span").where("module <> ''")


def _simple_imports(entry) -> Column:
    out = None
    for pattern, kind in entry:
        what = F.array(F.struct(F.regexp_extract("code", pattern, 1).alias("module"), F.lit(None).cast("string").alias("alias"), F.lit(kind).alias("kind")))
        out = F.when(F.col("code").rlike(pattern), what) if out is None else out.when(F.col("code").rlike(pattern), what)
    return out


def references(declared: DataFrame) -> DataFrame:
    """``path, language, name, qualifier, kind, in_symbol, line``: calls, and what classes inherit."""
    code = F.regexp_replace(F.col("code"), "\"(?:\\\\.|[^\"\\\\])*\"|'(?:\\\\.|[^'\\\\])*'", "\"\"")
    heads = F.col("raw_kind").isin("function", "method", "constructor", "class")
    calls = F.transform(
        F.regexp_extract_all(code, F.lit(r"([A-Za-z_$][\w$]*(?:(?:\.|::|->|\\)[A-Za-z_$][\w$]*)*)!?\s*\("), F.lit(1)), lambda x: F.trim(x)
    )
    calls = F.filter(calls, lambda x: ~x.isin(*rules.NO_CALLS))
    own = F.when(heads & (F.col("name") != ""), F.filter(calls, lambda x: (x != F.col("name")) & (x != F.concat(F.lit("self."), F.col("name"))))).otherwise(calls)
    command = F.when((F.col("language") == "bash") & (F.col("raw_kind").isNull() | (F.col("raw_kind") == "constant")), F.filter(
        lists.commands(F.col("code"), rules.SHELL_AHEAD), lambda x: ~x.isin(*rules.SHELL_DECLARES)))
    called = F.filter(F.coalesce(command, own), lambda x: ~x.isin("fi", "done", "then", "do", "else", "esac", *rules.NO_CALLS))
    bases = F.when(
        F.col("raw_kind") == "class",
        F.when(F.col("language") == "python", F.regexp_extract("code", r"^class\s+\w+\s*\(([^)]*)\)", 1))
        .when(F.col("language") == "ruby", F.regexp_extract("code", r"^class\s+[\w:]+\s*<\s*([\w:]+)", 1))
        .when(F.col("language").isin("java", "php", "typescript", "tsx", "javascript"), F.concat_ws(
            ",", F.nullif(F.regexp_extract("code", r"\bextends\s+([\w.$\\]+)", 1), F.lit("")), F.nullif(F.regexp_extract("code", r"\bimplements\s+([\w.$\\, ]+)", 1), F.lit(""))))
        .otherwise(F.lit("")),
    ).otherwise(F.lit(""))
    inherited = F.filter(F.transform(F.split(bases, ","), lambda x: F.trim(x)), lambda x: (x != "") & ~F.contains(x, F.lit("=")))
    owners = F.transform("scopes", lambda x: _segments(x["name"]))
    chain = F.array_compact(F.concat(F.array(_segments(F.col("package"))), owners, F.array(F.when(heads, _segments(F.col("name"))))))
    owner = F.when(F.size(F.concat(owners, F.array_compact(F.array(F.when(heads, F.col("name")))))) == 0, F.lit("<module>")).otherwise(F.array_join(chain, "."))
    tag = lambda kind: lambda x: F.named_struct(F.lit("kind"), F.lit(kind), F.lit("q"), x)
    both = F.concat(F.transform(called, tag("call")), F.transform(inherited, tag("inherit")))
    skip = F.coalesce(F.col("raw_kind").isin("package", "module"), F.lit(False)) | F.col("code").rlike(r"^(?:import|from|use|using)\s|^#\s*(?:include|define)\b")
    return declared.where(_analysed() & ~skip).select("path", "language", F.explode(both).alias("r"), owner.alias("in_symbol"), "line").select(
        "path", "language", F.element_at(F.split(_segments(F.col("r.q")), r"\."), -1).alias("name"), F.col("r.q").alias("qualifier"), "r.kind", "in_symbol", "line"
    )


def string_literals(declared: DataFrame) -> DataFrame:
    """``path, kind, value, start_byte, line`` of what is of interest inside string literals."""
    one = declared.select("path", "code", F.explode("strings").alias("s")).where("s is not null")
    value = F.regexp_replace("s.token", "^(\"\"\"|'''|[\"'`])|(\"\"\"|'''|[\"'`])$", "")
    context = F.expr("substring_index(code, s.token, 1)")
    return one.select("path", F.explode(lit_fn.literals(value, context)).alias("l"), F.col("s.start").alias("start_byte"), F.col("s.line").alias("line")).select(
        "path", "l.kind", "l.value", "start_byte", "line"
    )


def exports(declared: DataFrame, found: DataFrame) -> DataFrame:
    """``path, name, qualified_name``: what a file hands out, by the habits of its language."""
    listed = declared.where(F.col("language").isin("python") & F.col("code").rlike(r"^__all__\s*\+?=")).select(
        "path", F.explode(F.regexp_extract_all("code", F.lit("[\"']([^\"']+)[\"']"), F.lit(1))).alias("name")
    ).select("path", "name", F.col("name").alias("qualified_name"))
    code = F.col("signature")
    public = (
        F.when(F.col("language").isin("typescript", "tsx", "javascript"), code.rlike(r"^export\b"))
        .when(F.col("language") == "go", F.col("name").rlike("^[A-Z]") & ~F.col("kind").isin("method", "field"))
        .when(F.col("language") == "rust", F.array_contains("modifiers", "pub") & ~F.col("kind").isin("field", "module", "macro"))
        .when(F.col("language").isin("java", "csharp"), F.col("kind").isin("class", "interface", "enum") & code.rlike(r"\bpublic\b"))
        .otherwise(False)
    )
    default = declared.where(F.col("language").isin(*_SCRIPTED) & (F.col("level") == 0) & F.col("code").rlike(r"^export\s+default\s+(?:async\s+)?(?:function|class)\b"))
    listed = listed.unionByName(default.select("path", F.lit("default").alias("name"), F.lit("default").alias("qualified_name")))
    return listed.unionByName(found.where(public).select("path", "name", "qualified_name"))


def metrics(declared: DataFrame, found: DataFrame) -> DataFrame:
    """Counts per file: functions, classes, nesting, async, generators, tests, main guards, lines of comments.

    Nesting is that of functions and classes in Python, and 1 for a file with a class in
    TypeScript and JavaScript; no other language has one. Comments of Java and Rust count as none.
    """
    scripted = F.col("language").isin("python", "typescript", "tsx", "javascript")
    calls = F.col("kind").isin("function", "method", "constructor") | scripted & (F.col("kind") == "property")
    outermost = F.col("parent_qname") == F.when(F.col("language") == "go", "main").otherwise("")
    per = found.groupBy("path").agg(
        F.count_if(calls).alias("n_functions"), F.count_if(F.col("kind") == "class").alias("n_classes"),
        F.max(
            F.when((F.col("language") == "python") & (calls | (F.col("kind") == "class")), F.size(F.split("qualified_name", r"\.")))
            .when(F.col("language").isin("typescript", "tsx", "javascript") & (F.col("kind") == "class"), 1).otherwise(0)
        ).alias("max_nest_depth"),
        F.count_if(calls & (scripted | F.col("language").isin("rust", "csharp")) & F.array_contains("modifiers", "async")).alias("async_count"),
        F.count_if(calls & (
            F.when(F.col("language") == "go", F.col("name").rlike("^Test[A-Z]") & (F.col("kind") == "function"))
            .when(F.col("language") == "rust", F.array_contains("modifiers", "test"))
            .when(F.col("language") == "python", F.col("name").rlike("^(test_|setUp$|tearDown$)"))
            .otherwise((F.col("language") == "ruby") & F.startswith("name", F.lit("test_")))
        )).alias("test_count"),
        F.max(F.col("language").isin("go", "rust", "c", "cpp") & (F.col("name") == "main") & (F.col("kind") == "function") & outermost
              | (F.col("language") == "java") & (F.col("name") == "main") & F.array_contains("modifiers", "static")
              | (F.col("language") == "csharp") & (F.col("name") == "Main") & F.array_contains("modifiers", "static") & ~F.contains("parent_qname", F.lit("."))).alias("main"),
    )
    covered = F.flatten(F.transform(F.array_compact("comments"), lambda c: F.sequence(c["line"], c["line"] + c["breaks"])))
    guard = declared.groupBy("path").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(_analysed() & ~F.col("language").isin("java", "rust"), covered))))).alias("comment_lines"),
        F.max((F.col("language") == "python") & F.col("code").rlike("^if __name__ == [\"']__main__[\"']")).alias("guard"),
        F.count_distinct(F.when((F.col("language") == "python") & F.col("code").rlike(r"\byield\b"), F.get("scopes", F.size("scopes") - 1)["s"])).alias("generator_count"),
    )
    return guard.join(per, "path", "left").select(
        "path", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_functions", "n_classes", "max_nest_depth", "async_count", "generator_count", "test_count")],
        (F.col("guard") | F.coalesce("main", F.lit(False))).alias("has_main_guard"), "comment_lines",
    )


def module_docs(declared: DataFrame) -> DataFrame:
    """``path, module_doc``: what a language takes for a file's documentation.

    A Python file's first string; in Go the comments before the first code, in Rust those of
    documentation among them; in TypeScript and JavaScript a block comment that comes first.
    Other languages have none.
    """
    some = declared.where(_analysed() & (F.col("code") != "")).groupBy("path").agg(F.min("s").alias("first"), F.min_by("code", "s").alias("head"), F.min_by("strings", "s").alias("quoted"))
    told = (
        declared.where(F.col("language").isin("go", "rust", *_SCRIPTED)).join(some.select("path", "first"), "path").where(F.col("s") <= F.col("first"))
        .groupBy("path").agg(F.max("language").alias("language"), F.sort_array(F.flatten(F.collect_list(F.array_compact("comments")))).alias("comments"))
    )
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    inner = lambda x: bare(F.regexp_replace(x, r"^/\*\*?|\*/$", ""))
    block = lambda x: F.startswith(x, F.lit("/*"))
    tokens_of = F.transform("comments", lambda c: c["token"])
    # Lines of comment behind one another are one token.
    each = F.flatten(F.transform(tokens_of, lambda c: F.when(block(c), F.array(c)).otherwise(F.split(c, "\n"))))
    lines = F.when(F.col("language") == "go", F.transform(each, lambda c: F.when(block(c), inner(c)).otherwise(bare(F.substring(c, 3, 1_000_000_000))))).when(
        F.col("language") == "rust", F.transform(F.filter(each, lambda c: block(c) | c.rlike(r"^//[/!]")), lambda c: F.when(block(c), inner(c)).otherwise(bare(F.substring(c, 4, 1_000_000_000))))
    ).otherwise(F.when(block(F.get(tokens_of, F.lit(0))), F.transform(F.split(inner(F.get(tokens_of, F.lit(0))), "\n"), lambda c: bare(F.regexp_replace(c, r"^\s*\*+", "")))))
    quoted = bare(F.regexp_replace(F.get("quoted", F.lit(0))["token"], "^(\"\"\"|'''|[\"'])|(\"\"\"|'''|[\"'])$", ""))
    doc = F.when(F.col("head").rlike("^(\"|')") & F.col("language").isNull(), quoted).otherwise(bare(F.array_join(lines, "\n")))
    return some.join(told, "path", "left").select("path", F.coalesce(doc, F.lit("")).alias("module_doc"))

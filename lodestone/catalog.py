"""The registered queries over code facts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import classify, gitignore, literals, text
from lodestone.functions.gitignore import glob_regex, rule
from lodestone.operators import analysis, chunking, enclosing, inventory, packing, read, rollup, symbols, virtual
from lodestone.plans.durable import durable
from lodestone.streaming import log, versions

_UNITS = "\n"
_CHUNK_TOKENS = 120


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lang_rollup(spark, d):
    return rollup.languages(virtual.summaries(spark, d))


def lang_by_count(spark, d):
    return rollup.languages_by_count(virtual.summaries(spark, d))


def manifest_scalars(spark, d):
    return rollup.manifest(virtual.summaries(spark, d))


def skipped_by_reason(spark, d):
    return rollup.skipped_by_reason(virtual.entries(spark, d))


def classify_flags(spark, d):
    path = F.col("path")
    return virtual.files(spark, d, f"{virtual.CONTENT} AS content").select(
        "doc_id", classify.is_test(path).alias("is_test"), classify.is_config(path).alias("is_config"),
        classify.is_generated(path, F.col("content")).alias("is_generated"), classify.in_skipped_folder(path).alias("in_skipped_folder"),
    )


def detect_language(spark, d):
    return virtual.files(spark, d, f"{virtual.FIRST_LINE} AS first_line").select(
        "doc_id", classify.language(F.col("path"), F.col("first_line")).alias("language")
    )


def file_metrics(spark, d):
    t, loc, blank = F.col("text"), F.col("measured.loc"), F.col("measured.blank")
    return virtual.documents(spark, d).withColumn("measured", text.measured(F.col("text"))).select(
        "doc_id", text.n_bytes(t).cast("long").alias("bytes"), loc.cast("long").alias("loc"), blank.cast("long").alias("blank"),
        (loc - blank).cast("long").alias("sloc"), text.tokens(t).cast("long").alias("token_estimate"), text.digest(t).alias("sha256"),
    )


def tree_view(spark, d):
    return read.tree(virtual.entries(spark, d), "/src1", True)[0].select("path", "size", "analyzed", "skip_reason")


def tree_totals(spark, d):
    return read.tree(virtual.entries(spark, d), "/src1", True)[1]


def glob_filter(spark, d):
    return read.list_files(virtual.files(spark, d), "src[1-4]*/*.py")


def _urls(spark, d):
    return _read(spark, d, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("value"))


def url_literals(spark, d):
    value = F.concat(F.lit("see <"), F.col("value"), F.lit(">, or ("), F.col("value"), F.lit(".);"))
    return _urls(spark, d).select("page_id", F.explode(literals.urls(value)).alias("url"))


def route_literals(spark, d):
    tail = F.regexp_replace("value", "^https?://[^/]+", "")
    return _urls(spark, d).select("page_id", literals.route(tail).alias("route")).where("route is not null")


def path_literals(spark, d):
    value = F.concat(F.lit("open ~"), F.regexp_replace("value", "^https?://[^/]+", ""), F.lit(" from "), F.col("value"), F.lit(" or ./a"), F.col("page_id").cast("string"), F.lit("/b.txt"))
    return _urls(spark, d).select("page_id", F.explode(literals.paths(value)).alias("path"))


_STATEMENT = "CASE event_id % 4 WHEN 0 THEN '  select *  from ' || event_type WHEN 1 THEN 'With love from ' || event_type WHEN 2 THEN 'DROP TABLE ' || event_type ELSE 'see ' || event_type END"
_ENV = "'APP_' || upper(event_type) || ' or DB_' || CAST(user_id % 5 AS STRING) || ' x_Y'"
_CONTEXT = "CASE event_id % 3 WHEN 0 THEN 'os.GetEnv(' WHEN 1 THEN 'value = process.env[' ELSE 'print(' END"


def sql_literals(spark, d):
    found = _read(spark, d, "events").selectExpr("event_id", f"{_STATEMENT} AS value")
    return found.select("event_id", literals.sql(F.col("value")).alias("statement")).where("statement is not null")


def env_literals(spark, d):
    found = _read(spark, d, "events").selectExpr("event_id", f"{_ENV} AS value", f"{_CONTEXT} AS context")
    return found.select("event_id", F.explode(literals.env_names(F.col("value"), F.col("context"))).alias("name"))


_SYMBOL_SPANS = ("l_orderkey", "l_linenumber AS symbol_id", "(l_linenumber * 37) % 200 AS start", "(l_linenumber * 37) % 200 + CAST(l_quantity AS INT) * 4 AS end")


def enclosing_symbol(spark, d):
    lines = _read(spark, d, "lineitem")
    points = lines.selectExpr("l_orderkey", "l_linenumber AS point_id", "CAST(l_partkey % 250 AS INT) AS pos")
    return enclosing.enclosing_symbol(points, lines.selectExpr(*_SYMBOL_SPANS), "l_orderkey")


def unfetched_entries(spark, d):
    head = virtual.files(spark, d)
    seen = head.join(_read(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    sizes = head.where("doc_id % 3 <> 0").select("path", "size")
    return inventory.unfetched(seen, head, sizes)


def fetch_failures(spark, d):
    batch = virtual.files(spark, d).select("path", "size", "doc_id")
    fetched = batch.join(_read(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("path")
    return inventory.batch_outcome(batch, fetched)[1]


def planned_bytes(spark, d):
    return inventory.planned_bytes(virtual.files(spark, d), 4000)


def _symbols(spark, d):
    return _read(spark, d, "part").selectExpr(*virtual.SYMBOLS)


def symbols_filtered(spark, d):
    return read.symbols(_symbols(spark, d), "", "method", "Brand_1")


def top_level_symbols(spark, d):
    dotted = _symbols(spark, d).withColumn("qualified_name", F.when(F.col("symbol_id") % 3 == 0, F.concat("qualified_name", F.lit(".m"))).otherwise(F.col("qualified_name")))
    return rollup.top_level(dotted)


def symbols_sorted_top(spark, d):
    return _symbols(spark, d).orderBy("qualified_name", "file", "symbol_id").limit(50)


def artifact_index(spark, d):
    sized = virtual.files(spark, d).select("path", (F.col("size") * 2).alias("size_bytes"))
    rollups = sized.agg(F.sum("size_bytes").alias("s")).select(F.explode(F.array(
        F.struct(F.lit("tree.json").alias("name"), F.col("s").alias("size_bytes")), F.struct(F.lit("log.jsonl").alias("name"), F.lit(0).cast("long").alias("size_bytes")),
    )).alias("r")).select("r.name", "r.size_bytes")
    return rollup.artifact_index(sized, rollups, "http://localhost/", "j1")


def greedy_chunks(spark, d):
    units = F.filter(F.split("text", _UNITS), lambda u: u != "")
    docs = virtual.documents(spark, d).select("doc_id", units.alias("units"))
    found = chunking.chunk_units(docs, "doc_id", F.col("units"), F.transform("units", text.tokens), _CHUNK_TOKENS)
    return found.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "tokens")


def ffd_bins(spark, d):
    items = virtual.documents(spark, d).selectExpr("source AS job_id", "doc_id", "n_chars AS size")
    return packing.first_fit_bins(items, 20_000, item="doc_id")


_LINE = "'{\"event\": \"' || event_type || '\", \"id\": ' || CAST(event_id AS STRING) || '}'"


def log_tail(spark, d):
    lines = _read(spark, d, "events").selectExpr("event_id", f"{_LINE} AS line")
    return log.window_of(lines, "event_id", 5000, 200)


def event_counts(spark, d):
    return _read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def event_windows(spark, d):
    return log.event_rates(_read(spark, d, "events").select("ts", "event_type"))


def retention_sweep(spark, d):
    dirs = _read(spark, d, "orders").selectExpr("o_orderkey AS job_id", "CAST(unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS DOUBLE) AS mtime")
    active = _read(spark, d, "orders").where("o_orderstatus = 'O'").selectExpr("o_orderkey AS job_id")
    return read.expired(dirs, active, 900_000_000.0, 30)


def jobs_newest(spark, d):
    table = _read(spark, d, "orders").selectExpr("o_orderkey AS job_id", "o_orderstatus AS state", "o_orderdate AS started_at")
    return read.jobs(table, "F", 40)


def language_names(spark, d):
    names = spark.createDataFrame(list(classify.DISPLAY_NAMES.items()), "language string, display_name string")
    found = virtual.summaries(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    return found.join(F.broadcast(names), "language", "left").select("language", F.coalesce("display_name", "language").alias("display_name"), "n")


def incremental_reindex(spark, d):
    docs = virtual.documents(spark, d)
    now = docs.selectExpr("doc_id", f"{virtual.PATH} AS path", "sha2(text, 256) AS sha256")
    before = docs.selectExpr(f"{virtual.PATH} AS path", "CASE WHEN doc_id % 4 = 0 THEN sha2(text || '.', 256) ELSE sha2(text, 256) END AS sha256")
    return inventory.changed_files(now, before).select("doc_id", "path", "sha256")


_CHANGES = ("concat('u', user_id) AS path", "event_id AS version", "event_type <> 'view' AS live", "event_type AS language", "event_id % 1000 AS bytes")


def versioned_rollup(spark, d):
    """Files and bytes by language after each quarter of the changes, from what the changes bring and replace."""
    events = _read(spark, d, "events")
    count = events.agg(F.max("event_id")).first()[0] + 1
    signed = versions.differences(events.selectExpr(*_CHANGES), ["language", "bytes"])
    quarter = F.floor(F.col("version") * 4 / count).cast("int")
    return versions.summed(signed.withColumn("quarter", F.explode(F.sequence(quarter, F.lit(3)))), ["quarter", "language"], ["bytes"])


def versioned_facts(spark, d):
    """The facts (here the events' values) that belong to the last version of their path."""
    events = _read(spark, d, "events")
    facts = events.selectExpr("concat('u', user_id) AS path", "event_id AS version", "value")
    return versions.counting(facts, events.selectExpr(*_CHANGES))


#: Names, endings, roots, folders and their exceptions, 5,000 of them, in order.
RULES = 5000


def rule_line(k: int) -> str:
    return (f"mod_{k}.py", f"*.x{k}.ts", f"/src{k % 20}/src/main_{k}.go", f"!test_{k - 16}.py", f"svc_{k}/", f"!src{k % 20}/dist/lib_{k}.rs", f"page_{k}.*", f"test_{k}.py")[k % 8 if k % 64 > 3 else k % 3]


def ignore_rules(spark, d):
    return virtual.files(spark, d).select("doc_id", "path", gitignore.ignored(F.col("path"), [rule_line(k) for k in range(RULES)]).alias("ignored"))


def code_symbols(spark, d):
    found = symbols.symbols(symbols.declarations(virtual.sources(spark, d), comments=False))
    return found.groupBy("path", "kind", "qualified_name").agg(F.count(F.lit(1)).alias("n"))


def code_references(spark, d):
    found = symbols.references(symbols.declarations(virtual.sources(spark, d), comments=False))
    return found.groupBy("path", "kind", "qualifier", "in_symbol").agg(F.count(F.lit(1)).alias("n"))


def _kinds_declared(spark, d):
    """Statements of the sources in 13 languages."""
    return symbols.declarations(virtual.kinds(spark, d), comments=False)


def _kinds_found(spark, d):
    """The same and their symbols; the statements are written once for both."""
    declared = durable(_kinds_declared(spark, d).drop("strings"), "declared")
    return declared, symbols.symbols(declared)


def kind_symbols(spark, d):
    return symbols.symbols(_kinds_declared(spark, d)).select("path", "language", "kind", "name", "qualified_name")


def kind_imports(spark, d):
    return symbols.imports(_kinds_declared(spark, d)).select("path", "module", "alias", "kind")


def kind_exports(spark, d):
    return symbols.exports(*_kinds_found(spark, d))


def kind_references(spark, d):
    return symbols.references(_kinds_declared(spark, d)).select("path", "name", "kind", "in_symbol")


def kind_literals(spark, d):
    return symbols.string_literals(_kinds_declared(spark, d)).select("path", "kind", "value")


def kind_metrics(spark, d):
    return symbols.metrics(*_kinds_found(spark, d))


def parse_status(spark, d):
    return symbols.parse_status(virtual.kinds(spark, d))


def bracket_errors(spark, d):
    return symbols.parse_status(virtual.derived(spark, d, virtual.BRACKET_PATH, virtual.BRACKET_SOURCE))


def nested_lists(spark, d):
    """Imports, symbols, exports and calls out of lists inside of statements."""
    declared = durable(symbols.declarations(virtual.derived(spark, d, virtual.LIST_PATH, virtual.LIST_SOURCE), comments=False), "lists")
    found = durable(symbols.symbols(declared.where("language IN ('go', 'typescript')")), "symbols")
    none = F.lit(None).cast("string")
    return (
        symbols.imports(declared).select("path", F.lit("import").alias("what"), F.col("module").alias("name"), F.col("alias").alias("more"))
        .unionByName(found.select("path", F.col("kind").alias("what"), F.col("qualified_name").alias("name"), none.alias("more")))
        .unionByName(symbols.exports(declared, found).where(F.endswith("path", F.lit(".ts"))).select("path", F.lit("export").alias("what"), "name", none.alias("more")))
        .unionByName(symbols.references(declared.where("language = 'bash'")).select("path", F.col("kind").alias("what"), "name", F.col("in_symbol").alias("more")))
    )


def deep_scopes(spark, d):
    found = symbols.symbols(symbols.declarations(virtual.derived(spark, d, virtual.DEEP_PATH, virtual.DEEP_SOURCE), comments=False))
    return found.select("path", "kind", "qualified_name", (F.col("span.end_line") - F.col("span.start_line") + 1).alias("lines"))


def code_chunks(spark, d):
    files = virtual.derived(spark, d, virtual.CHUNK_PATH, virtual.CHUNK_SOURCE)
    declared = durable(symbols.declarations(files, comments=False), "functions")
    return analysis.chunks(declared, files, symbols.symbols(declared), 40).select(
        "path", "chunk", "qualified_name", "kind", "span.start_line", "span.end_line", "token_estimate", F.sha2("text", 256).alias("sha256")
    )


def module_docs(spark, d):
    return symbols.module_docs(symbols.declarations(virtual.derived(spark, d, virtual.DOC_PATH, virtual.DOC_SOURCE)))


def path_glob(spark, d):
    return read.expand(virtual.files(spark, d), "**/pkg/*/[a-z]*_[0-9]*.?s")


def symbol_totals(spark, d):
    return read.symbol_totals(_symbols(spark, d), kind="method", file_prefix="/Brand_1")


def artifact_totals(spark, d):
    return rollup.artifact_totals(artifact_index(spark, d))


def entry_points(spark, d):
    return rollup.entry_points(symbols.metrics(*_kinds_found(spark, d)))


_DONE = (
    "CASE WHEN event_id % 7 = 0 THEN 'file_error' ELSE 'file_done' END AS event", "CASE WHEN user_id % 5 = 0 THEN '' ELSE event_type END AS language",
    "event_id % 11 <> 0 AS parse_ok",
)


def progress_counters(spark, d):
    return rollup.progress(_read(spark, d, "events").selectExpr(*_DONE))


_OWN = (
    kind_symbols, kind_imports, kind_exports, kind_references, kind_literals, kind_metrics, parse_status, bracket_errors, nested_lists, deep_scopes, module_docs, code_chunks, path_glob, symbol_totals, artifact_totals,
    entry_points, progress_counters, versioned_rollup, versioned_facts, ignore_rules,
    code_symbols, code_references,
    lang_rollup, lang_by_count, manifest_scalars, skipped_by_reason, classify_flags, detect_language, file_metrics, tree_view,
    tree_totals, glob_filter, url_literals, route_literals, path_literals, sql_literals, env_literals, enclosing_symbol,
    unfetched_entries, fetch_failures, planned_bytes, symbols_filtered, top_level_symbols, symbols_sorted_top, artifact_index,
    greedy_chunks, ffd_bins, log_tail, event_counts, event_windows, retention_sweep, jobs_newest, language_names, incremental_reindex,
)


def queries() -> dict:
    return {f.__name__: f for f in _OWN}


# The SQL. ------------------------------------------------------------------------------------


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_BASE = "regexp_extract(lower(path), '[^/]*$')"
_EXT = f"CASE WHEN {_BASE} LIKE '%.%' THEN regexp_extract({_BASE}, '[^.]*$') ELSE '' END"
_DIRS = "string_split(regexp_replace(path, '[^/]*$', ''), '/')"


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


_LANG = f"""coalesce(({_map(classify.NAMES)})[{_BASE}], ({_map(classify.EXTENSIONS)})[{_EXT}],
  CASE WHEN first_line LIKE '#!%' THEN
    ({_map(classify.INTERPRETERS)})[lower(regexp_extract(regexp_extract(regexp_replace(substr(first_line, 3), '^\\s*(/usr/bin/env )?\\s*', ''), '^\\S*'), '[^/]*$'))]
  END, '')"""
_TEST = f"(regexp_matches({_BASE}, '{classify.TEST_NAME}') OR list_has_any(string_split(lower(regexp_replace(path, '[^/]*$', '')), '/'), {list(classify.TEST_FOLDERS)}))"
_CONFIG = f"({_BASE} IN {_in(classify.CONFIG_NAMES)} OR {_EXT} IN {_in(classify.CONFIG_EXTENSIONS)})"
_GENERATED = "(" + " OR ".join(f"contains('/' || lower(path) || '/', '{h}')" for h in classify.GENERATED_FOLDERS) + f" OR regexp_matches(substr(content, 1, 2048), '{classify.GENERATED_HEAD}'))"
_SKIPPED = f"list_has_any({_DIRS}, {list(classify.SKIPPED_FOLDERS)})"
_VFILES = f"vfiles AS (SELECT doc_id, {virtual.PATH} AS path, n_chars AS size, text, {virtual.FIRST_LINE} AS first_line, {virtual.CONTENT} AS content FROM documents)"
_LOC = r"(len(string_split_regex(content, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')) - CASE WHEN content = '' OR regexp_matches(content, '[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]$') THEN 1 ELSE 0 END)"
_SUMMARIES = f"""{_VFILES}, summaries AS (
  SELECT doc_id, path, {_LANG} AS language, strlen(content) AS bytes, {_LOC} AS loc, {_TEST} AS is_test, {_CONFIG} AS is_config,
         {_GENERATED} AS is_generated FROM vfiles)"""


def _ignored(lines) -> str:
    out = "false"
    for found in filter(None, map(rule, lines)):
        out = f"CASE WHEN regexp_matches(path, '{found[0]}') THEN {str(found[1]).lower()} ELSE {out} END"
    return out


_ENTRIES = f"""{_VFILES}, entries AS (
  SELECT path, size, skip_reason = '' AS analyzed, skip_reason FROM (
    SELECT path, size, CASE WHEN {_ignored(virtual.IGNORE)} THEN 'gitignore' WHEN {_ignored(virtual.EXTRA)} THEN 'extra_ignore'
      WHEN size > 4000 THEN 'oversize' WHEN {_EXT} IN {_in(classify.BINARY_EXTENSIONS)} THEN 'binary' ELSE '' END AS skip_reason
    FROM vfiles WHERE NOT {_SKIPPED}))"""
_PART = f"symbols AS (SELECT {', '.join(virtual.SYMBOLS)} FROM part)"
_HEADS = "|".join(literals.SQL_HEADS)
_TAIL = r"regexp_replace(coalesce(url, ''), '^https?://[^/]+', '')"

_SQL = {
    "lang_rollup": f"WITH {_SUMMARIES} SELECT CASE WHEN language = '' THEN 'unknown' ELSE language END AS language, count(*) AS file_count, sum(bytes)::BIGINT AS bytes, sum(loc)::BIGINT AS loc FROM summaries GROUP BY 1",
    "lang_by_count": f"WITH {_SUMMARIES} SELECT language, count(*) AS file_count FROM summaries GROUP BY 1",
    "manifest_scalars": f"""WITH {_SUMMARIES} SELECT count(*) AS file_count, sum(bytes)::BIGINT AS total_bytes, count(*) FILTER (language = '') AS parse_errors_count,
      count(*) FILTER (is_test) AS test_file_count, count(*) FILTER (is_config) AS config_file_count, count(*) FILTER (is_generated) AS generated_file_count FROM summaries""",
    "skipped_by_reason": f"WITH {_ENTRIES} SELECT skip_reason, count(*) AS n FROM entries WHERE NOT analyzed GROUP BY 1",
    "classify_flags": f"WITH {_VFILES} SELECT doc_id, {_TEST} AS is_test, {_CONFIG} AS is_config, {_GENERATED} AS is_generated, {_SKIPPED} AS in_skipped_folder FROM vfiles",
    "detect_language": f"WITH {_VFILES} SELECT doc_id, {_LANG} AS language FROM vfiles",
    "file_metrics": f"""WITH t AS (SELECT doc_id, text AS content FROM documents),
      u AS (SELECT *, {_LOC} AS loc, len(list_filter(string_split_regex(content, '\\n'), lambda x: regexp_matches(x, '^\\s*$')))
        - CASE WHEN content = '' OR content LIKE '%\n' THEN 1 ELSE 0 END AS blank FROM t)
      SELECT doc_id, strlen(content) AS bytes, loc, blank, loc - blank AS sloc, greatest(1, (strlen(content) + 3) // 4) AS token_estimate, sha256(content) AS sha256 FROM u""",
    "tree_view": f"WITH {_ENTRIES} SELECT path, size, analyzed, skip_reason FROM entries WHERE analyzed AND starts_with(path, 'src1')",
    "tree_totals": f"""WITH {_ENTRIES} SELECT count(*) FILTER (analyzed AND starts_with(path, 'src1')) AS returned,
      coalesce(sum(size) FILTER (analyzed AND starts_with(path, 'src1')), 0)::BIGINT AS returned_bytes, count(*) AS total, sum(size)::BIGINT AS total_bytes FROM entries""",
    "glob_filter": f"WITH {_VFILES} SELECT path FROM vfiles WHERE regexp_matches(path, '{glob_regex('src[1-4]*/*.py')}')",
    "url_literals": r"""WITH v AS (SELECT page_id, 'see <' || coalesce(url, '') || '>, or (' || coalesce(url, '') || '.);' AS value FROM pages)
      SELECT DISTINCT page_id, rtrim(u, '.,;:!?)]}''"') AS url FROM (SELECT page_id, unnest(regexp_extract_all(value, '\b(?:https?|wss?|grpc|postgres|mysql|redis|s3|file)://[^\s''"<>`]+')) AS u FROM v)""",
    "route_literals": rf"""WITH v AS (SELECT page_id, trim({_TAIL}) AS route FROM pages)
      SELECT page_id, route FROM v WHERE regexp_matches(route, '^/[A-Za-z0-9_\-./{{}}<>:*?]+$') AND contains(substr(route, 2), '/')""",
    "path_literals": rf"""WITH v AS (SELECT page_id, ' open ~' || {_TAIL} || ' from ' || CASE WHEN regexp_matches(coalesce(url, ''), '^https?://') THEN '' ELSE coalesce(url, '') END
        || ' or ./a' || page_id::VARCHAR || '/b.txt' AS value FROM pages)
      SELECT DISTINCT page_id, path FROM (SELECT page_id, unnest(regexp_extract_all(value, '[^A-Za-z0-9_/]((?:/|~/|\./|\.\./)[A-Za-z0-9_./\-]+/[A-Za-z0-9_./\-]+)', 1)) AS path FROM v)""",
    "sql_literals": rf"""WITH v AS (SELECT event_id, {_STATEMENT} AS value FROM events)
      SELECT event_id, regexp_replace(trim(value), '\s+', ' ', 'g') AS statement FROM v WHERE regexp_matches(ltrim(upper(value)), '^(?:{_HEADS})[ \n]')""",
    "env_literals": rf"""WITH v AS (SELECT event_id, {_ENV} AS value, {_CONTEXT} AS context FROM events)
      SELECT DISTINCT event_id, name FROM (SELECT event_id, unnest(regexp_extract_all(value, '\b[A-Z][A-Z0-9_]{{2,}}\b')) AS name FROM v
        WHERE {' OR '.join(f"contains(lower(context), '{c}')" for c in literals.ENV_CONTEXTS)})""",
    "enclosing_symbol": """WITH s AS (SELECT l_orderkey, l_linenumber AS symbol_id, (l_linenumber * 37) % 200 AS a, (l_linenumber * 37) % 200 + CAST(l_quantity AS INT) * 4 AS b FROM lineitem),
      p AS (SELECT DISTINCT l_orderkey, l_linenumber AS point_id, CAST(l_partkey % 250 AS INT) AS pos FROM lineitem)
      SELECT l_orderkey, point_id, pos, symbol_id FROM (
        SELECT p.l_orderkey, point_id, pos, symbol_id, row_number() OVER (PARTITION BY p.l_orderkey, point_id, pos ORDER BY a DESC NULLS LAST, b, symbol_id DESC) AS place
        FROM p LEFT JOIN s ON p.l_orderkey = s.l_orderkey AND a <= pos AND pos < b) WHERE place = 1""",
    "unfetched_entries": f"""WITH {_VFILES} SELECT path, CASE WHEN doc_id % 3 <> 0 THEN size ELSE -1 END AS size, false AS analyzed, 'oversize' AS skip_reason
      FROM vfiles v WHERE NOT EXISTS (SELECT 1 FROM labels l JOIN vfiles w USING (doc_id) WHERE w.path = v.path)""",
    "fetch_failures": f"WITH {_VFILES} SELECT path, size, doc_id FROM vfiles v WHERE NOT EXISTS (SELECT 1 FROM labels l JOIN vfiles w USING (doc_id) WHERE w.path = v.path)",
    "planned_bytes": "SELECT coalesce(sum(n_chars) FILTER (n_chars > 0 AND n_chars <= 4000), 0)::BIGINT AS planned_bytes FROM documents",
    "symbols_filtered": f"WITH {_PART} SELECT * FROM symbols WHERE kind = 'method' AND starts_with(file, 'Brand_1')",
    "top_level_symbols": f"WITH {_PART} SELECT * FROM (SELECT CASE WHEN symbol_id % 3 = 0 THEN qualified_name || '.m' ELSE qualified_name END AS qualified_name, kind, file, symbol_id FROM symbols) WHERE NOT contains(qualified_name, '.') AND kind <> 'module'",
    "symbols_sorted_top": f"WITH {_PART} SELECT * FROM symbols ORDER BY qualified_name, file, symbol_id LIMIT 50",
    "artifact_index": f"""WITH {_VFILES}
      SELECT 'tree.json' AS name, 'rollup' AS kind, (sum(size) * 2)::BIGINT AS size_bytes, 'http://localhost/outputs/j1/tree.json' AS url FROM vfiles
      UNION ALL SELECT 'log.jsonl', 'log', 0, 'http://localhost/outputs/j1/log.jsonl'
      UNION ALL SELECT 'analysis_index.json', 'rollup', NULL, 'http://localhost/outputs/j1/analysis_index.json'
      UNION ALL SELECT 'files/' || path || '.json', 'per_file', size * 2, 'http://localhost/outputs/j1/file/files/' || path || '.json' FROM vfiles""",
    "greedy_chunks": f"""WITH RECURSIVE units AS (
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ord, greatest(1, (strlen(u) + 3) // 4) AS t
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE u <> ''),
      fold AS (
        SELECT doc_id, ord, 0 AS chunk, t::BIGINT AS run FROM units WHERE ord = 1
        UNION ALL
        SELECT u.doc_id, u.ord, CASE WHEN f.run + u.t > {_CHUNK_TOKENS} THEN f.chunk + 1 ELSE f.chunk END,
               CASE WHEN f.run + u.t > {_CHUNK_TOKENS} THEN u.t ELSE f.run + u.t END
        FROM fold f JOIN units u ON u.doc_id = f.doc_id AND u.ord = f.ord + 1)
      SELECT doc_id, chunk::BIGINT AS chunk, min(ord) AS first, max(ord) AS last, max(run)::BIGINT AS tokens FROM fold GROUP BY doc_id, chunk""",
    "ffd_bins": """WITH RECURSIVE items AS (
        SELECT coalesce(source, '') AS job, source, doc_id, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS ord FROM documents),
      packed AS (
        SELECT job, 0::BIGINT AS ord, []::BIGINT[] AS rooms, -1::BIGINT AS bin FROM items GROUP BY job
        UNION ALL
        SELECT job, ord, CASE WHEN slot IS NULL THEN list_append(rooms, 20000 - size) ELSE list_transform(rooms, lambda r, i: CASE WHEN i = slot THEN r - size ELSE r END) END,
               coalesce(slot - 1, len(rooms))::BIGINT
        FROM (SELECT i.job, i.ord, i.size, p.rooms, list_position(list_transform(p.rooms, lambda r: r >= i.size), true) AS slot
              FROM packed p JOIN items i ON i.job = p.job AND i.ord = p.ord + 1))
      SELECT i.source AS job_id, i.doc_id, i.size, p.bin::INT AS bin FROM items i JOIN packed p ON i.job = p.job AND i.ord = p.ord""",
    "log_tail": f"""WITH l AS (SELECT event_id, {_LINE} AS line FROM events), o AS (SELECT *, sum(strlen(line) + 1) OVER (ORDER BY event_id)::BIGINT AS next_offset FROM l)
      SELECT event_id, line, next_offset FROM o WHERE next_offset - strlen(line) - 1 >= 5000 ORDER BY event_id LIMIT 200""",
    "event_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "event_windows": "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "retention_sweep": "SELECT o_orderkey AS job_id, epoch(o_orderdate)::DOUBLE AS mtime FROM orders o WHERE epoch(o_orderdate) <= 900000000.0 - 30 * 86400 AND NOT EXISTS (SELECT 1 FROM orders a WHERE a.o_orderkey = o.o_orderkey AND a.o_orderstatus = 'O')",
    "jobs_newest": "SELECT o_orderkey AS job_id, o_orderstatus AS state, o_orderdate AS started_at FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 40",
    "language_names": f"WITH {_SUMMARIES} SELECT language, coalesce(({_map(classify.DISPLAY_NAMES)})[language], language) AS display_name, count(*) AS n FROM summaries GROUP BY 1, 2",
    "incremental_reindex": f"WITH {_VFILES} SELECT doc_id, path, sha256(text) AS sha256 FROM vfiles v WHERE doc_id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM vfiles w WHERE w.path = v.path AND w.doc_id % 4 <> 0 AND w.text = v.text)",
}


_CODE = f"""code AS (SELECT {virtual.SOURCE_PATH} AS path, doc_id % 3 AS k, doc_id % 5 + 1 AS n, doc_id::VARCHAR AS id FROM documents)"""
_SQL["code_symbols"] = f"""WITH {_CODE}
  SELECT path, 'class' AS kind, CASE k WHEN 0 THEN '' ELSE 'a.b.' END || 'D' || id AS qualified_name, 1 AS n FROM code WHERE k <> 1
  UNION ALL SELECT path, 'module', 'p' || id, 1 FROM code WHERE k = 1
  UNION ALL SELECT path, CASE k WHEN 1 THEN 'function' ELSE 'method' END, CASE k WHEN 0 THEN 'D' || id || '.go' WHEN 1 THEN 'p' || id || '.Go' ELSE 'a.b.D' || id || '.go' END, n FROM code"""
_SQL["code_references"] = f"""WITH {_CODE}
  SELECT path, 'inherit' AS kind, 'Base' AS qualifier, CASE k WHEN 0 THEN '' ELSE 'a.b.' END || 'D' || id AS in_symbol, 1 AS n FROM code WHERE k <> 1
  UNION ALL SELECT path, 'call', 'use', CASE k WHEN 0 THEN 'D' || id || '.go' WHEN 1 THEN 'p' || id || '.Go' ELSE 'a.b.D' || id || '.go' END, n FROM code"""


# What the sources in 13 languages declare, written down per language and not derived from the rules. ``@``: the id.
_DECLARED = {
    0: "class D@ D@|method go D@.go|function test_go test_go",
    1: "class D@ D@|method go D@.go|function area area",
    2: "interface Shape Shape|function area@ area@",
    3: "class D@ D@|method go D@.go|function up up",
    4: "module p@ p@|class Box p@.Box|field W p@.Box.W|method Fill p@.Box.Fill|function TestFill p@.TestFill",
    5: "class Rod Rod|field len Rod.len|method cut Rod.cut|function weld@ weld@|function main main",
    6: "class D@ a.b.D@|field n a.b.D@.n|method main a.b.D@.main",
    7: "module Kit Kit|class D@ Kit.D@|method test_go Kit.D@.test_go",
    8: "constant RATE RATE|function twice@ twice@|function main main",
    9: "module sp sp|function jump@ sp.jump@",
    10: "module Home Home|class D@ Home.D@|property Watts Home.D@.Watts|method Go Home.D@.Go",
    11: "class D@ Site.D@|method go Site.D@.go|function link_to Site.link_to",
    12: "constant TARGET TARGET|function build build",
}
_NAMED = dict(enumerate("python typescript tsx javascript go rust java ruby c cpp csharp php bash".split()))
_IMPORTED = {
    0: "os - import|a.b.c d from", 1: "./parts::One - from", 2: "./parts::Two T from", 3: "./parts::default X from", 4: "os - import",
    5: "std::fmt::Debug - import", 6: "java.util.Map - import", 7: "set - import", 8: "stdlib.h - import", 9: "map - import", 10: "System.Text - import",
    11: "Form - import", 12: "./lib.sh - import",
}
_EXPORTED = {0: "D@ D@|go go", 1: "D@ D@|area area", 2: "Shape Shape|area@ area@", 3: "D@ D@|up up", 4: "Box p@.Box|TestFill p@.TestFill", 5: "Rod Rod|cut Rod.cut|weld@ weld@", 6: "D@ a.b.D@", 10: "D@ Home.D@"}
_REFERRED = {
    0: "Base inherit D@|use call D@.go|use call test_go|test_go call <module>", 1: "Base inherit D@|use call D@.go|use call area", 2: "use call area@", 3: "Base inherit D@|use call D@.go",
    4: "use call p@.Fill|use call p@.TestFill", 5: "join call Rod.cut|join call weld@|join call main", 6: "Base inherit a.b.D@|use call a.b.D@.main",
    7: "Base inherit Kit.D@|use call Kit.D@.test_go", 8: "puts call main", 9: "use call sp.jump@", 10: "Use call Home.D@.Go", 11: "Base inherit Site.D@|take call Site.D@.go",
    12: "echo call build|build call <module>",
}
#: Functions, classes, nesting, async, generators, tests, and whether there is an entry point.
_MEASURED = {
    0: "2 1 2 0 1 1 true", 1: "2 1 1 1 0 0 false", 2: "1 0 0 0 0 0 false", 3: "2 1 1 0 0 0 false", 4: "2 1 0 0 0 1 false", 5: "3 1 0 1 0 0 true", 6: "1 1 0 0 0 0 true",
    7: "1 1 0 0 0 1 false", 8: "2 0 0 0 0 0 true", 9: "1 0 0 0 0 0 false", 10: "1 1 0 0 0 0 false", 11: "2 1 0 0 0 0 false", 12: "1 0 0 0 0 0 false",
}


def _told(table: dict[int, str], *columns: str) -> str:
    """``said``: a row per document and entry of its language, its parts under the names given."""
    values = ", ".join(f"({k}, '{row}')" for k, entry in table.items() for row in entry.split("|"))
    parts = ", ".join(f"string_split(row, ' ')[{i}] AS {c}" for i, c in enumerate(columns, 1))
    return f"""told(k, said) AS (VALUES {values}), said AS (SELECT doc_id, path, k, text, {parts} FROM (
      SELECT doc_id, text, {virtual.KIND_PATH} AS path, k, replace(said, '@', doc_id::VARCHAR) AS row FROM documents JOIN told ON doc_id % 13 = k))"""


_LANGUAGE_OF = "CASE k " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _NAMED.items()) + " END"
_SQL["kind_symbols"] = f"WITH {_told(_DECLARED, 'kind', 'name', 'qualified_name')} SELECT path, {_LANGUAGE_OF} AS language, kind, name, qualified_name FROM said"
_SQL["kind_imports"] = f"WITH {_told(_IMPORTED, 'module', 'alias', 'kind')} SELECT path, module, nullif(alias, '-') AS alias, kind FROM said"
_SQL["kind_exports"] = f"WITH {_told(_EXPORTED, 'name', 'qualified_name')} SELECT path, name, qualified_name FROM said"
_SQL["kind_references"] = f"WITH {_told(_REFERRED, 'name', 'kind', 'in_symbol')} SELECT path, name, kind, in_symbol FROM said"
_SQL["kind_literals"] = f"SELECT {virtual.KIND_PATH} AS path, 'url' AS kind, 'https://h.example/' || doc_id AS value FROM documents"
_SQL["kind_metrics"] = f"""WITH {_told(_MEASURED, 'f', 'c', 'd', 'a', 'g', 't', 'm')}
  SELECT path, f::BIGINT AS n_functions, c::BIGINT AS n_classes, d::INT AS max_nest_depth, a::BIGINT AS async_count, g::BIGINT AS generator_count, t::BIGINT AS test_count,
         m::BOOLEAN AS has_main_guard, CASE WHEN k IN (5, 6) THEN 0 ELSE len(string_split(coalesce(text, ''), chr(10))) END::INT AS comment_lines FROM said"""
_SQL["entry_points"] = f"WITH {_told(_MEASURED, 'f', 'c', 'd', 'a', 'g', 't', 'm')} SELECT path FROM said WHERE m = 'true'"
_SQL["parse_status"] = f"SELECT {virtual.KIND_PATH} AS path, true AS parse_ok, 0 AS error_nodes, 0 AS missing_nodes FROM documents"
# Of the brackets of one type, as many close nothing as the running sum falls below zero at most.
_SQL["bracket_errors"] = """WITH letters AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^aeiont]', '', 'g') AS w FROM documents),
  runs AS (SELECT doc_id, string_split(CASE WHEN doc_id % 2 = 0 THEN regexp_replace(w, '[^aei]', '', 'g') || translate(reverse(regexp_replace(w, '[^aei]', '', 'g')), 'aei', 'xyz') ELSE w END, '') AS m FROM letters),
  marks AS (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS c FROM runs),
  kinds AS (SELECT doc_id, i, CASE WHEN doc_id % 2 = 0 THEN (CASE WHEN c IN ('a', 'x') THEN 0 WHEN c IN ('e', 'y') THEN 1 ELSE 2 END) ELSE (CASE WHEN c IN ('a', 'e') THEN 0 WHEN c IN ('i', 'o') THEN 1 ELSE 2 END) END AS kind,
    CASE WHEN doc_id % 2 = 0 THEN (CASE WHEN c IN ('a', 'e', 'i') THEN 1 ELSE -1 END) ELSE (CASE WHEN c IN ('a', 'i', 'n') THEN 1 ELSE -1 END) END AS d FROM marks WHERE c <> ''),
  sums AS (SELECT doc_id, kind, d, sum(d) OVER (PARTITION BY doc_id, kind ORDER BY i) AS run FROM kinds),
  low AS (SELECT doc_id, greatest(0, -min(run)) AS c, sum(d) + greatest(0, -min(run)) AS o FROM sums GROUP BY doc_id, kind),
  per AS (SELECT doc_id, sum(c + o)::INT AS e, sum(o)::INT AS m FROM low GROUP BY doc_id)
  SELECT 'b' || doc_id || ('.' || ['py', 'ts', 'tsx', 'js', 'go', 'rs', 'java', 'rb', 'c', 'cpp', 'cs', 'php'][doc_id % 12 + 1]) AS path,
    coalesce(e, 0) = 0 AS parse_ok, coalesce(e, 0) AS error_nodes, coalesce(m, 0) AS missing_nodes FROM documents LEFT JOIN per USING (doc_id)"""
_LINED = "lined AS (SELECT doc_id, l, i - 1 AS i, 'x' || regexp_extract(l, '[A-Za-z]+') || (i - 1) AS x FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents))"
_SQL["nested_lists"] = f"""WITH {_LINED}
  SELECT 'q' || doc_id || '.rs' AS path, 'import' AS what, 'top::' || x || CASE i % 3 WHEN 1 THEN '::deep' || i || '::Last' ELSE '' END AS name,
    CASE i % 3 WHEN 1 THEN 'L' || i WHEN 2 THEN 'R' || i END AS more FROM lined WHERE doc_id % 4 = 0
  UNION ALL SELECT 'q' || doc_id || '.go', 'module', 'p', NULL FROM documents WHERE doc_id % 4 = 1
  UNION ALL SELECT 'q' || doc_id || '.go', 'constant', 'p.' || x || unnest(CASE i % 3 WHEN 0 THEN [''] WHEN 1 THEN ['A', 'B'] ELSE ['C'] END), NULL FROM lined WHERE doc_id % 4 = 1
  UNION ALL SELECT 'q' || doc_id || '.go', 'constant', 'p.' || CASE i % 3 WHEN 0 THEN 'X' ELSE 'Up' END || i, NULL FROM lined WHERE doc_id % 4 = 1 AND i % 3 < 2
  UNION ALL SELECT 'q' || doc_id || '.go', CASE i % 2 WHEN 0 THEN 'class' ELSE 'interface' END, 'p.' || CASE i % 2 WHEN 0 THEN 'T' ELSE 'I' END || i, NULL FROM lined WHERE doc_id % 4 = 1
  UNION ALL SELECT 'q' || doc_id || '.go', 'field', 'p.T' || i || '.F' || i, NULL FROM lined WHERE doc_id % 4 = 1 AND i % 2 = 0
  UNION ALL SELECT 'q' || doc_id || '.ts', w, x, NULL FROM (SELECT doc_id, x, unnest([CASE i % 2 WHEN 0 THEN 'constant' ELSE 'function' END, 'export']) AS w FROM lined WHERE doc_id % 4 = 2)
  UNION ALL SELECT 'q' || doc_id || '.ts', w, CASE w WHEN 'export default' THEN 'default' ELSE 'D' || doc_id END, NULL
    FROM (SELECT doc_id, unnest([CASE doc_id % 8 WHEN 2 THEN 'class' ELSE 'function' END, 'export', 'export default']) AS w FROM documents WHERE doc_id % 4 = 2)
  UNION ALL SELECT 'q' || doc_id || '.sh', 'call', x || unnest(CASE i % 2 WHEN 0 THEN ['', 'b', 'c'] ELSE ['d', 'e', 'f', 'g'] END), 'run' FROM lined WHERE doc_id % 4 = 3"""
_SQL["nested_lists"] = f"SELECT path, CASE what WHEN 'export default' THEN 'export' ELSE what END AS what, name, more FROM ({_SQL['nested_lists']})"
_SQL["deep_scopes"] = """WITH deep AS (SELECT doc_id, doc_id % 2 AS k, (1 + len(string_split(coalesce(text, ''), chr(10))) % 40)::BIGINT AS n FROM documents),
  named AS (SELECT *, list_transform(list_filter(range(n), lambda i: i % 3 < 2), lambda i: 'C' || i) AS chain FROM deep),
  each AS (SELECT doc_id, k, n, chain, unnest(range(n)) AS i FROM named)
  SELECT 'n' || doc_id || CASE k WHEN 0 THEN '.java' ELSE '.py' END AS path, 'class' AS kind, array_to_string(chain[1:list_position(chain, 'C' || i)], '.') AS qualified_name,
    CASE k WHEN 0 THEN n - i + 2 ELSE n - i + 1 END::INT AS lines FROM each WHERE i % 3 < 2
  UNION ALL SELECT 'n' || doc_id || CASE k WHEN 0 THEN '.java' ELSE '.py' END, 'method', array_to_string(chain, '.') || '.go', 1 FROM named
  UNION ALL SELECT 'n' || doc_id || CASE k WHEN 0 THEN '.java' ELSE '.py' END, unnest(['class', 'method']), unnest(['Tail', 'Tail.last']), unnest(CASE k WHEN 0 THEN [1, 1] ELSE [3, 2] END) FROM named"""
_SQL["code_chunks"] = f"""WITH RECURSIVE {_LINED},
  units AS (
    SELECT doc_id, i, 'def f' || i || '():' || chr(10) || '    return "' || repeat(CASE i % 2 WHEN 0 THEN 'x' ELSE 'y' END, length(l) % 60) || '"' AS code,
      sum(CASE i % 2 WHEN 0 THEN 2 ELSE 3 END) OVER (PARTITION BY doc_id ORDER BY i) - CASE i % 2 WHEN 0 THEN 1 ELSE 2 END AS line FROM lined),
  fold AS (
    SELECT doc_id, i, 0 AS chunk, (strlen(code) + 3) // 4 AS run FROM units WHERE i = 0
    UNION ALL
    SELECT u.doc_id, u.i, CASE WHEN f.run + (strlen(u.code) + 3) // 4 > 40 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.run + (strlen(u.code) + 3) // 4 > 40 THEN (strlen(u.code) + 3) // 4 ELSE f.run + (strlen(u.code) + 3) // 4 END
    FROM fold f JOIN units u ON u.doc_id = f.doc_id AND u.i = f.i + 1),
  whole AS (
    SELECT doc_id, chunk, min(i) AS first, max(i) AS last, min(line) AS line,
      string_agg(code || CASE WHEN i % 2 = 1 AND i < edge THEN chr(10) || '# note' ELSE '' END, chr(10) ORDER BY i) AS text
    FROM (SELECT *, max(i) OVER (PARTITION BY doc_id, chunk) AS edge FROM fold JOIN units USING (doc_id, i)) GROUP BY doc_id, chunk)
  SELECT 'h' || doc_id || '.py' AS path, chunk::INT AS chunk, 'f' || first AS qualified_name, 'function' AS kind, line::INT AS start_line,
    (line + strlen(text) - strlen(replace(text, chr(10), '')))::INT AS end_line, ((strlen(text) + 3) // 4)::INT AS token_estimate, sha256(text) AS sha256 FROM whole"""
_BARE = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_SQL["module_docs"] = f"""WITH {_LINED},
  docs AS (SELECT doc_id, string_agg(CASE WHEN doc_id % 5 = 3 AND i % 3 = 1 THEN NULL ELSE {_BARE('l')} END, chr(10) ORDER BY i) AS t FROM lined GROUP BY doc_id)
  SELECT 'm' || doc_id || ['.py', '.go', '.ts', '.rs', '.java'][doc_id % 5 + 1] AS path,
    CASE doc_id % 5 WHEN 0 THEN {_BARE("coalesce(text, '')")} WHEN 4 THEN '' ELSE coalesce({_BARE('t')}, '') END AS module_doc FROM documents JOIN docs USING (doc_id)"""
_SQL["path_glob"] = f"WITH {_VFILES} SELECT path FROM vfiles WHERE list_extract(string_split(path, '/'), -3) = 'pkg' AND list_extract(string_split(path, '/'), -1) SIMILAR TO '[a-z][^/]*_[0-9][^/]*[.][^/]s'"
_SQL["symbol_totals"] = f"WITH {_PART} SELECT count(*) AS total_in_repo, count(*) FILTER (kind = 'method' AND starts_with(file, 'Brand_1')) AS total_returned FROM symbols"
_SQL["artifact_totals"] = "SELECT count(*) + 3 AS artifacts, (4 * sum(n_chars))::BIGINT AS total_size_bytes FROM documents"
_SQL["versioned_rollup"] = f"""WITH e AS (SELECT {', '.join(_CHANGES)}, (event_id * 4 // (SELECT max(event_id) + 1 FROM events))::INT AS q FROM events),
  state AS (SELECT k AS quarter, path, max_by(live, version) AS live, max_by(language, version) AS language, max_by(bytes, version) AS bytes FROM e, range(4) AS t(k) WHERE q <= k GROUP BY k, path)
  SELECT quarter::INT AS quarter, language, count(*) AS file_count, sum(bytes)::BIGINT AS bytes FROM state WHERE live GROUP BY ALL"""
_SQL["versioned_facts"] = """SELECT 'u' || user_id AS path, event_id AS version, value FROM events e
  WHERE event_type <> 'view' AND NOT EXISTS (SELECT 1 FROM events n WHERE n.user_id = e.user_id AND n.event_id > e.event_id)"""
# The rules again as kinds and keys; the last one that fits decides.
_SQL["ignore_rules"] = f"""WITH r AS (SELECT k, CASE WHEN k % 64 > 3 THEN k % 8 ELSE k % 3 END AS kind FROM range({RULES}) AS t(k)),
  f AS (SELECT doc_id, {virtual.PATH} AS path FROM documents), p AS (SELECT *, string_split(path, '/') AS parts FROM f),
  hits AS (
    SELECT doc_id, k, kind FROM p, r WHERE CASE kind
      WHEN 0 THEN list_contains(parts, 'mod_' || k || '.py') WHEN 1 THEN list_has_any([true], list_transform(parts, lambda x: ends_with(x, '.x' || k || '.ts')))
      WHEN 2 THEN starts_with(path || '/', 'src' || k % 20 || '/src/main_' || k || '.go/') WHEN 3 THEN list_contains(parts, 'test_' || (k - 16) || '.py')
      WHEN 4 THEN list_contains(parts[1:len(parts) - 1], 'svc_' || k) WHEN 5 THEN starts_with(path || '/', 'src' || k % 20 || '/dist/lib_' || k || '.rs/')
      WHEN 6 THEN list_has_any([true], list_transform(parts, lambda x: starts_with(x, 'page_' || k || '.'))) ELSE list_contains(parts, 'test_' || k || '.py') END),
  last AS (SELECT doc_id, max_by(kind, k) AS kind FROM hits GROUP BY doc_id)
  SELECT doc_id, path, coalesce(kind NOT IN (3, 5), false) AS ignored FROM p LEFT JOIN last USING (doc_id)"""
_SQL["progress_counters"] = f"""WITH e AS (SELECT {', '.join(_DONE)} FROM events)
  SELECT CASE WHEN language = '' THEN 'unknown' ELSE language END AS language, count(*) AS files_done, count(*) FILTER (NOT parse_ok) AS errors_count FROM e WHERE event = 'file_done' GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

"""DuckDB SQL for the numbered operators that SQL can express."""

from lodestone.llm import url_filter

_OP1 = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE)
           / 4503599627370496::DOUBLE AS u
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, source_size * 3 AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM totals),
filling AS (
  SELECT *, coalesce(sum(cap) OVER below, 0) AS c, sum(w) OVER above AS ww,
         (SELECT sum(source_size) FROM totals) AS t
  FROM ranked
  WINDOW below AS (ORDER BY cap / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         above AS (ORDER BY cap / w::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (
  SELECT * FROM filling WHERE w * (t - c) <= cap * ww
  ORDER BY cap / w::DOUBLE, source NULLS LAST LIMIT 1),
targets AS (
  SELECT r.source, r.source_size,
         CASE WHEN l.t IS NULL OR r.cap * l.ww < r.w * (l.t - l.c) THEN r.cap::DOUBLE
              ELSE r.w::DOUBLE * (l.t - l.c)::DOUBLE / l.ww::DOUBLE END AS target
  FROM ranked r LEFT JOIN level l ON true),
expected AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(3.0::DOUBLE, t.target / t.source_size * 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS e
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
odds AS (
  SELECT *, floor(e)::BIGINT AS whole,
         CASE WHEN e - floor(e) > 0 THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS q
  FROM expected),
certain AS (SELECT source, max(target) - sum(whole * size) AS rest FROM odds GROUP BY source),
lottery AS (
  SELECT o.doc_id, o.source, o.q, o.size, c.rest,
         sum(o.size) OVER (PARTITION BY o.source ORDER BY o.q, o.doc_id ROWS UNBOUNDED PRECEDING) AS run
  FROM odds o JOIN certain c ON o.source IS NOT DISTINCT FROM c.source WHERE o.q IS NOT NULL),
gaps0 AS (
  SELECT source, max(rest) - sum(CASE WHEN run <= rest THEN size ELSE 0 END) AS gap FROM lottery GROUP BY source),
FILLING
filled AS (ALL_FILLS)
SELECT o.doc_id, o.size, o.source_size, o.target,
       (o.whole + CASE WHEN l.run <= l.rest OR f.source_size IS NOT NULL THEN 1 ELSE 0 END) * o.size AS taken
FROM odds o
LEFT JOIN lottery l ON o.doc_id = l.doc_id
LEFT JOIN filled f ON o.doc_id = f.doc_id
"""


def _fillings(rounds: int = 4) -> str:
    """One step per document that fills up a source: the best of those left, and what is then open."""
    steps = ""
    for k in range(rounds):
        fits = "abs(l.size - g.gap) < g.gap" if k + 1 == rounds else "l.size <= g.gap"
        others = "".join(f" AND l.doc_id NOT IN (SELECT doc_id FROM fill{j})" for j in range(k))
        steps += f"""fill{k} AS (
  SELECT source, doc_id, size, true AS source_size FROM (
    SELECT l.*, row_number() OVER (PARTITION BY l.source ORDER BY abs(l.size - g.gap), l.q, l.doc_id) AS place
    FROM lottery l JOIN gaps{k} g ON l.source IS NOT DISTINCT FROM g.source
    WHERE l.run > l.rest AND l.size > 0 AND {fits}{others}) WHERE place = 1),
gaps{k + 1} AS (
  SELECT g.source, g.gap - coalesce(f.size, 0) AS gap FROM gaps{k} g LEFT JOIN fill{k} f ON g.source IS NOT DISTINCT FROM f.source),
"""
    return steps


_OP1 = _OP1.replace("FILLING\n", _fillings()).replace(
    "ALL_FILLS", " UNION ALL ".join(f"SELECT doc_id, source_size FROM fill{k}" for k in range(4))
)

_OP2 = r"""
WITH squeezed AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM squeezed WINDOW same AS (PARTITION BY text)
"""

_OP10 = r"""
WITH norm AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS t
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
spots AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM norm, lengths WHERE len(w) >= n)),
hits AS (SELECT s.doc_id, s.i, s.n, w.item FROM spots s JOIN windows w ON s.n = w.n AND s.t = w.t),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT norm.doc_id, len(norm.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM norm LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _op7(depth: int = 4) -> str:
    """The template tree with one column per segment, as many as the given urls have at most and two more."""
    cols = [f"t{i}" for i in range(1, depth + 1)]
    fits = lambda rule: (
        f"((host = '{(h := rule.split('/')[0])}' OR suffix(host, '.{h}')) AND starts_with(path, '{rule[len(h):]}'))"
    )
    ordered = sorted(url_filter.RULES, key=lambda r: -len(r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in ordered) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in ordered) + " END"
    segment = lambda i: f"CASE WHEN regexp_matches(own[{i}], '[0-9]') THEN '*' || regexp_extract(own[{i}], '(\\.[A-Za-z]{{1,5}})$', 1) ELSE own[{i}] END"
    steps, last = "", "paths"

    def replaced(d: int, table: str) -> str:
        on = " AND ".join(f"p.{c} = r.{c}" for c in ["host", *cols[: d + 1]])
        moved = ", ".join(f"CASE WHEN r.host IS NOT NULL THEN '*' ELSE p.{c} END AS {c}" if i == d else f"p.{c}" for i, c in enumerate(cols))
        return f"(SELECT p.host, p.segs, p.a, p.b, p.n, {moved} FROM {last} p LEFT JOIN {table} r ON {on})"

    for d, seg in enumerate(cols):
        at = ", ".join(["host", *cols[:d]])
        steps += f"""
c{d} AS (SELECT {at}, {seg}, sum(a + b + n) AS c FROM {last} WHERE {seg} IS NOT NULL GROUP BY ALL),
k{d} AS (SELECT {at}, count(*) AS kids, sum(c) AS total FROM c{d} GROUP BY ALL),
r{d} AS (SELECT {at}, {seg} FROM c{d} JOIN k{d} USING ({at}) WHERE NOT starts_with({seg}, '*') AND kids >= {url_filter.MANY} AND c < total * {url_filter.RARE}::DOUBLE),
p{d} AS {replaced(d, f'r{d}')},"""
        last = f"p{d}"
    critical = lambda f: f"({f} * (1 - 2::DOUBLE / (9 * {f}) + {url_filter.DEVIATE}::DOUBLE * sqrt(2::DOUBLE / (9 * {f}))) ** 3)"
    for d, seg in enumerate(cols):
        own = ", ".join(["host", *cols[:d]])
        at = own + ", top"
        kid = f"coalesce({cols[d + 1]}, '')" if d + 1 < depth else "''"
        steps += f"""
v{d} AS (SELECT {own}, {seg}, {kid} AS kid, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b, sum(a + b + n)::DOUBLE AS c FROM {last} WHERE {seg} IS NOT NULL GROUP BY ALL),
w{d} AS (SELECT *, first_value(kid) OVER (PARTITION BY {own}, {seg} ORDER BY c DESC, kid DESC) AS top FROM v{d}),
b{d} AS (SELECT {at}, {seg}, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM w{d} GROUP BY ALL),
m{d} AS (SELECT {at}, sum(a) AS aa, sum(b) AS ab, sum(c) AS ac, count(*) AS branches FROM b{d} GROUP BY ALL),
f{d} AS (SELECT {at}, kid, sum(c) AS ck FROM w{d} GROUP BY ALL),
g{d} AS (SELECT {at}, (count(*) - 1)::DOUBLE AS df FROM f{d} GROUP BY ALL),
x{d} AS (
  SELECT {at}, {seg}, sum(pow(coalesce(w.c, 0) * sqrt((ac - b.c) / b.c) - (ck - coalesce(w.c, 0)) * sqrt(b.c / (ac - b.c)), 2) / ck) AS chi
  FROM b{d} b JOIN m{d} USING ({at}) JOIN f{d} USING ({at}) LEFT JOIN w{d} w USING ({at}, {seg}, kid) WHERE branches > 1 GROUP BY ALL),
t{d}x AS (
  SELECT {at}, {seg}, chi, df, ac, aa + ab AS told,
         CASE WHEN (a + b) * (aa + ab - a - b) * aa * ab > 0
              THEN pow(a * (ab - b) - b * (aa - a), 2) * (aa + ab) / ((a + b) * (aa + ab - a - b) * aa * ab) ELSE 0 END AS cross_chi
  FROM b{d} JOIN m{d} USING ({at}) JOIN x{d} USING ({at}, {seg}) JOIN g{d} USING ({at})),
s{d} AS (
  SELECT {at}, {seg} FROM t{d}x WHERE (df < 1 OR chi < {critical('df')} OR chi < {url_filter.EFFECT}::DOUBLE * ac)
    AND (cross_chi < {critical('1::DOUBLE')} OR cross_chi < {url_filter.EFFECT}::DOUBLE * told)),
q{d} AS {replaced(d, f's{d}')},"""
        last = f"q{d}"
    return rf"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (
  SELECT *, {rule} AS rule, list_filter(string_split(path, '/'), lambda s: s <> '') AS own FROM parts),
cut AS (SELECT page_id, host, path, rule, {verdict} AS told, [{', '.join(segment(i) for i in range(1, depth + 1))}] AS segs FROM ruled),
paths AS (
  SELECT host, segs, count(*) FILTER (told = 'allow') AS a, count(*) FILTER (told = 'block') AS b, count(*) FILTER (told IS NULL) AS n,
         {', '.join(f'segs[{i}] AS t{i}' for i in range(1, depth + 1))} FROM cut GROUP BY host, segs),{steps}
judged AS (
  SELECT host, segs, (sum(b) OVER same + {url_filter.STRENGTH / 2}::DOUBLE) / (sum(a + b) OVER same + {url_filter.STRENGTH}::DOUBLE) AS purity
  FROM {last} WINDOW same AS (PARTITION BY host, {', '.join(cols)}))
SELECT page_id, host, path, rule, coalesce(told, CASE WHEN purity >= {url_filter.REJECT} THEN 'block' ELSE 'allow' END) AS verdict
FROM cut JOIN judged USING (host, segs)
"""


def _op12(levels: int = 8) -> str:
    """One step per level; a level with one node is passed on as it is. ``levels`` is enough for 8 ** 8 leaves a group."""
    value = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    row = lambda text: "sha256(" + " || ".join([*map(value, ("doc_id", "source", "lang", "n_chars")), value(text)]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = ""

    def level(k: int, own: str, key: str) -> str:
        group = f"{key}, i // 8" if key else "i // 8"
        over = f"PARTITION BY {key}" if key else ""
        keys = f"{key}, " if key else ""
        return f"""
{own}c{k} AS (SELECT *, count(*) OVER ({over}) AS c FROM {own}{k}),
{own}{k + 1} AS (SELECT {keys}i // 8 AS i, CASE WHEN any_value(c) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {own}c{k} GROUP BY {group}),
{own}s{k} AS (
  SELECT {keys}i, c, coalesce(string_agg(d, '' ORDER BY i) OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(d, '' ORDER BY i) OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {own}c{k} WINDOW run AS (PARTITION BY {group} ORDER BY i)),"""

    for k in range(levels):
        steps += level(k, "n", "g")
    steps += f"""
roots AS (SELECT g, d FROM n{levels}),
t0 AS (SELECT g AS i, d FROM roots),"""
    for k in range(levels):
        steps += level(k, "t", "")
    for own, key, count in (("n", "s.g = f.g AND ", levels), ("t", "", levels)):
        for k in range(count):
            last = f"{own}f{k - 1}" if k else ("claims" if own == "n" else f"nf{levels - 1}")
            at = f"f.place // {8 ** k}" if own == "n" else f"f.g // {8 ** k}"
            steps += f"""
{own}f{k} AS (
  SELECT f.* REPLACE (CASE WHEN s.c = 1 THEN f.h ELSE sha256(s.l || f.h || s.r) END AS h, CASE WHEN s.c = 1 THEN f.p ELSE f.p || s.l || s.r END AS p)
  FROM {last} f JOIN {own}s{k} s ON {key}s.i = {at}),"""
    return rf"""
WITH bits AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda x, _: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)) ORDER BY b) AS crc
  FROM range(256) AS t(b)),
hashed AS (
  SELECT doc_id, lang, text, n_chars, source, {row('text')} AS leaf, {row(lower)} AS changed,
         xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]))) % 3 = 0 AS tampered
  FROM documents, bits),
leaves AS (
  SELECT doc_id, leaf, CASE WHEN tampered THEN changed ELSE leaf END AS claim, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
  FROM hashed),
claims AS (SELECT doc_id, leaf, g, place, claim AS h, '' AS p FROM leaves),
n0 AS (SELECT g, place AS i, leaf AS d FROM leaves),{steps}
top AS (SELECT d FROM t{levels})
SELECT f.doc_id, f.leaf, roots.d AS subroot, (SELECT d FROM top) AS root, sha256(f.p) AS proof_sha256, f.h AS folded_root, f.h = (SELECT d FROM top) AS verified
FROM tf{levels - 1} f JOIN roots USING (g)
"""


_OP13 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s
  FROM documents),
drawn AS (
  SELECT *, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM cut),
parts AS (
  SELECT doc_id, text, n::BIGINT AS n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


ORACLES = {"op1_pareto_mix": _OP1, "op2_chunk_recipe_dedup": _OP2, "op10_decontaminate": _OP10, "op7_url_templates": _op7(), "op12_merkle_manifest": _op12(), "op13_fill_in_middle": _OP13}

"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative; the run
with the highest sum, found in one linear scan, is the content. The weights come from
labelled pages, at most ``SAMPLE`` of them: pages whose single ``<article>`` says what is
inside. A tag costs the more the more often it stands outside; a word brings the share of
words inside among those with the same nearest tag.

Elements that are never content by their name, role or class (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, comments) are left out before the scan.
The run is widened to the whole of each ``article`` or ``main`` element, or block of a content
class, that it touches, and is never narrowed.

Defined cases: null html is empty; a page without words gives an empty text; tags that are
not closed end with their parent or the page; ``<`` that opens no tag is text; repeated rows
stay; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled pages that weights are taken from.
SAMPLE = 2000

# Quoted values may hold ``>``, and ``<`` where the quote ends as a value does; a quote that
# doesn't is a character.
_PLAIN = r"(?:[^<>\"'=]|=\s*\"[^\"<]*\"|=\s*'[^'<]*'|=)*+"
_QUOTED = r"(?:[^<>\"'=]|=\s*\"[^\"]*\"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|=)*+"
_LOOSE = r"[^<>]*+"
_NAMED = r"[a-zA-Z][a-zA-Z0-9:_.-]*"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>script|style|textarea|title|iframe)(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<name>{_NAMED})(?P<attrs>{_PLAIN}|{_QUOTED}|{_LOOSE})>"
    r"|</?[a-zA-Z][^<>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

#: Fixed values of HTML: elements without content of their own, and elements that end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td"
    " tfoot th thead tr ul".split()
)
#: Never content: by element, by role, and by a word of the class or id.
DROP_TAGS = frozenset("head nav header footer aside form button menu dialog label input noscript template svg select object".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements banner sponsor sponsored promo promotion promoted"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars side aside header masthead footer"
    " cookie cookies consent notice notices notification alert popup modal overlay newsletter subscribe subscription"
    " signup login share sharing social comment comments commentlist disqus replies reply respond related recommended"
    " widget widgets pagination pager toolbar copyright disclaimer".split()
)
#: Words that say where or what kind of box such an element is; a class of several words is dropped
#: if all of them are of one or the other kind (``site-header``, but not ``share-price``).
BESIDE_WORDS = frozenset(
    "site page main global top bottom left right primary secondary first last inner outer box bar list area wrap wrapper container section"
    " block panel item items link links button buttons icon icons text title slot unit units post posts article articles form toggle mobile desktop"
    " js is has the and by to a".split()
)
#: Whole-page wrappers keep what is in them, whatever their class.
KEEP_TAGS = frozenset("html body main article".split())
_CLOSES_P = BLOCK - {"body", "html"}
#: Classes and ids of elements that hold the whole of an article.
WHOLE_WORDS = frozenset("article content post entry story".split())
#: What tags cost where the labelled pages say nothing: text and its marks little, links and the rest more.
MARKS = frozenset("b i em strong u s small mark code kbd samp var sub sup span q cite abbr dfn time del ins br img wbr".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th caption pre blockquote figure figcaption".split())
MARK_COST, TEXT_COST, OTHER_COST = -0.05, -0.2, -1.0
#: Labelled tags that outweigh these costs.
FEW_TAGS = 20


def _unlabelled(name: str) -> float:
    return MARK_COST if name in MARKS else TEXT_COST if name in TEXT_TAGS else OTHER_COST


def _dropped(name: str, attrs: str, by_class: bool = True) -> bool:
    if name in DROP_TAGS:
        return True
    if not attrs or name in ("html", "body"):
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in DROP_ROLES:
            return True
        if by_class and key in ("class", "id") and any(_tells(word, name) for word in value.split()):
            return True
    return False


def _tells(word: str, name: str) -> bool:
    """Whether a class or id says that an element is no content: by itself, or with all of its parts."""
    parts = [p for p in re.split(r"[^a-z]+", word) if p]
    told = DROP_WORDS if name not in KEEP_TAGS else frozenset(("comment", "comments", "reply"))
    return any(p in told for p in parts) and all(p in told or p in BESIDE_WORDS for p in parts)


def _classes(attrs: str) -> str:
    found = [m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs or "") if m[1].lower() in ("class", "id")]
    return " ".join(found).lower()


def tokens(page: str, by_class: bool = True) -> list[tuple[str, str, str]]:
    """``(kind, name, value)``: ``open`` tags with classes and ids, ``close`` tags, and ``text`` with its nearest tag.

    Dropped elements are left out; without ``by_class`` only those dropped by name or role.
    """
    out: list[tuple[str, str, str]] = []
    stack: list[str] = []
    standing: Counter = Counter()  # open elements by name
    skip, depth = "", 0

    def unwind(name: str) -> None:
        while True:
            top = stack.pop()
            standing[top] -= 1
            if top == name:
                return

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            if not skip:
                out.append(("text", stack[-1] if stack else "", text))
            continue
        name = m["name"]
        if name is None:
            continue
        name, end = name.lower(), m["end"]
        if skip:
            if name == skip and name not in VOID:
                depth += -1 if end else 1
                if not depth:
                    skip = ""
            elif end and standing[name] and name in ("body", "html", "article", "main"):
                skip, depth = "", 0  # the dropped element was never closed
                unwind(name)
                out.append(("close", name, ""))
            continue
        if end:
            if standing[name]:
                unwind(name)
            out.append(("close", name, ""))
        elif _dropped(name, m["attrs"], by_class):
            if name not in VOID and not (name == "svg" and m["attrs"].endswith("/")):
                skip, depth = name, 1
        else:
            out.append(("open", name, _classes(m["attrs"])))
            if name not in VOID:
                if name in _CLOSES_P and stack and stack[-1] == "p":
                    unwind("p")
                stack.append(name)
                standing[name] += 1
    return out


#: Tags that are counted by name; all others are of one kind.
NAMED = BLOCK | VOID | MARKS | TEXT_TAGS | frozenset("a div section span article main body html".split())


def label_counts(page: str) -> Counter | None:
    """Counts of tags and of words by nearest tag, inside and outside of the only article; None without one."""
    found = tokens(page)
    if sum(k == "open" and n == "article" for k, n, _ in found) != 1:
        return None
    counts, inside = Counter(), False
    for kind, name, value in found:
        if name == "article" and kind != "text":
            inside = kind == "open"
            continue
        counts[("word" if kind == "text" else "tag", name if name in NAMED else "", inside)] += len(value.split()) if kind == "text" else 1
    return counts


class Weights:
    """Score per tag (negative) and per word by nearest tag (positive)."""

    def __init__(self, counts: Counter) -> None:
        self.tags: dict[str, float] = {}
        self.words: dict[str, float] = {}
        for kind, name in {(k, n) for k, n, _ in counts}:
            within, out = counts[(kind, name, True)], counts[(kind, name, False)]
            share = (within + 1) / (within + out + 2)
            if kind == "tag":
                trust = min(1.0, (within + out) / FEW_TAGS)
                self.tags[name] = -max(0.01, trust * 3 * (1 - share) - (1 - trust) * _unlabelled(name))
            else:
                self.words[name] = max(0.01, share)
        for name in ("article", "main", "body", "html"):
            self.tags[name] = -0.01

    def of(self, kind: str, name: str, value: str) -> float:
        known = name if name in NAMED else ""
        if kind == "text":
            return self.words.get(known, 0.5) * len(value.split())
        return self.tags.get(known, _unlabelled(name))


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the run with the highest sum; the first such run, empty if nothing is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, at = total, (start, i + 1)
    return at


_WHOLE = (
    lambda t: t[1] == "article",
    lambda t: t[1] == "main",
    lambda t: t[1] in ("div", "section") and bool(WHOLE_WORDS & set(re.split(r"[^a-z]+", t[2]))),
)


def _widened(found: list[tuple[str, str, str]], low: int, high: int) -> tuple[int, int]:
    """The run grown to the whole of each article, else main, else content element that it touches.

    The element of the run's first words says how far down that list later words look.
    """
    opened: list[int] = []
    standing: Counter = Counter()
    holders: tuple[list[int], ...] = ([], [], [])  # open elements by kind, outermost first
    touched: dict[int, int] = {}  # start and end of elements
    last = None
    for i, (kind, name, value) in enumerate(found):
        if kind == "open" and name not in VOID:
            opened.append(i)
            standing[name] += 1
            for held, wanted in zip(holders, _WHOLE, strict=True):
                if wanted(found[i]):
                    held.append(i)
        elif kind == "close" and standing[name]:
            while True:
                top = opened.pop()
                standing[found[top][1]] -= 1
                for held in holders:
                    if held and held[-1] == top:
                        held.pop()
                ended = found[top][1] == name
                if top in touched:
                    touched[top] = i + 1 if ended else i
                if ended:
                    break
        elif kind == "text" and low <= i < high and value.strip():
            rank = next((r for r, held in enumerate(holders) if held), None)
            if last is None:
                last = len(holders) - 1 if rank is None else rank
            if rank is not None and rank <= last:
                touched.setdefault(holders[rank][0], len(found))
    return min([low, *touched]), max([high, *touched.values()])


def blocks(found: list[tuple[str, str, str]]) -> list[str]:
    """Texts of the blocks in page order, references decoded, white space as single spaces."""
    out: list[str] = []
    parts: list[str] = []
    for kind, name, value in [*found, ("close", "body", "")]:
        if kind == "text":
            parts.append(html_lib.unescape(value))
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK:
            if text := " ".join("".join(parts).split()):
                out.append(text)
            parts = []
    return out


def extract(page: str | None, weights: Weights) -> str:
    """The main text; a page whose classes would drop all of it is read without them."""
    for by_class in (True, False):
        found = tokens(page or "", by_class)
        low, high = best_run([weights.of(*t) for t in found])
        if low < high:
            low, high = _widened(found, low, high)
            return "\n".join(blocks(found[low:high]))
    return ""


def learn(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> Weights:
    """Weights from ``sample`` different pages with one article at most, those of the lowest hashes of their html.

    What reaches the driver is a count per name in ``NAMED`` and place.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                total.update(label_counts(page.as_py()) or {})
        rows = [(*key, n) for key, n in total.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
             pa.array([r[2] for r in rows], pa.bool_()), pa.array([r[3] for r in rows], pa.int64())],
            ["kind", "name", "inside", "n"],
        )

    marked = pages.select(F.col(html_col).alias("html")).where(F.lower("html").contains("<article")).select("html", F.xxhash64("html").alias("h"))
    lowest = marked.select("h").distinct().orderBy(F.xxhash64("h"), "h").limit(sample)
    # Copies of a page are one; each task hands on a page once.
    drawn = marked.join(F.broadcast(lowest), "h", "left_semi").dropDuplicates(["h"]).select("html")
    counts = (
        drawn.mapInArrow(count, "kind string, name string, inside boolean, n bigint")
        .groupBy("kind", "name", "inside").agg(F.sum("n").alias("n"))
        .collect()
    )
    return Weights(Counter({(r["kind"], r["name"], r["inside"]): r["n"] for r in counts}))


def extract_pages(pages: DataFrame, weights: Weights, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``'s columns, ``text`` and ``n_chars`` per row of ``pages``; a kept column with one of these names is left out."""
    keep = tuple(c for c in keep if c.lower() not in ("text", "n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py(), weights) for page in batch.column(batch.num_columns - 1)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), sizes], [*batch.schema.names[:-1], "text", "n_chars"]
            )

    chosen = pages.select(*keep, F.col(html_col).alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{schema}, text string, n_chars bigint")

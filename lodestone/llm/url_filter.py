"""URL filters by allow and block rules and a path-template tree (DataFrame functions only).

Rules judge first: of those that fit a url's host and path the longest wins. For the rest
every host has a tree of path segments. Segments that vary become wildcards: those with
digits by their form (an extension stays), others where a node has very many different
children of which each is rare. Then sibling branches that are statistically alike are merged
into one: what follows below them is spread alike, and the labels that rules give their urls
do not differ, both by chi-squared tests of the branch against its siblings below which the
same segment is the most frequent. A branch that no
rule judges so shares the labels of siblings with the same structure, and a template is
rejected where its smoothed share of blocked among labelled urls is high enough.

The tree is built from distinct (host, segments) with counts, level by level with
aggregates and joins on keys, for as many levels as paths still branch on; a path that is
alone below its node is done. A host with a third of all pages is as many rows as it has
different generalised paths, pre-aggregated before they move; sums by node are written before
they are joined back, so small ones are broadcast by their size and a hot node's join can be split.

Defined cases: null urls and urls without ``://`` have empty host and path, which is a host
like any other; empty segments don't count; repeated rows count; a template without labels is
allowed; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.durable import durable

#: (verdict, host and path prefix)
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: A node with so many children has its rare ones (below this share) generalised.
MANY, RARE = 20, 0.05
#: Standard normal deviate of the tests' 95th percentile; a spread that is smaller than
#: ``EFFECT`` (chi-squared by url) is none, however many urls show it.
DEVIATE, EFFECT = 1.645, 0.02
#: Purity is (blocked + STRENGTH / 2) / (labelled + STRENGTH); templates from REJECT on go.
STRENGTH, REJECT = 10.0, 0.9

_ANY, _KEY = "*", "\u0001"


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(u, r"(?s)\A.*?://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, else null."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        what = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, what) if found is None else found.when(fits, what)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def segments(path: Column) -> Column:
    """The segments; those with digits are wildcards that keep an extension."""
    own = F.filter(F.split(path, "/"), lambda s: s != "")
    ending = lambda s: F.concat(F.lit(_ANY), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1))
    return F.transform(own, lambda s: F.when(s.rlike("[0-9]"), ending(s)).otherwise(s))


def critical(freedom: Column) -> Column:
    """The 95th percentile of chi-squared, by the cube-root approximation."""
    part = F.lit(2.0) / (F.lit(9.0) * freedom)
    return freedom * F.pow(F.lit(1.0) - part + F.lit(DEVIATE) * F.sqrt(part), F.lit(3.0))


def _placed(paths: DataFrame, d: int) -> DataFrame:
    """``paths`` with their node ``at`` level ``d``, its child ``seg``, and ``kids``: null below nodes that no other path goes on from."""
    placed = paths.withColumn("at", F.array_join(F.slice("to", 1, d), _KEY) if d else F.lit("")).withColumn("seg", F.get("to", F.lit(d)))
    # By segment first, so that a node with very many paths is not one task's.
    kids = placed.groupBy("host", "at", "seg").agg(F.count(F.lit(1)).alias("paths"))
    nodes = kids.groupBy("host", "at").agg(F.sum("paths").alias("paths"), F.count("seg").alias("kids")).where("paths > 1")
    return placed.join(durable(nodes.drop("paths"), "nodes"), ["host", "at"], "left")


def _replaced(d: int, where: Column) -> Column:
    return F.transform("to", lambda s, i: F.when(where & (i == d), F.lit(_ANY)).otherwise(s))


def _swept(tree: DataFrame, change, label: str) -> DataFrame:
    """``change(met, d)`` (``host, at, seg`` that become wildcards) applied from the root down; a path that is done moves no more."""
    own, d, done = tree.columns, 0, []
    going = durable(tree, label)
    while not done or not going.isEmpty():
        met = durable(_placed(going, d), "met")
        varied = change(met.where("kids is not null"), d).select("host", "at", "seg", F.lit(True).alias("varies"))
        moved = met.join(varied, ["host", "at", "seg"], "left").withColumn("to", _replaced(d, F.coalesce("varies", F.lit(False))))
        moved = durable(moved.select(*own, (F.col("kids").isNotNull() & (F.size("to") > d + 1)).alias("open")), label)
        done.append(moved.where("not open").select(*own))
        going, d = moved.where("open").select(*own), d + 1
    return reduce(DataFrame.unionByName, done)


def _rare(met: DataFrame, d: int) -> DataFrame:
    """Children of nodes with very many, each of them rare."""
    counted = met.where("seg is not null").groupBy("host", "at", "seg").agg(F.sum(F.col("a") + F.col("b") + F.col("n")).alias("c"))
    nodes = durable(counted.groupBy("host", "at").agg(F.count(F.lit(1)).alias("all_kids"), F.sum("c").alias("all")).where(F.col("all_kids") >= MANY), "many")
    named = counted.where(~F.startswith("seg", F.lit(_ANY)))
    return named.join(nodes, ["host", "at"]).where(F.col("c") < F.col("all") * RARE)


def _alike(met: DataFrame, d: int) -> DataFrame:
    """Branches that are like the siblings of their sort: in what follows below them, and in labels where both have some.

    Siblings are of a sort where the same segment is the most frequent below them.
    """
    cells = met.where("seg is not null").groupBy("host", "at", "seg", F.coalesce(F.get("to", F.lit(d + 1)), F.lit("")).alias("kid")).agg(
        *[F.sum(x).alias(x) for x in "ab"], F.sum(F.col("a") + F.col("b") + F.col("n")).alias("c")
    )
    tops = cells.groupBy("host", "at", "seg").agg(F.max(F.struct("c", "kid"))["kid"].alias("top"))
    below = durable(cells.join(tops, ["host", "at", "seg"]).withColumn("at", F.struct("at", "top")), "sorted")
    branches = below.groupBy("host", "at", "seg").agg(*[F.sum(x).alias(x) for x in ("a", "b", "c")])
    kinds = durable(below.groupBy("host", "at", "kid").agg(F.sum("c").alias("all_kid")), "kinds")
    freedom = kinds.groupBy("host", "at").agg((F.count(F.lit(1)) - 1).cast("double").alias("freedom"))
    sums = branches.groupBy("host", "at").agg(*[F.sum(x).alias("all_" + x) for x in ("a", "b", "c")], F.count(F.lit(1)).alias("branches")).where("branches > 1")
    nodes = durable(sums.join(freedom, ["host", "at"]), "nodes")
    rest, own = F.col("all_c") - F.col("c"), F.col("c")
    cells = (
        below.select("host", "at", "seg", "kid", F.col("c").alias("got")).join(kinds, ["host", "at", "kid"])
        .join(branches.select("host", "at", "seg", "c"), ["host", "at", "seg"]).join(nodes, ["host", "at"])
    )
    # Two samples' chi-squared: sum of (own * sqrt(rest/own) - others * sqrt(own/rest))^2 / all; kids that a branch lacks add all * own/rest.
    gap = F.col("got") * F.sqrt(rest / own) - (F.col("all_kid") - F.col("got")) * F.sqrt(own / rest)
    spread = cells.groupBy("host", "at", "seg").agg(
        F.sum(gap * gap / F.col("all_kid")).alias("met"), F.sum("all_kid").alias("seen")
    )
    chi = F.col("met") + (F.col("all_c") - F.col("seen")) * own / rest
    a, b, all_a, all_b = (F.col(x).cast("double") for x in ("a", "b", "all_a", "all_b"))
    labelled, others = a + b, all_a + all_b - a - b
    cross, margins = a * (all_b - b) - b * (all_a - a), labelled * others * all_a * all_b
    told = F.when(margins > 0, cross * cross * (labelled + others) / margins).otherwise(0.0)
    same = lambda x, size, freedom: (x < critical(freedom)) | (x < F.lit(EFFECT) * size)
    return (
        branches.join(nodes, ["host", "at"]).join(spread, ["host", "at", "seg"])
        .where((F.col("freedom") < 1) | same(chi, F.col("all_c"), F.col("freedom")))
        .where(same(told, labelled + others, F.lit(1.0)))
        .withColumn("at", F.col("at.at"))
    )


def template_tree(paths: DataFrame) -> DataFrame:
    """``host, segs, to`` (the template): ``paths`` has ``host, segs, a, b, n`` counts by label."""
    general = _swept(paths.withColumn("to", F.col("segs")), _rare, "general")
    return _swept(general, _alike, "merged")


def judge(pages: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, keep: Sequence[str] = ()) -> DataFrame:
    """``keep``'s columns and ``host, path, rule, verdict, template, purity`` per row of ``pages``.

    A kept column with the name of one of these is left out.
    """
    keep = [c for c in keep if c.lower() not in ("host", "path", "rule", "verdict", "template", "purity")]
    host, path = host_and_path(F.col(url_col))
    read = pages.select(F.struct(*keep).alias("kept") if keep else F.lit(None).alias("kept"), host.alias("host"), path.alias("path"))
    ruled = read.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules)).withColumn("segs", segments(F.col("path")))
    label = F.col("ruled.verdict")
    paths = ruled.groupBy("host", "segs").agg(
        F.count_if(label == "allow").alias("a"),
        F.count_if(label == "block").alias("b"),
        F.count_if(label.isNull()).alias("n"),
    )
    tree = template_tree(paths)
    shares = durable(tree.groupBy("host", "to").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")), "shares")
    purity = (F.col("tb") + STRENGTH / 2) / (F.col("ta") + F.col("tb") + STRENGTH)
    verdicts = durable(
        tree.join(shares, ["host", "to"]).select(
            F.col("host").alias("h"), F.col("segs").alias("s"),
            F.concat(F.lit("/"), F.array_join("to", "/")).alias("template"),
            purity.alias("purity"),
        ),
        "verdicts",
    )
    joined = ruled.join(verdicts, (F.col("host") == F.col("h")) & (F.col("segs") == F.col("s")))
    verdict = F.coalesce(label, F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return joined.select(
        *(["kept.*"] if keep else []), "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), "template", "purity"
    )

"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Every source has a target in words. A document's expected number of copies is its
source's target over its source's words (times its own relative weight, if one is
given). The whole part of that number is certain; the fraction is the probability
``p`` with which the document wins one more copy. Winners are drawn by Pareto order
sampling: with ``u`` uniform, documents are ranked by ``(u / (1 - u)) / (p / (1 - p))``
and the head of the ranking is taken until the source's words are used up. The
document at the cut would mostly overshoot, so up to ``FILLS`` that are left out and fit
the rest best are taken in its place.

Defined cases: null text has size 0; a null source is a source of its own, last in
order; a source without words has target 0; rows of one id and source win or lose together
and are drawn with the words of all of them, a row with a null id has its text's digest for
an id; a source whose certain copies use up its target takes nobody more; an empty table
gives an empty result. ``u`` comes from a digest of the id, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.durable import durable
from lodestone.plans.ordered import global_rank

WORD = r"[^\x20\x09-\x0D]+"
#: Slices of the ranking of one source; only one slice per source is sorted.
SLICES = 4096
#: Documents that fill up what the cut leaves of a source's target.
FILLS = 4


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on ``key`` and ``seed`` alone: 52 bits of MD5."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(
    sized: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, max_repeat: int = 3
) -> DataFrame:
    """One row per source: ``source, source_size, target``.

    Targets share ``share`` of all words by weight, none above ``max_repeat`` times
    its source's words; what is cut off is shared again by weight among the rest
    until none is above. Each round is one aggregate over the sources.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(totals, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = durable(
        ranked.select("source", "source_size", weight.cast("long").alias("w"))
        .withColumn("cap", F.col("source_size") * int(max_repeat)),
        "sources",
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget = total if share == 1.0 else total * share
    # Sources are filled up from the lowest cap per weight; `level` is what all reach.
    filled, left, open_weight = -1.0, budget, None
    while True:
        row = sources.agg(
            F.sum(F.when(F.col("cap") / F.col("w") <= F.lit(float(filled)), F.col("cap")).otherwise(0)).alias("c"),
            F.sum(F.when(F.col("cap") / F.col("w") <= F.lit(float(filled)), 0).otherwise(F.col("w"))).alias("w"),
        ).first()
        left, open_weight = budget - (row["c"] or 0), row["w"] or 0
        if not open_weight:
            break
        level = left / open_weight
        if level <= filled:
            break
        higher = sources.where(
            (F.col("cap") / F.col("w") > F.lit(float(filled))) & (F.col("cap") / F.col("w") <= F.lit(float(level)))
        ).agg(F.max(F.col("cap") / F.col("w"))).first()[0]
        if higher is None:
            break
        filled = higher
    if open_weight:
        open_target = F.col("w").cast("double") * F.lit(float(left)) / F.lit(float(open_weight))
    else:
        open_target = F.col("cap").cast("double")
    return sources.select(
        "source",
        "source_size",
        F.when(F.col("cap") / F.col("w") <= F.lit(float(filled)), F.col("cap").cast("double"))
        .otherwise(open_target)
        .alias("target"),
    )


def _with_odds(sized: DataFrame, targets: DataFrame, max_repeat: int) -> DataFrame:
    """Adds ``whole`` (certain copies) and ``q`` (place in the ranking; null: no more copy)."""
    t = targets.select(
        F.col("source").alias("__source"),
        *[F.col(c) for c in targets.columns if c != "source"],
    )
    joined = sized.join(t, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    expected = F.when(
        F.col("source_size") > 0,
        F.least(F.lit(float(max_repeat)), F.col("target") / F.col("source_size") * F.col("rel")),
    ).otherwise(F.lit(0.0))
    p = F.col("__e") - F.floor("__e")
    return (
        joined.withColumn("__e", expected)
        .withColumn("whole", F.floor("__e").cast("long"))
        .withColumn("q", F.when(p > 0, (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))))
        .drop("__e")
    )


def draw(sized: DataFrame, targets: DataFrame, max_repeat: int = 3) -> DataFrame:
    """Adds to ``targets`` where each source's ranking is cut and which document fills the rest.

    ``sized`` has ``id, source, size, rel, u``. A source's ranking is summed in
    slices first; only the slice that holds the cut is sorted, so a source with a
    third of all rows is never in one task.
    """
    odds = _with_odds(sized, targets, max_repeat)
    certain = odds.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    rest = (
        targets.select(F.col("source").alias("s1"), *[c for c in targets.columns if c != "source"])
        .join(certain, F.col("s1").eqNullSafe(F.col("source")), "left")
        .select("s1", "source_size", "target", (F.col("target") - F.coalesce("certain", F.lit(0))).alias("rest"))
    )
    # Rows of one id are one ticket with the words of all.
    tickets = durable(odds.where("q is not null").groupBy("source", "q", "id").agg(F.sum("size").alias("size")), "tickets")
    lottery = tickets.withColumn("slice", F.floor(F.col("q") / (1 + F.col("q")) * SLICES).cast("int"))
    slices = lottery.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cut_slice = (
        slices.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(rest.select("s1", "rest"), F.col("source").eqNullSafe(F.col("s1")))
        .where((F.col("base") <= F.col("rest")) & (F.col("base") + F.col("words") > F.col("rest")))
        .groupBy("s1")
        .agg(F.min("slice").alias("at"), F.min_by("base", "slice").alias("base"), F.min("rest").alias("rest"))
    )
    cut_slice = durable(cut_slice, "cut")
    inside = Window.partitionBy("source").orderBy("q", "id").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        lottery.join(cut_slice, F.col("source").eqNullSafe(F.col("s1")) & (F.col("slice") == F.col("at")))
        .withColumn("run", F.col("base") + F.sum("size").over(inside))
        .where(F.col("run") > F.col("rest"))
        .groupBy(F.col("source").alias("s2"))
        .agg(F.min(F.struct("q", "id")).alias("cut"))
    )
    # Without a cut everybody is taken, or nobody where the certain copies are too much already.
    params = durable(
        rest.join(cut, F.col("s1").eqNullSafe(F.col("s2")), "left").drop("s2").withColumnRenamed("s1", "source")
        .withColumn("everybody", F.col("cut").isNull() & (F.col("rest") >= 0)),
        "draw",
    )
    p = params.select(F.col("source").alias("s3"), "rest", "cut", "everybody")
    at = lottery.join(p, F.col("source").eqNullSafe(F.col("s3"))).withColumn("me", F.struct("q", "id"))
    inside_cut = F.col("everybody") | F.coalesce(F.col("me") < F.col("cut"), F.lit(False))
    none = F.array().cast(f"array<struct<q:double,id:{sized.schema['id'].dataType.simpleString()}>>")
    state = durable(
        at.groupBy(F.col("s3").alias("s4"))
        .agg((F.max("rest") - F.sum(F.when(inside_cut, F.col("size")).otherwise(0))).alias("gap"))
        .withColumn("fills", none),
        "gaps",
    )
    for last in [False] * (FILLS - 1) + [True]:
        # The largest document that fits; in the end the one that comes nearest either way.
        off = F.abs(F.col("size") - F.col("gap"))
        best = (
            at.where(~inside_cut & (F.col("size") > 0))
            .join(state, F.col("source").eqNullSafe(F.col("s4")))
            .where(~F.array_contains("fills", F.col("me")) & ((off < F.col("gap")) if last else (F.col("size") <= F.col("gap"))))
            .groupBy(F.col("s4").alias("s5"))
            .agg(F.min(F.struct(off.alias("off"), F.col("me"), F.col("size"))).alias("best"))
        )
        state = durable(
            state.join(best, F.col("s4").eqNullSafe(F.col("s5")), "left").select(
                "s4",
                (F.col("gap") - F.coalesce("best.size", F.lit(0))).alias("gap"),
                F.when(F.col("best").isNull(), F.col("fills")).otherwise(F.concat("fills", F.array("best.me"))).alias("fills"),
            ),
            "gaps",
        )
    return (
        params.join(state, F.col("source").eqNullSafe(F.col("s4")), "left")
        .select("source", "source_size", "target", "cut", "everybody", "fills")
    )


def take(sized: DataFrame, drawn: DataFrame, max_repeat: int = 3) -> DataFrame:
    """``sized`` with ``source_size, target, copies``; the draw's table is one row per source."""
    me = F.struct("q", "id")
    won = F.col("q").isNotNull() & (
        F.col("everybody") | F.coalesce(me < F.col("cut"), F.lit(False)) | F.coalesce(F.array_contains("fills", me), F.lit(False))
    )
    return (
        _with_odds(sized, drawn, max_repeat)
        .withColumn("copies", F.col("whole") + won.cast("long"))
        .drop("cut", "everybody", "fills", "q", "whole")
    )


def sized_documents(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weight_col: str | None = None, seed: str = "mix-1", keep: Sequence[str] = (),
) -> DataFrame:
    """``id, own_id, source, size, rel, u`` of every document, and the columns in ``keep`` as they are; ``id`` names a ticket."""
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text|"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    rel = F.lit(1.0) if weight_col is None else F.greatest(F.lit(0.0), F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)))
    return docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("kept") if keep else F.lit(None).cast("string").alias("kept"),
        name.alias("id"),
        F.col(id_col).alias("own_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        rel.alias("rel"),
        uniform(name, seed).alias("u"),
    )


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: Sequence[int] = (5, 2, 1), share: float = 1.0, max_repeat: int = 3,
    weight_col: str | None = None, seed: str = "mix-1", keep: Sequence[str] = (),
) -> DataFrame:
    """``id, size, source_size, target, copies, taken`` per document, or these with ``keep``'s columns.

    A kept column with the name of one of these is left out.

    ``weight_col``: relative odds of a document inside its source (mean 1 by words).
    Texts are read once for their sizes; what is drawn from is ids and numbers.
    """
    columns = ["size", "source_size", "target", "copies", "taken"]
    keep = [c for c in keep if c.lower() not in columns]
    sized = durable(
        sized_documents(docs, id_col, source_col, text_col, weight_col, seed).drop("kept"), "sizes"
    )
    if weight_col is not None:
        mean = sized.groupBy(F.col("source").alias("s0")).agg(
            (F.sum(F.col("rel") * F.col("size")) / F.sum("size")).alias("mean")
        )
        sized = durable(
            sized.join(mean, F.col("source").eqNullSafe(F.col("s0")))
            .withColumn("rel", F.when(F.col("mean") > 0, F.col("rel") / F.col("mean")).otherwise(0.0))
            .drop("s0", "mean"),
            "weighted",
        )
    drawn = durable(draw(sized, source_targets(sized, weights, share, max_repeat), max_repeat), "drawn")
    if keep:
        if weight_col is not None:
            raise ValueError("keep goes with equal weights inside a source")
        full = sized_documents(docs, id_col, source_col, text_col, None, seed, keep)
    else:
        full = sized
    out = take(full, drawn, max_repeat).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("kept.*", *columns) if keep else out.select(F.col("own_id").alias(id_col), *columns)

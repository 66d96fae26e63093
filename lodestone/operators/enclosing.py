"""Points to the innermost interval around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.durable import durable


def _cells(start: Column, end: Column) -> Column:
    """The fewest aligned cells ``(level, cell)``, each 2^level long, that make up ``[start, end)``; at most two a level.

    At a level the cells that fit run from ``first`` to before ``after``; the one at either edge
    that is no left or right half of a fitting larger one stays, all others go up a level.
    """
    half = lambda x, k: F.call_function("shiftright", x, k)

    def at(k: Column) -> Column:
        first, after = -half(-start, k), half(end, k)
        odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
        cell = lambda x: F.struct(k.alias("level"), x.alias("cell"))
        edges = F.array(F.when(odd(first), cell(first)), F.when(odd(after), cell(after - 1)))
        return F.when(first < after, F.array_compact(edges))

    levels = F.sequence(F.lit(0), F.length(F.bin(end - start)) - 1)
    return F.when(end > start, F.flatten(F.filter(F.transform(levels, at), lambda found: found.isNotNull())))


#: Symbols, and points, of a file that meet each other directly; a file with more spreads over its cells.
FEW_SYMBOLS, FEW_POINTS = 64, 100_000


def _by_file(points: DataFrame, placed: DataFrame, file: str) -> DataFrame:
    """Points to the innermost symbol of their file, where a file has few: both are dealt by file, and stay there."""
    around = (F.col(file) == F.col("__file")) & (F.col("start") <= F.col("pos")) & (F.col("pos") < F.col("end"))
    inner = F.when(F.col("__file").isNotNull(), F.struct("start", (-F.col("end")).alias("e"), "symbol_id"))
    return points.join(placed, around, "left").groupBy(file, "point_id", "pos").agg(F.max(inner).alias("best"))


def _by_cells(points: DataFrame, placed: DataFrame, file: str) -> DataFrame:
    """The same through aligned cells, whatever the numbers of points and symbols of a file."""
    best = (
        placed.withColumn("c", F.explode(_cells(F.col("start").cast("long"), F.col("end").cast("long"))))
        .groupBy("__file", F.col("c.level").alias("__level"), F.col("c.cell").alias("__cell"))
        .agg(F.max(F.struct("start", (-F.col("end")).alias("e"), "symbol_id")).alias("__best"))
    )
    longest = placed.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0  # one number
    levels = range(max(int(longest), 1).bit_length())
    pos = F.col("pos").cast("long")
    asked = points.distinct().withColumn("c", F.explode(F.array(*[
        F.struct(F.lit(k).alias("level"), F.shiftright(pos, k).alias("cell")) for k in levels
    ])))
    met = asked.join(best, (F.col(file) == F.col("__file")) & (F.col("c.level") == F.col("__level")) & (F.col("c.cell") == F.col("__cell")), "left")
    return met.groupBy(file, "point_id", "pos").agg(F.max("__best").alias("best"))


def enclosing_symbol(points: DataFrame, symbols: DataFrame, file: str = "path", few_symbols: int = FEW_SYMBOLS, few_points: int = FEW_POINTS) -> DataFrame:
    """``points`` (``path, point_id, pos``) with ``symbol_id`` of the innermost ``[start, end)`` around ``pos``, or null.

    Of symbols around a point the last in order of start, then of falling end, then of id is the
    innermost; they need not be nested. Files are counted first. In one with few symbols and
    points every point meets the symbols of its file, and both are moved once. In any other
    a symbol is cut into aligned cells, two at most for each power of two in its length, and a
    cell keeps its innermost symbol only; a point asks for the one cell around it at each level,
    so it meets a row a level and not every symbol of its file, and such a file spreads over its cells.

    Points without a position and symbols that are empty, reversed or without an end meet nothing;
    a null file meets no other; repeated points are one.
    """
    points = points.select(file, "point_id", "pos")
    placed = symbols.where(F.col("start") < F.col("end")).select(F.col(file).alias("__file"), "symbol_id", "start", "end")
    counted = (
        points.select(F.col(file).alias("__many"), F.lit(0).alias("symbol")).unionByName(placed.select(F.col("__file").alias("__many"), F.lit(1).alias("symbol")))
        .groupBy("__many").agg(F.sum("symbol").alias("symbols"), F.sum(1 - F.col("symbol")).alias("points"))
    )
    full = (F.col("symbols") > few_symbols) | (F.col("points") > few_points)
    many = durable(counted.where(full).select("__many"), "many")
    if many.isEmpty():
        met = _by_file(points, placed, file)
    else:
        here, there = F.col(file).eqNullSafe(F.col("__many")), F.col("__file") == F.col("__many")
        few = _by_file(points.join(many, here, "left_anti"), placed.join(many, there, "left_anti"), file)
        met = few.unionByName(_by_cells(points.join(many, here, "left_semi"), placed.join(many, there, "left_semi"), file))
    return met.select(file, "point_id", "pos", F.col("best.symbol_id").alias("symbol_id"))

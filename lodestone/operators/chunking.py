"""Greedy chunks of consecutive units under a token limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TOKENS = 800


def chunk_bounds(tokens: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """``array<struct<first, last, tokens>>`` (units from 1): a unit that would pass the limit starts a chunk.

    One ordered fold per row over token counts; a chunk is written down when it ends.
    """
    done = F.array().cast("array<struct<first:int,last:int,tokens:bigint>>")
    zero = F.struct(done.alias("done"), F.lit(1).alias("first"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("sum"))

    def step(acc: Column, t: Column) -> Column:
        full = (acc["sum"] + t > max_tokens) & (acc["at"] >= acc["first"])
        ended = F.struct(acc["first"].alias("first"), acc["at"].alias("last"), acc["sum"].alias("tokens"))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(ended))).otherwise(acc["done"]).alias("done"),
            F.when(full, acc["at"] + 1).otherwise(acc["first"]).alias("first"),
            (acc["at"] + 1).alias("at"),
            F.when(full, t.cast("long")).otherwise(acc["sum"] + t).alias("sum"),
        )

    def finish(acc: Column) -> Column:
        ended = F.struct(acc["first"].alias("first"), acc["at"].alias("last"), acc["sum"].alias("tokens"))
        return F.when(acc["at"] >= acc["first"], F.concat(acc["done"], F.array(ended))).otherwise(acc["done"])

    return F.aggregate(tokens, zero, step, finish)


def chunk_units(rows: DataFrame, key: str, units: Column, tokens: Column, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``key, chunk, first, last, token_estimate, text`` per chunk of each row's units."""
    cut = rows.select(key, units.alias("__units"), tokens.alias("__tokens")).select(
        key, "__units", F.posexplode(chunk_bounds(F.col("__tokens"), max_tokens)).alias("chunk", "c")
    )
    return cut.select(
        key, "chunk", "c.first", "c.last", F.col("c.tokens").alias("tokens"),
        F.array_join(F.slice("__units", F.col("c.first"), F.col("c.last") - F.col("c.first") + 1), "\n").alias("text"),
    )

"""Which texts contain which patterns, without comparing every text with every pattern."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store

# Letters of the pieces by which texts and patterns meet.
PIECE = 4
# Texts times patterns of one ledger that are compared directly. Cutting so few into pieces costs more than comparing them.
DIRECT_MOST = 10_000


def pieces(value: Column, width: int = PIECE) -> Column:
    """The different pieces of `width` letters of a text; none if it is shorter."""
    starts = F.sequence(F.lit(1), F.length(value) - (width - 1))
    return F.when(F.length(value) >= width, F.array_distinct(F.transform(starts, lambda i: F.substring(value, i, F.lit(width)))))


def containing(texts: DataFrame, patterns: DataFrame, text: str, pattern: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, text, pattern): every different text with every different pattern of the same keys that it contains.

    Keys of few texts and patterns compare them as they are; elsewhere a pattern meets texts by pieces. Null and empty
    patterns, and null texts, are in no pair, nor is a null key.
    """
    keys = list(keys)
    texts = texts.select(*keys, F.col(text).alias("whole")).filter("whole <> ''").distinct()
    patterns = patterns.select(*keys, F.col(pattern).alias("part")).filter("part <> ''").distinct()
    if keys:
        texts, patterns = store(texts), store(patterns)
        # A stored table is far smaller than its rows in memory, so its size must not make the planner broadcast it.
        sizes = texts.groupBy(*keys).agg(F.count("*").alias("n_texts")).join(
            patterns.groupBy(*keys).agg(F.count("*").alias("n_parts")).hint("merge"), keys)
        large = sizes.filter(F.col("n_texts") * F.col("n_parts") > DIRECT_MOST).select(*keys)
        if large.isEmpty():
            found = _direct(texts, patterns, keys)
        else:
            large = store(large)
            found = _direct(texts.join(large, keys, "left_anti"), patterns.join(large, keys, "left_anti"), keys).unionByName(
                _by_pieces(texts.join(large, keys, "left_semi"), patterns.join(large, keys, "left_semi"), keys))
    else:
        found = _by_pieces(texts, patterns, keys)
    return found.select(*keys, F.col("whole").alias(text), F.col("part").alias(pattern))


def _direct(texts: DataFrame, patterns: DataFrame, keys: list[str]) -> DataFrame:
    return texts.join(patterns.hint("merge"), keys).filter(F.contains("whole", "part")).select(*keys, "whole", "part")


def _by_pieces(texts: DataFrame, patterns: DataFrame, keys: list[str]) -> DataFrame:
    """A pattern meets the texts that hold its rarest piece, so a piece that many texts share costs nothing where a pattern
    has a better one; what meets is verified. A pattern shorter than a piece is looked up among the texts' pieces of its
    own length."""
    long_parts = patterns.filter(F.length("part") >= PIECE)
    held = texts.select(*keys, "whole", F.explode(pieces(F.col("whole"))).alias("piece"))
    wanted = long_parts.select(*keys, "part", F.explode(pieces(F.col("part"))).alias("piece"))
    often = held.join(wanted.select(*keys, "piece").distinct(), [*keys, "piece"], "left_semi").groupBy(*keys, "piece").agg(F.count("*").alias("n"))
    # A piece in no text settles that its pattern is in none.
    rare = wanted.join(often, [*keys, "piece"], "left").groupBy(*keys, "part").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("rare")).filter("rare.n > 0")
    met = held.join(rare.select(*keys, "part", F.col("rare.piece").alias("piece")), [*keys, "piece"]).filter(F.contains("whole", "part"))
    found = met.select(*keys, "whole", "part")

    short_parts = patterns.filter(F.length("part") < PIECE)
    bits = F.flatten(F.array_compact(F.array(*[pieces(F.col("whole"), width) for width in range(1, PIECE)])))
    short = texts.select(*keys, "whole", F.explode(bits).alias("part")).join(short_parts, [*keys, "part"]).select(*keys, "whole", "part")
    return found.unionByName(short)

"""Context windows: arrays are cut in the JVM; no self-join, so that a frequent word isn't a skewed key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = "dddddd"


def skipgrams(sentences: DataFrame, key: str, tokens: str, width: Column | int) -> DataFrame:
    """key, centre, context: pairs within `width` positions of a sentence, the centre itself left out."""
    w = F.lit(width) if isinstance(width, int) else width
    each = sentences.withColumn("_w", w).select(key, "_w", F.col(tokens).alias("_t"), F.posexplode(tokens).alias("_i", "centre"))
    around = F.expr("concat(slice(_t, greatest(_i - _w, 0) + 1, least(_i, _w)), slice(_t, _i + 2, _w))")
    return each.select(key, "centre", F.explode(around).alias("context"))


def random_width(window: int, *keys) -> Column:
    """A width from 1 to window, by the keys."""
    return (F.lit(window) - F.pmod(F.xxhash64(*keys), F.lit(window))).cast("int")


def around(tokens: str, start: str, length: str, width: int, more_right: int = 0, keep: bool = False) -> Column:
    """The tokens left and right of a span that begins at `start` (from 0); with the span itself if keep."""
    left = f"slice({tokens}, greatest({start} - {width}, 0) + 1, least({start}, {width}))"
    right = f"slice({tokens}, {start} + {length} + 1, {width + more_right})"
    middle = f"slice({tokens}, {start} + 1, {length}), " if keep else ""
    return F.expr(f"concat({left}, {middle}{right})")


def filtered(tokens: Column, words: Column | None, stop: Column | None) -> Column:
    """Tokens that are words, no stop words and no number; with neither list, all."""
    if words is None or stop is None:
        return tokens
    return F.filter(tokens, lambda x: F.array_contains(words, x) & ~F.array_contains(stop, x) & (x != NUMBER))


def keeping_anchor(tokens: str, start: str, length: str, width: int, anchor: Column) -> Column:
    """The window with the span as one token, the anchor's own; null where that is null or nothing is beside it."""
    left, right = F.expr(f"slice({tokens}, greatest({start} - {width}, 0) + 1, least({start}, {width}))"), F.expr(f"slice({tokens}, {start} + {length} + 1, {width})")
    whole = F.concat(left, F.array(anchor), right)
    return F.when(anchor.isNotNull() & (F.size(whole) > 1), whole)

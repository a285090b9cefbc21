"""Answer quality: overlap of the tokens of two texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_f1(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``(key, f1)`` over the lower-cased, blank-separated tokens, repeats counted."""

    def tokens(c: str, side: int) -> DataFrame:
        return pairs.select(key, F.explode(F.split(F.lower(c), " ")).alias("w"), F.lit(side).alias("side"))

    counts = tokens(a, 0).union(tokens(b, 1)).groupBy(key, "w").agg(F.count_if(F.col("side") == 0).alias("x"), F.count_if(F.col("side") == 1).alias("y"))
    return counts.groupBy(key).agg((2.0 * F.sum(F.least("x", "y")) / (F.sum("x") + F.sum("y"))).alias("f1"))

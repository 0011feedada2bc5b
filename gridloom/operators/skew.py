"""Joins of many rows to per-key information when one key may hold a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

HOT_ROWS = 5_000_000  # rows that one task should meet of a key


def join_spread(
    rows: DataFrame, info: DataFrame, counts: DataFrame, key: str, spread: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Inner join on ``key``; a key of n rows is spread over n / ``hot_rows`` copies of its information.

    ``counts`` is ``(key, n)``. Keys that are spread have at least ``hot_rows`` rows
    each, so a trillion rows have 200,000 of them at most: few enough to broadcast.
    """
    hot = F.broadcast(counts.filter(F.col("n") > hot_rows).select(key, F.ceil(F.col("n") / hot_rows).alias("_ways")))
    salted = rows.join(hot, key, "left").withColumn(
        "_way", F.when(F.col("_ways").isNotNull(), F.pmod(F.xxhash64(*spread), F.col("_ways"))).otherwise(F.lit(0).cast("bigint"))
    )
    copies = info.join(hot, key, "left").withColumn(
        "_way", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_ways"), F.lit(1)).cast("bigint") - 1))
    )
    return salted.drop("_ways").join(copies.drop("_ways"), [key, "_way"]).drop("_way")

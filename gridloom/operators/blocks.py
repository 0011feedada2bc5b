"""Ordered work inside groups that may hold a third of all rows.

A window over one hot group is one task. Here every group is cut into blocks of
its integer position, so a window never sees more than ``BLOCK`` rows: rows are
numbered inside their block, blocks inside their super-block, super-blocks
inside the group, and the small per-block totals are joined back on the block.
Rows are in tasks by block then, so totals come to them: left to itself, Spark
sends all rows to every task where their files are small by good compression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 1 << 16


def block_of(pos: Column | str, block: int = BLOCK) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / block).cast("bigint")


def _prefix(df: DataFrame, keys: Sequence[str], pos: str, value: Column, out: str, block: int, levels: int) -> DataFrame:
    df = df.withColumn("_v", value)
    if levels == 0:
        window = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum("_v").over(window)).drop("_v")
    level = f"_b{levels}"
    df = df.withColumn(level, block_of(pos, block))
    inner = [*keys, level]
    totals = df.groupBy(*inner).agg(F.sum("_v").alias("_total"))
    before = _prefix(totals, keys, level, F.col("_total"), "_upto", block, levels - 1).select(
        *inner, (F.col("_upto") - F.col("_total")).alias("_before")
    )
    window = Window.partitionBy(*inner).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_local", F.sum("_v").over(window))
        .join(before.hint("merge"), inner)
        .withColumn(out, F.col("_local") + F.col("_before"))
        .drop("_v", "_local", "_before", level)
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], pos: str, value: Column, out: str, block: int = BLOCK, levels: int = 2
) -> DataFrame:
    """Inclusive running sum of ``value`` in each group of (non-null) ``keys``.

    ``pos`` is an integer, unique in its group; gaps are fine.
    """
    return _prefix(df, keys, pos, value, out, block, levels)


def numbered(df: DataFrame, keys: Sequence[str], pos: str, out: str, **kwargs) -> DataFrame:
    """Dense numbers 1, 2, … in each group, by integer ``pos``."""
    return running_sum(df, keys, pos, F.lit(1), out, **kwargs)


def next_position(df: DataFrame, keys: Sequence[str], pos: str, out: str, block: int = BLOCK) -> DataFrame:
    """The next ``pos`` of the group, null after its last one."""
    df = df.withColumn("_blk", block_of(pos, block))
    inner = [*keys, "_blk"]
    firsts = df.groupBy(*inner).agg(F.min(pos).alias("_first"))
    following = firsts.select(
        *inner, F.lead("_first").over(Window.partitionBy(*keys).orderBy("_blk")).alias("_following")
    )
    here = F.lead(pos).over(Window.partitionBy(*inner).orderBy(pos))
    return (
        df.withColumn("_here", here)
        .join(following.hint("merge"), inner)
        .withColumn(out, F.coalesce("_here", "_following"))
        .drop("_blk", "_here", "_following")
    )


def previous_value(df: DataFrame, keys: Sequence[str], pos: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """``value`` of the row before, by integer ``pos``; null on the first row of a group."""
    df = df.withColumn("_blk", block_of(pos, block))
    inner = [*keys, "_blk"]
    lasts = df.groupBy(*inner).agg(F.max_by(value, pos).alias("_last"))
    carried = lasts.select(*inner, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_blk")).alias("_carried"))
    window = Window.partitionBy(*inner).orderBy(pos)
    return (
        df.withColumn("_nth", F.row_number().over(window))
        .withColumn("_here", F.lag(value).over(window))
        .join(carried.hint("merge"), inner)
        .withColumn(out, F.when(F.col("_nth") > 1, F.col("_here")).otherwise(F.col("_carried")))
        .drop("_blk", "_nth", "_here", "_carried")
    )


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, spread: Sequence[str], out: str = "rank", ways: int = 256
) -> DataFrame:
    """The first ``n`` rows of each group, numbered; a hot group is spread over ``ways`` tasks first."""
    spread_window = Window.partitionBy(*keys, "_way").orderBy(*order)
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_way", F.pmod(F.xxhash64(*spread), F.lit(ways)))
        .withColumn(out, F.row_number().over(spread_window))
        .filter(F.col(out) <= n)
        .withColumn(out, F.row_number().over(window))
        .filter(F.col(out) <= n)
        .drop("_way")
    )

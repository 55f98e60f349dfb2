"""Running totals over ordered groups that may be far larger than one task.

A plain window would sort a whole group in one task.  Here every group is cut
into blocks (any column that never decreases along the order): the window runs
per block, and each block starts from the total of the blocks before it.  Only
the block totals, one small row per block, ever meet in one task per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def block_starts(totals: DataFrame, group: list[str], block: str, names: list[str]) -> DataFrame:
    """Add ``<name>_before`` for each total: its sum over the earlier blocks of the same group."""
    earlier = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("*", *(
        F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}_before") for name in names
    ))


def running_total(
    df: DataFrame, group: list[str], block: str, order: list, value: Column, name: str, below: int | None = None
) -> DataFrame:
    """Add ``name``: the inclusive running sum of ``value`` in ``order`` within ``group``.

    ``order`` must be unique inside a group and ``block`` must not decrease along it.  With
    ``below`` only rows of blocks that start under that total are kept; the rest are not sorted.
    """
    starts = block_starts(
        df.groupBy(*group, block).agg(F.sum(value).alias("_n")), group, block, ["_n"]
    ).drop("_n")
    if below is not None:
        df = df.join(starts.filter(F.col("_n_before") < below), [*group, block])
    in_block = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(name, F.sum(value).over(in_block))
    if below is None:
        df = df.join(starts, [*group, block])
    return df.withColumn(name, F.col(name) + F.col("_n_before")).drop("_n_before")


def number_rows(df: DataFrame, group: list[str], block: str, order: list, name: str) -> DataFrame:
    """Add ``name``: the 1-based row number within ``group``."""
    return running_total(df, group, block, order, F.lit(1).cast("bigint"), name)

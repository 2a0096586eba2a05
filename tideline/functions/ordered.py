"""Running values along a global order, without putting a whole key or the whole table into one task.

The order column is cut into blocks. What a row needs from its own block comes from a window over (keys, block); what it
needs from earlier blocks comes from one row per (keys, block). A key with a third of all rows is thus many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 18


def _blocks(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("__block", F.floor(F.col(order) / block))


def carry(df: DataFrame, keys: list[str], order: str, ties: list[str], value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """df with `name`: the last non-null value in the rows before this one with the same keys."""
    cut = _blocks(df.withColumn("__value", value), order, block)
    within = Window.partitionBy(*keys, "__block").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(order, *ties)
    heads = cut.groupBy(*keys, "__block").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), place)).alias("__last"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = heads.select(*keys, "__block", F.last("__last", True).over(earlier).alias("__before"))
    local = cut.withColumn("__local", F.last("__value", True).over(within))
    return local.join(before, [*keys, "__block"], "left").withColumn(name, F.coalesce("__local", "__before")).drop("__value", "__block", "__local", "__before")


def dense_rank_by(df: DataFrame, order: str, name: str, first: int = 1, block: int = BLOCK) -> DataFrame:
    """df with dense, gap-free numbers from `first` on along a unique order column."""
    cut = _blocks(df, order, block)
    every = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("__block").agg(F.count("*").alias("__n")).select("__block", F.coalesce(F.sum("__n").over(every), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__block").orderBy(order)
    return cut.join(starts, "__block").withColumn(name, F.col("__start") + F.row_number().over(within) + (first - 1)).drop("__block", "__start")

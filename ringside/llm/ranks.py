"""Gapless positions inside groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept_table

#: Bits of a row number that ``monotonically_increasing_id`` keeps for the row inside its partition (fixed value).
_ROW_BITS = 33


def positions(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``pos`` (0, 1, ... by ``order`` inside each group, nulls first) and ``total`` (rows of the group).

    Rows are cut into ranges of (group, order, arrival), so a large group, or many rows of one order value, lie in many
    tasks. A range counts its rows by itself; what the earlier ranges of a group hold is one number per group and range.
    Rows of equal order follow their arrival, fixed by the table written first.
    """
    fixed = kept_table(df.withColumn("tie_", F.monotonically_increasing_id()), f"{name}-fixed")
    by = [*groups, *order, "tie_"]
    lined = kept_table(
        fixed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("row_", F.monotonically_increasing_id()),
        f"{name}-lined").withColumn("part_", F.shiftright("row_", _ROW_BITS))
    spans = lined.groupBy(*groups, "part_").agg(F.min("row_").alias("first_"), F.count("*").alias("n_"))
    group = Window.partitionBy(*groups)
    spans = spans.select(
        *[F.col(g).alias(f"of_{g}") for g in groups], F.col("part_").alias("at_"),
        (F.sum("n_").over(group.orderBy("part_")) - F.col("n_") - F.col("first_")).alias("shift_"),
        F.sum("n_").over(group).alias("total"))
    same: Column = F.col("part_") == F.col("at_")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"of_{g}"))
    return lined.join(spans, same).select(*df.columns, (F.col("row_") + F.col("shift_")).alias("pos"), "total")

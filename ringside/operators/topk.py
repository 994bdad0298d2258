"""First rows per key and ordered keep-first dedup.

All of these filter ``row_number() <= n`` right above the window, so Spark
limits every map partition to n rows per key before the shuffle: a hot key
ships n rows per task, not all of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RANK = "__rank"


def first_n(df: DataFrame, keys: list, order: list, n: int, rank: str | None = None) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rank or RANK, F.row_number().over(window)).filter(
        F.col(rank or RANK) <= n
    )
    return out if rank else out.drop(RANK)


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    return first_n(df, keys, order, 1)


def filter_then_first(df: DataFrame, keep: Column, keys: list, order: list) -> DataFrame:
    """Rejected rows do not use up their key."""
    return keep_first(df.filter(keep), keys, order)


def first_then_filter(df: DataFrame, keep: Column, keys: list, order: list) -> DataFrame:
    """The first row of a key uses it up, even when it is rejected afterwards."""
    return keep_first(df, keys, order).filter(keep)


def latest_state(df: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """Keyed upsert: the whole latest row per key replaces the earlier ones."""
    return keep_first(df, keys, [F.col(c).desc() for c in order])


def upsert(current: DataFrame, changes: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """Latest row per key; a change wins over the current row that it ties with."""
    both = current.withColumn("_source", F.lit(0)).unionByName(changes.withColumn("_source", F.lit(1)))
    return latest_state(both, keys, [*order, "_source"]).drop("_source")


def insert_if_absent(current: DataFrame, incoming: DataFrame, keys: list) -> DataFrame:
    """Existing rows win; the first incoming row of a missing key fills it (all columns in order decide)."""
    absent = incoming.join(current.select(*keys), keys, "left_anti")
    return current.unionByName(keep_first(absent, keys, [c for c in incoming.columns if c not in keys] or list(keys)))

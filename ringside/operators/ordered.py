"""Running values inside each key, split over the whole order.

``lag``, running ``last``, ``sum`` and ``min`` need every row of a key in
order. A plain window puts the whole key into one task. Here all rows are cut
into ranges of (keys, order), so a range holds its share of the rows whatever
the keys look like; each range is a window group per key, and one summary row
per range carries the state across. Only rows equal in keys and whole order
are bound to stay together.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ringside.session import cut_lineage

CHUNK = "__chunk"
SLOT = "__slot"


@dataclass(frozen=True)
class Running:
    """``kind``: lag, last, sum or min up to this row, before (last of the earlier
    rows) or min_before (min of the earlier rows)."""

    kind: str
    value: Column


def in_ranges(df: DataFrame, keys: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """Rows with the number of their range in ``CHUNK``; as many ranges as shuffle partitions.

    The number is the partition a row lies in, so it is fixed by a reliable
    checkpoint: a lost executor cannot renumber rows between two uses.
    """
    pieces = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(pieces, *keys, *order).withColumn(CHUNK, F.spark_partition_id())
    return cut_lineage(placed)


def running(
    df: DataFrame, keys: list[str], order: list[str], specs: dict[str, Running], chunks: int | None = None
) -> DataFrame:
    """Add one column per spec, computed over ``order`` inside ``keys``.

    Rows that come from ``in_ranges`` with these keys and this order keep their ranges.
    """
    placed = df if CHUNK in df.columns else in_ranges(df, keys, order, chunks)
    marked = placed.select("*", *[s.value.alias(f"__v_{n}") for n, s in specs.items()])
    parts = [CHUNK, *keys]
    inner = Window.partitionBy(*parts).orderBy(*order)
    local = marked.select(
        "*", F.row_number().over(inner).alias(SLOT),
        *[_plain(s.kind, F.col(f"__v_{n}"), inner).alias(f"__l_{n}") for n, s in specs.items()],
    )

    place = F.struct(*order)
    edges = marked.groupBy(*parts).agg(
        *[_edge(s.kind, F.col(f"__v_{n}"), place).alias(n) for n, s in specs.items()]
    )
    step = Window.partitionBy(*keys).orderBy(CHUNK)
    across = step.rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *parts, F.row_number().over(step).alias("__turn"),
        *[_carry(s.kind, n, across, step).alias(f"__c_{n}") for n, s in specs.items()],
    ).filter(F.col("__turn") > 1).drop("__turn")
    # Only the first key of a range can have begun in an earlier one, so there
    # are fewer carried rows than ranges: a proven size, safe to send to every task.
    joined = _join_null_safe(local, F.broadcast(carried), parts, "left")
    return joined.select(
        *df.columns,
        *[_combine(s.kind, F.col(f"__l_{n}"), F.col(f"__c_{n}")).alias(n) for n, s in specs.items()],
    )


def _plain(kind: str, value: Column, window) -> Column:
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    if kind == "lag":
        return F.lag(value).over(window)
    if kind == "last":
        return F.last(value, ignorenulls=True).over(upto)
    if kind == "before":
        return F.last(value, ignorenulls=True).over(earlier)
    if kind == "sum":
        return F.sum(value).over(upto)
    if kind == "min":
        return F.min(value).over(upto)
    if kind == "min_before":
        return F.min(value).over(earlier)
    raise ValueError(f"unknown running value: {kind}")


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which a NULL key meets itself."""
    renamed = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"__k_{k}" for k in keys])


def _edge(kind: str, value: Column, place: Column) -> Column:
    if kind == "lag":
        return F.max_by(value, place)
    if kind in ("last", "before"):
        return F.max_by(value, F.when(value.isNotNull(), place))
    return F.sum(value) if kind == "sum" else F.min(value)


def _carry(kind: str, name: str, across, step) -> Column:
    if kind == "lag":
        return F.lag(name).over(step)
    if kind in ("last", "before"):
        return F.last(name, ignorenulls=True).over(across)
    return F.sum(name).over(across) if kind == "sum" else F.min(name).over(across)


def _combine(kind: str, local: Column, carried: Column) -> Column:
    if kind == "lag":
        return F.when(F.col(SLOT) == 1, carried).otherwise(local)
    if kind in ("last", "before"):
        return F.coalesce(local, carried)
    if kind == "sum":
        return F.coalesce(local + carried, local, carried)
    return F.least(local, carried)

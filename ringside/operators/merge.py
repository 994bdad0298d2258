"""Merging a card with its fallback source, and fresh rows with cached ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ringside.functions.text import blank_to_null, combine_errors
from ringside.operators.matching import greedy_one_to_one
from ringside.session import cut_lineage


def fallback_merge(existing: DataFrame, fallback: DataFrame, group: str) -> DataFrame:
    """Fallback order first, filling only missing fields; leftovers follow.

    Both sides carry group, pos, bout_id, a_name, b_name, weight_class and
    card_segment. ``how`` tells matched, added and leftover rows apart.
    """
    assigned = greedy_one_to_one(
        fallback.withColumnRenamed("pos", "left_pos"),
        existing.withColumnRenamed("pos", "right_pos"),
        group,
    )
    # Read by three joins below, so it is worked out once.
    pairs = cut_lineage(
        assigned.select(group, F.col("left_pos").alias("f_pos"), F.col("right_pos").alias("e_pos"))
    )

    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.select(group, *[F.col(c).alias(f"{mark}_{c}") for c in df.columns if c != group])

    # Three joins on unique keys: a full join on the assignment would gather
    # all unmatched rows of a group under one empty key. Sizes are guessed from
    # packed files, so the joins are told not to broadcast rows.
    left, right = side(fallback, "f"), side(existing, "e")
    pairs = pairs.hint("merge")
    matched = left.join(pairs, [group, "f_pos"]).join(right.hint("merge"), [group, "e_pos"])
    added = left.join(pairs, [group, "f_pos"], "left_anti")
    leftover = right.join(pairs, [group, "e_pos"], "left_anti")
    own, other = (lambda c: F.col(f"e_{c}")), (lambda c: F.col(f"f_{c}"))
    return (
        _merged(matched, group, "matched", 0, "f_pos", own, lambda c: filled(own(c), other(c)))
        .unionByName(_merged(added, group, "added", 0, "f_pos", other, other))
        .unionByName(_merged(leftover, group, "leftover", 1, "e_pos", own, lambda c: F.nullif(own(c), F.lit("n/a"))))
    )


def merge_coverage(merged: DataFrame, group: str, tag: str) -> DataFrame:
    """Per group of ``fallback_merge``: rows matched, added and left over, and the source with its tag.

    ``tag`` names the fallback; groups the fallback says nothing about keep their source as it is.
    """
    counts = [F.count_if(F.col("how") == how).alias(how) for how in ("matched", "added", "leftover")]
    per_group = merged.groupBy(group).agg(*counts, F.count(F.lit(1)).alias("confirmed"))
    own = F.lit("main")
    return per_group.withColumn(
        "source", F.when(F.col("matched") + F.col("added") > 0, tag_once(own, tag)).otherwise(own)
    )


def _merged(df, group, how, part, place, own, fill) -> DataFrame:
    return df.select(
        group, F.lit(how).alias("how"), F.lit(part).alias("part"), F.col(place).alias("place"),
        *[own(c).alias(c) for c in ("bout_id", "a_name", "b_name")],
        *[fill(c).alias(c) for c in ("weight_class", "card_segment")],
    )


def filled(own: Column, other: Column) -> Column:
    """``n/a`` counts as missing."""
    return F.coalesce(F.nullif(own, F.lit("n/a")), other)


def fresh_else_cached(fresh: DataFrame, cached: DataFrame, key: str, value: str) -> DataFrame:
    """Fresh value when it came, else the cached one, with provenance."""
    joined = fresh.select(key, F.col(value).alias("__f")).join(
        cached.select(key, F.col(value).alias("__c")), key, "full_outer"
    )
    return joined.select(
        key,
        F.coalesce("__f", "__c").alias(value),
        F.when(F.col("__f").isNotNull(), "fresh").when(F.col("__c").isNotNull(), "cached")
        .otherwise("failed").alias("origin"),
    )


def first_success(first: Column, second: Column) -> Column:
    """Of two read attempts (structs of status, content, error) the first that
    succeeded; otherwise a failure with both errors.
    """
    failed = F.struct(
        F.lit("fetch_failed").alias("status"), F.lit("").alias("content"),
        combine_errors(first["error"], second["error"]).alias("error"),
    )
    return (
        F.when(first["status"] == "success", first).when(second["status"] == "success", second).otherwise(failed)
    )


def previous_hash(meaningful: Column, raw: Column) -> Column:
    return F.coalesce(blank_to_null(meaningful), blank_to_null(raw))


def add_once(items: Column, item: Column) -> Column:
    return F.array_union(items, F.array(item))


def tag_once(source: Column, tag: str) -> Column:
    return F.when(source.contains(tag), source).otherwise(F.concat(source, F.lit(f" + {tag}")))

"""Canonical form and content hash of a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ringside.functions import odds

# Bookkeeping fields that never take part in a content hash.
VOLATILE = ("generated_at", "content_hash")


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON with sorted keys and explicit nulls."""
    return F.to_json(
        F.struct(*[fields[k].alias(k) for k in sorted(fields)]),
        {"ignoreNullFields": "false"},
    )


def content_hash(fields: dict[str, Column]) -> Column:
    kept = {k: v for k, v in fields.items() if k not in VOLATILE}
    return F.sha2(canonical_json(kept), 256)


#: Totals move a lot; a report counts as changed when they move a bucket (fixed values).
BUCKETED = ("over_1_5_decimal", "over_2_5_decimal")


def rewritten(value: Column, kind: DataType, leaf: Callable[[Column, str], Column], name: str = "") -> Column:
    """``value`` with its fields in order of their names at every level and ``leaf(value, field name)`` for the rest.

    Built from the schema alone; items of a list go by the name of the list.
    """
    if isinstance(kind, StructType):
        fields = [
            rewritten(value[f.name], f.dataType, leaf, f.name).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: rewritten(x, kind.elementType, leaf, name))
    if isinstance(kind, MapType):
        # entries in order of their keys; a key names its value
        entries = F.array_sort(F.map_entries(value))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(
            e["key"].cast("string").alias("key"), rewritten(e["value"], kind.valueType, leaf, name).alias("value"))))
    return leaf(value, name)


def _meaning(value: Column, name: str) -> Column:
    return odds.bucket_text(value) if name in BUCKETED else value


def nested_json(report: Column, kind: StructType, meaningful: bool = True) -> Column:
    """Canonical JSON of a nested report without its top-level bookkeeping fields.

    ``meaningful`` puts totals into their buckets wherever they stand.
    """
    kept = StructType([f for f in kind.fields if f.name not in VOLATILE])
    leaf = _meaning if meaningful else (lambda value, name: value)
    return F.to_json(rewritten(report, kept, leaf), {"ignoreNullFields": "false"})


def nested_hash(report: Column, kind: StructType, meaningful: bool = True) -> Column:
    """Equal for reports that differ in field order and bookkeeping only."""
    return F.sha2(nested_json(report, kind, meaningful), 256)


def short_id(prefix: Column, *parts: Column) -> Column:
    """Replayable id: prefix and eight hex digits of the hash of the parts."""
    return F.concat(
        prefix, F.lit("-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8)
    )


def record_prefix(project_key: Column) -> Column:
    return F.substring(F.replace(project_key, F.lit("-"), F.lit("")), 1, 5)

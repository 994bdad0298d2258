"""Writing records as JSON together with their Markdown documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ringside.functions.hashing import content_hash
from ringside.sources.keyed import BUCKET, write_keyed
from ringside.sources.records import write_records


def write_documents(parts: DataFrame, key: str, path: str) -> None:
    """Document parts, in reading order inside a file. A document written again replaces its parts."""
    write_keyed(parts.select(key, "part_no", "body"), path, [key], within=["part_no"])


def read_documents(spark: SparkSession, key: str, path: str) -> DataFrame:
    return spark.read.schema(f"{key} bigint, part_no bigint, body string").json(path).drop(BUCKET)


def dual_write(records: DataFrame, parts: DataFrame, path: str) -> None:
    """Records and their documents side by side, one job each."""
    write_records(records, f"{path}/records")
    write_documents(parts, "record_id", f"{path}/documents")


def write_reports(snapshots: DataFrame, parts: DataFrame, path: str) -> None:
    """Report snapshots (append-only, by event) and the rendered parts."""
    snapshots.write.mode("append").json(f"{path}/snapshots")
    write_documents(parts.withColumnRenamed("card", "report_id"), "report_id", f"{path}/documents")


def with_snapshot_hash(snapshots: DataFrame, fields: list[str]) -> DataFrame:
    """Content hash over the typed fields; bookkeeping fields do not count."""
    return snapshots.withColumn("content_hash", content_hash({f: F.col(f) for f in fields}))

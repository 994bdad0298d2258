"""JSON record folders: write, scan with a project filter, look up by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ringside.schemas import RECORD
from ringside.sources.keyed import BUCKET, path_exists, qualified, write_keyed
from ringside.sources.text_files import read_whole


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines by project, so that a project scan reads its folder only.

    A record written again replaces the stored one; all others stay.
    """
    write_keyed(df, path, ["project_key", "record_id"], folders=["project_key"])


def read_records(
    spark: SparkSession, path: str, project_key: str | None = None, multi_line: bool = False
) -> DataFrame:
    """Scan a folder; broken records keep their text in ``_corrupt_record``."""
    df = (
        spark.read.schema(RECORD)
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
        .withColumn("file_name", F.col("_metadata.file_name"))
        .drop(BUCKET)
    )
    return df if project_key is None else df.filter(F.col("project_key") == project_key)


def look_up(requests: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Every requested key with its record, or with ``found`` false."""
    marked = records.withColumn("found", F.lit(True))
    return requests.join(marked, key, "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per text or Markdown file; none where there is no such file or folder."""
    if not any(ch in path for ch in "*?[{"):
        if not path_exists(spark, path):
            return spark.createDataFrame([], "file_path string, body string")
        # Spark's own reader takes milliseconds a file, which counts with many small ones
        whole = read_whole(spark, qualified(spark, path))
        if whole is not None:
            return whole
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("body")
    )

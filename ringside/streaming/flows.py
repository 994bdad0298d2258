"""Streaming flows: the inbox goes through the batch operators, keyed state is Spark's own.

Inbox outputs are written per batch under its id; replaying a batch overwrites the same folder. All other flows are
stateful operators (``processors``) with a file sink, whose log makes a replayed batch count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ringside.operators import routing
from ringside.operators.topk import latest_state
from ringside.session import starting_with
from ringside.streaming import inbox, processors
from ringside.streaming.inbox import Inbox

c = F.col


def parquet_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A table as a stream; ``path`` may be a folder or a single file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # As a pattern, because a plain streaming path has to be a folder.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


FOLDERS = {"ideas": "idea", "contexts": "context"}


def inbox_stream(spark: SparkSession, path: str, max_files: int = 10_000) -> DataFrame | Inbox:
    """Whole inbox files with their name; the folder ``ideas`` or ``contexts`` tells the entity type.

    A file is one JSON object, on one line or many. ``max_files`` bounds a
    batch; the rest comes in the next ones. Spark's own source keeps all names
    in the driver, so a plain folder is listed by ``streaming.inbox``.
    """
    if inbox.is_listed(path):
        return inbox.Inbox(spark, path, max_files)
    return inbox_files(
        spark.readStream.option("maxFilesPerTrigger", max_files).text(path, wholetext=True, recursiveFileLookup=True))


def inbox_files(files: DataFrame) -> DataFrame:
    folder = F.element_at(F.split(c("_metadata.file_path"), "/"), -2)
    kind = F.when(F.lit(False), "")
    for name, entity in FOLDERS.items():
        kind = kind.when(folder == name, entity)
    return files.select(c("_metadata.file_name").alias("file_name"), kind.alias("entity_type"), c("value").alias("body"))


#: A batch of thousands of small files is listed by few tasks, not one a file, and many of them are read by one task. The
#: driver does not keep the files of earlier batches.
SMALL_FILES = {
    "spark.sql.hive.filesourcePartitionFileCacheSize": "0",
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "32",
    "spark.sql.files.openCostInBytes": "64k",
}


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what has arrived since the last run, then stop."""
    # the source of files lists them with the session's settings while the stream runs
    with starting_with(stream.sparkSession, SMALL_FILES):
        query = (
            stream.writeStream.foreachBatch(each)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return query


def emit(df: DataFrame, out: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")


# ---------------------------------------------------------------- inbox

def ingest_inbox(stream: DataFrame | Inbox, out: str, checkpoint: str) -> StreamingQuery:
    """Files to routed Markdown documents, failures with their reason, and counters.

    The checkpoint lists the files already taken. ``out`` gets ``documents``
    (target, file_name, body), ``failed`` (file_name, error_reason) and
    ``stats``. Inside a batch the last file name wins a target; of several
    batches the last one does, see ``current_documents``.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        parsed = routing.with_error_reason(batch.withColumn("record", routing.parse_inbox(c("body"))))
        unknown = c("error_reason").isNull() & c("entity_type").isNull()
        parsed = parsed.withColumn("error_reason", F.when(unknown, "unknown folder").otherwise(c("error_reason"))).persist()
        good = parsed.filter(c("error_reason").isNull()).select(
            routing.target_path("record", c("entity_type"), F.date_format(F.current_date(), "yyyy-MM-dd")).alias("target"),
            "file_name", routing.inbox_markdown("record", c("entity_type")).alias("body"),
        )
        emit(routing.last_writer_wins(good, "target", ["file_name"]), f"{out}/documents", batch_id)
        emit(
            parsed.filter(c("error_reason").isNotNull()).select("file_name", "error_reason"), f"{out}/failed", batch_id,
        )
        emit(routing.outcome_counts(parsed), f"{out}/stats", batch_id)
        parsed.unpersist()

    if not isinstance(stream, Inbox):
        return drain(stream, each, checkpoint)
    lists = f"{checkpoint}/files"
    inbox.update_lists(stream, lists)

    def each_list(batch: DataFrame, batch_id: int) -> None:
        addresses = [r.address for r in batch.select("address").collect()]
        if addresses:
            each(inbox_files(inbox.whole_files(batch.sparkSession, stream.path, addresses)), batch_id)

    return drain(inbox.listed_stream(stream.spark, lists), each_list, checkpoint)


def current_documents(spark: SparkSession, out: str) -> DataFrame:
    """One document per target: the one written last."""
    written = spark.read.parquet(f"{out}/documents")
    return latest_state(written, ["target"], ["batch_id", "file_name"]).drop("batch_id")


# ---------------------------------------------------------------- keyed state

def drain_to(rows: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append what a stateful stream emits to Parquet, for all that has arrived since the last run."""
    with processors.state_store(rows.sparkSession):
        query = (
            rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
        )
    query.awaitTermination()
    return query


def latest_per_key(stream: DataFrame, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Keyed state fed by a stream; the table is ``processors.state_of(spark, checkpoint, "latest")``.

    A batch reads and writes the state of its own keys only.
    """
    rows = processors.latest_rows(stream, keys, order)
    with processors.state_store(stream.sparkSession):
        query = (
            rows.writeStream.format("noop").option("checkpointLocation", checkpoint)
            .outputMode("update").trigger(availableNow=True).start()
        )
    query.awaitTermination()
    return query


def changed_only(runs: DataFrame, out: str, checkpoint: str, frames: bool = False) -> StreamingQuery:
    """Runs that differ from the last sent hash of their key.

    Runs go by arrival: batch by batch, and by seq inside a batch. A late run
    is therefore compared with what was sent last, not with its neighbour.
    """
    return drain_to(processors.emit_on_change(runs, frames), out, checkpoint)


def gate(runs: DataFrame, at: str, out: str, checkpoint: str, delay: str = "0 seconds") -> StreamingQuery:
    """Window gate over a stream of runs, by arrival as in ``changed_only``; ``at`` is their event time."""
    return drain_to(processors.gate(runs, at, delay), out, checkpoint)


def consume_matches(events: DataFrame, out: str, checkpoint: str, key: str, within_seconds: int) -> StreamingQuery:
    """Texts take the newest open record of their key; each record serves once.

    ``events`` have the key, event_id, ts and role (open or text). State with
    TTL goes by the clock, for which Spark plans batches without end when it
    drains a stream; so a run is one batch here.
    """
    tagged = events.withColumn("is_text", c("role") == "text")
    return drain_to(processors.consume_matches(tagged, key, within_seconds), out, checkpoint, once=True)


def pairs_within(
    events: DataFrame, out: str, checkpoint: str, key: str, within_seconds: int, delay: str = "0 seconds"
) -> StreamingQuery:
    """Every text with the open records up to the bound before it, by a join of two streams."""
    opened, texts = events.filter(c("role") == "open"), events.filter(c("role") == "text")
    return drain_to(processors.pairs_within(opened, texts, key, within_seconds, delay), out, checkpoint)

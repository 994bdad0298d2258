"""Operators with keyed state on Spark's state store (``transformWithState``).

Rows of a key come in no order inside a micro-batch. ``LatestRow`` needs none and holds one row. The others go by arrival,
that is by their position inside the batch: they sort the rows that one key has in one batch, so the size of a batch,
which ``flows.parquet_stream`` bounds at the source, bounds their memory; how much a key has had before does not matter.
"""

from __future__ import annotations

import datetime
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ringside.session import STATE_STORE_PROVIDER, starting_with

OUTPUT = "key bigint, seq bigint, kind string"
JUDGED = "key bigint, seq bigint, kind string, status string, reason string"
DAY = datetime.timedelta(days=1)
SATURDAY = 5


def state_store(spark: SparkSession):
    """Streams started inside keep their state in RocksDB."""
    return starting_with(spark, {
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE_PROVIDER,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    })


def _travels_with_the_query() -> None:
    """Workers then need no installed package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ---------------------------------------------------------------- change

def is_news(kind: str, own: str | None, last: str | None) -> bool:
    return kind == "baseline" or own != last


class EmitOnChange(StatefulProcessor):
    """Value state: the hash sent last. Every baseline is sent, an update when its hash differs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last_hash", "hash string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self._last.get()
        last = state[0] if state else None
        for row in sorted(rows, key=lambda r: r.seq):
            if is_news(row.kind, row.hash, last):
                yield Row(key=key[0], seq=row.seq, kind=row.kind)
            last = row.hash
        self._last.update((last,))

    def close(self) -> None:
        pass


class EmitOnChangeFrames(EmitOnChange):
    """The same over Arrow frames, for keys with many rows in a batch: compares whole columns."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat([f[["seq", "kind", "hash"]] for f in rows]).sort_values("seq")
        state = self._last.get()
        previous = frame["hash"].shift(1)
        previous.iloc[0] = state[0] if state else None
        emitted = frame[(frame["kind"] == "baseline") | (frame["hash"] != previous)]
        self._last.update((frame["hash"].iloc[-1],))
        yield emitted.assign(key=key[0])[["key", "seq", "kind"]]


def emit_on_change(runs: DataFrame, frames: bool = False) -> DataFrame:
    """``runs`` is a stream with key, seq, kind and hash."""
    _travels_with_the_query()
    keyed = runs.select("key", "seq", "kind", "hash").groupBy("key")
    if frames:
        return keyed.transformWithStateInPandas(EmitOnChangeFrames(), OUTPUT, "Append", "None")
    return keyed.transformWithState(EmitOnChange(), OUTPUT, "Append", "None")


# ---------------------------------------------------------------- gate

def in_next_weekend(day: datetime.date | None, reference: datetime.date | None) -> bool:
    """Whether ``day`` is on the weekend that comes next; a Saturday's is its own, a Sunday's six days ahead."""
    if day is None or reference is None:
        return False
    saturday = reference + DAY * ((SATURDAY - reference.weekday()) % 7)
    return saturday <= day <= saturday + DAY


class WindowGate(StatefulProcessor):
    """Value state: the date of the open window and the hash sent last.

    A timer closes the window when the watermark passes the day of its event: every later run would find it over. All
    that is kept then is that the next update has to be told so.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._window = handle.getValueState("window", "opened date, hash string, over boolean")

    @staticmethod
    def closes(opened: datetime.date) -> int:
        """Milliseconds at the end of the event's day, UTC."""
        return ((opened + DAY) - datetime.date(1970, 1, 1)).days * 86_400_000

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = window = self._window.get()
        for row in sorted(rows, key=lambda r: r.seq):
            if row.kind == "baseline":
                opens = in_next_weekend(row.opened_date, row.run_date)
                window = (row.opened_date, row.hash, False) if opens else None
                status, reason = ("baseline_created", "window_opened") if opens else ("skipped", "no_event")
            elif window is None:
                status, reason = "skipped", "no_window"
            elif window[2] or not in_next_weekend(window[0], row.run_date):
                window, status, reason = None, "skipped", "window_over"
            elif window[1] == row.hash:
                status, reason = "unchanged", "same_hash"
            else:
                window, status, reason = (window[0], row.hash, False), "changed", "new_hash"
            yield Row(key=key[0], seq=row.seq, kind=row.kind, status=status, reason=reason)
        self._keep(before, window)

    def _keep(self, before: tuple | None, window: tuple | None) -> None:
        had = before[0] if before and not before[2] else None
        has = window[0] if window and not window[2] else None
        if had != has and had is not None:
            self._handle.deleteTimer(self.closes(had))
        if had != has and has is not None:
            self._handle.registerTimer(self.closes(has))
        if window is None and before is not None:
            self._window.clear()
        elif window is not None and window != before:
            self._window.update(window)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._window.update((None, None, True))
        return iter(())

    def close(self) -> None:
        pass


def gate(runs: DataFrame, at: str, delay: str = "0 seconds") -> DataFrame:
    """``runs`` is a stream with key, seq, kind, run_date, opened_date, hash and the event time ``at``.

    Runs older than the watermark, the newest time of the batches before less ``delay``, are dropped by Spark.
    """
    _travels_with_the_query()
    timed = runs.withWatermark(at, delay).select("key", "seq", "kind", "run_date", "opened_date", "hash", at)
    return timed.groupBy("key").transformWithState(WindowGate(), JUDGED, "Append", "EventTime")


# ---------------------------------------------------------------- latest

class LatestRow(StatefulProcessor):
    """Value state: the newest row of the key. Emits it when a batch brings a newer one."""

    def __init__(self, schema: str, columns: list[str], order: list[str]) -> None:
        self._schema, self._columns, self._order = schema, columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._latest = handle.getValueState("latest", self._schema)

    def _rank(self, values) -> list[tuple]:
        # nulls first
        return [(values[i] is not None, values[i]) for i in self._order]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = newest = self._latest.get()
        for row in rows:
            values = tuple(row[c] for c in self._columns)
            if newest is None or self._rank(values) > self._rank(newest):
                newest = values
        if newest is not known:
            self._latest.update(newest)
            yield Row(**dict(zip(self._columns, newest, strict=True)))

    def close(self) -> None:
        pass


def latest_rows(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key after every batch that changes it; ``order`` decides between old and new rows."""
    _travels_with_the_query()
    columns = stream.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    processor = LatestRow(schema, columns, [columns.index(c) for c in order])
    return stream.groupBy(*keys).transformWithState(processor, schema, "Update", "None")


def state_of(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """The values of a value state as a table, read from the stream's checkpoint by Spark's state data source."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load().select("value.*")


# ---------------------------------------------------------------- matching

class ConsumeMatches(StatefulProcessor):
    """Map state: id and time of the open records that no text has taken yet.

    A text takes the newest of them, the lowest id of equal times, if it is recent enough. Records live for the bound:
    by state TTL counted from their arrival, for keys that get no more rows, and by event time when rows come.
    """

    def __init__(self, key: str, within_seconds: int) -> None:
        self._key, self._bound = key, within_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._open = handle.getMapState("open", "id bigint", "at bigint", self._bound // 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = {i: at for (i,), (at,) in self._open.iterator()}
        # the one to take is last: newest time, then lowest id
        waiting = sorted((at, -i) for i, at in known.items())
        newest = waiting[-1][0] if waiting else None
        for row in sorted(rows, key=lambda r: (r.at, r.is_text, r.event_id if r.is_text else -r.event_id)):
            newest = row.at if newest is None else max(newest, row.at)
            if not row.is_text:
                place = len(waiting)
                while place and waiting[place - 1] > (row.at, -row.event_id):
                    place -= 1
                waiting.insert(place, (row.at, -row.event_id))
                continue
            place = len(waiting) - 1
            while place >= 0 and waiting[place][0] > row.at:
                place -= 1
            if place >= 0 and row.at - waiting[place][0] <= self._bound:
                yield Row(**{self._key: key[0], "text_id": row.event_id, "open_id": -waiting.pop(place)[1]})
        left = {-i: at for at, i in waiting if newest - at <= self._bound}
        for i in known.keys() - left.keys():
            self._open.removeKey((i,))
        for i in left.keys() - known.keys():
            self._open.updateValue((i,), (left[i],))

    def close(self) -> None:
        pass


def consume_matches(events: DataFrame, key: str, within_seconds: int) -> DataFrame:
    """``events`` is a stream with the key, event_id, ts and is_text; open records are the rows that are no text."""
    _travels_with_the_query()
    rows = events.select(key, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "is_text")
    return rows.groupBy(key).transformWithState(
        ConsumeMatches(key, within_seconds), f"{key} bigint, text_id bigint, open_id bigint", "Append", "ProcessingTime")


# ---------------------------------------------------------------- interval join

def pairs_within(opened: DataFrame, texts: DataFrame, key: str, within_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """Stream-stream join: every text with the open records of its key up to the bound before it.

    Both sides carry a watermark, so Spark drops a record from its state once no text in time can come, and a text once
    the watermark has passed it. Rows later than the watermark are dropped.
    """
    # watermarks need zoned times
    at = F.col("ts").cast("timestamp")
    left = opened.select(F.col(key), F.col("event_id").alias("open_id"), at.alias("open_ts")).withWatermark("open_ts", delay)
    right = texts.select(F.col(key).alias("of"), F.col("event_id").alias("text_id"), at.alias("text_ts")).withWatermark("text_ts", delay)
    bound = F.expr(f"INTERVAL {int(within_seconds)} SECONDS")
    near = (F.col(key) == F.col("of")) & (F.col("text_ts") >= F.col("open_ts")) & (F.col("text_ts") <= F.col("open_ts") + bound)
    return left.join(right, near).select(key, "text_id", "open_id", "open_ts")

"""Runs of windows that share a minimizer: the common front of the two substring operators.

A window is a fixed number of consecutive symbols (bytes or words). Its minimizer is the gram with the smallest hash in
it, the leftmost on ties; equal windows hold equal minimizers at equal places, so all copies of a window meet in the
bucket of that gram. Consecutive windows with one minimizer form a run, which stands for all of them in one row. Only
windows in buckets that are met twice can repeat.

A bucket whose runs are all equal needs no look at the windows: every run but the first is repeated whole. In the other
buckets equal runs count as one, and their first occurrences go on to the operators' own windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, STEP, U64, Rolling, Words, bodies, kept_table, text_batches

#: Low bits that hold a gram's place while minima are taken; a piece of a text is shorter than that.
_PLACE = (1 << 24) - 1
_PIECE = 4 * STEP


@dataclass(frozen=True)
class Kind:
    """What a window is made of."""

    name: str
    window: int
    gram: int
    words: bool

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts and where each text starts (one more entry than texts)."""
        if self.words:
            words = Words(texts)
            return words.hash, words.first
        data = np.frombuffer(b"".join(texts), np.uint8)
        return BYTE_VALUES[data], np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def _minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    size = 1
    out = values
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    if width > size:
        out = np.minimum(out[: len(out) - (width - size)], out[width - size :])
    return out


def runs(kind: Kind, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, bucket, hash) of every run; windows never cross texts."""
    symbols, first = kind.symbols(texts)
    parts = []
    for at in range(0, max(1, len(symbols) - kind.window + 1), _PIECE):
        piece = symbols[at : at + _PIECE + kind.window - 1]
        if len(piece) < kind.window:
            continue
        rolling = Rolling(piece)
        grams = rolling.grams(kind.gram)
        packed = (grams & U64(~_PLACE & (1 << 64) - 1)) | np.arange(len(grams), dtype=U64)
        anchor = (_minima(packed, kind.window - kind.gram + 1) & U64(_PLACE)).astype(np.int64)
        start = np.arange(len(anchor))
        owner = np.searchsorted(first, start + at, side="right") - 1
        inside = start + at + kind.window <= first[np.minimum(owner + 1, len(first) - 1)]
        start, anchor, owner = start[inside], anchor[inside], owner[inside]
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (owner[1:] != owner[:-1])
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(start)))
        low = start[head]
        whole = rolling.span(low, low + count + kind.window - 1) + (anchor[head] - low).astype(U64)
        parts.append((owner[head], low + at - first[owner[head]], count, grams[anchor[head]].view(np.int64),
                      whole.view(np.int64)))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


RUN = "doc_id long, low int, n int, bucket long, hash long"


def _emit(kind: Kind):
    def emit(batches):
        for part, texts in text_batches(batches):
            owner, low, n, bucket, whole = runs(kind, texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(owner)), pa.array(low, pa.int32()), pa.array(n, pa.int32()),
                 pa.array(bucket), pa.array(whole)], ["doc_id", "low", "n", "bucket", "hash"])

    return emit


@dataclass
class Shared:
    """``certain``: runs that repeat an equal, earlier one (doc_id, low, n, and the first in first.doc_id, first.low).
    ``open``: first occurrences in buckets with different runs (doc_id, low, n, bucket)."""

    certain: DataFrame
    open: DataFrame


def shared_runs(docs: DataFrame, kind: Kind) -> Shared:
    """``docs``: doc_id and text. Rows without an id are neither compared nor sources."""
    texts = bodies(docs.where("doc_id is not null"), F.col("doc_id").cast("long").alias("doc_id"))
    found = texts.mapInArrow(_emit(kind), RUN)
    # counts and extremes combine on the map side, so a bucket that holds a third of the runs costs one row a task
    met = kept_table(found.groupBy("bucket").agg(
        F.count("*").alias("met"), F.min("hash").alias("a"), F.max("hash").alias("b")).where("met > 1").select(
        "bucket", (F.col("a") != F.col("b")).alias("mixed")), f"{kind.name}-met")
    # as a table of its own the join has an exchange on either side, so adaptive execution can split a hot bucket
    both = kept_table(found.join(met, "bucket"), f"{kind.name}-runs")
    firsts = kept_table(both.groupBy("bucket", "hash").agg(
        F.min(F.struct("doc_id", "low")).alias("first"), F.first("n").alias("n"), F.first("mixed").alias("mixed")),
        f"{kind.name}-firsts")
    certain = both.select("doc_id", "low", "n", "bucket", "hash").join(
        firsts.select("bucket", "hash", "first"), ["bucket", "hash"]).where(
        (F.col("doc_id") != F.col("first.doc_id")) | (F.col("low") != F.col("first.low")))
    opened = firsts.where("mixed").select("first.doc_id", "first.low", "n", "bucket")
    return Shared(certain.select("doc_id", "low", "n", "first"), opened)


def with_texts(docs: DataFrame, runs_: DataFrame) -> DataFrame:
    """Documents that have runs in ``runs_``: doc_id, body, and the runs as a list (bounded by the text's length)."""
    listed = runs_.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in runs_.columns if c != "doc_id"])).alias("runs"))
    return bodies(docs, F.col("doc_id").cast("long").alias("doc_id")).join(listed, "doc_id")


def covered(low: np.ndarray, n: np.ndarray, window: int, size: int) -> np.ndarray:
    """Mask of the symbols of a text of ``size`` covered by the windows [low, low + n)."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, np.minimum(low, size), 1)
    np.add.at(change, np.minimum(low + n - 1 + window, size), -1)
    return np.cumsum(change[:-1]) > 0


def removals(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every row of ``docs`` with the list of its repeated runs (null: none)."""
    listed = kept_table(spans.groupBy("doc_id").agg(F.collect_list(F.struct("low", "n")).alias("runs")), "removed-runs")
    return bodies(docs, F.col("doc_id").cast("long").alias("doc_id")).join(listed, "doc_id", "left").select(
        "doc_id", "body", F.col("runs.low").alias("low"), F.col("runs.n").alias("n"))

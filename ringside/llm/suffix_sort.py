"""Substring dedup on bytes: suffixes sorted bucket by bucket, long ties resolved by ranks of a difference cover.

A suffix matters by its first WINDOW bytes. Suffixes fall into buckets by their minimizer (see ``windows``): copies meet
in one bucket, and suffixes whose bucket is met once cannot repeat and are never sorted. Where a bucket's runs are all
equal, their first occurrence settles all of its suffixes. The other buckets are sorted, one after the other inside a
task's stream, over the text of their different runs:

1. The difference cover D of PERIOD (for any two places there is a shift under PERIOD that brings both into D) selects
   sample suffixes. They are ranked first: by blocks of PERIOD bytes, then twice by pairs of such ranks (PERIOD is a
   shift inside the cover), which orders them by four blocks.
2. The bucket's suffixes are sorted by their first PERIOD bytes only. Ties are split against a pivot by comparing the
   ranks of the two sample suffixes at the shift of their places, in constant time however long the tie is.
3. Neighbours in that order that agree on WINDOW bytes are one class; all but its smallest (doc_id, start) repeat.

A task holds PART different runs of a bucket at most: larger buckets are sorted in parts, whose class firsts meet by
window hash in a second step. Memory is bounded by the part, not by the bucket or the corpus. What the plain form of the
method would sort (every byte of the corpus) is cut down beforehand without losing a match; see the README for figures.

A byte goes if a window that covers it also starts earlier (smaller doc_id, or same document and earlier start).

Defined results: null and empty texts have no bytes; texts under WINDOW bytes lose nothing. Rows without a ``doc_id``
lose nothing and are no source. ``doc_id`` names a text: rows that share one should be equal, are one source, and lose
the union of what their id loses. Empty tables give no rows. Only ``doc_id`` and the text column are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_VALUES, Rolling, kept_table, text_batches
from .windows import Kind, covered, removals, shared_runs, with_texts

WINDOW, GRAM = 100, 24
KIND = Kind("suffix", WINDOW, GRAM, words=False)
PERIOD = 32
#: Different runs of one bucket that a task sorts together, and runs sorted in one vectorised step.
PART, STEP_RUNS = 4096, 4096


def difference_cover(period: int) -> np.ndarray:
    """The first s places and every s-th one: any difference is a multiple of s less a number under s."""
    s = math.isqrt(period - 1) + 1
    return np.unique(np.concatenate((np.arange(s), np.arange(0, period, s))))


COVER = difference_cover(PERIOD)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: Smallest shift that brings places of two residues into the cover.
_SHIFT = np.array([[next(d for d in range(PERIOD) if _IN_COVER[(a + d) % PERIOD] and _IN_COVER[(b + d) % PERIOD])
                    for b in range(PERIOD)] for a in range(PERIOD)])


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks by the keys, first key first; equal keys share a rank, ranks start at 1."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


def window_classes(text: np.ndarray, place: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``place`` by (group, suffix), and the class of each place of that order.

    Two are in one class if group and first WINDOW bytes are equal.
    """
    n = len(text)
    padded = np.zeros(n + WINDOW + 8 * PERIOD, np.uint64)
    padded[:n] = text
    eight = np.zeros(len(padded) - 8, np.uint64)
    for i in range(8):
        eight |= padded[i : len(eight) + i] << np.uint64(56 - 8 * i)
    # ranks of the sample
    sample = np.flatnonzero(_IN_COVER[np.arange(n) % PERIOD])
    rank = np.zeros(n + 8 * PERIOD, np.int64)
    rank[sample] = _dense(*[eight[sample + 8 * i] for i in range(PERIOD // 8)])
    for reach in (PERIOD, 2 * PERIOD):
        rank[sample] = _dense(rank[sample], rank[sample + reach])
    # first PERIOD bytes
    keys = [group, *[eight[place + 8 * i] for i in range(PERIOD // 8)]]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    tie = np.cumsum(new)
    open_ = np.arange(len(order))
    while len(open_):
        label = tie[open_]
        head = np.flatnonzero(np.append(True, label[1:] != label[:-1])) if len(label) else label
        count = np.diff(np.append(head, len(label)))
        many = np.repeat(count > 1, count)
        open_, label = open_[many], label[many]
        if not len(open_):
            break
        head = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
        count = np.diff(np.append(head, len(label)))
        here = place[order[open_]]
        pivot = np.repeat(here[head + count // 2], count)
        shift = _SHIFT[here % PERIOD, pivot % PERIOD]
        side = np.sign(rank[here + shift] - rank[pivot + shift])
        inner = np.lexsort((side, label))
        order[open_] = order[open_][inner]
        side, label = side[inner], label[inner]
        # three labels where there was one: labels only need to differ and to rise
        wider = label * 3 + side
        tie = tie * 3
        tie[open_] = wider
        tie = np.cumsum(np.append(False, tie[1:] != tie[:-1]))
        open_ = open_[side != 0]
    at, kind = place[order], group[order]
    same = kind[1:] == kind[:-1]
    for i in [*range(0, WINDOW - 8, 8), WINDOW - 8]:
        same &= eight[at[1:] + i] == eight[at[:-1] + i]
    return order, np.cumsum(np.append(False, ~same)) if len(order) else tie


def _slices(batches):
    """Texts of the open runs: bucket, part, parts, doc_id, low, n, slice."""
    names = ["bucket", "part", "parts", "doc_id", "low", "n", "slice"]
    for part, texts in text_batches(batches):
        listed = part.column(part.schema.get_field_index("runs"))
        fields = listed.flatten()
        owner = np.repeat(np.arange(len(texts)), np.asarray(listed.value_lengths().fill_null(0)))
        low, n = (np.asarray(fields.field(x)).astype(np.int64) for x in ("low", "n"))
        cut = [texts[o][a : a + k + WINDOW - 1] for o, a, k in zip(owner, low, n, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [fields.field("bucket"), fields.field("part"), fields.field("parts"), part.column(0).take(pa.array(owner)),
             fields.field("low"), fields.field("n"), pa.array(cut, pa.binary())], names)


_SORTED = "pending boolean, doc_id long, low int, n int, bucket long, hash long"


def _sort_buckets(batches):
    """Sort the suffixes of the stream's buckets; a bucket part comes in consecutive rows."""
    held = None

    def flush(rows):
        bucket, part, parts, doc, low, n, slices = (rows[c].to_numpy(zero_copy_only=False) for c in (
            "bucket", "part", "parts", "doc_id", "low", "n", "slice"))
        sizes = np.array([len(s) for s in slices], np.int64)
        base = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"".join(slices), np.uint8)
        counts = np.minimum(n.astype(np.int64), np.maximum(0, sizes - WINDOW + 1))
        run = np.repeat(np.arange(len(n)), counts)
        step = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
        group = np.cumsum(np.append(False, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])))[run]
        place, start = base[run] + step, low[run].astype(np.int64) + step
        order, label = window_classes(text, place, group)
        run, place, start = run[order], place[order], start[order]
        first = np.lexsort((start, doc[run], label))
        run, place, start, label = run[first], place[first], start[first], label[first]
        head = np.append(True, label[1:] != label[:-1]) if len(label) else np.zeros(0, bool)
        lead = np.flatnonzero(head)[np.cumsum(head) - 1]
        repeat = (doc[run] != doc[run[lead]]) | (start != start[lead])
        # repeated windows, glued where they follow each other in a run
        glue = np.lexsort((start[repeat], run[repeat]))
        r, s = run[repeat][glue], start[repeat][glue]
        new = np.append(True, (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)) if len(r) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        wait = head & (parts[run] > 1)
        spans = Rolling(BYTE_VALUES[text]).span(place[wait], place[wait] + WINDOW).view(np.int64)
        k, w = len(at), int(wait.sum())
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat([False, True], [k, w])),
            pa.array(np.concatenate((doc[r[at]], doc[run[wait]])), pa.int64()),
            pa.array(np.concatenate((s[at], start[wait])), pa.int32()),
            pa.array(np.concatenate((np.diff(np.append(at, len(r))), np.ones(w, np.int64))), pa.int32()),
            pa.array(np.concatenate((bucket[r[at]], bucket[run[wait]])), pa.int64()),
            pa.array(np.concatenate((np.zeros(k, np.int64), spans)), pa.int64()),
        ], ["pending", "doc_id", "low", "n", "bucket", "hash"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        while held.num_rows > STEP_RUNS:
            keys = held["bucket"].to_numpy(), held["part"].to_numpy()
            edge = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])) + 1
            if not len(edge):
                break
            # the last edge inside the step, or the first one where a part is longer than a step
            cut = int(edge[edge <= STEP_RUNS][-1]) if edge[0] <= STEP_RUNS else int(edge[0])
            yield flush(held.slice(0, cut).combine_chunks())
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield flush(held.combine_chunks())


def repeated_windows(docs: DataFrame, part: int = PART) -> DataFrame:
    """Runs of windows that also start earlier: doc_id, low, n."""
    shared = shared_runs(docs.select("doc_id", "text"), KIND)
    sizes = shared.open.groupBy("bucket").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    opened = shared.open.join(sizes, "bucket").withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "low"), F.col("parts")).cast("int"))
    slices = with_texts(docs, opened.select("doc_id", "low", "n", "bucket", "part", "parts")).mapInArrow(
        _slices, "bucket long, part int, parts int, doc_id long, low int, n int, slice binary")
    ordered = kept_table(slices.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(
        _sort_buckets, _SORTED), "suffix-sorted")
    pending = ordered.where("pending").select("doc_id", "low", "bucket", "hash")
    firsts = pending.groupBy("bucket", "hash").agg(F.min(F.struct("doc_id", "low")).alias("first"), F.count("*").alias("met"))
    late = pending.join(firsts.where("met > 1"), ["bucket", "hash"]).where(
        (F.col("doc_id") != F.col("first.doc_id")) | (F.col("low") != F.col("first.low")))
    return shared.certain.select("doc_id", "low", "n").union(
        ordered.where("not pending").select("doc_id", "low", "n")).union(
        late.select("doc_id", "low", F.lit(1).alias("n")))


def _cut(keep: bool):
    def cut(batches):
        for part, texts in text_batches(batches):
            lows, ns = (part.column(part.schema.get_field_index(x)).to_pylist() for x in ("low", "n"))
            removed, spans, digests, bodies = [], [], [], []
            for i, text in enumerate(texts):
                gone = covered(np.array(lows[i] or [], np.int64), np.array(ns[i] or [], np.int64), WINDOW, len(text))
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).view(np.int8)))
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                removed.append(int(gone.sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                digests.append(hashlib.sha256(kept).hexdigest())
                bodies.append(kept if keep else None)
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(digests, pa.string()), pa.array(bodies, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])

    return cut


def dedup(docs: DataFrame, keep: bool = True, part: int = PART) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, end), kept_sha256 and, with ``keep``, the remaining bytes."""
    return removals(docs, repeated_windows(docs, part)).mapInArrow(
        _cut(keep), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, "
                    "kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, keep=False).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")

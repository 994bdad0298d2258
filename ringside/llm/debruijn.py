"""Substring dedup by de Bruijn compaction over word windows.

The edges of the graph are the word k-mers of WINDOW words; two edges follow each other where they share all words but
one. Consecutive edges with one minimizer (see ``windows``) are a path, the form in which edges travel: a row stands for
up to WINDOW - GRAM + 1 of them. In a bucket where all paths are equal the path does not branch, is compacted to one row
by its first source, and a join gives that source to every copy. Paths of the other buckets branch there or end early:
they are compacted to one row per different path and opened into edges, which meet by hash and get their smallest
document. A path that a document holds again is not opened again: it loses the edges that its first occurrence there
loses. Paths and edges that repeat are glued into maximal spans in each document by their source coordinates, and
every span is verified to lie on windows of that document.

A word goes if a window that covers it also starts in a document with a smaller id.

Defined results: null, empty or blank texts have no words; texts under WINDOW words lose nothing. Rows without a
``doc_id`` lose nothing and are no source. ``doc_id`` names a text: rows that share one should be equal, and lose the
union of what their id loses. Repeats inside one document stay unless an earlier document has them. Empty tables give no
rows. Only ``doc_id`` and the text column are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, Words, kept_table, text_batches
from .windows import Kind, covered, removals, shared_runs, with_texts

WINDOW, GRAM = 50, 16
KIND = Kind("debruijn", WINDOW, GRAM, words=True)


def _edges(batches):
    """Open paths as single edges: doc_id, path (where it begins), low, bucket, hash."""
    for part, texts in text_batches(batches):
        words = Words(texts)
        rolling = Rolling(words.hash)
        listed = part.column(part.schema.get_field_index("runs"))
        fields = listed.flatten()
        owner = np.repeat(np.arange(len(texts)), np.asarray(listed.value_lengths().fill_null(0)))
        low, n, bucket = (np.asarray(fields.field(x)).astype(np.int64) for x in ("low", "n", "bucket"))
        at = np.repeat(np.arange(len(low)), n)
        step = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        place = low[at] + step
        start = words.first[owner[at]] + place
        fits = start + WINDOW <= words.first[owner[at] + 1]
        at, place, start = at[fits], place[fits], start[fits]
        yield pa.RecordBatch.from_arrays(
            [part.column(0).take(pa.array(owner[at])), pa.array(low[at], pa.int32()), pa.array(place, pa.int32()),
             pa.array(bucket[at]), pa.array(rolling.span(start, start + WINDOW).view(np.int64))],
            ["doc_id", "path", "low", "bucket", "hash"])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """Runs of windows that also start in a document with a smaller id: doc_id, low, n."""
    shared = shared_runs(docs.select("doc_id", "text"), KIND)
    copies = kept_table(shared.certain.where(F.col("first.doc_id") <= F.col("doc_id")).select(
        "doc_id", "low", "n", F.col("first.doc_id").alias("source"), F.col("first.low").alias("path")), "debruijn-copies")
    certain = copies.where("source < doc_id").select("doc_id", "low", "n")
    edges = kept_table(with_texts(docs, shared.open).mapInArrow(
        _edges, "doc_id long, path int, low int, bucket long, hash long"), "debruijn-edges")
    sources = edges.groupBy("bucket", "hash").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where(
        "source < last").select("bucket", "hash", "source")
    opened = kept_table(edges.join(sources, ["bucket", "hash"]).where("source < doc_id").select(
        "doc_id", "path", "low"), "debruijn-opened")
    # equal paths of the first one's own document
    again = copies.where("source = doc_id").select("doc_id", "path", F.col("low").alias("start")).distinct()
    same = opened.join(again, ["doc_id", "path"]).select("doc_id", (F.col("start") + F.col("low") - F.col("path")).alias("low"))
    return certain.union(opened.select("doc_id", "low").union(same).select("doc_id", "low", F.lit(1).alias("n")))


def _cut(keep: bool):
    def cut(batches):
        for part, texts in text_batches(batches):
            words = Words(texts)
            lows, ns = (part.column(part.schema.get_field_index(x)).to_pylist() for x in ("low", "n"))
            sizes, removed, bodies, digests = [], [], [], []
            for i, text in enumerate(texts):
                s, e = words.first[i], words.first[i + 1]
                gone = covered(np.array(lows[i] or [], np.int64), np.array(ns[i] or [], np.int64), WINDOW, e - s)
                at = words.offset[i]
                kept = b" ".join([text[a - at : b - at] for a, b in zip(
                    words.start[s:e][~gone].tolist(), words.end[s:e][~gone].tolist(), strict=True)])
                sizes.append(int(e - s))
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                bodies.append(kept.decode("utf-8", "replace") if keep else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()),
                 pa.array(bodies, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "text"])

    return cut


def dedup(docs: DataFrame, keep: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``keep``, the remaining text, for every row."""
    return removals(docs, repeated_windows(docs)).mapInArrow(
        _cut(keep), "doc_id long, n_words long, n_removed long, kept_sha256 string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, keep=False).drop("text")

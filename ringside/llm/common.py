"""What the operators share: tables in the shared folder, batches of texts as arrays, connected components."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringside.session import free_shuffles, scratch_path

U64 = np.uint64
#: Odd multiplier of the rolling polynomial over 64-bit symbols; its inverse modulo 2**64 undoes a shift.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Symbols of one vectorised step: bounds the memory of a Python worker, never the length of a text.
STEP = 1 << 19
#: White space of the word rule [^\x20\x09-\x0D]+ (fixed values).
BLANKS = b" \t\n\x0b\x0c\r"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Rows go to Python in batches of 1000 while a table is written, so that a worker holds few whole texts at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def kept_table(df: DataFrame, name: str, batch: int = 1000, files: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the rows survive lost executors and are not worked out twice.

    ``batch`` is the rows that go to Python at a time, ``files`` the rows of a file at most (0: as many as there are).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    with small_batches(spark, batch):
        (df.write.option("maxRecordsPerFile", files) if files else df.write).parquet(path)
    del df
    free_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


#: Rows up to which a narrow table (a few fixed-width columns) goes to all tasks: some 10 MB.
BROADCAST_ROWS = 100_000


def checked_broadcast(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it has at most BROADCAST_ROWS rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits (multiply and shift)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def powers(n: int, base: int) -> np.ndarray:
    out = np.empty(max(n, 1), U64)
    out[0] = 1
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


class Rolling:
    """Hashes of any substring of a symbol array in constant time each (polynomial modulo 2**64, then mixed)."""

    _pow = powers(1, BASE)
    _inv = powers(1, BASE_INVERSE)

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        if len(Rolling._pow) < n + 1:
            Rolling._pow, Rolling._inv = powers(n + 1, BASE), powers(n + 1, BASE_INVERSE)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(symbols * Rolling._pow[:n], out=self.sums[1:])

    def span(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Rolling._inv[start])

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k symbols from every position."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[k:] - self.sums[:-k]) * Rolling._inv[:n])


#: One random 64-bit value per byte, from a fixed rule.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))


class Words:
    """The words of a batch of texts as arrays: 64-bit hash, byte range and text number of each."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(joined, np.uint8)
        blank = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        if len(self.end) < len(self.start):
            self.end = np.append(self.end, len(self.data))
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offset = np.concatenate(([0], np.cumsum(lengths)))
        #: number of the first word of each text, and one past the last
        self.first = np.searchsorted(self.start, self.offset)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        # every byte is mixed with its place in the word before it is added, so no arrangement of bytes cancels out
        place = np.zeros(len(self.data), np.int64)
        place[self.start] = self.start
        np.maximum.accumulate(place, out=place)
        np.subtract(np.arange(len(place)), place, out=place)
        sums = np.zeros(len(place) + 1, U64)
        np.cumsum(mix(BYTE_VALUES[self.data] + place.view(U64) * U64(BASE)), out=sums[1:])
        self.hash = mix(sums[self.end] - sums[self.start] + (self.end - self.start).astype(U64) * U64(BASE))


def text_batches(frames: Iterator, size: int = STEP) -> Iterator[tuple]:
    """Split Arrow batches into slices of about ``size`` bytes of text: (batch slice, list of UTF-8 texts).

    The text column must be binary; a null counts as empty. A text longer than ``size`` comes alone and whole.
    """
    for batch in frames:
        column = batch.column(batch.schema.get_field_index("body"))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = used = 0
        for i in range(len(sizes) + 1):
            if i == len(sizes) or used and used + sizes[i] > size:
                if i > start:
                    yield batch.slice(start, i - start), [t or b"" for t in column.slice(start, i - start).to_pylist()]
                start, used = i, 0
            if i < len(sizes):
                used += sizes[i] + 1


def bodies(docs: DataFrame, *columns, text: str = "text") -> DataFrame:
    """Chosen columns and the whole text as UTF-8 bytes in ``body`` (null: empty)."""
    return docs.select(*columns, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))


def components(edges: DataFrame, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest vertex reachable from every vertex of ``edges``: columns ``vertex``, ``root``.

    Each round gives every vertex the smallest label around it and then the label of that label (pointer jumping), so
    the rounds grow with the logarithm of a chain's length. Joins and minima only: a hub's messages are combined on the
    map side and its join rows are split by adaptive execution. Only one count reaches the driver.
    """
    spark = edges.sparkSession
    both = kept_table(
        edges.select(F.col(a).alias("v"), F.col(b).alias("u"))
        .union(edges.select(F.col(b).alias("v"), F.col(a).alias("u")))
        .where("v is not null and u is not null and v <> u").distinct(), f"{name}-edges")
    labels = kept_table(both.groupBy(F.col("v").alias("vertex"))
                        .agg(F.least(F.min("u"), F.first("v")).alias("root")), f"{name}-labels")
    while True:
        around = both.join(labels.select(F.col("vertex").alias("u"), F.col("root").alias("other")), "u").groupBy(
            F.col("v").alias("vertex")).agg(F.min("other").alias("near"))
        stepped = labels.join(around, "vertex").select(
            "vertex", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        target = labels.select(F.col("vertex").alias("root"), F.col("root").alias("further"))
        moved = kept_table(stepped.join(target, "root", "left").select(
            "vertex", "old", F.least("root", F.coalesce("further", "root")).alias("root")), f"{name}-labels")
        changed = moved.where("old <> root").limit(1).count()
        labels = moved.select("vertex", "root")
        if not changed:
            return labels

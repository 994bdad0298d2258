"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Words (lower case) are the symbols. Items fall into classes by their number of words, w in [c, 2c) with c a power of
two. A class looks at windows of 3c/4 words: all of them in its items, those at every (c/4)-th word in the documents, so
that any passage of an item's length holds a whole document window. The random walk of Chakraborty, Goldenberg and
Koucky copies the current symbol and moves on by one symbol or none, as a random function of step and symbol says;
texts at edit distance k then differ in O(k^2) places. A key samples COORDINATES of those places; REPEATS independent
walks and samples give each window as many chances. Windows whose key meets an item's propose the item at one
alignment, which the exact edit distance (bit-parallel, item against the best-placed part of the document) accepts up
to MAX_EDITS of the item's characters. Measured recall is in the tests.

The benchmark is a stated query set: it is taken in blocks of at most BLOCK_BYTES, each sent to the tasks once, and
every document is read whole and never shuffled.

Defined results: a null text has no words and no hit. Items of fewer than MIN_WORDS words, null or empty ones included,
cannot be told from ordinary prose and are not searched. Repeated documents are each reported, repeated items each under
their own id. An item that occurs several times in a document is reported once with its smallest distance, the leftmost
on ties. An empty table gives no rows. Only ``doc_id``, ``item_id`` and the text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, STEP, U64, Words, bodies, mix, text_batches

MIN_WORDS = 4
MAX_EDITS = 0.2
COORDINATES, REPEATS = 4, 6
BLOCK_BYTES = 8 << 20
#: Places of a sieve: SPARSE for each key of the items, at most _SIEVE; fewer would let too many windows through.
_SIEVE, SPARSE = 1 << 20, 64

SCHEMA = "doc_id long, item_id long, distance int, similarity double, start long, end long"


def edit_search(pattern: str, text: str) -> tuple[int, int]:
    """Smallest edit distance of ``pattern`` to any part of ``text`` and where the leftmost such part ends.

    Bit-parallel columns (Myers 1999) on whole-number bit vectors, so patterns of any length are exact.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, at = full, 0, m, m, 0
    for i, ch in enumerate(text):
        eq = masks.get(ch, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        if score < best:
            best, at = score, i + 1
    return best, at


@dataclass
class Walk:
    """One repeat of one class: which steps of the walk are sampled, and the items' keys."""

    size: int
    stride: int
    steps: np.ndarray
    seed: int
    keys: np.ndarray | None = None
    items: np.ndarray | None = None
    shifts: np.ndarray | None = None
    sieves: list | None = None

    def bits(self, symbols: np.ndarray, block: int) -> np.ndarray:
        return mix(symbols ^ U64((self.seed + block * BASE) & (1 << 64) - 1))

    def run(self, symbols: np.ndarray, at: np.ndarray, sift: bool):
        """Keys of the windows at ``at``; with ``sift`` windows leave as soon as no item shares their prefix."""
        n, size = len(symbols), self.size
        random = self.bits(symbols, 0)
        place, key, keys = np.zeros(len(at), np.int64), np.zeros(len(at), U64), []
        sampled = 0
        for step in range(int(self.steps[-1]) + 1):
            if step and step % 64 == 0:
                random = self.bits(symbols, step // 64)
            where = np.minimum(at + place, n - 1)
            over = place >= size
            if step == self.steps[sampled]:
                key = mix(key * U64(BASE) + np.where(over, U64(1), symbols[where]))
                sampled += 1
                keys.append(key)
                if sift:
                    sieve = self.sieves[sampled - 1]
                    stay = sieve[(key & U64(len(sieve) - 1)).astype(np.int64)]
                    at, place, key, where, over = at[stay], place[stay], key[stay], where[stay], over[stay]
            place += ((random[where] >> U64(step % 64)) & U64(1)).astype(np.int64) * ~over
        return at, keys if not sift else key


class Index:
    """A block of benchmark items, ready to be searched for in documents."""

    def __init__(self, ids: list, texts: list[str], max_edits: float = MAX_EDITS):
        self.max_edits = max_edits
        lowered = [(t or "").lower() for t in texts]
        words = Words([t.encode() for t in lowered])
        self.ids, self.texts, self.words = ids, [" ".join(t.split()) for t in lowered], words
        self.bags = [set(words.hash[s:e].tolist()) for s, e in zip(words.first, words.first[1:], strict=False)]
        self.walks: list[Walk] = []
        counts = words.counts
        classes = sorted({1 << int(c).bit_length() - 1 for c in counts if c >= MIN_WORDS})
        for low in classes:
            size, stride = max(1, 3 * low // 4), max(1, low // 4)
            members = np.flatnonzero((counts >= low) & (counts < 2 * low))
            spans = [np.arange(words.first[i], words.first[i + 1] - size + 1) for i in members]
            at = np.concatenate(spans)
            owner = np.repeat(members, [len(s) for s in spans])
            for repeat in range(REPEATS):
                seed = int(mix(np.array([low * 1000 + repeat + 1], U64) * U64(BASE))[0])
                steps = np.sort(np.random.default_rng(seed).choice(
                    2 * size, min(COORDINATES, 2 * size), replace=False))
                walk = Walk(size, stride, steps, seed)
                _, keys = walk.run(words.hash, at, sift=False)
                walk.sieves = []
                for key in keys:
                    sieve = np.zeros(min(_SIEVE, 1 << (SPARSE * len(key)).bit_length()), bool)
                    sieve[(key & U64(len(sieve) - 1)).astype(np.int64)] = True
                    walk.sieves.append(sieve)
                order = np.argsort(keys[-1], kind="stable")
                walk.keys, walk.items = keys[-1][order], owner[order]
                walk.shifts = (at - words.first[owner])[order]
                self.walks.append(walk)

    def candidates(self, docs: Words) -> set[tuple[int, int, int]]:
        """(text, item, word at which the item would start) proposed by the windows of a batch."""
        found: set[tuple[int, int, int]] = set()
        inside = np.arange(len(docs.hash)) - docs.first[docs.text]
        for walk in self.walks:
            at = np.flatnonzero((inside % walk.stride == 0) & (inside + walk.size <= docs.counts[docs.text]))
            at, key = walk.run(docs.hash, at, sift=True)
            low, high = np.searchsorted(walk.keys, key), np.searchsorted(walk.keys, key, side="right")
            for p, s, e in zip(at[high > low], low[high > low], high[high > low], strict=True):
                for k in range(s, e):
                    found.add((int(docs.text[p]), int(walk.items[k]), int(p - walk.shifts[k])))
        return found

    def search(self, texts: list[bytes]) -> dict[tuple[int, int], tuple[int, int, int]]:
        """Best (distance, start, end in characters of the lower-case text) for every (text, item) within bounds."""
        if not self.walks:
            return {}
        lowered = [t.decode("utf-8", "replace").lower().encode() for t in texts]
        docs = Words(lowered)
        if not len(docs.hash):
            return {}
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for text, item, at in sorted(self.candidates(docs)):
            count, pattern = int(self.words.counts[item]), self.texts[item]
            slack = int(self.max_edits * count) + 2
            first = max(int(docs.first[text]), at - slack)
            last = min(int(docs.first[text + 1]), at + count + slack)
            if last <= first or len(self.bags[item].intersection(docs.hash[first:last].tolist())) * 4 < len(
                    self.bags[item]):
                continue
            start, end = int(docs.start[first]), int(docs.end[last - 1])
            region = docs.data[start:end].tobytes().decode("utf-8", "replace")
            spaced = " ".join(region.split())
            distance, stop = edit_search(pattern, spaced)
            if distance > self.max_edits * len(pattern):
                continue
            before = len(docs.data[docs.offset[text] : start].tobytes().decode("utf-8", "replace"))
            hit = (distance, before + max(0, stop - len(pattern)), before + stop)
            if (text, item) not in best or hit < best[text, item]:
                best[text, item] = hit
        return best


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[pd.DataFrame]:
    """The benchmark in blocks of about ``block_bytes``; one is on the driver at a time when iterated lazily."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = int(total // block_bytes) + 1
    for k in range(count):
        yield items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).orderBy("item_id").toPandas()


def find(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """Every (document, item) whose item occurs within the edit bound."""
    source, out = bodies(docs, F.col("doc_id").cast("long").alias("doc_id")), None
    for block in blocks(benchmark):
        hits = source.mapInArrow(_reporter(block, max_edits), SCHEMA)
        out = hits if out is None else out.union(hits)
    return out


def _reporter(block: pd.DataFrame, max_edits: float):
    ids, texts = block["item_id"].tolist(), block["text"].tolist()

    def report(batches):
        index = Index(ids, texts, max_edits)
        for part, bodies_ in text_batches(batches):
            docs, rows = part.column(0).to_pylist(), []
            for (text, item), (distance, start, end) in sorted(index.search(bodies_).items()):
                rows.append((docs[text], ids[item], distance, 1 - distance / len(index.texts[item]), start, end))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "item_id", "distance", "similarity", "start", "end"])

    return report


def _free(block: pd.DataFrame, max_edits: float):
    """Boolean UDF over UTF-8 texts: no item of the block occurs in it."""
    ids, texts = block["item_id"].tolist(), block["text"].tolist()
    held: list[Index] = []

    @F.pandas_udf("boolean")
    def free(column: pd.Series) -> pd.Series:
        if not held:
            held.append(Index(ids, texts, max_edits))
        bodies_ = [b"" if x is None else bytes(x) for x in column]
        out, start, used = np.ones(len(bodies_), bool), 0, 0
        for i in range(len(bodies_) + 1):
            if i == len(bodies_) or used and used + len(bodies_[i]) > STEP:
                for text, _ in held[0].search(bodies_[start:i]):
                    out[start + text] = False
                start, used = i, 0
            if i < len(bodies_):
                used += len(bodies_[i]) + 1
        return pd.Series(out)

    return free


def clean(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """Documents without any benchmark item, columns unchanged; nothing is shuffled."""
    for block in blocks(benchmark):
        docs = docs.where(_free(block, max_edits)(F.col("text").cast("binary")))
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

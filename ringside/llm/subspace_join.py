"""Embedding near duplicates by a subspace pigeonhole join.

Unit vectors at cosine c or more are at a squared distance of at most 2 - 2c. A random rotation spreads that distance
over blocks of BLOCK_DIMENSIONS coordinates; whatever the spread, one of k blocks holds at most a k-th of it. So every
block is range-joined on its own under that budget, and the union of the blocks' candidates is verified exactly, by the
cosine of the vectors as given, in double precision. A pair belongs to the first block that proposes it, so that it is
counted once.

The vectors are packed into tiles of at most TILE vectors or TILE_BYTES, which are written once, and every pair of tiles
is one piece of work: its task reads the two tiles from the shared folder (a Cartesian product of tile rows, without a
shuffle), so the disk holds every distinct vector twice (the shuffle that finds equal ones, the tiles), however many
pairs there are, and a worker holds a few tiles. Inside a pair of tiles the range join of a block goes along its first
coordinate in order: partners lie within the budget's radius, and their distance in the block is a matrix product. Tasks
give link counts and links to a local root, never pairs.

Equal vectors are one vector with a number of copies. Components are those of the links.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component link with nothing, and only
vectors of one length link. Repeated rows are copies. Rows with a null ``vec_id`` link with nothing. Ties do not
matter: a pair at exactly the threshold is linked. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import components, kept_table

COSINE = 0.95
BLOCK_DIMENSIONS = 8
#: Vectors and bytes (in double precision) of a tile. Small tables are cut into about LEAST_TILES of at least LEAST_ROWS.
TILE, TILE_BYTES = 16_384, 8 << 20
LEAST_TILES, LEAST_ROWS = 16, 1024
#: Left and right rows of one step inside a pair of tiles, bytes of the vectors of one verification: they bound memory.
_STEP, _ACROSS, _CHECK_BYTES = 256, 2048, 16 << 20
#: Room for rounding in the products of a step, which are in single precision and only propose.
_SLACK = 1e-5
_TILES = "tile long, size int, reps binary, copies binary, vectors binary"


@functools.lru_cache(maxsize=8)
def rotation(size: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))[0]


def blocks_of(size: int) -> list[slice]:
    count = max(1, round(size / BLOCK_DIMENSIONS))
    edges = np.linspace(0, size, count + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _turned(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(x.shape[1])


def _radius(size: int, cosine: float) -> float:
    """Radius of a block's share, with room for rounding."""
    return math.sqrt((2 - 2 * cosine) / len(blocks_of(size)) + 1e-9)


def _packer(kind: str):
    """Vectors as bytes of one float type, equal where the vectors are equal."""

    def pack(frames):
        for frame in frames:
            packed = [None if v is None else (np.asarray(v, "<f8") + 0.0).astype(kind).tobytes() for v in frame["value"]]
            frame["size"] = pd.array([None if p is None else len(p) // np.dtype(kind).itemsize for p in packed], "Int32")
            frame["vector"] = packed
            yield frame.assign(vec_id=frame["vec_id"].astype("Int64"))[["vec_id", "size", "vector"]]

    return pack


def _tiler(rows: int):
    """Distinct vectors as rows of a tile each; a task leaves one smaller tile per size."""

    def tile(batches):
        waiting: dict[int, list] = {}
        first, made = TaskContext.get().partitionId() << 32, 0

        def full(size: int) -> pa.RecordBatch:
            nonlocal made
            reps, copies, vectors = zip(*waiting.pop(size), strict=True)
            made += 1
            return pa.RecordBatch.from_pydict({
                "tile": pa.array([first + made], pa.int64()), "size": pa.array([size], pa.int32()),
                "reps": [np.array(reps, "<i8").tobytes()], "copies": [np.array(copies, "<i8").tobytes()],
                "vectors": [b"".join(vectors)]})

        for batch in batches:
            for size, *row in zip(*(batch.column(c).to_pylist() for c in ("size", "rep", "copies", "vector")), strict=True):
                held = waiting.setdefault(size, [])
                held.append(row)
                if len(held) >= max(1, min(rows, TILE_BYTES // (8 * size))):
                    yield full(size)
        for size in list(waiting):
            yield full(size)

    return tile


class _Tile:
    """A tile in memory: ids, copies, vectors as given, turned unit vectors."""

    def __init__(self, size: int, reps, copies, vectors, kind: str):
        self.reps, self.copies = np.frombuffer(reps, "<i8"), np.frombuffer(copies, "<i8")
        self.x = np.frombuffer(vectors, kind).reshape(-1, size).astype("<f8")
        self.norm, self.turned = np.linalg.norm(self.x, axis=1), _turned(self.x)

    def along(self, block: slice) -> tuple:
        """Positions in order of the block's first coordinate, that coordinate, and both factors of squared distances."""
        order = np.argsort(self.turned[:, block.start], kind="stable")
        low = self.turned[order, block]
        square, one = (low * low).sum(1, keepdims=True), np.ones((len(low), 1))
        return (order, low[:, 0], np.concatenate([-2 * low, square, one], 1).astype("<f4"),
                np.concatenate([low, one, square], 1).astype("<f4"))


def _near(a: np.ndarray, b: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b whose product is within the budget: few, so eight answers are looked at as one word."""
    wide = -(-len(b) // 8) * 8
    close = np.zeros((len(a), wide), bool)
    np.less_equal(a @ b.T, np.float32(budget + _SLACK), out=close[:, : len(b)])
    words = close.view(np.uint64).reshape(-1)
    hit = np.flatnonzero(words)
    at, byte = np.nonzero(words[hit].view(np.uint8).reshape(-1, 8))
    return np.divmod(hit[at] * 8 + byte, wide)


def _proposed(a: _Tile, b: _Tile, block: slice, budget: float):
    """Positions of pairs that may be within the budget of one block; every pair of a tile with itself once."""
    left, mine, factors, _ = a.along(block)
    right, theirs, _, others = b.along(block)
    reach = math.sqrt(budget) + 1e-9
    for s in range(0, len(left), _STEP):
        last = min(s + _STEP, len(left))
        low = s if a is b else np.searchsorted(theirs, mine[s] - reach)
        high = np.searchsorted(theirs, mine[last - 1] + reach, "right")
        for t in range(low, high, _ACROSS):
            i, j = _near(factors[s:last], others[t : min(t + _ACROSS, high)], budget)
            if a is b:
                later = j + t > i + s
                i, j = i[later], j[later]
            yield left[s + i], right[t + j]


def _hook(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the sets of i and j in ``labels`` (each label is the smallest position known)."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def _linked(a: _Tile, b: _Tile, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of two tiles (or one) that link: id, links, id of a local root."""
    size = a.x.shape[1]
    parts, budget = blocks_of(size), _radius(size, cosine) ** 2
    shift = 0 if a is b else len(a.reps)
    rep = a.reps if a is b else np.concatenate([a.reps, b.reps])
    links, labels, check = np.zeros(len(rep), np.int64), np.arange(len(rep)), max(1, _CHECK_BYTES // (8 * size))
    for block, part in enumerate(parts):
        for i, j in _proposed(a, b, part, budget):
            for c in range(0, len(i), check):
                p, q = i[c : c + check], j[c : c + check]
                ok = np.einsum("ij,ij->i", a.x[p], b.x[q]) >= cosine * a.norm[p] * b.norm[q]
                p, q = p[ok], q[ok]
                if not len(p):
                    continue
                apart = (a.turned[p] - b.turned[q]) ** 2
                shares = np.stack([apart[:, k].sum(1) for k in parts], 1) <= budget
                # the first block that proposes the pair counts it
                mine = shares.argmax(1) == block
                mine &= shares[:, block]
                p, q = p[mine], q[mine]
                np.add.at(links, p, b.copies[q])
                np.add.at(links, q + shift, a.copies[p])
                _hook(labels, p, q + shift)
    got = links > 0
    return rep[got], links[got], rep[labels[got]]


def _joiner(cosine: float, kind: str):
    def join(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at] for c in batch.schema.names}
                a, b = (_Tile(row["size"].as_py(), *(row[f"{side}_{c}"].as_buffer() for c in ("reps", "copies", "vectors")), kind)
                        for side in ("a", "b"))
                rep, links, root = _linked(a, a if row["a_tile"] == row["b_tile"] else b, cosine)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (rep, links, root)], ["rep", "links", "root"])

    return join


def _pairs_of_tiles(tiles: DataFrame) -> DataFrame:
    """Every two tiles of one size once, in either order by turns, so that the tasks of the product have equal work."""

    def side(name: str) -> DataFrame:
        return tiles.select(*(F.col(c).alias(f"{name}_{c}") for c in tiles.columns))

    first, second = F.col("a_tile"), F.col("b_tile")
    turn = F.xxhash64(F.least(first, second), F.greatest(first, second)) % 2 == 0
    both = side("a").join(side("b").hint("shuffle_replicate_nl"), (F.col("a_size") - F.col("b_size") == 0)
                          & ((first == second) | ((first < second) == turn)))
    return both.withColumnRenamed("a_size", "size").drop("b_size")


def link(vectors: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    # vectors of single precision stay so on disk; the sums are in double precision
    kind = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    value = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    fine = (F.size("value") > 0) & F.forall("value", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) \
        & F.exists("value", lambda x: x != 0) & F.col("vec_id").isNotNull()
    packed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("value")).select(
        "vec_id", F.when(fine, F.col("value")).alias("value")).mapInPandas(_packer(kind), "vec_id long, size int, vector binary")
    # the vectors themselves meet their equals once; from then on their SHA-256 stands for them
    rows = kept_table(packed.select("vec_id", F.unhex(F.sha2("vector", 256)).alias("key")), "subspace-rows")
    known = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    distinct = known.count()
    per_tile = min(tile, max(LEAST_ROWS, -(-distinct // LEAST_TILES)))
    tiles = packed.where("vector is not null").groupBy("size", "vector").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies")).coalesce(-(-distinct // (4 * per_tile)) or 1)
    tiles = kept_table(tiles.mapInArrow(_tiler(per_tile), _TILES), "subspace-tiles", files=1)
    found = kept_table(_pairs_of_tiles(tiles).mapInArrow(_joiner(cosine, kind), "rep long, links long, root long"),
                       "subspace-links", batch=1)
    roots = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), "subspace")
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = known.join(totals, "rep", "left").join(roots, F.col("rep") == F.col("vertex"), "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "rep").alias("component_id"))
    linked = rows.where("key is not null").join(classes, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                             F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

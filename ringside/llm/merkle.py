"""Merkle manifest of a dataset with incremental witnesses.

A leaf is the digest of a row's fields. Per source, leaves ascend by ``doc_id``; every FAN consecutive nodes (the last run
may be shorter, even one) become their digest until one node is left, the source's root. The sources' roots, ordered by
source, make the root in the same way. A witness of a leaf is what its way to the root needs: the other nodes of each run.

Witnesses grow while nodes are appended (``OpenTree``): an open subtree carries the partial witnesses of all leaves under
it. A node that is completed beside it extends them at once, and takes over the open ones to its left; a full run closes
and is itself appended one level up. Nothing is looked up afterwards and a tree is never walked down.

On Spark the leaves of a source are cut at aligned positions into blocks of FAN ** HEIGHT. Each block is appended in one
task. The block roots are further appends: they are cut and appended the same way until every source has one node, then
the sources' roots. A leaf's witness is its own block's part followed by the parts of the blocks above it, so only block
roots travel upwards and one witness per block comes down; no group, source or tree sits in one task.

Defined results: a null field is ``-``; a null source is a source and comes first; a null ``doc_id`` comes first. Rows of
equal ``doc_id`` are leaves of their own, ordered by leaf. A source of one row has that leaf as root, and one source has
its root as root; a leaf without siblings has an empty witness. An empty table gives no rows. Only the columns named in
FIELDS are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_table, table
from .ranks import positions

FAN = 3
#: Levels that one task builds; a block is FAN ** HEIGHT nodes.
HEIGHT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32


def digest_of(nodes: list[bytes]) -> bytes:
    """Digest of the nodes' lower-case hex texts, one after the other."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def height_of(total: int) -> int:
    levels = 0
    while total > 1:
        total, levels = -(-total // FAN), levels + 1
    return levels


class OpenTree:
    """A tree that is appended to; ``witnesses`` of its leaves are extended as their siblings are completed."""

    def __init__(self) -> None:
        #: per level the open run: (digest, witnesses of the leaves below)
        self.runs: list[list[tuple[bytes, list[bytearray]]]] = []
        self.witnesses: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        own = bytearray()
        self.witnesses.append(own)
        self._put(0, digest, [own])

    def _put(self, level: int, digest: bytes, below: list[bytearray]) -> None:
        if level == len(self.runs):
            self.runs.append([])
        run = self.runs[level]
        if len(run) == FAN:
            self._close(level)
            run = self.runs[level]
        for _, theirs in run:
            for witness in theirs:
                witness += digest
        if run:
            left = b"".join([d for d, _ in run])
            for witness in below:
                witness += left
        run.append((digest, below))

    def _close(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        self._put(level + 1, digest_of([d for d, _ in run]), [w for _, below in run for w in below])

    def finish(self, height: int) -> bytes:
        """Close what is open up to ``height`` levels and give the one node there."""
        for level in range(height):
            self._close(level)
        (root, _), = self.runs[height]
        return root


def fold(node: bytes, witness: bytes, places: list[tuple[int, int]]) -> bytes:
    """The root that ``node`` and its ``witness`` lead to; ``places``: (position, nodes) in each tree on the way up."""
    at = 0
    for pos, total in places:
        while total > 1:
            inner = pos % FAN
            others = min(FAN, total - pos + inner) - 1
            split = at + inner * DIGEST
            end = at + others * DIGEST
            node = digest_of([witness[at:split], node, witness[split:end]])
            at, pos, total = end, pos // FAN, -(-total // FAN)
    return node


def _append(height: int):
    """Append the nodes of each block, given in order; a block starts where the position is a multiple of its size."""
    size = FAN**height

    def closed(parts: list[pa.RecordBatch], tree: OpenTree, total: int):
        root = tree.finish(min(height, height_of(total)))
        rows = pa.Table.from_batches(parts).combine_chunks()
        first = [root, *[None] * (rows.num_rows - 1)]
        yield from rows.append_column("witness", pa.array([bytes(w) for w in tree.witnesses], pa.binary())).append_column(
            "block_root", pa.array(first, pa.binary())).to_batches()

    def work(batches):
        held, tree, of = [], OpenTree(), 0
        for batch in batches:
            names = batch.schema.names
            pos, totals = (batch.column(names.index(c)).to_pylist() for c in ("pos", "total"))
            nodes = batch.column(names.index("digest")).to_pylist()
            start = 0
            for i, node in enumerate(nodes):
                if pos[i] % size == 0 and (held or i):
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield from closed(held, tree, of)
                    held, tree, start = [], OpenTree(), i
                of = totals[i]
                tree.append(node)
            if start < len(nodes):
                held.append(batch.slice(start))
        if held:
            yield from closed(held, tree, of)

    return work


def _block(height: int) -> Column:
    return F.floor(F.col("pos") / FAN**height).cast("long")


@dataclass
class Grown:
    """A finished forest: one table per round of appends, and one root per group."""

    rounds: list[DataFrame]
    roots: DataFrame


def grow(nodes: DataFrame, groups: list[str], name: str, height: int = HEIGHT) -> Grown:
    """Append ``nodes`` (groups, pos, total, digest, further columns) to one tree per group, block by block.

    Every table of the result has its input's columns, ``witness`` inside the block and, in the first row of a block,
    ``block_root``; ``roots`` has the groups and ``digest``.
    """
    size, rounds = FAN**height, []
    while True:
        ready = nodes.withColumn("block_", _block(height))
        keys = [*groups, "block_"]
        ready = ready.repartition(*keys).sortWithinPartitions(*keys, "pos").drop("block_")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema)
        done = kept_table(ready.mapInArrow(_append(height), f"{fields}, witness binary, block_root binary"), name)
        rounds.append(done)
        nodes = done.where("block_root is not null").select(
            *groups, _block(height).alias("pos"), F.ceil(F.col("total") / size).cast("long").alias("total"),
            F.col("block_root").alias("digest"))
        # one number reaches the driver
        if (done.agg(F.max("total")).first()[0] or 0) <= size:
            return Grown(rounds, nodes.select(*groups, "digest"))


def whole_witness(grown: Grown, groups: list[str], height: int = HEIGHT) -> DataFrame:
    """The first round's rows with the parts of all later rounds added to ``witness``; joins on (groups, block)."""
    above = None
    for done in reversed(grown.rounds):
        if above is not None:
            upper = above.select(*[F.col(g).alias(f"of_{g}") for g in groups], F.col("pos").alias("of_block"),
                                 F.col("witness").alias("further"))
            same = _block(height) == F.col("of_block")
            for g in groups:
                same &= F.col(g).eqNullSafe(F.col(f"of_{g}"))
            done = done.join(upper, same).withColumn("witness", F.concat("witness", "further")).drop(
                *upper.columns)
        above = done
    return above.drop("block_root")


def encoded(fields: dict[str, Column]) -> Column:
    """The fields one after the other: ``-`` if null, else UTF-8 byte count, a colon and the value."""
    parts = []
    for value in fields.values():
        text = value.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.concat(*parts)


def leaf(fields: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(encoded(fields), 256))


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """One row per document row: source, doc_id, leaf, witness, its place (pos, total) in the source, the source's place
    (source_pos, sources), subroot, root and, with ``changed`` values of fields, the leaf of those (``other``)."""
    fields = {c: F.col(c) for c in FIELDS}
    rows = docs.select(
        F.col("source").cast("string").alias("source"), "doc_id", leaf(fields).alias("digest"),
        leaf({**fields, **(changed or {})}).alias("other") if changed else F.lit(None).cast("binary").alias("other"))
    leaves = positions(rows, ["source"], ["doc_id", "digest"], "merkle-leaves")
    trees = grow(leaves, ["source"], "merkle-trees", height)
    roots = positions(trees.roots.withColumn("all_", F.lit(0)), ["all_"], ["source"], "merkle-roots")
    crown = grow(roots, ["all_"], "merkle-crown", height)
    summit = crown.roots.select(F.col("all_"), F.col("digest").alias("root"))
    top = whole_witness(crown, ["all_"], height).join(summit, "all_").select(
        F.col("source").alias("of"), F.col("digest").alias("subroot"), "root", F.col("pos").alias("source_pos"),
        F.col("total").alias("sources"), F.col("witness").alias("crown"))
    return whole_witness(trees, ["source"], height).join(top, F.col("source").eqNullSafe(F.col("of"))).select(
        "source", "doc_id", F.col("digest").alias("leaf"), "other", F.concat("witness", "crown").alias("witness"),
        "pos", "total", "source_pos", "sources", "subroot", "root")


def _prove(batches):
    """Digest of every witness and the root it leads to from ``other`` (from the leaf where that is null)."""
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        proofs, folded = [], []
        for node, other, witness, pos, total, at, sources in zip(*columns[1:8], strict=True):
            proofs.append(digest_of([witness]).hex())
            folded.append(fold(other or node, witness, [(pos, total), (at, sources)]).hex())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array([x.hex() for x in columns[i]], pa.string()) for i in (1, 8, 9)],
             pa.array(proofs, pa.string()), pa.array(folded, pa.string())],
            ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])


def verify(listed: DataFrame) -> DataFrame:
    """Fold every row of a manifest from its ``other`` leaf, or its own, and compare with the root."""
    return listed.select(
        F.col("doc_id").cast("long").alias("doc_id"), "leaf", "other", "witness", "pos", "total", "source_pos", "sources",
        "subroot", "root").mapInArrow(
        _prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's tampering: where 2 divides the crc32 of the decimal id, line feeds are deleted from the text."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return verify(manifest(table(spark, sf_dir, "documents"), {"text": text}))


def _field(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::VARCHAR)) || ':' || {column}::VARCHAR, '-')"


#: ``run``: the nodes of a run as one list; the fold goes up level by level, first in the source, then over the sources.
ORACLE = """
WITH RECURSIVE step AS (SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS c
    FROM range(256) t(i))),
body AS (
  SELECT doc_id, source, {head} AS head, text, (4294967295 - list_reduce([4294967295::BIGINT] || list_transform(
      regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda b: ('0x' || b)::BIGINT),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % 2 = 0 AS even
  FROM documents, step),
leaves AS (
  SELECT doc_id, source, sha256(head || {text}) AS leaf,
    sha256(head || CASE WHEN even THEN {changed} ELSE {text} END) AS other
  FROM body),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS total
  FROM leaves),
nodes AS (
  SELECT source, 0 AS level, pos, total, leaf AS node FROM placed
  UNION ALL
  SELECT source, level + 1, pos // 3, (max(total) + 2) // 3, sha256(string_agg(node, '' ORDER BY pos))
  FROM nodes WHERE total > 1 GROUP BY source, level, pos // 3),
subroots AS (
  SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS total
  FROM nodes WHERE total = 1),
crown AS (
  SELECT 0 AS level, pos, total, subroot AS node FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (max(total) + 2) // 3, sha256(string_agg(node, '' ORDER BY pos))
  FROM crown WHERE total > 1 GROUP BY level, pos // 3),
runs AS (
  SELECT false AS top, source, level, pos // 3 AS run, list(node ORDER BY pos) AS members
  FROM nodes WHERE total > 1 GROUP BY source, level, pos // 3
  UNION ALL
  SELECT true, NULL, level, pos // 3, list(node ORDER BY pos) FROM crown WHERE total > 1 GROUP BY level, pos // 3),
folded AS (
  SELECT p.source, p.doc_id, p.leaf, s.pos AS at, s.total AS sources, s.subroot,
    CASE WHEN p.total = 1 THEN 0 ELSE 1 END AS phase, 0 AS level, p.pos AS pos, p.total AS total, p.other AS node, '' AS proof,
    row_number() OVER () AS row
  FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT f.source, f.doc_id, f.leaf, f.at, f.sources, f.subroot,
    CASE WHEN f.phase = 1 AND f.total <= 3 OR f.phase = 0 THEN CASE WHEN f.sources > 1 THEN 2 ELSE 3 END
      WHEN f.phase = 2 AND f.total <= 3 THEN 3 ELSE f.phase END,
    CASE WHEN f.phase = 0 OR f.phase = 1 AND f.total <= 3 THEN 0 ELSE f.level + 1 END,
    CASE WHEN f.phase = 0 OR f.phase = 1 AND f.total <= 3 THEN f.at ELSE f.pos // 3 END,
    CASE WHEN f.phase = 0 OR f.phase = 1 AND f.total <= 3 THEN f.sources ELSE (f.total + 2) // 3 END,
    CASE WHEN f.phase = 0 THEN f.node ELSE sha256(
      array_to_string(r.members[1:f.pos % 3], '') || f.node || array_to_string(r.members[f.pos % 3 + 2:], '')) END,
    CASE WHEN f.phase = 0 THEN f.proof ELSE f.proof
      || array_to_string(r.members[1:f.pos % 3], '') || array_to_string(r.members[f.pos % 3 + 2:], '') END,
    f.row
  FROM folded f LEFT JOIN runs r ON f.phase > 0 AND r.top = (f.phase = 2)
    AND (r.top OR r.source IS NOT DISTINCT FROM f.source) AND r.level = f.level AND r.run = f.pos // 3
  WHERE f.phase < 3)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM folded, (SELECT node AS root FROM crown WHERE total = 1) WHERE phase = 3
""".format(head=" || ".join(_field(c) for c in FIELDS[:-1]), text=_field("text"),
           changed=_field("replace(text, chr(10), '')"))

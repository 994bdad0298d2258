"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words (lower case, split at white space). Its weight is its count in the text times an inverse
document frequency. Frequencies are counted over all documents into a fixed number of hashed features, so the table is
bounded and its resolution, as a share of the documents, is the same at every size.

* Texts that are equal are one text: classes and samples are per distinct text, copies join by its digest.
* Each of BANDS x ROWS samples is an improved consistent weighted sample (Gamma-distributed r and c and a uniform beta,
  drawn from the shingle's hash): two texts share a sample with a probability equal to their weighted Jaccard
  similarity. At 0.8 a pair misses all of 12 bands of 3 rows with probability 0.0002.
* Bands are worked off in the groups of ROUNDS. Buckets that lie in one known component are done. Of the others, those
  members are found by their samples that have a near member (LIKELY equal samples or more) of another component in the
  bucket, and only these are sent, each with its sorted shingles, to the task of their bucket, which compares exactly:
  one member against all its near ones at a time, by weighted Jaccard similarity. The most central member goes first; a
  link joins two components for the rest of the bucket, so that a group collapses early. Bounds by total weight and by
  the distances to that first member (weighted Jaccard distance is a metric) rule pairs out before. A pair is met in the
  first band that it shares. What leaves a task is links that join components, fewer than members; pairs are never rows.
* A bucket is cut into parts of PART members and PART_BYTES of shingles. Parts are linked inside first, then one member
  of each component and part meets the others', again and again while they need parts. Then every member outside a
  bucket's largest component visits the other parts, so any two near members of a bucket are compared unless they are
  known to be connected. A pair at 0.8 shares fewer than LIKELY samples with a probability under 0.001.
* Classes are the connected components of the links.

Defined results: a text of fewer than five words has no shingle and is similar to its exact copies only; null, empty
and blank texts hold no words and stand alone. Rows with a null ``doc_id`` stand alone too and get a null class.
Repeated rows are copies; rows of one ``doc_id`` with different texts are different documents. Ties go to the smallest
``doc_id``. Only ``doc_id`` and the text column are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, U64, Words, bodies, checked_broadcast, components, kept_table, mix, text_batches

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
#: Equal samples (of 36) from which two texts of a bucket are worth an exact comparison.
LIKELY = 20
#: Groups of bands that are worked off one after the other.
ROUNDS = ((0,), (1, 2, 3), tuple(range(4, BANDS)))
#: Members of a bucket that the centre is measured against.
_PROBES = 64
PART, PART_BYTES = 4096, 16 << 20
#: Shingles that are compared in one step.
_MANY = 1 << 19
FEATURES = 1 << 18
#: Elements of one vectorised step, so that its arrays stay in the processor's cache.
_BLOCK = 1 << 14


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (text number, hash, count), sorted by text and hash."""
    words = Words([t.decode("utf-8", "replace").lower().encode() for t in texts])
    n = len(words.hash) - SHINGLE + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none.astype(U64), none
    h = np.zeros(n, U64)
    for i in range(SHINGLE):
        h = h * U64(BASE) + words.hash[i : i + n]
    inside = words.text[:n] == words.text[SHINGLE - 1 :]
    owner, h = words.text[:n][inside], mix(h[inside])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def _frequencies(batches):
    """Documents per hashed feature in this partition."""
    counts, documents = np.zeros(FEATURES, np.int64), 0
    for part, texts in text_batches(batches):
        owner, h, _ = shingles(texts)
        pair = np.unique(owner * FEATURES + (h & U64(FEATURES - 1)).astype(np.int64))
        counts += np.bincount(pair % FEATURES, minlength=FEATURES)
        documents += len(texts)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(counts[at], documents), pa.int64())],
        ["feature", "documents"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log((1 + documents) / (1 + documents with the feature)) + 1 of every feature; FEATURES numbers."""
    got = bodies(docs).mapInArrow(_frequencies, "feature long, documents long").groupBy("feature").agg(
        F.sum("documents").alias("documents")).toPandas()
    counts = np.zeros(FEATURES)
    known = got["feature"] >= 0
    counts[got["feature"][known].to_numpy()] = got["documents"][known].to_numpy()
    total = float(got["documents"][~known].sum())
    return (np.log((1 + total) / (1 + counts)) + 1).astype(np.float32)


def samples(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """Consistent weighted samples, texts x (BANDS * ROWS); 0 where a text has no shingle."""
    out = np.full((texts, BANDS * ROWS), np.iinfo(U64).max, U64)
    scale = np.float32(2.0**-24)
    for start in range(0, len(h), _BLOCK):
        who, key = owner[start : start + _BLOCK], h[start : start + _BLOCK]
        log_weight = np.log(weight[start : start + _BLOCK])
        first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        rows = who[first]
        for j in range(BANDS * ROWS):
            one = mix(key ^ U64((j + 1) * BASE & (1 << 64) - 1))
            two = one * U64(0xA0761D6478BD642F)
            two ^= two >> U64(29)
            u1 = ((one >> U64(40)).astype(np.float32) + np.float32(0.5)) * scale
            u2 = ((one >> U64(16) & U64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * scale
            u3 = ((two >> U64(40)).astype(np.float32) + np.float32(0.5)) * scale
            u4 = ((two >> U64(16) & U64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * scale
            beta = ((one & U64(0xFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-16)
            r = -np.log(u1 * u2)
            level = np.floor(log_weight / r + beta)
            # log of c / (y * exp(r)) with log y = r * (level - beta)
            rank = np.log(-np.log(u3 * u4)) - r * (level - beta + 1)
            bits = rank.view(np.uint32)
            bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
            chosen = mix(key + level.astype(np.int64).astype(U64) * U64(BASE))
            packed = (bits.astype(U64) << U64(32)) | (chosen >> U64(32))
            out[rows, j] = np.minimum(out[rows, j], np.minimum.reduceat(packed, first))
    return out


def band_keys(samples_: np.ndarray) -> np.ndarray:
    parts = (samples_ & U64(0xFFFFFFFF)).reshape(len(samples_), BANDS, ROWS)
    key = np.arange(BANDS, dtype=U64)[None, :] * U64(BASE)
    for i in range(ROWS):
        key = mix(key + parts[:, :, i] * U64(0xA0761D6478BD642F))
    return key.view(np.int64)


def _signer(idf: np.ndarray):
    def sign(batches):
        for part, texts in text_batches(batches):
            owner, h, count = shingles(texts)
            weight = count.astype(np.float32) * idf[(h & U64(FEATURES - 1)).astype(np.int64)]
            drawn = samples(owner, h, weight, len(texts))
            keys = band_keys(drawn)
            drawn = (drawn & U64(0xFFFFFFFF)).astype("<u4")
            sizes = np.bincount(owner, minlength=len(texts))
            words = [not t.isspace() and len(t) > 0 for t in texts]
            yield pa.RecordBatch.from_arrays([
                part.column(0),
                pa.array([hashlib.sha256(t).digest()[:16] if w else None for t, w in zip(texts, words, strict=True)],
                         pa.binary()),
                pa.array([k if s else None for k, s in zip(keys, sizes, strict=True)], pa.list_(pa.int64())),
                pa.array([x.tobytes() if s else None for x, s in zip(drawn, sizes, strict=True)], pa.binary()),
                pa.array(sizes, pa.int32()),
            ], ["doc_id", "digest", "bands", "samples", "size"])

    return sign


def _vectors(batches):
    """Digest and shingles of every text: sorted hashes, then counts in the narrowest width (first byte)."""
    for part, texts in text_batches(batches):
        owner, h, count = shingles(texts)
        ends = np.searchsorted(owner, np.arange(len(texts) + 1))
        out = []
        for s, e in zip(ends, ends[1:], strict=False):
            width = next(w for w in (1, 2, 4, 8) if count[s:e].max(initial=0) < 1 << 8 * w)
            out.append(bytes([width]) + h[s:e].astype("<u8").tobytes() + count[s:e].astype(f"<u{width}").tobytes())
        digests = [hashlib.sha256(t).digest()[:16] for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(out, pa.binary())], ["digest", "vector"])


def unpacked(vector: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of a packed vector."""
    width = vector[0]
    n = (len(vector) - 1) // (8 + width)
    return np.frombuffer(vector, "<u8", n, 1), np.frombuffer(vector, f"<u{width}", n, 1 + 8 * n)


class Members:
    """The shingle weights of a bucket's members as one array, for exact comparisons of one member with many."""

    def __init__(self, vectors: list[bytes], idf: np.ndarray):
        pairs = [unpacked(v) for v in vectors]
        hashes = np.concatenate([h for h, _ in pairs])
        counts = np.concatenate([c for _, c in pairs]).astype(np.float64)
        self.weight = counts * idf[(hashes & U64(FEATURES - 1)).astype(np.int64)]
        found, self.at = np.unique(hashes, return_inverse=True)
        self.off = np.append(0, np.cumsum([len(h) for h, _ in pairs]))
        self.total = np.add.reduceat(self.weight, self.off[:-1])
        self.own = np.zeros(len(found))

    def steps(self, others: np.ndarray) -> list[np.ndarray]:
        """``others`` in steps of about _MANY shingles."""
        sizes = self.off[others + 1] - self.off[others]
        step = np.cumsum(sizes) // _MANY
        return np.split(others, np.flatnonzero(step[1:] != step[:-1]) + 1) if len(others) else []

    def similarity(self, i: int, others: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of member i with each of ``others`` (no vector is empty)."""
        mine = slice(self.off[i], self.off[i + 1])
        self.own[self.at[mine]] = self.weight[mine]
        sizes = self.off[others + 1] - self.off[others]
        first = np.cumsum(sizes) - sizes
        take = np.arange(sizes.sum()) + np.repeat(self.off[others] - first, sizes)
        low = np.add.reduceat(np.minimum(self.own[self.at[take]], self.weight[take]), first)
        self.own[self.at[mine]] = 0
        return low / (self.total[i] + self.total[others] - low)


def central_first(drawn: np.ndarray) -> np.ndarray:
    """Members in order of the samples they share with others, measured against a few of them."""
    n = len(drawn)
    probes = np.unique(np.linspace(0, n - 1, min(n, _PROBES)).astype(int))
    shared = np.zeros(n, np.int64)
    for p in probes:
        shared += (drawn == drawn[p]).sum(1)
    return np.argsort(-shared, kind="stable")


class Tile:
    """Members of one part of a bucket, or of two parts that are compared with each other; which pairs are near."""

    def __init__(self, band: int, roots: np.ndarray, drawn: np.ndarray, own: np.ndarray, far: np.ndarray):
        self.number = int(np.argmax(band_keys(drawn[:1].astype(U64))[0] == band))
        self.label = np.unique(roots, return_inverse=True)[1]
        self.drawn, self.own, self.far = drawn, own, far
        self.across = len(np.unique(own)) > 1

    def near(self, i: int, among: np.ndarray) -> np.ndarray:
        """Those of ``among`` in another component, with LIKELY equal samples, that meet i here and in no earlier band.

        Two parts: members of different parts, one of them outside the bucket's largest component (``far``).
        """
        among = among[self.label[among] != self.label[i]]
        if self.across:
            among = among[(self.own[among] != self.own[i]) & (self.far[among] | self.far[i])]
        if not len(among):
            return among
        equal = self.drawn[among] == self.drawn[i]
        ok = equal.sum(1) >= LIKELY
        ok &= equal.reshape(-1, BANDS, ROWS).all(2).argmax(1) == self.number
        return among[ok]

    def active(self) -> np.ndarray:
        """Members with a near one."""
        n, out = len(self.label), np.zeros(len(self.label), bool)
        for i in range(n):
            found = self.near(i, np.arange(i + 1, n))
            if len(found):
                out[found] = out[i] = True
        return out

    def links(self, members: Members, threshold: float) -> list[tuple[int, int]]:
        """Similar pairs that join components: fewer than members."""
        order, out = central_first(self.drawn), []
        threshold -= 1e-9
        away = np.concatenate([1 - members.similarity(order[0], s) for s in members.steps(np.arange(len(order)))])
        for at, i in enumerate(order):
            rest = self.near(i, order[at + 1 :])
            small, large = np.minimum(members.total[rest], members.total[i]), np.maximum(members.total[rest], members.total[i])
            rest = rest[(small >= threshold * large) & (np.abs(away[rest] - away[i]) <= 1 - threshold + 1e-9)]
            for some in members.steps(rest):
                some = some[self.label[some] != self.label[i]]
                if not len(some):
                    continue
                for j in some[members.similarity(i, some) >= threshold]:
                    if self.label[j] != self.label[i]:
                        out.append((int(i), int(j)))
                        self.label[self.label == self.label[j]] = self.label[i]
        return out


def _stretches(batches, columns: list[str], work):
    """Apply ``work`` to the consecutive rows of equal ``columns``; a stretch may go over batches."""
    held = []

    def joined():
        return pa.Table.from_batches(held).combine_chunks()

    for batch in batches:
        keys = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in columns]
        if not batch.num_rows:
            continue
        edges = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if held:
            last = [held[-1].column(held[-1].schema.get_field_index(c))[-1].as_py() for c in columns]
            if last != [k[0] for k in keys]:
                edges = np.append(0, edges)
        start = 0
        for e in edges.tolist():
            if e > start:
                held.append(batch.slice(start, e - start))
            yield from work(joined())
            held, start = [], e
        held.append(batch.slice(start))
    if held:
        yield from work(joined())


def _drawn(rows) -> np.ndarray:
    return np.frombuffer(b"".join(rows["samples"].to_pylist()), "<u4").reshape(-1, BANDS * ROWS)


def _tile(rows) -> Tile:
    root, own, far = (rows[c].to_numpy(zero_copy_only=False) for c in ("root", "own", "far"))
    return Tile(rows["band"][0].as_py(), root, _drawn(rows), own, far)


def _find_active(rows):
    chosen = np.flatnonzero(_tile(rows).active())
    if len(chosen):
        yield from rows.take(pa.array(chosen)).combine_chunks().to_batches()


def _find_links(idf: np.ndarray, threshold: float):
    def find(rows):
        found = _tile(rows).links(Members(rows["vector"].to_pylist(), idf), threshold)
        ids = rows["b"].to_numpy()
        a, b = (np.array([ids[p[k]] for p in found], np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return find


_TILE = ["band", "one", "two"]
_MEMBER = "band long, one int, two int, own int, b long, root long, far boolean, samples binary"


def _compared(rows: DataFrame, vectors: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Links among the tiles of ``rows`` (columns of _MEMBER; a tile is a band key and one or two parts)."""
    tiles = rows.repartition(*_TILE).sortWithinPartitions(*_TILE)
    active = kept_table(tiles.mapInArrow(lambda b: _stretches(b, _TILE, _find_active), _MEMBER), "icws-active")
    shipped = active.join(vectors, "b").repartition(*_TILE).sortWithinPartitions(*_TILE, "b")
    return kept_table(shipped.mapInArrow(
        lambda b: _stretches(b, _TILE, _find_links(idf, threshold)), "a long, b long"), "icws-links")


def _dealt(rows: DataFrame, turn: int = 0) -> DataFrame:
    """``rows`` with the parts of their buckets: ``parts`` and ``own``, the part of each row by a hash of its id."""
    size = F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum(F.col("size").cast("long") * 9) / PART_BYTES))
    counts = rows.groupBy("band").agg(size.cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1")
    return rows.join(counts.drop("n"), "band").withColumn("own", F.pmod(F.xxhash64("b", F.lit(turn)), F.col("parts")).cast("int"))


def _links(texts: DataFrame, vectors: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame | None:
    """Component roots (vertex, root) of all texts that have a link."""
    banded = texts.where("bands is not null").select(
        F.col("v").alias("b"), "size", "samples", F.posexplode("bands").alias("number", "band"))
    # every bucket that is met twice, in parts
    parted = kept_table(_dealt(banded), "icws-parted")
    links, roots = None, None

    def rooted(rows: DataFrame) -> DataFrame:
        if roots is None:
            return rows.withColumn("root", F.col("b"))
        return rows.join(roots.select(F.col("vertex").alias("b"), "root"), "b", "left").withColumn(
            "root", F.coalesce("root", "b"))

    def mixed(rows: DataFrame, keys: list[str]) -> DataFrame:
        """Rows of groups that hold different components."""
        several = rows.groupBy(*keys).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        return rows.join(several.select(*keys), keys)

    def member(rows: DataFrame, one: str = "own", two: str = "own") -> DataFrame:
        far = F.col("far") if "far" in rows.columns else F.lit(False)
        return rows.select("band", F.col(one).cast("int").alias("one"), F.col(two).cast("int").alias("two"), "own", "b", "root",
                           far.alias("far"), "samples")

    def compare(rows: DataFrame) -> None:
        nonlocal links, roots
        found = _compared(rows, vectors, idf, threshold)
        if found.limit(1).count():
            links = found if links is None else links.union(found)
            roots = components(links, "icws")

    for numbers in ROUNDS:
        rows = parted.where(F.col("number").isin(*numbers))
        compare(member(mixed(rooted(rows), ["band", "own"])))
        cut = rows.where("parts > 1")
        if not cut.limit(1).count():
            continue
        heads, turn, before = cut, 0, None
        while True:
            # one member for every component of a part, dealt anew
            turn += 1
            heads = kept_table(_dealt(mixed(rooted(heads), ["band"]).groupBy("band", "own", "root").agg(
                F.min_by(F.struct("b", "size", "samples"), "b").alias("head")).select("band", "head.*"), turn), "icws-heads")
            compare(member(mixed(rooted(heads), ["band", "own"])))
            heads, n = heads.where("parts > 1"), heads.where("parts > 1").count()
            # members that are not similar to each other stay apart however they are dealt
            if not n or before is not None and n > before / 2:
                break
            before = n
        whole = kept_table(mixed(rooted(cut), ["band"]), "icws-rooted")
        largest = whole.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(
            F.max_by("root", F.struct("n", "root")).alias("largest"))
        placed = kept_table(whole.join(largest, "band").withColumn("far", F.col("root") != F.col("largest")), "icws-placed")
        # those outside the largest component meet the members of all other parts
        visited = placed.where("far").select(F.col("band").alias("of"), F.col("own").alias("other")).distinct()
        met = placed.join(visited, (F.col("band") == F.col("of")) & (F.col("own") != F.col("other"))).drop("of")
        visits = placed.where("far").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("other <> own")
        tiles = met.unionByName(visits).withColumn("one", F.least("own", "other")).withColumn(
            "two", F.greatest("own", "other")).dropDuplicates([*_TILE, "b"])
        compare(member(tiles, "one", "two"))
    return roots


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row per document row: ``doc_id``, ``digest`` (null: no words), ``class_id`` (smallest id of its class),
    ``kept`` (it is that one)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    idf = inverse_frequencies(docs)
    signed = kept_table(bodies(docs, "doc_id").mapInArrow(
        _signer(idf), "doc_id long, digest binary, bands array<long>, samples binary, size int"), "icws-signed")
    known = signed.where("doc_id is not null and digest is not null")
    # a number per distinct text
    texts = kept_table(known.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.max("bands").alias("bands"), F.max("samples").alias("samples"),
        F.max("size").alias("size")).withColumn("v", F.monotonically_increasing_id()), "icws-texts")
    shared = texts.where("bands is not null").select("v", F.explode("bands").alias("band"))
    shared = shared.join(shared.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band")
    needed = kept_table(texts.join(shared.select("v").distinct(), "v").select("v", "rep", "digest"), "icws-needed")
    # one row of each text that meets another one
    bodies_ = bodies(docs.join(needed.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    vectors = kept_table(bodies_.mapInArrow(_vectors, "digest binary, vector binary").join(
        needed.select("v", "digest"), "digest").groupBy("v").agg(F.first("vector").alias("vector")).withColumnRenamed(
        "v", "b"), "icws-vectors")
    roots = _links(texts, vectors, idf, threshold)
    if roots is None:
        classes = texts.select("digest", F.col("rep").alias("class_id"))
    else:
        named = texts.join(roots, F.col("v") == F.col("vertex"), "left").withColumn("root", F.coalesce("root", "v"))
        smallest = named.groupBy("root").agg(F.min("rep").alias("class_id"))
        classes = named.join(smallest, "root").select("digest", "class_id")
    joined = known.select("doc_id", "digest").join(classes, "digest").select("doc_id", "digest", "class_id")
    alone = signed.where("doc_id is null or digest is null").select("doc_id", "digest", F.col("doc_id").alias("class_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("digest")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, with the columns of ``docs``.

    Documents are told apart by id and text: of rows that share both one stays, whatever their other columns hold; of
    rows that share an id only, each is judged by its own text.
    """
    listed = kept_table(near_duplicates(docs).where("doc_id is not null and digest is not null").groupBy(
        F.col("doc_id").alias("id_"), F.col("digest").alias("digest_")).agg(
        F.first("kept").alias("kept_"), F.count("*").alias("rows_")).where("not kept_ or rows_ > 1"), "icws-judged")
    named = {c: f"c{i}_" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*named.values())
    key = (F.col(named["doc_id"]).cast("long") == F.col("id_")) & (
        F.substring(F.unhex(F.sha2(F.col(named["text"]).cast("binary"), 256)), 1, 16) == F.col("digest_"))
    single = plain.join(checked_broadcast(listed), key, "left_anti")
    copies = plain.join(checked_broadcast(listed.where("kept_")), key).dropDuplicates(["id_", "digest_"]).select(*plain.columns)
    return single.union(copies).toDF(*docs.columns)

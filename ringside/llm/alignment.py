"""Alignment of two tokenizers over the same texts, with corpus-wide counts of linked ids.

Texts are cut into batches of about BATCH bytes. Inside a batch every token has a byte range; pandas ``merge_asof``, keyed
by document, finds for each token start of one side the other side's token that covers it, in both directions. Of two
tokens whose ranges overlap the one that starts later starts inside the other, so the union of both directions is all
links; a pair that starts together is met from both sides and counted once. Byte offsets at which both sides end cut a
document into groups.

The corpus-wide count of an id pair is the number of documents that hold it linked. A batch writes its documents, each
with its pairs as numbers into the batch's list of distinct pairs, and that list with documents per pair. The lists are
summed and joined by pair, so what is shuffled is distinct pairs per batch, not links; then each batch meets the counts of
its own list in one cogroup, whose size the batch bounds. Texts are encoded once. No vocabulary-sized table is broadcast.

The byte-level tokenizer is run from its own file by ``tiktoken`` where that file is a plain byte-level BPE whose ids
follow the order of its merges (the ids are equal then, tested), else by ``tokenizers``.

Defined results: a text that is null or empty, or that either tokenizer does not give back byte for byte after a space
(normalised or unknown letters), has no tokens: zeros and an empty digest. Tokenizers' special strings are plain text.
Repeated rows are documents of their own. A text longer than BATCH is a batch of its own, whole. An empty table gives no
rows. Only ``doc_id`` and the text column are read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bodies, kept_table, table, text_batches
from .tokens import _byte_letters

#: Bytes of text aligned at a time; bounds a task's memory and a cogroup, never a text.
BATCH = 2 << 20
#: The pattern by which byte-level pre-tokenizers split (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteSide:
    """Ids and token bytes of a byte-level BPE file of the tokenizers library; the text is encoded after a space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        value = {letter: byte for byte, letter in enumerate(_byte_letters())}
        vocabulary = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec.get("added_tokens", [])}}
        special = {t["id"] for t in spec.get("added_tokens", [])}
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.pieces[i] = token.encode() if i in special else bytes(value[c] for c in token)
        if self._plain(spec):
            import tiktoken

            ranks = {self.pieces[i]: i for i in vocabulary.values() if i not in special}
            self._encode = tiktoken.Encoding("side", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self._encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _plain(spec: dict) -> bool:
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel":
            return False
        if not split.get("use_regex", True) or split.get("add_prefix_space") or any(
                model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
            return False
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        return made == list(range(256, 256 + len(made)))

    def ids(self, text: str) -> list[int]:
        return self._encode(" " + text)


class PieceSide:
    """Ids and token bytes of a sentencepiece model, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.pieces.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
        self.ids = model.encode


@functools.lru_cache(maxsize=2)
def sides(byte_path: str, piece_path: str):
    """Both tokenizers, their token lengths and their ids in decimal; one copy a Python worker."""
    both = ByteSide(byte_path), PieceSide(piece_path)
    lengths = [np.array([len(p) for p in side.pieces], np.int64) for side in both]
    decimal = [[f"{i}{mark}".encode() for i in range(len(side.pieces)) for mark in marks]
               for side, marks in zip(both, (",|", ",;"), strict=True)]
    return both, lengths, decimal


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes


def links(a_start: np.ndarray, a_doc: np.ndarray, b_start: np.ndarray, b_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping token pairs as (number of the A token, number of the B token); both sides in order of the text."""
    left = pd.DataFrame({"at": a_start, "doc": a_doc, "a": np.arange(len(a_start))})
    right = pd.DataFrame({"at": b_start, "doc": b_doc, "b": np.arange(len(b_start))})
    covering_b = pd.merge_asof(left, right, on="at", by="doc")["b"].to_numpy()
    covering_a = pd.merge_asof(right, left, on="at", by="doc")["a"].to_numpy()
    later = a_start[covering_a] != b_start
    return np.append(left["a"].to_numpy(), covering_a[later]), np.append(covering_b, right["b"].to_numpy()[later])


def _packed(numbers: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending pair numbers as steps, and how often each is linked, in the narrowest width that holds them."""
    steps = np.diff(numbers, prepend=0)
    width = next(w for w in (1, 2, 4, 8) if max(steps.max(initial=0), times.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + np.concatenate([steps, times]).astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64).reshape(2, -1)
    return np.cumsum(both[0]), both[1]


_DOC = ("batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, "
        "a_ids array<int>, b_ids array<int>, documents array<int>")


def align(texts: list[bytes], byte_path: str, piece_path: str) -> tuple[list[tuple], tuple]:
    """Documents as (n_a, n_b, n_groups, n_links, groups digest, packed pairs) and the batch's pairs as
    (A ids, B ids, documents)."""
    (byte_side, piece_side), (a_length, b_length), (a_decimal, b_decimal) = sides(byte_path, piece_path)
    whole, a_ids, b_ids = [], [], []
    for i, body in enumerate(texts):
        text = body.decode("utf-8", "replace")
        a, b = (byte_side.ids(text), piece_side.ids(text)) if body else ([], [])
        want = b" " + body
        if body and b"".join([byte_side.pieces[t] for t in a]) == want == b"".join([piece_side.pieces[t] for t in b]):
            whole.append(i)
            a_ids.append(a)
            b_ids.append(b)
    out = [(0, 0, 0, 0, "", None)] * len(texts)
    if not whole:
        return out, ([], [], [])
    a, n_a = _flat(a_ids)
    b, n_b = _flat(b_ids)
    del a_ids, b_ids
    docs = len(whole)
    a_doc, b_doc = np.repeat(np.arange(docs), n_a), np.repeat(np.arange(docs), n_b)
    # offsets run on over the batch; every document has as many bytes on both sides
    a_end, b_end = np.cumsum(a_length[a]), np.cumsum(b_length[b])
    at_a, at_b = links(a_end - a_length[a], a_doc, b_end - b_length[b], b_doc)
    # groups: ends that both sides have
    a_last = b_end[np.searchsorted(b_end, a_end)] == a_end
    b_last = a_end[np.searchsorted(a_end, b_end)] == b_end
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    n_groups = np.bincount(a_doc[a_last], minlength=docs)
    n_links = np.bincount(a_doc[at_a], minlength=docs)
    # a group's A ids, then its B ids, with the mark that follows each
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + np.searchsorted(b_group, a_group, "left")] = 2 * a + a_last
    order[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = 2 * (b + len(a_length)) + b_last
    marked = a_decimal + b_decimal
    ends = np.cumsum(n_a + n_b)
    # pairs, the most frequent first; then which documents hold which
    number, pair = pd.factorize(a[at_a] << 32 | b[at_b])
    rank = np.argsort(np.argsort(-np.bincount(number), kind="stable"), kind="stable")
    cell, held = pd.factorize(a_doc[at_a] * len(pair) + rank[number])
    times = np.bincount(cell)
    by = np.argsort(held)
    held, times = held[by], times[by]
    first = np.searchsorted(held, np.arange(docs + 1) * len(pair))
    for k, i in enumerate(whole):
        codes = order[ends[k] - n_a[k] - n_b[k] : ends[k]].tolist()
        text = b"".join([marked[c] for c in codes])[:-1]
        mine = slice(first[k], first[k + 1])
        out[i] = (int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), hashlib.sha256(text).hexdigest(),
                  _packed(held[mine] - k * len(pair), times[mine]))
    documents = np.bincount(held % len(pair), minlength=len(pair))
    ranked = np.empty_like(pair)
    ranked[rank] = pair
    return out, (ranked >> 32, ranked & 0xFFFFFFFF, documents)


def _aligner(byte_path: str, piece_path: str, size: int):
    def work(batches):
        number = TaskContext.get().partitionId() << 32
        for part, texts in text_batches(batches, size):
            rows, pairs = align(texts, byte_path, piece_path)
            n, columns = len(rows), list(zip(*rows, strict=True))
            # the batch's list goes with its first document
            lists = [pa.array([list(p), *[None] * (n - 1)], pa.list_(pa.int32())) for p in pairs]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * n, pa.int64()), part.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]],
                 pa.array(columns[4], pa.string()), pa.array(columns[5], pa.binary()), *lists],
                ["batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "a_ids", "b_ids",
                 "documents"])
            number += 1

    return work


_RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string")


def _counted(docs: pa.Table, listed: pa.Table) -> pa.Table:
    """Sums over the links of every document of a batch; ``listed`` has the counts of the batch's pairs."""
    at = listed["number"].to_numpy()
    count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    count[at] = listed["count"].to_numpy()
    best[at] = listed["best"].to_numpy(zero_copy_only=False)
    sums, bests = [], []
    for data in docs["pairs"].to_pylist():
        numbers, times = _unpacked(data) if data else (np.zeros(0, np.int64),) * 2
        sums.append(int((count[numbers] * times).sum()))
        bests.append(int((best[numbers] * times).sum()))
    return pa.table({c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
                    | {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64()),
                       "groups_sha256": docs["groups_sha256"]})


def aligned(docs: DataFrame, byte_path: str, piece_path: str, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """Documents with their group and link counts, and the corpus-wide table ``a_id``, ``b_id``, ``count``, ``best``."""
    rows = bodies(docs, F.col("doc_id").cast("long").alias("doc_id"))
    coded = kept_table(rows.mapInArrow(_aligner(byte_path, piece_path, batch), _DOC), "aligned")
    listed = coded.where("a_ids is not null").select(
        F.col("batch").alias("of"), F.posexplode(F.arrays_zip("a_ids", "b_ids", "documents")).alias("number", "pair")).select(
        "of", "number", F.col("pair.a_ids").alias("a_id"), F.col("pair.b_ids").alias("b_id"),
        F.col("pair.documents").alias("documents"))
    summed = listed.groupBy("a_id", "b_id").agg(F.sum("documents").alias("count"))
    # an A id has at most as many partners as the other vocabulary has ids
    counts = kept_table(summed.withColumn(
        "best", F.col("count") == F.max("count").over(Window.partitionBy("a_id"))), "aligned-pairs")
    known = listed.join(counts, ["a_id", "b_id"]).select("of", "number", "count", "best")
    out = coded.drop("a_ids", "b_ids", "documents").groupBy("batch").cogroup(known.groupBy("of")).applyInArrow(
        _counted, _RESULT)
    return out, counts


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                   public_tokenizers.path("piece_bpe_32k.model"))[0]

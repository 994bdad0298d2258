"""Token-ID output as ORC: integer run lengths, row indexes, Bloom filters on document ids, stripe-parallel reads.

A corpus is a folder of ORC files in ascending order of ``doc_id`` (range partitions sorted inside; a file holds one
range). A row is a document: its ids as an array of integers, which ORC stores in run-length encoded streams, their
number, and where they start among the ids of its file. ORC keeps minima and maxima of ``doc_id`` per file, stripe and
row group and a Bloom filter per row group, so a reader prunes by id; Spark reads stripes in parallel. Offsets over the
whole corpus are the files' totals summed in order plus the start inside the file; only one number per file is needed.

The tokenizer's normaliser and splitter never look across a blank or line feed, so texts are cut into chunks there. A
chunk of Latin letters and then marks is parted between them and lowered, all others stay as they are. The pieces of a
batch are dictionary-encoded, each distinct piece is encoded once (a bounded memory keeps those already seen; lower-case
letters go straight to the tokenizer's model, others through the whole tokenizer), and the batch's ids are gathered by the
dictionary's numbers. The ids equal those of whole texts (tested). A tokenizer file that fails a probe of this (one that
keeps blanks or capitals, say) is given whole texts instead.

Defined results: a null or empty text is the end id alone. A null ``doc_id`` sorts first. Repeated ids are rows of their
own, ordered by text. An empty table gives an empty folder that reads as no rows. Only ``doc_id`` and the text column
are read.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringside.session import scratch_path

from .common import bodies, free_shuffles, kept_table, small_batches, text_batches

END = 1
#: Chunks a task remembers before it starts over: bounds its memory, not what it encodes.
REMEMBERED = 400_000
#: Bytes of text encoded in one step.
SLICE = 2 << 20
STRIPE_BYTES, ROWS_PER_INDEX = 16 << 20, 1000
SCHEMA = "doc_id long, n_tokens long, part_start long, ids array<int>"


_LATIN = "".join(chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha())
#: A run of Latin letters and then marks: the splitter parts them there, and normalisation only lowers the letters.
_PLAIN = re.compile(rf"([A-Za-z{_LATIN}]+)([!-/:-@\[-`{{-~]*)")


_PROBE = "Ab  aB, naïve\nCAFÉ!! it's We'LL 12ab x_y ** \t ü ÀÉÎ;"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Encoder(dict):
    """Ids of text chunks as little-endian bytes, worked out at first use."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.id_bytes = [int(i).to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size() + 1)]
        letters = _byte_letters()
        self.table = {ord(c): "".join(letters[b] for b in c.encode()) for c in _LATIN}

        self.chunked = True
        whole = self.packed(self.tokenizer.encode(_PROBE, add_special_tokens=False).ids)
        self.chunked = self.ids(_PROBE) == whole

    def packed(self, ids) -> bytes:
        return b"".join([self.id_bytes[i] for i in ids])

    def letters(self, chunk: str) -> bytes:
        """Ids of lower-case Latin letters, straight from the model."""
        tokens = self.model.tokenize(chunk if chunk.isascii() else chunk.translate(self.table))
        return b"".join([self.id_bytes[t.id] for t in tokens])

    def keep(self, chunk: str, ids: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        if len(chunk) < 64:
            self[chunk] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha() and chunk.islower() and chunk.isascii():
            tokens = self.model.tokenize(chunk)
            ids = self.id_bytes[tokens[0].id] if len(tokens) == 1 else b"".join([self.id_bytes[t.id] for t in tokens])
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = ids
            return ids
        plain = _PLAIN.fullmatch(chunk)
        if not plain:
            whole = self.tokenizer.encode(chunk, add_special_tokens=False).ids if chunk else ()
            return self.keep(chunk, self.packed(whole))
        low, marks = plain[1].lower(), plain[2]
        if low == chunk:
            return self.keep(chunk, self.letters(low))
        ids = self.get(low)
        if ids is None:
            ids = self.keep(low, self.letters(low))
        return self.keep(chunk, ids + self[marks] if marks else ids)

    def ids(self, text: str | None) -> bytes:
        if not self.chunked:
            return self.packed(self.tokenizer.encode(text or "", add_special_tokens=False).ids)
        return b"".join([self[c] for c in (text or "").replace("\n", " ").split(" ")])


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder a Python worker, kept from task to task."""
    return Encoder(path)


def _flag(bit: int, characters: str) -> np.ndarray:
    return np.isin(np.arange(256), list(characters.encode("latin-1"))).astype(np.uint8) << bit


_ASCII = "abcdefghijklmnopqrstuvwxyz"
#: One bit per kind of byte: blanks part chunks; letters and capitals are ASCII ones; marks are those of _PLAIN; then the
#: second bytes of two-byte Latin letters, after 0xC3, and of the capitals among them.
_KIND = (_flag(0, " \n") | _flag(1, _ASCII + _ASCII.upper()) | _flag(2, _ASCII.upper())
         | _flag(3, "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
         | _flag(4, "".join(chr(c.encode()[1]) for c in _LATIN))
         | _flag(5, "".join(chr(c.encode()[1]) for c in _LATIN if c.lower() != c)))


def _after(mask: np.ndarray) -> np.ndarray:
    out = np.empty_like(mask)
    out[:1], out[1:] = False, mask[:-1]
    return out


def _running(mask: np.ndarray) -> np.ndarray:
    """How many are set before each place, and in all."""
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=out[1:], dtype=np.int32)
    return out


def pieces(texts: list[bytes]) -> tuple[pa.StringArray, np.ndarray]:
    """The pieces of all texts in order, and how many each text has."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _KIND[data]
    full, letter, mark, capital = kind & 1 == 0, kind & 2 > 0, kind & 8 > 0, kind & 4 > 0
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[lead + 1 < len(data)]
    lead = lead[kind[lead + 1] & 16 > 0]
    letter[lead] = letter[lead + 1] = True
    capital[lead + 1] = kind[lead + 1] & 32 > 0
    head = full & ~_after(full)
    starts, ends = np.flatnonzero(head), np.flatnonzero(~full & _after(full))
    # letters, then marks, and nothing else
    wrong = _running((full & ~letter & ~mark) | (letter & _after(mark)))
    plain = (wrong[ends] == wrong[starts]) & letter[starts]
    inside = np.zeros(len(data), bool)
    inside[full] = np.repeat(plain, ends - starts)
    body = data + ((capital & inside).view(np.uint8) << 5)
    first = head | (inside & mark & _after(letter))
    offsets = np.append(_running(full)[:-1][first], np.int32(full.sum()))
    counted = _running(first)[np.cumsum([len(t) + 1 for t in texts])]
    array = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(body[full]))
    return array, np.diff(counted, prepend=0)


def _stretched(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (sizes[0] of them), then those of the next."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def encoded(encoder: Encoder, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by ``end``, and how many each has."""
    if not encoder.chunked:
        coded = [np.frombuffer(encoder.ids(t.decode()), "<i4") for t in texts]
        sizes = np.array([len(c) + 1 for c in coded], np.int64)
        return np.concatenate([np.append(c, end) for c in coded]).astype(np.int32), sizes
    found, counts = pieces(texts)
    found = found.dictionary_encode()
    coded = [encoder[p] for p in found.dictionary.to_pylist()]
    coded.append(np.array([end], "<u4").tobytes())
    known = np.frombuffer(b"".join(coded), "<i4")
    sizes = np.array([len(c) // 4 for c in coded], np.int64)
    # the end id is one more piece of every text
    order = np.insert(found.indices.to_numpy(), np.cumsum(counts), len(coded) - 1)
    ids = known[_stretched((np.cumsum(sizes) - sizes)[order], sizes[order])]
    totals = np.append(0, np.cumsum(sizes[order]))
    return ids, np.diff(totals[np.append(0, np.cumsum(counts + 1))])


def _encode(path: str, end: int):
    def encode(batches):
        encoder, total = encoder_of(path), 0
        for part, texts in text_batches(batches, SLICE):
            ids, counts = encoded(encoder, texts, end)
            ends = np.cumsum(counts)
            offsets = pa.array(np.append(0, ends).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts), pa.array(total + ends - counts),
                 pa.ListArray.from_arrays(offsets, pa.array(ids))], ["doc_id", "n_tokens", "part_start", "ids"])
            total += int(ends[-1])

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Write the corpus of ``docs`` to the new folder ``path``."""
    free_shuffles(docs.sparkSession)
    rows = bodies(docs, F.col("doc_id").cast("long").alias("doc_id")).repartitionByRange("doc_id")
    coded = rows.sortWithinPartitions("doc_id", "body").mapInArrow(_encode(tokenizer, end), SCHEMA)
    with small_batches(docs.sparkSession):
        coded.write.option("orc.compress", "ZSTD").option("orc.stripe.size", STRIPE_BYTES).option(
            "orc.create.index", "true").option("orc.row.index.stride", ROWS_PER_INDEX).option(
            "orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a corpus: doc_id, start (ids of all documents before it), n_tokens, ids; filters on id prune."""
    files = spark.read.schema(SCHEMA).orc(path).select("*", F.col("_metadata.file_name").alias("file"))
    totals = files.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    # one row per file, so it can go to all tasks: the ids are read without a shuffle
    offsets = totals.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("offset"))
    return files.join(F.broadcast(offsets), "file").select(
        "doc_id", (F.col("offset") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _checksums(batches):
    for batch in batches:
        column = batch.column(3)
        values = np.asarray(column.flatten()).view(np.uint32)
        ends = np.cumsum(np.append(0, np.asarray(column.value_lengths().fill_null(0))))
        sums = [zlib.crc32(values[s:e].tobytes()) for s, e in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())],
                                         ["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        _checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the corpus of ``docs`` to the shared folder and give its digest as read back."""
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, default_tokenizer())
    return kept_table(digest(read_tokens(spark, path)), "token-digest")

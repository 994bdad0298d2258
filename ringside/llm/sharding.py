"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard draws a number for every key: u in (0, 1) from the digest of key and shard, then -ln(u) / weight, so that the
shard with the smallest draw wins with a probability equal to its share of the weights. A draw depends on the key and
that shard only. A shard that is added takes the keys it now wins and no key moves between the others; one that is taken
away gives up its own keys only; a changed weight moves keys to or from that shard only.

Assignment is a projection. A slot is a row's place inside its shard by key, found over ranges of (shard, key), so a
shard of any size, and many rows of one key, lie in many tasks.

Defined results: a null ``doc_id`` is a key of its own (``-``). Rows of equal ``doc_id`` go to the same shard and get
slots of their own, ordered by checksum and size. A null or empty text has size OVERHEAD and checksum 0. An empty table
gives no rows. A weight must be above 0. ``assign`` reads the key only; ``shard`` reads ``doc_id`` and the text column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .ranks import positions

SHARDS = 40
#: Bytes a record takes beside its text (fixed value).
OVERHEAD = 16
#: Hex digits of a digest that make a draw: 52 bits, so that the half steps of u are exact in a double.
_DIGITS = 13
FILE_ROWS = 200_000


def stable_key(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("-"))


def draw(key: Column, shard: Column, weight: Column) -> Column:
    """What ``shard`` draws for ``key``: exponential with rate ``weight``."""
    digits = F.substring(F.md5(F.concat(key, F.lit("|"), shard.cast("string"))), 1, _DIGITS)
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 4 * _DIGITS)
    return -F.log(u) / weight


def winner(key: Column, weights: dict[int, float]) -> Column:
    """(draw, shard) of the shard with the smallest draw; equal draws go to the smaller shard."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("shards need weights above 0")
    shards = F.array(*[F.struct(F.lit(int(s)).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in weights.items()])
    return F.array_min(F.transform(shards, lambda s: F.struct(
        draw(key, s["shard"], s["weight"]).alias("draw"), s["shard"].alias("shard"))))


def assign(key: Column, weights: dict[int, float]) -> Column:
    """The shard of a key among ``weights`` (shard number: weight)."""
    return winner(stable_key(key), weights)["shard"]


def shard(docs: DataFrame, weights: dict[int, float], added: dict[int, float] | None = None) -> DataFrame:
    """One row per document row: doc_id, size, text_crc32, shard, slot and, with shards ``added``, grown_shard."""
    best = winner(F.col("key"), weights)
    text = F.coalesce("text", F.lit(""))
    known = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), stable_key(F.col("doc_id")).alias("key"))
    rows = known.select("doc_id", "size", "text_crc32", "key", best.alias("best"))
    grown = F.col("best")
    if added:
        grown = F.least("best", winner(F.col("key"), added))
    rows = rows.select("doc_id", "size", "text_crc32", F.col("best.shard").alias("shard"), grown["shard"].alias("grown_shard"))
    return positions(rows, ["shard"], ["doc_id", "text_crc32", "size"], "shards").select(
        "doc_id", "size", "text_crc32", "shard", F.col("pos").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: dict[int, float], file_rows: int = FILE_ROWS) -> None:
    """Write the rows of ``docs`` under ``path``, a folder ``shard_=n`` each, in files of at most ``file_rows`` rows.

    A large shard is dealt over several tasks by a hash of the rows' arrival, so that many rows of one key are parted too.
    """
    rows = docs.withColumn("shard_", assign(F.col("doc_id"), weights))
    counts = rows.groupBy("shard_").agg(F.ceil(F.count("*") / file_rows).alias("files_")).withColumnRenamed("shard_", "of_")
    # one row per shard
    dealt = rows.join(F.broadcast(counts), F.col("shard_") == F.col("of_")).withColumn(
        "file_", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("files_")))
    dealt.repartition("shard_", "file_").sortWithinPartitions("shard_", "doc_id").select(
        *docs.columns, "shard_").write.option("maxRecordsPerFile", file_rows).partitionBy("shard_").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = shard(docs, dict.fromkeys(range(SHARDS), 1.0), {SHARDS: 1.0})
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The checksum goes through the bytes of each text by table; the table is built by its rule.
CRC_SQL = """
  step AS (SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS c
    FROM range(256) t(i)))"""


def crc_of(body: str) -> str:
    """DuckDB expression: unsigned crc32 of a text's UTF-8 bytes; needs ``step`` of CRC_SQL in scope."""
    return f"""(4294967295 - list_reduce([4294967295::BIGINT] || list_transform(
      regexp_extract_all(hex(encode({body})), '..'), lambda b: ('0x' || b)::BIGINT),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])))"""


ORACLE = f"""
WITH {CRC_SQL.strip()},
draws AS (
  SELECT doc_id, s, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-') || '|' || s), 1, 13))::BIGINT + 0.5::DOUBLE)
    / 4503599627370496::DOUBLE) AS draw
  FROM documents, range(41) t(s)),
best AS (
  SELECT doc_id, arg_min(s, (draw, s)) FILTER (WHERE s < 40)::INTEGER AS shard,
    arg_min(s, (draw, s))::INTEGER AS grown_shard
  FROM draws GROUP BY doc_id)
SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 16)::BIGINT AS size,
  {crc_of("coalesce(text, '')")}::BIGINT AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
FROM documents JOIN best USING (doc_id), step
"""

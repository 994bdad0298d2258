"""Mixing sources to target weights along a low-discrepancy schedule of equal-token blocks.

Every source's documents are shuffled (by a hash of the id) and laid end to end on a line of words, which is cut into
blocks of BLOCK_WORDS words. Slot n of the schedule belongs to the source in whose stretch of the cumulative targets the
point frac((n + 1/2) * golden ratio) falls; the slots of a source are ranked, and rank r takes the block r modulo the
number of its blocks, so a source is taken whole before any of it is taken again. Golden-ratio points keep every source
within a few slots of its share at any time; a source stops at its target (its last slot may be cut) and slots that the
points left it short of follow at the end of the schedule.

Sources sorted by code point, null last, weigh 5, 2, 1, repeating, and share SHARE of all words; a target stops at CAP
times its source's words and the excess is shared again by weight until none is above.

The number of sources is a dimension, not data: their word counts come to the driver. Prefix sums are two-level (hash
ranges within a source, then inside a range; slots likewise in chunks), so that neither a large source nor the schedule
sits in one task.

Defined results: a null or blank text has size 0 and is never taken; a null source is a source. Repeated rows are
documents of their own. An empty table gives no rows. Only ``doc_id``, ``source`` and the text column are read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept_table

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
BLOCK_WORDS = 256
GOLDEN = (math.sqrt(5) - 1) / 2
#: White space between words, as a Java class (fixed value).
BLANK_CLASS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_CLASS), "")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Water level: each target is its weight times a common level, or its cap if that is lower."""
    left, weight, out = share * sum(sizes), float(sum(weights)), [0.0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i] / weights[i]):
        out[i] = min(cap * sizes[i], left * weights[i] / weight)
        left, weight = left - out[i], weight - weights[i]
    return out


def _stretch(ends: np.ndarray):
    def place(frames):
        for frame in frames:
            x = np.mod((frame["slot"].to_numpy() + 0.5) * GOLDEN, 1.0) * ends[-1]
            yield pd.DataFrame({"slot": frame["slot"],
                                "number": np.minimum(np.searchsorted(ends, x, side="right"), len(ends) - 1)})

    return place


def schedule(spark: SparkSession, plan: pd.DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots of the mix: ``slot``, ``number`` (of the source), ``rank``, ``block``, ``words``.

    ``plan`` has a row per source: number, size and goal (whole words to take).
    """
    live = plan[plan["goal"] > 0].sort_values("number")
    shape = "slot long, number long, rank long, block long, words long"
    if not len(live):
        return spark.createDataFrame([], shape)
    blocks = -(-live["size"] // block_words)
    passes, rest = live["goal"] // live["size"], live["goal"] % live["size"]
    needed = passes * blocks + -(-rest // block_words)
    facts = live.assign(blocks=blocks, needed=needed, number=live["number"].astype("int64"))
    total = int(needed.sum())
    chunk = max(1, math.isqrt(total))
    ids, ends = live["number"].to_numpy(), np.cumsum(needed.to_numpy(float))
    known = spark.createDataFrame(facts[["number", "size", "goal", "blocks", "needed"]].astype("int64"))
    points = spark.range(total).withColumnRenamed("id", "slot").mapInPandas(
        _stretch(ends), "slot long, number long").withColumn(
        "number", F.element_at(F.array(*[F.lit(int(i)) for i in ids]), (F.col("number") + 1).cast("int")).cast("long")
    ).withColumn("chunk", F.floor(F.col("slot") / chunk))
    points = kept_table(points, "mix-points")
    before = points.groupBy("number", "chunk").agg(F.count("*").alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("number").orderBy("chunk")) - F.col("n"))
    ranked = points.withColumn("inner", F.row_number().over(Window.partitionBy("number", "chunk").orderBy("slot"))).join(
        before.drop("n"), ["number", "chunk"]).select("slot", "number", (F.col("before") + F.col("inner") - 1).alias("rank"))
    made = points.groupBy("number").agg(F.count("*").alias("made"))
    short = known.join(made, "number", "left").select(
        "number", F.coalesce("made", F.lit(0)).alias("made"), "needed").where("made < needed").select(
        F.lit(total).cast("long").alias("slot"), "number",
        F.explode(F.sequence("made", F.col("needed") - 1)).alias("rank"))
    slots = ranked.union(short).join(F.broadcast(known), "number").where("rank < needed")
    block = F.col("rank") % F.col("blocks")
    done = F.floor(F.col("rank") / F.col("blocks")) * F.col("size") + block * block_words
    return slots.select("slot", "number", "rank", block.alias("block"), F.least(
        F.lit(block_words), F.col("size") - block * block_words, F.col("goal") - done).cast("long").alias("words"))


def measured(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.size(words_of(F.col("text"))).cast("long").alias("size"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"),
        F.xxhash64(F.col("doc_id").cast("string"), F.lit("mix")).alias("key"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP,
        block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document row: doc_id, source, digest (of the text), size, source_size, target, taken."""
    spark = docs.sparkSession
    sizes = kept_table(measured(docs), "mix-sizes")
    known = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    known = sorted(known, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    own = [float(weights[i % len(weights)]) for i in range(len(known))]
    goal = targets([r["size"] for r in known], own, share, cap) if known else []
    plan = pd.DataFrame({"number": range(len(known)), "size": [r["size"] for r in known],
                         "goal": [int(round(g)) for g in goal]}, dtype="int64")
    slots = schedule(spark, plan, block_words)
    facts = spark.createDataFrame(
        [(i, r["source"], r["size"], float(g)) for i, (r, g) in enumerate(zip(known, goal, strict=True))],
        "number long, source string, source_size long, target double")
    ranges = max(1, math.isqrt(max((r["n"] for r in known), default=1)))
    # 24 high bits of the hash, order kept, spread over the ranges
    part = F.floor((F.shiftrightunsigned(F.col("key"), 40) * ranges) / (1 << 24))
    lined = sizes.join(F.broadcast(facts.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of"))).drop(
        "of").withColumn("part", part)
    parts = lined.groupBy("number", "part").agg(F.sum("size").alias("words")).withColumn(
        "before", F.sum("words").over(Window.partitionBy("number").orderBy("part")) - F.col("words")).drop("words")
    order = Window.partitionBy("number", "part").orderBy("key", "doc_id", "size", "digest")
    placed = lined.withColumn("row", F.row_number().over(order)).withColumn(
        "inner", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(
        parts, ["number", "part"]).withColumn("start", F.col("before") + F.col("inner") - F.col("size"))
    placed = kept_table(placed.drop("before", "inner", "key"), "mix-placed")
    pieces = placed.where("size > 0").select(
        "number", "part", "row", "start", "size", F.explode(F.sequence(
            F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * block_words + F.col("words"))
    taken = pieces.join(slots.select("number", "block", "words"), ["number", "block"]).groupBy(
        "number", "part", "row").agg(F.sum(F.greatest(F.lit(0), high - low)).alias("taken"))
    return placed.join(taken, ["number", "part", "row"], "left").select(
        "doc_id", "source", "digest", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: one row per time a text is taken, the last cut to the words taken; columns of ``docs``.

    A cut text is its first words joined by one blank, with ``n_chars`` counted anew; a text taken 0 times is left out.
    """
    chosen = mix(docs).where("taken > 0").groupBy("doc_id", "source", "digest").agg(
        F.max("taken").alias("taken_"), F.max("size").alias("size_")).withColumnsRenamed(
        {"doc_id": "doc_", "source": "source_", "digest": "digest_"})
    # the documents' own names give way to numbers, so that they cannot meet the names used here
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain, text, chars = docs.toDF(*names.values()), F.col(names["text"]), names.get("n_chars")
    whole = F.col("time_") * F.col("size_") <= F.col("taken_")
    rest = (F.col("taken_") - (F.col("time_") - 1) * F.col("size_")).cast("int")
    joined = plain.join(chosen, F.col(names["doc_id"]).eqNullSafe(F.col("doc_"))
                        & F.col(names["source"]).cast("string").eqNullSafe(F.col("source_"))
                        & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("digest_")))
    times = joined.withColumn("time_", F.explode(F.sequence(
        F.lit(1).cast("long"), F.ceil(F.col("taken_") / F.col("size_")))))
    cut = F.array_join(F.slice(words_of(text), 1, rest), " ")
    out = times.withColumn(names["text"], F.when(whole, text).otherwise(cut))
    if chars:
        out = out.withColumn(chars, F.when(whole, F.col(chars)).otherwise(F.length(names["text"])).cast(
            docs.schema["n_chars"].dataType))
    return out.select(*names.values()).toDF(*docs.columns)

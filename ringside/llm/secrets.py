"""Secret scan: fixed rules plus character Markov models, in DataFrame functions only.

Base rules find assigned values, access keys and long hexadecimal runs. Beside them, all runs of at least MIN_RUN key
characters are scored by two first-order character models, one of random strings and one of ordinary identifiers; a run
whose log-likelihood ratio is at least MIN_RATIO, and MIN_PER_CHARACTER for each of its characters, is a span of kind
``random`` unless it meets a base span. The ratio alone decides; what it misses is stated in the tests (random strings of
lower-case letters only, which look like rare words, and of digits only).

Both models are counted from labelled samples: values that a base rule found are random strings, all other runs of
word characters are ordinary. They come from at most SAMPLE documents, those with the smallest hash of their id;
the scan itself covers every document. Only the counts of character pairs (alphabet squared) reach the driver.

Positions are code points, ends exclusive, from the pieces between matches: no step runs Python.

Defined results: a null or empty text has no spans. Without any labelled sample a model falls back to even odds for all
characters, so nothing is added. Rows are scanned one by one: repeated rows get equal results, an empty table gives
none. Only ``doc_id`` and the text column are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base rules, in the order in which spans at one start are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE = 8

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_RUN = 12
RUN = rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}+"
ORDINARY = r"[A-Za-z0-9_-]{8,}"
SAMPLE = 20_000
MIN_RATIO, MIN_PER_CHARACTER = 12.0, 0.5
SMOOTHING = 4.0
#: Matches whose places are summed together.
BLOCK = 128

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def matches(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end); with ``keep``, a list of booleans, those it marks.

    Places are running sums: first inside blocks of BLOCK matches, then over the blocks, because a list that grows item by
    item is copied with every item.
    """
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    marks = F.transform(lengths, lambda x: F.lit(True)) if keep is None else keep
    # every piece but the last is followed by a match
    zipped = F.slice(F.arrays_zip(pieces.alias("before"), lengths.alias("size"), marks.alias("keep")), 1, F.size(lengths))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["before"] + x["size"]
        span = F.struct((acc["at"] + x["before"]).alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["keep"], F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    def summed(items: Column) -> Column:
        return F.aggregate(items, F.struct(F.lit(0).alias("at"), _none().alias("found")), step)

    def placed(blocks: Column) -> Column:
        starts = F.aggregate(
            blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
            lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))
        return F.flatten(F.zip_with(blocks, starts["starts"], lambda x, o: F.transform(x["found"], lambda s: F.struct(
            (s["start"] + o).alias("start"), s["kind"].alias("kind"), (s["end"] + o).alias("end")))))

    def in_blocks(items: Column) -> Column:
        count = F.floor((F.size(items) + (BLOCK - 1)) / BLOCK).cast("int")
        numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda i: summed(F.slice(items, i * BLOCK + 1, BLOCK)))

    # each list is worked out once and handed on
    return F.get(F.transform(F.transform(F.array(zipped), in_blocks), placed), F.lit(0))


def base_spans(text: Column) -> Column:
    """Spans of the base rules by start, then kind."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assigned = F.filter(F.arrays_zip(matches(text, ASSIGN, 0).alias("span"), values.alias("value")),
                        lambda x: F.length(x["value"]) >= MIN_VALUE)
    return F.array_sort(F.concat(
        F.when(text.rlike(ASSIGN), F.transform(assigned, lambda x: x["span"])).otherwise(_none()),
        F.when(F.contains(text, F.lit("AKIA")), matches(text, ACCESS, 1)).otherwise(_none()),
        F.when(text.rlike(HEX), matches(text, HEX, 2)).otherwise(_none())))


def values_found(text: Column) -> Column:
    """Strings that the base rules take for secrets."""
    return F.concat(
        F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda x: F.length(x) >= MIN_VALUE),
        F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), F.regexp_extract_all(text, F.lit(HEX), F.lit(0)))


def train(docs: DataFrame, sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratio of every character pair, row by row over the alphabet."""
    chosen = docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    texts = docs.join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("body"))
    labelled = texts.select("body", values_found(F.col("body")).alias("secret")).select(
        F.explode(F.concat(
            F.transform("secret", lambda x: F.struct(x.alias("run"), F.lit(1).alias("random"))),
            F.transform(
                F.filter(F.regexp_extract_all("body", F.lit(ORDINARY), F.lit(0)),
                         lambda x: ~F.exists("secret", lambda s: F.contains(s, x))),
                lambda x: F.struct(x.alias("run"), F.lit(0).alias("random"))))).alias("x")).select("x.*")
    pairs = labelled.groupBy("run", "random").agg(F.count("*").alias("n")).select(
        "random", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - 1), lambda i: F.substring("run", i, 2)))
        .alias("pair"))
    pairs = pairs.where(F.length(F.translate("pair", ALPHABET, "")) == 0)
    # a kind of run counts by the logarithm of its copies, so that a much repeated one doesn't rule the model
    rows = pairs.groupBy("random", "pair").agg(F.sum(F.log2(F.col("n") + 1)).alias("n")).collect()
    size = len(ALPHABET)
    tables = [[[0.0] * size for _ in range(size)] for _ in range(2)]
    for r in rows:
        tables[r["random"]][ALPHABET.index(r["pair"][0])][ALPHABET.index(r["pair"][1])] += r["n"]
    out = []
    singles = []
    for t in tables:
        column = [sum(t[i][j] for i in range(size)) + 1.0 for j in range(size)]
        singles.append([c / sum(column) for c in column])
    for i in range(size):
        for j in range(size):
            plain, random = (
                (t[i][j] + SMOOTHING * s[j]) / (sum(t[i]) + SMOOTHING) for t, s in zip(tables, singles, strict=True))
            out.append(math.log(random / plain))
    return out


def ratio(run: Column, table: Column) -> Column:
    """Log-likelihood ratio of a run of key characters."""
    place = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.aggregate(
        place, F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, p: F.struct(
            p.alias("last"),
            F.when(acc["last"] == 0, acc["sum"]).otherwise(
                acc["sum"] + F.element_at(table, (acc["last"] - 1) * len(ALPHABET) + p)).alias("sum")))["sum"]


def model_spans(text: Column, base: Column, table: Column) -> Column:
    likely = F.transform(
        F.regexp_extract_all(text, F.lit(RUN), F.lit(0)),
        lambda run: ratio(run, table) >= F.greatest(F.lit(MIN_RATIO), F.length(run) * MIN_PER_CHARACTER))
    apart = F.filter(matches(text, RUN, 3, likely), lambda x: ~F.exists(
        base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return F.when(text.rlike(RUN), apart).otherwise(_none())


def listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, table: list[float]) -> DataFrame:
    """doc_id, base (spans of the rules) and all (with the model's) of every document."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    ruled = texts.withColumn("base", base_spans(F.col("body")))
    added = ruled.withColumn("added", model_spans(F.col("body"), F.col("base"), F.lit(table)))
    return added.select("doc_id", "base", F.array_sort(F.concat("base", "added")).alias("all"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, train(docs))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))

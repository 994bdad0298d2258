"""Domain tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ringside.functions import html, text
from ringside.functions.odds import two_digits
from ringside.operators.topk import first_n
from ringside.registry import PROJECT_KEYS


#: Records of one day: they come a minute apart.
DAY = 1440


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def big(col: Column) -> Column:
    return col.cast("bigint")


def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id, project, kind and time of the records, without their pages."""
    return table(spark, sf_dir, "documents").select(*_key_columns())


def _key_columns() -> list[Column]:
    doc = F.col("doc_id")
    return [
        doc.alias("record_id"),
        pick(PROJECT_KEYS, F.substring("source", 4, 10).cast("int") % 5).alias("project_key"),
        F.when(doc % 2 == 0, "idea").otherwise("context").alias("entity_type"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=F.floor(doc / DAY).cast("int"), mins=(doc % DAY).cast("int")))
        .alias("created_ts"),
    ]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idea and context records from documents; every third has a page link."""
    docs = table(spark, sf_dir, "documents")
    pages = table(spark, sf_dir, "pages")
    doc = F.col("doc_id")
    link = F.col("source_url")
    # only the readable beginning of the pages that are asked for goes into the join
    page = F.col("page_id")
    pages = pages.select(
        "page_id", F.when(page % 3 == 0, F.col("url")).alias("source_url"),
        F.when((page % 3 == 0) & (page % 4 != 0), F.substring(html.readable_text(F.col("html")), 1, html.READABLE_LIMIT))
        .alias("readable"),
    )
    base = docs.join(pages, doc == page, "left").select("doc_id", "text", "lang", "source", "readable", "source_url")
    raw = F.when(link.isNotNull() & (doc % 2 == 0), link).otherwise(F.col("text"))
    return base.select(
        *_key_columns(),
        "lang",
        "text",
        "source_url",
        raw.alias("raw_input"),
        F.when(doc % 5 == 0, "").otherwise(text.strip(raw)).alias("normalized_text"),
        F.when(
            link.isNotNull() & (doc % 4 != 0),
            F.col("readable"),
        ).otherwise("").alias("extracted_content"),
        F.when(link.isNull(), "not_applicable").when(doc % 4 == 0, "fetch_failed")
        .otherwise("success").alias("link_fetch_status"),
        F.when(link.isNotNull() & (doc % 4 == 0), "HTTP 404").alias("link_fetch_error"),
    )


METHODS = ("KO/TKO", "Submission (RNC)", "Decision - Unanimous", "DQ")
EVENT_NAMES = (
    "UFC 300: Main", "UFC Fight Night", "LFA 12", "Bellator 200", "Cage Warriors: Nine", "Open Mat",
)


def fights(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind, event_id = F.col("event_type"), F.col("event_id")
    return events.select(
        F.col("user_id").alias("fighter"),
        "event_id",
        "ts",
        F.date_format("ts", "yyyy-MM-dd").alias("fight_date"),
        F.concat(F.lit("Opponent "), event_id % 97).alias("opponent"),
        F.when(kind == "purchase", "W").when(kind == "error", "L").when(kind == "view", "D")
        .otherwise("NC").alias("result"),
        pick(METHODS, event_id % 4).alias("method"),
        (event_id % 5 + 1).alias("round"),
        pick(EVENT_NAMES, event_id % 6).alias("event_name"),
    )


def last_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most recent fights per fighter, ``pos`` 1 being the latest."""
    return first_n(
        fights(spark, sf_dir), ["fighter"], [F.col("ts").desc(), F.col("event_id").desc()], 5, "pos"
    )


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring parts as bouts, twelve to a card."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    even, odd = key % 2 == 0, key % 2 == 1
    return (
        part.groupBy(F.expr("p_partkey div 2").alias("bout_key"))
        .agg(
            F.max(F.when(even, F.col("p_name"))).alias("a_name"),
            F.max(F.when(odd, F.col("p_name"))).alias("b_name"),
            F.max(F.when(even, F.col("p_type"))).alias("kind"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter(F.col("n") == 2)
        .select(
            "bout_key",
            F.expr("bout_key div 12").alias("card"),
            (F.col("bout_key") % 12).alias("pos"),
            "a_name", "b_name", "kind",
        )
    )


def odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odds rows of each card: other order, some swapped, some names cut."""
    key, row = F.col("bout_key"), F.col("row_index")
    even = key % 2 == 0
    base = bouts(spark, sf_dir).select(
        "card", "bout_key", ((F.col("pos") * 7) % 12).alias("row_index"),
        F.when(key % 5 == 0, F.substring_index("a_name", " ", -1)).otherwise(F.col("a_name")).alias("n1"),
        F.col("b_name").alias("n2"),
        F.concat(F.when(even, "-").otherwise("+"), (100 + key % 900).cast("string")).alias("o1"),
        F.concat(F.when(even, "+").otherwise("-"), (110 + key % 700).cast("string")).alias("o2"),
    )

    def either(swapped: str, straight: str) -> Column:
        return F.when(row % 3 == 0, F.col(swapped)).otherwise(F.col(straight))

    return base.select(
        "card", "row_index", "bout_key",
        either("n2", "n1").alias("a_name"), either("n1", "n2").alias("b_name"),
        either("o2", "o1").alias("a_american"), either("o1", "o2").alias("b_american"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_of(table(spark, sf_dir, "events"))


def runs_of(events: DataFrame, *further: Column) -> DataFrame:
    """Monitor log: sign-ups open a window, everything else is an update run. ``further`` columns come along."""
    event_id, day = F.col("event_id"), F.to_date("ts")
    signup = F.col("event_type") == "signup"
    return events.select(
        F.col("user_id").alias("key"),
        event_id.alias("seq"),
        F.when(signup, "baseline").otherwise("incremental").alias("kind"),
        day.alias("run_date"),
        F.when(signup, F.date_add(day, (event_id % 9).cast("int"))).alias("opened_date"),
        F.sha2(
            F.concat_ws("|", "event_type", two_digits(F.rint(F.col("value") / 50) * 50)), 256
        ).alias("hash"),
        *further,
    )


def fighters_count(spark, d) -> int:
    """Fighters are the users of ``events``, numbered from 0: one number, whatever the scale."""
    return (table(spark, d, "events").agg(F.max("user_id")).first()[0] or 0) + 1

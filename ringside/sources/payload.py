"""JSON payloads inside pages, and their flattening."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from ringside.operators.topk import filter_then_first


def tagged_json(html: Column, tag_open: str) -> Column:
    """Body of the script element that opens with ``tag_open``."""
    escaped = "".join("\\" + ch if ch in ".*+?()[]{}|^$\\" else ch for ch in tag_open)
    return F.nullif(F.regexp_extract(html, rf"(?s){escaped}(.*?)</script>", 1), F.lit(""))


def scripts_with(html: Column, marker: str) -> Column:
    """All script bodies that hold the marker, in page order."""
    bodies = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1))
    return F.filter(bodies, lambda b: F.contains(b, F.lit(marker)))


def enclosing_json(marker: str, anchor: str = '"page":{'):
    """Column function: smallest JSON object around the marker, from the first script that has one.

    The search starts at the last anchor before the marker, or at the marker
    itself, and goes outwards over the opening braces before it.
    """

    def around(script: str | None, decoder: json.JSONDecoder) -> str | None:
        at = script.find(marker) if script else -1
        if at < 0:
            return None
        hook = script.rfind(anchor, 0, at)
        brace = script.rfind("{", 0, hook if hook >= 0 else at)
        while brace >= 0:
            try:
                _, end = decoder.raw_decode(script, brace)
            except ValueError:
                end = -1
            if end > at:
                return script[brace:end]
            brace = script.rfind("{", 0, brace)
        return None

    @F.pandas_udf(StringType())
    def enclosing(scripts: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def first(bodies) -> str | None:
            found = (around(body, decoder) for body in bodies)
            return next((text for text in found if text is not None), None)

        return scripts.map(first, na_action="ignore")

    return enclosing


def flatten_card(df: DataFrame, keep: list[str], segments: str = "segments") -> DataFrame:
    """One row per match with its segment and both positions from 0.

    Absent or empty arrays give no rows; ``confirmed`` counts all matches.
    """
    matches = F.transform(segments, lambda s: F.coalesce(F.size(s["mtchs"]), F.lit(0)))
    total = F.aggregate(matches, F.lit(0), lambda a, n: a + F.greatest(n, F.lit(0)))
    return (
        df.select(*keep, F.coalesce(total, F.lit(0)).alias("confirmed"),
                  F.posexplode(segments).alias("segment_pos", "segment"))
        .select(*keep, "confirmed", "segment_pos", "segment.hdr", "segment.nm",
                F.posexplode("segment.mtchs").alias("match_pos", "match"))
    )


def _listed(value: Column, path: str) -> Column:
    """The variant at ``path`` if it is a list, else NULL."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(found).startswith("ARRAY"), found)


def each(df: DataFrame, items: Column, place: str, value: str) -> DataFrame:
    """One row per item of a variant list, with its place from 0; NULL gives no rows."""
    spark = df.sparkSession
    exploded = spark.tvf.variant_explode(items.outer()).select(F.col("pos").alias(place), F.col("value").alias(value))
    return df.lateralJoin(exploded)


def market_events(payloads: DataFrame, keep: list[str], body: str = "body") -> DataFrame:
    """Events of market feeds: ``keep``, places of query, page and event, slug, title and the list of markets (variant).

    ``body`` is JSON text, read once into a variant; parts of another shape than expected give no rows. An event needs a
    slug, a title and a list of markets; then the first of a slug counts, in the order of the feed.
    """
    feed = payloads.select(*keep, F.try_parse_json(body).alias("feed_"))
    # Fixed value: where the feed keeps its queries.
    queries = each(feed.withColumn("qs_", _listed(F.col("feed_"), "$.props.pageProps.dehydratedState.queries")).drop("feed_"),
                   F.col("qs_"), "query_pos", "query_").drop("qs_")
    pages = each(queries.withColumn("ps_", _listed(F.col("query_"), "$.state.data.pages")).drop("query_"),
                 F.col("ps_"), "page_pos", "page_").drop("ps_")
    events = each(pages.withColumn("es_", _listed(F.col("page_"), "$.events")).drop("page_"),
                  F.col("es_"), "event_pos", "event_").drop("es_")
    read = events.select(
        *keep, "query_pos", "page_pos", "event_pos", F.try_variant_get("event_", "$.slug", "string").alias("slug"),
        F.try_variant_get("event_", "$.title", "string").alias("title"), _listed(F.col("event_"), "$.markets").alias("markets"))
    valid = (F.col("slug") != "") & (F.col("title") != "") & F.col("markets").isNotNull()
    return filter_then_first(read, valid, [*keep, "slug"], ["query_pos", "page_pos", "event_pos"])


def market_list(markets: Column) -> Column:
    """Markets of an event as structs; outcomes and prices that are no lists are NULL."""
    return F.try_variant_get(markets, "$", "array<struct<question:string,outcomes:variant,outcomePrices:variant>>")


def market_prices(markets: Column) -> Column:
    """Question, outcomes and prices of every market of an event."""
    return F.transform(market_list(markets), lambda m: F.struct(
        m["question"].alias("question"), F.try_variant_get(m["outcomes"], "$", "array<string>").alias("outcomes"),
        F.try_variant_get(m["outcomePrices"], "$", "array<string>").alias("prices")))


def zip_aligned(red: Column, blue: Column, meta: Column) -> Column:
    """Names zipped with the reversed metadata; empty unless all lengths agree."""
    aligned = (F.size(red) > 0) & (F.size(red) == F.size(blue)) & (F.size(red) == F.size(meta))
    zipped = F.arrays_zip(red.alias("red"), blue.alias("blue"), F.reverse(meta).alias("meta"))
    return F.when(aligned, F.reverse(zipped))

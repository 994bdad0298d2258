"""Scored lookup of an event link on a listing page, and article choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ringside.functions.html import html_unescape
from ringside.functions.text import bind, slug_ascii
from ringside.operators.topk import keep_first

WINDOW = 5_000


def _hits(text: Column, a_last: Column, b_last: Column) -> Column:
    """5 for each last name found in the slug of the text."""

    def score(slug: Column) -> Column:
        return F.when(F.contains(slug, a_last), 5).otherwise(0) + F.when(F.contains(slug, b_last), 5).otherwise(0)

    return bind(slug_ascii(text), score)


def best_link(links: Column, html: Column, a_last: Column, b_last: Column, day: Column) -> Column:
    """Best link of one page, as a struct of score and href, or NULL.

    First by link text and date parts of the link; if nothing scores, by the
    page text around each link. ``links`` are structs of href and text; all
    work stays inside the row.
    """
    year, month, date = (F.date_format(day, p) for p in ("yyyy", "yyyyMM", "dd"))

    by_text = F.transform(
        links,
        lambda link, i: F.struct(
            (
                _hits(F.lower(link["text"]), a_last, b_last)
                + F.contains(link["href"], date).cast("int")
                + F.contains(link["href"], year).cast("int")
            ).alias("score"),
            (-i).alias("back"),
            link["href"].alias("href"),
        ),
    )
    raw = F.lower(html)

    def around(href: Column) -> Column:
        at = F.position(F.lower(href), raw)
        start = F.greatest(at - WINDOW, F.lit(1))
        return F.when(at > 0, F.substr(raw, start, at + WINDOW - start))

    by_window = F.transform(
        F.transform(
            F.array_sort(F.array_distinct(F.transform(links, lambda link: link["href"]))),
            lambda href: F.struct(href.alias("href"), around(href).alias("text")),
        ),
        lambda w, i: F.struct(
            (
                _hits(w["text"], a_last, b_last)
                + F.contains(F.replace(w["text"], F.lit("-"), F.lit("")), month).cast("int")
            ).alias("score"),
            (-i).alias("back"),
            w["href"].alias("href"),
        ),
    )
    first = F.array_max(F.filter(by_text, lambda x: x["score"] > 0))
    second = F.array_max(F.filter(by_window, lambda x: x["score"] > 0))
    return F.coalesce(first, second)


def title_matches(
    title_slug: Column, a_last: Column, b_last: Column, event_slug: Column | None = None
) -> Column:
    """Both last names of the main bout are in the title; of an event without bouts, its own slug."""
    pair = F.contains(title_slug, a_last) & F.contains(title_slug, b_last)
    if event_slug is None:
        return pair
    return F.when(a_last.isNull() & b_last.isNull(), F.contains(title_slug, event_slug)).otherwise(pair)


def best_article(found: DataFrame) -> DataFrame:
    """Latest opening-odds article per card among its own search results.

    ``found`` has card, term_ord, rank, post_id, title, date_gmt, a_last and
    b_last. Posts without an id do not count; any other post counts where it
    first shows up, before the title filters. Titles are decoded.
    """
    known = found.filter(F.coalesce("post_id", F.lit(0)) != 0).withColumn("title", html_unescape(F.col("title")))
    first = keep_first(known, ["card", "post_id"], ["term_ord", "rank"])
    slug = slug_ascii(F.col("title"))
    odds_title = F.contains(slug, F.lit("opening-betting-odds")) | F.contains(slug, F.lit("opening-odds"))
    fitting = first.filter(odds_title & title_matches(slug, F.col("a_last"), F.col("b_last")))
    return keep_first(fitting, ["card"], [F.col("date_gmt").desc(), "term_ord", "rank"])

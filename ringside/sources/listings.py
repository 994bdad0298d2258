"""Whole listing pages to rows: schedules, news articles and fight cards, through the nodes of the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ringside.functions import classify, dates, nodes
from ringside.functions.text import strip
from ringside.operators.topk import first_then_filter
from ringside.sources import payload

# Fixed values of the listing markup.
EVENT_PATH = "/mma/fightcenter/_/id/"
ARTICLE, ARTICLE_TITLE, ARTICLE_TIME = "contentItem", "contentItem__title", "time-elapsed"
RED, BLUE = "c-listing-ticker-fightcard__red_corner_name", "c-listing-ticker-fightcard__blue_corner_name"
FIGHT, FIGHT_ID, FIGHT_CLASS = "c-listing-fight", "data-fmid", "c-listing-fight__class-text"
SEGMENTS = {"Main Card": "Main Card", "Prelims": "Prelim", "Early Prelims": "Early Prelim"}


def absolute(base: Column, href: Column) -> Column:
    """``href`` seen from the page ``base``: whole addresses, own host, own scheme, or beside the page."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/(?:[^?#]*/)?)?)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(host, href))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), href))
    )


def schedule(pages: DataFrame, page_key: str, html: Column, reference: Column, base: Column) -> DataFrame:
    """Events of schedule pages: the table rows around links to an event, with at least five cells of their own.

    Of rows with one link the first of the page counts, then its date has to be valid.
    """
    page = F.col("page_")
    link = nodes.link_to(EVENT_PATH)
    rows = F.transform(
        nodes.holding(page, link, "tr"),
        lambda row: F.struct(
            strip(nodes.first(nodes.inside(page, row, link))["attrs"]["href"]).alias("href"),
            F.transform(nodes.children(page, row, nodes.is_tag("td")), lambda cell: nodes.in_one_line(nodes.text(page, cell)))
            .alias("cells"),
        ),
    )
    cells = F.col("row_.cells")
    listed = (
        pages.select(page_key, reference.alias("day_"), base.alias("base_"), nodes.scan(html, ("href",), ("tr",)).alias("page_"))
        .select(page_key, "day_", "base_", F.posexplode(rows).alias("pos", "row_"))
        .filter(F.size(cells) >= 5)
        .select(
            page_key, "pos", absolute(F.col("base_"), F.col("row_.href")).alias("event_url"),
            dates.infer_year(cells[0], F.col("day_")).alias("event_date"), cells[1].alias("event_time"),
            cells[2].alias("broadcast"), cells[3].alias("event_name"), cells[4].alias("location"),
        )
    )
    return first_then_filter(listed, F.col("event_date").isNotNull(), [page_key, "event_url"], ["pos"])


def articles(pages: DataFrame, page_key: str, html: Column, base: Column) -> DataFrame:
    """News articles of listing pages in page order; title and link are needed."""
    page = F.col("page_")

    def pieces(node: Column) -> Column:
        return strip(F.array_join(nodes.texts(page, node), " "))

    found = F.transform(
        nodes.select(page, nodes.both(nodes.is_tag("article"), nodes.has_class(ARTICLE))),
        lambda node: F.struct(
            pieces(nodes.first(nodes.inside(page, node, nodes.both(nodes.is_tag("h2"), nodes.has_class(ARTICLE_TITLE)))))
            .alias("title"),
            strip(nodes.first(nodes.inside(page, node, lambda n: (n["tag"] == "a") & n["attrs"]["href"].isNotNull()))
                  ["attrs"]["href"]).alias("href"),
            F.coalesce(pieces(nodes.first(nodes.inside(page, node, nodes.has_class(ARTICLE_TIME)))), F.lit("")).alias("published"),
        ),
    )
    return (
        pages.select(page_key, base.alias("base_"), nodes.scan(html, ("class", "href")).alias("page_"))
        .select(page_key, "base_", F.posexplode(found).alias("pos", "a_"))
        .filter((F.col("a_.title") != "") & (F.col("a_.href") != ""))
        .select(page_key, "pos", "a_.title", absolute(F.col("base_"), F.col("a_.href")).alias("url"), "a_.published")
    )


def card(pages: DataFrame, page_key: str, html: Column) -> DataFrame:
    """Bouts of card pages: names from the ticker, the rest from the fights, which are listed the other way round.

    A page whose three lists differ in length gives no rows. The segment of a
    fight is the last heading at or above its line.
    """
    page = F.col("page_")
    div = nodes.is_tag("div")

    def names(part: str) -> Column:
        return F.transform(
            nodes.select(page, nodes.both(div, nodes.has_class(part))), lambda n: strip(nodes.text(page, n)))

    headings = F.filter(
        F.transform(nodes.select(page, nodes.is_tag("h3")), lambda n: F.struct(n["line"].alias("line"), strip(nodes.text(page, n)).alias("label"))),
        lambda h: h["label"].isin(*SEGMENTS),
    )

    def segment(fight: Column) -> Column:
        above = F.filter(headings, lambda h: h["line"] <= fight["line"])
        return F.coalesce(F.try_element_at(classify.literal_map(SEGMENTS), F.try_element_at(above, F.lit(-1))["label"]), F.lit("Card"))

    def weight_class(fight: Column) -> Column:
        node = nodes.first(nodes.inside(page, fight, nodes.both(div, nodes.has_class(FIGHT_CLASS))))
        parts = F.filter(F.transform(nodes.texts(page, node), strip), lambda x: x != "")
        return F.coalesce(classify.translate_weight_class(F.array_join(parts, " ")), F.lit("n/a"))

    fights = F.transform(
        nodes.select(page, nodes.both(div, nodes.has_class(FIGHT), lambda n: n["attrs"][FIGHT_ID].isNotNull())),
        lambda f: F.struct(f["attrs"][FIGHT_ID].alias("bout_id"), segment(f).alias("card_segment"), weight_class(f).alias("weight_class")),
    )
    lists = pages.select(page_key, nodes.scan(html, ("class", FIGHT_ID)).alias("page_")).select(
        page_key, names(RED).alias("red"), names(BLUE).alias("blue"), fights.alias("meta"))
    return lists.select(
        page_key, F.posexplode(payload.zip_aligned(F.col("red"), F.col("blue"), F.col("meta"))).alias("pos", "b")
    ).select(page_key, "pos", "b.meta.bout_id", F.col("b.red").alias("a_name"), F.col("b.blue").alias("b_name"),
             "b.meta.weight_class", "b.meta.card_segment")

"""HTML columns: readable text, links, table rows and paragraph pairs."""

from __future__ import annotations

import html as html_lib

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

from ringside.functions.text import WHITESPACE, collapse_spaces, strip

READABLE_LIMIT = 12_000

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


@F.pandas_udf(StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    """Named and numeric character references; Spark SQL has no such function."""
    return text.map(html_lib.unescape, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def unescape_all(texts: pd.Series) -> pd.Series:
    """Character references of every text in a list."""
    return texts.map(lambda items: [html_lib.unescape(x) for x in items], na_action="ignore")


# These patterns define which markup readable text leaves out.
def drop_markup(html: Column) -> Column:
    """Scripts, styles, noscript blocks and tags become spaces."""
    for tag in ("script", "style", "noscript"):
        html = F.regexp_replace(html, rf"(?is)<{tag}.*?>.*?</{tag}>", " ")
    return F.regexp_replace(html, r"(?s)<[^>]+>", " ")


def readable_text(html: Column) -> Column:
    return collapse_spaces(html_unescape(drop_markup(html)))


def page_status(content_type: Column, text: Column) -> Column:
    supported = content_type.contains("text/html") | content_type.contains("text/plain")
    return (
        F.when(~F.coalesce(supported, F.lit(False)), "unsupported_content")
        .when(F.coalesce(text, F.lit("")) == "", "empty_content")
        .otherwise("success")
    )


def anchors(html: Column) -> Column:
    """``<a href="..">text</a>`` as structs of href and text, in page order; the value may be quoted either way or bare."""
    value = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    whole = F.regexp_extract_all(html, F.lit(rf"(?is)<a\s[^>]*?href\s*=\s*{value}[^>]*>.*?</a>"), F.lit(0))
    href = rf"(?is)^<a\s[^>]*?href\s*=\s*{value}"
    return F.transform(
        whole,
        lambda a: F.struct(
            # one of the three forms matched, the other two groups are empty
            F.concat(*[F.regexp_extract(a, href, i) for i in (1, 2, 3)]).alias("href"),
            collapse_spaces(F.regexp_replace(a, r"(?s)<[^>]+>", " ")).alias("text"),
        ),
    )


def blocks(html: Column, tag: str) -> Column:
    """Inner HTML of every ``tag`` element, shortest match, in page order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), F.lit(1))


def paragraph_lines(paragraph: Column) -> Column:
    """Non-blank lines of a paragraph without tags."""
    lines = F.split(paragraph, LINE_BREAK)
    return F.filter(lines, lambda x: F.regexp_replace(x, rf"{WHITESPACE}+", "") != "")


def paragraph_pair(html: Column) -> Column:
    """Paragraphs without ``<strong>`` that hold exactly two odds lines."""
    kept = F.filter(blocks(html, "p"), lambda p: ~F.lower(p).contains("<strong>"))
    broken = F.transform(kept, lambda p: F.regexp_replace(F.regexp_replace(p, r"<br />|<br/>|<br>", "\n"), r"<[^>]+>", ""))
    pairs = F.transform(unescape_all(broken), paragraph_lines)
    pairs = F.filter(pairs, lambda p: F.size(p) == 2)
    parsed = F.transform(
        pairs,
        lambda p: F.struct(
            odds_line_name(p[0]).alias("a_name"),
            odds_line_price(p[0]).alias("a_american"),
            odds_line_name(p[1]).alias("b_name"),
            odds_line_price(p[1]).alias("b_american"),
        ),
    )
    return F.filter(parsed, lambda r: (r["a_american"] != "") & (r["b_american"] != ""))


_ODDS_LINE = rf"^(.+?){WHITESPACE}+([+-]\d{{3,4}})$"


def odds_line_name(line: Column) -> Column:
    return strip(F.regexp_extract(strip(line), _ODDS_LINE, 1))


def odds_line_price(line: Column) -> Column:
    return F.regexp_extract(strip(line), _ODDS_LINE, 2)


def table_cells(row: Column) -> Column:
    """Text of every ``<td>`` of one ``<tr>``."""
    cells = F.regexp_extract_all(row, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))
    return F.transform(cells, lambda c: collapse_spaces(F.regexp_replace(c, r"(?s)<[^>]+>", " ")))

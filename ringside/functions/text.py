"""Text columns: whitespace, titles, labels and slugs (all JVM-side)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Texts shown when a title is missing.
NO_TITLE = "Идея без заголовка"
NO_NAME = "Без названия"
BARE_LINK = "Ссылка без описания"
LINK_WORD = "ссылка"

# Every character that str.split() treats as white space. The wide ones sit
# behind one range test, so that ordinary letters cost two tests each.
_NARROW = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
_WIDE = "\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WHITESPACE = f"[{_NARROW}[\u1680-\u3000&&[{_WIDE}]]]"
WHITESPACE_CHARS = _NARROW + _WIDE



def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_to_null(col: Column) -> Column:
    """Empty text counts as missing; text made of blanks does not."""
    return F.nullif(col, F.lit(""))


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE_CHARS))


def collapse_spaces(col: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(col, rf"{WHITESPACE}+", " "))


def words(col: Column) -> Column:
    return F.filter(F.split(collapse_spaces(col), " "), lambda w: w != "")


def shorten(col: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three being dots when cut."""
    return F.when(F.length(col) <= limit, col).otherwise(
        F.concat(F.substring(col, 1, limit - 3), F.lit("..."))
    )


def build_title(text: Column, host: Column, extracted: Column) -> Column:
    """Record title from its text, or from host and page text for a bare link."""
    line = collapse_spaces(F.coalesce(text, F.lit("")))
    summary = F.substring(collapse_spaces(F.coalesce(extracted, F.lit(""))), 1, 70)
    host = F.coalesce(host, F.lit(""))
    labelled = F.when(host != "", F.concat(host, F.lit(": "), summary)).otherwise(summary)
    link_title = (
        F.when(summary != "", shorten(labelled, 80))
        .when(host != "", F.concat(host, F.lit(f": {LINK_WORD}")))
        .otherwise(BARE_LINK)
    )
    return (
        F.when(line == "", NO_TITLE)
        .when(line.rlike("^https?://"), link_title)
        .otherwise(shorten(line, 80))
    )


def derive_title(normalized: Column, raw: Column) -> Column:
    """Export title: first 80 characters, no dots."""
    line = collapse_spaces(F.coalesce(first_filled(normalized, raw), F.lit(NO_NAME)))
    return F.coalesce(blank_to_null(F.substring(line, 1, 80)), F.lit(NO_NAME))


def list_label(title: Column, url: Column, host: Column, extracted: Column) -> Column:
    """Listing label, cut at 60 characters; links show host and page text."""
    title = strip(F.coalesce(title, F.lit("")))
    url = F.coalesce(url, F.lit(""))
    summary = collapse_spaces(F.coalesce(extracted, F.lit("")))
    is_link = title.rlike("^https?://") | ((url != "") & (title == url))
    labelled = F.when(host != "", F.concat(host, F.lit(": "), summary)).otherwise(summary)
    link_label = (
        F.when(summary != "", F.substring(labelled, 1, 60))
        .when(host != "", F.substring(F.concat(host, F.lit(f": {LINK_WORD}")), 1, 60))
        .otherwise(BARE_LINK)
    )
    return (
        F.when(is_link, link_label)
        .when(title == "", NO_NAME)
        .otherwise(F.substring(title, 1, 60))
    )


# Outside these ranges (Latin letters, Cyrillic) no character has a longer form.
MAY_SPELL_LONGER = r"[\x{bc}-\x{be}\x{132}-\x{3ff}\x{530}-\x{10ffff}]"


@lru_cache(maxsize=1)
def _ascii_tables() -> tuple[str, str, tuple[str, ...]]:
    """ASCII forms of every character whose NFKD form has any, by rule.

    Two aligned strings for one-character forms, then ``character + form``
    entries for the rare longer ones.
    """
    source, target, longer = [], [], []
    for code in range(0x80, 0x110000):
        char = chr(code)
        if not unicodedata.decomposition(char):
            continue
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        elif plain:
            longer.append(char + plain)
    return "".join(source), "".join(target), tuple(longer)


def to_ascii(col: Column) -> Column:
    """NFKD, then drop what is not ASCII, as one table lookup per character.

    Only rows with a character outside ASCII enter the table, and only rows
    with one of the longer forms enter the fold over those.
    """
    source, target, longer = _ascii_tables()
    entries = F.split(F.lit("\x01".join(longer)), "\x01")
    char_class = "[" + "".join(entry[0] for entry in longer) + "]"
    spelled = F.when(
        col.rlike(MAY_SPELL_LONGER) & col.rlike(char_class),
        F.aggregate(
            entries, col, lambda acc, e: F.replace(acc, F.substring(e, 1, 1), F.substring(e, 2, 20))
        ),
    ).otherwise(col)
    return F.when(
        col.rlike(r"[^\x00-\x7F]"),
        F.regexp_replace(F.translate(spelled, source, target), r"[^\x00-\x7F]+", ""),
    ).otherwise(col)


def slug_ascii(col: Column, empty: str = "ufc-event") -> Column:
    slug = F.regexp_replace(F.lower(to_ascii(col)), "[^a-z0-9]+", "-")
    return F.coalesce(blank_to_null(F.btrim(slug, F.lit("-"))), F.lit(empty))


def slug_wide(col: Column) -> Column:
    """Slug that keeps Cyrillic letters, ``-`` and ``_``; hyphen runs stay."""
    dashed = F.regexp_replace(F.lower(strip(col)), rf"{WHITESPACE}+", "-")
    kept = F.regexp_replace(dashed, r"(?iu)[^a-zа-я0-9\-_]+", "-")
    return F.coalesce(blank_to_null(F.btrim(kept, F.lit("-"))), F.lit("item"))


def safe_id(col: Column, limit: int = 80) -> Column:
    value = F.lower(F.btrim(F.regexp_replace(col, "[^A-Za-z0-9._-]+", "-"), F.lit("-")))
    return F.coalesce(blank_to_null(F.substring(value, 1, limit)), F.lit("item"))


def safe_suffix(normalized: Column, raw: Column, limit: int = 24) -> Column:
    base = F.lower(F.coalesce(first_filled(normalized, raw), F.lit("item")))
    kept = F.substring(F.regexp_replace(base, "[^a-z0-9]", ""), 1, limit)
    return F.coalesce(blank_to_null(kept), F.lit("item"))


def drop_repeated_phrase(col: Column) -> Column:
    """``x y x y`` becomes ``x y``."""
    parts = words(col)
    half = (F.size(parts) / 2).cast("int")
    left = F.slice(parts, 1, half)
    right = F.slice(parts, half + 1, half)
    return F.when(
        (F.size(parts) >= 2) & (F.size(parts) % 2 == 0) & (left == right),
        F.array_join(left, " "),
    ).otherwise(col)


def strip_backticks(col: Column) -> Column:
    value = strip(col)
    return F.when(
        value.startswith("`") & value.endswith("`"),
        value.substr(F.lit(2), F.greatest(F.length(value) - 2, F.lit(0))),
    ).otherwise(value)


def combine_errors(*parts: Column) -> Column:
    """Filled error texts joined by `` | ``, at most 500 characters."""
    joined = F.concat_ws(" | ", *[blank_to_null(p) for p in parts])
    return F.coalesce(
        F.substring(blank_to_null(joined), 1, 500), F.lit("Unknown fetch error")
    )

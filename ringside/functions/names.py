"""Name columns: tokens, last names and the pairwise name score."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ringside.functions.text import slug_ascii, words


def tokens_of_slug(slug: Column) -> Column:
    return F.split(slug, "-")


def last_of_slug(slug: Column) -> Column:
    return F.substring_index(slug, "-", -1)


def name_tokens(name: Column) -> Column:
    return tokens_of_slug(slug_ascii(name))


def last_token(tokens: Column) -> Column:
    return F.try_element_at(tokens, F.lit(-1))


def signal_tokens(name: Column) -> Column:
    """Whole lower-cased name plus its parts of four letters or more."""
    lowered = F.lower(name)
    parts = words(F.translate(lowered, ".-'", "   "))
    return F.array_distinct(
        F.concat(F.array(lowered), F.filter(parts, lambda p: F.length(p) >= 4))
    )


def name_score(slug_a: Column, slug_b: Column) -> Column:
    """10 same slug; same last name 8 or 4; shared tokens 5 or 1; else 0."""
    shared = F.size(F.array_intersect(tokens_of_slug(slug_a), tokens_of_slug(slug_b)))
    same_last = last_of_slug(slug_a) == last_of_slug(slug_b)
    return score_of_parts(slug_a == slug_b, same_last, shared)


def score_of_parts(same: Column, same_last: Column, shared: Column) -> Column:
    """The name score from what two slugs have in common."""
    by_tokens = F.when(same_last, F.when(shared >= 2, 8).otherwise(4)).otherwise(
        F.when(shared >= 2, 5).otherwise(shared)
    )
    return F.when(same, 10).otherwise(by_tokens)

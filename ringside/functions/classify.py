"""Classifiers over fixed keyword lists, as plain column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ringside.functions.text import bind, blank_to_null, drop_repeated_phrase, strip
from ringside.registry import EXPLICIT_TAGS, PROJECTS

# Headline classes with their keywords, in the order they apply.
HEADLINE_GROUPS = (
    ("injury", ("injury", "injured", "surgery", "hospital", "consciousness", "recovery", "recover")),
    ("weight", ("weight", "weight cut", "miss weight", "move up", "move down", "flyweight",
                "bantamweight", "featherweight", "lightweight", "welterweight", "middleweight",
                "heavyweight")),
    ("replacement", ("short notice", "replacement", "withdraw", "withdraws", "pullout", "steps in",
                     "new opponent")),
    ("camp", ("camp", "team", "coach")),
    ("layoff", ("returns", "return", "back after", "comeback", "layoff")),
)

# Promotions known by the start of an event name.
PROMOTIONS = ("UFC", "DWCS", "LFA", "PFL", "Bellator")

# Result codes and their markers.
RESULT_MARKERS = {"W": "🟩 W", "L": "🟥 L", "D": "🟨 D", "NC": "⬜ NC"}

# Weight-class names and their English forms.
WEIGHT_CLASSES = {
    "Полулегкий вес": "Featherweight",
    "Легчайший вес": "Bantamweight",
    "Наилегчайший вес": "Flyweight",
    "Легкий вес": "Lightweight",
    "Полусредний вес": "Welterweight",
    "Средний вес": "Middleweight",
    "Полутяжелый вес": "Light Heavyweight",
    "Тяжелый вес": "Heavyweight",
    "Женский минимальный вес": "Women's Strawweight",
    "Женский наилегчайший вес": "Women's Flyweight",
    "Женский легчайший вес": "Women's Bantamweight",
}

# Fixed value.
TAG_PATTERN = r"(?:проект|раздел|категория)\s*:\s*([a-z0-9\-_а-я]+)"


def contains_any(text: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def headline_class(title: Column) -> Column:
    """First headline class with a keyword in the title, else NULL."""

    def choose(lowered: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for label, needles in HEADLINE_GROUPS:
            out = out.when(contains_any(lowered, needles), label)
        return out

    return bind(F.lower(title), choose)


def explicit_project(lowered: Column) -> Column:
    """Key named by a ``project: x`` tag, aliases resolved, else NULL."""
    value = F.nullif(F.regexp_extract(lowered, TAG_PATTERN, 1), F.lit(""))
    return F.coalesce(F.try_element_at(literal_map(EXPLICIT_TAGS), value), value)


def keyword_scores(text: Column) -> Column:
    """Number of distinct keywords of each project in the text, registry order."""
    lists = F.array(*[F.array(*[F.lit(k) for k in p.keywords]).cast("array<string>") for p in PROJECTS])
    return F.transform(lists, lambda keys: F.size(F.filter(keys, lambda k: F.contains(text, k))))


def classify_project(text: Column) -> Column:
    """Struct of project key and how it was found: explicit, keywords, fallback.

    The text is lowered and scored once per row; ties go to registry order.
    """
    keys = F.array(*[F.lit(p.key) for p in PROJECTS])

    def decide(row: Column) -> Column:
        best = F.array_max(row["scores"])
        known = F.array_contains(keys, F.coalesce(row["tag"], F.lit("")))
        by_words = F.element_at(keys, F.array_position(row["scores"], best).cast("int"))
        return F.struct(
            F.when(known, row["tag"]).when(best > 0, by_words).otherwise("shared").alias("project_key"),
            F.when(known, "explicit").when(best > 0, "keywords").otherwise("fallback").alias("how"),
        )

    def measure(lowered: Column) -> Column:
        return F.struct(
            explicit_project(lowered).alias("tag"), keyword_scores(lowered).alias("scores")
        )

    return bind(bind(F.lower(text), measure), decide)


def method_bucket(method: Column) -> Column:
    m = F.lower(F.coalesce(method, F.lit("")))
    return (
        F.when(m.contains("ko"), "KO/TKO")
        .when(m.contains("submission") | m.startswith("sub"), "Submission")
        .when(m.contains("decision") | (m == "draw"), "Decision")
        .otherwise("Other")
    )


def promotion(event_name: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for prefix in PROMOTIONS:
        out = out.when(event_name.startswith(prefix), prefix)
    return out.otherwise(F.substring_index(event_name, ":", 1))


def result_marker(result: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(RESULT_MARKERS), result), result)


def segment_label(segment: Column, pos: Column) -> Column:
    """Card-segment label; ``pos`` counts from 0 inside the segment."""
    lowered = F.lower(segment)
    return (
        F.when(lowered.contains("main") & (pos == 0), "Main Event")
        .when(lowered.contains("main") & (pos == 1), "Co-Main")
        .when(lowered.contains("main"), "Main Card")
        .when(lowered.contains("prelim"), "Prelim")
        .otherwise(segment)
    )


def rounds_label(segment_code: Column, pos: Column) -> Column:
    return F.when((segment_code == "main") & (pos == 0), "5 x 5").otherwise("3 x 5")


def weight_class_key(value: Column) -> Column:
    return F.substring_index(strip(F.lower(value)), " - ", 1)


def translate_weight_class(raw: Column) -> Column:
    value = strip(F.regexp_replace(strip(raw), "^-+|-+$", ""))
    value = drop_repeated_phrase(value)
    value = F.when(value.endswith(" Bout"), strip(F.regexp_replace(value, " Bout$", ""))).otherwise(value)
    return F.coalesce(F.try_element_at(literal_map(WEIGHT_CLASSES), value), blank_to_null(value))

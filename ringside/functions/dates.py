"""Date columns: tolerant parsing, year inference and weekend arithmetic.

Everything works on local dates and times, so no result depends on the
session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ISO_PATTERN = (
    r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2})?)(?:\.\d{1,6})?"
    r"(Z|[+-]\d{2}:\d{2})?)?$"
)

# Month abbreviations in calendar order.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def iso_date(value: Column) -> Column:
    """Date part of an ISO text, no shift for its zone; NULL when malformed."""
    return F.try_to_date(blank(F.regexp_extract(value, ISO_PATTERN, 1)), "yyyy-MM-dd")


def blank(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def iso_utc(value: Column) -> Column:
    """UTC time of an ISO text; a text without a zone is taken as UTC."""
    clock = F.coalesce(blank(F.regexp_extract(value, ISO_PATTERN, 2)), F.lit("00:00"))
    clock = F.when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
    day = blank(F.regexp_extract(value, ISO_PATTERN, 1))
    local = F.concat(day, F.lit(" "), clock).try_cast("timestamp_ntz")
    zone = F.regexp_extract(value, ISO_PATTERN, 3)
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    minutes = F.when(
        zone.rlike(r"^[+-]"),
        sign * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")),
    ).otherwise(0)
    return local - F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def first_ten(value: Column, today: Column) -> Column:
    return F.coalesce(F.substring(blank(value), 1, 10), today)


def infer_year(raw: Column, reference: Column) -> Column:
    """Date for ``Mon D``: this year, or the next when over 180 days past."""
    parts = F.split(F.trim(F.regexp_replace(F.replace(raw, F.lit(","), F.lit("")), r"\s+", " ")), " ")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.try_element_at(parts, F.lit(1)))
    day = F.try_element_at(parts, F.lit(2)).try_cast("int")

    def on(year: Column) -> Column:
        text = F.format_string("%04d-%02d-%02d", year, month, day)
        return F.when((month > 0) & day.between(1, 31), F.try_to_date(text, "yyyy-MM-dd"))

    this_year = on(F.year(reference))
    return F.when(
        this_year < F.date_sub(reference, 180), on(F.year(reference) + 1)
    ).otherwise(this_year)


def next_saturday(reference: Column) -> Column:
    """The day itself on a Saturday; six days ahead on a Sunday."""
    return F.next_day(F.date_sub(reference, 1), "SAT")


def in_next_weekend(day: Column, reference: Column) -> Column:
    saturday = next_saturday(reference)
    return day.between(saturday, F.date_add(saturday, 1))


def run_mode(day: Column) -> Column:
    weekday = F.weekday(day)
    return (
        F.when(weekday == 3, "baseline")
        .when(weekday.isin(4, 5), "incremental")
        .otherwise("skipped")
    )


def iso_seconds(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")

"""Odds arithmetic. Missing results are NULL; ``n/a`` is a rendering matter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def two_digits(value: Column) -> Column:
    return F.bround(value, 2).cast("decimal(18,2)").cast("string")


def american_to_decimal(line: Column) -> Column:
    value = line.try_cast("int")
    return (
        F.when(value > 0, two_digits(1 + value / 100))
        .when(value < 0, two_digits(1 + F.lit(100) / F.abs(value)))
    )


def probability_to_decimal(raw: Column) -> Column:
    value = raw.try_cast("double")
    return F.when(value > 0, two_digits(F.lit(1.0) / value))


def bucket(value: Column, step: float = 0.05) -> Column:
    """Nearest multiple of ``step``, halves to even, two digits."""
    return two_digits(F.rint(value / step) * step)


def bucket_text(raw: Column, step: float = 0.05) -> Column:
    """Text that is no number stays as it is."""
    value = raw.try_cast("double")
    return F.when(value.isNotNull(), bucket(value, step)).otherwise(raw)


def over_price(markets: Column, question: str) -> Column:
    """Decimal price found at the place of ``Over`` in the first such market."""
    prices = F.transform(
        F.filter(markets, lambda m: m["question"] == F.lit(question)),
        lambda m: F.get(m["prices"], F.array_position(m["outcomes"], "Over").cast("int") - 1),
    )
    return probability_to_decimal(F.get(prices, F.lit(0)))

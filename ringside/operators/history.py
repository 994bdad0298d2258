"""Per-fighter history: records, recent form, gaps and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ringside.functions.classify import method_bucket, promotion
from ringside.functions.text import first_filled
from ringside.operators.topk import first_n, keep_first

BUCKETS = (("KO/TKO", "ko"), ("Submission", "sub"), ("Decision", "dec"), ("Other", "oth"))


def _summary(prefix: str) -> Column:
    return F.concat_ws(
        ", ", *[F.concat_ws(" ", F.col(f"{prefix}_{short}").cast("string"), F.lit(name)) for name, short in BUCKETS]
    )


def record_summary(fights: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """Totals and method breakdown per fighter: one partial aggregate.

    ``published`` has fighter and published; a filled published record wins.
    """
    bucket, result = method_bucket(F.col("method")), F.col("result")
    counts = [
        F.count_if((result == code) & (bucket == name)).alias(f"{word}_{short}")
        for code, word in (("W", "wins"), ("L", "losses"))
        for name, short in BUCKETS
    ]
    totals = fights.groupBy("fighter").agg(
        *[F.count_if(result == code).alias(word) for code, word in (("W", "wins"), ("L", "losses"), ("D", "draws"))],
        *counts,
    )
    if published is None:
        totals = totals.withColumn("published", F.lit(None).cast("string"))
    else:
        totals = totals.join(published, "fighter", "left")
    computed = F.concat_ws("-", *[F.col(w).cast("string") for w in ("wins", "losses", "draws")])
    return totals.select(
        "fighter", "wins", "losses", "draws", "losses_sub",
        first_filled(F.col("published"), computed).alias("record_summary"),
        _summary("wins").alias("wins_summary"),
        _summary("losses").alias("losses_summary"),
    )


def recent_form(last_five: DataFrame) -> DataFrame:
    """Counts over at most five rows per fighter."""
    won, method = F.col("result") == "W", F.col("method")
    finish = method.isin("KO/TKO", "TKO") | method.contains("Submission")
    return last_five.groupBy("fighter").agg(
        F.count_if(won).alias("recent_wins"),
        F.count_if(won & finish).alias("finish_wins"),
        F.count_if(promotion(F.col("event_name")) == "UFC").alias("ufc_fights"),
        F.count(F.lit(1)).alias("recent_fights"),
        F.max("fight_date").alias("last_fight"),
    )


def form_label(wins: Column, finishes: Column, submission_losses: Column) -> Column:
    return (
        F.when((wins >= 4) & (finishes >= 3), "strong_finisher")
        .when(wins >= 4, "strong")
        .when(wins <= 2, "unstable")
        .when(submission_losses == 0, "no_submission_losses")
        .otherwise("mixed")
    )


def pair_edge(a_wins: Column, b_wins: Column) -> Column:
    a, b = F.coalesce(a_wins, F.lit(0)), F.coalesce(b_wins, F.lit(0))
    return F.when(a > b, "A").when(b > a, "B").otherwise("none")


def gap_signal(days: Column, layoff: int = 240, turnaround: int = 49) -> Column:
    return F.when(days >= layoff, "layoff").when(
        (days > 0) & (days <= turnaround), "short_turnaround"
    )


def capped_signals(fighters: DataFrame, candidates: DataFrame, cap: int = 3) -> DataFrame:
    """First ``cap`` distinct signals per fighter in rule order, or a placeholder.

    ``candidates`` has fighter, rule_ord, signal_type and summary.
    """
    unique = keep_first(candidates, ["fighter", "signal_type", "summary"], ["rule_ord"])
    kept = first_n(unique, ["fighter"], ["rule_ord"], cap, "pos")
    return fighters.select("fighter").join(kept, "fighter", "left").select(
        "fighter",
        F.coalesce("pos", F.lit(1)).alias("pos"),
        F.coalesce("signal_type", F.lit("none")).alias("signal_type"),
        F.coalesce("summary", F.lit("none found")).alias("summary"),
    )

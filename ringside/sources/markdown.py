"""Reading report documents back into rows, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ringside.functions.html import LINE_BREAK
from ringside.functions.text import slug_ascii, strip, strip_backticks

FINAL = "## Финальные замечания"
BOUT_NOTE = "Комментарий по бою:"


def between(text: Column, start, end=None) -> Column:
    """Text after the first ``start`` up to the next ``end``, stripped."""
    start = start if isinstance(start, Column) else F.lit(start)
    at = F.position(start, text)
    begin = at + F.length(start)
    if end is None:
        found = F.substr(text, begin)
    else:
        end = end if isinstance(end, Column) else F.lit(end)
        stop = F.position(end, text, begin)
        found = F.when(stop > 0, F.substr(text, begin, stop - begin))
    return strip(F.when(at > 0, found))


def text_lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def keyed(block: Column, key) -> Column:
    """Value of the bullet ``- key: value`` without its backticks."""
    key = key if isinstance(key, Column) else F.lit(key)
    line = F.get(
        F.filter(
            text_lines(block),
            lambda x: x.startswith(F.concat(F.lit("- "), key, F.lit(": ")))
            | x.startswith(F.concat(F.lit("- `"), key, F.lit("`: "))),
        ),
        F.lit(0),
    )
    return strip_backticks(F.regexp_extract(line, r"^- [^:]+: (.+)$", 1))


def nested(block: Column, key: str) -> Column:
    """Indented bullets right below ``- key:``."""
    body = F.regexp_extract(block, rf"(?m)^- {key}:\n((?:  - .*\n?)*)", 1)
    return F.transform(
        F.filter(text_lines(body), lambda x: x.startswith("  - ")),
        lambda x: strip(F.substr(x, F.lit(5))),
    )


def plain_bullets(block: Column) -> Column:
    return F.transform(
        F.filter(text_lines(block), lambda x: x.startswith("- ")),
        lambda x: strip(F.substr(x, F.lit(3))),
    )


def quality_label(notes: Column) -> Column:
    """First quoted label in note order, else ``partial``."""
    found = F.transform(notes, lambda n: F.regexp_extract(n, "`(good|partial|weak)`", 1))
    return F.coalesce(F.get(F.filter(found, lambda x: x != ""), F.lit(0)), F.lit("partial"))


def parse_events(docs: DataFrame, key: str, body: str = "body") -> DataFrame:
    """One row per document: the event fields."""
    text = F.col(body)
    title = F.regexp_extract(text, r"(?m)^# (.*)$", 1)
    place = between(text, "## Турнир", "## Качество данных")
    quality = between(text, "## Качество данных", "## Легенда")
    notes = F.filter(
        plain_bullets(quality), lambda n: ~n.rlike("^(Формат отчёта|Язык|Odds format):")
    )
    final = F.when(F.contains(text, F.lit(FINAL)), between(text, FINAL))
    return docs.select(
        key,
        F.coalesce(F.nullif(keyed(place, "Турнир"), F.lit("")), F.substring_index(title, " — ", 1)).alias("event_name"),
        F.when(title.contains(" — "), F.regexp_extract(title, r"^.*? — (.*)$", 1))
        .otherwise("Stage 2 Report").alias("title_suffix"),
        keyed(place, "Дата").alias("event_date"),
        keyed(place, "Арена").alias("venue"),
        keyed(place, "Промоушен").alias("promotion"),
        keyed(place, "Формат трансляции").alias("broadcast"),
        keyed(place, "Подтверждённых боёв").alias("confirmed"),
        nested(place, "Основные источники").alias("sources"),
        keyed(quality, "Формат отчёта").alias("report_format"),
        keyed(quality, "Язык").alias("language"),
        keyed(quality, "Odds format").alias("odds_format"),
        notes.alias("quality_notes"),
        quality_label(notes).alias("quality_label"),
        F.coalesce(plain_bullets(final), F.array().cast("array<string>")).alias("final_notes"),
    )


def parse_bouts(docs: DataFrame, key: str, body: str = "body") -> DataFrame:
    """One row per bout with the text block of each side."""
    text = F.col(body)
    section = F.when(F.contains(text, F.lit(FINAL)), between(text, "## Бои", FINAL)).otherwise(
        between(text, "## Бои")
    )
    blocks = F.filter(F.transform(F.split(section, r"(?m)^### "), strip), lambda b: b != "")
    title = F.substring_index("block", "\n", 1)
    rows = docs.select(key, F.posexplode(blocks).alias("pos", "block")).select(
        key, "pos", "block",
        strip(F.substring_index(title, " vs. ", 1)).alias("a_name"),
        strip(F.regexp_extract(title, r"^.*? vs\. (.*)$", 1)).alias("b_name"),
    )
    block = F.col("block")
    a_mark = F.concat(F.lit("#### "), F.col("a_name"))
    b_mark = F.concat(F.lit("#### "), F.col("b_name"))
    odds = between(block, "#### Линии", a_mark)
    meta = r"(?m)^`([^`]+)` \| `([^`]+)` \| `([^`]+)`$"
    return rows.select(
        key, "pos", "a_name", "b_name",
        slug_ascii(title).alias("bout_id"),
        *[F.regexp_extract(block, meta, i + 1).alias(n) for i, n in enumerate(("weight_class", "card_segment", "status"))],
        keyed(odds, F.col("a_name")).alias("a_price"),
        keyed(odds, F.col("b_name")).alias("b_price"),
        keyed(odds, "ТБ 1.5").alias("over_1_5"),
        keyed(odds, "ТБ 2.5").alias("over_2_5"),
        between(block, a_mark, b_mark).alias("a_block"),
        between(block, b_mark, BOUT_NOTE).alias("b_block"),
        F.array_join(plain_bullets(between(block, BOUT_NOTE)), " ").alias("commentary"),
    )


def parse_fighters(bouts: DataFrame, key: str) -> DataFrame:
    """Two rows per bout: the fields of each side."""
    sides = F.array(
        *[F.struct(F.lit(s).alias("side"), F.col(f"{s}_name").alias("name"), F.col(f"{s}_block").alias("block")) for s in "ab"]
    )
    block = F.col("block")
    signals = plain_bullets(between(block, "Предбоевые сигналы:"))
    said = F.filter(signals, lambda x: ~x.startswith("Источник:"))
    origin = F.transform(
        F.filter(signals, lambda x: x.startswith("Источник:")),
        lambda x: strip(F.regexp_replace(x, "^Источник:", "")),
    )
    summary = F.array_join(said, " ")
    return bouts.select(key, "pos", F.inline(sides)).select(
        key, "pos", "side", "name", "block",
        keyed(block, "Рекорд").alias("record_summary"),
        keyed(block, "Победы по методам").alias("wins_summary"),
        keyed(block, "Поражения по методам").alias("losses_summary"),
        nested(block, "Источники").alias("sources"),
        F.array_join(plain_bullets(between(block, "Короткий комментарий:", "Предбоевые сигналы:")), " ").alias("commentary"),
        summary.alias("signal_summary"),
        F.coalesce(F.try_element_at(origin, F.lit(-1)), F.lit("n/a")).alias("signal_source"),
        F.when(F.contains(F.lower(summary), F.lit("не найдено")), "none").otherwise("context").alias("signal_type"),
    )


FIGHT_FIELDS = ("fight_date", "opponent", "result", "method", "round", "promotion", "event_name")


def parse_fights(fighters: DataFrame, key: str) -> DataFrame:
    """Rows of the seven-cell table, with their position from 0."""
    table = between(F.col("block"), "Последние 5:", "Короткий комментарий:")
    rows = F.filter(text_lines(table), lambda x: x.startswith("|") & ~x.startswith("| ---"))
    cells = F.transform(
        rows,
        lambda r: F.transform(F.split(F.regexp_replace(strip(r), r"^\|+|\|+$", ""), r"\|"), strip),
    )
    kept = F.filter(cells, lambda x: (F.size(x) == 7) & ((x[0] != "Дата") | (x[1] != "Соперник")))
    return fighters.select(key, "pos", "side", "name", F.posexplode(kept).alias("fight_pos", "x")).select(
        key, "pos", "side", "name", "fight_pos",
        *[F.col("x")[i].alias(n) for i, n in enumerate(FIGHT_FIELDS)],
    )

"""Documents in ordered parts.

A document is a set of rows (key, part_no, body); its text is the bodies in
order. Every part has a bounded size (one bout, or at most a fixed number of
comment lines), so no document has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ringside.functions import render
from ringside.functions.text import first_filled, strip
from ringside.operators.topk import first_n

LINES_PER_PART = 1_000
NO_COMMENTS = "- комментариев пока нет"


def record_parts(records: DataFrame, comments: DataFrame, lines_per_part: int = LINES_PER_PART) -> DataFrame:
    """Idea and context documents; long comment lists continue in more parts.

    ``comments`` has record_id, turn (unique per record), author, text and
    created as text.
    """
    idea = F.col("entity_type") == "idea"
    counts = comments.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_comments"))
    heads = records.join(counts, "record_id", "left")
    closing = F.when(F.col("n_comments").isNull(), f"\n{NO_COMMENTS}\n").otherwise("\n")
    first = heads.select(
        "record_id", F.lit(0).cast("bigint").alias("part_no"),
        F.when(idea, F.concat(render.idea_head(), closing)).otherwise(render.context_document()).alias("body"),
    )
    line = render.comment_line(F.col("created"), F.col("author"), F.col("text"))
    rest = (
        comments.join(records.filter(idea).select("record_id"), "record_id", "left_semi")
        .withColumn("part_no", F.floor(F.col("turn") / lines_per_part) + 1)
        .groupBy("record_id", "part_no")
        .agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("rows"))
        .select("record_id", "part_no", F.concat(F.array_join(F.col("rows.line"), "\n"), F.lit("\n")).alias("body"))
    )
    return first.unionByName(rest)


def fighter_lines(last_five: DataFrame, signals: DataFrame) -> DataFrame:
    """Table lines (five at most) and signal lines (three at most) per fighter."""
    cells = [F.col(n).cast("string") for n in
             ("fight_date", "opponent", "result", "method", "round", "promotion", "event_name")]
    fights = first_n(last_five, ["fighter"], ["pos"], 5).groupBy("fighter").agg(
        F.array_sort(F.collect_list(F.struct("pos", render.table_row(*cells).alias("line")))).alias("f")
    )
    said = render.lines(
        render.text_of("- ", F.col("summary")), render.text_of("- Источник: ", F.col("source"))
    )
    notes = first_n(signals, ["fighter"], ["pos"], 3).groupBy("fighter").agg(
        F.array_sort(F.collect_list(F.struct("pos", said.alias("line")))).alias("s")
    )
    return fights.join(notes, "fighter", "full_outer").select(
        "fighter", F.col("f.line").alias("fight_lines"), F.col("s.line").alias("signal_lines")
    )


def report_parts(cards: DataFrame, bouts: DataFrame, fighters: DataFrame) -> DataFrame:
    """Event reports: a head, one part per bout, and the closing notes.

    Part texts are joined by line breaks. ``cards`` has first_pos and the
    event fields; ``bouts`` has a_fighter and b_fighter; ``fighters`` has one
    row per fighter with statistics and lines.
    """
    head = cards.select("card", F.lit(0).cast("bigint").alias("part_no"), render.event_head(F.col).alias("body"))
    tail = cards.select(
        "card", F.lit(1_000_000_000).cast("bigint").alias("part_no"),
        render.event_tail(F.col("final_notes")).alias("body"),
    ).filter(F.col("body").isNotNull())

    def role(mark: str) -> DataFrame:
        return fighters.select(F.col("fighter").alias(f"{mark}_fighter"), F.struct(
            *[c for c in fighters.columns if c != "fighter"]).alias(mark))

    def block(mark: str) -> Column:
        def value(name: str) -> Column:
            return F.col(f"{mark}_name") if name == "name" else F.col(f"{mark}.{name}")
        # A side without a fighter has no block at all.
        return F.when(F.col(mark).isNotNull(), render.fighter_block(value))

    joined = (
        bouts.join(role("a"), "a_fighter", "left").join(role("b"), "b_fighter", "left")
        .join(cards.select("card", "first_pos"), "card")
    )
    rule = F.when(F.col("pos") == F.col("first_pos"), "").otherwise("\n---\n\n")
    body = F.concat(rule, render.bout_block(F.col, block("a"), block("b")))
    middle = joined.select("card", (F.col("pos") + 1).cast("bigint").alias("part_no"), body.alias("body"))
    return head.unionByName(middle).unionByName(tail)


def context_pack(files: DataFrame, keys: list[str], first_limit: int = 2_500, limit: int = 2_000) -> DataFrame:
    """Readme first, then the named files in order, each cut to its limit.

    ``files`` has the keys, ord (0 for the readme, up to 4), name and body, one
    row per key and ord.
    """
    cut = F.when(
        F.col("ord") == 0, render.text_of("# Project README\n", F.substring("body", 1, first_limit))
    ).otherwise(render.text_of("# Inbox Context: ", F.col("name"), "\n", F.substring("body", 1, limit)))
    return (
        files.filter(F.col("ord").between(0, 4)).groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("ord", cut.alias("chunk")))).alias("c"))
        .select(*keys, F.array_join(F.col("c.chunk"), "\n\n").alias("pack"))
    )


def pack_for_reader(pack: Column, limit: int = 5_000) -> Column:
    """A reader takes the beginning of a pack only: a feature, not a bound of ours."""
    return F.substring(pack, 1, limit)


def append_manual_text(records: DataFrame, texts: DataFrame) -> DataFrame:
    """Add a manual text to each matched record and mark it as resolved."""
    note = F.col("manual_text")
    joined = records.join(texts, "record_id", "left")
    hit = note.isNotNull()

    def changed(new: Column, old: str) -> Column:
        return F.when(hit, new).otherwise(F.col(old)).alias(old)

    kept = [c for c in records.columns if c not in ("raw_input", "normalized_text", "extracted_content", "link_fetch_status")]
    return joined.select(
        *kept,
        changed(strip(render.text_of(F.col("raw_input"), "\n\n[manual_text]\n", note)), "raw_input"),
        changed(strip(render.text_of(F.col("normalized_text"), "\n\n", note)), "normalized_text"),
        changed(note, "extracted_content"),
        changed(F.lit("manual_text_added"), "link_fetch_status"),
    )


def derive_ideas(contexts: DataFrame, new_id: Column) -> DataFrame:
    """New ideas from context records: fields copied, fresh id, new source type."""
    return contexts.select(
        new_id.alias("id"), F.col("record_id").alias("derived_from"), "project_key",
        F.lit("idea").alias("entity_type"), F.lit("context-derived").alias("source_type"), "raw_input",
        first_filled(F.col("normalized_text"), F.col("raw_input")).alias("normalized_text"),
        "source_url", "extracted_content", "link_fetch_status", "link_fetch_error",
    )

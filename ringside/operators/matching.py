"""Fuzzy matching of name pairs across sources.

Two name pairs match when the better orientation scores 8 or more. That is so
exactly when one name pair shares its slug, or its last name and one more
token, or when both name pairs share a last name or two tokens. Each case is
an equality on a key built row by row, so candidates come from one equi-join
that emits scoring pairs only. Rows with equal names are one *kind*: keys,
joins and scores are worked out per kind, never per copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ringside.functions.names import last_of_slug, name_score, score_of_parts, tokens_of_slug
from ringside.functions.text import bind, slug_ascii
from ringside.operators.ordered import Running, running
from ringside.operators.topk import first_n, keep_first
from ringside.session import cut_lineage, scratch_path

THRESHOLD = 8
#: Left rows plus links that one task walks at a time. It sizes the steps and decides nothing else.
BATCH = 50_000
#: Kinds of a side up to which a group is scored pair by pair. It chooses between two ways to the same pairs.
SMALL = 64


def _tokens(slug: Column) -> Column:
    return F.array_distinct(tokens_of_slug(slug))


def strong_keys(slug: Column) -> Column:
    """Keys two names share iff their score is 8 or 10."""
    last = last_of_slug(slug)
    rest = F.transform(
        F.array_remove(_tokens(slug), last), lambda t: F.concat(F.lit("+"), last, F.lit("/"), t)
    )
    return F.array_append(rest, F.concat(F.lit("="), slug))


def weak_keys(slug: Column) -> Column:
    """Keys two names share iff their score is 4 or more."""

    def pairs(tokens: Column) -> Column:
        return F.flatten(
            F.transform(
                tokens,
                lambda t, i: F.transform(
                    F.slice(tokens, i + 2, F.size(tokens)), lambda u: F.concat(t, F.lit("/"), u)
                ),
            )
        )

    return F.array_append(
        bind(F.array_sort(_tokens(slug)), pairs), F.concat(F.lit("."), last_of_slug(slug))
    )


def _crossed(left: Column, right: Column) -> Column:
    return bind(
        F.struct(left.alias("l"), right.alias("r")),
        lambda s: F.flatten(
            F.transform(s["l"], lambda a: F.transform(s["r"], lambda b: F.concat(a, F.lit("&"), b)))
        ),
    )


def _pair_keys(slug_a: Column, slug_b: Column, both_ways: bool) -> Column:
    keys = [strong_keys(slug_a), strong_keys(slug_b), _crossed(weak_keys(slug_a), weak_keys(slug_b))]
    if both_ways:
        keys.append(_crossed(weak_keys(slug_b), weak_keys(slug_a)))
    return F.array_distinct(F.concat(*keys))


def _with_slugs(df: DataFrame, group: str, pos: str, a: str, b: str) -> DataFrame:
    return df.select(
        group,
        F.col(pos).cast("bigint").alias(pos),
        slug_ascii(F.col("a_name")).alias(a),
        slug_ascii(F.col("b_name")).alias(b),
    )


def score_kinds(left_kinds: DataFrame, right_kinds: DataFrame, group: str) -> DataFrame:
    """Scoring pairs of kinds: (group, la, lb) against (group, ra, rb).

    Keys cost a name pair a few hundred rows. A group with at most ``SMALL`` kinds on either side, as
    cards are, is therefore scored pair by pair; both ways find the same pairs.
    """
    la, lb, ra, rb = (F.col(c) for c in ("la", "lb", "ra", "rb"))
    left_kinds = left_kinds.filter(la.isNotNull() & lb.isNotNull())
    right_kinds = right_kinds.filter(ra.isNotNull() & rb.isNotNull())
    sizes = left_kinds.groupBy(group).agg(F.count(F.lit(1)).alias("nl")).join(
        right_kinds.groupBy(group).agg(F.count(F.lit(1)).alias("nr")), group
    ).select(group, (F.greatest("nl", "nr") <= SMALL).alias("small"))
    lefts, rights = left_kinds.join(sizes, group), right_kinds.join(sizes, group)
    small = F.col("small")
    paired = lefts.filter(small).drop("small").join(rights.filter(small).drop("small"), group)

    def keyed(kinds: DataFrame, keys: Column) -> DataFrame:
        # Names that meet on equal hashes of different keys fall to the score.
        rows = kinds.filter(~small).drop("small").withColumn("k", F.explode(keys))
        return rows.withColumn("k", F.xxhash64("k"))

    # Sizes are guessed before keys are exploded, so the join is told not to broadcast them.
    met = (
        keyed(lefts, _pair_keys(la, lb, True))
        .join(keyed(rights, _pair_keys(ra, rb, False)).hint("merge"), [group, "k"])
        .drop("k")
        .dropDuplicates([group, "la", "lb", "ra", "rb"])
    )
    direct = name_score(ra, la) + name_score(rb, lb)
    reverse = name_score(ra, lb) + name_score(rb, la)
    return (
        paired.unionByName(met)
        .withColumn("score", F.greatest(direct, reverse))
        .withColumn("orientation", F.when(direct >= reverse, "direct").otherwise("reverse"))
        .filter(F.col("score") >= THRESHOLD)
    )


def greedy_one_to_one(
    left: DataFrame, right: DataFrame, group: str, batch: int = BATCH, chunks: int | None = None
) -> DataFrame:
    """Left rows in order each take their best unused right row of the group.

    ``left`` has group, left_pos, a_name, b_name; ``right`` the same with
    right_pos; positions are unique inside a group. The best row is the one
    with the highest score, then the lowest position. Returns group, both
    positions, score and orientation.

    Rows of one right kind are always taken in their order, so what a left row
    chooses from is the next free row of each kind it scores with. Left rows
    are dealt into turns of about ``batch`` rows and links; in a turn every
    group walks its left rows in one task, which gets their links and, of each
    right kind, no more rows than the turn can ask for. A group that fits one
    turn, as cards do, is done in one; a longer one takes as many turns as it
    has batches.
    """
    lefts = _with_slugs(left, group, "left_pos", "la", "lb")
    rights = _with_slugs(right, group, "right_pos", "ra", "rb")
    lk, rk = [group, "la", "lb"], [group, "ra", "rb"]
    kinds = cut_lineage(score_kinds(lefts.select(*lk).distinct(), rights.select(*rk).distinct(), group))

    degrees = kinds.groupBy(*lk).agg(F.least(F.count(F.lit(1)) + 1, F.lit(batch)).alias("weight"))
    before = {"upto": Running("sum", F.col("weight"))}
    turns = running(lefts.join(degrees, lk), [group], ["left_pos"], before, chunks).withColumn(
        "turn", F.floor((F.col("upto") - 1) / batch)
    )
    queue = cut_lineage(turns.select(*lk, "left_pos", "turn"))
    ranked = {"k": Running("sum", F.lit(1))}
    rights = cut_lineage(
        running(rights.join(kinds.select(*rk).distinct(), rk), rk, ["right_pos"], ranked, chunks)
        .select(*rk, "right_pos", "k")
    )

    last = queue.agg(F.max("turn")).first()[0]
    spark = kinds.sparkSession
    path = scratch_path(spark, "greedy")
    used = None
    for turn in range((last or 0) + 1):
        picks = _one_turn(queue.filter(F.col("turn") == turn), rights, kinds, used, group, batch)
        picks.write.parquet(f"{path}/turn={turn}")
        if turn == last:
            break
        taken = spark.read.schema(picks.schema).parquet(f"{path}/turn={turn}").groupBy(*rk).agg(
            F.count(F.lit(1)).alias("used")
        )
        both = taken if used is None else used.unionByName(taken)
        used = cut_lineage(both.groupBy(*rk).agg(F.sum("used").alias("used")))
    return spark.read.schema(picks.schema).parquet(path).select(
        group, "left_pos", "right_pos", "score", "orientation"
    )


def _one_turn(
    lefts: DataFrame, rights: DataFrame, kinds: DataFrame, used: DataFrame | None, group: str, batch: int
) -> DataFrame:
    """Picks of one turn, all groups side by side."""
    lk, rk = [group, "la", "lb"], [group, "ra", "rb"]
    if used is None:
        free = rights.withColumn("used", F.lit(0))
    else:
        free = rights.join(used, rk, "left").withColumn("used", F.coalesce("used", F.lit(0)))
    free = free.filter(F.col("k") > F.col("used"))
    heads = free.filter(F.col("k") == F.col("used") + 1).select(*rk, F.col("right_pos").alias("head"))
    asking = lefts.groupBy(*lk).agg(F.count(F.lit(1)).alias("n"))
    # A turn has at most ``batch`` left rows, so of the kinds a left kind scores with it can be
    # turned away from all but one of the best ``batch``; what comes after those is never reached.
    links = first_n(
        kinds.join(asking, lk).join(heads, rk), lk, [F.col("score").desc(), "head"], batch
    )
    need = links.groupBy(*rk).agg(F.sum("n").alias("need"))
    offered = free.join(need, rk).filter(F.col("k") <= F.col("used") + F.col("need"))

    def rows(df: DataFrame, what: str, **given: str) -> DataFrame:
        empty = {"la": "string", "lb": "string", "ra": "string", "rb": "string", "pos": "bigint",
                 "score": "int", "orientation": "string"}
        cols = [
            F.col(given.get(c, c)).cast(t).alias(c) if given.get(c, c) in df.columns else F.lit(None).cast(t).alias(c)
            for c, t in empty.items()
        ]
        return df.select(group, F.lit(what).alias("what"), *cols)

    both = rows(lefts, "left", pos="left_pos").unionByName(rows(offered, "right", pos="right_pos")).unionByName(
        rows(links, "link")
    )
    group_type = both.schema[group].dataType.simpleString()
    return both.repartition(group).sortWithinPartitions(group).mapInArrow(
        lambda batches: _walk(batches, group),
        f"`{group}` {group_type}, ra string, rb string, left_pos bigint, right_pos bigint, score int, orientation string",
    )


def _walk(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[pa.RecordBatch]:
    """Serve the left rows of each group in order; rows come sorted by group, one group is held at a time."""
    names = ("ra", "rb", "left_pos", "right_pos", "score", "orientation")
    types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    current, held, first_type = None, [], None

    def packed(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * 7
        arrays = [pa.array(values, t) for values, t in zip(columns, (first_type, *types))]
        return pa.RecordBatch.from_arrays(arrays, [group, *names])

    for batch in batches:
        first_type = batch.schema.field(group).type
        done = []
        columns = (group, "what", "la", "lb", "ra", "rb", "pos", "score", "orientation")
        for key, *row in zip(*[batch.column(c).to_pylist() for c in columns]):
            if held and key != current:
                done.extend((current, *pick) for pick in _serve(held))
                held = []
            current = key
            held.append(row)
        if done:
            yield packed(done)
    if held:
        yield packed([(current, *pick) for pick in _serve(held)])


def _serve(rows: list) -> Iterator[tuple]:
    """Picks of one group: each left row takes the best next free row of the kinds it scores with."""
    links, stock, queue = {}, {}, []
    for what, la, lb, ra, rb, pos, score, orientation in rows:
        if what == "left":
            queue.append((pos, (la, lb)))
        elif what == "right":
            stock.setdefault((ra, rb), []).append(pos)
        else:
            links.setdefault((la, lb), []).append(((ra, rb), score, orientation))
    for positions in stock.values():
        positions.sort(reverse=True)
    for left_pos, kind in sorted(queue):
        offers = [(-score, stock[other][-1], other, o) for other, score, o in links.get(kind, ()) if stock.get(other)]
        if offers:
            cost, right_pos, other, orientation = min(offers)
            stock[other].pop()
            yield (*other, left_pos, right_pos, -cost, orientation)


def best_title(bouts: DataFrame, titles: DataFrame, group: str) -> DataFrame:
    """Many-to-one: the title with the highest sum of both name scores, from 8.

    ``titles`` has group, title_pos and title; ties go to the lowest position.
    Equal titles count once, with their lowest position; equal bouts share
    their answer. A score depends only on which words a name shares with a
    title, whether the last words are equal and whether all are, so names and
    titles meet on single words and the score comes from counting them: work
    grows with the number of words of a title, however long it is.
    """
    lefts = _with_slugs(bouts, group, "left_pos", "la", "lb")
    kinds = lefts.select(group, "la", "lb").distinct()
    rights = (
        titles.select(group, slug_ascii(F.col("title")).alias("ts"), "title_pos")
        .groupBy(group, "ts").agg(F.min("title_pos").alias("title_pos"))
    )
    sides = {"a": F.col("la"), "b": F.col("lb")}
    entries = F.concat(*[_entries(slug, side) for side, slug in sides.items()])
    lk = kinds.select("*", F.inline(entries))
    rk = rights.select(group, "title_pos", F.inline(_entries(F.col("ts"), "t"))).drop("side")
    # One name meets one title on a word at most once; the last word and the whole are words of their own.
    met = lk.join(rk, [group, "key"]).groupBy(group, "la", "lb", "title_pos").agg(
        *[
            F.count_if((F.col("side") == side) & F.col("key").startswith(mark)).alias(f"{side}_{name}")
            for side in sides for name, mark in (("words", "+"), ("last", ".") , ("whole", "="))
        ]
    )
    total = sum(
        score_of_parts(F.col(f"{s}_whole") > 0, F.col(f"{s}_last") > 0, F.col(f"{s}_words")) for s in sides
    )
    scored = met.select(group, "la", "lb", "title_pos", total.cast("int").alias("score")).filter(
        F.col("score") >= THRESHOLD
    )
    best = keep_first(
        scored, [group, "la", "lb"], [F.col("score").desc(), F.col("title_pos").asc()]
    )
    return lefts.join(best, [group, "la", "lb"]).select(group, "left_pos", "title_pos", "score")


def _entries(slug: Column, side: str) -> Column:
    """Words, last word and whole slug as marked keys."""
    keys = F.concat(
        F.transform(_tokens(slug), lambda t: F.concat(F.lit("+"), t)),
        F.array(F.concat(F.lit("."), last_of_slug(slug)), F.concat(F.lit("="), slug)),
    )
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(side).alias("side")))

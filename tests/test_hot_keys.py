"""Work cut into many ranges gives what one range gives."""

import random
import re

from pyspark.sql import Window, functions as F

from ringside.functions.names import name_score  # noqa: F401
from ringside.operators import changes, matching
from ringside.operators.matching import best_title, greedy_one_to_one
from ringside.operators.ordered import CHUNK, Running, in_ranges, running
from ringside.plans.adapters import runs, table

c = F.col


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_running_values(spark):
    rng = random.Random(1)
    rows = [
        (rng.choice([1, 1, 1, None, None, 2, 3]), rng.randint(0, 50), i, rng.choice([None, 1, 2, 5]), rng.randint(-5, 5))
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "u int, t int, i int, v int, w int")
    specs = {
        "lag": Running("lag", c("v")), "last": Running("last", c("v")), "before": Running("before", c("v")),
        "sum": Running("sum", c("w")), "min": Running("min", c("w")), "min_before": Running("min_before", c("w")),
    }
    whole = running(df, ["u"], ["t", "i"], specs, chunks=1)
    assert same(whole, running(df, ["u"], ["t", "i"], specs, chunks=9))
    plain = Window.partitionBy("u").orderBy("t", "i")
    expected = df.select("*", F.lag("v").over(plain).alias("lag"), F.sum("w").over(plain.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"))
    assert same(whole.select(*expected.columns), expected)


def test_one_key_with_a_constant_first_column_is_cut(spark):
    df = spark.range(10_000).select(F.lit(1).alias("u"), F.lit(7).alias("t"), c("id").alias("i"), F.lit(1).alias("one"))
    sizes = [r["count"] for r in in_ranges(df, ["u"], ["t", "i"], 8).groupBy(CHUNK).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2_500
    got = running(df, ["u"], ["t", "i"], {"n": Running("sum", c("one"))}, chunks=8)
    assert got.filter(c("n") != c("i") + 1).isEmpty()


def test_equal_times_go_to_the_lowest_id(spark):
    rows = [(1, 5, 10, "open"), (1, 3, 10, "open"), (1, 2, 10, "text"), (1, 9, 11, "text"), (1, 4, 12, "text")]
    df = spark.createDataFrame(rows, "u int, event_id int, s int, role string").withColumn(
        "ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    args = (df, "u", c("role") == "open", c("role") == "text", 60)
    found = {r.text_id: r.open_id for r in changes.newest_within(*args).collect()}
    assert found == {2: 3, 9: 3, 4: 3}
    for chunks in (1, 3):
        taken = {r.text_id: r.open_id for r in changes.consume_within(*args, chunks=chunks).collect()}
        assert taken == {2: 3, 9: 5}


def test_changes_gate_and_matching_in_time(spark, sf_dir):
    log = runs(spark, sf_dir)
    assert same(changes.changed_runs(log), changes.changed_runs(log, chunks=11))
    assert same(changes.gate_runs(log), changes.gate_runs(log, chunks=11))
    events = table(spark, sf_dir, "events")
    args = ("user_id", c("event_type") == "error", c("event_type") == "click", 48 * 3600)
    assert same(changes.consume_within(events, *args), changes.consume_within(events, *args, chunks=11))
    assert same(changes.newest_within(events, *args), changes.newest_within(events, *args, chunks=11))


FIRST, LAST = "ana bo cy dan".split(), "silva kim li".split()


def some_name(rng):
    kind = rng.random()
    if kind < 0.2:
        return rng.choice(LAST)
    if kind < 0.8:
        return f"{rng.choice(FIRST)} {rng.choice(LAST)}"
    return f"{rng.choice(FIRST)} {rng.choice(FIRST)} {rng.choice(LAST)}"


def score(a, b):
    x, y = a.split(), b.split()
    shared = len(set(x) & set(y))
    if x == y:
        return 10
    if x[-1] == y[-1]:
        return 8 if shared >= 2 else 4
    return 5 if shared >= 2 else shared


def greedy(left, right):
    out = []
    for g in sorted({row[0] for row in left}):
        used = set()
        for _, pos, a, b in [x for x in left if x[0] == g]:
            best = None
            for _, other, x, y in [r for r in right if r[0] == g and r[1] not in used]:
                direct, reverse = score(x, a) + score(y, b), score(x, b) + score(y, a)
                top = max(direct, reverse)
                if top >= 8 and (best is None or top > best[1]):
                    best = (other, top, "direct" if direct >= reverse else "reverse")
            if best:
                used.add(best[0])
                out.append((g, pos, *best))
    return sorted(out)


def test_greedy_matching_against_a_plain_loop(spark):
    rng = random.Random(7)
    left = [(g, p, some_name(rng), some_name(rng)) for g in range(5) for p in range(40)]
    right = [(g, p, some_name(rng), some_name(rng)) for g in range(5) for p in range(35)]
    lhs = spark.createDataFrame(left, "g int, left_pos int, a_name string, b_name string")
    rhs = spark.createDataFrame(right, "g int, right_pos int, a_name string, b_name string")
    expected = greedy(left, right)
    for limits in ({}, {"batch": 300, "chunks": 5}):
        assert sorted(tuple(r) for r in greedy_one_to_one(lhs, rhs, "g", **limits).collect()) == expected


def test_small_groups_are_scored_by_pairs_and_large_ones_by_keys_with_the_same_pairs(spark, monkeypatch):
    rng = random.Random(11)
    kinds = lambda sizes: sorted({(g, "-".join(some_name(rng).split()), "-".join(some_name(rng).split())) for g, n in sizes for _ in range(n)})
    left, right = kinds([(1, 9), (2, 40), (3, 40), (4, 3)]), kinds([(1, 12), (2, 45), (3, 5), (5, 3)])
    expected = set()
    for g, a, b in left:
        for h, x, y in right:
            if g == h:
                x_, y_, a_, b_ = (n.replace("-", " ") for n in (x, y, a, b))
                direct, reverse = score(x_, a_) + score(y_, b_), score(x_, b_) + score(y_, a_)
                if max(direct, reverse) >= 8:
                    expected.add((g, a, b, x, y, max(direct, reverse), "direct" if direct >= reverse else "reverse"))
    lost = [(1, None, "ana-silva"), (2, "ana-silva", None), (None, "ana-silva", "bo-kim")]
    lhs = spark.createDataFrame(left + lost, "g int, la string, lb string")
    rhs = spark.createDataFrame(right + lost, "g int, ra string, rb string")
    columns = ["g", "la", "lb", "ra", "rb", "score", "orientation"]
    for small in (0, 12, 64):
        monkeypatch.setattr(matching, "SMALL", small)
        found = matching.score_kinds(lhs, rhs, "g")
        got = [tuple(r) for r in found.select(*columns).collect()]
        assert len(got) == len(set(got)) and set(got) == expected, small
        # a few kinds become many keys, so keys are never sent to every task
        assert re.search(r"SortMergeJoin \[g#\d+, k#\d+L\]", found._jdf.queryExecution().executedPlan().toString())


def test_copies_of_one_pair_over_several_turns(spark):
    left = [(1, p, "ana silva", "bo kim") for p in range(300)]
    right = [(1, p, "bo kim", "ana silva") for p in range(250)]
    lhs = spark.createDataFrame(left, "g int, left_pos int, a_name string, b_name string")
    rhs = spark.createDataFrame(right, "g int, right_pos int, a_name string, b_name string")
    got = greedy_one_to_one(lhs, rhs, "g", batch=300).collect()
    assert sorted((r.left_pos, r.right_pos) for r in got) == [(p, p) for p in range(250)]


def test_best_title_against_a_plain_loop(spark):
    rng = random.Random(3)
    bouts = [(g, p, some_name(rng), some_name(rng)) for g in range(4) for p in range(20)]
    titles = [(g, p, f"{some_name(rng)} vs {some_name(rng)}") for g in range(4) for p in range(20)]
    filler = " ".join(f"w{i}" for i in range(14))
    titles += [(g, p, f"{filler} {some_name(rng)} and {some_name(rng)}") for g in range(4) for p in range(20, 30)]
    expected = []
    for g, pos, a, b in bouts:
        best = None
        for _, at, title in [t for t in titles if t[0] == g]:
            total = score(title, a) + score(title, b)
            if total >= 8 and (best is None or total > best[1]):
                best = (at, total)
        if best:
            expected.append((g, pos, *best))
    lhs = spark.createDataFrame(bouts, "g int, left_pos int, a_name string, b_name string")
    rhs = spark.createDataFrame(titles, "g int, title_pos int, title string")
    assert sorted(tuple(r) for r in best_title(lhs, rhs, "g").collect()) == sorted(expected)


def test_long_comment_lists_become_parts(spark):
    from ringside.operators.documents import record_parts
    from ringside.plans.text_queries import documents_of
    from tests.conftest import SF_DIR

    records = documents_of(spark, SF_DIR).filter((c("record_id") == 0) & (c("entity_type") == "idea"))
    rows = [(0, t, "user", f"text {t}", "2024-01-01T00:00:00") for t in range(25)]
    notes = spark.createDataFrame(rows, "record_id bigint, turn bigint, author string, text string, created string")
    whole = record_parts(records, notes).orderBy("part_no").collect()
    cut = record_parts(records, notes, lines_per_part=10).orderBy("part_no").collect()
    assert len(whole) == 2 and len(cut) == 4
    assert "".join(r.body for r in whole) == "".join(r.body for r in cut)

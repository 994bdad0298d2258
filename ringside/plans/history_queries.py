"""Aggregates, ordering, top-k and dedup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringside.functions import classify, dates, names
from ringside.operators import history
from ringside.operators.ordered import Running, running
from ringside.operators.topk import filter_then_first, first_n, first_then_filter, keep_first
from ringside.plans import sqltext as q
from ringside.plans.adapters import big, bouts, fighters_count, fights, last_five, pick, record_keys, table
from ringside.plans.catalog import query
from ringside.registry import PROJECT_KEYS

c = F.col

_BUCKET = """CASE WHEN contains(lower(method), 'ko') THEN 'KO/TKO' WHEN contains(lower(method), 'submission') THEN 'Submission'
  WHEN contains(lower(method), 'decision') THEN 'Decision' ELSE 'Other' END"""


def _counts(code: str) -> str:
    return " || ', ' || ".join(
        f"count(*) FILTER (result = '{code}' AND {_BUCKET} = '{b}') || ' {b}'"
        for b in ("KO/TKO", "Submission", "Decision", "Other")
    )


_SUMMARY = f"""{q.FIGHTS},
summary AS (SELECT fighter, count(*) FILTER (result = 'W') AS wins, count(*) FILTER (result = 'L') AS losses,
  count(*) FILTER (result = 'D') AS draws, count(*) FILTER (result = 'L' AND {_BUCKET} = 'Submission') AS losses_sub,
  coalesce(nullif(max(CASE WHEN fighter % 7 = 0 AND event_id % 2 = 0 THEN (fighter % 20) || '-' || (fighter % 5) || '-0' ELSE '' END), ''),
    count(*) FILTER (result = 'W') || '-' || count(*) FILTER (result = 'L') || '-' || count(*) FILTER (result = 'D')) AS record_summary,
  {_counts('W')} AS wins_summary, {_counts('L')} AS losses_summary FROM fights GROUP BY fighter)"""


def summary(spark, d):
    key = c("fighter")
    rows = fights(spark, d)
    listed = rows.filter((key % 7 == 0) & (c("event_id") % 2 == 0)).select("fighter").distinct()
    published = listed.select(
        "fighter",
        F.concat_ws("-", (key % 20).cast("string"), (key % 5).cast("string"), F.lit("0")).alias("published"),
    )
    return history.record_summary(rows, published)


@query("record_summary", f"WITH {_SUMMARY} SELECT * FROM summary")
def record_summary(spark, d):
    """F1"""
    return summary(spark, d)


_UFC = "(starts_with(event_name, 'UFC'))"
_FORM = f"""{q.LAST_FIVE},
form AS (SELECT fighter, count(*) FILTER (result = 'W') AS recent_wins,
  count(*) FILTER (result = 'W' AND (method IN ('KO/TKO', 'TKO') OR contains(method, 'Submission'))) AS finish_wins,
  count(*) FILTER {_UFC} AS ufc_fights, count(*) AS recent_fights, max(fight_date) AS last_fight FROM last_five GROUP BY fighter)"""


@query("recent_form", f"WITH {_FORM} SELECT * FROM form")
def recent_form(spark, d):
    """F5"""
    return history.recent_form(last_five(spark, d))


_LABEL = """CASE WHEN recent_wins >= 4 AND finish_wins >= 3 THEN 'strong_finisher' WHEN recent_wins >= 4 THEN 'strong'
  WHEN recent_wins <= 2 THEN 'unstable' WHEN losses_sub = 0 THEN 'no_submission_losses' ELSE 'mixed' END"""


def profile(spark, d):
    joined = summary(spark, d).join(history.recent_form(last_five(spark, d)), "fighter")
    label = history.form_label(c("recent_wins"), c("finish_wins"), c("losses_sub"))
    return joined.withColumn("form", label)


@query("form_label", f"WITH {_SUMMARY}, {_FORM.replace(q.FIGHTS + ',', '', 1)} SELECT fighter, {_LABEL} AS form FROM summary JOIN form USING (fighter)")
def form_label(spark, d):
    """F6, label"""
    return profile(spark, d).select("fighter", "form")


@query("fighter_profile", f"""WITH {_SUMMARY}, {_FORM.replace(q.FIGHTS + ',', '', 1)}
SELECT fighter, record_summary, wins_summary, losses_summary, recent_wins, finish_wins, {_LABEL} AS form FROM summary JOIN form USING (fighter)""")
def fighter_profile(spark, d):
    """F1 with F5 and F6: the flagship"""
    return profile(spark, d).select(
        "fighter", "record_summary", "wins_summary", "losses_summary", "recent_wins", "finish_wins", "form"
    )


@query("pair_edge", f"""WITH {_FORM}, {q.BOUTS}
SELECT bout_key, CASE WHEN coalesce(a.recent_wins, 0) > coalesce(b.recent_wins, 0) THEN 'A'
  WHEN coalesce(b.recent_wins, 0) > coalesce(a.recent_wins, 0) THEN 'B' ELSE 'none' END AS edge
FROM bouts LEFT JOIN form a ON a.fighter = (bout_key * 2) % (SELECT max(user_id) + 1 FROM events) LEFT JOIN form b ON b.fighter = (bout_key * 2 + 1) % (SELECT max(user_id) + 1 FROM events)""")
def pair_edge(spark, d):
    """F6, edge: the form table joined in both roles"""
    form = history.recent_form(last_five(spark, d)).select("fighter", "recent_wins")
    a = form.select(c("fighter").alias("a_key"), c("recent_wins").alias("a_wins"))
    b = form.select(c("fighter").alias("b_key"), c("recent_wins").alias("b_wins"))
    key, users = c("bout_key") * 2, F.lit(fighters_count(spark, d))
    return (
        bouts(spark, d).select("bout_key", (key % users).alias("a_key"), ((key + 1) % users).alias("b_key"))
        .join(a, "a_key", "left").join(b, "b_key", "left")
        .select("bout_key", history.pair_edge(c("a_wins"), c("b_wins")).alias("edge"))
    )


@query("match_coverage", """WITH r AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30)
SELECT o_custkey, count(l_orderkey) AS matched, count(*) AS total,
  CASE WHEN count(l_orderkey) = 0 THEN 'no match' ELSE count(l_orderkey) || '/' || count(*) END AS note
FROM orders LEFT JOIN r ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def match_coverage(spark, d):
    """F3"""
    source = table(spark, d, "lineitem").filter((c("l_returnflag") == "R") & (c("l_quantity") > 30))
    keys = source.select(c("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(1))
    joined = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(keys, "o_orderkey", "left")
    return joined.groupBy("o_custkey").agg(
        F.count("hit").alias("matched"), F.count(F.lit(1)).alias("total")
    ).withColumn(
        "note",
        F.when(c("matched") == 0, "no match").otherwise(
            F.concat_ws("/", c("matched").cast("string"), c("total").cast("string"))
        ),
    )


_COMMENTS = "comments AS (SELECT conv_id AS record_id, turn, role AS author, text, TIMESTAMP '2024-01-01' + to_minutes((conv_id % 1000) * 1440 + turn) AS created FROM conversations)"


def comments(spark, d):
    """Conversation turns as comments on the record of the same number."""
    minutes = ((c("conv_id") % 1000) * 1440 + c("turn")).cast("int")
    return table(spark, d, "conversations").select(
        c("conv_id").alias("record_id"), "turn", c("role").alias("author"), "text",
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=minutes)).alias("created"),
    )


@query("comment_history", f"""WITH {_COMMENTS}
SELECT record_id, count(*) AS n_comments, md5(max_by(text, turn)) AS latest_hash, max_by(author, turn) AS latest_author,
  {q.iso_seconds('max(created)')} AS updated_at FROM comments GROUP BY record_id""")
def comment_history(spark, d):
    """counts and latest comment; the ordered history stays in rows"""
    return (
        comments(spark, d).groupBy("record_id")
        .agg(
            F.count(F.lit(1)).alias("n_comments"),
            F.md5(F.max_by("text", "turn")).alias("latest_hash"),
            F.max_by("author", "turn").alias("latest_author"),
            dates.iso_seconds(F.max("created")).alias("updated_at"),
        )
    )


@query("comment_updates", f"""WITH {_COMMENTS}, n AS (SELECT record_id, count(*) AS n_comments, max(created) AS latest FROM comments GROUP BY record_id)
SELECT doc_id AS record_id, coalesce(n_comments, 0) AS n_comments,
  {q.iso_seconds("coalesce(latest, TIMESTAMP '2024-01-01' + to_minutes(doc_id))")} AS updated_at
FROM documents LEFT JOIN n ON record_id = doc_id""")
def comment_updates(spark, d):
    """every record, with or without comments"""
    counts = comments(spark, d).groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("created").alias("latest")
    )
    created = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=c("doc_id").cast("int"))
    records = table(spark, d, "documents").select(c("doc_id").alias("record_id"), created.alias("made"))
    return records.join(counts, "record_id", "left").select(
        "record_id", F.coalesce("n", F.lit(0)).alias("n_comments"),
        dates.iso_seconds(F.coalesce("latest", "made")).alias("updated_at"),
    )


@query("comment_log", f"""WITH {_COMMENTS}
SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY turn, author, text) AS pos, turn, author, md5(text) AS text_hash FROM comments""")
def comment_log(spark, d):
    """the ordered history, one row a comment; long histories are split over their order"""
    rows = comments(spark, d).select("record_id", "turn", "author", "text")
    placed = running(rows, ["record_id"], ["turn", "author", "text"], {"pos": Running("sum", F.lit(1))})
    return placed.select("record_id", big(c("pos")).alias("pos"), "turn", "author", F.md5("text").alias("text_hash"))


@query("last_n", f"""WITH {_COMMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY turn DESC) AS back,
  count(*) OVER (PARTITION BY record_id) AS n FROM comments)
SELECT record_id, least(n, 5) - back + 1 AS pos, turn, author, md5(text) AS text_hash FROM r WHERE back <= 5""")
def last_n(spark, d):
    """The last five, oldest of them first"""
    tail = first_n(comments(spark, d), ["record_id"], [c("turn").desc()], 5)
    return first_n(tail, ["record_id"], [c("turn").asc()], 5, "pos").select(
        "record_id", big(c("pos")).alias("pos"), "turn", "author", F.md5("text").alias("text_hash")
    )


# ---------------------------------------------------------------- dedup

@query("dedup_first", """SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type""")
def dedup_first(spark, d):
    """G1: first row per key"""
    return keep_first(
        table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"]
    )


_WHOLE_SQL = "SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events"


@query("dedup_filter_first", f"SELECT user_id, event_type, event_id FROM ({_WHOLE_SQL.replace('FROM events', 'FROM events WHERE value > 20')}) WHERE rn = 1")
def dedup_filter_first(spark, d):
    """G1: rejected rows do not use up the key"""
    return filter_then_first(
        table(spark, d, "events"), c("value") > 20, ["user_id", "event_type"], ["event_id"]
    ).select("user_id", "event_type", "event_id")


@query("dedup_filter_after", f"SELECT user_id, event_type, event_id FROM ({_WHOLE_SQL}) WHERE rn = 1 AND value > 20")
def dedup_filter_after(spark, d):
    """G1: the first row uses up the key even when rejected"""
    return first_then_filter(
        table(spark, d, "events").select("user_id", "event_type", "event_id", "value"),
        c("value") > 20, ["user_id", "event_type"], ["event_id"],
    ).select("user_id", "event_type", "event_id")


@query("chat_candidates", """WITH t AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS chat, event_type FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY event_id) AS rn FROM t WHERE chat IS NOT NULL)
SELECT chat AS chat_id, event_id, event_type AS last_text FROM r WHERE rn = 1""")
def chat_candidates(spark, d):
    """G1: distinct chats of an update feed, rows without a chat skipped"""
    chat = F.when(c("event_type") != "error", c("user_id"))
    rows = table(spark, d, "events").select(chat.alias("chat_id"), "event_id", c("event_type").alias("last_text"))
    return filter_then_first(rows, c("chat_id").isNotNull(), ["chat_id"], ["event_id"])


@query("first_n", f"""WITH {q.LAST_FIVE} SELECT fighter, pos, fight_date, opponent, result, method, round, event_name FROM last_five""")
def first_five(spark, d):
    """G2"""
    return last_five(spark, d).select(
        "fighter", big(c("pos")).alias("pos"), "fight_date", "opponent", "result", "method", "round", "event_name"
    )


# ---------------------------------------------------------------- gaps and signals

@query("gap_signals", """WITH g AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) -
  lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS days FROM orders)
SELECT o_custkey, o_orderkey, days AS gap_days, CASE WHEN days >= 240 THEN 'layoff' ELSE 'short_turnaround' END AS signal
FROM g WHERE days >= 240 OR (days > 0 AND days <= 49)""")
def gap_signals(spark, d):
    """G6"""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    seen = running(
        orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"previous": Running("lag", c("o_orderdate"))}
    )
    days = F.date_diff(F.to_date("o_orderdate"), F.to_date("previous"))
    return (
        seen.select("o_custkey", "o_orderkey", big(days).alias("gap_days"))
        .withColumn("signal", history.gap_signal(c("gap_days")))
        .filter(c("signal").isNotNull())
    )


_NAMES = ("Ana Tion", "Bo Ouen", "Li Atter", "Jan O'Eaux-Ray")
_TAILS = ("", " team", " after surgery", " must miss weight", " steps in", " returns")
_TOKENS = "([['ana tion', 'tion'], ['bo ouen', 'ouen'], ['li atter', 'atter'], ['jan o''eaux-ray', 'eaux']])"
_GROUP_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(t, {q.lit(k)})" for k in keys) + f" THEN '{label}'"
    for label, keys in classify.HEADLINE_GROUPS
) + " END"
_HEADLINES = f"""h0 AS (SELECT conv_id, turn, lower(text || ([{', '.join(q.lit(x) for x in _TAILS)}])[(conv_id + turn) % 6 + 1]) AS t,
  {_TOKENS}[conv_id % 4 + 1] AS toks, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
headlines AS (SELECT conv_id, turn, {_GROUP_SQL} AS signal_type, md5(t) AS summary FROM h0
  WHERE rn <= 12 AND len(list_filter(toks, lambda x: contains(t, x))) > 0 AND {_GROUP_SQL} IS NOT NULL)"""


def headlines(spark, d):
    """First twelve headlines per fighter, then those with name and keyword."""
    first = first_n(table(spark, d, "conversations"), ["conv_id"], ["turn"], 12)
    title = F.lower(F.concat(c("text"), pick(_TAILS, (c("conv_id") + c("turn")) % 6)))
    tokens = names.signal_tokens(pick(_NAMES, c("conv_id") % 4))
    return (
        first.select("conv_id", "turn", title.alias("title"), tokens.alias("tokens"))
        .filter(F.exists("tokens", lambda t: F.contains(c("title"), t)))
        .select(
            "conv_id", "turn", classify.headline_class(c("title")).alias("signal_type"),
            F.md5("title").alias("summary"),
        )
        .filter(c("signal_type").isNotNull())
    )


@query("headline_signals", f"WITH {_HEADLINES} SELECT * FROM headlines")
def headline_signals(spark, d):
    """D6"""
    return headlines(spark, d)


@query("signals_capped", f"""WITH {_FORM}, {_HEADLINES},
f AS (SELECT *, DATE '2024-02-10' + CAST(fighter % 3 * 120 AS INTEGER) - CAST(last_fight AS DATE) AS days FROM form),
cand AS (
  SELECT fighter, 0 AS ord, 'weight_class_context' AS signal_type, (fighter % 4) || '/' || (fighter % 3) AS summary FROM f WHERE fighter % 4 <> fighter % 3
  UNION ALL SELECT fighter, 1, CASE WHEN days >= 240 THEN 'layoff' ELSE 'short_turnaround' END, CAST(days AS VARCHAR) FROM f WHERE days >= 240 OR (days > 0 AND days <= 49)
  UNION ALL SELECT fighter, 2, 'sample_quality', ufc_fights || '/' || recent_fights FROM f WHERE ufc_fights <= 1
  UNION ALL SELECT conv_id, 10 + turn, signal_type, summary FROM headlines),
u AS (SELECT fighter, signal_type, summary, min(ord) AS ord FROM cand GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY fighter ORDER BY ord) AS pos FROM u)
SELECT form.fighter, coalesce(pos, 1) AS pos, coalesce(signal_type, 'none') AS signal_type, coalesce(summary, 'none found') AS summary
FROM form LEFT JOIN r ON r.fighter = form.fighter AND r.pos <= 3""")
def signals_capped(spark, d):
    """G9"""
    form = history.recent_form(last_five(spark, d))
    key = c("fighter")
    event_date = F.date_add(F.lit("2024-02-10").cast("date"), (key % 3 * 120).cast("int"))
    days = F.date_diff(event_date, c("last_fight").cast("date"))

    def rule(order: int, fires, kind, detail):
        return F.when(
            fires, F.struct(F.lit(order).cast("bigint").alias("rule_ord"), kind.alias("signal_type"), detail.alias("summary"))
        )

    rules = F.array_compact(
        F.array(
            rule(0, key % 4 != key % 3, F.lit("weight_class_context"),
                 F.concat_ws("/", (key % 4).cast("string"), (key % 3).cast("string"))),
            rule(1, history.gap_signal(days).isNotNull(), history.gap_signal(days), days.cast("string")),
            rule(2, c("ufc_fights") <= 1, F.lit("sample_quality"),
                 F.concat_ws("/", c("ufc_fights").cast("string"), c("recent_fights").cast("string"))),
        )
    )
    from_rules = form.select("fighter", F.inline(rules))
    from_news = headlines(spark, d).select(
        c("conv_id").alias("fighter"), (c("turn") + 10).alias("rule_ord"), "signal_type", "summary"
    )
    return history.capped_signals(form, from_rules.unionByName(from_news)).withColumn("pos", big(c("pos")))


# ---------------------------------------------------------------- listings

ALL_PROJECTS = "__all__"


def listing(df, project_key: str, n: int = 10):
    """Newest records of a project or of all; ties by file name."""
    if project_key != ALL_PROJECTS:
        if project_key not in PROJECT_KEYS:
            raise ValueError(f"unknown project: {project_key}")
        df = df.filter(c("project_key") == project_key)
    return df.orderBy(c("updated_ts").desc(), c("record_id").asc()).limit(n)


_UPDATED = f"{q.RECORDS}, u AS (SELECT *, created_ts + to_minutes(record_id % 7 * 1000) AS updated_ts FROM records)"


def updated(spark, d):
    later = F.make_dt_interval(mins=(c("record_id") % 7 * 1000).cast("int"))
    return record_keys(spark, d).select(
        "record_id", "project_key", "entity_type", (c("created_ts") + later).alias("updated_ts")
    )


@query("list_records", f"""WITH {_UPDATED} SELECT record_id, project_key, {q.iso_seconds('updated_ts')} AS updated_at FROM u
WHERE project_key = 'learning-programming' ORDER BY updated_ts DESC, record_id LIMIT 10""")
def list_records(spark, d):
    """D1, G7"""
    return listing(updated(spark, d), "learning-programming").select(
        "record_id", "project_key", dates.iso_seconds(c("updated_ts")).alias("updated_at")
    )


@query("list_per_project", f"""WITH {_UPDATED}, r AS (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY updated_ts DESC, record_id) AS pos FROM u)
SELECT project_key, pos, record_id, {q.iso_seconds('updated_ts')} AS updated_at FROM r WHERE pos <= 10""")
def list_per_project(spark, d):
    """G7 per project"""
    top = first_n(updated(spark, d), ["project_key"], [c("updated_ts").desc(), c("record_id").asc()], 10, "pos")
    return top.select(
        "project_key", big(c("pos")).alias("pos"), "record_id", dates.iso_seconds(c("updated_ts")).alias("updated_at")
    )


@query("nearest_event", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS event_date FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-06-20' AND DATE '1998-06-21' ORDER BY o_orderdate, o_orderkey LIMIT 1""")
def nearest_event(spark, d):
    """First event of the weekend after the reference date"""
    reference = F.lit("1998-06-17").cast("date")
    saturday = dates.next_saturday(reference)
    first, after = saturday.cast("timestamp_ntz"), F.date_add(saturday, 2).cast("timestamp_ntz")
    return (
        table(spark, d, "orders").filter((c("o_orderdate") >= first) & (c("o_orderdate") < after))
        .orderBy("o_orderdate", "o_orderkey").limit(1)
        .select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("event_date"))
    )


@query("unresolved_recent", """SELECT event_id, CASE event_type WHEN 'error' THEN 'fetch_failed' WHEN 'click' THEN 'empty_content' ELSE 'unsupported_content' END AS status
FROM events WHERE event_type IN ('error', 'click', 'view') AND event_id % 3 <> 0 AND TIMESTAMP '2024-01-15 12:00:00' - ts <= INTERVAL 2 HOUR""")
def unresolved_recent(spark, d):
    """No lower age bound, so later records count as recent"""
    kind = c("event_type")
    status = (
        F.when(kind == "error", "fetch_failed").when(kind == "click", "empty_content")
        .when(kind == "view", "unsupported_content").otherwise("success")
    )
    content = F.when(c("event_id") % 3 == 0, "text").otherwise("")
    now = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return (
        table(spark, d, "events")
        .filter(c("ts") >= now - F.make_dt_interval(hours=F.lit(2)))
        .select("event_id", status.alias("status"), content.alias("content"))
        .filter(c("status").isin("fetch_failed", "unsupported_content", "empty_content") & (c("content") == ""))
        .select("event_id", "status")
    )

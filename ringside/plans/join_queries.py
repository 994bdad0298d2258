"""Joins and matching across sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringside.functions import html, names, text, urls
from ringside.functions.odds import american_to_decimal
from ringside.operators import changes, discovery, matching, merge
from ringside.operators.topk import insert_if_absent
from ringside.plans import sqltext as q
from ringside.plans.adapters import big, bouts, odds, pick, table
from ringside.plans.catalog import query
from ringside.plans.source_queries import _ANCHORS_SQL
from ringside.registry import PROJECT_KEYS, PROJECTS, registry_frame

c = F.col


def _walk(lefts: str, last_step: str) -> str:
    """Greedy assignment, one left row of every card per step."""
    return f"""
pl AS (SELECT card, lpos, list(rpos ORDER BY score DESC, rpos) AS choices FROM cand GROUP BY card, lpos),
walk(card, lpos, used, pick) AS (
  SELECT DISTINCT card, CAST(-1 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) FROM {lefts}
  UNION ALL
  SELECT card, lpos, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick FROM (
    SELECT w.card, w.lpos + 1 AS lpos, w.used, list_filter(pl.choices, lambda e: NOT list_contains(w.used, e))[1] AS pick
    FROM walk w LEFT JOIN pl ON pl.card = w.card AND pl.lpos = w.lpos + 1 WHERE w.lpos < {last_step})),
assigned AS (SELECT w.card, w.lpos, w.pick AS rpos, cand.score, cand.orientation FROM walk w
  JOIN cand ON cand.card = w.card AND cand.lpos = w.lpos AND cand.rpos = w.pick WHERE w.pick IS NOT NULL)"""


def _cand(left: str, right: str, lpos: str, rpos: str) -> str:
    direct = f"{q.name_score('r.sa', 'l.sa')} + {q.name_score('r.sb', 'l.sb')}"
    reverse = f"{q.name_score('r.sa', 'l.sb')} + {q.name_score('r.sb', 'l.sa')}"
    return f"""
l AS (SELECT card, {lpos} AS lpos, {q.slug('a_name')} AS sa, {q.slug('b_name')} AS sb FROM {left}),
r AS (SELECT card, {rpos} AS rpos, {q.slug('a_name')} AS sa, {q.slug('b_name')} AS sb FROM {right}),
scored AS (SELECT l.card, lpos, rpos, {direct} AS d, {reverse} AS v FROM l JOIN r ON l.card = r.card),
cand AS (SELECT card, lpos, rpos, greatest(d, v) AS score, CASE WHEN d >= v THEN 'direct' ELSE 'reverse' END AS orientation
  FROM scored WHERE greatest(d, v) >= 8)"""


def _price(x: str) -> str:
    v = f"CAST({x} AS INTEGER)"
    return f"CASE WHEN {v} > 0 THEN printf('%.2f', 1 + {v} / 100.0::DOUBLE) ELSE printf('%.2f', 1 + 100.0::DOUBLE / abs({v})) END"


@query("fuzzy_one_to_one", f"""WITH RECURSIVE {q.ODDS}, {_cand('bouts', 'odds', 'pos', 'row_index')}, {_walk('bouts', '11')}
SELECT a.card, a.lpos AS pos, a.rpos AS row_index, CAST(a.score AS BIGINT) AS score, a.orientation,
  CASE WHEN orientation = 'direct' THEN {_price('a_american')} ELSE {_price('b_american')} END AS a_price,
  CASE WHEN orientation = 'direct' THEN {_price('b_american')} ELSE {_price('a_american')} END AS b_price
FROM assigned a JOIN odds ON odds.card = a.card AND odds.row_index = a.rpos""")
def fuzzy_one_to_one(spark, d):
    """E1"""
    rows = odds(spark, d)
    matched = matching.greedy_one_to_one(
        bouts(spark, d).withColumnRenamed("pos", "left_pos"),
        rows.withColumnRenamed("row_index", "right_pos"),
        "card",
    )
    direct = c("orientation") == "direct"
    a, b = american_to_decimal(c("a_american")), american_to_decimal(c("b_american"))
    priced = matched.join(
        rows.select("card", c("row_index").alias("right_pos"), "a_american", "b_american"), ["card", "right_pos"]
    )
    return priced.select(
        "card", c("left_pos").alias("pos"), c("right_pos").alias("row_index"), big(c("score")).alias("score"),
        "orientation", F.when(direct, a).otherwise(b).alias("a_price"), F.when(direct, b).otherwise(a).alias("b_price"),
    )


_TITLES = f"""{q.ODDS},
titles AS (SELECT card, row_index, CASE row_index % 4 WHEN 0 THEN 'UFC: ' || a_name || ' vs. ' || b_name WHEN 1 THEN b_name || ' vs. ' || a_name
  WHEN 2 THEN a_name ELSE a_name || ' vs ' || b_name END AS title FROM odds)"""


@query("fuzzy_best", f"""WITH {_TITLES}, l AS (SELECT card, pos, {q.slug('a_name')} AS sa, {q.slug('b_name')} AS sb FROM bouts),
r AS (SELECT card, row_index, {q.slug('title')} AS st FROM titles),
s AS (SELECT card, pos, row_index, {q.name_score('st', 'sa')} + {q.name_score('st', 'sb')} AS score FROM l JOIN r USING (card)),
b AS (SELECT *, row_number() OVER (PARTITION BY card, pos ORDER BY score DESC, row_index) AS rn FROM s WHERE score >= 8)
SELECT card, pos, row_index AS title_pos, CAST(score AS BIGINT) AS score FROM b WHERE rn = 1""")
def fuzzy_best(spark, d):
    """E2"""
    kind = c("row_index") % 4
    title = (
        F.when(kind == 0, F.concat(F.lit("UFC: "), c("a_name"), F.lit(" vs. "), c("b_name")))
        .when(kind == 1, F.concat(c("b_name"), F.lit(" vs. "), c("a_name")))
        .when(kind == 2, c("a_name"))
        .otherwise(F.concat(c("a_name"), F.lit(" vs "), c("b_name")))
    )
    titles = odds(spark, d).select("card", c("row_index").alias("title_pos"), title.alias("title"))
    best = matching.best_title(bouts(spark, d).withColumnRenamed("pos", "left_pos"), titles, "card")
    return best.select("card", c("left_pos").alias("pos"), "title_pos", big(c("score")).alias("score"))


_MERGE = f"""{q.ODDS},
ex AS (SELECT card, pos, 'e' || bout_key AS bout_id, a_name, b_name, CASE WHEN bout_key % 3 = 0 THEN 'n/a' ELSE kind END AS weight_class,
  CASE WHEN bout_key % 2 = 0 THEN 'n/a' ELSE 'Prelim' END AS card_segment FROM bouts WHERE bout_key % 4 <> 0),
fb AS (SELECT card, row_index AS pos, 'f' || bout_key AS bout_id, a_name, b_name, 'Lightweight' AS weight_class, 'Main Card' AS card_segment
  FROM odds WHERE bout_key % 5 <> 1)"""


_MERGED = f"""WITH RECURSIVE {_MERGE}, {_cand('fb', 'ex', 'pos', 'pos')}, {_walk('fb', '11')},
m AS (SELECT fb.card, fb.pos AS fpos, a.rpos AS epos FROM fb LEFT JOIN assigned a ON a.card = fb.card AND a.lpos = fb.pos)
SELECT coalesce(m.card, ex.card) AS card, CASE WHEN m.card IS NULL THEN 'leftover' WHEN ex.card IS NULL THEN 'added' ELSE 'matched' END AS how,
  CASE WHEN m.card IS NULL THEN 1 ELSE 0 END::BIGINT AS part, coalesce(m.fpos, ex.pos) AS place, coalesce(ex.bout_id, fb.bout_id) AS bout_id,
  coalesce(ex.a_name, fb.a_name) AS a_name, coalesce(ex.b_name, fb.b_name) AS b_name,
  coalesce(nullif(ex.weight_class, 'n/a'), fb.weight_class) AS weight_class, coalesce(nullif(ex.card_segment, 'n/a'), fb.card_segment) AS card_segment
FROM m FULL JOIN ex ON ex.card = m.card AND ex.pos = m.epos LEFT JOIN fb ON fb.card = m.card AND fb.pos = m.fpos"""


@query("fallback_merge", _MERGED)
def fallback_merge(spark, d):
    """E3, H3"""
    key = c("bout_key")
    existing = bouts(spark, d).filter(key % 4 != 0).select(
        "card", "pos", F.concat(F.lit("e"), key.cast("string")).alias("bout_id"), "a_name", "b_name",
        F.when(key % 3 == 0, "n/a").otherwise(c("kind")).alias("weight_class"),
        F.when(key % 2 == 0, "n/a").otherwise("Prelim").alias("card_segment"),
    )
    fallback = odds(spark, d).filter(key % 5 != 1).select(
        "card", c("row_index").alias("pos"), F.concat(F.lit("f"), key.cast("string")).alias("bout_id"),
        "a_name", "b_name", F.lit("Lightweight").alias("weight_class"), F.lit("Main Card").alias("card_segment"),
    )
    return merge.fallback_merge(existing, fallback, "card").withColumn("part", big(c("part")))


@query("merge_coverage", f"""SELECT card, count(*) FILTER (how = 'matched') AS matched, count(*) FILTER (how = 'added') AS added,
  count(*) FILTER (how = 'leftover') AS leftover, count(*) AS confirmed,
  CASE WHEN count(*) FILTER (how <> 'leftover') > 0 THEN 'main + official' ELSE 'main' END AS source FROM ({_MERGED}) GROUP BY card""")
def merge_coverage(spark, d):
    """F3 on the merged cards themselves"""
    return merge.merge_coverage(fallback_merge(spark, d), "card", "official")


# ---------------------------------------------------------------- discovery

def _tok(x: str) -> str:
    return f"string_split({q.slug(x)}, '-')[-1]"


_WIN = "CASE WHEN spot > 0 THEN substr(raw, greatest(spot - 5000, 1), spot + 5000 - greatest(spot - 5000, 1)) END"

_LOOKUP = f"""{_ANCHORS_SQL},
links AS (SELECT page_id, pos, text, href || CASE WHEN page_id % 4 = 0 THEN '' WHEN pos % 3 = 0 THEN '-2024' WHEN pos % 3 = 1 THEN '-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') ELSE '' END AS href FROM a),
ev AS (SELECT page_id, lower(html) AS raw, lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS dd,
  CASE WHEN page_id % 4 = 0 THEN 'charset' WHEN page_id % 4 = 1 THEN coalesce((SELECT {_tok('x.text')} FROM a x WHERE x.page_id = pages.page_id AND x.pos = 1), 'zz') ELSE 'zz' END AS la,
  CASE WHEN page_id % 4 = 0 THEN 'zz' ELSE coalesce((SELECT {_tok('x.text')} FROM a x WHERE x.page_id = pages.page_id AND x.pos = 3), 'zz') END AS lb FROM pages),
p1 AS (SELECT page_id, pos, href, CASE WHEN contains({q.slug('lower(text)')}, la) THEN 5 ELSE 0 END + CASE WHEN contains({q.slug('lower(text)')}, lb) THEN 5 ELSE 0 END
  + CAST(contains(href, dd) AS INTEGER) + CAST(contains(href, '2024') AS INTEGER) AS score FROM links JOIN ev USING (page_id)),
b1 AS (SELECT page_id, href, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rn FROM p1 WHERE score > 0),
w0 AS (SELECT DISTINCT page_id, href FROM links),
w1 AS (SELECT page_id, href, raw, la, lb, position(lower(href) IN raw) AS spot FROM w0 JOIN ev USING (page_id)),
w2 AS (SELECT page_id, href, la, lb, {_WIN} AS win FROM w1),
p2 AS (SELECT page_id, href, CASE WHEN contains({q.slug('win')}, la) THEN 5 ELSE 0 END + CASE WHEN contains({q.slug('win')}, lb) THEN 5 ELSE 0 END
  + CAST(contains(replace(win, '-', ''), '202403') AS INTEGER) AS score FROM w2 WHERE win IS NOT NULL),
b2 AS (SELECT page_id, href, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, href) AS rn FROM p2 WHERE score > 0)"""


@query("scored_lookup", f"""WITH {_LOOKUP}
SELECT pages.page_id, coalesce(b1.href, b2.href) AS href, CAST(coalesce(b1.score, b2.score) AS BIGINT) AS score
FROM pages LEFT JOIN b1 ON b1.page_id = pages.page_id AND b1.rn = 1 LEFT JOIN b2 ON b2.page_id = pages.page_id AND b2.rn = 1""")
def scored_lookup(spark, d):
    """Every page is the listing page of its own event"""
    key = c("page_id")
    day_text = F.lpad((key % 28 + 1).cast("string"), 2, "0")
    base = table(spark, d, "pages").select("page_id", "html", html.anchors(c("html")).alias("found"))

    def last_word(i: int):
        return F.coalesce(names.last_token(names.name_tokens(F.get(c("found"), F.lit(i))["text"])), F.lit("zz"))

    def dated(link, i):
        extra = (
            F.when(key % 4 == 0, "").when(i % 3 == 0, "-2024")
            .when(i % 3 == 1, F.concat(F.lit("-"), day_text)).otherwise("")
        )
        return F.struct(F.concat(link["href"], extra).alias("href"), link["text"].alias("text"))

    events = base.select(
        "page_id", "html", F.transform("found", dated).alias("links"),
        F.when(key % 4 == 0, "charset").when(key % 4 == 1, last_word(1)).otherwise("zz").alias("a_last"),
        F.when(key % 4 == 0, "zz").otherwise(last_word(3)).alias("b_last"),
        F.concat(F.lit("2024-03-"), day_text).cast("date").alias("day"),
    )
    best = discovery.best_link(c("links"), c("html"), c("a_last"), c("b_last"), c("day"))
    return events.select("page_id", best.alias("b")).select("page_id", "b.href", big(c("b.score")).alias("score"))


_POSTS = f"""{q.BOUTS},
main AS (SELECT card, {_tok('a_name')} AS la, {_tok('b_name')} AS lb FROM bouts WHERE pos = 0),
posts AS (SELECT card, bout_key % 3 AS term_ord, pos AS rank, bout_key // 2 AS post_id,
  CASE bout_key % 4 WHEN 0 THEN a_name || ' vs. ' || b_name || ': Opening Odds' WHEN 1 THEN 'Opening betting odds for ' || b_name || ' & ' || a_name
    WHEN 2 THEN a_name || ' vs. ' || b_name ELSE 'UFC opening odds, ' || a_name || ' + ' || b_name END AS title,
  strftime(DATE '2024-01-01' + CAST(bout_key % 5 AS INTEGER), '%Y-%m-%dT08:00:00') AS date_gmt FROM bouts),
found AS (SELECT posts.*, la, lb, {q.slug('title')} AS slug FROM posts JOIN main USING (card))"""


def search_results(spark, d):
    """Posts found for each card, with the last names of its main bout."""
    key = c("bout_key")
    all_bouts = bouts(spark, d)
    kind = key % 4
    title = (
        F.when(kind == 0, F.concat(c("a_name"), F.lit(" vs. "), c("b_name"), F.lit(": Opening Odds")))
        .when(kind == 1, F.concat(F.lit("Opening betting odds for "), c("b_name"), F.lit(" & "), c("a_name")))
        .when(kind == 2, F.concat(c("a_name"), F.lit(" vs. "), c("b_name")))
        .otherwise(F.concat(F.lit("UFC opening odds, "), c("a_name"), F.lit(" + "), c("b_name")))
    )
    posts = all_bouts.select(
        "card", (key % 3).alias("term_ord"), c("pos").alias("rank"), F.expr("bout_key div 2").alias("post_id"),
        title.alias("title"),
        F.concat(F.date_add(F.lit("2024-01-01").cast("date"), (key % 5).cast("int")).cast("string"), F.lit("T08:00:00")).alias("date_gmt"),
    )
    main = all_bouts.filter(c("pos") == 0).select(
        "card",
        names.last_token(names.name_tokens(c("a_name"))).alias("a_last"),
        names.last_token(names.name_tokens(c("b_name"))).alias("b_last"),
    )
    return posts.join(main, "card")


@query("title_contains", f"WITH {_POSTS} SELECT card, rank, title FROM found WHERE contains(slug, la) AND contains(slug, lb)")
def title_contains(spark, d):
    """D2"""
    fits = discovery.title_matches(text.slug_ascii(c("title")), c("a_last"), c("b_last"))
    return search_results(spark, d).filter(fits).select("card", "rank", "title")


@query("title_of_event", f"""WITH {_POSTS}, named AS (SELECT card, a_name AS event_name FROM bouts WHERE pos = 3)
SELECT card, rank, title FROM found LEFT JOIN named USING (card)
WHERE CASE WHEN card % 2 = 0 THEN contains(slug, {q.slug('event_name')}) ELSE contains(slug, la) AND contains(slug, lb) END""")
def title_of_event(spark, d):
    """Of every other card no bout is known, only the name of the event"""
    known = c("card") % 2 == 1
    named = bouts(spark, d).filter(c("pos") == 3).select("card", c("a_name").alias("event_name"))
    rows = search_results(spark, d).join(named, "card", "left")
    fits = discovery.title_matches(
        text.slug_ascii(c("title")), F.when(known, c("a_last")), F.when(known, c("b_last")), text.slug_ascii(c("event_name"))
    )
    return rows.filter(fits).select("card", "rank", "title")


@query("best_article", f"""WITH {_POSTS},
f AS (SELECT *, row_number() OVER (PARTITION BY card, post_id ORDER BY term_ord, rank) AS seen FROM found WHERE post_id <> 0),
g AS (SELECT *, row_number() OVER (PARTITION BY card ORDER BY date_gmt DESC, term_ord, rank) AS rn FROM f
  WHERE seen = 1 AND contains(slug, la) AND contains(slug, lb) AND (contains(slug, 'opening-betting-odds') OR contains(slug, 'opening-odds')))
SELECT card, post_id, title, date_gmt FROM g WHERE rn = 1""")
def best_article(spark, d):
    """D3, G4"""
    escaped = search_results(spark, d).withColumn("title", F.replace(F.replace("title", F.lit("&"), F.lit("&#38;")), F.lit("."), F.lit("&#46;")))
    return discovery.best_article(escaped).select("card", "post_id", "title", "date_gmt")


# ---------------------------------------------------------------- lookups and merges

@query("asof_heading", """WITH e AS (SELECT *, CASE WHEN event_type = 'signup' THEN 'H' || event_id END AS heading FROM events),
w AS (SELECT user_id, event_id, event_type, last_value(heading IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS h FROM e)
SELECT user_id, event_id, coalesce(h, 'Card') AS heading FROM w WHERE event_type <> 'signup'""")
def asof_heading(spark, d):
    """E5"""
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    heading = F.when(c("event_type") == "signup", F.concat(F.lit("H"), c("event_id").cast("string")))
    seen = changes.as_of(rows, ["user_id"], ["ts", "event_id"], {"heading": heading})
    return seen.filter(c("event_type") != "signup").select(
        "user_id", "event_id", F.coalesce("heading", F.lit("Card")).alias("heading")
    )


_REG = ", ".join(f"({q.lit(p.key)}, {q.lit(p.label)})" for p in PROJECTS)


@query("registry_join", f"""WITH reg(project_key, project_label) AS (VALUES {_REG}),
t AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 6 = 5 THEN 'other' ELSE ([{', '.join(q.lit(k) for k in PROJECT_KEYS)}])[c_custkey % 6 + 1] END AS project_key FROM customer)
SELECT c_custkey, project_key, project_label, project_label IS NOT NULL AS known, n_name, r_name FROM t LEFT JOIN reg USING (project_key)
LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def registry_join(spark, d):
    """The registry has five rows by definition and is broadcast"""
    key = F.when(c("c_custkey") % 6 == 5, "other").otherwise(pick(PROJECT_KEYS, F.least(c("c_custkey") % 6, F.lit(4))))
    labels = registry_frame(spark).select("project_key", "project_label")
    return (
        table(spark, d, "customer").select("c_custkey", "c_nationkey", key.alias("project_key"))
        .join(F.broadcast(labels), "project_key", "left")
        .join(table(spark, d, "nation"), c("n_nationkey") == c("c_nationkey"), "left")
        .join(table(spark, d, "region"), c("r_regionkey") == c("n_regionkey"), "left")
        .select("c_custkey", "project_key", "project_label", c("project_label").isNotNull().alias("known"), "n_name", "r_name")
    )


@query("pair_enrich", f"""WITH {q.BOUTS}, h AS (SELECT l_partkey, count(*) AS fights, CAST(sum(l_quantity) AS BIGINT) AS total, max(l_extendedprice) AS best FROM lineitem GROUP BY l_partkey)
SELECT bout_key, a.fights AS a_fights, a.total AS a_total, a.best AS a_best, b.fights AS b_fights, b.total AS b_total, b.best AS b_best
FROM bouts LEFT JOIN h a ON a.l_partkey = bout_key * 2 LEFT JOIN h b ON b.l_partkey = bout_key * 2 + 1""")
def pair_enrich(spark, d):
    """One aggregate, two roles"""
    history = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("fights"), big(F.sum("l_quantity")).alias("total"), F.max("l_extendedprice").alias("best")
    )

    def role(mark: str):
        return history.select(
            c("l_partkey").alias(f"{mark}_key"), *[c(n).alias(f"{mark}_{n}") for n in ("fights", "total", "best")]
        )

    pairs = bouts(spark, d).select("bout_key", (c("bout_key") * 2).alias("a_key"), (c("bout_key") * 2 + 1).alias("b_key"))
    return pairs.join(role("a"), "a_key", "left").join(role("b"), "b_key", "left").drop("a_key", "b_key")


@query("state_compare", """WITH cur AS (SELECT c_custkey, sha256(c_mktsegment || '|' || (c_custkey % 9)) AS hash FROM customer),
sent AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN sha256(c_mktsegment || '|' || (c_custkey % 9)) WHEN 1 THEN '' ELSE 'old' END AS m,
  CASE WHEN c_custkey % 8 = 1 THEN sha256(c_mktsegment || '|' || (c_custkey % 9)) ELSE '' END AS r FROM customer WHERE c_custkey % 5 <> 0)
SELECT c_custkey, coalesce(nullif(m, ''), nullif(r, '')) AS prev_hash,
  CASE WHEN coalesce(nullif(m, ''), nullif(r, '')) IS NOT DISTINCT FROM hash THEN 'unchanged' ELSE 'changed' END AS status FROM cur LEFT JOIN sent USING (c_custkey)""")
def state_compare(spark, d):
    """E8"""
    key = c("c_custkey")
    customer = table(spark, d, "customer")
    now = F.sha2(F.concat_ws("|", c("c_mktsegment"), (key % 9).cast("string")), 256)
    current = customer.select("c_custkey", now.alias("hash"))
    sent = customer.filter(key % 5 != 0).select(
        "c_custkey",
        F.when(key % 4 == 0, now).when(key % 4 == 1, "").otherwise("old").alias("last_meaningful_hash"),
        F.when(key % 8 == 1, now).otherwise("").alias("last_sent_hash"),
    )
    previous = merge.previous_hash(c("last_meaningful_hash"), c("last_sent_hash"))
    return current.join(sent, "c_custkey", "left").select(
        "c_custkey", previous.alias("prev_hash"),
        F.when(previous.eqNullSafe(c("hash")), "unchanged").otherwise("changed").alias("status"),
    )


@query("insert_if_absent", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'current' ELSE 'incoming' END AS origin,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus ELSE lower(o_orderstatus) END AS status FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0""")
def absent_inserted(spark, d):
    """E9"""
    orders, key = table(spark, d, "orders"), c("o_orderkey")
    current = orders.filter(key % 3 != 0).select("o_orderkey", F.lit("current").alias("origin"), c("o_orderstatus").alias("status"))
    incoming = orders.filter(key % 2 == 0).select("o_orderkey", F.lit("incoming").alias("origin"), F.lower("o_orderstatus").alias("status"))
    return insert_if_absent(current, incoming, ["o_orderkey"])


@query("fresh_or_stale", f"""SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN {q.host('url')} || ' new' WHEN page_id % 11 <> 0 THEN {q.host('url')} || ' old' END AS body,
  CASE WHEN page_id % 7 <> 0 THEN 'fresh' WHEN page_id % 11 <> 0 THEN 'cached' ELSE 'failed' END AS origin FROM pages""")
def fresh_or_stale(spark, d):
    """E10"""
    pages, key = table(spark, d, "pages").select("page_id", "url"), c("page_id")
    fresh = pages.select("page_id", F.when(key % 7 != 0, F.concat(urls.host(c("url")), F.lit(" new"))).alias("body"))
    cached = pages.filter(key % 11 != 0).select("page_id", F.concat(urls.host(c("url")), F.lit(" old")).alias("body"))
    return merge.fresh_else_cached(fresh, cached, "page_id", "body")


@query("link_attempts", """WITH t AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'fetch_failed' ELSE 'empty_content' END AS s1,
  CASE page_id % 5 WHEN 0 THEN 'unsupported_content' WHEN 1 THEN 'fetch_failed' ELSE 'success' END AS s2, url FROM pages)
SELECT page_id, CASE WHEN s1 = 'success' OR s2 = 'success' THEN 'success' ELSE 'fetch_failed' END AS status,
  CASE WHEN s1 = 'success' THEN '1 ' || url WHEN s2 = 'success' THEN '2 ' || url ELSE '' END AS content,
  CASE WHEN s1 = 'success' OR s2 = 'success' THEN NULL ELSE 'first ' || s1 || CASE WHEN page_id % 5 = 0 THEN ' | second ' || s2 ELSE '' END END AS error FROM t""")
def link_attempts(spark, d):
    """E10, two attempts"""
    key = c("page_id")

    def attempt(mark, status, error):
        good = status == "success"
        return F.struct(
            status.alias("status"),
            F.when(good, F.concat(F.lit(mark), c("url"))).otherwise("").alias("content"),
            F.when(~good, error).alias("error"),
        )

    one = F.when(key % 3 == 0, "success").when(key % 3 == 1, "fetch_failed").otherwise("empty_content")
    two = F.when(key % 5 == 0, "unsupported_content").when(key % 5 == 1, "fetch_failed").otherwise("success")
    best = merge.first_success(
        attempt("1 ", one, F.concat(F.lit("first "), one)),
        attempt("2 ", two, F.when(key % 5 == 0, F.concat(F.lit("second "), two)).otherwise("")),
    )
    return table(spark, d, "pages").select("page_id", best.alias("b")).select("page_id", "b.*")


@query("provenance_union", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'base|odds' WHEN 1 THEN 'base|odds' ELSE 'base|x|odds' END AS sources,
  CASE WHEN o_orderkey % 4 = 0 THEN 'card + odds_feed' ELSE 'card + odds_feed' END AS source FROM orders""")
def provenance_union(spark, d):
    """H2"""
    kind = c("o_orderkey") % 3
    before = (
        F.when(kind == 0, F.array(F.lit("base"), F.lit("odds"))).when(kind == 1, F.array(F.lit("base")))
        .otherwise(F.array(F.lit("base"), F.lit("x")))
    )
    source = F.when(c("o_orderkey") % 4 == 0, "card + odds_feed").otherwise("card")
    return table(spark, d, "orders").select(
        "o_orderkey", F.array_join(merge.add_once(before, F.lit("odds")), "|").alias("sources"),
        merge.tag_once(source, "odds_feed").alias("source"),
    )

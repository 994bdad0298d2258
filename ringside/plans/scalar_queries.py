"""Scalar and projection queries: one map-only pass over the table each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringside.functions import classify, dates, hashing, html, names, odds, text, urls
from ringside.plans import sqltext as q
from ringside.plans.adapters import big, bouts, pick, records, table
from ringside.plans.catalog import query

c = F.col


@query("title_build", f"""WITH {q.RECORDS}
SELECT record_id, {q.title(f"coalesce(nullif(normalized_text, ''), raw_input)", f"coalesce({q.host('source_url')}, '')", 'extracted_content')} AS title
FROM records""")
def title_build(spark, d):
    """C1"""
    return records(spark, d).select(
        "record_id",
        text.build_title(
            text.first_filled(c("normalized_text"), c("raw_input")),
            urls.host(c("source_url")),
            c("extracted_content"),
        ).alias("title"),
    )


@query("list_label", f"""WITH {q.RECORDS},
t AS (SELECT *, CASE record_id % 4 WHEN 0 THEN coalesce(source_url, '') WHEN 1 THEN '' ELSE {q.collapse('raw_input')} END AS title,
  coalesce({q.host('source_url')}, '') AS h, {q.collapse('extracted_content')} AS summary FROM records)
SELECT record_id, coalesce(nullif(left({q.collapse("coalesce(nullif(normalized_text, ''), nullif(raw_input, ''), 'Без названия')")}, 80), ''), 'Без названия') AS derived,
  CASE WHEN regexp_matches(title, '^https?://') OR (coalesce(source_url, '') <> '' AND title = source_url) THEN
    CASE WHEN summary <> '' THEN left(CASE WHEN h <> '' THEN h || ': ' || summary ELSE summary END, 60)
      WHEN h <> '' THEN left(h || ': ссылка', 60) ELSE 'Ссылка без описания' END
  WHEN title = '' THEN 'Без названия' ELSE left({q.strip('title')}, 60) END AS label FROM t""")
def list_label(spark, d):
    """C2"""
    df = records(spark, d)
    title = (
        F.when(c("record_id") % 4 == 0, F.coalesce(c("source_url"), F.lit("")))
        .when(c("record_id") % 4 == 1, "")
        .otherwise(text.collapse_spaces(c("raw_input")))
    )
    host = F.coalesce(urls.host(c("source_url")), F.lit(""))
    return df.select(
        "record_id",
        text.derive_title(c("normalized_text"), c("raw_input")).alias("derived"),
        text.list_label(title, c("source_url"), host, c("extracted_content")).alias("label"),
    )


@query("extract_links", """WITH t AS (
  SELECT doc_id, regexp_extract_all(text || ' ' || coalesce(url, '') || ' ' || coalesce(url, ''), 'https?://\\S+') AS links
  FROM documents LEFT JOIN pages ON page_id = doc_id)
SELECT doc_id, pos, links[pos + 1] AS link
FROM (SELECT doc_id, links, unnest(range(len(links))) AS pos FROM t)""")
def extract_links(spark, d):
    """C3"""
    url = F.coalesce(c("url"), F.lit(""))
    joined = table(spark, d, "documents").join(
        table(spark, d, "pages").select("page_id", "url"), c("doc_id") == c("page_id"), "left"
    )
    links = urls.extract_links(F.concat_ws(" ", c("text"), url, url))
    return joined.select("doc_id", F.posexplode(links).alias("pos", "link")).withColumn("pos", big(c("pos")))


@query("url_host", f"SELECT page_id, {q.host('url')} AS host FROM pages")
def url_host(spark, d):
    """C4"""
    return table(spark, d, "pages").select("page_id", urls.host(c("url")).alias("host"))


@query("page_text", f"SELECT page_id, left({q.page_text('html')}, 12000) AS readable FROM pages")
def page_text(spark, d):
    """C5, text"""
    readable = F.substring(html.readable_text(c("html")), 1, html.READABLE_LIMIT)
    return table(spark, d, "pages").select("page_id", readable.alias("readable"))


_TYPES = ("text/html; charset=utf-8", "text/plain", "application/pdf", "")


@query("page_status", f"""WITH t AS (
  SELECT page_id, (['text/html; charset=utf-8', 'text/plain', 'application/pdf', ''])[page_id % 4 + 1] AS ct,
    CASE WHEN page_id % 8 = 1 THEN '<p> </p>' ELSE html END AS html FROM pages)
SELECT page_id, CASE WHEN page_id % 4 >= 2 THEN 'unsupported_content'
  WHEN {q.page_text('html')} = '' THEN 'empty_content' ELSE 'success' END AS status FROM t""")
def page_status(spark, d):
    """C5, status"""
    body = F.when(c("page_id") % 8 == 1, "<p> </p>").otherwise(c("html"))
    return table(spark, d, "pages").select(
        "page_id",
        html.page_status(pick(_TYPES, c("page_id") % 4), html.readable_text(body)).alias("status"),
    )


@query("slug_ascii", f"SELECT doc_id, {q.slug('text')} AS slug FROM documents")
def slug_ascii(spark, d):
    """C6"""
    return table(spark, d, "documents").select("doc_id", text.slug_ascii(c("text")).alias("slug"))


_WIDE = q.sub(q.sub(f"lower({q.strip('text')})", q.WS + "+", "-"), r"(?i)[^a-zа-я0-9\-_]+", "-")


@query("slug_wide", f"SELECT doc_id, coalesce(nullif(trim({_WIDE}, '-'), ''), 'item') AS slug FROM documents")
def slug_wide(spark, d):
    """C7"""
    return table(spark, d, "documents").select("doc_id", text.slug_wide(c("text")).alias("slug"))


@query("safe_id", f"""SELECT doc_id,
  coalesce(nullif(left(lower(trim({q.sub('text', '[^A-Za-z0-9._-]+', '-')}, '-')), 80), ''), 'item') AS safe,
  coalesce(nullif(left({q.sub('lower(text)', '[^a-z0-9]')}, 24), ''), 'item') AS suffix FROM documents""")
def safe_id(spark, d):
    """C8"""
    return table(spark, d, "documents").select(
        "doc_id",
        text.safe_id(c("text")).alias("safe"),
        text.safe_suffix(F.lit(""), c("text")).alias("suffix"),
    )


_NAME = "p_name || CASE p_partkey % 3 WHEN 0 THEN ' O''Neil-Ray' WHEN 1 THEN ' St. Élan' ELSE '' END"


@query("name_tokens", f"""WITH t AS (SELECT p_partkey, {_NAME} AS name FROM part),
s AS (SELECT *, string_split({q.slug('name')}, '-') AS toks,
  list_filter(string_split({q.collapse("translate(lower(name), '.-''', '   ')")}, ' '), lambda x: length(x) >= 4) AS parts FROM t)
SELECT p_partkey, array_to_string(toks, '|') AS tokens, toks[-1] AS last,
  array_to_string(list_sort(list_distinct(list_append(parts, lower(name)))), '|') AS signal_tokens FROM s""")
def name_tokens(spark, d):
    """C9"""
    name = F.concat(
        c("p_name"),
        F.when(c("p_partkey") % 3 == 0, " O'Neil-Ray").when(c("p_partkey") % 3 == 1, " St. Élan").otherwise(""),
    )
    tokens = names.name_tokens(name)
    return table(spark, d, "part").select(
        "p_partkey",
        F.array_join(tokens, "|").alias("tokens"),
        names.last_token(tokens).alias("last"),
        F.array_join(F.array_sort(names.signal_tokens(name)), "|").alias("signal_tokens"),
    )


@query("name_score", f"""WITH {q.BOUTS}, s AS (SELECT bout_key, {q.slug('a_name')} AS a, {q.slug('b_name')} AS b,
  {q.slug("a_name || ' ' || b_name")} AS whole FROM bouts)
SELECT bout_key, CAST({q.name_score('a', 'b')} AS BIGINT) AS score, CAST({q.name_score('whole', 'b')} AS BIGINT) AS title_score FROM s""")
def name_score(spark, d):
    """C10"""
    both = text.slug_ascii(F.concat_ws(" ", "a_name", "b_name"))
    a, b = text.slug_ascii(c("a_name")), text.slug_ascii(c("b_name"))
    return bouts(spark, d).select(
        "bout_key", big(names.name_score(a, b)).alias("score"), big(names.name_score(both, b)).alias("title_score")
    )


_AMERICAN = "CAST(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END * (100 + l_partkey % 900) AS BIGINT)"


@query("odds_decimal", f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, {_AMERICAN} AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 17 = 0 THEN NULL
  WHEN v > 0 THEN printf('%.2f', 1 + v / 100.0::DOUBLE) ELSE printf('%.2f', 1 + 100.0::DOUBLE / abs(v)) END AS price FROM t""")
def odds_decimal(spark, d):
    """C11"""
    sign = F.when(c("l_linenumber") % 2 == 0, "+").otherwise("-")
    line = F.when(c("l_partkey") % 17 == 0, "EVEN").otherwise(
        F.concat(sign, (100 + c("l_partkey") % 900).cast("string"))
    )
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", odds.american_to_decimal(line).alias("price")
    )


@query("prob_decimal", """SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_linenumber = 7 OR l_discount <= 0 THEN NULL ELSE printf('%.2f', 1.0::DOUBLE / l_discount) END AS price FROM lineitem""")
def prob_decimal(spark, d):
    """C12"""
    raw = F.when(c("l_linenumber") == 7, "none").otherwise(c("l_discount").cast("string"))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", odds.probability_to_decimal(raw).alias("price")
    )


@query("bucket_step", """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'n/a'
  ELSE printf('%.2f', round_even(value / 0.05::DOUBLE, 0) * 0.05::DOUBLE) END AS total FROM events""")
def bucket_step(spark, d):
    """C13"""
    raw = F.when(c("event_id") % 10 == 0, "n/a").otherwise(c("value").cast("string"))
    return table(spark, d, "events").select("event_id", odds.bucket_text(raw).alias("total"))


_DECISIONS = (
    "KO/TKO", "TKO - Punches", "Submission (RNC)", "Sub. armbar", "Decision - Split", "Draw", "No Contest", "DQ",
)


@query("method_bucket", f"""WITH t AS (SELECT event_id, lower(([{', '.join(q.lit(m) for m in _DECISIONS)}])[event_id % 8 + 1]) AS m FROM events)
SELECT event_id, CASE WHEN contains(m, 'ko') THEN 'KO/TKO' WHEN contains(m, 'submission') OR starts_with(m, 'sub') THEN 'Submission'
  WHEN contains(m, 'decision') OR m = 'draw' THEN 'Decision' ELSE 'Other' END AS bucket FROM t""")
def method_bucket(spark, d):
    """C14"""
    return table(spark, d, "events").select(
        "event_id", classify.method_bucket(pick(_DECISIONS, c("event_id") % 8)).alias("bucket")
    )


@query("prefix_class", """WITH t AS (SELECT p_partkey, (['UFC ', 'DWCS', 'LFA 7: ', 'PFL: ', 'Bellator', '', ''])[p_partkey % 7 + 1] || p_type || ': ' || p_brand AS n FROM part)
SELECT p_partkey, CASE WHEN starts_with(n, 'UFC') THEN 'UFC' WHEN starts_with(n, 'DWCS') THEN 'DWCS' WHEN starts_with(n, 'LFA') THEN 'LFA'
  WHEN starts_with(n, 'PFL') THEN 'PFL' WHEN starts_with(n, 'Bellator') THEN 'Bellator' ELSE string_split(n, ':')[1] END AS promotion FROM t""")
def prefix_class(spark, d):
    """C15"""
    prefix = pick(("UFC ", "DWCS", "LFA 7: ", "PFL: ", "Bellator", "", ""), c("p_partkey") % 7)
    name = F.concat(prefix, c("p_type"), F.lit(": "), c("p_brand"))
    return table(spark, d, "part").select("p_partkey", classify.promotion(name).alias("promotion"))


@query("code_map", """SELECT o_orderkey, CASE CASE o_orderstatus WHEN 'O' THEN 'W' WHEN 'F' THEN 'L' ELSE o_orderstatus END
  WHEN 'W' THEN '🟩 W' WHEN 'L' THEN '🟥 L' ELSE o_orderstatus END AS marker FROM orders""")
def code_map(spark, d):
    """C16"""
    status = c("o_orderstatus")
    code = F.when(status == "O", "W").when(status == "F", "L").otherwise(status)
    return table(spark, d, "orders").select("o_orderkey", classify.result_marker(code).alias("marker"))


@query("position_label", """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber - 1 AS pos,
  (['Main Card', 'Prelims', 'Early'])[l_partkey % 3 + 1] AS seg, (['main', 'prelims1', 'early'])[l_partkey % 3 + 1] AS code FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN seg = 'Main Card' AND pos = 0 THEN 'Main Event' WHEN seg = 'Main Card' AND pos = 1 THEN 'Co-Main'
  WHEN seg = 'Main Card' THEN 'Main Card' WHEN seg = 'Prelims' THEN 'Prelim' ELSE seg END AS label,
  CASE WHEN code = 'main' AND pos = 0 THEN '5 x 5' ELSE '3 x 5' END AS rounds FROM t""")
def position_label(spark, d):
    """C17"""
    pos = c("l_linenumber") - 1
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        classify.segment_label(pick(("Main Card", "Prelims", "Early"), c("l_partkey") % 3), pos).alias("label"),
        classify.rounds_label(pick(("main", "prelims1", "early"), c("l_partkey") % 3), pos).alias("rounds"),
    )


@query("phrase_dedupe", """WITH t AS (SELECT p_partkey, p_name, p_type,
  CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || p_name WHEN 1 THEN '- ' || p_name || ' Bout' WHEN 2 THEN 'Легкий вес Легкий вес' ELSE '' END AS raw FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN 'Lightweight' END AS weight_class,
  lower(p_type) AS class_key FROM t""")
def phrase_dedupe(spark, d):
    """C18"""
    key = c("p_partkey") % 4
    raw = (
        F.when(key == 0, F.concat_ws(" ", "p_name", "p_name"))
        .when(key == 1, F.concat(F.lit("- "), c("p_name"), F.lit(" Bout")))
        .when(key == 2, "Легкий вес Легкий вес")
        .otherwise("")
    )
    return table(spark, d, "part").select(
        "p_partkey",
        classify.translate_weight_class(raw).alias("weight_class"),
        classify.weight_class_key(F.concat(F.lit(" "), c("p_type"), F.lit(" - "), c("p_name"))).alias("class_key"),
    )


@query("date_parse", f"""WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderdate AS ts FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4 THEN day END AS event_date,
  CASE o_orderkey % 6 WHEN 0 THEN {q.iso_seconds('ts + INTERVAL 22 HOUR + INTERVAL 30 MINUTE')} WHEN 1 THEN {q.iso_seconds('ts')}
    WHEN 2 THEN {q.iso_seconds('ts + INTERVAL 20 HOUR')} WHEN 3 THEN {q.iso_seconds('ts + INTERVAL 27 HOUR')} END AS utc,
  CASE o_orderkey % 6 WHEN 4 THEN 'tba ' || left(day, 6) WHEN 5 THEN '2000-01-01' ELSE day END AS first_ten FROM t""")
def date_parse(spark, d):
    """C19"""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    kind = c("o_orderkey") % 6
    raw = (
        F.when(kind == 0, F.concat(day, F.lit("T22:30Z")))
        .when(kind == 1, day)
        .when(kind == 2, F.concat(day, F.lit("T23:00:00.250+03:00")))
        .when(kind == 3, F.concat(day, F.lit(" 22:00:00-05:00")))
        .when(kind == 4, F.concat(F.lit("tba "), day))
        .otherwise("")
    )
    return table(spark, d, "orders").select(
        "o_orderkey",
        dates.iso_date(raw).cast("string").alias("event_date"),
        dates.iso_seconds(dates.iso_utc(raw)).alias("utc"),
        dates.first_ten(raw, F.lit("2000-01-01")).alias("first_ten"),
    )


@query("year_infer", """WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%b') AS mon, CAST(strftime(o_orderdate, '%d') AS INTEGER) AS dd,
  month(o_orderdate) AS mm FROM orders),
u AS (SELECT *, try_cast(printf('%04d-%02d-%02d', 1998, mm, dd) AS DATE) AS y0, try_cast(printf('%04d-%02d-%02d', 1999, mm, dd) AS DATE) AS y1 FROM t)
SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL
  ELSE strftime(CASE WHEN y0 < DATE '1998-11-15' - 180 THEN y1 ELSE y0 END, '%Y-%m-%d') END AS event_date FROM u""")
def year_infer(spark, d):
    """C20"""
    raw = F.when(c("o_orderkey") % 9 == 0, F.date_format("o_orderdate", "MMMM d")).otherwise(
        F.concat(F.date_format("o_orderdate", "MMM d"), F.lit(", TBA"))
    )
    raw = F.when(c("o_orderkey") % 9 == 0, F.concat(raw, F.lit("x"))).otherwise(raw)
    reference = F.lit("1998-11-15").cast("date")
    return table(spark, d, "orders").select(
        "o_orderkey", dates.infer_year(raw, reference).cast("string").alias("event_date")
    )


_SATURDAY = "(CAST(o_orderdate AS DATE) + CAST((6 - isodow(o_orderdate) + 7) % 7 AS INTEGER))"


@query("weekend_dates", f"""SELECT o_orderkey, strftime({_SATURDAY}, '%Y-%m-%d') AS saturday,
  strftime({_SATURDAY} + 1, '%Y-%m-%d') AS sunday FROM orders""")
def weekend_dates(spark, d):
    """C21, weekend pair"""
    saturday = dates.next_saturday(F.to_date("o_orderdate"))
    return table(spark, d, "orders").select(
        "o_orderkey",
        saturday.cast("string").alias("saturday"),
        F.date_add(saturday, 1).cast("string").alias("sunday"),
    )


@query("run_mode", """SELECT o_orderkey, CASE isodow(o_orderdate) WHEN 4 THEN 'baseline' WHEN 5 THEN 'incremental'
  WHEN 6 THEN 'incremental' ELSE 'skipped' END AS mode FROM orders""")
def run_mode(spark, d):
    """C21, run mode"""
    return table(spark, d, "orders").select(
        "o_orderkey", dates.run_mode(F.to_date("o_orderdate")).alias("mode")
    )


@query("concat_parts", """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE c_name END AS loc,
  concat_ws(', ', n_name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, r_name) AS tail
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey)
SELECT c_custkey, CASE WHEN tail <> '' AND loc <> 'n/a' THEN loc || ', ' || tail ELSE loc END AS venue FROM t""")
def concat_parts(spark, d):
    """C22"""
    joined = (
        table(spark, d, "customer")
        .join(table(spark, d, "nation"), c("n_nationkey") == c("c_nationkey"), "left")
        .join(table(spark, d, "region"), c("r_regionkey") == c("n_regionkey"), "left")
    )
    location = F.when(c("c_custkey") % 5 == 0, "n/a").otherwise(c("c_name"))
    middle = F.when(c("c_custkey") % 3 == 0, "").otherwise(c("c_mktsegment"))
    return joined.select("c_custkey", venue(location, c("n_name"), middle, c("r_name")).alias("venue"))


def venue(location, *parts):
    trailing = F.concat_ws(", ", *[text.blank_to_null(p) for p in parts])
    return F.when(
        (trailing != "") & (location != "n/a"), F.concat(location, F.lit(", "), trailing)
    ).otherwise(location)


@query("record_id", f"""WITH {q.RECORDS}
SELECT record_id, CASE entity_type WHEN 'context' THEN 'ctx-' ELSE '' END || left(replace(project_key, '-', ''), 5) || '-' ||
  left(sha256(concat_ws('|', CAST(record_id AS VARCHAR), project_key, raw_input)), 8) AS id FROM records""")
def record_id(spark, d):
    """C24"""
    short = hashing.short_id(
        hashing.record_prefix(c("project_key")), c("record_id").cast("string"), c("project_key"), c("raw_input")
    )
    return records(spark, d).select(
        "record_id",
        F.when(c("entity_type") == "context", F.concat(F.lit("ctx-"), short)).otherwise(short).alias("id"),
    )


_PHRASES = ("", " Team news", " out after Surgery", " must miss weight", " steps in", " returns", " camp and recovery")
_GROUP_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(t, {q.lit(k)})" for k in keys) + f" THEN '{label}'"
    for label, keys in classify.HEADLINE_GROUPS
) + " END"


@query("keyword_first", f"""WITH x AS (SELECT doc_id, lower(text || ([{', '.join(q.lit(p) for p in _PHRASES)}])[doc_id % 7 + 1]) AS t FROM documents)
SELECT doc_id, {_GROUP_SQL} AS signal_type FROM x""")
def keyword_first(spark, d):
    """C25"""
    title = F.concat(c("text"), pick(_PHRASES, c("doc_id") % 7))
    return table(spark, d, "documents").select("doc_id", classify.headline_class(title).alias("signal_type"))


_NOTES = (
    "", " Проект: Ставки", " python api и бот", " новый рынок и стартап", " раздел : shared", " категория: код",
    " Проект: неизвестный банк", " UFC telegram",
)


def _classify_sql() -> str:
    scores = ", ".join(
        (" + ".join(f"CAST(contains(t, {q.lit(k)}) AS INTEGER)" for k in p.keywords) or "0") + f" AS s{i}"
        for i, p in enumerate(classify.PROJECTS)
    )
    aliases = " ".join(f"WHEN {q.lit(a)} THEN {q.lit(k)}" for a, k in classify.EXPLICIT_TAGS.items())
    keys = ", ".join(q.lit(p.key) for p in classify.PROJECTS)
    best = "greatest(s0, s1, s2, s3, s4)"
    by_words = " ".join(f"WHEN s{i} = {best} THEN {q.lit(p.key)}" for i, p in enumerate(classify.PROJECTS))
    return f"""WITH x AS (SELECT doc_id, lower(text || ([{', '.join(q.lit(n) for n in _NOTES)}])[doc_id % 8 + 1]) AS t FROM documents),
    y AS (SELECT doc_id, {scores}, regexp_extract(t, {q.lit(classify.TAG_PATTERN)}, 1) AS tag FROM x),
    z AS (SELECT *, CASE tag {aliases} ELSE tag END AS named FROM y)
    SELECT doc_id, CASE WHEN named IN ({keys}) THEN named WHEN {best} > 0 THEN CASE {by_words} END ELSE 'shared' END AS project_key,
      CASE WHEN named IN ({keys}) THEN 'explicit' WHEN {best} > 0 THEN 'keywords' ELSE 'fallback' END AS how FROM z"""


@query("classify_keywords", _classify_sql())
def classify_keywords(spark, d):
    """C26"""
    body = F.concat(c("text"), pick(_NOTES, c("doc_id") % 8))
    return table(spark, d, "documents").select("doc_id", classify.classify_project(body).alias("p")).select(
        "doc_id", "p.project_key", "p.how"
    )


@query("content_hash", """SELECT doc_id, sha256('{"lang":"' || lang || '","source":"' || source || '","text_hash":"' || md5(text) || '","total":' ||
  CASE WHEN doc_id % 4 = 0 THEN 'null' ELSE '"' || printf('%.2f', round_even(n_chars / 30.0::DOUBLE / 0.05::DOUBLE, 0) * 0.05::DOUBLE) || '"' END || '}') AS hash
  FROM documents""")
def content_hash(spark, d):
    """C27"""
    total = F.when(c("doc_id") % 4 != 0, odds.bucket(c("n_chars") / F.lit(30.0)))
    fields = {
        "text_hash": F.md5("text"), "source": c("source"), "lang": c("lang"), "total": total,
        "generated_at": F.current_timestamp(),
    }
    return table(spark, d, "documents").select("doc_id", hashing.content_hash(fields).alias("hash"))


@query("parallel_lookup", """WITH t AS (SELECT *, l_partkey % 4 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN k IN (0, 1) AND l_discount > 0 THEN printf('%.2f', 1.0::DOUBLE / l_discount) END AS over_1_5,
  CASE WHEN k IN (0, 3) AND l_tax > 0 THEN printf('%.2f', 1.0::DOUBLE / l_tax) END AS over_2_5 FROM t""")
def parallel_lookup(spark, d):
    """C28"""
    k = c("l_partkey") % 4

    def market(question, value, flipped, short):
        price, rest = value.cast("string"), (1 - value).cast("string")
        outcomes = F.when(flipped, F.array(F.lit("Under"), F.lit("Over"))).otherwise(
            F.array(F.lit("Over"), F.lit("Under"))
        )
        prices = F.when(short, F.array(rest)).when(flipped, F.array(rest, price)).otherwise(F.array(price, rest))
        return F.struct(
            F.lit(question).alias("question"), outcomes.alias("outcomes"), prices.alias("prices")
        )

    first = market("O/U 1.5 Rounds", c("l_discount"), k >= 1, k == 2)
    second = market("O/U 2.5 Rounds", c("l_tax"), k == 3, F.lit(False))
    noise = market("Winner", c("l_tax"), k >= 0, F.lit(False))
    markets = (
        F.when(k == 0, F.array(noise, first, second))
        .when(k == 1, F.array(first))
        .when(k == 2, F.array(first, noise))
        .otherwise(F.array(second, second))
    )
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        odds.over_price(markets, "O/U 1.5 Rounds").alias("over_1_5"),
        odds.over_price(markets, "O/U 2.5 Rounds").alias("over_2_5"),
    )


@query("error_combine", """SELECT event_id, coalesce(left(nullif(concat_ws(' | ', CASE WHEN event_id % 3 = 0 THEN 'urllib HTTP ' || (400 + event_id % 100) END,
  CASE WHEN event_id % 5 = 0 THEN repeat('x', CAST(event_id % 600 AS INTEGER)) || 'httpx' END), ''), 500), 'Unknown fetch error') AS error FROM events""")
def error_combine(spark, d):
    """C29"""
    n = c("event_id")
    first = F.when(n % 3 == 0, F.concat(F.lit("urllib HTTP "), (400 + n % 100).cast("string"))).otherwise("")
    second = F.when(n % 5 == 0, F.concat(F.expr("repeat('x', cast(event_id % 600 as int))"), F.lit("httpx")))
    return table(spark, d, "events").select("event_id", text.combine_errors(first, second).alias("error"))


_PATH = q.sub("regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)", ";[^/]*$")
_KEY = f"{q.netloc('url')} || '-' || {_PATH} || '-' || regexp_extract(url, '^[^?#]*[?]([^#]*)', 1)"


@query("url_key", f"SELECT page_id, left({q.slug(_KEY)}, 120) AS cache_key FROM pages")
def url_key(spark, d):
    """C30"""
    return table(spark, d, "pages").select("page_id", urls.cache_key(c("url")).alias("cache_key"))


@query("weekend_filter", f"""WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day,
  CAST(o_orderdate AS DATE) - CAST(o_orderkey % 10 AS INTEGER) AS ref FROM orders),
u AS (SELECT *, ref + CAST((6 - isodow(ref) + 7) % 7 AS INTEGER) AS sat FROM t)
SELECT o_orderkey, strftime(day, '%Y-%m-%d') AS event_date FROM u WHERE day BETWEEN sat AND sat + 1""")
def weekend_filter(spark, d):
    """D5"""
    day = F.to_date("o_orderdate")
    reference = F.date_sub(day, (c("o_orderkey") % 10).cast("int"))
    return table(spark, d, "orders").filter(dates.in_next_weekend(day, reference)).select(
        "o_orderkey", day.cast("string").alias("event_date")
    )


@query("term_union", f"""WITH {q.BOUTS}, t AS (SELECT bout_key, a_name || ' ' || b_name AS t1,
  string_split({q.slug('a_name')}, '-')[-1] || ' ' || string_split({q.slug('b_name')}, '-')[-1] AS t2,
  CASE WHEN bout_key % 2 = 0 THEN a_name || ' ' || b_name ELSE kind END AS t3, CASE WHEN bout_key % 3 = 0 THEN ' ' ELSE lower(kind) END AS t4 FROM bouts)
SELECT bout_key, t1 || CASE WHEN t2 <> t1 THEN '|' || t2 ELSE '' END || CASE WHEN t3 NOT IN (t1, t2) THEN '|' || t3 ELSE '' END ||
  CASE WHEN trim(t4) <> '' AND t4 NOT IN (t1, t2, t3) THEN '|' || t4 ELSE '' END AS terms FROM t""")
def term_union(spark, d):
    """H1"""
    a_last = names.last_token(names.name_tokens(c("a_name")))
    b_last = names.last_token(names.name_tokens(c("b_name")))
    event_name = F.when(c("bout_key") % 2 == 0, F.concat_ws(" ", "a_name", "b_name")).otherwise(c("kind"))
    slug_words = F.when(c("bout_key") % 3 == 0, " ").otherwise(F.lower("kind"))
    return bouts(spark, d).select(
        "bout_key",
        F.array_join(
            search_terms(
                F.concat_ws(" ", "a_name", "b_name"), F.concat_ws(" ", a_last, b_last), event_name, slug_words
            ),
            "|",
        ).alias("terms"),
    )


def search_terms(*terms):
    """Filled terms in order of first appearance."""
    stripped = F.transform(F.array(*terms), text.strip)
    return F.array_distinct(F.filter(stripped, lambda t: t != ""))

"""Sources, extraction and inbox queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ringside.functions import classify, dates, html, nodes, odds as odds_of, text
from ringside.operators import routing
from ringside.plans import sqltext as q
from ringside.plans.adapters import big, bouts, odds, pick, records, table
from ringside.plans.catalog import query
from ringside.registry import PROJECT_KEYS
from ringside.session import scratch_path
from ringside.sources import listings, payload
from ringside.sources.keyed import read_keyed
from ringside.sources.records import look_up, read_records, read_whole_texts, write_records
from ringside.sources.text_files import read_files, write_files

c = F.col


def record_rows(spark, d):
    """Records with their time as text, as they are stored."""
    return records(spark, d).withColumn("created_at", dates.iso_seconds(c("created_ts")))


@query("record_scan", f"""WITH {q.RECORDS}
SELECT record_id, project_key, entity_type, {q.iso_seconds('created_ts')} AS created_at, md5(raw_input) AS raw_hash,
  md5(normalized_text) AS text_hash, source_url FROM records""")
def record_scan(spark, d):
    """A1: write the records as JSON, scan them back."""
    path = scratch_path(spark, "records")
    write_records(
        record_rows(spark, d).select(
            "record_id", "project_key", "entity_type", "created_at", "source_url", "raw_input",
            "normalized_text", "extracted_content", "link_fetch_status", "link_fetch_error",
        ),
        path,
    )
    return read_records(spark, path).select(
        "record_id", "project_key", "entity_type", "created_at",
        F.md5("raw_input").alias("raw_hash"), F.md5("normalized_text").alias("text_hash"), "source_url",
    )


@query("record_lookup", """WITH r AS (SELECT DISTINCT CASE WHEN doc_id % 4 = 3 THEN -doc_id ELSE doc_id END AS doc_id FROM labels)
SELECT r.doc_id, x.doc_id IS NOT NULL AS found, x.lang FROM r LEFT JOIN documents x ON x.doc_id = r.doc_id""")
def record_lookup(spark, d):
    """A2"""
    wanted = F.when(c("doc_id") % 4 == 3, -c("doc_id")).otherwise(c("doc_id"))
    requests = table(spark, d, "labels").select(wanted.alias("doc_id")).distinct()
    return look_up(requests, table(spark, d, "documents").select("doc_id", "lang"), "doc_id")


_TAG = '<script id="__NEXT_DATA__" type="application/json" crossorigin="anonymous">'


def _order_payload():
    return F.to_json(
        F.struct(
            big(c("o_orderkey")).alias("id"),
            F.struct(
                c("o_orderstatus").alias("status"),
                F.concat(c("o_orderpriority"), F.lit(' "{}" \\ end')).alias("priority"),
            ).alias("content"),
        )
    )


_PAYLOAD = "id bigint, content struct<status:string,priority:string>"
_PAYLOAD_SQL = """SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority || ' "{}" \\ end' AS priority FROM orders"""


@query("embedded_json", _PAYLOAD_SQL)
def embedded_json(spark, d):
    """A5, by script tag"""
    page = F.concat(
        F.lit("<html><script>var a={x:1};</script>" + _TAG), _order_payload(), F.lit("</script></html>")
    )
    body = table(spark, d, "orders").select(page.alias("html"))
    parsed = F.from_json(payload.tagged_json(c("html"), _TAG), _PAYLOAD)
    return body.select(parsed.alias("p")).select("p.id", "p.content.status", "p.content.priority")


@query("embedded_marker", _PAYLOAD_SQL)
def embedded_marker(spark, d):
    """A5, by marker and balanced braces"""
    page = F.concat(
        F.lit('<html><script>var a={"x":1};</script><script>var key="segMeta" + {;</script><script>window.d={"skip":"}{","page":{"wrap":'),
        _order_payload(),
        F.lit(',"segMeta":{"n":1}}};done();</script></html>'),
    )
    found = payload.enclosing_json('"segMeta"')(payload.scripts_with(c("html"), '"segMeta"'))
    parsed = F.from_json(found, f"page struct<wrap:struct<{_PAYLOAD.replace('id bigint', 'id:bigint').replace('content struct', 'content:struct')}>>")
    return (
        table(spark, d, "orders").select(page.alias("html")).select(parsed.alias("p"))
        .select("p.page.wrap.id", "p.page.wrap.content.status", "p.page.wrap.content.priority")
    )


@query("nested_flatten", """WITH o AS (SELECT o_orderkey, o_orderpriority, o_orderkey % 3 + 1 AS n0, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 2 + 1 END AS n1 FROM orders),
m AS (SELECT *, 0 AS segment_pos, unnest(range(n0)) AS match_pos FROM o UNION ALL SELECT *, 1, unnest(range(n1)) FROM o)
SELECT o_orderkey, CAST(segment_pos AS BIGINT) AS segment_pos, match_pos, o_orderkey || '-' || segment_pos || '-' || match_pos AS match_id,
  CASE WHEN segment_pos = 1 THEN 'Prelim' WHEN match_pos = 0 THEN 'Main Event' WHEN match_pos = 1 THEN 'Co-Main' ELSE 'Main Card' END AS label,
  CASE WHEN segment_pos = 0 AND match_pos = 0 THEN '5 x 5' ELSE '3 x 5' END AS rounds,
  'A' || match_pos AS side_a, o_orderpriority AS side_b, CAST(n0 + n1 AS BIGINT) AS confirmed FROM m""")
def nested_flatten(spark, d):
    """A6, F7"""
    key = c("o_orderkey")

    def matches(seg: int, n):
        return F.transform(
            F.sequence(F.lit(0), n.cast("int") - 1),
            lambda i: F.struct(
                F.concat_ws("-", key.cast("string"), F.lit(str(seg)), i.cast("string")).alias("id"),
                F.lit("Lightweight").alias("nte"),
                F.struct(F.concat(F.lit("A"), i.cast("string")).alias("name")).alias("awy"),
                F.struct(c("o_orderpriority").alias("name")).alias("hme"),
            ),
        )

    def segment(hdr, nm, mtchs):
        return F.struct(F.lit(hdr).alias("hdr"), F.lit(nm).alias("nm"), mtchs.alias("mtchs"))

    segments = F.array(
        segment("Main Card", "main", matches(0, key % 3 + 1)),
        segment("Prelims", "prelims1", F.when(key % 5 != 0, matches(1, key % 2 + 1))),
    )
    flat = payload.flatten_card(table(spark, d, "orders").select("o_orderkey", segments.alias("segments")), ["o_orderkey"])
    return flat.select(
        "o_orderkey", big(c("segment_pos")).alias("segment_pos"), big(c("match_pos")).alias("match_pos"),
        c("match.id").alias("match_id"),
        classify.segment_label(c("hdr"), c("match_pos")).alias("label"),
        classify.rounds_label(c("nm"), c("match_pos")).alias("rounds"),
        c("match.awy.name").alias("side_a"), c("match.hme.name").alias("side_b"),
        big(c("confirmed")).alias("confirmed"),
    )


def feeds(spark, d):
    """One feed per card, at most twelve bouts: a query without data, one whose pages are no list, and two with pages.

    Some events come twice, some lack a slug, a title or a list of markets.
    """
    key = c("bout_key")

    def market(question, price, flipped):
        over, under = F.format_string("%.2f", price), F.format_string("%.2f", 1 - price)
        return F.struct(
            F.lit(question).alias("question"),
            F.when(flipped, F.array(F.lit("Under"), F.lit("Over"))).otherwise(F.array(F.lit("Over"), F.lit("Under"))).alias("outcomes"),
            F.when(flipped, F.array(under, over)).otherwise(F.array(over, under)).alias("outcomePrices"))

    def event(title):
        markets = F.array(market("Winner", F.lit(0.5), key < 0), market("O/U 1.5 Rounds", (1 + key % 80) / 100, key % 3 == 0),
                          market("O/U 2.5 Rounds", (1 + key % 60) / 100, key % 3 == 1))
        return F.struct(
            F.when(key % 10 != 3, F.concat(F.lit("e-"), key)).alias("slug"), title.alias("title"),
            F.when(key % 10 != 7, markets).alias("markets"))

    names = F.concat_ws(" vs. ", "a_name", "b_name")
    one = event(F.when(key % 10 != 5, names).otherwise(""))
    again = event(F.concat(F.lit("again "), names))
    rows = bouts(spark, d).select("card", F.struct("pos", one.alias("one"), again.alias("again")).alias("r")).groupBy("card").agg(
        F.array_sort(F.collect_list("r")).alias("rs"))
    early, late = F.filter("rs", lambda r: r["pos"] < 6), F.filter("rs", lambda r: r["pos"] >= 6)

    def page(items, which):
        return F.struct(F.transform(items, lambda r: r[which]).alias("events"))

    def body(data):
        return F.struct(F.struct(data.alias("data")).alias("state"))

    queries = [
        F.lit('{"state":{}}'), F.lit('{"state":{"data":{"pages":"none"}}}'),
        F.to_json(body(F.struct(F.array(page(late, "one")).alias("pages")))),
        F.to_json(body(F.struct(F.array(page(early, "one"), page(F.slice("rs", 1, 0), "one"), page("rs", "again")).alias("pages")))),
    ]
    return rows.select("card", F.concat(
        F.lit('{"props":{"pageProps":{"dehydratedState":{"queries":['), F.concat_ws(",", *queries), F.lit("]}}}}")).alias("body"))


@query("market_events", f"""WITH {q.BOUTS}, e AS (SELECT card, bout_key, CASE WHEN pos >= 6 THEN 2 ELSE 3 END AS query_pos, 0 AS page_pos,
    row_number() OVER (PARTITION BY card, pos >= 6 ORDER BY pos) - 1 AS event_pos, CASE WHEN bout_key % 10 = 5 THEN '' ELSE a_name || ' vs. ' || b_name END AS title FROM bouts
  UNION ALL SELECT card, bout_key, 3, 2, row_number() OVER (PARTITION BY card ORDER BY pos) - 1, 'again ' || a_name || ' vs. ' || b_name FROM bouts),
f AS (SELECT *, row_number() OVER (PARTITION BY card, bout_key ORDER BY query_pos, page_pos, event_pos) AS rn FROM e
  WHERE title <> '' AND bout_key % 10 NOT IN (3, 7))
SELECT card, query_pos, page_pos, event_pos, 'e-' || bout_key AS slug, title,
  printf('%.2f', 1.0::DOUBLE / CAST(printf('%.2f', (1 + bout_key % 80) / 100.0::DOUBLE) AS DOUBLE)) AS over_1_5,
  printf('%.2f', 1.0::DOUBLE / CAST(printf('%.2f', (1 + bout_key % 60) / 100.0::DOUBLE) AS DOUBLE)) AS over_2_5 FROM f WHERE rn = 1""")
def market_events(spark, d):
    """Queries, pages and events of a feed as variants, and the prices looked up in the markets of each event"""
    events = payload.market_events(feeds(spark, d), ["card"])
    prices = payload.market_prices(c("markets"))
    return events.select(
        "card", *[big(c(p)).alias(p) for p in ("query_pos", "page_pos", "event_pos")], "slug", "title",
        odds_of.over_price(prices, "O/U 1.5 Rounds").alias("over_1_5"), odds_of.over_price(prices, "O/U 2.5 Rounds").alias("over_2_5"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    """A6, flat payload"""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


_ANCHOR = r'(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>'
_ANCHORS_SQL = f"""a0 AS (SELECT page_id, regexp_extract_all(html, {q.lit(_ANCHOR)}) AS xs FROM pages),
a1 AS (SELECT page_id, xs, unnest(range(len(xs))) AS pos FROM a0),
a AS (SELECT page_id, pos, regexp_extract(xs[pos + 1], '(?is)^<a\\s[^>]*?href="([^"]*)"', 1) AS href,
  {q.collapse(q.sub('xs[pos + 1]', '(?s)<[^>]+>', ' '))} AS text FROM a1)"""


@query("page_links", f"WITH {_ANCHORS_SQL} SELECT page_id, pos, href, text FROM a")
def page_links(spark, d):
    """A7, links"""
    return (
        table(spark, d, "pages").select("page_id", F.posexplode(html.anchors(c("html"))).alias("pos", "a"))
        .select("page_id", big(c("pos")).alias("pos"), "a.href", "a.text")
    )


def one_page(rows, key: str, order: str, piece, head: str, tail: str):
    """One page per key: the pieces of its rows in order between head and tail. A page has a fixed number of rows."""
    listed = rows.select(key, F.struct(order, piece.alias("piece")).alias("r_")).groupBy(key).agg(
        F.array_sort(F.collect_list("r_")).alias("r_"))
    body = F.array_join(F.transform("r_", lambda r: r["piece"]), "\n")
    return listed.select(key, F.concat(F.lit(head), body, F.lit(tail)).alias("html"))


@query("schedule_rows", """WITH t AS (SELECT o_orderkey, o_orderkey // 32 AS page, o_orderkey // 2 AS url_key, o_orderdate, o_orderpriority,
  CAST(strftime(o_orderdate, '%d') AS INTEGER) AS dd, month(o_orderdate) AS mm FROM orders WHERE o_orderkey % 7 <> 6 AND o_orderkey % 13 <> 4),
f AS (SELECT *, row_number() OVER (PARTITION BY page, url_key ORDER BY o_orderkey) AS rn FROM t),
y AS (SELECT *, try_cast(printf('%04d-%02d-%02d', 1998, mm, dd) AS DATE) AS y0, try_cast(printf('%04d-%02d-%02d', 1999, mm, dd) AS DATE) AS y1 FROM f WHERE rn = 1)
SELECT page, 'https://www.example.com/mma/fightcenter/_/id/' || url_key AS event_url,
  strftime(CASE WHEN y0 < DATE '1998-11-15' - 180 THEN y1 ELSE y0 END, '%Y-%m-%d') AS event_date, 'Event <' || o_orderkey || '>' AS event_name,
  '7 PM' AS event_time, CASE WHEN o_orderkey % 5 = 0 THEN 'TVAB' ELSE 'TV' END AS broadcast, o_orderpriority AS location
FROM y WHERE o_orderkey % 11 <> 0 AND CASE WHEN y0 < DATE '1998-11-15' - 180 THEN y1 ELSE y0 END IS NOT NULL""")
def schedule_rows(spark, d):
    """A7, table rows of whole pages: five cells and a link, first row per link of a page, then a valid date

    Some cells hold a table of their own, some end tags are missing, some rows are too short or have no link to an event.
    """
    key = c("o_orderkey")
    day = F.when(key % 11 == 0, "TBA").otherwise(F.date_format("o_orderdate", "MMM d"))
    path = F.when(key % 13 == 4, "/mma/story/_/id/").otherwise("/mma/fightcenter/_/id/")
    inner = F.when(key % 5 == 0, "<table><tr><td>A</td><td>B</td></tr></table>").otherwise("")
    end = F.when(key % 3 == 0, "").otherwise("</td>")
    row = F.concat(
        F.lit("<tr><td>"), day, end, F.lit("<TD>7 PM"), end, F.lit("<td>TV"), inner, end, F.lit("<td class=x><a href='"), path,
        F.expr("o_orderkey div 2").cast("string"), F.lit("'>Event <b>&lt;"), key.cast("string"), F.lit("&gt;</b></a>"), end,
        F.when(key % 7 == 6, "").otherwise(F.concat(F.lit("<td> "), c("o_orderpriority"), F.lit(" <br>"), end)),
        F.when(key % 4 == 0, "").otherwise("</tr>"),
    )
    orders = table(spark, d, "orders").select("o_orderkey", F.expr("o_orderkey div 32").alias("page"), row.alias("row"))
    pages = one_page(
        orders, "page", "o_orderkey", c("row"),
        "<html><body><table><tr><td><div>UFC</div><table class=Table><thead><tr><th>Date</thead><tbody>", "</table></table>")
    found = listings.schedule(
        pages, "page", c("html"), F.lit("1998-11-15").cast("date"), F.lit("https://www.example.com/mma/schedule"))
    return found.drop("pos").withColumn("event_date", c("event_date").cast("string"))


@query("article_rows", f"""WITH a AS (SELECT doc_id, doc_id // 8 AS page, doc_id % 8 AS n, {q.strip("text || '  Team'")} AS title FROM documents
  WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0),
p AS (SELECT doc_id // 8 AS page, doc_id, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT page, pos, md5(title) AS title_hash, length(title) AS n_chars, CASE doc_id % 3 WHEN 0 THEN 'https://www.example.com/a/' WHEN 1
  THEN 'https://www.example.com/news/a/' ELSE 'https://m.example.org/a/' END || doc_id AS url,
  CASE WHEN doc_id % 2 = 0 THEN doc_id || 'h' ELSE '' END AS published FROM a JOIN p USING (page, doc_id)""")
def article_rows(spark, d):
    """A7, articles of whole pages: title and link needed, links made absolute; the title is the whole text"""
    key = c("doc_id")
    escaped = F.replace(F.replace(c("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    path = F.when(key % 3 == 0, "/a/").when(key % 3 == 1, "a/").otherwise("//m.example.org/a/")
    node = F.concat(
        F.lit("<article class='contentItem x'><div><h2 class=\"big contentItem__title\"><i>"),
        F.when(key % 5 == 0, "</i>").otherwise(F.concat(escaped, F.lit("</i> Team"))), F.lit("</h2>"),
        F.when(key % 7 == 0, "<a name=x>").otherwise(
            F.concat(F.lit("<a name=x></a><p>by <a href="), path, key.cast("string"), F.lit(">go</a><a href=/b>more</a>"))),
        F.when(key % 2 == 0, F.concat(F.lit("<span class='t time-elapsed'>"), key.cast("string"), F.lit("h</span>"))).otherwise(""),
        F.lit("</div></article>"),
    )
    docs = table(spark, d, "documents").select("doc_id", F.expr("doc_id div 8").alias("page"), node.alias("node"))
    pages = one_page(docs, "page", "doc_id", c("node"), "<body><article class=other><h2>no</h2></article>", "</body>")
    found = listings.articles(pages, "page", c("html"), F.lit("https://www.example.com/news/"))
    return found.select(
        "page", big(c("pos")).alias("pos"), F.md5("title").alias("title_hash"), big(F.length("title")).alias("n_chars"), "url", "published")


@query("page_articles", r"""WITH a AS (SELECT page_id, regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) AS body, html FROM pages),
h AS (SELECT *, regexp_extract(body, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h1 FROM a WHERE regexp_matches(html, '(?i)<article'))
SELECT page_id, trim(replace(regexp_replace(h1, '<[^>]+>', '', 'g'), '&amp;', '&')) AS title,
  CAST(len(regexp_extract_all(body, '(?i)<p[ >]')) AS BIGINT) AS n_paragraphs, CAST(len(regexp_extract_all(body, '(?i)<a\s')) AS BIGINT) AS n_links,
  CAST(len(regexp_extract_all(regexp_extract(html, '(?is)<nav>(.*?)</nav>', 1), '(?i)<li>')) AS BIGINT) AS n_menu FROM h""")
def page_articles(spark, d):
    """A7, the articles of ``pages``: heading, paragraphs and links inside, entries of the menu outside"""
    page = c("page")
    scanned = table(spark, d, "pages").select("page_id", nodes.scan(c("html"), ("href",)).alias("page"))
    menu = nodes.first(nodes.select(page, nodes.is_tag("nav")))
    found = F.transform(
        nodes.select(page, nodes.is_tag("article")),
        lambda a: F.struct(
            nodes.in_one_line(nodes.text(page, nodes.first(nodes.inside(page, a, nodes.is_tag("h1"))))).alias("title"),
            big(F.size(nodes.inside(page, a, nodes.is_tag("p")))).alias("n_paragraphs"),
            big(F.size(nodes.inside(page, a, nodes.is_tag("a")))).alias("n_links"),
            big(F.size(nodes.inside(page, menu, nodes.is_tag("li")))).alias("n_menu"),
        ),
    )
    return scanned.select("page_id", F.explode(found).alias("a")).select("page_id", "a.*")


@query("page_paragraphs", """WITH t AS (SELECT page_id, regexp_extract_all(html, '(?is)<p>(.*?)</p>', 1) AS xs FROM pages),
u AS (SELECT page_id, xs, unnest(range(len(xs))) AS pos FROM t)
SELECT page_id, pos, length(xs[pos + 1]) AS n_chars, md5(xs[pos + 1]) AS body_hash FROM u""")
def page_paragraphs(spark, d):
    """A8, paragraphs"""
    return (
        table(spark, d, "pages")
        .select("page_id", F.posexplode(html.blocks(c("html"), "p")).alias("pos", "body"))
        .select("page_id", big(c("pos")).alias("pos"), big(F.length("body")).alias("n_chars"), F.md5("body").alias("body_hash"))
    )


@query("odds_rows", f"""WITH {q.ODDS} SELECT card, row_index, a_name, a_american, b_name, b_american FROM odds
WHERE bout_key % 11 <> 0 AND bout_key % 13 <> 0 AND bout_key % 17 <> 0""")
def odds_rows(spark, d):
    """A8, pairs of name and price"""
    key = c("bout_key")
    # Signs and blanks come as character references in some rows.
    price = F.when(key % 4 == 1, F.replace(c("a_american"), F.lit("+"), F.lit("&#43;"))).otherwise(c("a_american"))
    a = F.concat(c("a_name"), F.when(key % 3 == 1, "&nbsp;").otherwise(" "), price)
    b = F.concat_ws("  ", F.concat(F.lit("<i>"), c("b_name"), F.lit("</i>")), c("b_american"))
    para = (
        F.when(key % 11 == 0, F.concat(F.lit("<p><strong>Card</strong><br />"), a, F.lit("</p>")))
        .when(key % 13 == 0, F.concat(F.lit("<p>"), a, F.lit("<br>x<br>"), b, F.lit("</p>")))
        .when(key % 17 == 0, F.concat(F.lit("<p>"), c("a_name"), F.lit(" +15<br/>"), b, F.lit("</p>")))
        .otherwise(F.concat(F.lit("<P>"), a, F.lit("<br /> \n"), b, F.lit("</P>")))
    )
    page = F.concat(F.lit("<div><p>Opening odds</p>"), para, F.lit("</div>"))
    return (
        odds(spark, d).select("card", "row_index", page.alias("html"))
        .select("card", "row_index", F.explode(html.paragraph_pair(c("html"))).alias("r"))
        .select("card", "row_index", "r.*")
    )


@query("zip_card", f"""WITH {q.BOUTS}, n AS (SELECT *, row_number() OVER (PARTITION BY card ORDER BY pos) - 1 AS nth FROM bouts)
SELECT card, nth AS pos, 'b-' || bout_key AS bout_id, a_name, b_name,
  CASE bout_key % 4 WHEN 0 THEN 'Lightweight' WHEN 1 THEN 'Catchweight' WHEN 2 THEN 'Heavyweight' ELSE 'n/a' END AS weight_class,
  CASE WHEN nth < 5 THEN 'Main Card' WHEN nth < 9 THEN 'Prelim' ELSE 'Early Prelim' END AS card_segment
FROM n WHERE card % 5 <> 3""")
def zip_card(spark, d):
    """A10: names from the ticker of a card page, the rest from its fights; pages with a fight too few give nothing"""
    key, at = c("bout_key"), c("at")

    def corner(part: str, name):
        return F.concat(F.lit(f'<div class="t {part}"> <b>'), name, F.lit("</b></div>"))

    order = F.row_number().over(Window.partitionBy("card").orderBy("pos")) - 1
    listed = bouts(spark, d).withColumn("at", order)
    label = (
        F.when(key % 4 == 0, "<i>Легкий вес</i>").when(key % 4 == 1, "Catchweight Bout").when(key % 4 == 2, "Heavyweight Heavyweight")
        .otherwise("")
    )
    heading = F.when(at == 0, "<h3>Main Card</h3>\n").when(at == 5, "<h3> Prelims</h3>\n").when(at == 9, "<h3>Early Prelims</h3>\n").otherwise("")
    fight = F.when((c("card") % 5 == 3) & (at == 0), "").otherwise(F.concat(
        heading, F.lit("<div class='c-listing-fight' data-fmid='b-"), key.cast("string"),
        F.lit("'><div>x<div class=c-listing-fight__class-text>\n"), label, F.lit("</div></div></div>")))
    # fights go from the main event down, the ticker the other way round
    ticker = F.concat(corner(listings.RED, c("a_name")), corner(listings.BLUE, c("b_name")))
    parts = listed.select("card", F.struct("at", fight.alias("fight"), ticker.alias("ticker")).alias("r")).groupBy("card").agg(
        F.array_sort(F.collect_list("r")).alias("rs"))
    pages = parts.select("card", F.concat(
        F.lit("<body><h3>Fight Card</h3>\n"), F.array_join(F.transform(F.reverse("rs"), lambda r: r["ticker"]), ""), F.lit("\n"),
        F.array_join(F.transform("rs", lambda r: r["fight"]), "\n"), F.lit("</body>")).alias("html"))
    return listings.card(pages, "card", c("html")).withColumn("pos", big(c("pos")))


# ---------------------------------------------------------------- inbox

_INBOX_SQL = f"""{q.RECORDS},
inbox AS (SELECT record_id, entity_type, project_key, raw_input, normalized_text, created_ts,
  CASE WHEN record_id % 11 = 0 THEN 'broken json' WHEN record_id % 13 = 0 THEN 'missing project_key'
    WHEN record_id % 17 = 0 THEN 'Unknown project_key: other' END AS error_reason FROM records)"""


def inbox(spark, d, **json_options):
    """Inbox records as JSON text; some broken, some with a wrong project."""
    key = c("record_id")
    project = F.when(key % 13 == 0, None).when(key % 17 == 0, "other").otherwise(c("project_key"))
    body = F.to_json(
        F.struct(
            "entity_type", project.alias("project_key"),
            F.when(key % 3 == 0, "").otherwise(F.substring(text.collapse_spaces(c("raw_input")), 1, 80)).alias("title"),
            "raw_input", "normalized_text", F.lit("text").alias("source_type"),
            dates.iso_seconds(c("created_ts")).alias("created_at"), "source_url",
            F.when(key % 4 == 0, F.concat(F.lit("r-"), (key % 100).cast("string"))).alias("remote_id"),
        ),
        json_options,
    )
    broken = F.concat(F.substring(body, 1, 60), F.lit("\x01"))
    return records(spark, d).select(
        "record_id", "entity_type", F.when(key % 11 == 0, broken).otherwise(body).alias("line")
    )


def parsed_inbox(spark, d):
    return routing.with_error_reason(
        inbox(spark, d).withColumn("record", routing.parse_inbox(c("line")))
    )


@query("inbox_quarantine", f"""WITH {_INBOX_SQL}
SELECT record_id, CASE WHEN error_reason IS NULL THEN 'imported' ELSE 'failed' END AS outcome, error_reason,
  CASE WHEN error_reason IS NULL THEN project_key END AS project_key FROM inbox""")
def inbox_quarantine(spark, d):
    """B4"""
    ok = c("error_reason").isNull()
    return parsed_inbox(spark, d).select(
        "record_id", F.when(ok, "imported").otherwise("failed").alias("outcome"), "error_reason",
        F.when(ok, c("record.project_key")).alias("project_key"),
    )


@query("inbox_stats", f"""WITH {_INBOX_SQL}
SELECT entity_type, CASE WHEN error_reason IS NOT NULL THEN 'failed' WHEN entity_type = 'idea' THEN 'imported_ideas' ELSE 'imported_contexts' END AS outcome,
  count(*) AS n FROM inbox GROUP BY ALL""")
def inbox_stats(spark, d):
    """F2"""
    return routing.outcome_counts(parsed_inbox(spark, d))


_TITLE_SQL = f"""CASE WHEN record_id % 3 = 0 THEN coalesce(nullif(normalized_text, ''), nullif(raw_input, ''), entity_type)
  ELSE coalesce(nullif(left({q.collapse('raw_input')}, 80), ''), nullif(normalized_text, ''), nullif(raw_input, ''), entity_type) END"""


def _wide(x: str) -> str:
    kept = q.sub(q.sub(f"lower({q.strip(x)})", q.WS + "+", "-"), r"(?i)[^a-zа-я0-9\-_]+", "-")
    return f"coalesce(nullif(trim({kept}, '-'), ''), 'item')"


_DIRS = " ".join(
    f"WHEN project_key = {q.lit(p.key)} THEN CASE entity_type WHEN 'idea' THEN {q.lit(p.idea_dir)} ELSE {q.lit(p.context_dir)} END"
    for p in classify.PROJECTS
)


TARGET_SQL = f"""t AS (SELECT *, {_TITLE_SQL} AS title FROM inbox WHERE error_reason IS NULL),
p AS (SELECT record_id, CASE {_DIRS} END || '/' || strftime(created_ts, '%Y-%m-%d') || '-' ||
  CASE WHEN record_id % 4 = 0 THEN 'r-' || (record_id % 100) ELSE left({_wide('title')}, 16) END || '.md' AS target FROM t)"""


@query("route_targets", f"""WITH {_INBOX_SQL}, {TARGET_SQL}
SELECT target, max(record_id) AS record_id FROM p GROUP BY target""")
def route_targets(spark, d):
    """The last record for a target name wins"""
    good = parsed_inbox(spark, d).filter(c("error_reason").isNull())
    named = good.select(
        "record_id", routing.target_path("record", c("entity_type"), F.lit("1970-01-01")).alias("target")
    )
    return routing.last_writer_wins(named, "target", ["record_id"]).select("target", "record_id")


_EXPORT_SQL = f"""{q.RECORDS},
t AS (SELECT *, entity_type || '-' || project_key || '-' || coalesce(nullif(left({q.sub("lower(coalesce(nullif(normalized_text, ''), nullif(raw_input, ''), 'item'))", '[^a-z0-9]')}, 24), ''), 'item') AS remote_id FROM records)"""


def export_rows(spark, d):
    suffix = text.safe_suffix(c("normalized_text"), c("raw_input"))
    return record_rows(spark, d).withColumn("source_type", F.lit("text")).withColumn(
        "remote_id", F.concat_ws("-", "entity_type", "project_key", suffix)
    )


@query("export_payload", f"""WITH {_EXPORT_SQL},
l AS (SELECT *, row_number() OVER (PARTITION BY entity_type, remote_id ORDER BY record_id DESC) AS rn FROM t)
SELECT remote_id, entity_type, project_key, md5(raw_input) AS raw_hash, source_url,
  coalesce(nullif(left({q.collapse("coalesce(nullif(normalized_text, ''), nullif(raw_input, ''), 'Без названия')")}, 80), ''), 'Без названия') AS title,
  len(regexp_extract_all(coalesce(nullif(raw_input, ''), normalized_text), 'https?://\\S+')) AS n_links, {q.iso_seconds('created_ts')} AS created_at,
  link_fetch_status, link_fetch_error, 'incoming/' || entity_type || 's/' || remote_id || '.json' AS target
FROM l WHERE rn = 1""")
def export_payload(spark, d):
    """B2"""
    latest = routing.latest_state(export_rows(spark, d), ["entity_type", "remote_id"], ["record_id"])
    return routing.export_payload(latest).select(
        "remote_id", "entity_type", "project_key", F.md5("raw_input").alias("raw_hash"), "source_url", "title",
        big(F.size("links")).alias("n_links"), "created_at", "link_fetch_status", "link_fetch_error",
        F.concat(F.lit("incoming/"), c("entity_type"), F.lit("s/"), c("remote_id"), F.lit(".json")).alias("target"),
    )


@query("export_roundtrip", f"""WITH {_EXPORT_SQL},
w AS (SELECT *, row_number() OVER (PARTITION BY entity_type, remote_id ORDER BY record_id % 3 = 1 DESC, record_id DESC) AS rn FROM t)
SELECT entity_type, remote_id, project_key, md5(raw_input) AS raw_hash FROM w WHERE rn = 1""")
def export_roundtrip(spark, d):
    """B2: an export, a second one over it, and what is stored then: the second wins its keys, all others stay"""
    path, rows = scratch_path(spark, "export"), export_rows(spark, d)
    again = c("record_id") % 3 == 1
    for part in (rows.filter(~again), rows.filter(again)):
        routing.write_export(routing.export_payload(routing.latest_state(part, ["entity_type", "remote_id"], ["record_id"])), path)
    stored = read_keyed(spark, path, "entity_type string, remote_id string, project_key string, raw_input string")
    return stored.select("entity_type", "remote_id", "project_key", F.md5("raw_input").alias("raw_hash"))


@query("text_files", """SELECT doc_id || '.md' AS file_name, md5(coalesce(text, '')) AS body_hash FROM documents""")
def text_files(spark, d):
    """A4: whole text files; a folder that does not exist adds none"""
    path = scratch_path(spark, "texts")
    docs = table(spark, d, "documents").select(
        F.lit("texts").alias("folder"), F.concat(c("doc_id").cast("string"), F.lit(".md")).alias("file_name"),
        F.coalesce("text", F.lit("")).alias("body"),
    )
    write_files(docs, path)
    found = read_whole_texts(spark, f"{path}/texts").unionByName(read_whole_texts(spark, f"{path}/absent"))
    return found.select(F.substring_index("file_path", "/", -1).alias("file_name"), F.md5("body").alias("body_hash"))


@query("text_source", """SELECT 'f' || doc_id % 3 AS folder, doc_id || '.md' AS file_name,
  md5(CASE WHEN doc_id % 4 = 1 THEN 'again ' ELSE '' END || coalesce(text, '')) AS body_hash FROM documents""")
def text_source(spark, d):
    """A4, B2: files written by a source with commit, a second job over some of them, read back in groups of files"""
    path, key = scratch_path(spark, "source"), c("doc_id")
    docs = table(spark, d, "documents").select(
        key, F.concat(F.lit("f"), key % 3).alias("folder"), F.concat(key.cast("string"), F.lit(".md")).alias("file_name"),
        F.coalesce("text", F.lit("")).alias("body"))
    write_files(docs, path)
    write_files(docs.filter(key % 4 == 1).withColumn("body", F.concat(F.lit("again "), "body")), path)
    return read_files(spark, path).select("folder", "file_name", F.md5("body").alias("body_hash"))

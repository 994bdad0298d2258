"""Pages as nodes, listings, market feeds and nested reports on hand-made cases."""

import datetime
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from ringside.functions import hashing, nodes
from ringside.functions.nodes import Scanner
from ringside.operators import changes
from ringside.sources import listings, payload

c = F.col


def tree(page, attributes=("class", "href"), holders=("tr", "article")):
    scanner = Scanner(frozenset(attributes), holders)
    scanner.read(page)
    return scanner


def outline(page):
    scanner = tree(page)
    return [(n["tag"], n["up"], "".join(scanner.texts[n["text"] : n["text_end"]])) for n in scanner.nodes]


def test_elements_end_where_the_next_one_starts():
    assert outline("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == [
        ("ul", None, "abcd"), ("li", 0, "a"), ("li", 0, "bc"), ("ul", 2, "c"), ("li", 3, "c"), ("li", 0, "d")]
    assert outline("<p>one<p>two<div>x</div></p>three") == [("p", None, "one"), ("p", None, "two"), ("div", None, "x")]
    assert outline("<div><span>a</div>b<b>c") == [("div", None, "a"), ("span", 0, "a"), ("b", None, "c")]


def test_nested_tables_keep_their_rows_apart():
    scanner = tree("<table><tr><td>1<table><tr><td>in</td></tr></table>x<td>2<tr><td>3</table>")
    rows = [n for n in scanner.nodes if n["tag"] == "tr"]
    assert [sum(m["tag"] == "td" and m["up"] == r["at"] for m in scanner.nodes) for r in rows] == [2, 1, 1]
    inner = next(n for n in scanner.nodes if n["up"] == rows[1]["at"])
    assert dict(inner["within"]) == {"tr": rows[1]["at"]}


def test_attributes_references_scripts_and_comments():
    scanner = tree('<a HREF="/x?a=1&amp;b=2" href=y class=\'p q\'>go &gt; now</A><!-- <b> --><script>if(a<b)"</p>"</script ><br/><i title="a>b">k')
    assert [(n["tag"], dict(n["attrs"])) for n in scanner.nodes] == [
        ("a", {"href": "/x?a=1&b=2", "class": "p q"}), ("script", {}), ("br", {}), ("i", {})]
    assert scanner.texts == ["go > now", 'if(a<b)"</p>"', "k"]
    assert outline("a < b <3 <a 'x") == [] and outline("") == []
    assert [n["line"] for n in tree("<p>\n<b>\n\n</b><i>").nodes] == [1, 2, 4]


def test_scanning_is_linear():
    for piece in ("<b>", "</i>", "<li>", "<td><p>", "<a '", "<!-- ", '<a "', "<ul><li>", "<", "<table><tr><td>"):
        begun = time.process_time()
        tree(piece * 20_000 + ">")
        assert time.process_time() - begun < 4, piece


def test_the_scanner_ends_on_any_text():
    rng = random.Random(5)
    parts = ["<", ">", "'", '"', "/", "a", " ", "<!--", "-->", "<td>", "</td>", "<table>", "</table>", "<p>", "<script>", "</script>", "=", "&amp;"]
    for _ in range(3000):
        scanner = tree("".join(rng.choice(parts) for _ in range(rng.randint(0, 30))))
        for n in scanner.nodes:
            assert n["at"] <= n["last"] < len(scanner.nodes) and n["text"] <= n["text_end"] <= len(scanner.texts)
            assert n["up"] is None or n["up"] < n["at"] and scanner.nodes[n["up"]]["last"] >= n["last"]


def test_scanned_pages_come_in_pieces_of_bounded_nodes(spark):
    pages = [f"<table>{'<tr><td>x' * 500}<a href=p{i}>" for i in range(90)]
    sizes = [sum(len(p["nodes"]) for p in piece.to_pylist()) for piece in nodes.pieces(pa.array(pages), frozenset(("href",)), ())]
    assert len(sizes) > 3 and max(sizes) < nodes.PIECE_NODES + 1_003 and sum(sizes) == 90 * 1_002
    df = spark.createDataFrame(list(enumerate(pages)), "k int, html string").coalesce(1).withColumn("p", nodes.scan(c("html")))
    found = df.select("k", nodes.first(nodes.select(c("p"), nodes.is_tag("a")))["attrs"]["href"].alias("href")).collect()
    assert len(found) == 90 and all(r.href == f"p{r.k}" for r in found)


def test_scanned_pages_come_in_pieces_of_bounded_text(spark):
    pages = [None, "", *(f"<article>{'word ' * 100_000}{i}" for i in range(13)), None]
    found = list(nodes.pieces(pa.array(pages), frozenset(), ()))
    texts = [["".join(p["texts"]) for p in piece.to_pylist()] for piece in found]
    assert len(found) == 3 and max(sum(map(len, piece)) for piece in texts) < nodes.PIECE_CHARS + 500_010
    assert [t[-2:].strip() for piece in texts for t in piece] == ["", "", *map(str, range(13)), ""]


def test_selections_are_columns(spark):
    page = '<div class="a b"><p>x<b>y</b></p></div><div><p class=a>z</p></div>'
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, html string").select("id", nodes.scan(c("html")).alias("page"))
    p = c("page")
    got = {r.id: r for r in df.select(
        "id", F.transform(nodes.select(p, nodes.has_class("a")), lambda n: nodes.text(p, n)).alias("a"),
        F.transform(nodes.inside(p, nodes.first(nodes.select(p, nodes.is_tag("div"))), nodes.is_tag("b")), lambda n: n["at"]).alias("b"),
    ).collect()}
    assert got[1].a == ["xy", "z"] and got[1].b == [2]
    assert got[2].a == got[3].a == []


def test_schedule_needs_five_cells_and_counts_the_first_row_of_a_link(spark):
    row = lambda day, n, cells=5: "<tr><td>%s<td>1<td>2<td><a href=' /mma/fightcenter/_/id/%s '>E%s</a>%s" % (day, n, n, "<td>L" * (cells - 4))
    page = "<table>" + row("TBA", 1) + row("Jan 3", 1) + row("Jan, 4", 2, 4) + row("Dec 5", 3) + "<tr><td>no link" * 2 + "</table>" + row("Feb 30", 4)
    df = spark.createDataFrame([(1, page), (2, None)], "page int, html string")
    got = listings.schedule(df, "page", c("html"), F.lit(datetime.date(2024, 11, 1)), F.lit("https://h.example/x/y")).collect()
    assert [(r.event_url, str(r.event_date), r.event_name, r.location) for r in got] == [
        ("https://h.example/mma/fightcenter/_/id/3", "2024-12-05", "E3", "L")]


def test_addresses_are_made_absolute(spark):
    cases = [("https://a.b/c/d", "x", "https://a.b/c/x"), ("https://a.b", "x", "https://a.b/x"), ("https://a.b/c/", "/x?y", "https://a.b/x?y"),
             ("http://a.b/c", "//q.r/s", "http://q.r/s"), ("http://a.b/c?d=/e", "f", "http://a.b/f"), ("http://a.b/c", "mailto:x", "mailto:x")]
    df = spark.createDataFrame(cases, "base string, href string, want string")
    assert df.where(listings.absolute(c("base"), c("href")) != c("want")).count() == 0


def test_card_pages_with_lists_of_different_length_give_nothing(spark):
    name = lambda part, n: f'<div class="{part}">{n}</div>'
    fight = "<div class=c-listing-fight data-fmid={0}><div class=c-listing-fight__class-text>Тяжелый вес</div></div>\n"
    whole = name(listings.RED, "r2") + name(listings.RED, " r1 ") + name(listings.BLUE, "b2") + name(listings.BLUE, "b1")
    page = "<h3>x</h3>" + whole + "<h3>Main Card</h3>\n" + fight.format(1) + "<h3> Prelims </h3>\n" + fight.format(2)
    df = spark.createDataFrame([(1, page), (2, page + name(listings.RED, "more")), (3, ""), (4, None)], "card int, html string")
    got = [tuple(r) for r in listings.card(df, "card", c("html")).orderBy("card", "pos").collect()]
    assert got == [(1, 0, "1", "r1", "b1", "Heavyweight", "Main Card"), (1, 1, "2", "r2", "b2", "Heavyweight", "Prelim")]


def test_feeds_of_another_shape_give_no_rows(spark):
    feed = lambda queries: '{"props":{"pageProps":{"dehydratedState":{"queries":%s}}}}' % queries
    event = '{"slug":"%s","title":"T","markets":[{"question":"q","outcomes":["Over"],"outcomePrices":["0.5"]}]}'
    pages = '[{"state":{"data":{"pages":[{"events":[%s]},{"events":"none"},{}]}}}]'
    bodies = [None, "", "{", "[]", feed("{}"), feed("[]"), feed("[1,null,{}]"), feed('[{"state":{"data":{"pages":{"a":1}}}}]'),
              feed(pages % (event % "s" + "," + event % "s" + ',{"slug":"x","title":null,"markets":[]},{"slug":"y","title":"T","markets":{}},7'))]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got = payload.market_events(df, ["id"]).withColumn("m", payload.market_prices(c("markets"))).collect()
    assert [(r.id, r.query_pos, r.page_pos, r.event_pos, r.slug, r.m[0].prices) for r in got] == [(8, 0, 0, 0, "s", ["0.5"])]


REPORT = ("struct<generated_at:string,event:struct<name:string,place:string>,bouts:array<struct<bout_id:string,over_1_5_decimal:string,"
          "fighters:array<struct<slug:string,name:string>>>>,notes:array<string>,extra:map<string,int>>")


def report(over="1.52", name="A B", generated="t", notes=("n",), bouts=None, extra=None):
    bouts = [("b1", over, [("f1", name), ("f2", "C")])] if bouts is None else bouts
    return (generated, ("E", None), bouts, list(notes), extra or {"z": 1, "a": 2})


def test_nested_hash_ignores_order_bookkeeping_and_small_moves(spark):
    data = [(1, report()), (2, report(generated="u")), (3, report(over="1.51")), (4, report(over="1.56")), (5, report(name="A")),
            (6, report(extra={"a": 2, "z": 1})), (7, report(over="n/a")), (8, report(notes=("m",))), (9, None)]
    df = spark.createDataFrame(data, f"id int, report {REPORT}")
    hashed = {r.id: r.h for r in df.select("id", hashing.nested_hash(c("report"), df.schema["report"].dataType).alias("h")).collect()}
    assert hashed[1] == hashed[2] == hashed[3] == hashed[6]
    assert len({hashed[i] for i in (1, 4, 5, 7, 8)}) == 5 and hashed[9] is None
    exact = {r.id: r.h for r in df.select("id", hashing.nested_hash(c("report"), df.schema["report"].dataType, False).alias("h")).collect()}
    assert exact[1] == exact[2] and exact[1] != exact[3]


def test_report_differences_by_entity(spark):
    old = [(1, report()), (2, report()), (3, report()), (4, report(bouts=[])), (5, None)]
    new = [(1, report(name=" A  B ", over="1.51", generated="x")),
           (2, report(over="1.66", name="Z")), (4, report(notes=("n", "m"))), (6, report(bouts=None))]
    schema = f"id int, report {REPORT}"
    diff = changes.report_diff(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), "id")
    got = {(r.id, r.entity, r["path"], r.kind, r.old, r.new) for r in diff.where("id in (1, 2)").collect()}
    assert got == {(2, "bout", "over_1_5_decimal", "changed", "1.50", "1.65"), (2, "fighter", "name", "changed", "A B", "Z")}
    kinds = {(r.id, r.entity, r.kind) for r in diff.where("id > 2").collect()}
    assert {(3, "event", "removed"), (3, "bout", "removed"), (3, "fighter", "removed"), (4, "bout", "added"), (4, "event", "changed"),
            (6, "event", "added"), (6, "bout", "added"), (6, "fighter", "added")} <= kinds
    summary = {r.id: r for r in changes.diff_summary(diff, "id").collect()}
    assert summary[2].changed_bouts == "b1" and summary[2].changed_fighters == "f1" and not summary[2].event_changed
    assert 1 not in summary

"""Column functions on hand-computed rows."""

import html
import unicodedata

import pytest
from pyspark.sql import functions as F

from ringside.functions import classify, dates, hashing, names, odds, render, text, urls
from ringside.functions.html import html_unescape, odds_line_name, odds_line_price, paragraph_pair, readable_text

c = F.col


def one(spark, values, fn, schema="x string"):
    """Result of a column function for every value, in order."""
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, {schema}")
    return [r[0] for r in df.select(fn(c("x")).alias("y"), "i").orderBy("i").select("y").collect()]


TRICKY = [
    "Élan Vital — ½ ﬁne …", "aжb", "Łódź Ünï", "ＡＢＣ ①", "", "№ 5 ™", "ſ K", "plain text", "ẛ̣", "かな ㎏",
    "é", "  x  y 　z\x1c", "\x85a b ", "жё-Ё_ж",
]


def test_slug_follows_nfkd(spark):
    import re

    def expected(v):
        ascii_text = unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode().lower()
        return re.sub("[^a-z0-9]+", "-", ascii_text).strip("-") or "ufc-event"

    assert one(spark, TRICKY, text.slug_ascii) == [expected(v) for v in TRICKY]


def test_quick_test_covers_every_longer_form():
    import re

    quick = re.compile("[\xbc-\xbeĲ-Ͽ԰-\U0010ffff]")
    assert all(quick.match(entry[0]) for entry in text._ascii_tables()[2])


def test_white_space_is_that_of_split(spark):
    assert one(spark, TRICKY, text.collapse_spaces) == [" ".join(v.split()) for v in TRICKY]
    assert one(spark, TRICKY, text.strip) == [v.strip() for v in TRICKY]


def test_wide_slug(spark):
    values = ["Привет, Мир!", "ё a", " A  b--c_ ", "!!!"]
    assert one(spark, values, text.slug_wide) == ["привет--мир", "a", "a-b--c_", "item"]


def test_safe_ids(spark):
    assert one(spark, ["A b/c", "--", "x" * 90], text.safe_id) == ["a-b-c", "item", "x" * 80]
    assert one(spark, ["Идея ABC-1", "Идея"], lambda x: text.safe_suffix(F.lit(""), x)) == ["abc1", "item"]


def test_titles(spark):
    def title(line, url="https://www.a.com/x", extracted=""):
        return text.build_title(F.lit(line), urls.host(F.lit(url)), F.lit(extracted))

    row = spark.range(1).select(
        title("").alias("empty"), title(" a \n b ").alias("plain"), title("y" * 81).alias("long"),
        title("y" * 80).alias("fits"), title("https://www.a.com/x").alias("bare"),
        title("https://z", extracted="some  text").alias("read"),
        title("https://z", url="", extracted="").alias("nothing"),
        title("https://z", extracted="w" * 100).alias("cut"),
    ).first()
    assert row.empty == "Идея без заголовка" and row.plain == "a b"
    assert row.long == "y" * 77 + "..." and row.fits == "y" * 80
    assert row.bare == "a.com: ссылка" and row.read == "a.com: some text"
    assert row.nothing == "Ссылка без описания"
    assert row.cut == ("a.com: " + "w" * 70)[:80]


def test_labels(spark):
    row = spark.range(1).select(
        text.list_label(F.lit(" T "), F.lit(None), F.lit(""), F.lit("")).alias("plain"),
        text.list_label(F.lit(""), F.lit(""), F.lit(""), F.lit("")).alias("none"),
        text.list_label(F.lit("http://b.c/d"), F.lit(None), F.lit("b.c"), F.lit("x " * 80)).alias("link"),
        text.derive_title(F.lit(""), F.lit("  ")).alias("blank"),
    ).first()
    assert (row.plain, row.none, row.blank) == ("T", "Без названия", "Без названия")
    assert row.link == ("b.c: " + " ".join(["x"] * 80))[:60]


def test_urls(spark):
    values = ["https://www.a.b:80/p;q?x=1#f", "http://u@h.com", "no-scheme/x", "https://x.org?y=2"]
    assert one(spark, values, urls.host) == ["a.b:80", "u@h.com", "", "x.org"]
    assert one(spark, values[:1], urls.cache_key) == ["www-a-b-80-p-x-1"]
    assert one(spark, ["a https://x.y/z) http://q\nhttps://x.y/z)"], urls.extract_links) == [
        ["https://x.y/z)", "http://q", "https://x.y/z)"]]


def test_unescape_is_general(spark):
    values = ["&amp;lt; &copy &#1078; &notit; &hellip;", None]
    assert one(spark, values, html_unescape) == [html.unescape(values[0]), None]
    page = "<p>a<script>x<y</script><STYLE>b</STYLE>c&nbsp;d</p><noscript>n</noscript>"
    assert one(spark, [page], readable_text) == ["a c d"]


def test_odds_lines(spark):
    lines = ["Jon O'Neil  -150", "A +15", "B +1500 x", "C D +1234"]
    assert one(spark, lines, odds_line_price) == ["-150", "", "", "+1234"]
    assert one(spark, lines, odds_line_name) == ["Jon O'Neil", "", "", "C D"]
    page = "<p>A +100<br/>\nB -200</p><p><strong>x</strong><br>A +100</p><p>one</p>"
    coded = "<p>Jan O&#8217;Neil&nbsp;&#43;150<br>B &amp; C -200</p>"
    assert [[tuple(r) for r in rows] for rows in one(spark, [page, coded], paragraph_pair)] == [
        [("A", "+100", "B", "-200")], [("Jan O\u2019Neil", "+150", "B & C", "-200")]]


def test_name_scores(spark):
    pairs = [
        ("ana-silva", "ana-silva", 10), ("ana-maria-silva", "ana-silva", 8), ("bo-silva", "ana-silva", 4),
        ("silva-ana-x", "ana-silva", 5), ("silva-x", "ana-silva", 1), ("q", "ana-silva", 0),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, s int")
    assert df.filter(names.name_score(c("a"), c("b")) != c("s")).count() == 0


def test_odds_over_their_domain(spark):
    values = [v for v in range(-9999, 10000) if abs(v) >= 100]
    expected = [f"{1 + v / 100:.2f}" if v > 0 else f"{1 + 100 / abs(v):.2f}" for v in values]
    assert one(spark, [f"{v:+d}" for v in values], odds.american_to_decimal) == expected
    assert one(spark, ["0", "x", ""], odds.american_to_decimal) == [None, None, None]
    probabilities = [f"{k / 1000}" for k in range(1, 1001)]
    assert one(spark, probabilities, odds.probability_to_decimal) == [f"{1 / float(p):.2f}" for p in probabilities]
    assert one(spark, ["0", "-1", "n/a"], odds.probability_to_decimal) == [None, None, None]


def test_buckets(spark):
    values = [f"{k / 100:.2f}" for k in range(100, 5001)]
    expected = [f"{round(float(v) / 0.05) * 0.05:.2f}" for v in values]
    assert one(spark, values, odds.bucket_text) == expected
    assert one(spark, ["n/a", "abc"], odds.bucket_text) == ["n/a", "abc"]


def test_dates(spark):
    values = ["2024-02-29T23:30:00-05:00", "2024-02-30", "20240101", "2024-01-01T10:00Z", None]
    assert [str(d) if d else None for d in one(spark, values, dates.iso_date)] == [
        "2024-02-29", None, None, "2024-01-01", None]
    assert one(spark, values[:1] + values[3:4], lambda x: dates.iso_seconds(dates.iso_utc(x))) == [
        "2024-03-01T04:30:00", "2024-01-01T10:00:00"]
    reference = F.lit("2024-11-15").cast("date")
    found = one(spark, ["Nov 1", "Jan 5", "May 18", "May 19", "Foo 1", "Feb 30", "Dec"],
                lambda x: dates.infer_year(x, reference))
    assert [str(d) if d else None for d in found] == [
        "2024-11-01", "2025-01-05", "2025-05-18", "2024-05-19", None, None, None]


def test_weekends(spark):
    days = ["2024-06-06", "2024-06-07", "2024-06-08", "2024-06-09"]
    as_date = lambda f: lambda x: f(x.cast("date"))
    assert [str(d) for d in one(spark, days, as_date(dates.next_saturday))] == [
        "2024-06-08", "2024-06-08", "2024-06-08", "2024-06-15"]
    assert one(spark, days, as_date(dates.run_mode)) == ["baseline", "incremental", "incremental", "skipped"]


@pytest.mark.parametrize("body, expected", [
    ("Проект: Ставки и ufc", ("ufc-betting", "explicit")),
    ("категория : неизвестно, но python", ("learning-programming", "keywords")),
    ("стартап и код", ("venture-investing", "keywords")),
    ("nothing here", ("shared", "fallback")),
    ("раздел: ёж", ("shared", "fallback")),
])
def test_classifier(spark, body, expected):
    assert tuple(one(spark, [body], classify.classify_project)[0]) == expected


def test_small_classifiers(spark):
    assert one(spark, ["KO", "Sub", "draw", "Draw x", None], classify.method_bucket) == [
        "KO/TKO", "Submission", "Decision", "Other", "Other"]
    assert one(spark, ["UFC 1: x", "Cage: y", "Open"], classify.promotion) == ["UFC", "Cage", "Open"]
    assert one(spark, ["W", "NC", "?"], classify.result_marker) == ["🟩 W", "⬜ NC", "?"]
    assert one(spark, ["-Средний вес Средний вес-", "Flyweight Bout", "a b c", ""], classify.translate_weight_class) == [
        "Middleweight", "Flyweight", "a b c", None]
    assert one(spark, ["He Returns after surgery", "calm"], classify.headline_class) == ["injury", None]


def test_hash_ignores_bookkeeping_and_order(spark):
    row = spark.range(1).select(
        hashing.content_hash({"b": F.lit("2"), "a": F.lit("1"), "generated_at": F.lit("x")}).alias("h1"),
        hashing.content_hash({"a": F.lit("1"), "b": F.lit("2"), "content_hash": F.lit("y")}).alias("h2"),
        hashing.content_hash({"a": F.lit("1"), "b": F.lit(None).cast("string")}).alias("h3"),
    ).first()
    assert row.h1 == row.h2 != row.h3


def test_errors_and_backticks(spark):
    row = spark.range(1).select(
        text.combine_errors(F.lit(""), F.lit(None)).alias("none"),
        text.combine_errors(F.lit("a"), F.lit("b")).alias("both"),
        text.strip_backticks(F.lit(" `x` ")).alias("quoted"),
        text.strip_backticks(F.lit("`x")).alias("half"),
    ).first()
    assert tuple(row) == ("Unknown fetch error", "a | b", "x", "`x")


def test_templates_mention_comments_only_when_present(spark):
    row = spark.range(1).select(
        render.template_analysis(F.lit("t"), F.lit("k"), F.lit(None).cast("string"), F.lit(0)).alias("without"),
        render.template_analysis(F.lit("t"), F.lit("k"), F.lit("last"), F.lit(2)).alias("with_"),
    ).first()
    assert "Что изменилось" not in row.without and row.without.endswith("Исходный текст идеи:\nt")
    assert "- Новый комментарий: last\n" in row.with_ and "Комментариев в истории: 2." in row.with_

"""Sources, sinks, merges, parsing and listings on small tables."""

import pytest
from pyspark.sql import functions as F

from ringside.operators import changes, history, merge, routing
from ringside.operators.documents import report_parts
from ringside.operators.topk import first_then_filter, filter_then_first, insert_if_absent, keep_first, upsert
from ringside.plans.history_queries import listing, updated
from ringside.plans.text_queries import report_markdown, report_tables, whole_reports
from ringside.session import scratch_path
from ringside.sources import markdown, payload
from ringside.sources.keyed import read_keyed
from ringside.sources.records import look_up, read_records, read_whole_texts
from ringside.sources.text_files import read_whole

c = F.col


def test_broken_records_stay_visible(spark):
    path = scratch_path(spark, "records")
    spark.createDataFrame([('{"record_id": 1, "project_key": "shared"}',), ('{"record_id": 2',)], "line string").write.text(path)
    got = {r.record_id: r._corrupt_record for r in read_records(spark, path).cache().collect()}
    assert got[1] is None and any(v == '{"record_id": 2' for v in got.values())


def test_one_file_per_record(spark):
    path = scratch_path(spark, "single")
    spark.createDataFrame([('{\n "record_id": 5,\n "project_key": "shared"\n}',)], "line string").coalesce(1).write.text(path)
    assert [r.record_id for r in read_records(spark, path, "shared", multi_line=True).collect()] == [5]
    assert read_records(spark, path, "other", multi_line=True).count() == 0


def test_lookup_keeps_missing_keys(spark):
    left = spark.createDataFrame([(1,), (9,)], "id int")
    right = spark.createDataFrame([(1, "a")], "id int, v string")
    assert sorted(tuple(r) for r in look_up(left, right, "id").select("id", "found", "v").collect()) == [
        (1, True, "a"), (9, False, None)]


def test_export_replaces_its_keys_only(spark):
    path = scratch_path(spark, "export")

    def payload_of(rows):
        return spark.createDataFrame(rows, "entity_type string, remote_id string, title string")

    routing.write_export(payload_of([("idea", "a", "1"), ("context", "b", "2"), ("idea", "c", "4")]), path)
    routing.write_export(payload_of([("idea", "a", "3")]), path)
    got = read_keyed(spark, path, "remote_id string, title string, entity_type string")
    assert sorted(r.title for r in got.collect()) == ["2", "3", "4"]


def test_export_files_keep_nulls_and_replace(spark):
    path = scratch_path(spark, "files")
    for title in ("old", "new"):
        df = spark.createDataFrame([("idea", "a", title, None), ("context", "b", "b", "u")], "entity_type string, remote_id string, title string, url string")
        routing.write_export_files(df, path)
    texts = {r.file_path.split("/")[-2]: r.body for r in read_whole_texts(spark, f"{path}/*/*.json").collect()}
    assert set(texts) == {"ideas", "contexts"} and texts["ideas"].count("\n") > 3
    assert '"title" : "new"' in texts["ideas"] and '"url" : null' in texts["ideas"]


def test_the_last_writer_of_a_target_wins(spark):
    path = scratch_path(spark, "routed")
    schema = "target string, file_name string, body string"
    routing.write_routed(spark.createDataFrame([("t", "1", "a"), ("t", "2", "b"), ("u", "1", "c")], schema), path)
    routing.write_routed(spark.createDataFrame([("u", "0", "d")], schema), path)
    assert sorted(tuple(r) for r in read_keyed(spark, path, schema).collect()) == [("t", "2", "b"), ("u", "0", "d")]


def test_keyed_rows_are_packed_and_go_in_turns(spark, monkeypatch):
    from pathlib import Path

    from ringside.sources import keyed

    path = scratch_path(spark, "turns")
    schema = "k bigint, part string, n bigint, v string"
    keys = dict(keys=["part", "k"], folders=["part"], within=["n"])
    text = "one two three " * 40
    first = [(k, f"p {k % 3}/=", n, text + str(k)) for k in range(200) for n in range(2)]
    keyed.write_keyed(spark.createDataFrame([*first, *first[:9], (None, "p 0/=", 1, "null")], schema), path, **keys)
    monkeypatch.setattr(keyed, "TURN_BYTES", 1000)
    again = [(k, f"p {k % 3}/=", 7, v) for k in range(0, 200, 4) for v in ("a", "b", "c")[: 1 + k % 3]]
    keyed.write_keyed(spark.createDataFrame([*again, (None, "p 0/=", 1, "more")], schema), path, **keys)
    want = {(r[0], r[1], r[2]): r[3] for r in first if r[0] % 4}
    want |= {(k, p, n): v for k, p, n, v in again}
    got = [tuple(r) for r in read_keyed(spark, path, schema).select("k", "part", "n", "v").collect()]
    assert sorted(r for r in got if r[0] is not None) == sorted((*k, v) for k, v in want.items())
    assert sorted(r[3] for r in got if r[0] is None) == ["more", "null"]
    files = [f for f in Path(path.removeprefix("file:")).rglob("*") if f.is_file() and f.name.startswith("part-")]
    assert files and all(f.name.endswith(".json.gz") for f in files) and not [*Path(path.removeprefix("file:")).glob("_staging*")]
    assert sum(f.stat().st_size for f in files) < 200 * len(text)  # half of the rows without their packing
    root = Path(path.removeprefix("file:")).parent
    assert not [*root.glob("keyed-*")]


def test_a_keyed_write_that_fails_leaves_the_table(spark):
    from ringside.sources.keyed import write_keyed

    path = scratch_path(spark, "failed")
    write_keyed(spark.createDataFrame([(i, "old") for i in range(50)], "k int, v string"), path, ["k"])
    bad = spark.range(50).select(c("id").cast("int").alias("k"), F.when(c("id") == 49, F.raise_error(F.lit("stop"))).otherwise("new").alias("v"))
    with pytest.raises(Exception, match="stop"):
        write_keyed(bad, path, ["k"])
    assert {r.v for r in read_keyed(spark, path, "k int, v string").collect()} == {"old"}


def test_absent_text_file_gives_no_rows(spark):
    assert read_whole_texts(spark, scratch_path(spark, "nothing")).isEmpty()


def test_whole_texts_are_read_many_a_task_with_the_rows_of_spark(spark, tmp_path):
    names = [f"{i}.md" for i in range(2_500)] + ["a b%é[x]#?.txt", "_hidden.md", ".dot.md"]
    for name in names:
        (tmp_path / name).write_bytes(b"\xef\xbb\xbfA\xff\r\n " if name[0] == "a" else b"" if name == "7.md" else name.encode())
    (tmp_path / "inner").mkdir()
    (tmp_path / "inner" / "deep.md").write_text("deep")
    found = read_whole_texts(spark, str(tmp_path))
    plain = spark.read.text(str(tmp_path), wholetext=True).select(c("_metadata.file_path").alias("file_path"), c("value").alias("body"))
    listed = lambda df: sorted(tuple(r) for r in df.select("file_path", F.hex("body")).collect())
    assert listed(found) == listed(plain) and len(listed(found)) == 2_500
    assert found.select(F.spark_partition_id()).distinct().count() == 3
    # a folder of a partitioned table and packed files are left to Spark
    (tmp_path / "day=1").mkdir()
    (tmp_path / "day=1" / "x.md").write_text("x")
    assert read_whole(spark, str(tmp_path)) is None


def test_repeated_incoming_keys_are_inserted_once(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (2, "c"), (1, "z")], "k int, v string")
    assert sorted(tuple(r) for r in insert_if_absent(old, new, ["k"]).collect()) == [(1, "a"), (2, "b")]


def test_equal_order_values_go_to_the_new_row(spark):
    old = spark.createDataFrame([(1, 1, "old")], "k int, seq int, v string")
    new = spark.createDataFrame([(1, 1, "new")], "k int, seq int, v string")
    assert [r.v for r in upsert(old, new, ["k"], ["seq"]).collect()] == ["new"]


def test_a_bout_without_fighters_has_no_blocks(spark, sf_dir):
    cards, bouts, fighters = report_tables(spark, sf_dir)
    alone = bouts.withColumn("a_fighter", F.lit(None).cast("bigint")).withColumn("b_fighter", F.lit(-1).cast("bigint"))
    bodies = [r.body for r in report_parts(cards, alone, fighters).filter(c("part_no").between(1, 12)).collect()]
    assert bodies and not any("Последние 5" in b for b in bodies)


def test_dual_write(spark, sf_dir):
    from ringside.operators.documents import record_parts
    from ringside.plans.history_queries import comments
    from ringside.plans.text_queries import documents_of
    from ringside.sources.sinks import dual_write, read_documents

    path = scratch_path(spark, "dual")
    records = documents_of(spark, sf_dir)
    notes = comments(spark, sf_dir).withColumn("created", c("created").cast("string"))
    parts = record_parts(records, notes)
    dual_write(records, parts, path)
    assert read_records(spark, f"{path}/records").count() == records.count()
    back = read_documents(spark, "record_id", f"{path}/documents")
    assert back.exceptAll(parts).isEmpty() and parts.exceptAll(back).isEmpty()
    assert sorted(map(str, back.collect())) == sorted(map(str, parts.collect()))
    one = c("record_id") == 3
    dual_write(records.filter(one), parts.filter(one).withColumn("body", F.lit("again")), path)
    assert read_records(spark, f"{path}/records").count() == records.count()
    back = read_documents(spark, "record_id", f"{path}/documents")
    assert {r.body for r in back.filter(one).collect()} == {"again"} and back.count() == parts.count()


def test_pages_lose_their_markup_before_they_meet_their_records(spark, sf_dir):
    from ringside.plans.adapters import records

    plan = records(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    above, joined, below = plan.partition("Join LeftOuter")
    assert joined and "html#" not in above and "html#" in below


def test_marker_search(spark):
    script = 'x={"a":"}{\\"","page":{"in":{"segMeta":{"n":[1,{"z":"}"}]}}}}; y={"page":{"b":1}}'
    page = f"<script>no</script><script>var k = '\"segMeta\"' + {{;</script><script>{script}</script>"
    df = spark.createDataFrame([(page,), ("<script>none</script>",)], "html string")
    found = payload.enclosing_json('"segMeta"')(payload.scripts_with(c("html"), '"segMeta"'))
    got = [r[0] for r in df.select(found).collect()]
    assert got == [script[2:script.index("; y=")], None]


def test_report_round_trip_through_files(spark, sf_dir):
    path = scratch_path(spark, "reports")
    whole_reports(spark, sf_dir).select("body").repartition(8).write.option("lineSep", "\x00").text(path)
    texts = read_whole_texts(spark, path).withColumn("body", F.explode(F.split("body", "\x00"))).filter(c("body") != "")
    events = markdown.parse_events(texts, "body")
    assert events.count() == whole_reports(spark, sf_dir).count()
    assert report_markdown(spark, sf_dir).filter(c("body").isNull()).count() == 0


def test_quality_label(spark):
    df = spark.createDataFrame([(["x", "`weak` `good`"],), (["y"],), ([],)], "n array<string>")
    assert [r[0] for r in df.select(markdown.quality_label(c("n"))).collect()] == ["weak", "partial", "partial"]


def test_dedup_variants_and_idempotence(spark):
    df = spark.createDataFrame([(1, 1, "bad"), (1, 2, "ok"), (2, 3, "ok")], "k int, pos int, v string")
    good = c("v") == "ok"
    assert sorted(r.pos for r in filter_then_first(df, good, ["k"], ["pos"]).collect()) == [2, 3]
    assert sorted(r.pos for r in first_then_filter(df, good, ["k"], ["pos"]).collect()) == [3]
    once = keep_first(df, ["k"], ["pos"])
    assert sorted(once.collect()) == sorted(keep_first(once, ["k"], ["pos"]).collect())


def test_hot_key_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((c("id") % 3).alias("k"), "id")
    plan = keep_first(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.index("Partial") > plan.index("Exchange")


def test_state_tables(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, seq int, v string")
    new = spark.createDataFrame([(2, 2, "c"), (3, 1, "d")], "k int, seq int, v string")
    assert sorted(r.v for r in upsert(old, new, ["k"], ["seq"]).collect()) == ["a", "c", "d"]
    assert sorted(r.v for r in insert_if_absent(old, new, ["k"]).collect()) == ["a", "b", "d"]


def test_a_b_a_emits_three_times(spark):
    df = spark.createDataFrame(
        [(1, i, "incremental", h) for i, h in enumerate("ABBA")], "key int, seq int, kind string, hash string")
    assert sorted(r.seq for r in changes.changed_runs(df).collect()) == [0, 1, 3]


def test_diff_kinds(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, f string, g string")
    new = spark.createDataFrame([(1, "a", "z"), (3, "c", "q")], "k int, f string, g string")
    got = sorted(tuple(r) for r in changes.snapshot_diff(old, new, "k", ["f", "g"]).collect())
    assert got == [(1, "changed", "g", "x", "z"), (2, "removed", "*", None, None), (3, "added", "*", None, None)]


def test_fallback_merge_sends_no_rows_to_every_task(spark, tmp_path):
    columns = "card bigint, pos bigint, bout_id string, a_name string, b_name string, weight_class string, card_segment string"
    existing = [
        (1, 0, "e0", "ana silva", "bo kim", "n/a", "Prelim"), (1, 1, "e1", "cy li", "dan ito", "Heavy", "n/a"),
        (2, 0, "e2", "ana silva", "bo kim", "n/a", "n/a"), (None, 0, "e3", "ana silva", "bo kim", "Fly", "n/a"),
    ]
    fallback = [
        (1, 0, "f0", "bo kim", "ana silva", "Light", "Main"), (1, 1, "f1", "eva roy", "flo day", "Light", "Main"),
        (3, 0, "f2", "ana silva", "bo kim", "Light", "Main"), (None, 0, "f3", "ana silva", "bo kim", "Light", "Main"),
    ]
    sides = []
    # files are far smaller than their rows, which invites a broadcast
    for name, rows in (("existing", existing), ("fallback", fallback)):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}")
        sides.append(spark.read.parquet(f"{tmp_path}/{name}"))
    merged = merge.fallback_merge(*sides, "card")
    got = sorted(map(tuple, merged.collect()), key=str)
    assert got == sorted([
        (1, "matched", 0, 0, "e0", "ana silva", "bo kim", "Light", "Prelim"),
        (1, "added", 0, 1, "f1", "eva roy", "flo day", "Light", "Main"),
        (3, "added", 0, 0, "f2", "ana silva", "bo kim", "Light", "Main"),
        (None, "added", 0, 0, "f3", "ana silva", "bo kim", "Light", "Main"),
        (1, "leftover", 1, 1, "e1", "cy li", "dan ito", "Heavy", None),
        (2, "leftover", 1, 0, "e2", "ana silva", "bo kim", None, None),
        (None, "leftover", 1, 0, "e3", "ana silva", "bo kim", "Fly", None),
    ], key=str)
    for df in (merged, merge.merge_coverage(merged, "card", "official")):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_fresh_wins_over_cached(spark):
    fresh = spark.createDataFrame([(1, "f"), (2, None), (3, None)], "k int, v string")
    cached = spark.createDataFrame([(1, "c"), (2, "c")], "k int, v string")
    got = {r.k: (r.v, r.origin) for r in merge.fresh_else_cached(fresh, cached, "k", "v").collect()}
    assert got == {1: ("f", "fresh"), 2: ("c", "cached"), 3: (None, "failed")}


def test_form_labels(spark):
    rows = [(5, 3, 1, "strong_finisher"), (4, 1, 0, "strong"), (2, 2, 0, "unstable"), (3, 0, 0, "no_submission_losses"), (3, 1, 10, "mixed")]
    df = spark.createDataFrame(rows, "w int, f int, s int, want string")
    assert df.filter(history.form_label(c("w"), c("f"), c("s")) != c("want")).count() == 0


def test_listing_rejects_unknown_projects(spark, sf_dir):
    with pytest.raises(ValueError):
        listing(updated(spark, sf_dir), "nope")
    assert listing(updated(spark, sf_dir), "__all__").count() == 10


def test_aligned_zip_needs_equal_lengths(spark):
    df = spark.createDataFrame([(["a", "b"], ["x", "y"], ["1", "2"]), (["a"], ["x"], [])], "r array<string>, b array<string>, m array<string>")
    got = [r[0] for r in df.select(payload.zip_aligned(c("r"), c("b"), c("m"))).collect()]
    assert [tuple(x) for x in got[0]] == [("b", "y", "1"), ("a", "x", "2")] and got[1] is None

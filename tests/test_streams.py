"""Streams in several batches equal their batch twins; replays change nothing."""

import pytest
from pyspark.sql import functions as F

from ringside.operators import changes
from ringside.plans.adapters import runs_of, table
from ringside.session import scratch_path
from ringside.sources.text_files import read_files, write_files
from ringside.streaming import flows, processors

c = F.col


def rows(df):
    return sorted(map(str, df.collect()))


def arrive(df, path, low, high):
    """Let the rows with event ids in a range arrive as one file."""
    part = df.filter((c("event_id") >= low) & (c("event_id") < high))
    part.coalesce(1).write.mode("append").parquet(path)


def in_three(spark, sf_dir, run):
    """Run a flow three times while the events arrive in order."""
    events = table(spark, sf_dir, "events")
    root = scratch_path(spark, "test")
    for low, high in ((0, 300), (300, 301), (301, 10_000)):
        arrive(events, f"{root}/in", low, high)
        run(flows.parquet_stream(spark, f"{root}/in"), root)
    return events, root


def test_changed_only_in_rows_and_frames(spark, sf_dir):
    for frames in (False, True):
        events, root = in_three(
            spark, sf_dir, lambda s, r: flows.changed_only(runs_of(s), f"{r}/out", f"{r}/cp", frames))  # noqa: B023
        assert rows(spark.read.parquet(f"{root}/out")) == rows(
            changes.changed_runs(runs_of(events)).select("key", "seq", "kind"))


def test_latest_per_key(spark, sf_dir):
    events, root = in_three(spark, sf_dir, lambda s, r: flows.latest_per_key(
        s.select("user_id", "event_id", "value"), ["user_id"], ["event_id"], f"{r}/cp"))
    expected = events.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))
    assert rows(processors.state_of(spark, f"{root}/cp", "latest")) == rows(expected)


def test_a_batch_touches_the_state_of_its_own_keys_only(spark):
    root = scratch_path(spark, "touched")
    run = lambda: flows.latest_per_key(flows.parquet_stream(spark, f"{root}/in"), ["k"], ["at"], f"{root}/cp")
    land = lambda data: spark.createDataFrame(data, "k long, at long, v string").coalesce(1).write.mode("append").parquet(f"{root}/in")
    land([(k, 1, "old") for k in range(500)])
    run()
    land([(7, 2, "new"), (8, 0, "late"), (9, None, "no time")])
    done = run()
    state = [p["stateOperators"][0] for p in done.recentProgress if p["stateOperators"] and p["numInputRows"]]
    assert sum(s["numRowsUpdated"] for s in state) == 1 and state[-1]["numRowsTotal"] == 500
    got = {r.k: r.v for r in processors.state_of(spark, f"{root}/cp", "latest").collect()}
    assert len(got) == 500 and got[7] == "new" and {got[k] for k in got if k != 7} == {"old"}


def test_late_runs_meet_what_was_sent_last(spark):
    """By arrival: hash A at 10, then late runs 5 (A, unchanged) and 6 (B), then 11 (B, unchanged)."""
    root = scratch_path(spark, "late")
    for rows in ([(1, 10, "A")], [(1, 5, "A"), (1, 6, "B")], [(1, 11, "B")]):
        df = spark.createDataFrame(rows, "key bigint, seq bigint, hash string").withColumn("kind", F.lit("incremental"))
        df.coalesce(1).write.mode("append").parquet(f"{root}/in")
        flows.changed_only(flows.parquet_stream(spark, f"{root}/in"), f"{root}/out", f"{root}/cp")
    assert sorted(r.seq for r in spark.read.schema(processors.OUTPUT).parquet(f"{root}/out").collect()) == [6, 10]
    assert [r.hash for r in processors.state_of(spark, f"{root}/cp", "last_hash").collect()] == ["B"]


_RUNS = "key bigint, seq bigint, kind string, run_date string, opened_date string, hash string"


def gated(spark, root, batches, delay="0 seconds"):
    """Each batch in a run of its own; status and reason by seq."""
    for batch in batches:
        df = spark.createDataFrame(batch, _RUNS).select(
            "key", "seq", "kind", c("run_date").cast("date").alias("run_date"), c("opened_date").cast("date").alias("opened_date"),
            "hash", c("run_date").cast("timestamp").alias("at"))
        df.coalesce(1).write.mode("append").parquet(f"{root}/in")
        flows.gate(flows.parquet_stream(spark, f"{root}/in"), "at", f"{root}/out", f"{root}/cp", delay)
    return {r.seq: r.reason for r in spark.read.schema(processors.JUDGED).parquet(f"{root}/out").collect()}


def test_a_late_update_finds_the_window_open(spark):
    got = gated(spark, scratch_path(spark, "late-gate"), [
        [(1, 10, "baseline", "2024-01-04", "2024-01-06", "A")], [(1, 5, "incremental", "2024-01-04", None, "B")]], "1 day")
    assert got == {10: "window_opened", 5: "new_hash"}


def test_a_timer_closes_the_window_when_its_day_is_past(spark):
    """Key 2 moves the watermark past the event of key 1; what key 1 is told afterwards is what the batch twin says."""
    root = scratch_path(spark, "timer")
    batches = [
        [(1, 1, "baseline", "2024-01-04", "2024-01-06", "A"), (3, 2, "baseline", "2024-01-04", "2024-01-06", "A")],
        [(2, 3, "baseline", "2024-01-08", "2024-01-13", "A")],
        [(2, 4, "incremental", "2024-01-09", None, "A")],
    ]
    assert gated(spark, root, batches) == {1: "window_opened", 2: "window_opened", 3: "window_opened", 4: "same_hash"}
    kept = [tuple(r) for r in processors.state_of(spark, f"{root}/cp", "window").collect()]
    assert sorted(kept, key=str)[:2] == [(None, None, True)] * 2 and sum(k[2] for k in kept) == 2
    got = gated(spark, root, [[(1, 5, "incremental", "2024-01-10", None, "B"), (1, 6, "incremental", "2024-01-10", None, "B"),
                               (3, 7, "baseline", "2024-01-10", "2024-01-13", "C")],
                              [(3, 8, "incremental", "2024-01-11", None, "C")]])
    assert {k: got[k] for k in (5, 6, 7, 8)} == {5: "window_over", 6: "no_window", 7: "window_opened", 8: "same_hash"}
    every = spark.createDataFrame([r for b in batches for r in b] + [
        (1, 5, "incremental", "2024-01-10", None, "B"), (1, 6, "incremental", "2024-01-10", None, "B"),
        (3, 7, "baseline", "2024-01-10", "2024-01-13", "C"), (3, 8, "incremental", "2024-01-11", None, "C")], _RUNS)
    twin = changes.gate_runs(every.withColumn("run_date", c("run_date").cast("date")).withColumn(
        "opened_date", c("opened_date").cast("date")))
    assert {r.seq: r.reason for r in twin.collect()} == got


def tagged(df):
    role = F.when(c("event_type") == "error", "open").when(c("event_type") == "click", "text")
    return df.select("user_id", "event_id", "ts", role.alias("role")).filter(c("role").isNotNull())


def test_consumed_matches(spark, sf_dir):
    def run(stream, root):
        flows.consume_matches(tagged(stream), f"{root}/out", f"{root}/cp", "user_id", 48 * 3600)

    events, root = in_three(spark, sf_dir, run)
    expected = changes.consume_within(
        events, "user_id", c("event_type") == "error", c("event_type") == "click", 48 * 3600
    )
    schema = "user_id bigint, text_id bigint, open_id bigint"
    assert rows(spark.read.schema(schema).parquet(f"{root}/out")) == rows(expected)


def test_interval_join_lets_go_of_what_no_text_can_reach(spark):
    root = scratch_path(spark, "interval")
    at = lambda day, hour: f"2024-01-{day:02d} {hour:02d}:00:00"
    batches = [
        [(1, 1, at(1, 0), "open"), (1, 2, at(1, 1), "open"), (1, 3, at(1, 2), "text"), (2, 4, at(1, 2), "text")],
        [(1, 5, at(1, 3), "text"), (1, 6, at(3, 0), "open"), (2, 7, at(3, 0), "text")],
        [(9, 8, at(9, 0), "open"), (9, 9, at(9, 0), "text")],
    ]
    for batch in batches:
        df = spark.createDataFrame(batch, "user_id long, event_id long, ts string, role string")
        df.withColumn("ts", c("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{root}/in")
        done = flows.pairs_within(flows.parquet_stream(spark, f"{root}/in"), f"{root}/out", f"{root}/cp", "user_id", 2 * 3600)
    schema = "user_id bigint, text_id bigint, open_id bigint, open_ts timestamp"
    got = {(r.text_id, r.open_id) for r in spark.read.schema(schema).parquet(f"{root}/out").collect()}
    assert got == {(3, 1), (3, 2), (5, 2), (9, 8)}
    held = [s["numRowsTotal"] for p in done.recentProgress for s in p["stateOperators"]]
    assert held[-1] <= 2  # of ten rows only the last pair is still held


def test_a_job_that_fails_leaves_no_file(spark):
    root = scratch_path(spark, "files")
    files = spark.range(400, numPartitions=4).select(
        F.concat(F.lit("f"), c("id") % 2).alias("folder"), c("id").cast("string").alias("file_name"), F.lit("first").alias("body"))
    write_files(files, root)
    stop = F.when(c("file_name") == "399", F.raise_error(F.lit("stop"))).otherwise("second")
    with pytest.raises(Exception, match="stop"):
        write_files(files.withColumn("body", stop), root)
    assert {(r.body, r["count"]) for r in read_files(spark, root).groupBy("body").count().collect()} == {("first", 400)}
    write_files(files.filter("file_name = '7'").withColumn("body", F.lit("second")), root)
    assert read_files(spark, root).where("body = 'second'").count() == 1 and read_files(spark, root).count() == 400
    assert read_files(spark, root + "/absent").count() == 0


def test_inbox_takes_each_file_once_in_bounded_batches(spark):
    root = scratch_path(spark, "test-inbox")
    good = '{\n  "project_key": "ufc-betting",\n  "title": "T",\n  "raw_input": "%s",\n  "remote_id": "%s",\n  "created_at": "2024-01-01T00:00:00"\n}'
    run = lambda: flows.ingest_inbox(
        flows.inbox_stream(spark, f"{root}/in", max_files=2), f"{root}/out", f"{root}/cp")

    def land(rows):
        write_files(spark.createDataFrame(rows, "folder string, file_name string, body string"), f"{root}/in")
        run()

    land([("ideas", "1.json", good % ("one", "a")), ("contexts", "2.json", good % ("two", "a")), ("ideas", "3.json", "{ broken"),
          ("other", "4.json", good % ("four", "b")), ("ideas", "5.json", '{"title": "x"}')])
    first = rows(flows.current_documents(spark, f"{root}/out"))
    run()
    assert rows(flows.current_documents(spark, f"{root}/out")) == first and len(first) == 2
    land([("ideas", "6.json", good % ("again", "a"))])
    bodies = {r.target: r.body for r in flows.current_documents(spark, f"{root}/out").collect()}
    assert len(bodies) == 2 and any("again" in b for b in bodies.values()) and not any("\none\n" in b for b in bodies.values())
    failed = {r.file_name: r.error_reason for r in spark.read.parquet(f"{root}/out/failed").collect()}
    assert failed == {"3.json": "broken json", "4.json": "unknown folder", "5.json": "missing project_key"}
    counted = {r.outcome: r.n for r in spark.read.parquet(f"{root}/out/stats").groupBy("outcome").agg(F.sum("n").alias("n")).collect()}
    assert counted == {"imported_ideas": 2, "imported_contexts": 1, "failed": 3}


def test_inbox_lists_are_made_by_executors_and_name_a_file_once(spark, monkeypatch):
    from urllib.parse import unquote

    from ringside.sources import text_files
    from ringside.streaming import inbox

    monkeypatch.setattr(text_files, "PIECE", 3)
    root = scratch_path(spark, "test-lists")
    names = [f"{i:02d} [a]%20{{x}}.json" for i in range(11)]
    rows_of = lambda part: spark.createDataFrame(
        [("deep/ideas", n, '{"project_key": "ufc-betting", "raw_input": "%s", "remote_id": "%s"}' % (n, n[:2])) for n in part],
        "folder string, file_name string, body string").coalesce(1)
    write_files(rows_of(names[:7]), f"{root}/in")
    write_files(rows_of(["_hidden.json", ".hidden.json"]), f"{root}/in")
    box = flows.inbox_stream(spark, f"{root}/in", max_files=2)
    flows.ingest_inbox(box, f"{root}/out", f"{root}/cp")
    # the names are in lists on disk: what is held for the source of the stream is a list a batch, not a file
    sizes = lambda: sorted(r["count"] for r in spark.read.json(f"{root}/cp/files").select("_metadata.file_path").groupBy(
        "file_path").count().collect())
    assert max(sizes()) <= 2 and sum(sizes()) == 7
    write_files(rows_of(names[5:]), f"{root}/in")
    flows.ingest_inbox(flows.inbox_stream(spark, f"{root}/in", max_files=2), f"{root}/out", f"{root}/cp")
    assert max(sizes()) <= 2 and sum(sizes()) == 11
    inbox.update_lists(box, f"{root}/cp/files")
    assert sum(sizes()) == 11
    got = sorted(unquote(r.file_name) for r in spark.read.parquet(f"{root}/out/documents").collect())
    assert got == names
    times = [s.getModificationTime() for s in _listed(spark, f"{root}/cp/files")]
    assert len(set(times)) == len(times)


def _listed(spark, path):
    from ringside.sources.keyed import located

    system, at = located(spark, path)
    return [s for s in system.listStatus(at) if s.isFile()]

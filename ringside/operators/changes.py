"""Change detection, the weekend window gate, matching in time and diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ringside.functions import hashing, odds
from ringside.functions.dates import in_next_weekend
from ringside.functions.text import collapse_spaces
from ringside.operators.ordered import CHUNK, Running, in_ranges, running


def changed_runs(runs: DataFrame, position: str = "seq", chunks: int | None = None) -> DataFrame:
    """Runs that emit: every baseline, and updates that differ from the last sent.

    After each run the last sent hash equals that run's hash, so the run before
    in ``position`` is what to compare with.
    """
    seen = running(runs, ["key"], [position], {"prev_hash": Running("lag", F.col("hash"))}, chunks)
    return seen.filter(
        (F.col("kind") == "baseline") | ~F.col("hash").eqNullSafe(F.col("prev_hash"))
    )


def gate_runs(runs: DataFrame, position: str = "seq", chunks: int | None = None) -> DataFrame:
    """Status of every run under the weekend window gate.

    An eligible baseline opens the window of its event. An update runs only
    while that window is open and its event is still on the next weekend;
    the first update past it closes the window. Runs of a key go by
    ``position``, which is unique inside the key.
    """
    at = F.col(position)
    baseline = F.col("kind") == "baseline"
    eligible = baseline & in_next_weekend(F.col("opened_date"), F.col("run_date"))
    opened = running(
        in_ranges(runs, ["key"], [position], chunks), ["key"], [position],
        {
            "base_at": Running("last", F.when(eligible, at)),
            "base_date": Running("last", F.when(eligible, F.col("opened_date"))),
            "closed_at": Running("last", F.when(baseline & ~F.coalesce(eligible, F.lit(False)), at)),
            "prev_hash": Running("lag", F.col("hash")),
        },
    )
    is_open = F.col("base_at").isNotNull() & (
        F.col("closed_at").isNull() | (F.col("closed_at") < F.col("base_at"))
    )
    over = ~baseline & is_open & ~in_next_weekend(F.col("base_date"), F.col("run_date"))
    marked = opened.withColumn("is_open", is_open).withColumn("over", over)
    closed = running(
        marked, ["key"], [position], {"over_at": Running("before", F.when(F.col("over"), at))}
    )
    closed_before = F.coalesce(F.col("over_at") > F.col("base_at"), F.lit(False))
    same = F.col("hash").eqNullSafe(F.col("prev_hash"))
    status = (
        F.when(baseline, F.when(F.col("base_at") == at, "baseline_created").otherwise("skipped"))
        .when(~F.col("is_open") | closed_before | F.col("over"), "skipped")
        .when(same, "unchanged")
        .otherwise("changed")
    )
    reason = (
        F.when(baseline, F.when(F.col("base_at") == at, "window_opened").otherwise("no_event"))
        .when(~F.col("is_open") | closed_before, "no_window")
        .when(F.col("over"), "window_over")
        .when(same, "same_hash")
        .otherwise("new_hash")
    )
    kept = ["key", "seq", "kind"] + ([position] if position != "seq" else [])
    return closed.select(*kept, status.alias("status"), reason.alias("reason"))


def as_of(
    df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], chunks: int | None = None
) -> DataFrame:
    """Latest non-null value of each column at or before every row."""
    return running(df, keys, order, {n: Running("last", v) for n, v in values.items()}, chunks)


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / 1_000_000


#: Order of open records and texts: by time; at one time records come before
#: texts, and of those records the lowest id comes last, so it is the one taken.
IN_TIME = ["ts", "is_text", "tie"]


def _in_time(df: DataFrame, key: str, is_open: Column, is_text: Column) -> DataFrame:
    tie = F.when(is_open, -F.col("event_id")).otherwise(F.col("event_id"))
    return df.filter(is_open | is_text).select(
        key, "ts", "event_id", is_open.alias("is_open"), is_text.alias("is_text"), tie.alias("tie")
    )


def newest_within(
    df: DataFrame, key: str, is_open: Column, is_text: Column, within_seconds: int, chunks: int | None = None
) -> DataFrame:
    """Each text row with the newest open record of its key, if recent enough.

    Nothing is consumed: several texts may find the same record. Of records
    with the same time the lowest id is found. Rows need ``ts`` and ``event_id``.
    """
    opened = F.col("is_open")
    seen = as_of(
        _in_time(df, key, is_open, is_text), [key], IN_TIME,
        {"open_id": F.when(opened, F.col("event_id")), "open_ts": F.when(opened, F.col("ts"))}, chunks,
    )
    return seen.filter(
        F.col("is_text") & (seconds_between(F.col("ts"), F.col("open_ts")) <= within_seconds)
    ).select(key, F.col("event_id").alias("text_id"), "open_id")


def consume_within(
    df: DataFrame, key: str, is_open: Column, is_text: Column, within_seconds: int, chunks: int | None = None
) -> DataFrame:
    """Each text takes the newest open record not yet taken, if recent enough.

    That is bracket matching: an open record adds one level, a text removes
    one, and a text closes the last record opened on its level. A record too
    old for one text is too old for all later ones, so the age test may follow
    the matching. Ties as in ``newest_within``.
    """
    step = F.when(F.col("is_open"), 1).otherwise(-1)
    rows = in_ranges(_in_time(df, key, is_open, is_text), [key], IN_TIME, chunks)
    level = running(rows, [key], IN_TIME, {"total": Running("sum", step)})
    level = running(level, [key], IN_TIME, {"floor": Running("min_before", F.col("total"))})
    # Texts without an open record push the floor down and match nothing.
    floor = F.least(F.col("floor"), F.lit(0))
    height = F.col("total") - floor
    on_level = level.drop(CHUNK).filter(height >= 0).withColumn(
        "level", F.when(F.col("is_open"), height).otherwise(height + 1)
    )
    paired = running(
        on_level, [key, "level"], IN_TIME,
        {
            "open_id": Running("lag", F.when(F.col("is_open"), F.col("event_id"))),
            "open_ts": Running("lag", F.when(F.col("is_open"), F.col("ts"))),
        },
        chunks,
    )
    return paired.filter(
        ~F.col("is_open") & (seconds_between(F.col("ts"), F.col("open_ts")) <= within_seconds)
    ).select(key, F.col("event_id").alias("text_id"), "open_id")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Added and removed keys, and changed fields as (key, kind, field, old, new)."""

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            key, F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]).alias(name)
        )

    both = packed(old, "o").join(packed(new, "n"), key, "full_outer")
    whole = F.array(F.struct(F.lit("*").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new")))
    changed = F.filter(
        F.zip_with("o", "n", lambda a, b: F.struct(a["field"].alias("field"), a["value"].alias("old"), b["value"].alias("new"))),
        lambda x: ~x["old"].eqNullSafe(x["new"]),
    )
    return (
        both.withColumn(
            "kind",
            F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed"),
        )
        .withColumn("rows", F.when(F.col("kind") == "changed", changed).otherwise(whole))
        .select(key, "kind", F.inline("rows"))
    )


def diff_document(diff: DataFrame, groups: DataFrame, group: str, key: str) -> DataFrame:
    """One row per group of ``groups``: what ``snapshot_diff`` rows say about it.

    ``diff`` carries the group next to the columns of ``snapshot_diff``. The summary lists the
    changed fields by name, so it is bounded by their number; the rows themselves stay in ``diff``.
    """
    kind = F.col("kind")
    found = diff.groupBy(group).agg(
        F.count_if(kind == "added").alias("n_added"),
        F.count_if(kind == "removed").alias("n_removed"),
        F.count_distinct(F.when(kind == "changed", F.col(key))).alias("n_changed"),
        F.array_join(F.sort_array(F.collect_set(F.when(kind == "changed", F.col("field")))), ",").alias("summary"),
    )
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_added", "n_removed", "n_changed")]
    return groups.join(found, group, "left").select(
        group, F.col("summary").isNotNull().alias("is_changed"), *counts,
        F.coalesce("summary", F.lit("")).alias("summary"),
    )


#: Lists inside a report whose items are entities of their own: name of the list, entity and the field that names an item.
ENTITIES = {"bouts": ("bout", "bout_id"), "fighters": ("fighter", "slug")}


def report_fields(reports: DataFrame, key: str, report: str = "report") -> DataFrame:
    """One row per field of every entity of a report: key, entity, entity_id, path, value (text).

    The walk follows the schema: structs are part of the entity around them, lists in ENTITIES hold entities of their own
    wherever they stand, other lists count whole. Bookkeeping fields are left out, totals go by their bucket, texts without
    regard to spacing. An entity without an id is left out; of two with one id and path the smaller value counts.
    """

    def leaf(value: Column, name: str, kind) -> Column:
        if isinstance(kind, (ArrayType, MapType)):
            return F.to_json(value)
        text = value.cast("string")
        return odds.bucket_text(text) if name in hashing.BUCKETED else collapse_spaces(text)

    def walk(value: Column, kind: StructType, entity: Column, path: str, top: bool) -> list[Column]:
        """Arrays of (entity, entity_id, path, value)."""
        own, further = [], []
        for f in kind.fields:
            inner = value[f.name]
            if top and f.name in hashing.VOLATILE:
                continue
            if isinstance(f.dataType, StructType):
                further += walk(inner, f.dataType, entity, f"{path}{f.name}.", False)
            elif f.name in ENTITIES and isinstance(f.dataType, ArrayType):
                further.append(F.flatten(F.transform(inner, item_fields(f.dataType.elementType, *ENTITIES[f.name]))))
            else:
                own.append(F.struct(
                    entity["entity"].alias("entity"), entity["entity_id"].alias("entity_id"), F.lit(path + f.name).alias("path"),
                    leaf(inner, f.name, f.dataType).alias("value")))
        return [F.array(*own), *[F.coalesce(x, F.array().cast(_FIELDS)) for x in further]] if own else further

    def item_fields(kind: StructType, label: str, name: str):
        def fields_of(item: Column) -> Column:
            named = F.struct(F.lit(label).alias("entity"), item[name].cast("string").alias("entity_id"))
            return F.flatten(F.array(*walk(item, kind, named, "", False)))

        return fields_of

    kind = reports.schema[report].dataType
    root = F.struct(F.lit("event").alias("entity"), F.col(key).cast("string").alias("entity_id"))
    fields = F.flatten(F.array(*walk(F.col(report), kind, root, "", True)))
    return reports.select(key, F.explode(fields).alias("f_")).select(key, "f_.*").filter(F.col("entity_id").isNotNull()).groupBy(
        key, "entity", "entity_id", "path").agg(F.min("value").alias("value"))


_FIELDS = "array<struct<entity:string,entity_id:string,path:string,value:string>>"


def report_diff(old: DataFrame, new: DataFrame, key: str, report: str = "report") -> DataFrame:
    """What changed between two versions of nested reports: key, entity, entity_id, kind, path, old, new.

    Bouts meet by their id and fighters by their slug, wherever they stand in their list. An entity on one side only is one
    row (path ``*``), as is a report on one side only, with its entities.
    """
    before, after = (report_fields(df, key, report).withColumnRenamed("value", name) for df, name in ((old, "old"), (new, "new")))
    at = [key, "entity", "entity_id", "path"]
    both = before.withColumn("was", F.lit(True)).join(after.withColumn("is", F.lit(True)), at, "full_outer")
    sides = both.groupBy(key, "entity", "entity_id").agg(
        F.bool_or(F.coalesce("was", F.lit(False))).alias("was"), F.bool_or(F.coalesce("is", F.lit(False))).alias("is"),
        F.collect_list(F.when(~F.col("old").eqNullSafe(F.col("new")), F.struct("path", "old", "new"))).alias("changes"))
    whole = F.array(F.struct(F.lit("*").alias("path"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new")))
    kind = F.when(~F.col("was"), "added").when(~F.col("is"), "removed").otherwise("changed")
    rows = F.when(F.col("was") & F.col("is"), F.col("changes")).otherwise(whole)
    return sides.select(key, "entity", "entity_id", kind.alias("kind"), F.inline(rows))


def diff_summary(diff: DataFrame, key: str) -> DataFrame:
    """Per changed report the ids of its changed bouts and fighters (lists as long as a report's), and their number."""

    def ids(entity: str) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(F.col("entity") == entity, F.col("entity_id")))), ",")

    return diff.groupBy(key).agg(
        ids("bout").alias("changed_bouts"), ids("fighter").alias("changed_fighters"),
        F.bool_or(F.col("entity") == "event").alias("event_changed"), F.count("*").alias("n_fields"))

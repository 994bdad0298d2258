"""Nested reports: canonical hash and difference of two versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringside.functions import hashing
from ringside.operators import changes
from ringside.plans import sqltext as q
from ringside.plans.adapters import big, bouts
from ringside.plans.catalog import query

c = F.col


def reports(spark, d, turned: bool = False, version: int = 0):
    """One report per card with bouts and their two fighters, at most twelve bouts.

    ``turned`` gives the fields in another order. Version 1 moves totals within their bucket, version 2 moves one bucket,
    renames, reorders, adds and removes.
    """
    key, pos = c("bout_key"), c("pos")
    over = F.lit(1.5) + (key % 20) * 0.05
    if version == 1:
        over = over + 0.01
    if version == 2:
        over = F.when(key % 5 == 1, over + 0.1).otherwise(over)

    def fighter(side: str, name):
        if version == 2:
            name = F.when(key % 7 == 2, F.concat(name, F.lit(" Jr"))).otherwise(F.concat(F.lit("  "), F.replace(name, F.lit(" "), F.lit("  "))))
        fields = [F.concat(F.lit(f"{side}-"), key).alias("slug"), name.alias("name"), F.struct(
            big(key % 30).alias("wins"), big(key % 11).alias("losses")).alias("record")]
        return F.struct(*(fields[::-1] if turned else fields))

    fields = [
        F.concat(F.lit("b-"), key).alias("bout_id"), F.when(key % 6 != 0, c("kind")).alias("weight_class"),
        F.format_string("%.2f", over).alias("over_1_5_decimal"),
        F.when(key % 3 != 0, F.lit("n/a")).alias("over_2_5_decimal"),
        F.array(fighter("a", c("a_name")), fighter("b", c("b_name"))).alias("fighters"),
    ]
    listed = bouts(spark, d)
    if version == 2:
        listed = listed.filter(key % 9 != 4)
    bout = F.struct("pos", F.struct(*(fields[::-1] if turned else fields)).alias("bout"))
    cards = listed.groupBy("card").agg(F.array_sort(F.collect_list(bout)).alias("rows"))
    rows = F.transform("rows", lambda r: r["bout"])
    if version == 2:
        rows = F.reverse(rows)
    head = F.struct(F.concat(F.lit("UFC "), c("card")).alias("name"), F.lit(None).cast("string").alias("location"))
    report = [
        F.current_timestamp().alias("generated_at"), head.alias("event"), rows.alias("bouts"),
        F.array(F.lit("one"), F.lit("two")).alias("sources"),
    ]
    return cards.select("card", F.struct(*(report[::-1] if turned else report)).alias("report"))


_BUCKET = "printf('%.2f', round_even({} / 0.05::DOUBLE, 0) * 0.05::DOUBLE)"
_OVER = "CAST(printf('%.2f', 1.5::DOUBLE + (bout_key % 20) * 0.05::DOUBLE) AS DOUBLE)"


def _report_json(over: str) -> str:
    def fighter(side: str) -> str:
        return (f"""'{{"name":"' || {side}_name || '","record":{{"losses":' || bout_key % 11 || ',"wins":' || bout_key % 30 """
                f"""|| '}},"slug":"{side}-' || bout_key || '"}}'""")

    bout = (f"""'{{"bout_id":"b-' || bout_key || '","fighters":[' || {fighter('a')} || ',' || {fighter('b')} || '],"over_1_5_decimal":"' || """
            f"""{over} || '","over_2_5_decimal":' || CASE WHEN bout_key % 3 <> 0 THEN '"n/a"' ELSE 'null' END || ',"weight_class":' || """
            """CASE WHEN bout_key % 6 <> 0 THEN '"' || kind || '"' ELSE 'null' END || '}'""")
    return (f"""'{{"bouts":[' || string_agg({bout}, ',' ORDER BY pos) || '],"event":{{"location":null,"name":"UFC ' || card || """
            """'"},"sources":["one","two"]}'""")


@query("report_hash", f"""WITH {q.BOUTS}
SELECT card, sha256({_report_json(_BUCKET.format(_OVER))}) AS hash, true AS same_when_turned, true AS same_in_bucket,
  false AS same_after_change,
  sha256({_report_json("printf('%.2f', " + _OVER + ")")}) AS exact_hash
FROM bouts GROUP BY card""")
def report_hash(spark, d):
    """C27, nested: the hash of a report; equal under field order and small moves of totals, different when one moves a bucket"""

    def hashed(df, name, meaningful=True):
        return df.select("card", hashing.nested_hash(c("report"), df.schema["report"].dataType, meaningful).alias(name))

    base = reports(spark, d)
    joined = hashed(base, "hash").join(hashed(reports(spark, d, turned=True), "turned"), "card").join(
        hashed(reports(spark, d, version=1), "moved"), "card").join(hashed(reports(spark, d, version=2), "changed"), "card", "left").join(
        hashed(base, "exact_hash", False), "card")
    return joined.select(
        "card", "hash", (c("hash") == c("turned")).alias("same_when_turned"), (c("hash") == c("moved")).alias("same_in_bucket"),
        F.coalesce(c("hash") == c("changed"), F.lit(False)).alias("same_after_change"), "exact_hash")


_DIFF = f"""{q.BOUTS}, cards AS (SELECT card, bool_or(bout_key % 9 <> 4) AS stays FROM bouts GROUP BY card),
diff AS (
  SELECT card, 'bout' AS entity, 'b-' || bout_key AS entity_id, 'removed' AS kind, '*' AS path, NULL AS old, NULL AS new FROM bouts WHERE bout_key % 9 = 4
  UNION ALL SELECT card, 'fighter', side || '-' || bout_key, 'removed', '*', NULL, NULL FROM bouts, (VALUES ('a'), ('b')) s(side) WHERE bout_key % 9 = 4
  UNION ALL SELECT card, 'event', CAST(card AS VARCHAR), 'removed', '*', NULL, NULL FROM cards WHERE NOT stays
  UNION ALL SELECT card, 'bout', 'b-' || bout_key, 'changed', 'over_1_5_decimal', {_BUCKET.format(_OVER)}, {_BUCKET.format('(' + _OVER + ' + 0.1::DOUBLE)')}
    FROM bouts WHERE bout_key % 5 = 1 AND bout_key % 9 <> 4
  UNION ALL SELECT card, 'fighter', side || '-' || bout_key, 'changed', 'name', CASE side WHEN 'a' THEN a_name ELSE b_name END,
    CASE side WHEN 'a' THEN a_name ELSE b_name END || ' Jr' FROM bouts, (VALUES ('a'), ('b')) s(side) WHERE bout_key % 7 = 2 AND bout_key % 9 <> 4)"""


def _diff(spark, d):
    return changes.report_diff(reports(spark, d), reports(spark, d, turned=True, version=2), "card")


@query("report_diff", f"WITH {_DIFF} SELECT * FROM diff")
def report_diff(spark, d):
    """J6, nested: changed fields of bouts and fighters inside two versions of a report, whatever the order of either"""
    return _diff(spark, d)


@query("report_diff_summary", f"""WITH {_DIFF} SELECT card,
  coalesce(string_agg(DISTINCT CASE WHEN entity = 'bout' THEN entity_id END, ',' ORDER BY CASE WHEN entity = 'bout' THEN entity_id END), '') AS changed_bouts,
  coalesce(string_agg(DISTINCT CASE WHEN entity = 'fighter' THEN entity_id END, ',' ORDER BY CASE WHEN entity = 'fighter' THEN entity_id END), '') AS changed_fighters,
  bool_or(entity = 'event') AS event_changed, count(*) AS n_fields FROM diff GROUP BY card""")
def report_diff_summary(spark, d):
    """Per report the changed bouts and fighters"""
    return changes.diff_summary(_diff(spark, d), "card")

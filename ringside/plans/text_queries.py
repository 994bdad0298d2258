"""Text assembly and report documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringside.functions import classify, dates, hashing, render, urls
from ringside.functions.odds import american_to_decimal
from ringside.operators import documents
from ringside.plans import sqltext as q
from ringside.plans.adapters import big, bouts, fighters_count, last_five, pick, records, table
from ringside.plans.catalog import ORACLES, query
from ringside.plans.history_queries import _COMMENTS, _SUMMARY, comments, summary
from ringside.plans.source_queries import parsed_inbox
from ringside.session import scratch_path
from ringside.sources import markdown, sinks

c = F.col


def documents_of(spark, d):
    """Records with every field of their Markdown form."""
    key = c("record_id")
    return records(spark, d).select(
        "record_id", "entity_type", "project_key", "source_url", "raw_input", "normalized_text", "extracted_content",
        "link_fetch_status", "link_fetch_error",
        key.cast("string").alias("id"),
        F.concat(F.lit("Record "), key.cast("string")).alias("title"),
        F.lit("text").alias("source_type"), F.lit("new").alias("status"),
        F.lit("not_exported").alias("sync_export_status"), F.lit(None).cast("string").alias("sync_export_target"),
        dates.iso_seconds(c("created_ts")).alias("created_at"), dates.iso_seconds(c("created_ts")).alias("updated_at"),
        urls.extract_links(c("raw_input")).alias("links"),
        F.when(key % 3 == 0, "Analysis").otherwise("").alias("analysis"),
    )


_LINKS_SQL = """CASE WHEN len(links) > 0 THEN '- ' || array_to_string(links, chr(10) || '- ') ELSE '- ссылок нет' END"""
_BODY_SQL = f"""'## Raw Input' || nl || raw_input || nl || nl || '## Normalized Text' || nl || coalesce(nullif(normalized_text, ''), 'Нет нормализованного текста.')
  || nl || nl || '## Links' || nl || {_LINKS_SQL} || nl || nl || '## Extracted Content' || nl || coalesce(nullif(extracted_content, ''), 'Извлечённого содержимого нет.')"""
_META_SQL = """'- Source URL: `' || coalesce(source_url, 'n/a') || '`' || nl || '- Link fetch status: `' || link_fetch_status || '`' || nl ||
  '- Link fetch error: `' || coalesce(link_fetch_error, 'n/a') || '`' || nl"""


@query("record_markdown", f"""WITH {q.RECORDS}, {_COMMENTS},
r AS (SELECT *, chr(10) AS nl, regexp_extract_all(raw_input, 'https?://\\S+') AS links, {q.iso_seconds('created_ts')} AS created_at,
  record_id IN (SELECT record_id FROM comments) AS has FROM records)
SELECT record_id, 0::BIGINT AS part_no, '# Record ' || record_id || nl || nl || '- ' || CASE entity_type WHEN 'idea' THEN 'Idea' ELSE 'Context' END || ' ID: `' || record_id || '`' || nl ||
  '- Project: `' || project_key || '`' || nl || '- Source type: `text`' || nl || CASE entity_type WHEN 'idea' THEN '- Status: `new`' || nl ELSE '' END || {_META_SQL} ||
  '- Sync export status: `not_exported`' || nl || '- Sync export target: `n/a`' || nl || '- Created at: `' || created_at || '`' || nl ||
  CASE entity_type WHEN 'idea' THEN '- Updated at: `' || created_at || '`' || nl ELSE '' END || nl || {_BODY_SQL} || nl ||
  CASE entity_type WHEN 'idea' THEN nl || '## Analysis' || nl || CASE WHEN record_id % 3 = 0 THEN 'Analysis' ELSE 'Анализ пока отсутствует.' END || nl || nl || '## Comments' || nl ||
    CASE WHEN has THEN '' ELSE '- комментариев пока нет' || nl END ELSE '' END AS body FROM r
UNION ALL
SELECT record_id, turn // 1000 + 1, string_agg('- ' || {q.iso_seconds('created')} || ' | ' || author || ': ' || text, chr(10) ORDER BY turn) || chr(10)
FROM comments WHERE record_id IN (SELECT record_id FROM records WHERE entity_type = 'idea') GROUP BY record_id, turn // 1000 + 1""")
def record_markdown(spark, d):
    """I1, stored forms"""
    notes = comments(spark, d).withColumn("created", dates.iso_seconds(c("created")))
    return documents.record_parts(documents_of(spark, d), notes)


IMPORTED_SQL = f"""r AS (SELECT *, chr(10) AS nl, CAST([] AS VARCHAR[]) AS links, left({q.collapse('raw_input')}, 80) AS t, {q.iso_seconds('created_ts')} AS created_at FROM records
  WHERE record_id % 11 <> 0 AND record_id % 13 <> 0 AND record_id % 17 <> 0),
s AS (SELECT record_id, '# ' || CASE WHEN record_id % 3 = 0 OR t = '' THEN 'Без названия' ELSE t END || nl || nl || '- Imported entity: `' || entity_type || '`' || nl ||
  '- Project: `' || project_key || '`' || nl || '- Source type: `text`' || nl || '- Source URL: `' || coalesce(source_url, 'n/a') || '`' || nl ||
  '- Link fetch status: `not_applicable`' || nl || '- Link fetch error: `n/a`' || nl || '- Created at: `' || created_at || '`' || nl || nl ||
  '## Raw Input' || nl || raw_input || nl || nl || '## Normalized Text' || nl || coalesce(nullif(normalized_text, ''), 'Нет нормализованного текста.') || nl || nl ||
  '## Links' || nl || '- ссылок нет' || nl || nl || '## Extracted Content' || nl || 'Извлечённого содержимого нет.' || nl ||
  CASE entity_type WHEN 'idea' THEN nl || '## Analysis' || nl || 'Анализ не приложен.' || nl || nl || '## Comments' || nl || '- комментариев нет' || nl ELSE '' END AS body FROM r)"""


@query("imported_markdown", f"WITH {q.RECORDS}, {IMPORTED_SQL} SELECT * FROM s")
def imported_markdown(spark, d):
    """I1, imported form"""
    good = parsed_inbox(spark, d).filter(c("error_reason").isNull())
    body = render.imported_document(c("entity_type"), lambda n: c(f"record.{n}"))
    return good.select("record_id", body.alias("body"))


@query("dual_write", ORACLES["record_markdown"])
def dual_write(spark, d):
    """B1: records and documents written in two goes, the second over a part of the first; the documents as stored"""
    path, rows = scratch_path(spark, "dual"), documents_of(spark, d)
    notes = comments(spark, d).withColumn("created", dates.iso_seconds(c("created")))
    key = c("record_id")
    draft = rows.filter(key % 3 != 0).withColumn("title", F.lit("draft"))
    for part in (draft, rows.filter(key % 2 == 0), rows.filter(key % 2 == 1)):
        sinks.dual_write(part, documents.record_parts(part, notes), path)
    return sinks.read_documents(spark, "record_id", f"{path}/documents")


@query("summary_line", """WITH t AS (SELECT o_orderkey, chr(10) AS nl, 'Event ' || o_orderpriority AS name, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_custkey % 15 AS VARCHAR) AS n,
  CASE WHEN o_orderstatus = 'O' THEN 'baseline' ELSE 'incremental' END AS kind FROM orders)
SELECT o_orderkey, CASE kind WHEN 'baseline' THEN 'UFC baseline report' ELSE 'UFC report update' END || nl || 'Турнир: ' || name || nl || 'Дата: ' || day || nl || 'Боёв: ' || n || nl ||
  CASE kind WHEN 'baseline' THEN 'Найден турнир на ближайшие выходные. Полный Markdown-отчёт прикреплён файлом.'
  ELSE 'Есть meaningful changes относительно последней отправленной версии. Обновлённый Markdown-отчёт прикреплён файлом.' END AS message,
  name || ' | ' || day || ' | ' || CASE kind WHEN 'baseline' THEN 'baseline' ELSE 'update' END AS caption, day || '-' || lower(replace(name, ' ', '-')) || '-' || kind || '.md' AS file_name FROM t""")
def summary_line(spark, d):
    """I3"""
    kind = F.when(c("o_orderstatus") == "O", "baseline").otherwise("incremental")
    name = F.concat(F.lit("Event "), c("o_orderpriority"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    slug = F.lower(F.replace(name, F.lit(" "), F.lit("-")))
    return table(spark, d, "orders").select(
        "o_orderkey",
        render.summary_message(kind, name, day, (c("o_custkey") % 15).cast("string")).alias("message"),
        render.caption(kind, name, day).alias("caption"),
        render.delivery_file(kind, slug, day).alias("file_name"),
    )


_ANALYSIS_INPUT = """CASE WHEN coalesce(source_url, '') <> '' AND extracted_content <> '' THEN 'Источник: ' || source_url || chr(10) || chr(10) || 'Комментарий пользователя:' || chr(10) ||
  coalesce(nullif(normalized_text, ''), raw_input) || chr(10) || chr(10) || 'Извлечённое содержимое ссылки:' || chr(10) || extracted_content ELSE coalesce(nullif(normalized_text, ''), raw_input) END"""


@query("analysis_input", f"WITH {q.RECORDS} SELECT record_id, {_ANALYSIS_INPUT} AS input FROM records")
def analysis_input(spark, d):
    """I6"""
    return records(spark, d).select(
        "record_id",
        render.analysis_input(c("source_url"), c("normalized_text"), c("raw_input"), c("extracted_content")).alias("input"),
    )


_ANALYSIS_TEXT = {
    "lead": "` через цель, гипотезу ценности и понятный результат. Добавь один конкретный сценарий использования и критерий успеха.",
    "effect": "## Что изменилось после комментария\n- Новый комментарий: ",
}


@query("template_analysis", f"""WITH {_COMMENTS}, h AS (SELECT record_id, count(*) AS n, max_by(text, turn) AS latest FROM comments GROUP BY record_id),
{q.RECORDS}, t AS (SELECT records.record_id, entity_type, project_key, raw_input, coalesce(n, 0) AS n, coalesce(latest, 'Комментариев пока нет.') AS latest, chr(10) AS nl FROM records LEFT JOIN h ON h.record_id = records.record_id)
SELECT record_id, CASE entity_type WHEN 'idea' THEN '## Усиление идеи' || nl || 'Сформулируй идею для проекта `' || project_key || '{_ANALYSIS_TEXT['lead']}' || nl || nl ||
  CASE WHEN n > 0 THEN '## Что изменилось после комментария' || nl || '- Новый комментарий: ' || latest || nl ||
    '- Пересобери гипотезу так, чтобы этот комментарий стал явным ограничением или критерием.' || nl || '- Добавь один проверочный шаг именно под новый комментарий.' || nl || nl ELSE '' END ||
  '## Что в ней сильного' || nl || '- Есть исходный импульс для действия.' || nl || '- Идею уже можно привязать к существующему проекту и рабочей базе.' || nl ||
  '- Её можно быстро превратить в проверяемую гипотезу.' || nl || nl || '## Что вызывает сомнения' || nl || '- Пока не хватает численного критерия успеха.' || nl ||
  '- Не до конца ясно, что именно является главным риском.' || nl || '- Может смешиваться сама идея и способ реализации.' || nl || nl || '## Как проверить быстро' || nl ||
  '- Сформулировать одну проверяемую гипотезу.' || nl || '- Определить, какие данные или сигналы подтвердят ценность.' || nl || '- Зафиксировать самый дешёвый следующий тест.' || nl || nl ||
  '## Следующий лучший шаг' || nl || 'Перепиши идею в одном абзаце и обнови её с учётом последнего комментария. Комментариев в истории: ' || n || '. Последний комментарий: ' || latest ||
  nl || nl || 'Исходный текст идеи:' || nl || raw_input
ELSE '## О чём материал' || nl || 'Это контекст для проекта `' || project_key || '`. Его стоит воспринимать как источник знаний или внешнее наблюдение.' || nl || nl || '## Ключевые мысли' || nl ||
  '- В материале есть полезный сигнал, который стоит учитывать в проекте.' || nl || '- Его лучше использовать как фон для решений и новых идей.' || nl ||
  '- При необходимости из него можно позже сделать отдельную идею.' || nl || nl || '## Почему это важно для проекта' || nl || '- Контекст помогает принимать решения не в вакууме.' || nl ||
  '- Он сохраняет внешние наблюдения рядом с рабочими материалами.' || nl || nl || '## Что стоит запомнить' || nl || left(raw_input, 1400) END AS analysis FROM t""")
def template_analysis(spark, d):
    """I4"""
    notes = comments(spark, d).groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("text", "turn").alias("latest")
    )
    joined = records(spark, d).select("record_id", "entity_type", "project_key", "raw_input").join(notes, "record_id", "left")
    count = F.coalesce("n", F.lit(0))
    analysis = render.template_analysis(c("raw_input"), c("project_key"), c("latest"), count)
    return joined.select(
        "record_id",
        F.when(c("entity_type") == "idea", analysis)
        .otherwise(render.template_summary(c("raw_input"), c("project_key"))).alias("analysis"),
    )


_FILES = ("README.md", "ideas.md", "current-system.md", "current-context.md", "first-questions.md")


@query("context_pack", f"""WITH t AS (SELECT doc_id // 5 AS pack_no, doc_id % 5 AS ord, text AS body FROM documents)
SELECT pack_no, string_agg(CASE WHEN ord = 0 THEN '# Project README' || chr(10) || left(body, 2500)
  ELSE '# Inbox Context: ' || ([{', '.join(q.lit(f) for f in _FILES)}])[ord + 1] || chr(10) || left(body, 2000) END, chr(10) || chr(10) ORDER BY ord) AS pack
FROM t GROUP BY pack_no""")
def context_pack(spark, d):
    """Five neighbouring documents are the files of one project; texts are cut before they move"""
    files = table(spark, d, "documents").select(
        F.expr("doc_id div 5").alias("pack_no"), (c("doc_id") % 5).alias("ord"),
        F.substring("text", 1, 2_500).alias("body"),
    )
    return documents.context_pack(files.withColumn("name", pick(_FILES, c("ord"))), ["pack_no"])


@query("pack_cut", ORACLES["context_pack"].replace("SELECT pack_no, string_agg", "SELECT pack_no, left(string_agg", 1)
       .replace("ORDER BY ord) AS pack", "ORDER BY ord), 5000) AS pack", 1))
def pack_cut(spark, d):
    """The part of a pack that its reader takes"""
    return context_pack(spark, d).select("pack_no", documents.pack_for_reader(c("pack")).alias("pack"))


@query("append_text", f"""WITH {q.RECORDS}, n AS (SELECT conv_id, max_by(text, turn) AS note FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT record_id, CASE WHEN hit THEN {q.strip("raw_input || chr(10) || chr(10) || '[manual_text]' || chr(10) || note")} ELSE raw_input END AS raw_input,
  CASE WHEN hit THEN {q.strip("normalized_text || chr(10) || chr(10) || note")} ELSE normalized_text END AS normalized_text,
  CASE WHEN hit THEN note ELSE extracted_content END AS extracted_content, CASE WHEN hit THEN 'manual_text_added' ELSE link_fetch_status END AS link_fetch_status
FROM (SELECT records.*, note, link_fetch_status = 'fetch_failed' AND note IS NOT NULL AS hit FROM records LEFT JOIN n ON conv_id = record_id)""")
def append_text(spark, d):
    """users' last words go to records whose link could not be read"""
    base = records(spark, d).select(
        "record_id", "raw_input", "normalized_text", "extracted_content", "link_fetch_status"
    )
    notes = (
        comments(spark, d).filter(c("author") == "user").groupBy("record_id")
        .agg(F.max_by("text", "turn").alias("manual_text"))
    )
    failed = records(spark, d).filter(c("link_fetch_status") == "fetch_failed").select("record_id")
    return documents.append_manual_text(base, notes.join(failed, "record_id", "left_semi"))


@query("derive_records", f"""WITH {q.RECORDS}
SELECT left(replace(project_key, '-', ''), 5) || '-' || left(sha256('derived|' || record_id), 8) AS id, record_id AS derived_from, project_key, 'idea' AS entity_type,
  'context-derived' AS source_type, raw_input, coalesce(nullif(normalized_text, ''), nullif(raw_input, '')) AS normalized_text, source_url, extracted_content, link_fetch_status, link_fetch_error
FROM records WHERE entity_type = 'context'""")
def derive_records(spark, d):
    """I8"""
    new_id = hashing.short_id(
        hashing.record_prefix(c("project_key")), F.lit("derived"), c("record_id").cast("string")
    )
    return documents.derive_ideas(records(spark, d).filter(c("entity_type") == "context"), new_id)


# ---------------------------------------------------------------- event reports

def report_tables(spark, d):
    key = c("bout_key")
    even, users = key % 2 == 0, F.lit(fighters_count(spark, d))
    american = F.concat(F.when(even, "-").otherwise("+"), (100 + key % 900).cast("string"))
    rows = bouts(spark, d).select(
        "card", "pos", "bout_key",
        F.concat_ws(" ", "a_name", (key * 2).cast("string")).alias("a_name"),
        F.concat_ws(" ", "b_name", (key * 2 + 1).cast("string")).alias("b_name"),
        (key * 2 % users).alias("a_fighter"), ((key * 2 + 1) % users).alias("b_fighter"),
        F.when(key % 7 != 0, c("kind")).alias("weight_class"),
        classify.segment_label(F.lit("Main Card"), c("pos")).alias("card_segment"),
        classify.rounds_label(F.lit("main"), c("pos")).alias("status"),
        F.when(key % 4 != 0, american_to_decimal(american)).alias("a_price"),
        F.lit("1.91").alias("b_price"),
        F.when(key % 3 == 0, "1.50").alias("over_1_5"), F.lit(None).cast("string").alias("over_2_5"),
        F.concat(F.lit("Бой номер "), key.cast("string")).alias("commentary"),
    )
    cards = rows.groupBy("card").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos")).select(
        "card", "first_pos",
        F.concat(F.lit("UFC Card "), c("card").cast("string")).alias("event_name"),
        F.lit("Weekly").alias("title_suffix"),
        F.date_add(F.lit("2024-01-06").cast("date"), (c("card") % 300).cast("int")).cast("string").alias("event_date"),
        F.lit("Arena, City").alias("venue"), F.lit("UFC").alias("promotion"), F.lit("TV").alias("broadcast"),
        c("n").cast("string").alias("confirmed"),
        F.array(F.lit("[card](https://example.com/card)"), F.concat(F.lit("[odds](https://example.com/"), c("card").cast("string"), F.lit(")"))).alias("sources"),
        F.lit("full-card detailed").alias("report_format"), F.lit("русский").alias("language"), F.lit("decimal only").alias("odds_format"),
        F.when(c("card") % 2 == 0, F.array(F.lit("Оценка: `good` вместо `weak`"), F.lit("второе")))
        .otherwise(F.array(F.lit("без оценки"))).alias("quality_notes"),
        F.when(c("card") % 3 == 0, F.array(F.lit("конец"))).otherwise(F.array().cast("array<string>")).alias("final_notes"),
    )
    fighter = c("fighter")
    five = last_five(spark, d).select(
        "fighter", "pos", "fight_date", "opponent", classify.result_marker(c("result")).alias("result"), "method", "round",
        classify.promotion(c("event_name")).alias("promotion"), "event_name",
    )
    stats = summary(spark, d).select("fighter", "record_summary", "wins_summary", "losses_summary")
    signals = stats.filter(fighter % 2 == 0).select(
        "fighter", F.lit(1).alias("pos"), F.concat(F.lit("простой "), fighter.cast("string")).alias("summary"),
        F.lit("fight history").alias("source"),
    )
    fighters = stats.join(documents.fighter_lines(five, signals), "fighter", "left").select(
        "*",
        F.when(fighter % 5 == 0, F.array(F.concat(F.lit("note "), fighter.cast("string")))).otherwise(F.array().cast("array<string>")).alias("notes"),
        F.array(F.concat(F.lit("[history](https://example.com/f/"), fighter.cast("string"), F.lit(")"))).alias("sources"),
        F.concat(F.lit("форма "), fighter.cast("string")).alias("commentary"),
    )
    return cards, rows, fighters


_REPORT = f"""{_SUMMARY}, {q.BOUTS},
rk AS (SELECT *, row_number() OVER (PARTITION BY fighter ORDER BY ts DESC, event_id DESC) AS p,
  CASE result WHEN 'W' THEN '🟩 W' WHEN 'L' THEN '🟥 L' WHEN 'D' THEN '🟨 D' ELSE '⬜ NC' END AS marker,
  CASE WHEN starts_with(event_name, 'UFC') THEN 'UFC' WHEN starts_with(event_name, 'LFA') THEN 'LFA' WHEN starts_with(event_name, 'Bellator') THEN 'Bellator'
    ELSE string_split(event_name, ':')[1] END AS promo FROM fights),
five AS (SELECT * FROM rk WHERE p <= 5),
tl AS (SELECT fighter, string_agg('| ' || concat_ws(' | ', fight_date, opponent, marker, method, CAST(round AS VARCHAR), promo, event_name) || ' |', chr(10) ORDER BY p) AS rows FROM five GROUP BY fighter),
rb AS (SELECT card, pos, bout_key, a_name || ' ' || (bout_key * 2) AS a_name, b_name || ' ' || (bout_key * 2 + 1) AS b_name, bout_key * 2 % (SELECT max(user_id) + 1 FROM events) AS fa, (bout_key * 2 + 1) % (SELECT max(user_id) + 1 FROM events) AS fb,
  CASE WHEN bout_key % 7 <> 0 THEN kind ELSE 'n/a' END AS weight_class, CASE pos WHEN 0 THEN 'Main Event' WHEN 1 THEN 'Co-Main' ELSE 'Main Card' END AS card_segment,
  CASE WHEN pos = 0 THEN '5 x 5' ELSE '3 x 5' END AS status,
  CASE WHEN bout_key % 4 = 0 THEN 'n/a' WHEN bout_key % 2 = 0 THEN printf('%.2f', 1 + 100.0::DOUBLE / (100 + bout_key % 900)) ELSE printf('%.2f', 1 + (100 + bout_key % 900) / 100.0::DOUBLE) END AS a_price,
  '1.91' AS b_price, CASE WHEN bout_key % 3 = 0 THEN '1.50' ELSE 'n/a' END AS over_1_5, 'n/a' AS over_2_5, 'Бой номер ' || bout_key AS commentary FROM bouts),
sides AS (SELECT card, pos, 'a' AS side, a_name AS name, fa AS fighter FROM rb UNION ALL SELECT card, pos, 'b', b_name, fb FROM rb),
blocks AS (SELECT card, pos, side, '#### ' || name || nl || nl || '- Рекорд: `' || coalesce(record_summary, 'n/a') || '`' || nl || '- Победы по методам: `' || coalesce(wins_summary, 'n/a') || '`' || nl ||
  '- Поражения по методам: `' || coalesce(losses_summary, 'n/a') || '`' || nl || CASE WHEN s.fighter % 5 = 0 THEN '- Дополнительно: `note ' || s.fighter || '`' || nl ELSE '' END || '- Источники:' || nl ||
  CASE WHEN s.fighter IS NOT NULL THEN '  - [history](https://example.com/f/' || s.fighter || ')' || nl ELSE '' END || nl || 'Последние 5:' || nl || nl ||
  '| Дата | Соперник | Результат | Метод | Раунд | Промоушен | Ивент |' || nl || '| --- | --- | --- | --- | --- | --- | --- |' || nl || coalesce(rows, '| n/a | n/a | n/a | n/a | n/a | n/a | n/a |') || nl || nl ||
  'Короткий комментарий:' || nl || nl || '- ' || CASE WHEN s.fighter IS NOT NULL THEN 'форма ' || s.fighter ELSE 'n/a' END || nl || nl || 'Предбоевые сигналы:' || nl || nl ||
  CASE WHEN s.fighter % 2 = 0 THEN '- простой ' || s.fighter || nl || '- Источник: fight history' ELSE '- Существенных предбоевых сигналов не найдено.' || nl || '- Источник: `n/a`' END AS block
  FROM (SELECT *, chr(10) AS nl FROM sides) x LEFT JOIN summary s ON s.fighter = x.fighter LEFT JOIN tl ON tl.fighter = x.fighter),
cards AS (SELECT card, count(*) AS n, min(pos) AS first_pos, 'UFC Card ' || card AS event_name, strftime(DATE '2024-01-06' + CAST(card % 300 AS INTEGER), '%Y-%m-%d') AS event_date FROM rb GROUP BY card),
parts AS (
  SELECT card, 0::BIGINT AS part_no, '# ' || event_name || ' — Weekly' || nl || nl || '## Турнир' || nl || nl || '- Турнир: `' || event_name || '`' || nl || '- Дата: `' || event_date || '`' || nl ||
    '- Арена: `Arena, City`' || nl || '- Промоушен: `UFC`' || nl || '- Формат трансляции: `TV`' || nl || '- Подтверждённых боёв: `' || n || '`' || nl || '- Основные источники:' || nl ||
    '  - [card](https://example.com/card)' || nl || '  - [odds](https://example.com/' || card || ')' || nl || nl || '## Качество данных' || nl || nl || '- Формат отчёта: `full-card detailed`' || nl || '- Язык: `русский`' || nl ||
    '- Odds format: `decimal only`' || nl || CASE WHEN card % 2 = 0 THEN '- Оценка: `good` вместо `weak`' || nl || '- второе' ELSE '- без оценки' END || nl || nl || '## Легенда' || nl || nl ||
    '- `🟩 W` — победа' || nl || '- `🟥 L` — поражение' || nl || '- `🟨 D` — ничья' || nl || '- `⬜ NC` — no contest' || nl || nl || '## Бои' || nl AS body FROM (SELECT *, chr(10) AS nl FROM cards)
  UNION ALL SELECT rb.card, rb.pos + 1, CASE WHEN rb.pos = first_pos THEN '' ELSE chr(10) || '---' || chr(10) || chr(10) END || '### ' || a_name || ' vs. ' || b_name || nl || nl ||
    '`' || weight_class || '` | `' || card_segment || '` | `' || status || '`' || nl || nl || '#### Линии' || nl || nl || '- `' || a_name || '`: `' || a_price || '`' || nl || '- `' || b_name || '`: `' || b_price || '`' || nl ||
    '- `ТБ 1.5`: `' || over_1_5 || '`' || nl || '- `ТБ 2.5`: `' || over_2_5 || '`' || nl || nl || a.block || nl || nl || b.block || nl || nl || 'Комментарий по бою:' || nl || nl || '- ' || commentary
    FROM (SELECT *, chr(10) AS nl FROM rb) rb JOIN blocks a ON a.card = rb.card AND a.pos = rb.pos AND a.side = 'a' JOIN blocks b ON b.card = rb.card AND b.pos = rb.pos AND b.side = 'b' JOIN cards ON cards.card = rb.card
  UNION ALL SELECT card, 1000000000, chr(10) || '## Финальные замечания' || chr(10) || chr(10) || '- конец' FROM cards WHERE card % 3 = 0)"""


@query("report_markdown", f"WITH {_REPORT} SELECT card, part_no, body FROM parts")
def report_markdown(spark, d):
    """I2"""
    return documents.report_parts(*report_tables(spark, d))


def whole_reports(spark, d):
    """Report texts; a card has twelve bouts at most by its key."""
    parts = report_markdown(spark, d)
    ordered = F.array_sort(F.collect_list(F.struct("part_no", "body")))
    return parts.groupBy("card").agg(ordered.alias("p")).select(
        "card", F.concat(F.regexp_replace(F.array_join(F.col("p.body"), "\n"), r"\s+\z", ""), F.lit("\n")).alias("body")
    )


@query("md_report_parse", f"""WITH {_REPORT}
SELECT card, pos, side, p - 1 AS fight_pos, name, fight_date, opponent, marker AS result, method, CAST(round AS VARCHAR) AS round, promo AS promotion, event_name
FROM sides JOIN five USING (fighter)
UNION ALL SELECT card, pos, side, 0, name, 'n/a', 'n/a', 'n/a', 'n/a', 'n/a', 'n/a', 'n/a' FROM sides WHERE fighter NOT IN (SELECT fighter FROM five)""")
def md_report_parse(spark, d):
    """Rendered reports read back to fight rows"""
    parsed = markdown.parse_bouts(whole_reports(spark, d), "card")
    rows = markdown.parse_fights(markdown.parse_fighters(parsed, "card"), "card")
    return rows.withColumn("pos", big(c("pos"))).withColumn("fight_pos", big(c("fight_pos")))


@query("md_bouts", f"""WITH {_REPORT}
SELECT card, pos, a_name, b_name, {q.slug("a_name || ' vs. ' || b_name")} AS bout_id, weight_class, card_segment, status, a_price, b_price, over_1_5, over_2_5, commentary FROM rb""")
def md_bouts(spark, d):
    """A9, bouts"""
    return markdown.parse_bouts(whole_reports(spark, d), "card").drop("a_block", "b_block").withColumn("pos", big(c("pos")))


@query("md_fighters", f"""WITH {_REPORT}
SELECT card, pos, side, name, coalesce(record_summary, 'n/a') AS record_summary, coalesce(wins_summary, 'n/a') AS wins_summary, coalesce(losses_summary, 'n/a') AS losses_summary,
  coalesce('[history](https://example.com/f/' || s.fighter || ')', '') AS sources, CASE WHEN s.fighter IS NULL THEN 'n/a' ELSE 'форма ' || s.fighter END AS commentary,
  CASE WHEN s.fighter % 2 = 0 THEN 'простой ' || s.fighter ELSE 'Существенных предбоевых сигналов не найдено.' END AS signal_summary,
  CASE WHEN s.fighter % 2 = 0 THEN 'fight history' ELSE '`n/a`' END AS signal_source, CASE WHEN s.fighter % 2 = 0 THEN 'context' ELSE 'none' END AS signal_type
FROM sides LEFT JOIN summary s ON s.fighter = sides.fighter""")
def md_fighters(spark, d):
    """A9, fighters"""
    parsed = markdown.parse_fighters(markdown.parse_bouts(whole_reports(spark, d), "card"), "card")
    return parsed.drop("block").withColumn("sources", F.array_join("sources", "|")).withColumn("pos", big(c("pos")))


@query("md_events", f"""WITH {_REPORT}
SELECT card, event_name, 'Weekly' AS title_suffix, event_date, 'Arena, City' AS venue, 'UFC' AS promotion, 'TV' AS broadcast, CAST(n AS VARCHAR) AS confirmed,
  '[card](https://example.com/card)|[odds](https://example.com/' || card || ')' AS sources, 'full-card detailed' AS report_format, 'русский' AS language, 'decimal only' AS odds_format,
  CASE WHEN card % 2 = 0 THEN 'Оценка: `good` вместо `weak`|второе' ELSE 'без оценки' END AS quality_notes, CASE WHEN card % 2 = 0 THEN 'good' ELSE 'partial' END AS quality_label,
  CASE WHEN card % 3 = 0 THEN 'конец' ELSE '' END AS final_notes FROM cards""")
def md_events(spark, d):
    """A9, C23, event fields"""
    events = markdown.parse_events(whole_reports(spark, d), "card")
    for name in ("sources", "quality_notes", "final_notes"):
        events = events.withColumn(name, F.array_join(name, "|"))
    return events

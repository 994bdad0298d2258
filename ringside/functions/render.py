"""Markdown and message texts as columns. ``n/a`` appears only here.

The Russian and English texts in this module are fixed values: they are the
document formats themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ringside.functions.text import blank_to_null, first_filled

NA = "n/a"


def text_of(*parts) -> Column:
    """Concatenation of columns and literal texts."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def or_na(col: Column) -> Column:
    return F.coalesce(blank_to_null(col), F.lit(NA))


def lines(*parts) -> Column:
    return F.concat_ws("\n", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def bullets(items: Column, empty: str, mark: str = "- ") -> Column:
    """One bullet line per item, or the text for an empty list."""
    listed = F.array_join(F.transform(items, lambda x: F.concat(F.lit(mark), x)), "\n")
    return F.when(F.size(items) > 0, listed).otherwise(empty)


def field(label: str, value: Column) -> Column:
    return text_of(f"- {label}: `", value, "`")


def _sections(c, extracted_default: str = "Извлечённого содержимого нет.") -> list:
    return [
        "## Raw Input", F.coalesce(c("raw_input"), F.lit("")), "",
        "## Normalized Text", first_filled(c("normalized_text"), F.lit("Нет нормализованного текста.")), "",
        "## Links", bullets(F.coalesce(c("links"), F.array().cast("array<string>")), "- ссылок нет"), "",
        "## Extracted Content", first_filled(c("extracted_content"), F.lit(extracted_default)),
    ]


def idea_head(c=F.col) -> Column:
    """An idea document up to its comment list."""
    return lines(
        text_of("# ", c("title")), "",
        field("Idea ID", c("id")),
        field("Project", c("project_key")),
        field("Source type", c("source_type")),
        field("Status", c("status")),
        field("Source URL", or_na(c("source_url"))),
        field("Link fetch status", c("link_fetch_status")),
        field("Link fetch error", or_na(c("link_fetch_error"))),
        field("Sync export status", c("sync_export_status")),
        field("Sync export target", or_na(c("sync_export_target"))),
        field("Created at", c("created_at")),
        field("Updated at", c("updated_at")), "",
        *_sections(c), "",
        "## Analysis", first_filled(c("analysis"), F.lit("Анализ пока отсутствует.")), "",
        "## Comments",
    )


def context_document(c=F.col) -> Column:
    return text_of(
        lines(
            text_of("# ", c("title")), "",
            field("Context ID", c("id")),
            field("Project", c("project_key")),
            field("Source type", c("source_type")),
            field("Source URL", or_na(c("source_url"))),
            field("Link fetch status", c("link_fetch_status")),
            field("Link fetch error", or_na(c("link_fetch_error"))),
            field("Sync export status", c("sync_export_status")),
            field("Sync export target", or_na(c("sync_export_target"))),
            field("Created at", c("created_at")), "",
            *_sections(c),
        ),
        "\n",
    )


def imported_document(entity: Column, c=F.col) -> Column:
    """Inbox payload as Markdown; ideas also show analysis and comments."""
    comments = F.transform(
        F.coalesce(c("comments"), F.array().cast("array<struct<created_at:string,author:string,text:string>>")),
        lambda m: text_of(
            F.coalesce(m["created_at"], F.lit("")), " | ",
            F.coalesce(m["author"], F.lit("unknown")), ": ", F.coalesce(m["text"], F.lit("")),
        ),
    )
    head = lines(
        text_of("# ", first_filled(c("title"), F.lit("Без названия"))), "",
        field("Imported entity", entity),
        field("Project", first_filled(c("project_key"), F.lit("unknown"))),
        field("Source type", first_filled(c("source_type"), F.lit("unknown"))),
        field("Source URL", or_na(c("source_url"))),
        field("Link fetch status", first_filled(c("link_fetch_status"), F.lit("not_applicable"))),
        field("Link fetch error", or_na(c("link_fetch_error"))),
        field("Created at", F.coalesce(c("created_at"), F.lit(""))), "",
        *_sections(c),
    )
    tail = lines(
        "", "", "## Analysis", first_filled(c("analysis"), F.lit("Анализ не приложен.")), "",
        "## Comments", bullets(comments, "- комментариев нет"),
    )
    return text_of(head, F.when(entity == "idea", tail).otherwise(""), "\n")


def comment_line(created: Column, author: Column, text: Column) -> Column:
    return text_of("- ", created, " | ", author, ": ", text)


def analysis_input(url: Column, normalized: Column, raw: Column, extracted: Column) -> Column:
    """Text handed to an analysis: with page text when the link was read."""
    own = first_filled(normalized, raw)
    full = lines(
        text_of("Источник: ", url), "", "Комментарий пользователя:", own, "",
        "Извлечённое содержимое ссылки:", extracted,
    )
    both = (F.coalesce(url, F.lit("")) != "") & (F.coalesce(extracted, F.lit("")) != "")
    return F.when(both, full).otherwise(own)


def template_analysis(text: Column, project_key: Column, latest: Column, count: Column) -> Column:
    """Analysis used when no model is at hand. ``latest`` is NULL without comments."""
    shown = F.coalesce(latest, F.lit("Комментариев пока нет."))
    effect = lines(
        "## Что изменилось после комментария",
        text_of("- Новый комментарий: ", shown),
        "- Пересобери гипотезу так, чтобы этот комментарий стал явным ограничением или критерием.",
        "- Добавь один проверочный шаг именно под новый комментарий.", "", "",
    )
    return text_of(
        "## Усиление идеи\nСформулируй идею для проекта `", project_key,
        "` через цель, гипотезу ценности и понятный результат. "
        "Добавь один конкретный сценарий использования и критерий успеха.\n\n",
        F.when(count > 0, effect).otherwise(""),
        lines(
            "## Что в ней сильного",
            "- Есть исходный импульс для действия.",
            "- Идею уже можно привязать к существующему проекту и рабочей базе.",
            "- Её можно быстро превратить в проверяемую гипотезу.", "",
            "## Что вызывает сомнения",
            "- Пока не хватает численного критерия успеха.",
            "- Не до конца ясно, что именно является главным риском.",
            "- Может смешиваться сама идея и способ реализации.", "",
            "## Как проверить быстро",
            "- Сформулировать одну проверяемую гипотезу.",
            "- Определить, какие данные или сигналы подтвердят ценность.",
            "- Зафиксировать самый дешёвый следующий тест.", "",
            "## Следующий лучший шаг", "",
        ),
        "Перепиши идею в одном абзаце и обнови её с учётом последнего комментария. "
        "Комментариев в истории: ", count.cast("string"), ". Последний комментарий: ", shown,
        "\n\nИсходный текст идеи:\n", text,
    )


def template_summary(text: Column, project_key: Column, limit: int = 1400) -> Column:
    return text_of(
        "## О чём материал\nЭто контекст для проекта `", project_key,
        "`. Его стоит воспринимать как источник знаний или внешнее наблюдение.\n\n",
        lines(
            "## Ключевые мысли",
            "- В материале есть полезный сигнал, который стоит учитывать в проекте.",
            "- Его лучше использовать как фон для решений и новых идей.",
            "- При необходимости из него можно позже сделать отдельную идею.", "",
            "## Почему это важно для проекта",
            "- Контекст помогает принимать решения не в вакууме.",
            "- Он сохраняет внешние наблюдения рядом с рабочими материалами.", "",
            "## Что стоит запомнить", "",
        ),
        F.substring(text, 1, limit),
    )


def summary_message(kind: Column, name: Column, day: Column, bouts: Column) -> Column:
    first = kind == "baseline"
    return lines(
        F.when(first, "UFC baseline report").otherwise("UFC report update"),
        text_of("Турнир: ", name),
        text_of("Дата: ", day),
        text_of("Боёв: ", bouts),
        F.when(
            first, "Найден турнир на ближайшие выходные. Полный Markdown-отчёт прикреплён файлом."
        ).otherwise(
            "Есть meaningful changes относительно последней отправленной версии. "
            "Обновлённый Markdown-отчёт прикреплён файлом."
        ),
    )


def caption(kind: Column, name: Column, day: Column) -> Column:
    label = F.when(kind == "baseline", "baseline").otherwise("update")
    return F.concat_ws(" | ", name, day, label)


def delivery_file(kind: Column, slug: Column, day: Column) -> Column:
    return text_of(day, "-", slug, "-", kind, ".md")


# ---------------------------------------------------------------- event report

TABLE_HEAD = (
    "| Дата | Соперник | Результат | Метод | Раунд | Промоушен | Ивент |\n"
    "| --- | --- | --- | --- | --- | --- | --- |"
)
EMPTY_ROW = "| n/a | n/a | n/a | n/a | n/a | n/a | n/a |"
NO_SIGNALS = "- Существенных предбоевых сигналов не найдено.\n- Источник: `n/a`"


def table_row(*cells: Column) -> Column:
    return text_of("| ", F.concat_ws(" | ", *cells), " |")


def fighter_block(f) -> Column:
    """``f`` gives a column of the fighter; lists of lines may be NULL."""
    notes = F.transform(f("notes"), lambda n: text_of("- Дополнительно: `", n, "`"))
    meta = [
        field("Рекорд", or_na(f("record_summary"))),
        field("Победы по методам", or_na(f("wins_summary"))),
        field("Поражения по методам", or_na(f("losses_summary"))),
    ]
    return lines(
        text_of("#### ", f("name")), "", *meta,
        F.when(F.size(f("notes")) > 0, F.array_join(notes, "\n")),
        "- Источники:",
        F.when(F.size(f("sources")) > 0, bullets(f("sources"), "", "  - ")), "",
        "Последние 5:", "", TABLE_HEAD,
        F.coalesce(F.array_join(f("fight_lines"), "\n"), F.lit(EMPTY_ROW)), "",
        "Короткий комментарий:", "", text_of("- ", or_na(f("commentary"))), "",
        "Предбоевые сигналы:", "",
        F.coalesce(F.array_join(f("signal_lines"), "\n"), F.lit(NO_SIGNALS)),
    )


def bout_block(b, fighter_a: Column, fighter_b: Column) -> Column:
    return lines(
        text_of("### ", b("a_name"), " vs. ", b("b_name")), "",
        text_of("`", or_na(b("weight_class")), "` | `", or_na(b("card_segment")), "` | `", or_na(b("status")), "`"), "",
        "#### Линии", "",
        text_of("- `", b("a_name"), "`: `", or_na(b("a_price")), "`"),
        text_of("- `", b("b_name"), "`: `", or_na(b("b_price")), "`"),
        text_of("- `ТБ 1.5`: `", or_na(b("over_1_5")), "`"),
        text_of("- `ТБ 2.5`: `", or_na(b("over_2_5")), "`"), "",
        fighter_a, F.when(fighter_a.isNotNull(), ""),
        fighter_b, F.when(fighter_b.isNotNull(), ""),
        "Комментарий по бою:", "", text_of("- ", b("commentary")),
    )


def event_head(e) -> Column:
    return lines(
        text_of("# ", e("event_name"), " — ", e("title_suffix")), "",
        "## Турнир", "",
        field("Турнир", e("event_name")), field("Дата", e("event_date")), field("Арена", e("venue")),
        field("Промоушен", e("promotion")), field("Формат трансляции", e("broadcast")),
        field("Подтверждённых боёв", e("confirmed")),
        "- Основные источники:",
        F.when(F.size(e("sources")) > 0, bullets(e("sources"), "", "  - ")), "",
        "## Качество данных", "",
        field("Формат отчёта", e("report_format")), field("Язык", e("language")),
        field("Odds format", e("odds_format")),
        F.when(F.size(e("quality_notes")) > 0, bullets(e("quality_notes"), "")), "",
        "## Легенда", "",
        "- `🟩 W` — победа", "- `🟥 L` — поражение", "- `🟨 D` — ничья", "- `⬜ NC` — no contest", "",
        "## Бои", "",
    )


def event_tail(notes: Column) -> Column:
    return F.when(
        F.size(notes) > 0, lines("", "## Финальные замечания", "", bullets(notes, ""))
    )

"""SQL text of the same rules, for the check of every query."""

from __future__ import annotations

from ringside.registry import PROJECT_KEYS

WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def collapse(x: str) -> str:
    return f"trim({sub(x, WS + '+', ' ')})"


def strip(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$")


def filled(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in xs) + ")"


def netloc(x: str) -> str:
    return f"regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def host(x: str) -> str:
    return f"replace({netloc(x)}, 'www.', '')"


def slug(x: str, empty: str = "ufc-event") -> str:
    plain = sub(f"strip_accents({x})", r"[^\x00-\x7F]")
    dashed = sub(f"lower({plain})", "[^a-z0-9]+", "-")
    return f"coalesce(nullif(trim({dashed}, '-'), ''), '{empty}')"


def page_text(html: str) -> str:
    for tag in ("script", "style", "noscript"):
        html = sub(html, f"(?is)<{tag}.*?>.*?</{tag}>", " ")
    html = sub(html, "(?s)<[^>]+>", " ")
    # These four also count without their semicolon.
    for entity, char in (("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")):
        html = sub(html, entity, char)
    return collapse(html)


def two_digits(x: str) -> str:
    return f"printf('%.2f', {x})"


def iso_seconds(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S')"


def shorten(x: str, limit: int) -> str:
    return f"(CASE WHEN length({x}) <= {limit} THEN {x} ELSE left({x}, {limit - 3}) || '...' END)"


def title(text: str, host_: str, extracted: str) -> str:
    line = collapse(text)
    summary = f"left({collapse(extracted)}, 70)"
    label = f"(CASE WHEN {host_} <> '' THEN {host_} || ': ' || {summary} ELSE {summary} END)"
    return (
        f"CASE WHEN {line} = '' THEN 'Идея без заголовка' "
        f"WHEN regexp_matches({line}, '^https?://') THEN "
        f"CASE WHEN {summary} <> '' THEN {shorten(label, 80)} "
        f"WHEN {host_} <> '' THEN {host_} || ': ссылка' ELSE 'Ссылка без описания' END "
        f"ELSE {shorten(line, 80)} END"
    )


def name_score(a: str, b: str) -> str:
    """Score of two slugs."""
    ta, tb = f"string_split({a}, '-')", f"string_split({b}, '-')"
    shared = f"len(list_intersect({ta}, {tb}))"
    return (
        f"(CASE WHEN {a} = {b} THEN 10 WHEN {ta}[-1] = {tb}[-1] THEN "
        f"CASE WHEN {shared} >= 2 THEN 8 ELSE 4 END "
        f"WHEN {shared} >= 2 THEN 5 WHEN {shared} = 1 THEN 1 ELSE 0 END)"
    )


_KEYS = ", ".join(lit(k) for k in PROJECT_KEYS)

RECORDS = f"""
records0 AS (
  SELECT doc_id, text, lang, cast(substr(source, 4) AS INTEGER) AS src, html,
         CASE WHEN doc_id % 3 = 0 THEN url END AS source_url
  FROM documents LEFT JOIN pages ON page_id = doc_id),
records1 AS (
  SELECT *, CASE WHEN source_url IS NOT NULL AND doc_id % 2 = 0 THEN source_url ELSE text END AS raw_input,
    CASE WHEN source_url IS NOT NULL AND doc_id % 4 <> 0 THEN left({page_text('html')}, 12000) ELSE '' END
      AS extracted_content
  FROM records0),
records AS (
  SELECT doc_id AS record_id, lang, text, ([{_KEYS}])[src % 5 + 1] AS project_key,
    CASE WHEN doc_id % 2 = 0 THEN 'idea' ELSE 'context' END AS entity_type,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_ts,
    source_url, raw_input, CASE WHEN doc_id % 5 = 0 THEN '' ELSE {strip('raw_input')} END AS normalized_text,
    extracted_content,
    CASE WHEN source_url IS NULL THEN 'not_applicable' WHEN doc_id % 4 = 0 THEN 'fetch_failed'
      ELSE 'success' END AS link_fetch_status,
    CASE WHEN source_url IS NOT NULL AND doc_id % 4 = 0 THEN 'HTTP 404' END AS link_fetch_error
  FROM records1)"""

FIGHTS = """
fights AS (
  SELECT user_id AS fighter, event_id, ts, strftime(ts, '%Y-%m-%d') AS fight_date,
    'Opponent ' || (event_id % 97) AS opponent,
    CASE event_type WHEN 'purchase' THEN 'W' WHEN 'error' THEN 'L' WHEN 'view' THEN 'D' ELSE 'NC' END AS result,
    (['KO/TKO', 'Submission (RNC)', 'Decision - Unanimous', 'DQ'])[event_id % 4 + 1] AS method,
    event_id % 5 + 1 AS round,
    (['UFC 300: Main', 'UFC Fight Night', 'LFA 12', 'Bellator 200', 'Cage Warriors: Nine', 'Open Mat'])
      [event_id % 6 + 1] AS event_name
  FROM events)"""

BOUTS = """
bouts AS (
  SELECT p_partkey // 2 AS bout_key, p_partkey // 24 AS card, (p_partkey // 2) % 12 AS pos,
    max(CASE WHEN p_partkey % 2 = 0 THEN p_name END) AS a_name,
    max(CASE WHEN p_partkey % 2 = 1 THEN p_name END) AS b_name,
    max(CASE WHEN p_partkey % 2 = 0 THEN p_type END) AS kind
  FROM part GROUP BY p_partkey // 2, p_partkey // 24, (p_partkey // 2) % 12
  HAVING count(*) = 2)"""

ODDS = f"""{BOUTS},
odds0 AS (
  SELECT card, (pos * 7) % 12 AS row_index, bout_key,
    CASE WHEN bout_key % 5 = 0 THEN string_split(a_name, ' ')[-1] ELSE a_name END AS n1, b_name AS n2,
    CASE WHEN bout_key % 2 = 0 THEN '-' ELSE '+' END || (100 + bout_key % 900) AS o1,
    CASE WHEN bout_key % 2 = 0 THEN '+' ELSE '-' END || (110 + bout_key % 700) AS o2
  FROM bouts),
odds AS (
  SELECT card, row_index, bout_key,
    CASE WHEN row_index % 3 = 0 THEN n2 ELSE n1 END AS a_name,
    CASE WHEN row_index % 3 = 0 THEN n1 ELSE n2 END AS b_name,
    CASE WHEN row_index % 3 = 0 THEN o2 ELSE o1 END AS a_american,
    CASE WHEN row_index % 3 = 0 THEN o1 ELSE o2 END AS b_american
  FROM odds0)"""

LAST_FIVE = f"""{FIGHTS},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY fighter ORDER BY ts DESC, event_id DESC) AS pos FROM fights),
last_five AS (SELECT * FROM ranked WHERE pos <= 5)"""

RUNS = """
runs AS (
  SELECT user_id AS key, event_id AS seq,
    CASE WHEN event_type = 'signup' THEN 'baseline' ELSE 'incremental' END AS kind,
    CAST(ts AS DATE) AS run_date,
    CASE WHEN event_type = 'signup' THEN CAST(ts AS DATE) + CAST(event_id % 9 AS INTEGER) END AS opened_date,
    sha256(event_type || '|' || printf('%.2f', round_even(value / 50.0, 0) * 50.0)) AS hash
  FROM events)"""

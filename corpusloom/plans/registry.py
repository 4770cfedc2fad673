"""Names of the registered queries and the SQL fragments they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The run date of the checked queries.
RUN_DATE = "2025-01-01 00:00:00"
RUN_DATE_ISO = "2025-01-01T00:00:00"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


SPACE = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{SPACE}|{SPACE}\z', '', 'g')"


def word_count(x: str) -> str:
    return f"(CASE WHEN {squash(x)} = '' THEN 0 ELSE len(string_split({squash(x)}, ' ')) END)::BIGINT"


def decode(x: str) -> str:
    """The references that occur in the page table, the ampersand last."""
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("nbsp", " ")):
        x = f"replace({x}, '&{name};', '{char}')"
    return f"regexp_replace({x}, '&amp(;|([^A-Za-z0-9;])|$)', '&\\2', 'g')"


def chunks_of(rows: str, keys: str, text: str) -> str:
    """CTEs ending in ``kept``: word chunks of ``text`` of at least 100 characters."""
    return f"""
    flat AS (SELECT {keys}, {squash(text)} AS t FROM {rows}),
    cut AS (SELECT {keys}, string_split(t, ' ') AS w FROM flat WHERE t <> ''),
    pieces AS (
      SELECT {keys}, (i // 1000)::BIGINT AS chunk_index,
             array_to_string(w[i + 1:i + 1000], ' ') AS plain_content,
             least(1000, len(w) - i)::BIGINT AS word_count,
             ((len(w) + 999) // 1000)::BIGINT AS total_chunks_for_page
      FROM cut, unnest(range(0, len(w), 1000)) AS u(i)),
    kept AS (SELECT *, length(plain_content)::BIGINT AS char_count FROM pieces WHERE length(plain_content) >= 100)
    """


def _element(name: str) -> str:
    return rf"nullif(regexp_extract(markup, '(?is)<{name}\b[^>]*>(.*?)</{name}\s*>', 1), '')"


_CONTAINERS = "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in ("nav", "header", "footer", "aside"))
_TEXT = (
    f"regexp_replace(coalesce({_element('main')}, {_element('article')}, {_element('body')}, ''), "
    "'</?[A-Za-z][^>]*>|<[!?][^>]*>', '', 'g')"
)
_TITLE = r"regexp_extract(markup, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)"
PAGES_CLEAN = rf"""
    marked AS (
      SELECT page_id, url, regexp_replace(regexp_replace(html,
        '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'),
        '(?is){_CONTAINERS}', '', 'g') AS markup
      FROM pages WHERE html IS NOT NULL),
    texts AS (SELECT page_id, url, {strip(decode(_TITLE))} AS title, {squash(decode(_TEXT))} AS t FROM marked),
    pages_clean AS (
      SELECT page_id, url, title, CASE WHEN length(t) > 20 THEN t ELSE '' END AS content, '' AS description,
             (CASE WHEN length(t) > 20 THEN len(string_split(t, ' ')) ELSE 0 END)::BIGINT AS word_count,
             (CASE WHEN length(t) > 20 THEN length(t) ELSE 0 END)::BIGINT AS char_count,
             substr(md5(url), 1, 12) AS url_hash,
             regexp_extract(url, '\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS domain
      FROM texts)
"""

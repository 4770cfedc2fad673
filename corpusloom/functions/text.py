"""Scalar text and URL expressions, all evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The whitespace class (every Unicode space plus the four
# separator controls), the minimum text length, key and preview lengths.
SPACE = r"[\s\x1c-\x1f]"
MIN_TEXT_LENGTH = 20
URL_KEY_LENGTH = 12
HIT_PREVIEW_LENGTH = 200
ELLIPSIS = "..."

RUN = rf"(?U){SPACE}+"
EDGES = rf"(?U)\A{SPACE}+|{SPACE}+\z"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column | str, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(col(value)), use), F.lit(0))


def squash(text: Column | str) -> Column:
    """Every run of whitespace becomes one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(col(text), RUN, " "))


def strip(text: Column | str) -> Column:
    """Remove Unicode whitespace at both ends only."""
    return F.regexp_replace(col(text), EDGES, "")


def is_blank(text: Column | str) -> Column:
    return ~col(text).rlike(r"(?U)[^\s\x1c-\x1f]")


def rows_of(df: DataFrame, keep: list, items: Column | str, name: str, position: str | None = None) -> DataFrame:
    """One row per item of an array; empty arrays give none.

    The outer form with a filter after it keeps the optimizer from adding a
    size check below, which would compute the array a second time.
    """
    if position is None:
        return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())
    return df.select(*keep, F.posexplode_outer(items).alias(position, name)).filter(F.col(name).isNotNull())


def substantial(squashed: Column | str, minimum: int = MIN_TEXT_LENGTH) -> Column:
    """Keep a normalised text only when longer than ``minimum`` characters."""
    squashed = col(squashed)
    return F.when(F.length(squashed) > minimum, squashed).otherwise(F.lit(""))


def words(squashed: Column | str) -> Column:
    """Words of a normalised text; the empty text has none."""
    squashed = col(squashed)
    return F.when(squashed == "", F.array().cast("array<string>")).otherwise(F.split(squashed, " "))


def squashed_word_count(squashed: Column | str) -> Column:
    """Words of a normalised text, as bigint."""

    def count(text: Column) -> Column:
        spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
        return F.when(text == "", F.lit(0)).otherwise(spaces + 1).cast("bigint")

    return bind(squashed, count)


def word_count(text: Column | str) -> Column:
    """Whitespace-separated words of a raw text, as bigint."""
    return squashed_word_count(squash(text))


def char_count(text: Column | str) -> Column:
    """Code points, as bigint."""
    return F.length(col(text)).cast("bigint")


def url_hash(url: Column | str) -> Column:
    return F.substring(F.md5(col(url)), 1, URL_KEY_LENGTH)


def url_domain(url: Column | str) -> Column:
    """Network location: port and user-info stay, the case stays."""
    return F.regexp_extract(col(url), r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_target(url: Column | str) -> Column:
    """Path with query, the part a robots rule is matched against."""
    target = F.regexp_extract(col(url), r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(target == "", F.lit("/")).otherwise(target)


def has_web_scheme(url: Column | str) -> Column:
    url = col(url)
    return url.startswith("http://") | url.startswith("https://")


def file_stem(path: Column | str) -> Column:
    """Base name without its last extension."""
    return F.regexp_extract(col(path), r"([^/]+?)(?:\.[^./]*)?\z", 1)


def preview(text: Column | str, limit: int = HIT_PREVIEW_LENGTH) -> Column:
    """One-line preview of a hit; the ellipsis is always there."""
    head = F.replace(F.substring(col(text), 1, limit), F.lit("\n"), F.lit(" "))
    return F.concat(head, F.lit(ELLIPSIS))


def short_preview(text: Column | str, limit: int = HIT_PREVIEW_LENGTH) -> Column:
    """Preview of an answer; the ellipsis only marks a cut."""
    text = col(text)
    cut = F.concat(F.substring(text, 1, limit), F.lit(ELLIPSIS))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def megabytes(size: Column | str) -> Column:
    return col(size) / F.lit(1048576.0)


def floor_average(total: Column | str, count: Column | str) -> Column:
    """Integer average; NULL when there is nothing to average."""
    return F.call_function("div", col(total), F.nullif(col(count), F.lit(0)))


def lookup(metadata: Column | str, key: str, default: str) -> Column:
    """Metadata value or ``default`` when the map or the key is missing."""
    return F.coalesce(F.try_element_at(col(metadata), F.lit(key)), F.lit(default))


def iso_timestamp(ts: Column | str) -> Column:
    """ISO form without a zone, microseconds only when there are any."""
    ts = col(ts)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    exact = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(exact.endswith(".000000"), whole).otherwise(exact)

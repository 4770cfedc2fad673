"""Raw pages to clean page records, URL filters, crawl policy and dedup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import text as T
from corpusloom.session import spread

# The agent the crawl policy is evaluated for and the agent
# name that stands for everyone.
USER_AGENT = "RAG-Bot-WebScraper/1.0 (Educational/Research Purpose)"
ANY_AGENT = "*"

#: Keys among which the pages of a host are dealt.
SALTS = 16


def extract_pages(
    pages: DataFrame,
    scraped_at: str,
    selectors: Sequence[str] = H.CONTENT_SELECTORS,
    minimum_length: int = T.MIN_TEXT_LENGTH,
) -> DataFrame:
    """Clean page records from ``page_id, url, html``.

    A page without HTML is a failed fetch and is dropped; a page whose text is
    too short stays, with empty content. One projection, no shuffle.
    """
    landed = spread(pages.filter("html IS NOT NULL").select("page_id", "url", "html"), "page_id")
    marked = landed.selectExpr(
        "page_id", "url", H.without_containers(H.without_raw_blocks("html")) + " AS markup"
    )
    picked = marked.selectExpr(
        "page_id", "url", "markup",
        H.plain_text(H.first_element(H.first_match("markup", selectors))) + " AS chosen",
    )
    # The body is only searched when the chosen element has no text at all.
    body = H.plain_text(H.first_element(H.from_selector("markup", "body")))
    texts = picked.select(
        "page_id",
        "url",
        F.expr(H.title_text("markup")).alias("title"),
        F.expr(H.meta_description("markup")).alias("description"),
        T.squash(
            F.expr(f"CASE WHEN coalesce(chosen, '') = '' THEN coalesce({body}, '') ELSE chosen END")
        ).alias("squashed"),
    )
    return texts.select(
        "page_id", "url", "title", "description", T.substantial("squashed", minimum_length).alias("content")
    ).select(
        "page_id",
        "url",
        "title",
        "content",
        "description",
        F.lit(scraped_at).cast("timestamp").alias("scraped_at"),
        T.squashed_word_count("content").alias("word_count"),
        T.char_count("content").alias("char_count"),
        T.url_hash("url").alias("url_hash"),
        T.url_domain("url").alias("domain"),
    )


def split_by_scheme(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Flag every URL as accepted (web scheme) or rejected."""
    return urls.withColumn("accepted", T.has_web_scheme(url_col))


def first_seen(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of every key.

    ``row_number() = 1`` lets the optimizer cut each key to one row per task
    before the shuffle, so a key that holds a third of the rows costs no more.
    """
    first = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def latest_version(rows: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of every key, cut per task in the same way."""
    last = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def not_yet_done(rows: DataFrame, done: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First occurrence of every key that is absent from ``done``.

    Copies are removed before the anti join, so it sees each key once.
    """
    return first_seen(rows, key, order).join(done.select(key), key, "left_anti")


def plain_path(path: Column | str) -> Column:
    """A URL path with its percent escapes decoded; a ``%`` that starts none stays, a ``+`` is a plus sign."""
    marked = F.regexp_replace(F.replace(T.col(path), F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(marked)


def robots_decisions(
    pages: DataFrame,
    rules: DataFrame,
    user_agent: str = USER_AGENT,
    url_col: str = "url",
) -> DataFrame:
    """Add ``allowed`` to ``pages`` from ``rules(host, agent, rule_order, path_prefix, allow)``.

    A group naming the agent wins over the general group; inside it the first
    rule whose prefix matches decides; no policy or no match means allowed, and
    an empty prefix to disallow means allow everything. Paths are compared after
    percent-decoding, so ``/a%20b`` and ``/a b`` are one path. The rules of a host are
    folded into one ordered array first (a policy file has a size limit, so the
    array is small), so the join never multiplies pages and the decision needs
    no second shuffle. Pages meet the policy of their host under ``SALTS`` keys, so
    a host with a third of all pages goes to as many tasks.
    """
    token = user_agent.split("/")[0].lower()
    named = (F.col("agent") != ANY_AGENT) & F.lit(token).contains(F.lower("agent"))
    per_host = (
        rules.filter(named | (F.col("agent") == ANY_AGENT))
        .groupBy(F.col("host").alias("_host"))
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("rule_order", plain_path("path_prefix").alias("path_prefix"), "allow", "agent", named.alias("named"))
                )
            ).alias("_rules")
        )
        .withColumn("_own", F.filter("_rules", lambda r: r["named"]))
        .select(
            "_host",
            F.when(
                F.size("_own") > 0,
                F.filter("_own", lambda r: r["agent"] == F.element_at("_own", 1)["agent"]),
            )
            .otherwise(F.col("_rules"))
            .alias("_rules"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("_salt"),
        )
    )
    target = plain_path(T.url_target(url_col))
    matching = F.filter("_rules", lambda r: (r["path_prefix"] == "*") | F.startswith(F.col("_target"), r["path_prefix"]))
    first = F.try_element_at(matching, F.lit(1))
    decision = F.when(first["path_prefix"] == "", F.lit(True)).otherwise(first["allow"])
    return (
        pages.withColumn("_host", T.url_domain(url_col))
        .withColumn("_target", target)
        .withColumn("_salt", F.pmod(F.xxhash64(url_col), F.lit(SALTS)))
        .join(per_host, ["_host", "_salt"], "left")
        .withColumn("allowed", F.coalesce(decision, F.lit(True)))
        .drop("_host", "_salt", "_target", "_rules")
    )

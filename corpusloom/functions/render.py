"""Text templates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import col, strip

# The layout of a rendered chunk, of a context block and of a
# prompt, and the message for a search without hits.
CHUNK_TITLE = "# "
CHUNK_URL = "**Source URL:** "
CHUNK_DOMAIN = "**Domain:** "
CHUNK_SCRAPED = "**Scraped:** "
CHUNK_RULE = "---"
NO_RESULTS = "No relevant information found in the knowledge base."
UNKNOWN_SOURCE = "Unknown"
PROMPT_GROUNDED = "Based on the following context, answer the question:"
PROMPT_QUICK = "Based on the context below, answer the question:"
PROMPT_CONTEXT = "Context:"
PROMPT_QUESTION = "Question: "
PROMPT_ANSWER = "Answer:"


def chunk_markdown(title, url, domain, scraped, body) -> Column:
    """A chunk as Markdown with its metadata on top and a newline at the end."""
    parts = [
        F.lit(CHUNK_TITLE), col(title), F.lit("\n\n" + CHUNK_URL), col(url),
        F.lit("\n" + CHUNK_DOMAIN), col(domain), F.lit("\n" + CHUNK_SCRAPED), col(scraped),
        F.lit(f"\n\n{CHUNK_RULE}\n\n"), col(body), F.lit("\n"),
    ]
    return F.concat(*parts)


def chunk_path(chunk_id: Column | str) -> Column:
    return F.concat(F.lit("chunks/chunk_"), col(chunk_id).cast("string"), F.lit(".md"))


def context_block(rank, source, text) -> Column:
    """One ranked hit, numbered and with its source."""
    label = F.coalesce(col(source), F.lit(UNKNOWN_SOURCE))
    number = col(rank).cast("string")
    return F.concat(
        F.lit("[Document "), number, F.lit("] (Source: "), label, F.lit("):\n"), strip(text)
    )


def prompt(context, question, opening: str = PROMPT_GROUNDED) -> Column:
    return F.concat(
        F.lit(f"{opening}\n\n{PROMPT_CONTEXT}\n"), col(context),
        F.lit(f"\n\n{PROMPT_QUESTION}"), col(question), F.lit(f"\n\n{PROMPT_ANSWER}"),
    )


def page_bullet(title, url, words) -> Column:
    return F.concat(
        F.lit("- ["), col(title), F.lit("]("), col(url), F.lit(") ("),
        col(words).cast("string"), F.lit(" words)"),
    )


def role_label(role) -> Column:
    """Icon and capitalised role of a thread message."""
    role = col(role)
    icon = F.when(role.isin("human", "user"), F.lit("🧑 ")).otherwise(F.lit("🤖 "))
    return F.concat(icon, F.initcap(role))

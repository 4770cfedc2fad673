"""HTML to text as SQL expressions.

Every function takes and returns the text of an expression, so a whole page
projection is handed to Spark in a few strings. Comments, scripts and styles go
first in one pass. Container subtrees and the chosen content element are found
by folding over the few places where such a tag opens or closes, so nested
containers are removed as a whole. What the expressions do not repair is broken
markup: an element that is never closed reaches to the end of the page, and
``>`` inside an attribute ends the tag.
"""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import html5, name2codepoint

from corpusloom.functions.text import EDGES

# Containers that hold no content, and the order in which a
# page is searched for its main content.
BOILERPLATE_TAGS = ("nav", "header", "footer", "aside")
CONTENT_SELECTORS = (
    "main",
    "article",
    ".content",
    "#content",
    ".main-content",
    "#main-content",
    ".post-content",
    ".entry-content",
    ".article-content",
)
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input",
    "link", "meta", "source", "track", "wbr",
)

RAW_BLOCKS = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
ANY_TAG = r"</?[A-Za-z][^>]*>|<[!?][^>]*>"
TAG_END = r"(?=[\s/>])"
REFERENCE = r"\A(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[^\t\n\f <&#;]{1,32};?)"
NAME_END = "(?![A-Za-z0-9])"
USUAL_REFERENCES = ("lt", "gt", "quot", "nbsp", "copy", "middot", "amp")  # the ampersand stays last
NO_TEXTS = "cast(array() AS array<string>)"


def pattern(regex: str) -> str:
    """A regular expression as a raw SQL literal."""
    return "r'" + regex.replace("'", r"\x27") + "'"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def without_raw_blocks(html: str) -> str:
    return f"regexp_replace({html}, {pattern(RAW_BLOCKS)}, '')"


def without_containers(html: str, tags: Sequence[str] = BOILERPLATE_TAGS) -> str:
    """Drop every subtree whose root is one of ``tags``, nested ones included."""
    names = "|".join(tags)
    tag = f"lower(regexp_extract(piece, {pattern(rf'(?i)\A</?({names}){TAG_END}')}, 1))"
    depth = """state.depth + CASE
        WHEN tag = '' THEN 0
        WHEN state.depth = 0 THEN if(startswith(piece, '</'), 0, 1)
        WHEN tag = state.open THEN if(startswith(piece, '</'), -1, 1)
        ELSE 0 END"""
    rest = rf"if(tag = '', piece, regexp_replace(piece, {pattern(r'(?s)\A<[^>]*>')}, ''))"
    after = f"""named_struct(
        'open', CASE WHEN depth = 0 THEN '' WHEN state.depth = 0 THEN tag ELSE state.open END,
        'depth', depth,
        'kept', if(depth = 0, concat(state.kept, array({rest})), state.kept))"""
    step = let("tag", tag, let("depth", depth, after))
    pieces = f"split(page, {pattern(rf'(?i)(?=</?(?:{names}){TAG_END})')})"
    folded = f"""aggregate({pieces}, named_struct('open', '', 'depth', 0, 'kept', {NO_TEXTS}),
        (state, piece) -> {step}, state -> array_join(state.kept, ''))"""
    present = pattern(rf"(?i)<(?:{names}){TAG_END}")
    return let("page", html, f"CASE WHEN page RLIKE {present} THEN {folded} ELSE page END")


def selector_pattern(selector: str) -> str:
    """Pattern of the opening tag a simple selector matches: tag, .class or #id."""
    if selector[0] not in ".#":
        return rf"(?i:<{selector}){TAG_END}"
    name = selector[1:].replace("-", r"\-")
    if selector[0] == "#":
        attribute = "id"
        forms = (rf'"{name}"', rf"'{name}'", rf"{name}(?=[\s>])")
    else:
        attribute = "class"
        forms = (
            rf'"(?:[^"]*\s)?{name}(?:\s[^"]*)?"',
            rf"'(?:[^']*\s)?{name}(?:\s[^']*)?'",
            rf"{name}(?=[\s>])",
        )
    return rf"(?i:<[a-z][a-z0-9]*)(?=\s)[^>]*?\s(?i:{attribute})\s*=\s*(?:{'|'.join(forms)})"


def from_selector(html: str, selector: str) -> str:
    """The page from the first element matched by ``selector`` on, else NULL."""
    found = f"regexp_extract({html}, {pattern(rf'(?s){selector_pattern(selector)}.*')}, 0)"
    return let("found", found, "if(found = '', NULL, found)")


def first_match(html: str, selectors: Sequence[str] = CONTENT_SELECTORS) -> str:
    """The page from the element of the first selector that matches anything."""
    return f"coalesce({', '.join(from_selector(html, s) for s in selectors)})"


def first_element(rest: str) -> str:
    """Inner HTML of the element that ``rest`` starts with."""
    name = rf"lower(regexp_extract(rest, {pattern(r'\A<([A-Za-z][A-Za-z0-9]*)')}, 1))"
    pieces = f"split(rest, concat('(?i)(?=</?', name, {pattern(TAG_END + ')')}))"
    depth = "state.depth + if(startswith(piece, '</'), -1, 1)"
    after = """named_struct(
        'depth', if(state.done, state.depth, depth),
        'done', state.done OR depth <= 0,
        'kept', if(state.done OR depth <= 0, state.kept, concat(state.kept, array(piece))))"""
    folded = f"""aggregate({pieces}, named_struct('depth', 0, 'done', false, 'kept', {NO_TEXTS}),
        (state, piece) -> {let("depth", depth, after)}, state -> array_join(state.kept, ''))"""
    void = ", ".join(f"'{tag}'" for tag in VOID_TAGS)
    return let("rest", rest, let("name", name, f"CASE WHEN name IN ({void}) THEN '' ELSE {folded} END"))


def decode_entities(text: str) -> str:
    """Numeric and named character references, decoded once from left to right.

    A name that is not known stays as it is, with or without a semicolon; old
    names are known without one.
    Texts that hold none but the usual references take a few replacements, the
    ampersand last; all others are decoded piece by piece.
    """
    simple = "text"
    for name in USUAL_REFERENCES:
        simple = f"regexp_replace({simple}, {pattern(f'&{name}{NAME_END};?')}, '{chr(name2codepoint[name])}')"
    usual = "|".join(USUAL_REFERENCES)
    other = pattern(rf"&(?!(?:{usual}){NAME_END})(?:[A-Za-z]|#[0-9]|#[xX][0-9A-Fa-f])")
    return let(
        "text",
        text,
        f"""CASE WHEN NOT contains(text, '&') THEN text
        WHEN text RLIKE {other} THEN {_decoded_pieces()} ELSE {simple} END""",
    )


def _literal(text: str) -> str:
    """A SQL string; characters that SQL would read otherwise as Unicode escapes."""
    return "'" + "".join(c if c.isalnum() or ord(c) > 127 else f"\\u{ord(c):04x}" for c in text) + "'"


def _decoded_pieces() -> str:
    """The rules of HTML 5 as the standard library states them: names first as they
    stand, then the longest old name that needs no semicolon; numbers of the
    Windows-1252 block as its characters, numbers that are no character as the
    replacement mark, controls as nothing."""
    # One constant map; the table is the one of HTML 5 from the standard library.
    table = _literal("\x01".join(f"{name}\x02{text}" for name, text in sorted(html5.items())))
    known = rf"try_element_at(str_to_map({table}, {_literal(chr(1))}, {_literal(chr(2))}), %s)"
    old = "|".join(sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name)))
    usual = " ".join(f"WHEN '{name};' THEN '{chr(name2codepoint[name])}'" for name in USUAL_REFERENCES)
    block = ", ".join(_literal(bytes([c]).decode("cp1252", "ignore") or chr(c)) for c in range(128, 160))
    hexadecimal = "lower(substring(ref, 2, 1)) = 'x'"
    digits = rf"regexp_replace(regexp_replace(ref, {pattern('^#[xX]?0*')}, ''), ';$', '')"
    numeric = let(
        "code",
        let("digits", digits, f"if(length(digits) > 7, 9999999, CAST(if({hexadecimal}, conv(digits, 16, 10), if(digits = '', '0', digits)) AS bigint))"),
        f"""CASE WHEN code IS NULL OR code = 0 OR code > 1114111 OR code BETWEEN 55296 AND 57343 THEN '�'
        WHEN code BETWEEN 128 AND 159 THEN element_at(array({block}), CAST(code - 127 AS int))
        WHEN code < 9 OR code = 11 OR code BETWEEN 14 AND 31 OR code = 127
          OR code BETWEEN 64976 AND 65007 OR code % 65536 >= 65534 THEN ''
        ELSE decode(unhex(lpad(hex(code), 8, '0')), 'UTF-32') END""",
    )
    rest = "substring(piece, length(ref) + 1)"
    prefix = let(
        "head",
        f"regexp_extract(ref, {pattern(f'^(?:{old})')}, 0)",
        f"if(head = '', concat('&', piece), concat({known % 'head'}, substring(piece, length(head) + 1)))",
    )
    decoded = let(
        "ref",
        f"regexp_extract(piece, {pattern(REFERENCE)}, 0)",
        f"""CASE WHEN ref = '' THEN concat('&', piece) WHEN startswith(ref, '#') THEN concat({numeric}, {rest})
        ELSE coalesce(concat(coalesce(CASE ref {usual} END, {known % 'ref'}), {rest}), {prefix}) END""",
    )
    return f"array_join(transform(split(text, '&'), (piece, at) -> if(at = 0, piece, {decoded})), '')"


def plain_text(html: str) -> str:
    """Text of a fragment: tags vanish without a separator, entities decoded."""
    return decode_entities(f"regexp_replace({html}, {pattern(ANY_TAG)}, '')")


def title_text(html: str) -> str:
    """Trimmed text of the first title; empty when missing or when it holds tags."""
    inner = rf"regexp_extract({html}, {pattern(r'(?is)<title\b[^>]*>(.*?)</title\s*>')}, 1)"
    text = let("inner", inner, f"if(inner RLIKE {pattern(ANY_TAG)}, '', {decode_entities('inner')})")
    return f"regexp_replace({text}, {pattern(EDGES)}, '')"


def meta_description(html: str) -> str:
    """``content`` of the first description meta tag, in either attribute order."""
    name = r"""\s(?i:name)\s*=\s*(?:"description"|'description'|description(?=[\s/>]))"""
    tag = f"regexp_extract({html}, {pattern(rf'(?i:<meta)(?=\s)[^>]*?{name}[^>]*>')}, 0)"
    forms = (r'"([^"]*)"', r"'([^']*)'", r"""([^\s"'>]+)""")
    found = [rf"nullif(regexp_extract(tag, {pattern(rf'(?is)\scontent\s*=\s*{form}')}, 1), '')" for form in forms]
    return let("tag", tag, decode_entities(f"coalesce({', '.join(found)}, '')"))

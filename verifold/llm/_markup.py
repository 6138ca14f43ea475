"""Markup read as a stream of events, in time linear in its length whatever it holds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

#: Elements whose content is no markup; it is skipped.
RAW_TAGS = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset(
    """
    address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header
    hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul
    """.split()
)
#: Repeats are possessive, so what never closes is read once; a quoted value may hold angle brackets.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
#: Numbers of characters that no character has; so many digits are no number to unescape().
_NO_CHARACTER = re.compile(r"&#0*+[0-9]{8,}+;?")
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^<>]*>", re.I) for tag in RAW_TAGS}


def decode(text: str) -> str:
    """text with its character references decoded."""
    return unescape(_NO_CHARACTER.sub("�", text)) if "&" in text else text


def attributes(text: str) -> dict[str, str]:
    """Names in lower case and decoded values of the attributes of a tag; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), decode(m[2] or m[3] or m[4] or ""))
    return out


def closes_itself(attrs: str) -> bool:
    """Whether a tag ends in a slash that is no part of a value without quotes."""
    return attrs.endswith("/") and (len(attrs) == 1 or attrs[-2] in " \t\r\n\f\"'")


def events(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes as written) and ("close", tag, "") in order of the page.

    Texts are decoded, tags are in lower case. A raw element opens and closes with nothing inside; comments are left out.
    """
    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            yield "text", decode(html[at:]), ""
            return
        if m.start() > at:
            yield "text", decode(html[at : m.start()]), ""
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                yield "text", m[0][9:].removesuffix("]]>"), ""
            continue
        tag = m[2].lower()
        if m[1]:
            yield "close", tag, ""
            continue
        yield "open", tag, m[3]
        if tag in _RAW_ENDS:
            if not closes_itself(m[3]):
                stop = _RAW_ENDS[tag].search(html, at)
                at = stop.end() if stop else end
            yield "close", tag, ""

"""Main text of web pages by two passes over their blocks."""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._markup import BLOCK_TAGS, VOID_TAGS, attributes, closes_itself, events
from ._spark import Positional

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could did do does for from had has have he her his how i if in into is it
    its like more no not now of on only or other our out over she so some such than that the their them then there these they this those through to
    up was we were what when where which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch du ein eine einem einen einer eines er es für hat ich ihr im in ist
    ja kann man mit nach nicht noch nur oder sich sie sind so über um und uns unter vom von vor war was wenn wer wie wird wir zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se
    ses son sont sur tout un une vous
    al ante como con cuando de del desde donde el ella en entre era es esta este esto fue ha hasta la las lo los más me mi muy no nos o para pero por
    porque que se ser sin sobre son su sus también te tiene todo un una y ya
    """.split()
)
#: Elements that never hold main text.
OUT_TAGS = frozenset("nav aside footer script style noscript template iframe svg canvas button select option textarea dialog object head title menu".split())
#: Elements that may hold none, and what says so (see Mark): a form can be around a whole page.
MARKED_TAGS = {"header": "name", "form": "part"}
#: Tokens of class, id or role that say the same.
OUT_NAMES = frozenset(
    """
    ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer header
    login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related replies reply search share sharing
    sidebar signup social sponsor sponsored subscribe toolbar widget widgets alert complementary contentinfo
    """.split()
)
#: First parts of names that say how a page is filed ("category-search"), and parts anywhere that say what it has ("has-sidebar").
FILED = frozenset("is show layout format type template category tag status js".split())
HAS = frozenset("has with no not without hide".split())
#: With one of these, a header is that of the text.
OF_TEXT = frozenset("article post entry page content story title section".split())
#: Names of readers' comments, of which there may be more than main text.
OF_READERS = frozenset("comment comments disqus replies reply".split())
ZONE_TAGS = ("article", "main")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
INLINE_TAGS = frozenset("a abbr b bdi cite code em font i label mark small span strong sub sup time u".split())
#: Elements that one of the same group or a new block closes.
_ENDED_BY = {"li": ("p", "li"), "dd": ("p", "dd", "dt"), "dt": ("p", "dd", "dt"), "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"), "th": ("p", "td", "th")}
#: Characters of a long block.
MIN_LENGTH = 70
_NAME_PART = re.compile(r"[A-Za-z]+")
_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile(r"[A-Za-z\u00c0-\u024f]")


class Mark:
    """An element that may not hold main text: what says so, the one around it, its letters, and whether it holds an
    article or a first heading.

    why is "name" (its whole name, or its tag), "part" (a part of its name) or "readers" (their comments).
    """

    __slots__ = ("why", "around", "letters", "article", "title", "out")

    def __init__(self, why: str, around: Mark | None) -> None:
        self.why, self.around, self.letters, self.article, self.title, self.out = why, around, 0, False, False, False


class Block:
    """Text between two breaks: its text, the characters of it in links, whether an article or main element holds it,
    whether it is a heading, and the innermost marked element around it."""

    __slots__ = ("text", "linked", "zone", "heading", "mark")

    def __init__(self, text: str, linked: int, zone: bool, heading: bool, mark: Mark | None = None):
        self.text, self.linked, self.zone, self.heading, self.mark = text, linked, zone, heading, mark


def _says(tag: str, attrs: str) -> tuple[bool, str | None]:
    """Whether the element is hidden, and why it may not hold main text (see Mark), by its tag, class, id and role."""
    why = MARKED_TAGS.get(tag)
    if tag in ("html", "body", "main") or "=" not in attrs and "hidden" not in attrs:
        return False, why
    named = attributes(attrs)
    hidden = tag not in ZONE_TAGS and ("hidden" in named or named.get("aria-hidden") == "true")
    for token in f"{named.get('class', '')} {named.get('id', '')} {named.get('role', '')}".split():
        parts = [x.lower() for x in _NAME_PART.findall(token)]
        hits = OUT_NAMES.intersection(parts)
        if not hits or parts[0] in FILED or not HAS.isdisjoint(parts) or hits <= {"header", "banner"} and not OF_TEXT.isdisjoint(parts):
            continue
        if hits & OF_READERS:
            return hidden, "readers"
        if all(x in OUT_NAMES for x in parts) or tag in INLINE_TAGS:
            why = "name"
        elif tag != "article" and why is None:
            why = "part"
    return hidden, why


def split_blocks(html: str) -> list[Block]:
    """The blocks of a page outside of elements that never hold main text, with decoded character references.

    Marked elements are evidence, weighed when the whole page is read: one that its whole name marks goes if it holds no
    article; one that a part of its name marks, if it holds no first heading either and at most half of the page's
    letters; readers' comments go. A main element in a marked one stays. If nothing is left, marks don't count.
    """
    blocks: list[Block] = []
    marks: list[Mark] = []
    said: list[str] = []
    linked = out = zone = links = 0
    mark: Mark | None = None
    heading = False
    stack: list[tuple] = []  # per open element: its tag, and out, zone, links and mark as they were before
    where: dict[str, list[int]] = {}  # places of open elements in the stack, by tag
    walls: list[int] = []  # places of open block elements

    def flush() -> None:
        nonlocal linked, said
        if said:
            text = " ".join("".join(said).split())
            if text:
                blocks.append(Block(text, linked, zone > 0, heading, mark))
            said, linked = [], 0

    def close(k: int) -> None:
        nonlocal out, zone, links, mark
        if stack[k][4] is not mark:
            flush()
        for element in reversed(stack[k:]):
            where[element[0]].pop()
        while walls and walls[-1] >= k:
            walls.pop()
        _, out, zone, links, mark = stack[k]
        del stack[k:]

    for kind, tag, attrs in events(html):
        if kind == "text":
            if not out:
                said.append(tag)
                if links:
                    linked += len("".join(tag.split()))
            continue
        block = tag in BLOCK_TAGS
        if block:
            flush()
            heading = kind == "open" and tag in HEADINGS
        if kind == "close":
            if where.get(tag):
                close(where[tag][-1])
            continue
        if block and tag not in ("br", "hr"):
            ends = _ENDED_BY.get(tag, ("p",))
            while walls and stack[walls[-1]][0] in ends:
                close(walls[-1])
        if tag in VOID_TAGS or closes_itself(attrs):
            continue
        before = (tag, out, zone, links, mark)
        hidden, why = _says(tag, attrs)
        if tag == "main":
            out, mark = 0, None
        elif tag in OUT_TAGS or hidden:
            out += 1
        elif why and not out and not (tag == "header" and why == "name" and zone):
            flush()
            mark = Mark(why, mark)
            marks.append(mark)
        if before[4]:
            before[4].title |= tag == "h1"
            before[4].article |= tag == "article" and why != "readers"
        zone += tag in ZONE_TAGS
        links += tag == "a"
        where.setdefault(tag, []).append(len(stack))
        if block:
            walls.append(len(stack))
        stack.append(before)
    flush()
    return _unmarked(blocks, marks)


def _unmarked(blocks: list[Block], marks: list[Mark]) -> list[Block]:
    total = 0
    for b in blocks:
        n = _letters(b.text)
        total += n
        if b.mark:
            b.mark.letters += n
    for m in reversed(marks):  # inner ones first
        if m.around:
            m.around.letters += m.letters
            m.around.title |= m.title
            m.around.article |= m.article
    for m in marks:  # outer ones first
        stays = m.article or m.why == "part" and (m.title or 2 * m.letters > total)
        m.out = m.why == "readers" or not stays or m.around is not None and m.around.out
    return [b for b in blocks if not (b.mark and b.mark.out)] or blocks


def _stop_words(text: str) -> tuple[int, int]:
    """How many words are stop words, and how many words there are."""
    words = [w for x in text.split() if (w := _WORD.search(x))]
    return sum(w[0].lower() in STOP_WORDS for w in words), len(words)


def _letters(text: str) -> int:
    return len("".join(text.split()))


def decide(
    blocks: list[Block], min_length: int = MIN_LENGTH, good_density: float = 0.2, bad_density: float = 0.04, max_links: float = 0.3, covered_density: float = 0.1
) -> list[bool | None]:
    """The first pass: True (good), False (bad) or None (open) for each block.

    Bad if links hold over max_links of the letters, or if a short block outside of articles has a copyright sign. Good if
    the block has min_length characters and good_density of stop words. Few stop words say nothing on a page whose
    language the list doesn't cover: it does if some block is good by them and they are covered_density of the words
    outside of links. If it does, blocks of min_length characters, mostly Latin letters, under bad_density and in no
    article or main element are bad. If it doesn't, all blocks of min_length characters are good. The rest is open.
    """
    long = [len(b.text) >= min_length for b in blocks]
    linked = [b.linked > max_links * _letters(b.text) for b in blocks]
    counts = [_stop_words(b.text) for b in blocks]
    density = [n / m if m else 0.0 for n, m in counts]
    free = [c for c, x in zip(counts, linked, strict=True) if not x]
    prose = any(n and not x and d >= good_density for n, x, d in zip(long, linked, density, strict=True))
    covered = prose and sum(n for n, _ in free) >= covered_density * sum(m for _, m in free)
    out: list[bool | None] = []
    for i, b in enumerate(blocks):
        if linked[i] or "©" in b.text and not long[i] and not b.zone:
            out.append(False)
        elif long[i] and (density[i] >= good_density or not covered):
            out.append(True)
        elif long[i] and density[i] < bad_density and not b.zone and 2 * len(_LATIN.findall(b.text)) >= _letters(b.text):
            out.append(False)
        else:
            out.append(None)
    return out


def inherit(blocks: list[Block], verdicts: list[bool | None]) -> list[bool]:
    """The second pass: an open block gets the label of its nearest decided neighbour, the good one if two are as near.

    Labels don't cross the bounds of articles and main elements, except to headings, which may stand before them. An
    open block outside that has no decided neighbour there is bad if a block in an article is good. Where no block of
    the page is good, bad ones say nothing of open ones: those are good.
    """
    if True not in verdicts:
        return [v is None for v in verdicts]
    decided = [i for i, v in enumerate(verdicts) if v is not None]
    sides = {zone: [i for i in decided if blocks[i].zone is zone] for zone in (False, True)}
    in_zone = any(verdicts[i] for i in sides[True])
    out = []
    for i, v in enumerate(verdicts):
        if v is None:
            near = _nearest(i, decided if blocks[i].heading else sides[blocks[i].zone])
            v = any(verdicts[j] for j in near) if near else blocks[i].zone or not in_zone
        out.append(v)
    return out


def _nearest(i: int, places: list[int]) -> list[int]:
    """The places nearest to i, which is none of them: one, or two that are as near."""
    k = bisect_left(places, i)
    near = places[max(0, k - 1) : k + 1]
    least = min((abs(j - i) for j in near), default=0)
    return [j for j in near if abs(j - i) == least]


def main_text(html: str | None) -> str:
    """The main text of one page: good blocks in page order, joined by one space; empty if there is none."""
    blocks = split_blocks(html or "")
    return " ".join(b.text for b, good in zip(blocks, inherit(blocks, decide(blocks)), strict=True) if good)


@F.arrow_udf(T.StringType())
def _main_text(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(x.as_py()) for x in pages], pa.string())


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with main_text of the whole html; empty for null, empty or textless pages. Time is linear in a page's
    length, deep, long or malformed as it may be. Repeated rows give equal texts, an empty table an empty result; a
    column named main_text is replaced, all others stay, whatever their names."""
    p = Positional(pages, ["main_text"])
    return p.restore(p.df.withColumn("main_text", _main_text(p.col(html_col))))


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))

"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. First pass: stop-word density,
length and link density call each block good, bad or ambiguous. Second pass: an
ambiguous block, which is short or poor in stop words without links, takes the
label of its nearest decided neighbours. Where the two sides disagree a block of an article
element is kept, and another goes with the nearer side; of two as near a
heading takes the good one, any other block the one before. Where nothing on
a page is decided, ambiguous blocks are kept.

Elements for menus, footers and the like are bad throughout and no neighbours.
Words of a class, id or role that name such things, and forms, are votes that
text may outvote: on a page with an article element they fall where all of its
text lies inside; on others where more good text lies inside than elsewhere,
or for reader comments where none lies elsewhere. Larger parts are asked
first, comments last. What still stands is bad and no neighbour either.

An article element is a prior: the blocks outside of it are bad unless good
text there is more than OUTWEIGHED times as long as its own; then the element
is passed over. Within it, links and poor density make a block ambiguous only.
On a page whose longer blocks hold next to no stop words of the lists, whose
language is none of theirs then, length and link density alone decide.

Pages are handled one by one where they lie, without a shuffle. Null and empty
html give an empty text; broken markup never fails and is read in one pass,
and end tags that do not match are passed over; repeated pages are extracted one by one; extra columns play
no part.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import table

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    a about all also an and are as at be been but by can could do for from had has have he her his how i if in into is it its
    more no not of on one or our out she so some that the their them then there these they this to up was we were what when
    which who will with would you your
    aber als am an auch auf aus bei bin das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in
    ist ja man mit nach nicht noch nur oder sein sich sie sind so über um und uns unter von vor war was wie wir wird zu zum zur
    au aux avec ce cette ces dans de des du elle en est et il ils la le les leur lui mais même ne nous on ou par pas plus pour
    qu que qui sa se ses si son sont sur un une vous y
    al como con cual de del desde donde el ella en entre era es esta este fue ha hay la las lo los más me mi muy no o para pero
    por que se sin sobre su sus también un una y ya
    """.split()
)

# Elements whose text is never shown, elements that hold no article text, and elements that end a block.
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video map".split())
ASIDE = frozenset("nav footer aside menu dialog button select option textarea label fieldset".split())
BLOCKS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody
    td textarea tfoot th thead tr ul
    """.split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr p dt dd tr td th option".split())
# Words of class, id or role that mark what is not the article.
MARKS = frozenset(
    """
    ad ads adv advert adverts advertisement advertising adsense banner promo promotion promoted sponsor sponsored sidebar nav
    navbar navigation menu menubar breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices notification
    alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended
    recommendations comment comments commentlist discussion disqus reply replies respond widget toolbar pagination pager
    contentinfo complementary search
    """.split()
)
COMMENTS = frozenset("comment comments commentlist discussion disqus reply replies respond".split())
# First parts of class names that tell of a page's layout.
LAYOUT = frozenset("has no with without is not hide show".split())
CORE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

SHORT, LONG = 70, 200
DENSE, SPARSE, UNKNOWN = 0.30, 0.15, 0.05
MOST_LINKED = 0.5
OUTWEIGHED = 4

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[<>\"']")
# Elements whose content is text up to their end tag.
RAW = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title")}
_MARKED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")


def marks(attributes: str) -> str:
    """Whether a class, id or role says that this isn't the article: "comments", "other" or ""."""
    out = ""
    for found in _MARKED.finditer(attributes) if attributes else ():
        for name in (found[1] or found[2] or found[3] or "").lower().split():
            words = re.split(r"[^a-z]+", name)
            if words[0] in LAYOUT and len(words) > 1:
                continue
            if not COMMENTS.isdisjoint(words):
                return "comments"
            if not MARKS.isdisjoint(words):
                out = "other"
    return out


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(text, "", "") for text and ("", tag, attributes) for tags, with "/" before the name of end tags, in one pass over the page.

    Comments, declarations and raw elements give nothing. Outside of quotes a tag ends at the next < at the latest, and a
    quote that is never closed is a character like others, so no part of broken markup is read again and again."""
    at, n = 0, len(page)
    closable = {'"': True, "'": True, ">": True}

    def find(what: str, start: int) -> int:
        """As str.find, but what once wasn't found is not looked for again."""
        found = page.find(what, start) if closable.get(what, True) else -1
        if found < 0:
            closable[what] = False
        return found

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield page[at:], "", ""
            return
        if lt > at:
            yield page[at:lt], "", ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = find(">", lt)
            at = lt + 2 if end < 0 else end + 1
            continue
        name = _NAME.match(page, lt + 1)
        if not name:
            yield "<", "", ""
            at = lt + 1
            continue
        end = name.end()
        while True:
            m = _STOP.search(page, end)
            if not m:
                end = n
                break
            end = m.start()
            if m[0] in "<>":
                break
            end = max(find(m[0], end + 1), end) + 1
        attributes = page[name.end() : end]
        at = end + 1 if page.startswith(">", end) else end
        tag = name[0].lower()
        if tag in RAW:
            close = RAW[tag].search(page, at)
            at = close.end() if close else n
            continue
        yield "", tag, attributes


class Part:
    """A part of a page that a class, id, role or form marks, the part around it, and those in it. `open` once the mark is outvoted and no other one around it stands."""

    __slots__ = ("comments", "around", "within", "own", "whole", "open")

    def __init__(self, kind: str, around: Part | None) -> None:
        self.comments, self.around, self.within, self.open = kind == "comments", around, [], False
        self.own = self.whole = 0  # length of its text that counts, without and with that of the parts in it
        if around is not None:
            around.within.append(self)


class Block:
    __slots__ = ("text", "linked", "outside", "core", "heading", "part", "label")

    def __init__(self, text: str, linked: int, outside: bool, core: bool, heading: bool = False, part: Part | None = None) -> None:
        self.text, self.linked, self.outside, self.core, self.heading, self.part, self.label = text, linked, outside, core, heading, part, ""


class Open:
    """An open tag: whether it isn't of the article or is of an article element, with all around it, the part it is in, and where the innermost list or item stands."""

    __slots__ = ("name", "edge", "outside", "core", "part", "item")

    def __init__(self, name: str, aside: bool, mark: str, is_core: bool, around: Open | None, place: int) -> None:
        self.name, self.edge = name, aside or is_core or bool(mark)
        self.outside = aside or (around is not None and around.outside)
        self.core = is_core or (around is not None and around.core)
        self.part = around.part if around is not None else None
        if mark:
            self.part = Part(mark, self.part)
        self.item = place if name in ("li", "ul", "ol") else around.item if around is not None else -1


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with the length of their linked text and where they stand."""
    out: list[Block] = []
    stack: list[Open] = []
    count: Counter[str] = Counter()
    outside = core = heading = False
    part: Part | None = None
    paragraph: Part | None = None
    parts: list[str] = []
    links, linked = 0, 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, outside, core, heading, paragraph or part))
            parts, linked = [], 0

    def leave(at: int) -> None:
        nonlocal outside, core, part
        for o in stack[at:]:
            count[o.name] -= 1
        del stack[at:]
        outside, core, part = (stack[-1].outside, stack[-1].core, stack[-1].part) if stack else (False, False, None)

    for text, tag, attributes in tokens(page):
        if not tag:
            parts.append(text)
            if links:
                linked += len(text.strip())
            continue
        ends, tag = tag[0] == "/", tag.lstrip("/")
        if tag == "br":
            parts.append(" ")
        if tag == "a":
            links = max(0, links - 1) if ends else links + 1
        if tag in BLOCKS:
            close()
            links, paragraph = 0, None
            heading = tag in HEADINGS and not ends
        if tag in VOID:
            mark = marks(attributes) if tag in BLOCKS and not ends else ""
            if mark:
                paragraph = Part(mark, part)
            continue
        if ends:
            if count[tag]:
                at = len(stack) - 1
                while stack[at].name != tag:
                    at -= 1
                if any(o.edge for o in stack[at:]):
                    close()
                    paragraph = None
                leave(at)
            continue
        if attributes.endswith("/"):
            continue
        if tag == "li" and stack and stack[-1].item >= 0 and stack[stack[-1].item].name == "li":  # a list item ends the one before it
            leave(stack[-1].item)
        aside = tag in ASIDE or tag in HIDDEN or (tag == "header" and not core)
        mark = "" if tag in ("body", "html") else marks(attributes)
        if tag in CORE and mark != "comments":
            mark = ""
        mark = mark or ("other" if tag == "form" else "")
        is_core = tag in CORE and not mark
        if aside or mark or is_core:
            close()
            paragraph = None
        stack.append(Open(tag, aside, mark, is_core, stack[-1] if stack else None, len(stack)))
        count[tag] += 1
        outside, core, part = stack[-1].outside, stack[-1].core, stack[-1].part
    close()
    return out


def density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(page: list[Block]) -> list[str]:
    """Good, bad or ambiguous by density, length and links alone."""
    long_ones = [b.text for b in page if not b.outside and len(b.text) >= SHORT and b.linked <= MOST_LINKED * len(b.text)]
    known = not long_ones or density(" ".join(long_ones)) >= UNKNOWN  # else the stop words are of other languages
    out = []
    for b in page:
        n, stops = len(b.text), density(b.text) if known else 0.0
        if b.linked > MOST_LINKED * n:
            out.append("bad")
        elif n < SHORT:
            out.append("ambiguous")
        elif stops >= DENSE or (n >= LONG and (stops >= SPARSE or not known)):
            out.append("good")
        else:
            out.append("bad" if b.linked and known and stops < SPARSE else "ambiguous")
    return out


def outvote(page: list[Block], first: list[str]) -> None:
    """Opens the parts whose marks are outvoted by the text in them."""
    inner = [(b, kind) for b, kind in zip(page, first, strict=True) if not b.outside]
    has_core = any(b.core for b, _ in inner)
    roots: dict[int, Part] = {}
    free = 0  # length of the text that counts and is in no marked part
    for b, kind in inner:
        n = len(b.text) if (b.core if has_core else kind == "good") else 0
        if b.part is None:
            free += n
            continue
        b.part.own += n
        top = b.part
        while top.around is not None and id(top) not in roots:
            top = top.around
        if top.around is None:
            roots[id(top)] = top
    order = list(roots.values())
    for p in order:  # parents first
        order.extend(p.within)
    for p in reversed(order):
        p.whole = p.own + sum(q.whole for q in p.within)
    ask = [(p.comments, -p.whole, i, p) for i, p in enumerate(roots.values())]
    heapq.heapify(ask)
    asked = len(ask)
    while ask:
        *_, p = heapq.heappop(ask)
        if p.whole and (not free or (not has_core and not p.comments and p.whole > free)):
            p.open = True
            free += p.own
            for q in p.within:
                heapq.heappush(ask, (q.comments, -q.whole, asked, q))
                asked += 1


def classify(page: list[Block]) -> list[Block]:
    """Labels every block good or bad."""
    first = first_pass(page)
    outvote(page, first)
    stands = [b.outside or (b.part is not None and not b.part.open) for b in page]
    inner = [(b, kind) for b, kind, bad in zip(page, first, stands, strict=True) if not bad]
    own = sum(len(b.text) for b, _ in inner if b.core)
    others = sum(len(b.text) for b, kind in inner if not b.core and kind == "good")
    has_core = 0 < own and others <= OUTWEIGHED * own
    passed = [bad or (has_core and not b.core) for b, bad in zip(page, stands, strict=True)]  # neither kept nor neighbours
    for b, kind, bad in zip(page, first, passed, strict=True):
        b.label = "bad" if bad else "ambiguous" if has_core and kind == "bad" else kind
    decided = [b.label for b in page]

    def look(order: range) -> list[tuple[int, str]]:
        out, last = [(len(page), "")] * len(page), None
        for i in order:
            if last is not None:
                out[i] = (abs(i - last), decided[last])
            if decided[i] != "ambiguous" and not passed[i]:
                last = i
        return out

    near = list(zip(look(range(len(page))), look(range(len(page) - 1, -1, -1)), strict=True))
    for b, ((d1, before), (d2, after)) in zip(page, near, strict=True):
        if b.label == "ambiguous":
            if before == after or not (before and after):
                b.label = before or after or "good"
            else:
                b.label = "good" if has_core or (b.heading and d1 == d2) else before if d1 <= d2 else after
    return page


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in classify(blocks(page or "")) if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    schema = StructType([pages.schema["page_id"], pages.schema["url"], StructField("text", StringType(), False), StructField("n_chars", LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", F.col("text"), "n_chars")

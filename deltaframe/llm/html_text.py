"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags.  The first pass decides each
block by itself: its length, the share of it that is links and its density of stop words make it good, bad or,
where it is too short or too unlike prose to tell, ambiguous.  The second pass lets ambiguous blocks
inherit the label of the nearest decided neighbours.  Good blocks make the text.

Tags are evidence: navigation, footers, adverts, comments and the like are bad.  Where article or main
elements hold a fair share of what is left (``frame``), what lies outside them is bad and a doubtful block inside them good.

Cases: a null or empty page, or one without a good block, gives an empty text;
tags that are never closed or pages cut in the middle of a tag are read as far
as they go (a cut tag is no text); a quotation mark that is never closed ends at its tag's end; equal rows each give a row; further columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

# Function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be been but by can could do for from had has have he her his how i if in into is it
    its more most no not of on one or other our out she so some such than that the their them then there these they this to up was we were
    what when which who will with would you your
    au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui sa
    se ses son sont sur tu un une vous plus être était
    als am an auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer er es für hat ich ihr im ist
    mit nach nicht noch nur oder sich sie sind so um und von vor war was wie wir zu zum zur über
    al como con del el ella ellos era es esta este ha han hay la las lo los más me mi muy no nos o para pero por se ser si sin sobre su
    sus también un una y ya""".split()
)

# Elements by what they do.
RAW_TEXT = ("title", "script", "style", "noscript", "template", "svg", "iframe", "canvas", "video", "audio", "textarea", "select")
BLOCKS = frozenset(
    """address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frame h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead
    title tr ul""".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav footer aside form button menu dialog".split())
CONTENT = frozenset(("article", "main"))
BOILERPLATE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|sponsor(?:ed)?|promo(?:tion)?s?|banners?|nav(?:bar|igation)?|menus?|breadcrumbs?|sidebars?|side|"
    r"footers?|headers?|masthead|comments?|disqus|replies|respond|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modals?|overlays?|"
    r"newsletters?|subscribe|signup|login|share|sharing|social|related|recommended|widgets?|pagination|pager|toc|skip|copyright|legal|disclaimers?)(?:$|[\s_-])"
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar note".split())

HEAD = frozenset("meta link base script style noscript template title head html".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_IN_TAG = re.compile(r">|=\s*[\"']")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW_TEXT}
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Rules:
    """Thresholds of the first pass, in characters and shares."""

    short: int = 70
    long: int = 200
    most_links: float = 0.35
    low_stop_words: float = 0.15
    high_stop_words: float = 0.25
    only_links: float = 0.9
    frame: float = 0.25


@dataclass
class Block:
    text: str
    linked: int
    boilerplate: bool
    content: int  # number of the enclosing article or main element, 0 outside
    label: str = ""
    framed: bool = False  # inside of what holds the page's text


def _is_boilerplate(tag: str, attributes: str, inside_content: bool) -> bool:
    if tag in BOILERPLATE or tag == "header" and not inside_content:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if name == "role" and value in BOILERPLATE_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and HIDDEN_STYLE.search(value):
            return True
        if name in ("class", "id") and BOILERPLATE_NAMES.search(value) and not (tag in CONTENT or inside_content and "header" in value):
            return True
        if name in ("class", "id") and tag == "article" and "comment" in value:
            return True
    return False


class _Scanner:
    """Cuts a page into text and tags, from left to right; what is not found once is not looked for again."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.absent: set[object] = set()

    def _find(self, what: object, at: int) -> int:
        """Where a string begins or a pattern matches; -1 if not."""
        if what in self.absent:
            return -1
        if isinstance(what, str):
            found = self.page.find(what, at)
        else:
            match = what.search(self.page, at)
            found = match.start() if match else -1
        if found < 0:
            self.absent.add(what)
        return found

    def _tag_end(self, at: int) -> tuple[int, int]:
        """End of a tag's attributes and of the tag."""
        size = len(self.page)
        while True:
            match = _IN_TAG.search(self.page, at)
            if not match:
                return size, size
            if self.page[match.end() - 1] == ">":
                return match.start(), match.end()
            close = self._find(self.page[match.end() - 1], match.end())
            if close < 0:  # an open quotation mark: the tag ends at the next bracket, or the page is cut here
                end = self.page.find(">", match.end())
                return (end, end + 1) if end >= 0 else (size, size)
            at = close + 1

    def parts(self) -> Iterator[tuple[str, str, str]]:
        """``(kind, name or text, attributes)``: kinds are text, open, close and gap (something that is not shown)."""
        page, size, at, head = self.page, len(self.page), 0, False
        while at < size:
            start = page.find("<", at)
            text = page[at : size if start < 0 else start]
            if text and head and not text.strip():
                text = ""
            if text:
                head = False
                yield "text", text, ""
            if start < 0:
                return
            if page.startswith("<!--", start):
                end = self._find("-->", start + 4)
                at = size if end < 0 else end + 3
                continue
            close = page.startswith("</", start)
            name = _NAME.match(page, start + 1 + close)
            if not name:
                if page[start + 1 : start + 2] in ("!", "?", "/"):  # declarations and their like
                    end = page.find(">", start)
                    at = size if end < 0 else end + 1
                elif start + 1 == size:
                    return
                else:
                    yield "text", "<", ""
                    at = start + 1
                continue
            tag = name[0].lower()
            end, at = self._tag_end(name.end())
            attributes = page[name.end() : end]
            if tag == "head":
                head = not close
                yield "gap", "", ""
                continue
            if head and tag not in HEAD:
                head = False
            if not close and tag in _RAW_END and not attributes.endswith("/"):
                end = self._find(_RAW_END[tag], at)
                at = size if end < 0 else self._tag_end(end + 2 + len(tag))[1]
                yield "gap", "", ""
            elif tag in _RAW_END:
                yield "gap", "", ""
            else:
                yield "close" if close else "open", tag, attributes


def blocks(page: str) -> list[Block]:
    """The page's blocks that hold any text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # open elements: name, boilerplate, content number
    parts: list[str] = []
    linked = contents = links = 0
    boilerplate, content = False, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Block(text, min(linked, len(text)), boilerplate, content))
        linked = 0

    for kind, tag, attributes in _Scanner(page).parts():
        if kind == "text":
            parts.append(tag)
            linked += len(tag.strip()) if links else 0
            continue
        if kind == "gap":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if kind == "close":
            if tag == "a":
                links = max(0, links - 1)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in BLOCKS and stack[i][1]:
                        flush()
                    del stack[i:]
                    boilerplate, content = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
                    break
            continue
        if tag == "a":
            links += 1
        if tag in VOID or attributes.endswith("/"):
            continue
        bad = boilerplate or _is_boilerplate(tag, attributes, content > 0)
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # closed by the next of its kind
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    boilerplate, content = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
                    bad = boilerplate or _is_boilerplate(tag, attributes, content > 0)
                    break
                if stack[i][0] not in ("p", "b", "i", "em", "strong", "span", "a", "u", "font", "small"):
                    break
        if tag in BLOCKS or bad != boilerplate:
            if tag not in BLOCKS:
                flush()
            if tag in CONTENT and not bad:
                contents += not content
                content = content or contents
            boilerplate = bad
            stack.append((tag, boilerplate, content))
    flush()
    return out


def first_pass(found: list[Block], rules: Rules) -> None:
    """Label each block good, bad or ambiguous by what it holds itself."""
    density = []
    inside = total = 0
    known = False
    for b in found:
        words = WORD.findall(b.text.lower())
        density.append(sum(w in STOP_WORDS for w in words) / max(1, len(words)))
        if not b.boilerplate:
            known |= density[-1] >= rules.low_stop_words and len(b.text) >= rules.short
            total += len(b.text) - b.linked
            inside += len(b.text) - b.linked if b.content else 0
    framed = inside > 0 and inside >= rules.frame * total
    for b, stop in zip(found, density, strict=True):
        n = len(b.text)
        b.framed = framed and b.content > 0
        prose = stop >= rules.high_stop_words if known else n >= rules.long  # or a language without a list of stop words
        if b.boilerplate or framed and not b.content or b.linked >= rules.only_links * n:
            b.label = "bad"
        elif b.linked > rules.most_links * n:
            b.label = "ambiguous" if b.framed else "bad"
        elif n < rules.short:
            b.label = "bad" if b.text[0] in "©®" and not b.framed else "ambiguous"
        elif prose:
            b.label = "good"
        else:
            b.label = "ambiguous" if b.framed or not known or stop >= rules.low_stop_words or n < rules.long else "bad"


def second_pass(found: list[Block]) -> None:
    """Ambiguous blocks take the label of the nearest decided neighbour.

    Structural boilerplate has no say.  Inside an article
    a block turns bad only between two bad ones; elsewhere a tie, or no
    decided neighbour at all, makes it bad.
    """
    decided = [(i, b) for i, b in enumerate(found) if b.label != "ambiguous" and not b.boilerplate]
    after = 0
    for i, b in enumerate(found):
        if b.label != "ambiguous":
            continue
        while after < len(decided) and decided[after][0] < i:
            after += 1
        near = [(abs(j - i), x.label) for j, x in decided[max(0, after - 1) : after + 1] if not b.framed or x.content == b.content]
        if b.framed:
            label = "bad" if [x for _, x in near] == ["bad", "bad"] else "good"
        else:
            label = "good" if near and all(x == "good" for d, x in near if d == min(near)[0]) else "bad"
        b.label = f"{b.label}:{label}"


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    if not page:
        return ""
    found = blocks(page)
    first_pass(found, rules)
    second_pass(found)
    return " ".join(b.text for b in found if b.label.endswith("good"))


def extract(df: DataFrame, key: str, markup: str, rules: Rules = Rules()) -> DataFrame:
    """``(key, text string)`` for each row.  No shuffle: pages are read one by one where they lie."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = [main_text(x, rules) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return df.select(F.col(key).alias("key"), F.col(markup).alias("markup")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def page_texts(pages: DataFrame) -> DataFrame:
    """``pages`` with their main text: page_id, url, text, n_chars."""
    packed = pages.select(F.struct("page_id", "url").alias("row"), "html")
    out = extract(packed, "row", "html")
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))

"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Blocks inside menus, page headers, footers, sidebars, notices,
adverts, forms or comment sections (by element, role, class or id) are boilerplate, scripts, styles and
hidden parts are no text at all, and blocks of an ``article`` or ``main`` that aren't lists of links are
content. First pass over the rest: link density, length and stop-word density decide good, bad, or leave a
block open (``short`` or ``near``). Second pass: an open block takes the label of its nearest decided
neighbours; where they differ, a ``near`` block or a heading before good text is good and a short one is bad.

Whole html, null as empty; nothing but boilerplate gives an empty text. Only ``page_id``, ``url`` and
``html`` are read, and rows are independent, so repeated rows and ties give equal texts.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow_batches

#: Frequent function words.
STOP_WORDS = frozenset(
    """the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there
    would their we him been has when who will no more if out so what up its about into than them can only other time new some could these two may first
    then do any like my now over such our man me even most made after also did many off before must well back through years where much your way down
    should because long each just state those too mr how little
    de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son mais comme ou aux leur nous vous elle cette
    der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum
    el y los del las por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde""".split()
)
#: Elements whose content is no text.
RAW = frozenset("script style noscript template textarea select svg math iframe object canvas audio video title head datalist".split())
#: Elements that begin and end a block.
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header
    hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul button input""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and names that mark boilerplate.
BAD_ELEMENTS = frozenset("nav footer aside form menu button dialog fieldset".split())
BAD_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist respond reply replies disqus cookie cookies
    consent gdpr footer masthead menu nav navbar navigation newsletter notice notices alert pagination pager popup modal overlay promo promoted promotion related
    recommended share sharing sidebar social sponsor sponsored subscribe subscription toolbar topbar widget widgets search login signup skip copyright disclaimer""".split()
)
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Some stop words per word, characters of a block, share of characters in links.
STOP_LOW, STOP_HIGH, SHORT, LONG, LINKS = 0.15, 0.25, 70, 200, 0.33

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_WORD = re.compile(r"\w+")
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_ENDS_P = BLOCK - {"button", "input", "option"}


@dataclass
class Block:
    text: str
    link_chars: int
    bad: bool
    inside: bool
    heading: bool

    def kind(self) -> str:
        """First pass."""
        if self.bad or not self.text:
            return "bad"
        density = self.link_chars / len(self.text)
        if self.inside:
            return "bad" if density > 0.8 and len(self.text) < LONG else "good"
        if density > LINKS or "\xa9" in self.text or "&copy" in self.text:
            return "bad"
        if len(self.text) < SHORT:
            return "bad" if self.link_chars else "short"
        found = [w.lower() in STOP_WORDS for w in _WORD.findall(self.text)]
        stops = sum(found) / max(1, len(found))
        if stops >= STOP_HIGH:
            return "good" if len(self.text) > LONG else "near"
        return "near" if stops >= STOP_LOW else "bad"


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html_module.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def _is_bad(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    if tag in BAD_ELEMENTS or tag == "header" and not inside:
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if attrs.get("role", "").lower() in BAD_ROLES:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    return bool(names.strip()) and any(n.lower() in BAD_NAMES for n in _NAME.findall(names))


def blocks(page: str) -> list[Block]:
    """The page's non-empty text blocks in page order."""
    out: list[Block] = []
    parts: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, in boilerplate, in article
    in_link = 0
    breaks = 0
    heading = False

    def state() -> tuple[bool, bool]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, False)

    def flush() -> None:
        nonlocal heading, in_link
        text = " ".join(html_module.unescape("".join(parts)).split())
        if text:
            bad, inside = state()
            out.append(Block(text, min(len(text), len(" ".join(html_module.unescape("".join(links)).split()))), bad, inside, heading))
        parts.clear()
        links.clear()
        heading = False

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            parts.append(text)
            if in_link:
                links.append(text)
            if not text.isspace():
                breaks = 0
        if m is None:
            break
        at = m.end()
        if m[0].startswith("<![CDATA["):
            continue
        closing, tag = m[1], m[2]
        if closing:
            tag = closing.lower()
            if tag == "a":
                in_link = max(0, in_link - 1)
                continue
            if tag in BLOCK:
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = _CLOSE[tag].search(page, at)
                at = end.end() if end else n if tag not in ("head", "title") else at
                if tag == "head" and end is None:
                    at = m.end()
            continue
        if tag == "br":
            parts.append(" ")
            breaks += 1
            if breaks == 2:
                flush()
            continue
        if tag == "a":
            in_link = 1
            continue
        if tag not in BLOCK:
            continue
        flush()
        breaks = 0
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = True
        if tag in VOID:
            continue
        attrs = _attributes(m[3]) if m[3] else {}
        if tag in _ENDS_P and stack and stack[-1][0] == "p":
            stack.pop()  # an open paragraph ends where a block begins
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            stack.pop()
        if tag in ("article", "main") and state()[0] and all(t in ("nav", "header", "html", "body") or not b for t, b, _ in stack):
            while stack and state()[0]:  # a menu or header left open ends where the article begins
                stack.pop()
        bad, inside = state()
        inside = inside or tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article") or attrs.get("itemprop") == "articleBody"
        stack.append((tag, bad or _is_bad(tag, attrs, inside), inside))
    flush()
    return out


def decide(found: list[Block]) -> list[bool]:
    """Second pass: which blocks are content."""
    kinds = [b.kind() for b in found]
    before, after = ["bad"] * len(kinds), ["bad"] * len(kinds)
    last = "bad"
    for i, k in enumerate(kinds):
        before[i] = last
        last = k if k in ("good", "bad") else last
    last = "bad"
    for i in range(len(kinds) - 1, -1, -1):
        after[i] = last
        last = kinds[i] if kinds[i] in ("good", "bad") else last
    out = []
    for i, k in enumerate(kinds):
        if k == "near":  # nothing decided around it: its stop words speak for it
            out.append("good" in (before[i], after[i]) or "good" not in kinds)
        elif k == "short":
            out.append(before[i] == after[i] == "good" or found[i].heading and after[i] == "good")
        else:
            out.append(k == "good")
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, decide(found)) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; a narrow stage."""
    bound_arrow_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    frame = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    kind = dict(frame.dtypes)["page_id"]
    return frame.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")

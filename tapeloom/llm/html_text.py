"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  First pass: markup that names itself (navigation, footer,
adverts, comments and so on) and dense links decide against a block; length and stop-word density, or an
article element around it, decide for it; the rest stays open.  Second pass: open blocks inherit the label of
their nearest decided neighbour, among blocks of the same parent if there are any.  Both passes run over
the blocks of many pages at once.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.frames import map_batches, pick

SHORT = 70  # characters; shorter blocks are never decided by their words
LONG = 200
STOP_LOW, STOP_HIGH = 0.15, 0.30
LINK_SHARE = 0.5

#: fixed values: frequent function words of English, German, French and Spanish
STOP_WORDS = frozenset(
    """the of and to in is that it for was on are as with be this by from at or an have not but which you were they his
    der die das und ist nicht ein eine zu den von mit sich auf für dem im auch als wie wird sind es ich er sie werden bei oder
    le la les et des un une du est que qui dans pour pas sur au avec par ce il elle se plus ne son sont mais ou nous vous
    el los las y de en una por con para su al lo como más pero sus este sin sobre también fue ser o del es no""".split()
)

#: fixed values: elements by what they mean for the text around or inside them
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th
    thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset(
    """head nav footer aside form noscript template svg math canvas object audio video select button menu dialog fieldset
    datalist""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|ad(?:box|slot|unit|wrap\w*|sense)|advert\w*|sponsor\w*|promo\w*|banners?|cookie\w*|consent|gdpr|notices?"
    r"|notification\w*|alerts?|popup\w*|pop|modal|overlay|newsletter|subscri\w*|signup|login|sidebar|side|widgets?|menu\w*|nav|navbar"
    r"|navigation|breadcrumbs?|footer|masthead|toolbar|pagination|pager|share|sharing|social|related|recommend\w*|comment\w*|respond"
    r"|repl(?:y|ies)|disqus|disclaimer|topbar)(?=$|[\s_-])", re.I,
)
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comment\w*|repl(?:y|ies)|ads?|advert\w*)(?=$|[\s_-])", re.I)
_HEADER = re.compile(r"(?:^|[\s_-])header(?=$|[\s_-])", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[A-Za-z][^>]*(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[^\W\d_]+")

BAD, OPEN, GOOD = 0, 1, 2


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)} if source.strip() else {}


def _dropped(name: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element says of itself that it holds no main text."""
    if name in DROPPED or name == "header" and not in_article or name == "article" and in_article:
        return True
    if not attributes or name in ("html", "body"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in ROLES:
        return True
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    if name in ("article", "main"):
        return bool(_COMMENT.search(named))
    return bool(_NAMED.search(named)) or not in_article and bool(_HEADER.search(named))


class _Page:
    """The blocks of one page in order: text, link characters, flags and the parent they share with others."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[str, int, bool, int, bool, int]] = []  # text, link chars, dropped, region, heading, parent
        #: name, dropped, region (article 2, main 1), number, whether the innermost block element is dropped
        self.stack: list[tuple[str, bool, int, int, bool]] = [("", False, 0, 0, False)]
        self.open: dict[str, int] = {}
        self.number = self.links = self.breaks = 0
        self.parts: list[str] = []
        self.linked: list[str] = []
        at = 0
        while token := _TOKEN.search(source, at):
            self._text(source[at : token.start()])
            at = token.end()
            if not token[2]:
                continue
            name = token[2].lower()
            if token[1]:
                self._close(name)
            else:
                self._start(name, token[3])
                if name in RAW:
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                    at = end.start() if end else len(source)
        self._text(source[at:])
        self._flush()

    def _text(self, source: str) -> None:
        if source and self.stack[-1][1] == self.stack[-1][4]:  # else inside a dropped element within a line of text
            text = html.unescape(source) if "&" in source else source
            self.parts.append(text)
            if not text.isspace():
                self.breaks = 0
                if self.links:
                    self.linked.append(text)

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                blocks = [entry for entry in self.stack[-8:] if entry[0] in BLOCKS]
                _, dropped, region, *_ = self.stack[-1]
                inner = blocks[-1] if blocks else self.stack[0]
                parent = blocks[-2][3] if len(blocks) > 1 else 0
                links = len(" ".join("".join(self.linked).split()))
                self.blocks.append((text, links, dropped, region, inner[0] in ("h1", "h2", "h3", "h4", "h5", "h6"), parent))
        self.parts, self.linked, self.breaks = [], [], 0

    def _start(self, name: str, source: str) -> None:
        if name == "br":
            self.breaks += 1
            self.parts.append(" ")
            if self.breaks == 2:
                self._flush()
            return
        if name in BLOCKS:
            self._flush()
            if name == "li":
                self._implied({"li"})
            elif name in ("dt", "dd"):
                self._implied({"dt", "dd"})
            elif name in ("td", "th", "tr"):
                self._implied({"td", "th"} if name != "tr" else {"td", "th", "tr"})
            self._implied({"p"})
        if name in VOID or name in RAW:
            return
        _, dropped, region, _, block_dropped = self.stack[-1]
        attributes = _attributes(source)
        dropped = dropped or _dropped(name, attributes, region == 2)
        if name == "article" or "articlebody" in attributes.get("itemprop", "").lower():
            region = 2
        elif name == "main" or attributes.get("role", "").lower() == "main":
            region = max(region, 1)
        self.number += 1
        self.stack.append((name, dropped, region, self.number, dropped if name in BLOCKS else block_dropped))
        self.open[name] = self.open.get(name, 0) + 1
        self.links += name == "a"

    def _implied(self, names: set[str]) -> None:
        """Close an element that ends where another starts, unless a container stands between."""
        if not any(self.open.get(n) for n in names):
            return
        for place in range(len(self.stack) - 1, 0, -1):
            name = self.stack[place][0]
            if name in names:
                self._pop(place)
                return
            if name in BLOCKS and name not in ("p", "td", "th"):
                return

    def _close(self, name: str) -> None:
        if name in BLOCKS:
            self._flush()
        if not self.open.get(name):
            return
        inline = name not in BLOCKS
        for place in range(len(self.stack) - 1, 0, -1):
            if self.stack[place][0] == name:
                self._pop(place)
                return
            if inline and self.stack[place][0] in BLOCKS:
                return

    def _pop(self, place: int) -> None:
        for name, *_ in self.stack[place:]:
            self.open[name] -= 1
            self.links -= name == "a"
        del self.stack[place:]


def stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _fill(label: np.ndarray, place: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label of the last decided block up to each one within its run, and how far back it is (huge: none)."""
    n = len(label)
    last = np.maximum.accumulate(np.where(label != OPEN, np.arange(n), -1))
    first = np.repeat(starts, np.diff(np.r_[starts, n]))
    found = last >= first
    last = np.maximum(last, 0)
    return np.where(found, label[last], OPEN), np.where(found, np.abs(place - place[last]), 1 << 60)


def inherit(label: np.ndarray, heading: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Labels in which open blocks have that of their nearest decided neighbour of the same group.

    At equal distances a heading follows what comes after it, another block is good if either is.  Open
    blocks of groups without decided ones stay open.
    """
    if not len(label):
        return label
    order = np.argsort(group, kind="stable")
    place, g = order, group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    before, back = _fill(label[order], place, starts)
    turned = order[::-1]
    after, on = _fill(label[turned], turned, np.flatnonzero(np.r_[True, g[::-1][1:] != g[::-1][:-1]]))
    after, on = after[::-1], on[::-1]
    tie = np.where(heading[order], after, np.maximum(before, after))
    out = label.copy()
    out[order] = np.where(label[order] != OPEN, label[order], np.where(back < on, before, np.where(on < back, after, np.where(back == 1 << 60, OPEN, tie))))
    return out


def main_blocks(page: np.ndarray, blocks: list[tuple[str, int, bool, int, bool, int]]) -> np.ndarray:
    """Which blocks of many pages are main text; ``page`` numbers the page of each block."""
    text = [b[0] for b in blocks]
    size, links, dropped, region, heading, parent = (
        np.array(c) for c in ([len(t) for t in text], *zip(*[b[1:] for b in blocks], strict=True))
    )
    stop = np.array([stop_share(t) if len(t) >= SHORT else 0.0 for t in text])
    notice = np.array(["©" in t and len(t) < LONG for t in text])
    # the article, or else the main element, of a page that has text in one
    top = np.zeros(page.max() + 1, int)
    np.maximum.at(top, page, np.where(dropped, 0, region))
    inside = (region > 0) & (region == top[page])
    linked = links > LINK_SHARE * size
    dense = np.where(stop >= STOP_HIGH, np.where(size > LONG, GOOD, OPEN), np.where(stop >= STOP_LOW, OPEN, BAD))
    label = np.where(size < SHORT, OPEN, np.where(inside, GOOD, dense))
    label[linked | notice & ~inside | dropped | ~inside & (top[page] > 0)] = BAD

    some = np.zeros(len(top), bool)
    some[page[label == GOOD]] = True
    label[(label == OPEN) & ~some[page]] = GOOD  # nothing on the page is decided for: only short blocks

    wide = int(parent.max()) + 1
    among = ~(dropped & inside)  # an advert inside the article says nothing of the text around it
    out = label.copy()
    out[among] = inherit(label[among], heading[among], (page * wide + parent)[among])
    out[among] = inherit(out[among], heading[among], (page * 2 + inside)[among])
    out[(out == OPEN) & inside] = GOOD
    return out == GOOD


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of the main text of every page.

    Blocks have single spaces inside, none at their ends, and one line feed between them.  A null or empty
    page, or one without main text, has the empty text; null ids and urls stay null; repeated rows give
    repeated rows; unclosed or wrongly nested tags end where a browser would end them; pages of any
    length are read whole; other columns are not read.
    """

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts: list[list[str]] = [[] for _ in range(batch.num_rows)]
        blocks, page = [], []
        for at, value in enumerate(batch.column(2)):
            found = _Page(value.as_py() or "").blocks
            blocks += found
            page += [at] * len(found)
        if blocks:
            for at in np.flatnonzero(main_blocks(np.array(page), blocks)):
                texts[page[at]].append(blocks[at][0])
        joined = ["\n".join(t) for t in texts]
        columns = [batch.column(0), batch.column(1), pa.array(joined), pa.array([len(t) for t in joined], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    columns = pick(pages, page_id=page_id, url=url, html=source).withColumn("page_id", F.col("page_id").cast("bigint"))
    return map_batches(columns, scan, "page_id bigint, url string, text string, n_chars bigint")

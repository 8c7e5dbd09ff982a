"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Fixed values of the HTML standard and common markup: element kinds, and names that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template title svg canvas iframe object textarea select option button".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
SIDE = frozenset("nav footer aside form header dialog menu fieldset".split())
SIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login masthead menu nav navbar navigation newsletter notice pagination popup promo related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
CONTENT = frozenset("article main".split())
CLOSED_BY_BLOCK = frozenset(["p"])
SAME_CLOSE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PUNCTUATION = frozenset(".,;:!?…。，！？、")
THRESHOLD = 0.05


class Block:
    __slots__ = ("path", "text", "side")

    def __init__(self, path: tuple[str, ...], text: str, side: bool):
        self.path, self.text, self.side = path, text, side


class PageParser(HTMLParser):
    """Blocks of text with their root-to-leaf tag paths; inline tags do not end a block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, bool]] = []  # tag, name on the path, side
        self.blocks: list[Block] = []
        self.held: list[str] = []
        self.hidden = 0

    def _end_block(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            names = tuple(n for t, n, _ in self.open if t not in INLINE)
            self.blocks.append(Block(names, text, any(s for _, _, s in self.open)))

    def _close(self, at: int) -> None:
        for tag, _, _ in self.open[at:]:
            self.hidden -= tag in HIDDEN
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self._end_block()
            closes = SAME_CLOSE.get(tag, CLOSED_BY_BLOCK)
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] in closes:
                    self._close(at)
                    break
                if self.open[at][0] not in INLINE:
                    break
        elif tag == "br":
            self.held.append(" ")
        if tag in VOID:
            return
        given = dict(attrs)
        names = f"{given.get('class') or ''} {given.get('id') or ''} {given.get('role') or ''}".lower()
        words = set(names.replace("-", " ").replace("_", " ").split())
        side = tag in SIDE or bool(words & SIDE_NAMES) and tag not in ("html", "body") and tag not in CONTENT
        if side and tag == "header" and any(t in CONTENT for t, _, _ in self.open):
            side = bool(words & SIDE_NAMES)
        first = (given.get("class") or "").split()
        self.open.append((tag, f"{tag}.{first[0]}" if first else tag, side))
        self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._end_block()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._close(at)
                return
            if tag in INLINE and self.open[at][0] not in INLINE:
                return  # a stray inline end tag never closes a block

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.held.append(data)

    def finish(self) -> list[Block]:
        self.close()
        self._end_block()
        return self.blocks


def path_scores(blocks: list[Block]) -> dict[tuple[str, ...], float]:
    """Fused ratio of each tag path: its text and punctuation per block, smoothed along the page.

    Both ratios are given to the blocks of the path in page order and smoothed with
    a Gaussian, so short blocks among long ones keep a high value; the path's score
    is the mean over its blocks of the product.
    """
    texts: dict[tuple[str, ...], int] = defaultdict(int)
    marks: dict[tuple[str, ...], int] = defaultdict(int)
    counts: dict[tuple[str, ...], int] = defaultdict(int)
    for b in blocks:
        texts[b.path] += len(b.text)
        marks[b.path] += sum(c in PUNCTUATION for c in b.text)
        counts[b.path] += 1
    window = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    window /= window.sum()

    def smooth(values: dict[tuple[str, ...], int]) -> np.ndarray:
        line = np.array([values[b.path] / counts[b.path] for b in blocks])
        return np.convolve(np.pad(line, 2, mode="edge"), window, mode="valid")

    fused = smooth(texts) * (1 + smooth(marks))
    sums: dict[tuple[str, ...], float] = defaultdict(float)
    for b, value in zip(blocks, fused):
        sums[b.path] += value
    return {path: total / counts[path] for path, total in sums.items()}


def main_text(html: str | None, threshold: float = THRESHOLD) -> str:
    """The article of a page: blocks joined by an empty line.

    Boilerplate containers (by element and by class or id names) are set aside
    first. Of the other tag paths those with a score of ``threshold`` of the best
    are content; their deepest common container is the article, and all its blocks
    are kept, headings and short paragraphs too. An ``article`` or ``main`` element
    on the best path is that container.
    """
    if not isinstance(html, str) or not html:
        return ""
    cut = html.rfind("<")  # a page may break off inside a tag
    if cut >= 0 and ">" not in html[cut:] and (html[cut + 1 : cut + 2].isalpha() or html[cut + 1 : cut + 2] in ("/", "!", "")):
        html = html[:cut]
    parser = PageParser()
    parser.feed(html)
    blocks = [b for b in parser.finish() if not b.side]
    if not blocks:
        return ""
    scores = path_scores(blocks)
    weights: dict[tuple[str, ...], float] = defaultdict(float)
    for b in blocks:
        weights[b.path] += scores[b.path] * len(b.text)
    best = max(weights, key=lambda p: (any(n.split(".")[0] in CONTENT for n in p), weights[p]))
    inside = [k for k, n in enumerate(best) if n.split(".")[0] in CONTENT]
    if inside:
        container = best[: inside[-1] + 1]
    else:
        chosen = [p for p in scores if scores[p] >= threshold * scores[best]]
        container = best[:-1] if len(best) > 1 else best
        while container and sum(p[: len(container)] == container for p in chosen) < len(chosen) / 2:
            container = container[:-1]
    return "\n\n".join(b.text for b in blocks if b.path[: len(container)] == container)


def extract_pages(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``.

    A null or empty html, or one without content, gives an empty text. Nulls in the
    other columns come back. Repeated rows each get their row; an empty table gives
    none. Other columns are ignored.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h, threshold) for h in batch["html"]]
            yield pd.DataFrame(
                {
                    "page_id": batch["page_id"].astype("Int64"),
                    "url": batch["url"],
                    "text": texts,
                    "n_chars": np.array([len(t) for t in texts], dtype=np.int64),
                }
            )

    return pages.select("page_id", "url", "html").mapInPandas(extract, "page_id long, url string, text string, n_chars long")

"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Lines in a sliding window, and the share of the highest window that a surge must reach.
WINDOW = 3
SURGE = 0.2
#: What a line counts where a page marks its article: inside, and outside.
INSIDE, OUTSIDE = 20.0, 0.5

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?P<end>>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose content is no text of the page; their content is skipped unparsed.
_RAW = frozenset("script style noscript textarea template iframe object svg math select title xmp noembed noframes audio video canvas datalist".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img ruby rt rp nobr input blink output meter progress".split())
#: Boilerplate by element and by role.
_AWAY = frozenset("nav footer aside form button menu dialog search fieldset".split())
_AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Containers whose class or id has one of these words are suspects: they go unless they hold the page's text.
_SUSPECT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification "
    "sidebar comment comments disqus replies respond discussion share sharing social related recommended recommendations newsletter subscribe subscription "
    "signup login signin breadcrumb breadcrumbs pagination pager nav navbar navigation menu menus header footer masthead topbar toolbar popup modal widget widgets copyright".split()
)
#: A class of these words tells a state of the page, not what the element is: "has-sidebar", "comments-open".
_STATE_WORDS = frozenset("has no not with without is open opened closed enabled disabled content up background".split())
_CONTAINERS = frozenset("div section ul ol dl table td center header".split())
_ARTICLE_ROLES = frozenset(("main", "article"))


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def _is_away(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    if name in _AWAY or name == "header" and not in_article:
        return True
    if not attrs or name in ("html", "body", "main"):
        return False
    if attrs.get("role", "").lower() in _AWAY_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "").lower()))


def _is_suspect(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    if name not in _CONTAINERS or not attrs:
        return False
    for token in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = set(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower()))
        if words & _SUSPECT_WORDS and not words & _STATE_WORDS and not (in_article and words & {"header", "masthead"}):
            return True
    return False


class Line(NamedTuple):
    """A line of a page. ``suspects`` are the numbers of the suspect elements around it."""

    text: str
    linked: int
    article: bool
    suspects: tuple[int, ...]


class _State(NamedTuple):
    away: bool = False
    article: bool = False
    link: bool = False
    suspects: tuple[int, ...] = ()


class _Elements:
    """The open elements. A close tag that opens nothing costs no search, so deep nesting takes linear time."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, _State, Counter]] = []
        self.blocks: Counter = Counter()
        self.inline: Counter = Counter()  # those opened since the last block
        self.state = _State()

    def push(self, name: str, state: _State) -> None:
        self.stack.append((name, self.state, self.inline))
        if name in _INLINE:
            self.inline[name] += 1
        else:
            self.blocks[name] += 1
            self.inline = Counter()
        self.state = state

    def _pop(self) -> str:
        name, self.state, inline = self.stack.pop()
        if name in _INLINE:
            inline[name] -= 1
        else:
            self.blocks[name] -= 1
        self.inline = inline
        return name

    def close(self, name: str) -> None:
        if (self.inline if name in _INLINE else self.blocks)[name]:
            while self._pop() != name:
                pass

    def close_sibling(self, name: str) -> None:
        """An open element of the same kind, with nothing but inline elements inside it, ends where another begins."""
        if not self.blocks[name]:
            return
        at = len(self.stack) - self.inline.total() - 1
        if at >= 0 and self.stack[at][0] == name:
            self.close(name)


def lines_of(html: str) -> list[Line]:
    """Lines of a page, those of boilerplate elements empty.

    Every block element begins and ends a line; inline elements and line breaks
    do not. Elements that are menus, headers, forms and so on by their name or
    role leave empty lines, which is what a window sees of them.
    """
    lines: list[Line] = []
    buffer: list[str] = []
    open_ = _Elements()
    linked = suspects = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(buffer).split())
        lines.append(Line(text, min(linked, len(text)), open_.state.article, open_.state.suspects))
        buffer.clear()
        linked = 0

    def text(part: str) -> None:
        nonlocal linked
        if part and not open_.state.away:
            part = unescape(part)
            buffer.append(part)
            if open_.state.link:
                linked += len(part)

    at, size = 0, len(html)
    while at < size:
        m = _MARKUP.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            text(m["cdata"].replace("&", "&amp;"))
            continue
        name = m["name"]
        if name is None:
            continue
        if not m["end"]:
            break
        name = name.lower()
        if m["close"]:
            if name not in _INLINE:
                flush()
            open_.close(name)
            continue
        raw = m["attrs"]
        if name in _RAW and not raw.endswith("/"):
            close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else size
            if name not in _INLINE:
                flush()
            continue
        if name == "br" or name == "wbr":
            text(" " if name == "br" else "")
            continue
        if name not in _INLINE:
            flush()
        if name in _VOID:
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            open_.close_sibling(name)
        attrs = _attributes(raw) if raw.strip() else {}
        away, article, link, inside = open_.state
        away = away or _is_away(name, attrs, article)
        if not away and _is_suspect(name, attrs, article):
            inside, suspects = (*inside, suspects), suspects + 1
        article = article or name in ("article", "main") or attrs.get("role", "").lower() in _ARTICLE_ROLES or attrs.get("itemprop", "").lower() == "articlebody"
        open_.push(name, _State(away, article and not away, link or name == "a", inside))
    flush()
    return lines


def _cleared(lines: list[Line]) -> list[Line]:
    """``lines`` without those of suspect elements, but for the suspects that hold the page's text.

    A suspect holds the text if more than half of the page's unlinked
    characters are in it and no marked article is outside of it.
    """
    weight = [len(x.text) - x.linked for x in lines]
    held: Counter = Counter()
    for x, n in zip(lines, weight):
        for k in x.suspects:
            held[k] += n
    if not held:
        return lines
    total = sum(weight)
    marked = sum(n for x, n in zip(lines, weight) if x.article and not any(2 * held[k] > total for k in x.suspects))
    spared = set() if marked else {k for k, n in held.items() if 2 * n > total}
    return [x if spared.issuperset(x.suspects) else x._replace(text="", linked=0) for x in lines]


def main_lines(lines: list[Line], window: int = WINDOW, surge: float = SURGE) -> list[str]:
    """Texts of the lines between surge and dive points, in page order.

    A line weighs its characters unless half of them are in links. The sum over each
    window of lines is the distribution: text surges at a window whose sum reaches ``surge`` times the
    highest, begins where the sums left zero before it, and dives where they
    are zero again. Marks of an article only add to it: where the marked lines hold
    half of all weight or more, the edges of the article are gaps, and lines
    inside count INSIDE times and lines outside OUTSIDE times as much against the
    same height, so that fragments go and a short part of the article stays. Fewer marks, as of a
    teaser card beside a body without any, change nothing.
    """
    lines = _cleared(lines)
    weight = [len(x.text) if 2 * x.linked < len(x.text) else 0 for x in lines]
    inside = sum(n for x, n in zip(lines, weight) if x.article)
    marked = inside > 0 and 2 * inside >= sum(weight)
    spaced: list[tuple[str, int, float]] = []
    for k, (x, n) in enumerate(zip(lines, weight)):
        if marked and k and x.article != lines[k - 1].article:
            spaced += [("", 0, 0.0)] * window
        spaced.append((x.text, n, n * (1.0 if not marked else INSIDE if x.article else OUTSIDE)))
    raw = np.array([n for _, n, _ in spaced], np.int64)
    if not raw.any():
        return []
    ones, pad = np.ones(window), np.zeros(window - 1)
    floor = surge * np.convolve(np.concatenate([raw, pad]), ones, "valid").max()
    sums = np.convolve(np.concatenate([[w for *_, w in spaced], pad]), ones, "valid")
    out: list[str] = []
    start = 0
    while start < len(sums):
        if sums[start] <= 0:
            start += 1
            continue
        dive = start
        while dive < len(sums) and sums[dive] > 0:
            dive += 1
        if sums[start:dive].max() >= floor:
            out += [spaced[i][0] for i in range(start, min(len(spaced), dive + window - 1)) if raw[i]]
        start = dive
    return out


def extract(html: str | None) -> str:
    """Main text of a whole page: blocks with single spaces, joined by two line feeds; null and empty pages give ''."""
    return "\n\n".join(main_lines(lines_of(html))) if html else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: id, url, text, n_chars (code points).

    One Arrow stage over the scan, no shuffle. Other columns are ignored;
    repeated rows each get a row; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return out.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint").toDF(id_col, url_col, "text", "n_chars")


def op1_html_text(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))

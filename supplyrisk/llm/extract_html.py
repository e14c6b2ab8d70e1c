"""Main text of web pages by tag-path ratios.

A page becomes a list of text blocks, each with its root-to-leaf path of
block tags.  Per path, text length, punctuation and block count are
aggregated; text and punctuation per block are fused into one ratio,
discounted by the share of link text.  Ratios are smoothed over paths that
follow each other on the page, weighted by the part of the path that they
share, and paths above a share of the best ratio are content.  Of the
content paths those count that lie in the container of the richest one;
short blocks of the container (headings, list items, table cells, ...)
follow it.

Paths compete, wherever they are.  An ``<article>`` or ``<main>`` mark
raises a path's ratio, a class, id or role that names page furniture (notices,
banners, sidebars, ...) lowers it; adverts and reader comments by such a name,
and elements that never hold the article (menus, page footers, forms,
scripts, ...), do not count.  A label names furniture when all parts of one of its words do: ``related-posts`` does,
``related-work`` does not.

Pages are independent: one Arrow pass, nothing is shuffled.  A page is
scanned once from left to right, so time is linear in its length, however
long it is; broken markup (unclosed tags, a cut-off end) ends where the page
ends.

Defined cases: null or empty html gives an empty text; of equally good paths
the first is the richest; repeated rows are extracted alike; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = "page_id long, url string, text string, n_chars long"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)[^>]*(?:>|\Z)", re.S)
_HINTS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Element names and label words with a fixed meaning in HTML pages.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option "
    "p pre section select summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title iframe svg template".split())
VOID = frozenset("hr".split())
BOILER_TAGS = frozenset("head nav footer aside form button select option optgroup menu dialog label legend dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
SHORT = HEADINGS | frozenset("p li td th dd dt blockquote pre figcaption caption".split())
#: Parts of class, id and role words that name furniture which may hold sentences, other furniture, and neither.
HARD_PARTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox sponsor sponsored sponsors promo promos promotion comment "
    "comments commentlist replies reply respond disqus related recommend recommended recommendations cookie cookies consent gdpr "
    "newsletter subscribe subscription popup modal share sharing social".split())
SOFT_PARTS = frozenset(
    "nav navbar navigation menu menus sidebar side widget widgets banner banners notice notices notification notifications alert alerts "
    "breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar login signin search copyright legal disclaimer "
    "complementary contentinfo skip".split())
PLAIN_PARTS = frozenset(
    "list lists box boxes block blocks section sections wrapper wrap container inner outer area bar bars post posts article articles "
    "link links item items button buttons icon icons media content body main site page top bottom left right form text title "
    "group row col column has is js primary secondary module panel slot unit thread reader user users site web".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、؛؟]")

#: An open element of the first kind ends where one of the second begins.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
         "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
         "option": {"option", "optgroup"}}
#: ... but not beyond these.
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "option": {"select"}}


#: Factors on a path's ratio: inside an article mark, and labelled as furniture of the second kind.
MARKED, SOFT = 2.0, 0.02


def furniture(label: str) -> int:
    """2 when a word of a class, id or role names furniture of the first kind, 1 of the second, else 0."""
    found = 0
    for word in label.lower().split():
        parts = [x for x in re.split(r"[_-]+|(?<=[a-z])(?=[0-9])", word) if x and not x.isdigit()]
        if parts and all(x in HARD_PARTS or x in SOFT_PARTS or x in PLAIN_PARTS for x in parts):
            if not parts[0] == "has":   # says something of the page, not of the element
                found = max(found, *(2 if x in HARD_PARTS else int(x in SOFT_PARTS) for x in parts))
    return found


@dataclass
class Open:
    tag: str
    path: tuple
    level: int        # 0 content so far, 1 labelled as furniture of the second kind, 2 never article
    article: int      # ordinal of the enclosing article or main, 0 outside


@dataclass
class Block:
    tag: str
    path: tuple
    level: int
    article: int
    text: str
    linked: int


@dataclass
class Ratio:
    article: int = 0
    level: int = 0
    blocks: list = field(default_factory=list)
    chars: int = 0
    marks: int = 0
    linked: int = 0

    @property
    def fused(self) -> float:
        n = len(self.blocks)
        weight = (MARKED if self.article else 1.0) * (SOFT if self.level else 1.0)
        return weight * (self.chars / n) * (1 + self.marks / n) * (1 - self.linked / max(self.chars, 1))


def parse(html: str) -> list[Block]:
    """Text blocks of a page in order."""
    stack = [Open("", (), 0, 0)]
    out: list[Block] = []
    words: list[str] = []
    link = linked = articles = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(words)).split())
        if text:
            top = stack[-1]
            out.append(Block(top.tag, top.path, top.level, top.article, text, min(linked, len(text))))
        words.clear()
        linked = 0

    def close(tag: str, beyond: frozenset | set = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                flush()
                del stack[i:]
                return
            if stack[i].tag in beyond:
                return

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        piece = html[at:m.start() if m else n]
        if piece:
            words.append(piece)
            linked += len(piece) * link
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = 0
            elif tag in BLOCKS:
                close(tag)
                flush()
            continue
        if tag in RAW:
            if not m[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if tag == "a":
            link = 1
        elif tag == "br":
            words.append(" ")
        elif tag in BLOCKS:
            flush()
            close("p", {"article", "section", "div", "td", "li", "blockquote", "body", "table"})
            for open_tag, enders in _ENDS.items():
                if tag in enders:
                    close(open_tag, _SCOPE[open_tag])
            if tag in VOID:
                continue
            top = stack[-1]
            label = " ".join(x for h in _HINTS.findall(m[3]) for x in h if x)
            level, article = top.level, top.article
            said = furniture(label)
            if tag in ("article", "main") and said < 2:
                level = 0 if level < 2 else level
                if not article:
                    articles += 1
                    article = articles
            elif tag not in ("html", "body"):
                level = max(level, 2 if tag in BOILER_TAGS else said, 1 if tag == "header" else 0)
            if tag in HEADINGS and article and stack[-1].tag == "header" and level == 1:
                level = 0    # the article's own title
            step = tag if not label else f"{tag}.{label.split()[0]}"
            stack.append(Open(tag, top.path + (step,), level, article))
            link = 0
    flush()
    return out


def _shared(a: tuple, b: tuple) -> float:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n / max(len(a), len(b), 1)


def ratios(blocks: list[Block]) -> dict[tuple, Ratio]:
    """Aggregates per path, in page order."""
    paths: dict[tuple, Ratio] = {}
    for b in blocks:
        r = paths.setdefault(b.path, Ratio(b.article, b.level))
        r.blocks.append(b)
        r.chars += len(b.text)
        r.marks += len(PUNCTUATION.findall(b.text))
        r.linked += b.linked
    return paths


def smoothed(paths: dict[tuple, Ratio]) -> dict[tuple, float]:
    """Fused ratios, averaged with those of the paths before and after by the share of the path in common."""
    order = list(paths)
    fused = [paths[p].fused for p in order]
    out = {}
    for i, p in enumerate(order):
        total, weight = 2 * fused[i], 2.0
        for j in (i - 1, i + 1):
            if 0 <= j < len(order):
                w = _shared(p, order[j])
                total, weight = total + w * fused[j], weight + w
        out[p] = total / weight
    return out


def content(blocks: list[Block], share: float = 0.15) -> list[Block]:
    """Blocks on the content paths, in page order."""
    paths = ratios([b for b in blocks if b.level < 2])
    smooth = smoothed(paths)
    if not smooth:
        return []
    best = max(smooth.values())
    chosen = {p: r for p, r in paths.items() if smooth[p] >= share * best and r.linked <= 0.5 * r.chars}
    chosen = chosen or {p: paths[p] for p in [max(smooth, key=smooth.get)]}
    # the richest path decides where the article is: its marked article, or its container
    top = max(chosen, key=lambda p: smooth[p] * paths[p].chars)
    home = paths[top]

    def inside(p: tuple, r: Ratio) -> bool:
        if home.article:
            return r.article == home.article
        return not r.article and _shared(p, top) * max(len(p), len(top)) >= len(top) - 1

    chosen = {p: r for p, r in chosen.items() if inside(p, r)}
    parents = {p[:-1] for p in chosen}

    def belongs(b: Block) -> bool:
        if b.path in chosen:
            return True
        r = paths.get(b.path)
        if r is None or r.level > home.level or r.linked > 0.5 * r.chars:
            return False
        near = inside(b.path, r) if home.article else any(b.path[:len(p)] == p for p in parents)
        return near and b.tag in (SHORT if home.article else HEADINGS)

    return [b for b in blocks if belongs(b)]


def main_text(html: str | None) -> str:
    return " ".join(b.text for b in content(parse(html))) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(run, PAGE)

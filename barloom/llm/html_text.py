"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block. Between lines stand empty lines for the borders of containers that lie there (two for each opened or closed div and its
like, one for sections and cells, none for paragraphs, lists and headings). A line's weight is its text outside links. Sums over sliding windows of
``window`` lines give the distribution: it surges where a sum becomes positive and dives where sums fall to zero again, so a stretch between surge and
dive is a run of lines with no gap as wide as the window; neighbours in different containers and rows of links part stretches.

Each stretch grows to a group, the text it is part of: all lines of the least container that holds it, or of the article or main element around that. Stretches of
no container but the body's are one group from the first surge to the last dive. Groups of ``share`` of the heaviest one's weight or more are kept (an article or main element
counts double) unless most of their text is links; if several are kept and one container below the body holds them all, so is what lies between them there. A
top heading right before the first is its title. Kept lines come whole, in page order, joined by a newline.

What the distribution can't tell, markup says: elements of navigation, forms and the like, and a few class and id words for adverts, notices, comments
and layout, as whole tokens or compounds of layout words, are taken out and leave a gap. Without an article or main element outside, layout that holds more than half of all weight stays; if
nothing else is left, so does anything that does. A header within an article or main element is part of it.

Null html is empty, and an empty page has an empty text. Truncated pages end where they end. Repeated rows each give a row; other columns are not
read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without end tag, with raw text, and that start a new block.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
#: An open p ends where one of these starts; an open li, dt, dd, tr, td, th or option ends at its like.
_ENDS_P = _BLOCK - frozenset("td th tr tbody thead tfoot li dt dd option caption body html head summary legend".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table div section article main body aside nav".split())

#: Containers, with the empty lines for each of their borders.
_BORDER = dict.fromkeys("div article main center aside nav header footer form".split(), 2) | {"section": 1, "td": 1}
_LAYOUT = frozenset("nav aside footer header form menu dialog search".split())
_NEVER = frozenset("head button select svg canvas object audio video".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
_LAYOUT_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead toolbar pagination pager widget".split())
_EXTRA_WORDS = frozenset("ad ads advert adverts advertisement sponsored promo banner cookie cookies consent newsletter popup comment comments commentlist disqus respond related share social".split())
#: What those are compounded with.
_PLACES = frozenset("site page main top bottom left right reader readers user post box list area container wrapper block inner".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
GAP = 4


class Line(NamedTuple):
    text: str
    linked: int  # characters in links, but spaces
    box: int  # its nearest container
    gap: int  # empty lines before it
    marks: tuple[int, ...]  # the furniture around it
    title: bool  # a top heading

    @property
    def weight(self) -> int:
        """Characters outside links, but spaces."""
        return max(0, len(self.text.replace(" ", "")) - self.linked)


class Page(NamedTuple):
    lines: list[Line]
    kinds: list[str]  # of the furniture: layout, extra or never
    parent: list[int]  # of each container; the first is the page
    whole: list[bool]  # whether a container is an article or main element

    def around(self, box: int) -> list[int]:
        """A container and those that hold it, the page last."""
        path = [box]
        while path[-1]:
            path.append(self.parent[path[-1]])
        return path


def _says(token: str, words: frozenset[str]) -> bool:
    """Whether a class or id token is one of the words, or a compound of one with layout words alone."""
    if token in words:
        return True
    parts = [x for x in re.split(r"[-_]+", token) if x]
    return len(parts) > 1 and any(x in words for x in parts) and all(x in _LAYOUT_WORDS or x in _EXTRA_WORDS or x in _PLACES or re.fullmatch(r"[\dx]+", x) for x in parts)


def furniture(tag: str, attributes: str, within: bool) -> str:
    """Why an element may be no part of the text: layout, extra or never; empty if it is like any other. ``within``: it stands in an article or main element."""
    why = "never" if tag in _NEVER else "layout" if tag in _LAYOUT and not (tag == "header" and within) else ""
    if tag in ("html", "body", "main") or "=" not in attributes and "hidden" not in attributes:
        return why
    if re.search(r"(?:^|\s)hidden(?=[\s/=]|$)", attributes) and not re.search(r"=\s*[\"'][^\"']*\bhidden\b", attributes):
        return "never"
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if name == "role" and value.strip() in _ROLES:
            why = why or "layout"
        if name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "never"
        if name == "class" and not re.fullmatch("h[1-6]", tag) or name == "id" and tag in _BORDER:
            if any(_says(token, _EXTRA_WORDS) for token in value.split()):
                why = why if why == "never" else "extra"
            elif any(_says(token, _LAYOUT_WORDS) for token in value.split()):
                why = why or "layout"
    return why


def read_page(page: str) -> Page:
    lines: list[Line] = []
    kinds: list[str] = []
    parent, whole = [0], [False]
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, whether it is a container, whether it is furniture
    boxes, marks = [0], []
    texts, links, gap, title = 0, 0, 0, False

    def end_block() -> None:
        nonlocal gap, title
        if parts:
            text = _SPACE.sub(" ", html_lib.unescape("".join(parts))).strip()
            if text:
                lines.append(Line(text, len(_SPACE.sub("", html_lib.unescape("".join(linked)))), boxes[-1], gap, tuple(marks), title))
                gap = 0
            parts.clear()
            linked.clear()
        title = False

    def take(text: str) -> None:
        parts.append(text)
        if links:
            linked.append(text)

    def pop(tag: str) -> None:
        nonlocal texts, links, gap
        while stack:
            top, box, mark = stack.pop()
            if top in _BLOCK or mark:
                end_block()
            texts -= top in ("article", "main")
            links -= top == "a"
            if box:
                boxes.pop()
                gap += _BORDER[top]
            if mark:
                marks.pop()
            if top == tag:
                return

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            take(page[at:])
            break
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            take(html_lib.escape(m[1], quote=False))
            continue
        if m[3] is None:
            continue
        closing, tag, attributes = m[2], m[3].lower(), m[4]
        if closing:
            if any(x[0] == tag for x in stack):
                pop(tag)
            elif tag in _BLOCK:
                end_block()
            continue
        if tag in _VOID:
            if tag == "hr":
                end_block()
            else:
                take(" " if tag == "br" else "")
            continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        open_ = [x[0] for x in stack]
        if tag == "body" and "head" in open_:
            pop("head")
        if tag in _ENDS_P and "p" in open_:
            cut = len(open_) - 1 - open_[::-1].index("p")
            if not _SCOPE & set(open_[cut + 1 :]):
                pop("p")
        if tag in _SAME:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _SAME[tag]:
                    pop(stack[k][0])
                    break
                if stack[k][0] in _SCOPE:
                    break
        why = furniture(tag, attributes, texts > 0)
        if tag in _BLOCK or why:
            end_block()
        if attributes.endswith("/") and why:
            continue
        title = tag == "h1" or title
        stack.append((tag, tag in _BORDER, bool(why)))
        if tag in _BORDER:
            gap += _BORDER[tag]
            parent.append(boxes[-1])
            whole.append(tag in ("article", "main"))
            boxes.append(len(parent) - 1)
        if why:
            marks.append(len(kinds))
            kinds.append(why)
        texts += tag in ("article", "main")
        links += tag == "a"
    end_block()
    return Page(lines, kinds, parent, whole)


def without_furniture(page: Page) -> list[Line]:
    """Lines outside furniture; a gap stands where some was taken out."""
    weight, total = [0] * len(page.kinds), 0
    for line in page.lines:
        if not any(page.kinds[m] == "never" for m in line.marks):
            total += line.weight
            for m in line.marks:
                weight[m] += line.weight
    gone = set(range(len(page.kinds)))
    if not any(page.whole[x] for box in {line.box for line in page.lines if line.text and not line.marks} for x in page.around(box)):
        gone = {m for m, kind in enumerate(page.kinds) if kind != "layout" or 2 * weight[m] <= total}
    if not any(line.weight for line in page.lines if not gone.intersection(line.marks)):
        gone = {m for m in gone if page.kinds[m] == "never" or 2 * weight[m] <= total}
    out, gap = [], 0
    for line in page.lines:
        if gone.intersection(line.marks):
            gap += line.gap + GAP
        else:
            out.append(line._replace(gap=line.gap + gap))
            gap = 0
    return out


def stretches(lines: list[Line], window: int) -> list[tuple[int, int]]:
    """(first line, last line + 1) between each surge and dive: runs of weight in which no ``window`` lines, empty ones included, sum to zero."""
    out: list[tuple[int, int]] = []
    empty = window
    for k, line in enumerate(lines):
        empty += line.gap
        if line.weight:
            if empty >= window:
                out.append((k, k + 1))
            else:
                out[-1] = (out[-1][0], k + 1)
            empty = 0
        else:
            empty += 1
    return out


def main_text(html: str | None, window: int = 3, share: float = 0.4) -> str:
    page = read_page(html or "")
    lines = without_furniture(page)
    paths: dict[int, list[int]] = {}

    def around(box: int) -> list[int]:
        return paths.get(box) or paths.setdefault(box, page.around(box))

    def common(some: list[int]) -> int:
        held = around(some[0])
        for box in set(some[1:]):
            held = [x for x in held if x in set(around(box))]
        return held[0]

    groups: dict[int, list[int]] = {}  # container -> its lines; for the page only those of stretches
    runs = stretches(lines, window)
    for a, b in runs:
        box = common([x.box for x in lines[a:b]])
        box = next((x for x in around(box) if page.whole[x]), box)
        groups.setdefault(box, []).extend(range(a, b) if not box else [])
    for box in [x for x in groups if any(y in groups for y in around(x)[1:] if y)]:
        del groups[box]  # a part of another one
    for box, own in groups.items():
        if box:
            own.extend(k for k, x in enumerate(lines) if box in around(x.box))
        else:
            own[:] = sorted({*own, *(k for k in range(own[0], own[-1] + 1) if not lines[k].box)})
    mass = {box: sum(lines[k].weight for k in own) * (2 if page.whole[box] else 1) for box, own in groups.items()}
    text = {box for box, own in groups.items() if 2 * sum(lines[k].weight for k in own) >= sum(len(lines[k].text.replace(" ", "")) for k in own)}
    heaviest = max((mass[box] for box in text), default=0)
    kept = [box for box in groups if box in text and mass[box] >= share * heaviest and mass[box]]
    if not kept:
        return ""
    if len(kept) > 1 and (held := common(kept)):
        own = {k for k, x in enumerate(lines) if held in around(x.box)}
    else:
        own = {k for box in kept for k in groups[box]}
    first = min(own)
    before = max((k for k in range(first) if lines[k].weight), default=None)
    if before is not None and lines[before].title and any(before == a for a, _ in runs) and not any(lines[k].title for k in own):
        own.add(before)
    return "\n".join(lines[k].text for k in sorted(own))


def extract_text(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, text and n_chars (its code points)."""
    fields = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            columns = [batch.column(f"k{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f"k{i}" for i in range(len(keep))), "text", "n_chars"])

    schema = ", ".join([*(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), "text string, n_chars long"])
    out = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(html_col).alias("html")).mapInArrow(run, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "text", "n_chars")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))

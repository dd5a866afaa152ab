"""Main text of web pages by line-block distribution.

1. Markup is stripped to one line per block element. Scripts, styles, menus, footers, sidebars, forms, adverts, notices and
   reader comments go by their element or class; a class that only sounds like furniture (``related``, ``share``) counts where
   most of the element's text is links.
2. A line weighs the length of its text without links, and a quarter of it outside the articles of a page that marks some.
   Weights are summed over sliding windows of lines. The text surges where a sum reaches a tenth of the page's highest, and
   dives where it falls below.
3. Of the regions between a surge and its dive, those that carry the body are kept: the heaviest, those under the same
   element, and those with lines half as long. Surge and dive points move to the ends of the article that a region lies in, or
   of the element that holds it, so that short lines at the edges stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Lines of a window, and the share of the highest sum at which text surges and dives.
WINDOW = 3
SURGE = 0.1
#: What text outside the articles of a page weighs that marks some.
OUTSIDE = 0.25

# Element and attribute names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes noembed xmp".split())
DROPPED = frozenset("nav footer aside head button select svg math canvas audio video object dialog menu".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Elements that hold blocks of text, and those that hold the whole page.
HOLDERS = frozenset("address article aside blockquote body center dd details dialog div dl fieldset figure footer form header html main nav ol section table tbody tr ul".split())
ROOTS = frozenset("html body".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words in classes and ids.
#: Adverts and cookie notices, whatever the element, and reader comments, unless a single paragraph is named so.
NEVER = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors cookie cookies consent gdpr notice".split())
COMMENTS = frozenset("comment comments commentlist disqus responses replies".split())
#: Words that stand beside those in the names of such elements. With any other a name is about something else (``ads-enabled``).
BESIDE = frozenset(
    "box block slot unit bar list section area wrap wrapper container holder inner outer top bottom left right main site page global message alert dialog prompt policy privacy settings preferences law info warning title heading label count link text body content author meta metadata date item thread reply user reader readers google inline placeholder module label leaderboard skyscraper mobile desktop".split()
)
#: What readers comment on.
OWNERS = frozenset("post article entry blog story news".split())
#: Furniture of the page, where elements hold others. What holds the page's dominant text is a frame and not furniture.
NAMED = frozenset("sidebar menu nav navbar navigation breadcrumb breadcrumbs notification banner promo footer copyright newsletter subscribe signup login popup modal overlay".split())
#: The same outside articles alone: inside one they hold its heading.
HEADER = frozenset("header masthead topbar".split())
#: Furniture where most of the text is links.
LINKED = frozenset("related share sharing social recommended recommendations toolbar pagination pager widget skip search legal disclaimer tags respond form".split())
#: Words that turn a class into a statement about the page (``has-sidebar``).
ABOUT = frozenset("has no with without is".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SOFT, FRAME, SURE = 1, 2, 3


@dataclass
class Line:
    text: str
    links: int
    element: int
    article: int
    outer: int
    inner: int
    wrapper: int


@dataclass
class Page:
    """Lines, and the elements they are in: the parent of each (0 is the page), and whether it is furniture if mostly links."""

    lines: list[Line] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [0])
    named_parent: dict[int, int] = field(default_factory=dict)
    soft: set[int] = field(default_factory=set)
    roots: set[int] = field(default_factory=lambda: {0})


def named(words: list[str], kind: frozenset[str], beside: frozenset[str]) -> bool:
    """Whether a name, as its words, is that of a ``kind``: it has such a word, and no word that stands for anything else."""
    bare = [w.rstrip("0123456789") for w in words]
    return bool(kind.intersection(bare)) and all(w in kind or w in beside or w in NAMED or w in HEADER or w in LINKED or not w or w[0].isdigit() for w in bare)


def furniture(name: str, attributes: str, inside: bool) -> int:
    """Whether an element and all in it are page furniture: ``SURE``; ``FRAME`` unless it holds the dominant text; ``SOFT`` if
    mostly links. A header inside an article may hold its heading."""
    level = SURE if name in DROPPED or (name == "header" and not inside) else FRAME if name == "form" else 0
    if level == SURE or not attributes.strip() or name in ROOTS:
        return level
    got = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attributes)}
    if "hidden" in got or got.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", got.get("style", "")) or (name not in ("article", "main") and got.get("role", "").lower() in ROLES):
        return SURE
    for token in (got.get("class", "") + " " + got.get("id", "")).lower().split():
        words = re.split(r"[-_]+", token)
        if words[0] in ABOUT:
            continue
        if named(words, NEVER, BESIDE) or (name != "p" and named(words, COMMENTS, BESIDE | OWNERS)):
            return SURE
        if name in HOLDERS and name not in ("article", "main", "blockquote"):
            if (named(words, NAMED, BESIDE) if inside else NAMED.intersection(words)) or "side-bar" in token or (not inside and HEADER.intersection(words)):
                level = max(level, FRAME)
            elif LINKED.intersection(words):
                level = max(level, SOFT)
    return level


def lines_of(html: str) -> Page:
    """One line per block, white space made one space, with where it is. Work is in proportion to the page, at any depth."""
    page = Page()
    parts: list[str] = []
    # Element, number, innermost holder, article, furniture outside it and inside it, innermost FRAME outside it.
    top = ("", 0, 0, 0, 0, 0, 0)
    stack: list[tuple[str, int, int, int, int, int, int]] = []
    opened: Counter[str] = Counter()
    linked, link_depth = 0, -1  # characters of the line inside links, and the depth at which the open link began

    def end_line() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        if text:
            _, _, holder, article, outer, inner, wrapper = stack[-1] if stack else top
            page.lines.append(Line(text, min(linked, len(text)), holder, article, outer, inner, wrapper))
        parts.clear()
        linked = 0

    def close(n: int) -> None:
        nonlocal link_depth
        for x in stack[n:]:
            opened[x[0]] -= 1
        del stack[n:]
        if link_depth > len(stack):
            link_depth = -1

    at = 0
    while at < len(html):
        m = TOKEN.match(html, at)
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if not m[0].startswith("<!--") and not re.match(r"<[!?]", m[0]):
                parts.append(m[0])
                linked += len(m[0]) if link_depth >= 0 else 0
            continue
        attributes = m[3] if m[2] else m[6]
        if m[1] or m[4]:
            if name in BLOCKS:
                end_line()
            elif name == "a":
                link_depth = -1
            if opened[name]:
                # An end tag closes its element and what was left open within; an inline one closes no block.
                i = len(stack) - 1
                while i >= 0 and stack[i][0] != name and (name in BLOCKS or stack[i][0] not in BLOCKS):
                    i -= 1
                if i >= 0 and stack[i][0] == name:
                    close(i)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in BLOCKS:
            end_line()
            while stack and stack[-1][0] in CLOSED_BY_BLOCK:
                close(len(stack) - 1)
            if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                close(len(stack) - 1)
        elif name == "br":
            parts.append(" ")
        if name not in VOID and not (attributes or "").rstrip().endswith("/"):
            _, _, holder, article, outer, inner, wrapper = stack[-1] if stack else top
            level = furniture(name, attributes or "", article > 0)
            number = 0
            if level or name in HOLDERS:
                number = len(page.parent)
                page.parent.append(holder)
                if name in ROOTS:
                    page.roots.add(number)
            if not article and name in ("article", "main"):
                article, inner = number, level
                if name == "main" and outer == FRAME:  # what holds the main part is a frame of the page
                    outer = 0
            elif level == SOFT:
                page.soft.add(number)
            elif article:
                inner = max(inner, level)
            else:
                outer = max(outer, level)
                if level == FRAME:
                    page.named_parent[number] = wrapper
                    wrapper = number
            stack.append((name, number, number or holder, article, outer, inner, wrapper))
            opened[name] += 1
            if name == "a":
                link_depth = len(stack)
    end_line()
    return page


def subtree(parent: list[int], own: Counter[int]) -> list[int]:
    """For each element the sum over it and all in it."""
    total = [own[i] for i in range(len(parent))]
    for i in range(len(parent) - 1, 0, -1):
        total[parent[i]] += total[i]
    return total


def shown(page: Page) -> list[bool]:
    """Which lines are no furniture. Frames around the dominant text are lifted: of the wrapped text in one frame, or one
    article, the longest is dominant if it is longer than all that is shown without it."""
    size, links = (Counter[int]() for _ in range(2))
    for x in page.lines:
        size[x.element] += len(x.text)
        links[x.element] += x.links
    size, links = subtree(page.parent, size), subtree(page.parent, links)
    lost = [False] * len(page.parent)
    for i in range(1, len(lost)):
        lost[i] = lost[page.parent[i]] or (i in page.soft and 2 * links[i] > size[i])
    # Outside articles a line of links is part of some menu.
    fits = [not (x.inner or lost[x.element] or (not x.article and 2 * x.links > len(x.text))) for x in page.lines]
    plain = sum(len(x.text) for x, ok in zip(page.lines, fits, strict=True) if ok and not x.outer)
    wrapped: Counter[tuple[int, int]] = Counter()
    for x, ok in zip(page.lines, fits, strict=True):
        if ok and x.outer == FRAME:
            wrapped[x.article, x.wrapper] += len(x.text)
    frames: set[int] = set()
    if wrapped:
        [((_, wrapper), most)] = wrapped.most_common(1)
        while most > plain and wrapper:
            frames.add(wrapper)
            wrapper = page.named_parent[wrapper]
    return [ok and (not x.outer or (x.outer == FRAME and x.wrapper in frames)) for x, ok in zip(page.lines, fits, strict=True)]


def regions(weights: list[float], window: int = WINDOW, surge: float = SURGE) -> list[tuple[int, int]]:
    """Runs of lines between a surge and a dive of the summed weights of ``window`` lines around each."""
    before = [0.0]
    for w in weights:
        before.append(before[-1] + w)
    half = window // 2
    sums = [before[min(len(weights), i + window - half)] - before[max(0, i - half)] for i in range(len(weights))]
    least = surge * max(sums, default=0.0)
    found, begin = [], None
    for i, s in enumerate([*sums, -1.0]):
        if s >= least > 0 and begin is None:
            begin = i
        elif s < least and begin is not None:
            found.append((begin, i))
            begin = None
    return found


def kept(page: Page, window: int = WINDOW, surge: float = SURGE) -> list[Line]:
    """The lines of the regions that carry the body, up to the ends of their articles or of the element that holds them."""
    lines, show = page.lines, shown(page)
    marked = any(ok and x.article for x, ok in zip(lines, show, strict=True))
    weights = [0.0 if not ok else (len(x.text) - x.links * (not x.article)) * (OUTSIDE if marked and not x.article else 1.0) for x, ok in zip(lines, show, strict=True)]
    found = regions(weights, window, surge)
    if not found:
        return []
    within = []
    for a, b in found:
        part = [i for i in range(a, b) if weights[i]]
        mean = sum(weights[i] for i in part) / len(part)
        # A window reaches over the edge: lines there that are short themselves belong to what is beyond it, unless they are in
        # the element of a longer one, or only the page holds them.
        holders = {lines[i].element for i in part if 2 * weights[i] >= mean} | page.roots
        core = [i for i in part if lines[i].element in holders]
        within.append([i for i in part if core[0] <= i <= core[-1]])
    sizes = [sum(weights[i] for i in part) for part in within]
    best = max(range(len(found)), key=lambda k: (sizes[k], -k))

    def holder_of(part: list[int], size: float) -> int:
        """The innermost element that holds all of it or, if only the page does, nine tenths: the rest is then what follows it."""
        held: Counter[int] = Counter()
        for i in part:
            held[lines[i].element] += weights[i]
        held_in = subtree(page.parent, held)
        for least in (size, 0.9 * size):
            element = max((i for i in range(len(held_in)) if held_in[i] >= least - 1e-6), default=0)
            if element not in page.roots:
                break
        return element

    def under(element: int) -> list[bool]:
        """Which elements are in it; in the page itself are only those that nothing else holds."""
        if element in page.roots:
            return [i in page.roots for i in range(len(page.parent))]
        out = [i == element for i in range(len(page.parent))]
        for i in range(element + 1, len(out)):
            out[i] = out[page.parent[i]]
        return out

    body = under(holder_of(within[best], sizes[best]))
    good = [k for k, part in enumerate(within) if 2 * sizes[k] * len(within[best]) >= sizes[best] * len(part) or any(body[lines[i].element] for i in part)]
    chosen = {i for k in good for i in within[k]}
    articles = {lines[i].article for i in chosen} - {0}
    if 2 * sum(weights[i] for i in within[best] if lines[i].article) > sizes[best]:
        return [x for x, ok in zip(lines, show, strict=True) if ok and x.article in articles]
    return [x for i, x in enumerate(lines) if show[i] and (i in chosen or body[x.element] or x.article in articles)]


def main_text(html: str | None) -> str:
    """The lines that carry the page's body, joined by one newline."""
    return "\n".join(x.text for x in kept(lines_of(html or "")))


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text in ``out_col`` instead of ``html_col``; other columns and all rows stay.

    Null and empty pages, and pages of furniture only, have the empty text. Character references are decoded, white space
    inside a block becomes one space. Pages of any length and depth are read whole, in time in proportion to them. Of regions
    that tie, the first is the heaviest. Repeated rows stay, each with its text; an empty table gives no rows. A column
    that is already named ``out_col`` is replaced.
    """
    keep = [c for c in pages.columns if c not in (html_col, out_col)]
    schema = pages.select(*keep).schema.add(out_col, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(batch.num_columns - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([main_text(x.as_py()) for x in html], pa.string())], [*keep, out_col])

    return pages.select(*keep, F.col(html_col)).mapInArrow(run, schema)

"""Main text of web pages by the distribution of text over lines.

A page is cut into lines: markup goes, block elements begin a new block, ``br`` and table
cells a new line in the same one. The weight of a line is the length of its text that may
belong to the article. Weights are summed over windows of ``WINDOW`` lines; where the sums
surge to ``SURGE`` text begins, where they dive below a quarter of it text ends, and the weighted lines
between both points are the main text.

Weights use what the markup says. Lines in navigation, page headers, footers, sidebars,
notices, adverts, forms, comments and hidden elements, by element, role, or words of ``class``
and ``id``, weigh nothing. If the page marks its article (``article``, else ``main``, else a
container named as content), only lines in it weigh, with all their text. Otherwise a
line weighs its text outside links, nothing if most of it is links. The surge adapts to
short pages. The heaviest span counts, with others of a quarter of its weight, and
short paragraphs between two of these; ends are trimmed to paragraphs, headings and long lines,
and reach over all paragraphs and headings that follow each other. A check by the marks
follows where there are any: weighted lines of the article that lie before the surge, between
spans or after the dive are put back in their place, since all of the article counts.

Malformed markup is read as far as possible: unclosed and crossing elements, a page that
stops inside a tag, comment or script, and references without a semicolon.

Defined results: a NULL or empty page, and one without text, has an empty text; rows with
NULL or repeated ids and URLs count each for itself; an empty table gives none; other columns
are not read. A page of any length is read in one pass, in time in proportion to its length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerline.llm.text import bound_batches, slices

WINDOW = 3
# Characters in a window from which on it is text, where the page does not mark its article.
SURGE = 86
# Other spans are kept from this part of the heaviest one's weight on.
LEAST_PART = 0.25
# A line at the end of a span that is no paragraph or heading must have that many.
LONG_LINE = 60

_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# Elements of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_BLOCKS = _PARAGRAPHS | frozenset(
    "address article aside body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form head header hgroup hr html legend li main menu nav ol optgroup option "
    "section select summary table tbody tfoot thead tr ul".split()
)
_CELLS = frozenset(("td", "th"))
_NEVER_TEXT = frozenset(
    "head script style textarea title iframe noembed noframes noscript xmp template svg canvas "
    "object audio video button select option datalist label fieldset legend output meter progress".split()
)
_ENDS_OF_SAME = {
    "li": frozenset(("ul", "ol", "menu", "dir")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)),
    "tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")),
    "option": frozenset(("select", "datalist")),
}
_BOUNDARIES = frozenset(("article", "main", "body", "td", "th"))

# Words of class and id, or roles, that say what an element is.
_APART = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "aside sidebar sidebars comment comments disqus respond reply replies discussion related "
    "recommended recommendations share sharing social cookie cookies consent gdpr notice notices "
    "notification alert alertdialog popup modal dialog overlay newsletter subscribe subscription "
    "signup login footer contentinfo complementary copyright hidden widget widgets teaser teasers "
    "paywall disclaimer".split()
)
_AROUND = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar toolbar "
    "pagination pager search searchbox form tablist".split()
)
_HEADINGS = frozenset(("header",))
_CONTENT = frozenset("article post entry story content main body text blog news".split())
_CONTENT_NAMES = frozenset(
    "content main maincontent article articlebody articlecontent post postcontent postbody entry "
    "entrycontent entrybody story storybody storycontent pagecontent bodytext articletext".split()
)
_DENIED = frozenset("has with without no not".split())

# What an element is: nothing special, around the article, apart from it, never text.
_PLAIN, _OUTSIDE, _OTHER, _UNSEEN = range(4)


@lru_cache(maxsize=4096)
def _evidence(name: str, attributes: str, hints: bool) -> tuple[int, int]:
    """(what the element is, how surely it holds the article: 3 article, 2 main, 1 by name)."""
    if name in _NEVER_TEXT:
        return _UNSEEN, 0
    kind = {"nav": _OUTSIDE, "header": _OUTSIDE, "form": _OUTSIDE, "menu": _OUTSIDE,
            "aside": _OTHER, "footer": _OTHER, "dialog": _OTHER}.get(name, _PLAIN)
    tier = {"article": 3, "main": 2}.get(name, 0)
    if not attributes or name in ("html", "body", "a"):
        return kind, tier
    values = {}
    for key, *value in _ATTRIBUTE.findall(attributes):
        values.setdefault(key.lower(), html.unescape("".join(value)))
    style = re.sub(r"\s", "", values.get("style", "").lower())
    if "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in style:
        return _OTHER, 0
    role = values.get("role", "").lower()
    if role in _APART:
        kind = _OUTSIDE if role == "banner" else _OTHER
    elif role in _AROUND:
        kind = _OUTSIDE
    if values.get("itemprop", "").lower() == "articlebody" or role == "article":
        tier = max(tier, 3)
    elif role == "main":
        tier = max(tier, 2)
    if not hints:
        return kind, tier
    for value in f"{values.get('class', '')} {values.get('id', '')}".split():
        words = [w.lower() for w in _WORD.findall(value)]
        if not words or _DENIED.intersection(words):
            continue
        if _APART.intersection(words):
            kind = max(kind, _OTHER)
        else:
            around = _AROUND.intersection(words)
            if around and not (around <= _HEADINGS and _CONTENT.intersection(words)):
                kind = max(kind, _OUTSIDE)
            elif "".join(words) in _CONTENT_NAMES and name in _BLOCKS:
                tier = max(tier, 1)
    return kind, 0 if kind == _OTHER else tier


@dataclass
class Line:
    block: int
    kind: int
    tier: int
    paragraph: bool
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    text: str = ""
    weight: int = 0


class _Reader:
    """Cuts a page into lines."""

    def __init__(self, hints: bool):
        self.hints = hints
        self.lines: list[Line] = []
        # Name, kind and tier of open elements.
        self.open: list[tuple[str, int, int]] = [("", _PLAIN, 0)]
        self.counts: Counter[str] = Counter()
        self.paragraph_at = 0
        self.block = 0
        # The line being read, for each kind of element in it.
        self.current: dict[tuple[int, int], Line] = {}

    def text(self, part: str) -> None:
        name, kind, tier = self.open[-1]
        line = self.current.get((kind, tier))
        if line is None:
            if not part.strip():
                return
            inside = name in _PARAGRAPHS or self.paragraph_at > 0
            line = self.current[kind, tier] = Line(self.block, kind, tier, inside)
            self.lines.append(line)
        line.parts.append(part)
        if self.counts["a"]:
            line.linked.append(part)

    def cut_to(self, size: int) -> None:
        for name, *_ in self.open[size:]:
            self.counts[name] -= 1
        del self.open[size:]
        if self.paragraph_at >= size:
            self.paragraph_at = 0

    def start(self, name: str, attributes: str) -> None:
        if name in _BLOCKS:
            self.block += 1
            self.current = {}
            if self.paragraph_at:
                self.cut_to(self.paragraph_at)
        elif name == "br" or name in _CELLS:
            self.current = {}
        if name in _VOID:
            return
        if name in _ENDS_OF_SAME:
            self.end_before(name, _ENDS_OF_SAME[name])
        _, kind, tier = self.open[-1]
        own, sure = _evidence(name, attributes if name in _BLOCKS or name in _CELLS or name == "span" else "", self.hints)
        if kind < _OTHER:
            if own >= _OTHER:
                kind = own
            elif sure:
                # An article in a form or an unclosed menu is the article all the same.
                kind = _PLAIN if sure >= 2 or kind == _PLAIN else kind
            elif own == _OUTSIDE and not (name == "header" and tier):
                kind = _OUTSIDE
        elif own == _UNSEEN:
            kind = _UNSEEN
        self.open.append((name, kind, max(tier, sure)))
        self.counts[name] += 1
        if name in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.paragraph_at = len(self.open) - 1

    def end_before(self, name: str, limits: frozenset[str]) -> None:
        """Ends an element of this name that a next one ends, within the nearest of ``limits``."""
        if not self.counts[name]:
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == name:
                self.cut_to(at)
                return
            if self.open[at][0] in limits:
                return

    def end(self, name: str) -> None:
        if name in _BLOCKS:
            self.block += 1
            self.current = {}
        elif name in _CELLS:
            self.current = {}
        if not self.counts[name]:
            return
        inline = name not in _BLOCKS and name not in _CELLS
        for at in range(len(self.open) - 1, 0, -1):
            found = self.open[at][0]
            if found == name:
                self.cut_to(at)
                return
            if found in _BOUNDARIES and name not in _BOUNDARIES and name != "html":
                return
            if inline and found in _BLOCKS:
                return


@lru_cache(maxsize=64)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE)


def lines_of(page: str, hints: bool = True) -> list[Line]:
    """The lines of a page that hold text, with what their elements say about them."""
    reader = _Reader(hints)
    at, size = 0, len(page)
    while at < size:
        found = _MARKUP.search(page, at)
        if found is None:
            reader.text(page[at:])
            break
        if found.start() > at:
            reader.text(page[at : found.start()])
        at = found.end()
        name = found.group(2)
        if not name:
            continue
        name = name.lower()
        if found.group(1):
            reader.end(name)
            continue
        reader.start(name, found.group(3))
        if name in _RAW:
            close = _raw_end(name).search(page, at)
            at = close.start() if close else size
    for line in reader.lines:
        line.text = " ".join(html.unescape("".join(line.parts)).split())
    return [line for line in reader.lines if line.text]


def spans(weights: list[int], surge: int) -> list[tuple[int, int]]:
    """Lines (first, last) between a surge of the window sums and the next dive."""
    dive = (surge + 3) // 4
    sums = [0, *accumulate(weights)]
    windows = [sums[min(i + WINDOW, len(weights))] - sums[i] for i in range(len(weights))]
    out: list[tuple[int, int]] = []
    start = None
    for i, window in enumerate([*windows, 0]):
        if start is None and window >= surge:
            start = i
        elif start is not None and window < dive:
            first, last = start, min(i + WINDOW - 2, len(weights) - 1)
            while not weights[first]:
                first += 1
            while not weights[last]:
                last -= 1
            if out and out[-1][1] >= first - 1:
                first, _ = out.pop()
            out.append((first, last))
            start = None
    return out


def _weigh(lines: list[Line], tier: int) -> None:
    """Weights of lines, of those of the article only if the page marks it by ``tier``."""
    for line in lines:
        size = len(line.text)
        if line.kind != _PLAIN or line.tier != tier:
            line.weight = 0
        elif tier:
            line.weight = size
        else:
            linked = len(" ".join(html.unescape("".join(line.linked)).split()))
            line.weight = size - linked if 2 * linked <= size else 0


def distributed(lines: list[Line]) -> list[int]:
    """The places of the main lines by surge and dive of their weights."""
    weights = [line.weight for line in lines]
    heaviest = max((sum(weights[i : i + WINDOW]) for i in range(len(weights))), default=0)
    if not heaviest:
        return []
    found = spans(weights, max(1, min(SURGE, (heaviest + 1) // 2)))

    def firm(line: Line) -> bool:
        return line.weight > 0 and (line.paragraph or line.weight >= LONG_LINE)

    trimmed = []
    for first, last in found:
        whole = (first, last)
        while first < last and not firm(lines[first]):
            first += 1
        while last > first and not firm(lines[last]):
            last -= 1
        first, last = (first, last) if firm(lines[first]) else whole
        # Short paragraphs and headings next to the text lie in windows before the surge.
        while first and lines[first - 1].weight and lines[first - 1].paragraph:
            first -= 1
        while last + 1 < len(lines) and lines[last + 1].weight and lines[last + 1].paragraph:
            last += 1
        if trimmed and trimmed[-1][1] >= first - 1:
            first = min(first, trimmed.pop()[0])
        trimmed.append((first, last))
    most = max(sum(weights[a : b + 1]) for a, b in trimmed)
    kept = [(a, b) for a, b in trimmed if sum(weights[a : b + 1]) >= LEAST_PART * most]
    out = []
    for n, (first, last) in enumerate(kept):
        between = range(kept[n - 1][1] + 1, first) if n else ()
        out += [i for i in between if weights[i] and lines[i].paragraph]
        out += [i for i in range(first, last + 1) if weights[i]]
    return out


def main_lines(page: str) -> list[Line]:
    for hints in (True, False):
        lines = lines_of(page, hints)
        tier = max((line.tier for line in lines if line.kind == _PLAIN), default=0)
        # If all of a marked article is apart by the names of its elements, these mislead.
        if tier or not any(line.tier for line in lines):
            break
    _weigh(lines, tier)
    found = distributed(lines)
    if tier:
        found = sorted({*found, *(i for i, line in enumerate(lines) if line.weight)})
    return [lines[i] for i in found]


def main_text(page: str | None) -> str:
    """The blocks of the main text, each in a line."""
    blocks: dict[int, list[str]] = {}
    for line in main_lines(page or ""):
        blocks.setdefault(line.block, []).append(line.text)
    return "\n".join(" ".join(parts) for parts in blocks.values())


def _extracted(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch, "html"):
            texts = [main_text(page) for page in some.column("html").to_pylist()]
            columns = [some.column(i) for i in range(some.num_columns - 1)]
            columns += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def extract(
    pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")
) -> DataFrame:
    """Columns ``keep`` of each page, the ``text`` of its main part, and that text's ``n_chars``."""
    bound_batches(pages.sparkSession)
    kinds = [f"`{name}` {pages.schema[name].dataType.simpleString()}" for name in keep]
    some = pages.select(*(pages[name] for name in keep), pages[page].alias("html"))
    run = partial(_extracted, names=[*keep, "text", "n_chars"])
    return some.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"]))

"""Main text of web pages by smoothed text-to-tag ratios over parser events."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that never hold main text.
ASIDE = frozenset("applet aside audio button canvas datalist dialog embed footer form frame head iframe map math menu nav noframes noscript object script search select style svg template textarea title video".split())
#: Words in class, id or role that mark what isn't main text.
ASIDE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies dialog discussion disqus footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe tags teaser toc toolbar topbar widget widgets".split()
)
#: Beside one of these words the others say nothing.
MAIN_WORDS = frozenset("article body content entry main post story text has no with without".split())
WHOLE = frozenset("html body main".split())
#: Elements that hold a text's blocks beside each other.
HOLDERS = frozenset("article body center div html main section td".split())
#: What a line under the threshold takes from its container, as a share of its length: outside links, and in links.
UNDER, UNDER_LINKED = 0.1, 1.0
#: A larger container below the body that gains almost as much is taken instead.
MARGIN = 0.03
#: Elements that a start tag of the same kind ends, and what else ends them.
IMPLIED = {"p": BLOCKS - {"html", "body", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option", "optgroup"}}
_BEGUN = re.compile(r"<[a-zA-Z/!?]")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Line:
    text: str
    tags: int
    aside: bool
    #: The share of the text that is in links.
    linked: float = 0.0

    @property
    def ratio(self) -> float:
        """Text outside links for each tag; none for what isn't main text anyway."""
        return 0.0 if self.aside else len(self.text) * (1 - self.linked) / max(1, self.tags)


@dataclass
class _Open:
    tag: str
    aside: bool
    #: The number of lines before it.
    start: int = 0
    landmark: bool = False


class Lines(HTMLParser):
    """Lines of a page from the parser's events, one for each run between block tags.

    Every event costs a constant number of steps for each element opened,
    however deep elements are nested and whatever is left open.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self._open = [_Open("", False)]
        #: Places of the open block elements, and for each (and the page) how many other elements of a name are open in it.
        self._blocks: list[int] = []
        self._inline: list[Counter[str]] = [Counter()]
        self._names: Counter[str] = Counter()
        #: Block elements that hold lines: the first line, the one after the last, tag.
        self.spans: list[tuple[int, int, str]] = []
        self._text: list[str] = []
        self._tags = self._linked = self._seen = self._links = 0

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.lines.append(Line(text, self._tags, self._open[-1].aside, self._linked / max(1, self._seen)))
            self._tags = 0
        self._text.clear()
        self._linked = self._seen = 0

    def _leave(self, tag: str | None) -> None:
        """Close the innermost open element of this name and all in it (all elements, if None)."""
        end = len(self.lines)
        while len(self._open) > 1:
            x = self._open.pop()
            self._links -= x.tag == "a"
            if x.tag in BLOCKS:
                self._blocks.pop()
                self._inline.pop()
                self._names[x.tag] -= 1
                if x.start < end:
                    self.spans.append((x.start, end, x.tag))
            else:
                self._inline[-1][x.tag] -= 1
            if x.tag == tag:
                return

    def _is_aside(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        top = self._open[-1]
        if tag in ASIDE or tag == "header" and not top.landmark:
            return True
        if tag in WHOLE or not attrs:
            return False
        known = dict(attrs)
        if "hidden" in known or known.get("aria-hidden") == "true" or "display:none" in (known.get("style") or "").replace(" ", "").lower():
            return True
        words = {w.lower() for k in ("class", "id", "role") for w in _WORDS.findall(known.get(k) or "")}
        if tag == "div" and "header" in words and not top.landmark and not words & MAIN_WORDS:
            return True
        return bool(words & ASIDE_WORDS) and not (words & MAIN_WORDS and not words & {"comment", "comments", "ad", "ads", "related", "sponsored"})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._flush()
            around = self._open[self._blocks[-1]].tag if self._blocks else ""
            if tag in IMPLIED.get(around, ()):
                self._leave(around)
        self._tags += 1
        if tag == "br":
            self._text.append(" ")
        if tag in VOID:
            return
        top = self._open[-1]
        self._open.append(_Open(tag, top.aside or self._is_aside(tag, attrs), len(self.lines), top.landmark or tag in ("article", "main")))
        self._links += tag == "a"
        if tag in BLOCKS:
            self._blocks.append(len(self._open) - 1)
            self._inline.append(Counter())
            self._names[tag] += 1
        else:
            self._inline[-1][tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        """An end tag closes an element of its name; one that isn't a block's, only within the block it's in."""
        if tag in BLOCKS:
            self._flush()
        self._tags += 1
        if (self._names if tag in BLOCKS else self._inline[-1])[tag] > 0:
            self._leave(tag)

    def handle_data(self, data: str) -> None:
        self._text.append(data)
        seen = len(data) - sum(map(data.count, " \n\t"))
        self._seen += seen
        self._linked += seen if self._links else 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![`` begins a comment up to the next ``>``; the standard parser fails on some of them."""
        end = self.rawdata.find(">", i)
        return end + 1 if end > 0 else -1

    def close(self) -> None:
        super().close()
        self._flush()
        self._leave(None)


def read(html: str) -> Lines:
    """The lines of a page. Behind its last ``>`` no tag is whole: a tag begun there is cut off, as browsers do."""
    parser, end = Lines(), html.rfind(">") + 1
    begun = _BEGUN.search(html, end)
    parser.feed(html[:end])
    parser.feed(html[end : begun.start()] if begun else html[end:])
    parser.close()
    return parser


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing over three deviations to either side; the ends repeat."""
    reach = max(1, int(3 * sigma))
    bell = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), bell / bell.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """Between the two clusters (two means, of logarithms) of the smoothed ratios."""
    logs = np.log1p(values)
    low, high = logs.min(), logs.max()
    for _ in range(32):
        near = logs <= (low + high) / 2
        if near.all() or not near.any():
            break
        new = logs[near].mean(), logs[~near].mean()
        if new == (low, high):
            break
        low, high = new
    return float(np.expm1((low + high) / 2))


def _landmarks(parser: Lines, over: np.ndarray) -> list[tuple[int, int]]:
    """The page's articles and main parts, none inside another: for each the first line, and the one after the last.

    Where one has most of its text in lines ``over`` the threshold, those with less than that and most of it in links are none.
    """
    lines, found = parser.lines, []
    for a, z, tag in sorted(parser.spans, key=lambda x: (x[0], -x[1])):
        if tag in ("article", "main") and not (found and z <= found[-1][1]) and any(not line.aside for line in lines[a:z]):
            found.append((a, z))

    def half(a: int, z: int, share) -> bool:
        own = [(len(lines[i].text), share(i)) for i in range(a, z) if not lines[i].aside]
        return sum(n * x for n, x in own) >= sum(n for n, _ in own) / 2

    upper = [half(a, z, lambda i: over[i]) for a, z in found]
    return [x for x, high in zip(found, upper, strict=True) if high or not any(upper) or not half(*x, lambda i: lines[i].linked)]


def _scope(parser: Lines, over: np.ndarray) -> list[tuple[int, int]]:
    """The runs of lines that are the content, by the lines ``over`` the threshold: for each the first, and the one after the last."""
    if marked := _landmarks(parser, over):
        return marked
    lines = parser.lines
    own = np.array([not line.aside for line in lines])
    length = np.array([len(line.text) for line in lines]) * own
    linked = np.array([line.linked for line in lines])
    gains = np.where(over, length, -length * (UNDER + (UNDER_LINKED - UNDER) * linked))
    counts, sums = (np.concatenate([[0], np.cumsum(x)]) for x in (own, gains))
    holding = [(a, z, tag) for a, z, tag in [*parser.spans, (0, len(lines), "html")] if counts[z] > counts[a]]
    gain = lambda x: sums[x[1]] - sums[x[0]]
    best = max((x for x in holding if x[2] in HOLDERS), key=lambda x: (gain(x), x[1] - x[0]))
    near = [x for x in holding if x[2] in HOLDERS - {"html", "body"} and x[0] <= best[0] and best[1] <= x[1] and gain(x) >= (1 - MARGIN) * gain(best)]
    start, end, _ = max([best, *near], key=lambda x: x[1] - x[0])
    # With the page's heading.
    heads = [x for x in holding if x[2] == "h1"]
    return [(min([start, *(a for a, _, _ in heads)]), max([end, *(z for _, z, _ in heads)]))]


def main_text(html: str | None, sigma: float = 1.5) -> str:
    """The main text of a page: blocks in page order, joined by a space.

    Parser events give lines, one for each run of text between block tags.
    Those in menus, headers, footers, sidebars, forms, adverts, notices,
    comments and the like, told by element, class, id and role, are never
    kept and have ratio 0; that is all such lists decide. Each line has its
    ratio of text (outside links) to tags; the ratios of the page are smoothed
    and parted in two clusters. Where a page has articles or a main part with
    text, they are the content, and nothing outside them; of several, those
    that are lists of links are left out if another is in the upper
    cluster. On other pages a container gains the length of each of its
    lines in the upper cluster and loses for those in the lower one, links most;
    the container that gains most is the content, or the largest one around it
    below the body that gains almost as much, with first-level headings. All
    lines of a run are kept, short ones as well.
    """
    lines = (parser := read(html or "")).lines
    if all(line.aside for line in lines):
        return ""
    ratios = smooth(np.array([line.ratio for line in lines]), sigma)
    runs = _scope(parser, ratios >= threshold(ratios))
    return " ".join(line.text for start, end in runs for line in lines[start:end] if not line.aside)


def extract_main_text(df: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``df`` with the main text of each page and its length n_chars (code points).

    Pages are treated one by one where they lie: nothing is shuffled.

    Defined cases: null and empty pages and pages without main text give an
    empty text; broken and cut pages are read as far as they go; white space
    in a block is one space; repeated rows and empty tables need no care;
    columns named like those added are replaced.
    """
    kept = [c for c in df.columns if c not in (text_col, "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(batch.num_columns - 1)
            for start in range(0, batch.num_rows, 256):
                texts = [main_text(page.as_py()) for page in pages.slice(start, 256)]
                columns = [batch.column(i).slice(start, 256) for i in range(batch.num_columns - 1)]
                columns += [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*(f"c_{i}" for i in range(len(kept))), "__text", "__n_chars"])

    chosen = df.select(*(F.col(c).alias(f"c_{i}") for i, c in enumerate(kept)), F.col(html_col).alias("__html"))
    out = chosen.mapInArrow(run, T.StructType([*chosen.schema.fields[:-1], T.StructField("__text", T.StringType()), T.StructField("__n_chars", T.LongType())]))
    return out.select(*(F.col(f"c_{i}").alias(c) for i, c in enumerate(kept)), F.col("__text").alias(text_col), F.col("__n_chars").alias("n_chars"))

"""Main text of web pages by text-to-tag ratio.

A page runs through the standard library's streaming parser. Events are gathered into
lines: one line per block of text, with the number of its characters and of the tags
met since the line before. Elements that are never content (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, comments of readers) give no text.
Each line's ratio is its characters over its tags; the ratios are smoothed along the
page with a Gaussian, and two-means clustering of the smoothed ratios gives the
threshold between content and clutter. The decision is made per region, the outermost
sectioning element around a line: a region's smoothed ratio, weighted by text, has to
reach the threshold, and all lines of a chosen region are kept, however short. Where a
page marks an article or a main part, only regions inside it compete.

Wrappers hide nothing: a form that holds most of the text that is not hidden otherwise, and
elements hidden for a word of their class, id or role, or as forms, around a main part or
around articles with at least as much text as the page shows without them. Elements named
for clutter alone, or for comments or related pages, wrap articles only where the page
shows nothing else. A page with wrappers is parsed a second time.

Every line of a chosen region becomes one block; its white space is one space, and
blocks are joined by a line break.

Defined cases: null, empty or blank html gives an empty text; markup that never closes
ends with the page; a page with one region keeps it; repeated rows give repeated
results; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from rowscribe.llm.batches import in_small_batches
from rowscribe.llm.registry import query, read

# Names of elements, and words in class, id and role that mark clutter.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset(
    "head title nav header footer aside form script style noscript template svg canvas iframe object menu dialog "
    "button select option textarea label fieldset".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SECTIONS = frozenset("article main section div td body".split())
CLUTTER = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|"
    r"complementary|consent|contentinfo|cookie|cookies|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|"
    r"newsletter|notice|notices|pagination|popup|promo|promoted|related|replies|search|share|sharing|sidebar|social|"
    r"sponsor|sponsored|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
NAMED = re.compile(CLUTTER.pattern.replace(r"(?:^|[\s_-])", r"(?:^|\s)", 1).replace(r"(?:$|[\s_-])", r"(?:$|\s)"), re.I)
ASIDE = re.compile(r"(?:^|\s)(?:comment|disqus|repl(?:y|ies)|related)", re.I)
OWN = frozenset(("article", "main", "body", "html"))  # judged by their name, not by their class
CLOSES_P = BLOCKS - {"body", "html"}

SIGMA = 1.5  # lines
REACH = 4


class _Lines(HTMLParser):
    """Lines of a page: (text, tags, region, inside an article)."""

    def __init__(self, wrappers: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.wrappers = wrappers  # elements that hide nothing, by number
        self.met = 0
        self.shown = 0  # characters
        self.soft: list[tuple[int, bool, bool, int]] = []  # open elements that may be wrappers: number, form, named for clutter, place
        self.around: list[tuple[int, tuple]] = []  # where an open article began: open elements, wrappers
        self.wrapped: dict[tuple, list[int]] = {}  # of wrappers: characters of articles, main parts
        self.in_forms: dict[int, int] = {}
        self.lines: list[tuple[str, int, int, bool]] = []
        self.open: list[tuple[str, bool]] = []  # name, hides its text
        self.hidden = 0
        self.articles = 0
        self.regions = [0]  # of the open sectioning elements
        self.seen = 0
        self.parts: list[str] = []
        self.tags = 0

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            region = self.regions[1] if len(self.regions) > 1 else 0
            self.lines.append((text, max(1, self.tags), region, self.articles > 0))
            self.tags = 0

    def _close(self, to: int) -> None:
        """Close the open elements from position ``to`` on."""
        while len(self.open) > to:
            name, hides = self.open.pop()
            self.hidden -= hides
            if self.around and self.around[-1][0] == len(self.open):
                self.around.pop()
            if self.soft and self.soft[-1][3] == len(self.open):
                self.soft.pop()
            if name in ("article", "main"):
                self.articles -= 1
            if name in SECTIONS and name != "body":
                self.regions.pop()

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in CLOSES_P and self.open and any(n == "p" for n, _ in self.open):
            self._close(next(i for i, (n, _) in enumerate(self.open) if n == "p"))
        if tag in ("article", "main", "body") and self.hidden:  # clutter that was never closed ends here
            for i, (name, hides) in enumerate(self.open):
                if hides and name in ("head", "nav", "header", "title") or hides and tag == "body":
                    self._close(i)
                    break
        self.met += 1
        marked = tag not in OWN and self._marked(attrs)
        hides = tag in SKIPPED or marked or tag in OWN and self._reader(tag, attrs)
        if self.met in self.wrappers:
            hides = False
        elif tag == "form" or marked and tag not in SKIPPED and not self._unseen(attrs):
            named = any(k in ("class", "id", "role") and v and (NAMED.search(v) or ASIDE.search(v)) for k, v in attrs)
            self.soft.append((self.met, tag == "form", named, len(self.open)))
        elif tag in ("article", "main") and not hides and self.hidden and self.hidden == len(self.soft):
            around = tuple(x[:3] for x in self.soft)
            self.around.append((len(self.open), around))
            self.wrapped.setdefault(around, [0, 0])[1] += tag == "main"
        self.open.append((tag, hides))
        self.hidden += hides
        if tag in ("article", "main"):
            self.articles += 1
        if tag in SECTIONS and tag != "body":
            self.seen += 1
            self.regions.append(self.seen)

    @staticmethod
    def _unseen(attrs) -> bool:
        return any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)

    @classmethod
    def _marked(cls, attrs) -> bool:
        return any(k in ("class", "id", "role") and v and CLUTTER.search(v) for k, v in attrs) or cls._unseen(attrs)

    @staticmethod
    def _reader(tag, attrs) -> bool:
        """Whether an article element is a reader's comment."""
        return tag == "article" and any(k in ("class", "id") and v and "comment" in v.lower() for k, v in attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._close(i)
                break

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            self.shown += len(data.strip())
        elif self.hidden == len(self.soft):  # hidden by what may be wrappers only
            if self.around and len(self.around[-1][1]) == self.hidden:
                self.wrapped[self.around[-1][1]][0] += len(data.strip())
            if self.hidden == 1 and self.soft[0][1]:
                self.in_forms[self.soft[0][0]] = self.in_forms.get(self.soft[0][0], 0) + len(data.strip())

    def finish(self) -> list[tuple[str, int, int, bool]]:
        self.close()
        self._end_line()
        return self.lines


    def found_wrappers(self) -> frozenset[int]:
        """The elements that hide their text but are wrappers of the page or its article."""
        out = set()
        if self.wrapped:
            around = max(self.wrapped, key=lambda a: (self.wrapped[a][1] > 0, not any(x[2] for x in a), self.wrapped[a][0]))
            size, mains = self.wrapped[around]
            if size and (mains or size >= self.shown and not any(named for _, _, named in around) or not self.shown):
                out = {number for number, _, _ in around}
        for form, size in self.in_forms.items():
            if 2 * size > self.shown + sum(self.in_forms.values()):
                out.add(form)
        return frozenset(out)


KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-REACH, REACH + 1)]


def smooth(ratios: list[float]) -> list[float]:
    """Gaussian mean along the lines; at the ends the kernel is cut and rescaled."""
    out = []
    for i in range(len(ratios)):
        low, high = max(0, i - REACH), min(len(ratios), i + REACH + 1)
        weights = KERNEL[low - i + REACH : high - i + REACH]
        out.append(sum(w * r for w, r in zip(weights, ratios[low:high])) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """The border between two clusters of numbers, halfway between their means."""
    low, high = min(values), max(values)
    border = (low + high) / 2
    for _ in range(50):
        below = [v for v in values if v < border]
        above = [v for v in values if v >= border]
        if not below or not above:
            return border
        new = (sum(below) / len(below) + sum(above) / len(above)) / 2
        if new == border:
            break
        border = new
    return border


def main_text(html: str | None) -> str:
    """The content of one page."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    lines = parser.finish()
    wrappers = parser.found_wrappers()
    if wrappers:
        parser = _Lines(wrappers)
        parser.feed(html)
        lines = parser.finish()
    if any(inside for *_, inside in lines):
        lines = [line for line in lines if line[3]]
    if not lines:
        return ""
    smoothed = smooth([len(text) / tags for text, tags, _, _ in lines])
    border = threshold(smoothed)
    regions: dict[int, list[float]] = {}
    for (text, _, region, _), ratio in zip(lines, smoothed):
        total = regions.setdefault(region, [0.0, 0.0])
        total[0] += len(text) * ratio
        total[1] += len(text)
    means = {r: a / b for r, (a, b) in regions.items()}
    chosen = {r for r, m in means.items() if m >= border} or {max(means, key=lambda r: (means[r], -r))}
    return "\n".join(text for text, _, region, _ in lines if region in chosen)


def extract(pages: DataFrame, html: str, into: str = "text") -> DataFrame:
    """The columns of ``pages`` without ``html``, and the main text."""
    schema = StructType([f for f in pages.schema.fields if f.name not in (html, into)]).add(into, StringType())
    kept = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(v.as_py()) for v in batch.column(html)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), texts], [*kept, into])

    return in_small_batches(pages).mapInArrow(run, schema)


@query("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"), "html")
    return texts.withColumn("n_chars", F.char_length("text").cast("bigint"))

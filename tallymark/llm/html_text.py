"""Main text of web pages by line-block distribution.

Markup is stripped to lines: a block element begins a line, an element that sets a part of the page apart leaves a gap
of empty lines around it, and what can't be article text (scripts, menus, forms, notices, comments, ...) leaves a gap
only. The lengths of the lines are summed over a sliding window. A surge is where the sum rises from nothing, a dive
where it falls back to nothing; the text between a surge and its dive is kept if its sum gets high enough between them,
or if it lies in the same container as text that is kept. Where the page names its article, only lines in it have a length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.shared import whole_text

#: Lines in a window, and the characters its sum must reach between a surge and its dive.
WINDOW, HEIGHT = 3, 80

# Elements by what they do to lines.
RAW = "script style noscript template svg math iframe object canvas textarea select title".split()
APART = "nav header footer aside form menu dialog button fieldset".split()
PARTS = "article main section div body html table blockquote figure details".split()
BLOCKS = (
    "p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr td th thead tbody tfoot caption pre hr br address figcaption summary option label legend hgroup center"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: A class, id or role that marks a part as no article text: one of these names, alone or with words that such names go with. Words
#: that speak of a page (no-sidebar, comments-open) or of a topic (category-social) are none of them.
_NAME = (
    "ads? adverts? advertisements? advertising banners? sponsor(?:ed)? promos? cookies? consent gdpr notices? alerts? popups? modal overlay"
    " nav navbar navigation menus? breadcrumbs? sidebars? footers? toolbar share sharing social related recommended newsletter subscribe"
    " comments? disqus replies respond login search pagination pager complementary contentinfo skip"
    " (?:more|other|latest|popular|trending)[_-](?:stories|articles|news|posts|reading)"
).replace(" ", "|")
_BEFORE = "site|page|main|top|bottom|left|right|global|primary|secondary|mobile|desktop|post|entry|article|google|user|web|readers?|visitors?|blog|inline|sticky"
_AFTER = (
    "areas?|bars?|blocks?|box(?:es)?|buttons?|containers?|content|forms?|icons?|inner|items?|links?|lists?|media|messages?|module|panel|articles?|posts?"
    "|sections?|signup|slots?|stories|thread|units?|widgets?|wrap|wrapper|primary|secondary|main|left|right|top|bottom|mobile|desktop"
)
MARKS = re.compile(rf"(?:(?:{_BEFORE})[_-])*(?:{_NAME})(?:[_-](?:{_NAME}|{_AFTER}))*(?:[_-]?\d+(?:x\d+)?)?", re.I)
#: The same for the top of a site; a header in an article is its own.
TOPS = re.compile(r"(?:(?:site|global|main|top)[_-])?(?:header|masthead)(?:[_-](?:inner|wrap|wrapper|container))?", re.I)
#: What an opening element ends that may go without an end tag, if no list, table or part lies between.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"},
    **dict.fromkeys(("thead", "tbody", "tfoot"), {"caption", "thead", "tbody", "tfoot", "tr", "td", "th"}),
}
SCOPES = {*PARTS, "ul", "ol", "dl", "menu"}
TRACKED = {*PARTS, *APART, *BLOCKS} - set(VOID)
HEADLINES = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Blocks that may stand in a paragraph; all others end it.
INLINE = {"button", "label", "option"}
_RAW = "|".join(RAW)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<(?P<raw>{_RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|$)|<(?P<close>/)?(?P<name>[a-zA-Z][\w:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z!?/][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")


def lines(page: str) -> tuple[list[str], list[bool], bool, list[int], list[int], set[int]]:
    """Lines of a page, empty ones where it has a gap; whether each is in a named article; whether there is any; the
    container of each, the container around each container (the page itself is 0); the lines with a headline."""
    out: list[str] = []
    inside: list[bool] = []
    homes: list[int] = []
    around = [0]
    headlines: set[int] = set()
    within: list[int] = []  # the innermost container at each open element
    text: list[str] = []
    depth = 0  # of articles
    open_: list[str] = []  # elements by which parts end
    count: Counter[str] = Counter()
    skip = 0  # how many elements are open with the one that is left out, which is the last of them
    seen, named, at = False, False, 0

    def end(n: int) -> None:
        nonlocal skip
        count.subtract(open_[n:])
        del open_[n:], within[n:]
        if n < skip:
            skip = 0

    def end_implied(name: str) -> None:
        if open_ and open_[-1] == "p" and name in TRACKED and name not in INLINE:
            end(len(open_) - 1)
        ended = ENDS.get(name)
        if not ended or not any(count[x] for x in ended):
            return
        k = last = len(open_)
        while k and open_[k - 1] not in SCOPES:
            k -= 1
            if open_[k] in ended:
                last = k
            elif last < len(open_):
                break
        end(last)

    def end_line(gap: bool = False) -> None:
        line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        text.clear()
        if line:
            if open_ and open_[-1] in HEADLINES:
                headlines.add(len(out))
            out.append(line)
            inside.append(depth > 0)
            homes.append(within[-1] if within else 0)
        if gap and (not out or out[-1]):
            out.extend([""] * WINDOW)
            inside.extend([False] * WINDOW)
            homes.extend([0] * WINDOW)

    def begin(name: str) -> None:
        home = within[-1] if within else 0
        if name in PARTS and name not in ("html", "body"):
            around.append(home)
            home = len(around) - 1
        open_.append(name)
        within.append(home)
        count[name] += 1

    for m in _TOKEN.finditer(page):
        if not skip:
            text.append(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        opens = not m["close"]
        if not skip and name in TRACKED:
            end_line()  # before the tag changes where it lies
        article = name in ("article", "main")
        empty = name in VOID or m["rest"].rstrip().endswith("/")
        if opens:
            end_implied(name)
        elif count[name]:
            was = skip
            k = len(open_) - 1
            while open_[k] != name:
                k -= 1
            end(k)
            if was and not skip and k == was - 1:
                continue  # the end of the part itself
        if skip:
            # a part that is left out does not hold the article; an unclosed menu ends where it begins. Once an article was named, those in such parts are others
            if not (article and opens and (name == "main" or not named)):
                if opens and not empty and (name in TRACKED or name == open_[skip - 1]):
                    begin(name)
                continue
            skip = 0
        # an article in an article is a comment on it
        nested = name == "article" and count["article"] > 0
        apart = name in APART and not (name == "header" and depth) or _marked(name, m["rest"], depth > 0)
        leaves = opens and not empty and (nested or not article and apart)
        if leaves:
            # inside the article its own parts are lines of it
            end_line(gap=not depth)
        if opens and not empty and (leaves or name in TRACKED):
            begin(name)
        if leaves:
            skip = len(open_)
        elif article and not empty:
            end_line(gap=not depth)
            depth = depth + 1 if opens else max(0, depth - 1)
            seen, named = seen or opens, named or opens and name == "article"
            if not depth:
                end_line(gap=True)
        elif name in PARTS:
            end_line(gap=not depth)
        elif name == "br" or name == "hr":
            end_line()
    if not skip:
        text.append(page[at:])
    end_line()
    return out, inside, seen, homes, around, headlines


def _marked(name: str, attributes: str, inside: bool) -> bool:
    """Whether the names of an element say that it is no article text."""
    if not attributes or name in ("html", "body") or name == "header" and inside:
        return False
    words = [w for a, b, c in _NAMED.findall(attributes) for w in (a or b or c).split()]
    return any(MARKS.fullmatch(w) or not inside and TOPS.fullmatch(w) for w in words)


def between(lengths: np.ndarray, window: int = WINDOW, height: int = HEIGHT) -> list[tuple[int, int]]:
    """Line ranges from a surge to its dive that are high enough; the highest one if none is."""
    if not lengths.any():
        return []
    sums = np.convolve(lengths, np.ones(window, np.int64))  # sums[i]: of the lines i - window + 1 to i
    high = np.concatenate([[0], (sums > 0).astype(np.int8), [0]])
    surges, dives = np.flatnonzero(np.diff(high) == 1), np.flatnonzero(np.diff(high) == -1)
    # a sum reaches window - 1 lines beyond the last line that has a length
    ranges = [(int(a), int(b) - window + 1) for a, b in zip(surges, dives, strict=True)]
    tops = [int(sums[a : b + window - 1].max()) for a, b in ranges]
    return [r for r, top in zip(ranges, tops, strict=True) if top >= min(height, max(tops))]


def joined(ranges: list[tuple[int, int]], every: list[tuple[int, int]], homes: list[int], around: list[int], headlines: set[int]) -> list[tuple[int, int]]:
    """Add the low ranges of the same text to the kept ones: a part boundary or something left out set them apart.

    A low range belongs to kept text if its container holds some or lies in the container of some, if both containers
    stand side by side in one that is not the page itself, if kept text stands on both sides of it in the container
    around it, or if it is a headline right before kept text."""
    kept = {r for r in ranges}
    own = [False] * len(around)
    for a, b in ranges:
        for x in homes[a:b]:
            own[x] = True
    holds, under = list(own), list(own)
    for k in range(len(around) - 1, 0, -1):  # a container is numbered after the one around it
        holds[around[k]] = holds[around[k]] or holds[k]
    for k in range(1, len(around)):
        under[k] = under[k] or under[around[k]]
    last = max((k for k, r in enumerate(every) if r in kept), default=-1)
    first = min((k for k, r in enumerate(every) if r in kept), default=0)
    out = []
    follows = False  # whether the next range is kept
    for k in range(len(every) - 1, -1, -1):
        a, b = every[k]
        follows = (a, b) in kept or any(
            holds[x] or under[x] or holds[around[x]] and (around[x] > 0 or first < k < last) for x in set(homes[a:b])
        ) or follows and any(n in headlines for n in range(a, b))
        if follows:
            out.append((a, b))
    return out[::-1]


def main_text(page: str) -> str:
    found, inside, named, homes, around, headlines = lines(page)
    lengths = np.array([len(x) if not named or i else 0 for x, i in zip(found, inside, strict=True)], np.int64)
    # a named article is kept whole, however little it holds
    ranges = between(lengths, height=0 if named else HEIGHT)
    if not named:
        ranges = joined(ranges, between(lengths, height=0), homes, around, headlines)
    return " ".join(x for a, b in ranges for x, n in zip(found[a:b], lengths[a:b], strict=True) if n)


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text (empty if none). Null markup counts as empty; only the three
    named columns are read, and each page is worked on alone, so repeated rows and equal ids give equal rows."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]
    df = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), whole_text(markup).alias("html"))
    return df.mapInArrow(extract, f"page_id {kinds[0]}, url {kinds[1]}, text string")

"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its path of block tags from the root. Text length and
punctuation are summed per path and divided by the path's number of blocks; the two ratios are smoothed
over the blocks around (weighted by how much of the path they share), fused to one score, and paths over
a share of the best score are content. A page's mark of its article is a weight: scores of paths outside it
are multiplied by `UNMARKED`, and the same threshold holds for all paths.

A content path vouches for its container, the element around its paragraphs, lists and tables. All
paragraphs, headings, captions, list items, terms and table cells of such a container go with it, short and
linked ones too; lists and tables that are mostly links do not, nor does a container that is.

Parts that are not the article by their own account are left out first: navigation, forms, scripts, side
boxes and the like by tag, and elements of which a class, id or role names such a part (a name all of whose
words do, or go with them, as in `share-buttons`; not `share-of-market`). A name leaves out no element that
holds a heading of the first rank or, without a marked article elsewhere, over half of the page's text; names
that are one such word, or mean readers' comments, yield only to the page's first such heading. If nothing is
left, no name counts. Elements inside a sentence do not end it, whether their text counts or not. A last
block of its own that begins as a copyright line is a footer.

Pages are independent, so this is one pass without a shuffle. Defined results: null html is the empty
page, with empty text; markup that breaks off is read as far as it goes; null keys and repeated rows
are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortfall.llm.common import by_value, slices

by_value(__name__)

SHARE = 0.15
NEIGHBOURS = 2
LINKED = 0.5
UNMARKED = 0.5
# Tags of HTML by what they do here.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr input "
    "math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd semantics".split()
)
# Without text of the page, and no end to the sentence around them.
MUTED = frozenset(
    "script style noscript template button select textarea iframe object svg canvas audio video map annotation annotation-xml".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head title nav footer aside form option dialog menu".split())
# Tags that hold the text of their container, and what they hang in: a path ends in them below its container.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li ul ol dt dd dl figure figcaption caption details summary address center".split())
CELLS = frozenset("td th tr tbody thead tfoot table".split())
ITEMS = frozenset("li dt dd td th".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Words of class, id and role that name what is not the article, and words that go with them.
ASIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|popup|modal|"
    r"overlay|newsletter|subscribe|subscription|signup|login|sidebar|side-bar|aside|widget\w*|nav\w*|menu\w*|breadcrumbs?|"
    r"topbar|toolbar|masthead|header|footer|footnav|copyright|share|sharing|social|related|recommend\w*|comments?|"
    r"commentlist|disqus|respond|reply|replies|discussion|pagination|pager|search|skip|contentinfo|complementary|"
    r"navigation|form|latest|teasers?|popular|trending|readers?)(?:$|[\s_-])",
    re.I,
)
COMPANIONS = frozenset(
    "box block container wrapper wrap area section bar panel list item items content inner outer top bottom left right "
    "site page global text link links button buttons icon icons row col column module region zone slot unit group media "
    "posts articles stories news topics tags talk letters voices opinions post primary secondary mobile desktop fixed "
    "small large new main first last".split()
)
COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
# Of these, words for what readers write; and compounds that say what an element has or allows, not what it is.
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|respond|reply|replies|discussion|readers?)(?:$|[\s_-])", re.I)
MODIFIER = re.compile(
    r"(?<!\S)(?:\S+[_-])?(?:has|with|no|without)[_-]\S+|(?<!\S)\S+[_-](?:enabled|disabled|open|closed)(?!\S)", re.I
)
WHOLE = re.compile(ASIDE.pattern.replace(r"[\s_-]", r"\s"), re.I)
HEADER = re.compile(r"(?<![^\s_-])header(?![^\s_-])", re.I)
MARKED = re.compile(r"^(?:article|main)$")


def is_aside(name: str) -> bool:
    """Whether a name says what is not the article: a word of ASIDE, and all others such words or companions."""
    words = [w for w in re.split(r"[_-]+", name) if w]
    aside = [ASIDE.fullmatch(w) is not None for w in words]
    known = all(a or w.lower() in COMPANIONS or w.isdigit() for a, w in zip(aside, words, strict=True))
    return ASIDE.fullmatch(name) is not None or (any(aside) and known)


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int
    marked: bool
    asides: tuple[int, ...] = ()


@dataclass
class Aside:
    """An element whose class, id or role has a word of what is not the article."""

    plain: bool  # the word is the whole name, or means what readers write
    chars: int = 0
    marked: int = 0  # characters inside marked articles
    heading: int = 0  # number of its first h1 on the page


class Blocks(HTMLParser):
    """Reads a page into blocks outside the dropped parts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # label, dropped, inside a marked article, asides
        self.asides: list[Aside] = []
        self.headings = 0
        self.tags: list[str] = []
        self.found: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.links = 0
        self.hidden = 0
        self.muted: list[str] = []  # open elements without text, inside a sentence

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            path = tuple(x[0] for x in self.stack)
            marked, asides = self.stack[-1][2:] if self.stack else (False, ())
            self.found.append(Block(path, text, self.linked, marked, asides))
            for i in asides:
                self.asides[i].chars += len(text)
                self.asides[i].marked += len(text) * marked
        self.parts, self.linked = [], 0

    def pop(self, count: int) -> None:
        for _ in range(count):
            self.tags.pop()
            self.hidden -= self.stack.pop()[1]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in MUTED or (self.muted and tag not in ENDS_PARAGRAPH):
            if tag in MUTED:
                self.muted.append(tag)
            return
        if self.muted and self.muted[0] != "button":  # what follows in a template or a picture
            return
        self.muted.clear()  # a button does not hold blocks
        if tag in INLINE:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "a":
                self.links += 1
            return
        self.flush()
        self.links = 0
        if tag in ENDS_PARAGRAPH and "p" in self.tags:
            self.pop(self.tags[::-1].index("p") + 1)
        for depth, open_tag in enumerate(reversed(self.tags)):
            if open_tag in CLOSES.get(tag, ()):
                self.pop(depth + 1)
            elif open_tag in HOLDS.get(tag, ()) or tag not in CLOSES:
                break
        if tag in VOID:
            return
        given = {name: value or "" for name, value in attrs}
        names = " ".join((given.get("class", ""), given.get("id", ""), given.get("role", "")))
        inside = bool(self.stack) and self.stack[-1][2]
        is_marked = bool(MARKED.match(tag)) or given.get("role") == "main"
        dropped = (
            tag in DROPPED
            or (tag == "header" and not inside)
            or "hidden" in given
            or given.get("aria-hidden") == "true"
            or (MARKED.match(tag) is not None and re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", names, re.I) is not None)
        )
        label = f"{tag}.{'.'.join(sorted(given.get('class', '').split()))}".rstrip(".")
        asides = self.stack[-1][3] if self.stack else ()
        named = MODIFIER.sub(" ", names)
        if inside:  # an article's own header
            named = HEADER.sub(" ", named)
        found = [x for x in named.split() if is_aside(x)]
        if tag not in ("html", "body") and not MARKED.match(tag) and found:
            asides = (*asides, len(self.asides))
            whole = any(WHOLE.match(x) for x in found)
            self.asides.append(Aside(whole or any(READERS.search(x) for x in found)))
        self.tags.append(tag)
        self.stack.append((label, dropped, inside or is_marked, asides))
        self.hidden += dropped
        if tag == "h1" and not self.hidden:
            self.headings += 1
            for i in asides:
                self.asides[i].heading = self.asides[i].heading or self.headings

    def handle_endtag(self, tag: str) -> None:
        if tag in self.muted:
            del self.muted[len(self.muted) - 1 - self.muted[::-1].index(tag) :]
            return
        if self.muted and tag not in self.tags:
            return
        self.muted.clear()
        if tag in INLINE:
            if tag == "a" and self.links:
                self.links -= 1
            return
        self.flush()
        self.links = 0
        if tag in self.tags:
            self.pop(self.tags[::-1].index(tag) + 1)

    def handle_data(self, data: str) -> None:
        if not self.hidden and not self.muted:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str) -> list[Block]:
    reader = Blocks()
    reader.feed(html)
    reader.close()
    reader.flush()
    return shown(reader.found, reader.asides)


def shown(found: list[Block], asides: list[Aside]) -> list[Block]:
    """The blocks outside what words leave out."""
    total, marked = sum(len(b.text) for b in found), sum(len(b.text) for b in found if b.marked)
    hidden = set()
    for i, aside in enumerate(asides):
        most = 2 * aside.chars > total and aside.marked == marked
        if aside.heading != 1 if aside.plain else not aside.heading and not most:
            hidden.add(i)
    return [b for b in found if hidden.isdisjoint(b.asides)] or found


def shared(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Share of the longer path that two paths have in common from the root."""
    if a == b:
        return 1.0
    same = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        same += 1
    return same / max(len(a), len(b))


def path_scores(found: list[Block]) -> dict[tuple[str, ...], float]:
    """Fused, smoothed ratio of each path."""
    chars: dict[tuple[str, ...], int] = defaultdict(int)
    marks: dict[tuple[str, ...], int] = defaultdict(int)
    count: dict[tuple[str, ...], int] = defaultdict(int)
    linked: dict[tuple[str, ...], int] = defaultdict(int)
    for block in found:
        chars[block.path] += len(block.text)
        marks[block.path] += len(re.findall(r"[.,;:!?。，]", block.text))
        count[block.path] += 1
        linked[block.path] += block.linked
    text_ratio = {p: (chars[p] - min(linked[p], chars[p])) / count[p] for p in chars}
    mark_ratio = {p: marks[p] / count[p] for p in chars}
    smooth: dict[tuple[str, ...], list[float]] = {p: [0.0, 0.0, 0.0] for p in chars}
    for i, block in enumerate(found):
        for other in found[max(0, i - NEIGHBOURS) : i + NEIGHBOURS + 1]:
            weight = shared(block.path, other.path) ** 2
            total = smooth[block.path]
            total[0] += weight
            total[1] += weight * text_ratio[other.path]
            total[2] += weight * mark_ratio[other.path]
    fused = {}
    for p, (weight, text, mark) in smooth.items():
        own = 0.5 * (text_ratio[p] + text / weight), 0.5 * (mark_ratio[p] + mark / weight)
        fused[p] = own[0] ** 0.5 * (1 + own[1]) ** 0.5 if linked[p] <= LINKED * chars[p] else 0.0
    return fused


def is_header(label: str) -> bool:
    return re.search(r"(?:^|[.-])header(?:$|[.-])", label, re.I) is not None


def tag_of(label: str) -> str:
    return label.split(".")[0]


def container(path: tuple[str, ...]) -> tuple[str, ...]:
    """The element that a path's paragraph, list or table stands in. A cell with paragraphs of its own may be
    part of a page's layout, so it is a container itself."""
    end = len(path)
    if end and tag_of(path[-1]) in ("td", "th"):
        while end and tag_of(path[end - 1]) in CELLS:
            end -= 1
    while end and tag_of(path[end - 1]) in TEXTUAL:
        end -= 1
    if end and is_header(path[end - 1]):  # a heading's own box
        end -= 1
    return path[:end]


def mostly_links(found: list[Block], key) -> set[tuple[str, ...]]:
    """Keys of blocks of which more than `LINKED` is link text."""
    chars: dict[tuple[str, ...], int] = defaultdict(int)
    linked: dict[tuple[str, ...], int] = defaultdict(int)
    for block in found:
        chars[key(block.path)] += len(block.text)
        linked[key(block.path)] += block.linked
    return {k for k in chars if linked[k] > LINKED * chars[k]}


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    if not found:
        return ""
    scores = path_scores(found)
    inside = {b.path for b in found if b.marked}
    if inside:
        scores = {p: score if p in inside else UNMARKED * score for p, score in scores.items()}
    bar = SHARE * max(scores.values())
    linked = mostly_links(found, lambda p: p)
    holders = {container(p) for p, score in scores.items() if score > 0 and score >= bar} - mostly_links(found, container)
    # Links alone, in a list, a table or straight in the container, are no part of the text; a linked paragraph is.
    linked = {p for p in linked if p == container(p) or tag_of(p[-1]) in ITEMS}
    kept = [b for b in found if container(b.path) in holders and b.path not in linked]
    last = kept[-1] if kept else None
    if last and len(kept) > 1 and COPYRIGHT.match(last.text) and container(last.path) != container(kept[-2].path):
        kept.pop()
    return "\n".join(b.text for b in kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            texts = [main_text(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(
        read, "page_id bigint, url string, text string, n_chars bigint"
    )

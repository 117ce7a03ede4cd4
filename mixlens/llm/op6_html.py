"""Main text of web pages by tag-path ratios.

A page is read once into blocks, each with its root-to-leaf path of block elements (tag, class and id words).  Per path,
text length and punctuation are summed over its blocks and divided by their number, text in links counting for nothing.
The ratios are smoothed along the page and fused: length times the root of punctuation times the weight of the path's
names.  A name is evidence, never a verdict: it makes a path's score a few times less or more.  Paths whose score is above
a threshold, a share of the page's mean, hold the content; where an article or main element has text that no name speaks
against, only such text is asked, so no block beside the article decides, however long.  The deepest element around all of
them, or the article or main element around that, is the content node.  Its blocks are the main text, save those below the
threshold under names that speak against them; and, where the content node is no article, paths that are links for the most
part and lie before or behind all content.

Reader comments are told by their structure: two or more siblings of one path that each name an author or a time, or two or more
siblings of one path under an element with a word of discussions in its name.  Articles beside one another are no comments.

A narrow map over whole pages: no shuffle, and one pass over tags and elements whatever their nesting.  Null and empty
html, and pages without text, give the empty text; null urls and keys are kept, repeated rows give a row each, other
columns are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlens.llm import common

# Element names of HTML, and words that name parts of a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var nobr picture".split()
)
RAW = set("script style textarea noscript template iframe noembed noframes xmp title svg math object video audio canvas select button".split())
CLOSES_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section table ul".split()
)
SCOPE = set("article aside body div footer form header html main nav ol section table ul dl".split())
OTHER_TAGS = set("head nav footer aside form menu dialog fieldset".split())
OTHER_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus disclaimer footer gdpr login menu modal nav navbar navigation newsletter notice notices pagination "
    "popup promo promotion promoted recommended related reply replies respond search share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription teaser toolbar widget complementary contentinfo hidden".split()
)
#: Marks of another part, unless an article holds them.
OUTER = {"header", "masthead", "topbar"}
MAIN_TAGS = {"article", "main"}
MAIN_WORDS = set("article articlebody content entry main post story text".split())

#: Last words of names that only say that something is a part.
PARTS = set("area bar block box button buttons container content form item items link links list panel section wrap wrapper".split())
#: Elements that are never a content node.
LEAVES = set("p h1 h2 h3 h4 h5 h6 li td pre".split())

#: Words of who wrote something, or when; and of parts that hold what readers wrote, if it is several pieces alike.
SIGNED = set("author byline date posted published time timestamp user username avatar".split())
READERS = set("discussion discussions feedback opinions reactions reader readers responses talk talkback thread threads".split())
HINT = re.compile("author|byline|date|posted|published|time|user|avatar", re.I)

PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？।؟،]")
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")


#: What closes an open element of a group, and what hides open ones from it.
GROUPS = {"li": "item", "dt": "term", "dd": "term", "td": "cell", "th": "cell", "tr": "row", "option": "option", "thead": "part", "tbody": "part", "tfoot": "part"}
CLOSES = {"li": ("item",), "dt": ("term",), "dd": ("term",), "td": ("cell",), "th": ("cell",), "tr": ("row", "cell"), "option": ("option",), "thead": ("part", "row", "cell"), "tbody": ("part", "row", "cell"), "tfoot": ("part", "row", "cell")}
LISTS = {"ul", "ol", "dl", "table", "menu", "select", "div", "body"}
#: Weights of names: an element for another part, a word for one, such a word that qualifies another, an article's.
OTHER_TAG, OTHER_WORD, OTHER_PART, ARTICLE = 0.02, 0.1, 0.4, 4.0


def weigh(tag: str, names: list[list[str]], article: bool) -> float:
    """What an element's names say of it.  In a name of several words the last one says what it is, the others how."""
    weight = OTHER_TAG if tag in OTHER_TAGS or tag in OUTER and not article else 1.0
    for words in names:
        for word in words:
            if word in OTHER_WORDS or word in OUTER and not article:
                weight *= OTHER_WORD if word == words[-1] or words[0] in OTHER_WORDS and words[-1] in PARTS else OTHER_PART
                break
    return weight * (ARTICLE if tag in MAIN_TAGS or any(w[-1] in MAIN_WORDS for w in names) else 1.0)


class Element:
    """A block element: its path's name and weight, its parent, and which elements an end tag may leave out are open."""

    __slots__ = ("against", "alike", "article", "depth", "name", "number", "open", "out", "parent", "readers", "signed", "tag", "weight")

    def __init__(self, tag: str, attributes: str, parent: Element | None, paths: dict, number: int) -> None:
        names = [w for m in NAMES.finditer(attributes) for x in (m[1] or m[2] or m[3] or "").split() if (w := [y.lower() for y in WORDS.findall(x)])] if attributes else []
        self.tag, self.parent, self.number, self.depth = tag, parent, number, parent.depth + 1 if parent else 0
        self.article = bool(parent and parent.article) or tag in MAIN_TAGS
        whole = tag in ("html", "body")
        own = 1.0 if whole else 0.0 if attributes and HIDDEN.search(attributes) else weigh(tag, names, bool(parent and parent.article))
        self.weight = own * (parent.weight if parent else 1.0)
        self.against = bool(parent and parent.against) or own < 1.0
        # the number of its path on this page: equal for equal paths
        self.name = paths.setdefault((parent.name if parent else -1, tag, *sorted({y for w in names for y in w})), len(paths))
        # children that are signed (under readers' names: all), by path
        self.signed, self.alike, self.out, words = False, None, None, {y for w in names for y in w}
        self.readers = not words.isdisjoint(READERS)
        if parent and parent.readers:
            parent.count(self)
        if not words.isdisjoint(SIGNED):
            self.sign()
        self.open = parent.open if parent else {}
        if tag in SCOPE or tag in LISTS:
            self.open = {k: e for k, e in self.open.items() if not (tag in SCOPE and k == "p" or tag in LISTS and k != "p")}
        if group := "p" if tag == "p" else GROUPS.get(tag):
            self.open = {**self.open, group: self}

    def count(self, child: Element) -> None:
        self.alike = self.alike or {}
        self.alike[child.name] = self.alike.get(child.name, 0) + 1

    def sign(self) -> None:
        """An author or a time stands in this element, and so in all around it."""
        e = self
        while e is not None and not e.signed:
            e.signed = True
            if e.parent is not None and not e.parent.readers:
                e.parent.count(e)
            e = e.parent

    def piece(self) -> bool:
        """Whether this is one of several signed pieces alike; an article is one only inside another."""
        alike = self.parent.alike if self.parent else None
        return bool(alike) and alike.get(self.name, 0) > 1 and (self.signed or self.parent.readers) and (self.tag not in MAIN_TAGS or self.parent.article)


def comments(found: list[tuple[Element, str, int]]) -> np.ndarray:
    """Which blocks are comments of readers: pieces alike, and an element (no article) most of whose text such pieces are."""
    whole: dict[int, int] = {}
    pieces: dict[int, int] = {}
    kept = np.zeros(len(found), bool)
    chains = []
    for e, text, _ in found:
        chain, x = [], e
        while x is not None and x.out is None:
            chain.append(x)
            x = x.parent
        out = x.out if x is not None else (False, False)
        for y in reversed(chain):  # whether some element above has pieces, and whether this lies in one
            y.out = out = (out[0] or bool(y.alike), out[1] or y.piece())
        if e.out[0]:
            chains.append(e)
    if not chains:
        return kept
    for e, text, _ in found:
        x, inside = e, False
        while x is not None and x.out[0]:
            if x.alike:
                whole[x.number] = whole.get(x.number, 0) + len(text)
                pieces[x.number] = pieces.get(x.number, 0) + len(text) * inside
            inside = inside or x.piece()
            x = x.parent
    for k, (e, _, _) in enumerate(found):
        x = e
        gone = e.out[1]
        while not gone and x is not None and x.out[0]:
            gone = bool(x.alike) and x.tag not in MAIN_TAGS and x.tag not in ("html", "body", "") and 2 * pieces[x.number] >= whole[x.number] > 0
            x = x.parent
        kept[k] = gone
    return kept if not kept.all() else np.zeros(len(found), bool)


def blocks(page: str) -> list[tuple[Element, str, int]]:
    """The page's blocks in order: element, text (white space collapsed, references decoded, none empty) and how many of
    its characters are links."""
    out: list[tuple[Element, str, int]] = []
    paths: dict[tuple, int] = {}
    root = top = Element("", "", None, paths, 0)
    made, opened = 1, {}
    parts: list[str] = []
    linked, link = [], False
    at, n = 0, len(page)

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((top, text, min(len(text), len(SPACE.sub(" ", html.unescape("".join(linked))).strip()))))
            parts.clear()
            linked.clear()

    def add(text: str) -> None:
        parts.append(text)
        if link:
            linked.append(text)

    def leave(to: Element) -> None:
        """Close all that is open below ``to``."""
        nonlocal top
        while top is not to:
            opened[top.tag] -= 1
            top = top.parent

    while at < n:
        m = MARKUP.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing = tag.lower(), m[1] or m[4]
        if tag in INLINE:
            if tag == "a":
                link = not closing
            if not closing and not top.signed and (tag == "time" or (m[3] and HINT.search(m[3]) and any(not SIGNED.isdisjoint(y.lower() for y in WORDS.findall(x[1] or x[2] or x[3] or "")) for x in NAMES.finditer(m[3])))):
                top.sign()
            continue
        if tag in RAW:
            if not closing and not (m[3] or m[6] or "").endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            if tag not in ("svg", "math", "button", "select"):
                flush()
            continue
        if tag in ("br", "wbr", "img", "input", "embed"):
            if tag == "br":
                parts.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            if opened.get(tag):
                e = top
                while e.tag != tag:
                    e = e.parent
                leave(e.parent)
            continue
        if tag in CLOSES_P and (e := top.open.get("p")):
            leave(e.parent)
        for group in CLOSES.get(tag, ()):
            if e := top.open.get(group):
                leave(e.parent)
                break
        top = Element(tag, m[3] or m[6] or "", top, paths, made)
        made += 1
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def smooth(values: np.ndarray) -> np.ndarray:
    """A Gaussian window over two neighbours on either side."""
    weights = np.exp(-(np.arange(-2, 3) ** 2) / 2.0)
    return np.convolve(np.pad(values, 2, mode="edge"), weights / weights.sum(), mode="valid")


def scores(found: list[tuple[Element, str, int]]) -> np.ndarray:
    """The fused ratio of each block's path: the mean over the path's blocks."""
    _, path = np.unique([e.name for e, _, _ in found], return_inverse=True)
    number = np.bincount(path)
    size = np.array([len(t) - linked for _, t, linked in found], float)
    marks = np.array([len(PUNCTUATION.findall(t)) for _, t, _ in found], float)
    text_ratio = smooth((np.bincount(path, size) / number)[path])
    mark_ratio = smooth((np.bincount(path, marks) / number)[path])
    fused = text_ratio * np.sqrt(1 + mark_ratio) * np.array([e.weight for e, _, _ in found])
    return (np.bincount(path, fused) / number)[path]


def content_node(found: list[tuple[Element, str, int]], chosen: np.ndarray) -> Element:
    """The deepest element around all chosen blocks, or the article or main element around it."""
    chain: list[Element] = []  # from the root to the first of them
    meets: dict[int, int] = {}  # element: the depth at which the chain passes or leaves it
    for (e, _, _), c in zip(found, chosen.tolist(), strict=True):
        if not c:
            continue
        e, above = e.parent if e.tag in LEAVES else e, []
        while e is not None and e.number not in meets:
            above.append(e)
            e = e.parent
        if e is None:
            chain = above[::-1]
            meets = {x.number: x.depth for x in chain}
        else:
            depth = meets[e.number]
            meets.update((x.number, depth) for x in above)
            del chain[depth + 1 :]
    node = chain[-1]
    around = node
    while around is not None and around.tag not in MAIN_TAGS:
        around = around.parent
    return around or node


def main_text(page: str | None, threshold: float = 0.5) -> str:
    """The main text of a page: the content node's blocks, one a line.  ``threshold`` is a factor on the mean of the fused
    ratios by text."""
    found = [x for x in blocks(page) if x[0].weight > 0] if page else []
    if not found:
        return ""
    found = [x for x, gone in zip(found, comments(found).tolist(), strict=True) if not gone]
    fused, size = scores(found), np.array([len(t) for _, t, _ in found], float)
    high = fused >= threshold * (fused * size).sum() / size.sum()
    own = np.array([e.article and not e.against and 2 * linked < len(t) for e, t, linked in found])
    chosen = own & (fused >= threshold * (fused * size)[own].sum() / size[own].sum()) if own.any() else high
    if not fused.any():  # nothing but links
        chosen = high = np.array([not e.against for e, _, _ in found])
        if not chosen.any():
            return ""
    node = content_node(found, chosen)
    inside = {node.number: True, 0: node.parent is None}

    def within(e: Element) -> bool:
        above = []
        while e.number not in inside:
            above.append(e.number)
            e = e.parent
        inside.update(dict.fromkeys(above, inside[e.number]))
        return inside[e.number]

    number, links = {}, {}
    for e, text, linked in found:
        number[e.name] = number.get(e.name, 0) + len(text)
        links[e.name] = links.get(e.name, 0) + linked
    first, *_, last = [*np.flatnonzero(chosen).tolist()] * 2
    whole = node.article or node.tag in MAIN_TAGS

    def text_of_it(k: int, e: Element) -> bool:
        return high[k] or not e.against and (whole or first < k < last or 2 * links[e.name] <= number[e.name])

    return "\n".join(text for k, (e, text, _) in enumerate(found) if within(e) and text_of_it(k, e))


def extract(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    rows = df.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{page}`").cast("string").alias("html"), F.col(f"`{url}`").cast("string").alias("url"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x.as_py()) for x in part.column(1)]
                yield pa.record_batch([part.column(0), part.column(2), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, common.schema(page_id=common.LONG, url=common.STR, text=common.STR, n_chars=common.LONG))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(common.table(spark, sf_dir, "pages"))

"""Main text of web pages by site template removal.

Every element below ``body`` has a subtree hash: its tag and class, its own text and
its children's hashes. Spark counts, per host, on how many different pages a subtree
occurs at the same place, and how many pages have that place at all. A place is the
path of tags and classes down to the element and its position among its siblings,
from the nearer end. A subtree that is what most pages of the host show at its place
is template and is deleted; the same words elsewhere, or at a place that other pages
fill otherwise, are content. Elements whose role is not content by their tag or their
class (menus, adverts, reader comments and the like) are left out too, unless the
page's only articles or its whole text are in one (see :func:`_unwrap`). What is left
of the page's articles, or of its body if it has none, is its text. Only boxes are
deleted by count, never paragraphs or headings; inside an article only plain
containers, not lists, tables or figures.
"""

from __future__ import annotations

import copy
import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.llm.shared import written

MANY_PAGES, MANY_SHARE = 5, 0.5
"""A subtree is template if so many different pages of the host have it at its place, and this share of those with the place."""
INSIDE_ARTICLES = 20
"""Inside articles so many different articles must have it, and the same share."""
BROADCAST_TEMPLATES = 500_000
"""Up to so many templates (counted) are sent to all workers; more are joined with the pages."""
SALTS = 32

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)", re.S)
_RAW = {t: re.compile(rf"</{t}\s*>?", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_BOXES = frozenset("address aside center details dir div dl fieldset figure footer header menu nav ol section table ul".split())
_CONTAINERS = frozenset("aside center div fieldset footer header menu nav section".split())
"""What count may delete inside an article."""
_DROPPED = frozenset(
    "aside button canvas dialog embed footer form head header iframe input label link menu meta nav noembed noframes noscript object option "
    "script select style svg template textarea title video audio".split())
_WRAPPERS = frozenset("aside dialog footer form header menu nav object".split())
"""Dropped for their role; the other tags in _DROPPED hold no text that is shown."""
_CONTENT = ("article", "main")
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner cookie cookies consent notice notices "
    "comment comments respond disqus reply replies sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead header "
    "share sharing social related newsletter subscribe popup modal widget pagination pager".split())
_PLACES = frozenset("area bar bottom box buttons container form global left links list main mobile posts right secondary site slot top wrapper".split())
"""What a compound name may add to a name without meaning something else: site-footer, but not related-work."""
_PARAGRAPH_ENDS = frozenset(_BLOCK - {"br", "option", "legend", "summary", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"})
_SAME_CLOSES = {t: (t,) for t in ("li", "option", "tr")} | {t: ("dd", "dt") for t in ("dd", "dt")} | {t: ("td", "th") for t in ("td", "th")}
_LISTS = ("ul", "ol", "dl", "table", "select", "menu")
_INLINE = frozenset("p b i em strong a span li".split())
_CELLS = ("article", "main", "td", "th", "body")
_SPACES = re.compile(r"\s+")


class Element:
    __slots__ = ("tag", "name", "children", "dropped", "hidden", "role_only", "hash")

    def __init__(self, tag: str, name: str = "", dropped: bool = False, hidden: bool = False, role_only: bool = False):
        """``role_only``: dropped for its tag alone."""
        self.tag, self.name, self.dropped, self.hidden, self.role_only = tag, name, dropped or hidden, hidden, role_only
        self.children, self.hash = [], 0


def _is_role(token: str) -> bool:
    """Whether a whole class or id says that an element is no content."""
    if token in _NAMES:
        return True
    parts = {part for part in re.split(r"[_-]+", token) if part}
    return not parts.isdisjoint(_NAMES) and parts <= _NAMES | _PLACES


def _open(tag: str, attributes: str) -> Element:
    name, named, hidden = "", False, tag in _DROPPED and tag not in _WRAPPERS
    if attributes and not attributes.isspace():
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values).lower()
            if key in ("class", "id"):
                name = f"{name} {value}" if key == "class" else name
                named |= tag not in ("body", "html", *_CONTENT) and any(map(_is_role, value.split()))
            elif key == "role":
                named |= value in _ROLES
            else:
                hidden |= key == "hidden" or value == "true"
    return Element(tag, name, named or tag in _WRAPPERS, hidden, tag in _WRAPPERS and not named and not hidden)


def parse(page: str) -> Element:
    """The tree of a page; a child is an Element or a text with references decoded.

    Unclosed paragraphs, list items and cells end where the next one begins; other
    unclosed elements end with their parent. A closing tag without an open element is
    ignored. Comments and declarations are left out.
    """
    root = Element("html")
    stack, at = [root], 0
    open_at: dict[str, list[int]] = {}  # depths of the open elements of a tag
    ends: list[int] = []  # depths of those that end where a block begins or hold it

    def nearest(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def cut(depth: int) -> None:
        for element in reversed(stack[depth:]):
            open_at[element.tag].pop()
            if element.tag in _PARAGRAPH_ENDS:
                ends.pop()
        del stack[depth:]

    for token in _TOKEN.finditer(page):
        if token.start() < at:
            continue  # inside a raw element
        if token.start() > at:
            stack[-1].children.append(entities.unescape(page[at : token.start()]))
        at = token.end()
        closing, tag = token.group(1), token.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            depth = nearest((tag,))
            if depth and (tag not in _INLINE or nearest(_CELLS) < depth):  # an inline end tag does not close its container
                cut(depth)
            continue
        if tag == "html":
            continue
        if tag in _PARAGRAPH_ENDS and ends and stack[ends[-1]].tag == "p":
            cut(ends[-1])
        closes = _SAME_CLOSES.get(tag)
        if closes:
            depth = nearest(closes)
            if depth > nearest(_LISTS):
                cut(depth)
        element = _open(tag, token.group(3))
        if element.role_only and open_at.get("article") and (tag == "header" or tag == "aside" and "quote" in element.name):
            element.dropped = False  # the article's own
        elif tag == "blockquote" and stack[-1].tag == "aside" and stack[-1].role_only and open_at.get("article"):
            stack[-1].dropped = False
        stack[-1].children.append(element)
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag not in _VOID and not token.group(3).endswith("/"):
            open_at.setdefault(tag, []).append(len(stack))
            if tag in _PARAGRAPH_ENDS:
                ends.append(len(stack))
            stack.append(element)
    if at < len(page):
        stack[-1].children.append(entities.unescape(page[at:]))
    _unwrap(root)
    return root


def _walk(root: Element):
    """Elements in post-order, without recursion."""
    stack = [(root, False)]
    while stack:
        element, done = stack.pop()
        if done:
            yield element
        else:
            stack.append((element, True))
            stack.extend((c, False) for c in element.children if isinstance(c, Element))


def _unwrap(root: Element) -> None:
    """Keeps elements dropped for their role that are the page's wrappers.

    Where no article or main is outside of such elements, the outermost that hold one are
    no longer dropped, and so on inwards until one is found. A form that holds a level-one
    heading is a wrapper too; so are all forms of a page without content markup whose
    text is in forms only.
    """
    holds, titled = set(), set()
    for element in _walk(root):
        if element.hidden:
            continue
        inner = [c for c in element.children if isinstance(c, Element)]
        if element.tag in _CONTENT or any(id(c) in holds for c in inner):
            holds.add(id(element))
        if element.tag == "h1" or any(id(c) in titled for c in inner):
            titled.add(id(element))
    seen = bool(holds)
    level = [root]
    while level:
        found, text, closed = False, False, []
        stack = level
        while stack:
            element = stack.pop()
            if element.dropped and element.tag == "form" and not element.hidden and id(element) in titled and not _named(element):
                element.dropped = False
            if element.dropped:
                closed.append(element)
            elif element.tag in _CONTENT:
                found = True
            else:
                text = text or any(isinstance(c, str) and not c.isspace() for c in element.children)
                stack.extend(c for c in element.children if isinstance(c, Element))
        if found or text and not seen:
            return
        level = [e for e in closed if not e.hidden and (id(e) in holds if seen else e.tag == "form" and not _named(e))]
        for element in level:
            element.dropped = False


def _named(element: Element) -> bool:
    return any(map(_is_role, element.name.split()))


def hash_subtrees(root: Element) -> None:
    for element in _walk(root):
        parts = [element.tag, element.name]
        for child in element.children:
            if isinstance(child, Element):
                parts.append(f"<{child.hash}>")
            elif text := _SPACES.sub(" ", child).strip():
                parts.append(text)
        element.hash = xxhash.xxh3_64_intdigest("\x00".join(parts)) - (1 << 63)


def _starts(root: Element) -> list[Element]:
    """The page's outermost articles, else its mains; none if it has neither."""
    starts: list[Element] = []
    for tag in _CONTENT:
        stack = [root]
        while stack:
            element = stack.pop()
            if element.dropped:
                continue
            if element.tag == tag:
                starts.append(element)
                continue
            stack.extend(reversed([c for c in element.children if isinstance(c, Element)]))
        if starts:
            break
    return starts


def _named_hash(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts))) - (1 << 63)


def _candidates(root: Element) -> list[tuple[Element, int, Element | None]]:
    """The boxes that count may delete, their places, and the article that each is in.

    A place inside an article begins at the article and has its last bit set, so both
    kinds are counted apart. Boxes that hold an article or main are none.
    """
    holds = set()
    for element in _walk(root):
        if element.tag in _CONTENT or any(id(c) in holds for c in element.children if isinstance(c, Element)):
            holds.add(id(element))
    found: list[tuple[Element, int, Element | None]] = []
    articles = _starts(root)
    boxes, inside = (_CONTAINERS, 1) if articles else (_BOXES, 0)
    for start in articles or [root]:
        stack = [(start, _named_hash(start.tag))]
        while stack:
            element, path = stack.pop()
            inner = [c for c in element.children if isinstance(c, Element)]
            for k, part in enumerate(inner):
                if part.dropped:
                    continue
                below = _named_hash(path, part.tag, part.name)
                if part.tag in boxes and id(part) not in holds and part.children:
                    from_end = len(inner) - 1 - k
                    place = _named_hash(below, *(("first", k) if k <= from_end else ("last", from_end)))
                    found.append((part, place & ~1 | inside, start if inside else None))
                stack.append((part, below))
    return found


def subtrees(root: Element) -> set[tuple[int, int]]:
    """(place, subtree) of the boxes of a page that may be template."""
    return {(place, part.hash) for part, place, _ in _candidates(root)}


def main_text(root: Element, template) -> str:
    """Blocks of the page's articles (outermost article, else main, else body), one a line.

    ``template`` tells whether it holds a (place, subtree).
    """
    gone = {id(part) for part, place, _ in _candidates(root) if (place, part.hash) in template} if template else ()
    starts = _starts(root)
    blocks: list[str] = []
    line: list[str] = []

    def end_block():
        text = _SPACES.sub(" ", "".join(line)).strip()
        if text:
            blocks.append(text)
        line.clear()

    for start in starts or [root]:
        stack: list = [start]
        while stack:
            item = stack.pop()
            if item is None:
                end_block()
            elif isinstance(item, str):
                line.append(item)
            elif item.tag == "br":
                line.append(" ")
            elif not item.dropped and id(item) not in gone:
                if item.tag in _BLOCK:
                    end_block()
                    stack.append(None)
                stack.extend(reversed(item.children))
        end_block()
    return "\n".join(blocks)


def host_of(url):
    """Host of a URL column, lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _page_boxes(pages: DataFrame) -> DataFrame:
    """(host, place, subtree, mark) of the boxes of every different page, ``mark`` naming its html."""
    def list_boxes(batches):
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for host, mark, page in zip(batch.column("host").to_pylist(), batch.column("mark").to_pylist(), batch.column("html").to_pylist(), strict=True):
                root = parse(page or "")
                hash_subtrees(root)
                for box in subtrees(root):
                    for column, value in zip(out, (host, *box, mark), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), *(pa.array(c, pa.int64()) for c in out[1:])], ["host", "place", "subtree", "mark"])

    rows = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("mark"), "html")
    return rows.mapInArrow(list_boxes, "host string, place long, subtree long, mark long").distinct()


def listed(pages: DataFrame) -> DataFrame:
    """(host, place, subtree, mark) of the boxes of every page of (url, html), and of their places with a null subtree.

    ``mark`` names the page's html, or inside an article the article's subtree, so copies
    of one page or article count once.
    """
    def list_boxes(batches):
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for host, mark, page in zip(batch.column("host").to_pylist(), batch.column("mark").to_pylist(), batch.column("html").to_pylist(), strict=True):
                root = parse(page or "")
                hash_subtrees(root)
                found = set()
                for part, place, article in _candidates(root):
                    own = mark if article is None else article.hash
                    found |= {(place, part.hash, own), (place, None, own)}
                for row in found:
                    for column, value in zip(out, (host, *row), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), *(pa.array(c, pa.int64()) for c in out[1:])], ["host", "place", "subtree", "mark"])

    rows = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("mark"), "html")
    return rows.mapInArrow(list_boxes, "host string, place long, subtree long, mark long").distinct()


def templates(boxes: DataFrame, many_pages: int = MANY_PAGES, many_share: float = MANY_SHARE) -> DataFrame:
    """(host, place, subtree) that at least ``many_pages`` pages have, and ``many_share`` of the host's pages with that place.

    Inside articles, INSIDE_ARTICLES different articles count.
    """
    counts = boxes.groupBy("host", "place", "subtree").count()
    least = F.when(F.col("place").bitwiseAND(F.lit(1)) == 1, F.lit(INSIDE_ARTICLES)).otherwise(F.lit(many_pages))
    many = counts.where(F.col("count") >= least)
    whole = many.where("subtree IS NULL").select("host", "place", F.col("count").alias("pages"))
    return many.where("subtree IS NOT NULL").join(whole, ["host", "place"]).where(F.col("count") >= many_share * F.col("pages")).select(
        "host", "place", "subtree")


class _Known:
    """Templates of all hosts as sorted hashes of (host, place, subtree)."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)

    def of(self, host: str) -> _Known:
        part = copy.copy(self)
        part.host = host
        return part

    def __bool__(self) -> bool:
        return len(self.keys) > 0

    def __contains__(self, box: tuple[int, int]) -> bool:
        key = _named_hash(self.host, *box)
        at = int(np.searchsorted(self.keys, key))
        return at < len(self.keys) and int(self.keys[at]) == key


def extract(
    pages: DataFrame, many_pages: int = MANY_PAGES, many_share: float = MANY_SHARE, broadcast: int = BROADCAST_TEMPLATES,
) -> DataFrame:
    """Main text of every row of (page_id, url, html): page_id, url, text, n_chars.

    A null or empty html, or a page without content, has an empty text. A null url has
    the empty host. Ties, repeated rows and null page_ids change nothing: each row gives
    one row. References are decoded, white space inside a block is one blank, blocks are
    joined by a line feed. Pages are read twice: to list their boxes and to write their
    text. They are not shuffled unless there are more than ``broadcast`` templates.
    """
    spark = pages.sparkSession
    boxes = written(listed(pages), "boxes")
    found = written(templates(boxes, many_pages, many_share), "templates")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    few = found.limit(broadcast + 1).count() <= broadcast
    if few:
        known = [_named_hash(*row) for row in zip(*(c.to_pylist() for c in found.toArrow().columns), strict=True)]
        held = spark.sparkContext.broadcast(_Known(np.array(known, np.int64)))
    else:
        salt = F.pmod(F.col("mark"), F.lit(SALTS))
        spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        # an article's boxes are named by the article, so pages are met through their own list again
        hits = _page_boxes(pages).withColumn("salt", salt).join(spread, ["host", "place", "subtree", "salt"]).groupBy("host", "mark").agg(
            F.collect_set(F.struct("place", "subtree")).alias("template"))
        rows = rows.withColumn("mark", F.xxhash64("html")).join(hits, ["host", "mark"], "left").drop("mark")

    def texts(batches):
        for batch in batches:
            out = []
            hosts = batch.column("host").to_pylist()
            own = [held.value.of(h) for h in hosts] if few else [
                {(t["place"], t["subtree"]) for t in ts or ()} for ts in batch.column("template").to_pylist()]
            for page, template in zip(batch.column("html").to_pylist(), own, strict=True):
                root = parse(page or "")
                hash_subtrees(root)
                out.append(main_text(root, template))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(
        texts, f"page_id {types['page_id']}, url {types['url']}, text string").withColumn("n_chars", F.length("text").cast("long"))

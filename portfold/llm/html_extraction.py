"""Main text of web pages: differences between pages with neighbouring URLs, checked by markup.

A page is cut into lines at block elements. Lines inside ``article`` or ``main`` are marked; lines inside menus, headers,
footers, side bars, forms, adverts, notices and comments, told by element, role or the first word of a class or id, are left out; an article
within an element that only its class or id tells counts if the page has no other. All other lines are open. A page that marks an
article consists of its marked lines, any other of its open lines.

All pages are sorted by host and URL path and dealt to tasks by ranges of this order, so that a host of any size is
spread. Each page is paired with the pages before and after it on the same host. Its lines are aligned with those of each by the
longest common subsequence, marked ones with marked ones and open ones with open ones; lines that it shares with both, or with the only one
there is, are template.

Markup checks the verdict: where an article is marked, template are whole marked elements only (those without another around them), so a
line that neighbours repeat stays if its element holds a line of its own. A template is on all of them, a copied article on one side only.
Where nothing would be left, the pages are copies throughout and keep their lines.

What is dealt out and aligned are 64-bit hashes of lines. The texts stay where they were parsed, and meet only verdicts that drop something.

The first and the last page of a range have a neighbour in another range. They are put aside with their neighbour within, and
meet in a second step, which holds two pages per range. So neighbours don't depend on how pages were dealt out.

Neither part does alone: adverts and footers that are new on each page are not shared, and passages that articles repeat are. See the README.

Defined results: null and empty pages, and pages without article text, give an empty string; a page without URL or without neighbour has
no partner and keeps its lines; elements that are never closed end with the element around them; repeated rows
give equal results; an empty table gives an empty result; other input columns are ignored, whatever their names.
"""

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portfold.llm.support import written

# NAMED is left out by class or id words alone, NESTED an article within that.
NESTED, ARTICLE, OPEN, OTHER, NAMED = 3, 2, 1, 0, -1
_MARKED = (ARTICLE, NESTED)

# Names of HTML elements, roles, and words in class names.
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "textarea", "title"}
_OTHER = {"nav", "header", "footer", "aside", "form", "head", "button", "select", "dialog", "menu"}
_MAIN = {"article", "main"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
    "nobr",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CLOSED_BY_BLOCKS = {"p"}
_ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar",
}
_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
    "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "pager", "pagination", "popup", "promo", "promoted", "promotion", "reactions", "related", "replies", "reply",
    "respond", "share", "sharing", "sidebar", "signup", "skyscraper", "social", "sponsor", "sponsored", "subscribe", "toolbar",
    "widget",
}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|itemprop|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def _kind_of(name: str, attributes: str, inside: int) -> int:
    """The kind of lines within an element, from its name and attributes and the kind around it."""
    if inside == OTHER or name in _OTHER:
        return OTHER
    main, named = name in _MAIN, False
    for found in _ATTRIBUTE.finditer(attributes):
        key, value = found[1].lower(), next((g for g in found.groups()[1:] if g is not None), "")
        if key in ("class", "id"):
            leading = {w[0].lower() for w in map(_WORD.search, value.split()) if w}
            named = named or bool(leading & _NAMES) and name not in ("html", "body")
        elif key == "role":
            if value.lower() in _ROLES:
                return OTHER
            main = main or value.lower() in ("main", "article")
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _NO_DISPLAY.search(value):
            return OTHER
        elif key == "itemprop":
            main = main or value.lower() == "articlebody"
    if main:
        return NESTED if inside in (NAMED, NESTED) else ARTICLE
    return NAMED if named else inside


class Line(NamedTuple):
    kind: int
    text: str
    element: int
    """Number of the outermost marked element around the line, 0 outside."""


def lines(page: str) -> list[Line]:
    """The lines of a page in order, each with its kind; character references decoded, white space as single spaces."""
    found: list[Line] = []
    stack: list[tuple[str, int, int]] = []  # open elements with the kind and the marked element within
    kind, element, elements, held, at = OPEN, 0, 0, [], 0

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                found.append(Line(kind, text, element))

    while True:
        tag = _TAG.search(page, at)
        held.append(page[at:tag.start()] if tag else page[at:])
        if not tag:
            break
        at = tag.end()
        name = tag[2] or tag[5]
        if not name:
            continue
        closing, name, attributes = tag[1] or tag[4], name.lower(), tag[3] or tag[6] or ""
        if name == "br":
            held.append(" ")
            continue
        if not closing and name in _RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            continue
        inline = name in _INLINE
        if not inline:
            flush()
        if name in _VOID:
            continue
        if closing:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if place is not None:
                if stack[place][1:] != (stack[place - 1][1:] if place else (OPEN, 0)):
                    flush()
                del stack[place:]
        else:
            if not inline and stack and stack[-1][0] in _CLOSED_BY_BLOCKS:
                stack.pop()
            around, outer = stack[-1][1:] if stack else (OPEN, 0)
            within = _kind_of(name, attributes, around)
            if inline and within == around:
                continue  # its end finds no open element and changes nothing
            if inline:
                flush()
            if within in _MARKED and not outer:
                elements += 1
                outer = elements
            stack.append((name, within, outer))
        kind, element = stack[-1][1:] if stack else (OPEN, 0)
    flush()
    return found


def common_lines(a: list, b: list) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``, by rows of bits between the ends that are equal anyway."""
    least = min(len(a), len(b))
    head = next((i for i in range(least) if a[i] != b[i]), least)
    tail = next((i for i in range(least - head) if a[-1 - i] != b[-1 - i]), least - head)
    ends = range(len(a) - tail, len(a))
    both = set(a[head:ends.start]) & set(b[head:len(b) - tail])
    left = [i for i in range(head, ends.start) if a[i] in both]
    right = [line for line in b[head:len(b) - tail] if line in both]
    places: dict = {}
    for j, line in enumerate(right):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(right)) - 1
    row, rows = full, []
    for i in left:
        match = row & places[a[i]]
        row = (row + match | row - match) & full
        rows.append(row)
    shared, i, j = [], len(left), len(right)
    while i and j:
        if rows[i - 1] >> j - 1 & 1:
            j -= 1
            continue
        i -= 1
        if i and not rows[i - 1] >> j - 1 & 1:
            continue
        shared.append(left[i])
        j -= 1
    return [*range(head), *shared[::-1], *ends]


def marked_lines(page: list[Line]) -> list[Line]:
    """The lines of the articles that the markup shows."""
    return [line for line in page if line.kind == ARTICLE] or [line for line in page if line.kind == NESTED]


def open_lines(page: list[Line]) -> list[Line]:
    return [line for line in page if line.kind == OPEN]


class Page(NamedTuple):
    """What differences are taken of: marked and open lines, or their hashes, and the elements of the marked ones."""

    marked: list
    elements: list[int]
    open: list


def page_of(page: list[Line]) -> Page:
    marked = marked_lines(page)
    return Page([line.text for line in marked], [line.element for line in marked], [line.text for line in open_lines(page)])


def kept_lines(page: Page, neighbours: list[Page]) -> list[int]:
    """Positions of the lines that are no template, among the marked ones of a page that has such, else among the open ones."""
    own = page.marked or page.open
    shared = set(range(len(own))) if neighbours else set()
    for other in neighbours:
        shared &= set(common_lines(own, other.marked if page.marked else other.open))
    kept = [i for i in range(len(own)) if i not in shared]
    if page.marked:
        with_own = {page.elements[i] for i in kept}
        kept = [i for i, element in enumerate(page.elements) if element in with_own]
    return kept or list(range(len(own)))


def main_text(page: list[Line], *neighbours: list[Line]) -> str:
    """The lines of a page that are no template beside its neighbours."""
    one = page_of(page)
    own = one.marked or one.open
    return "\n\n".join(own[i] for i in kept_lines(one, [page_of(n) for n in neighbours]))


_TEXTS, _HASHES, _NUMBERS = pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32())
_PAGE = ("marked", "elements", "open")
_PAGE_TYPES = (_HASHES, _NUMBERS, _HASHES)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, host, path, html) with the html replaced by ``marked`` lines, their ``elements``, and ``open`` lines."""
    for batch in batches:
        found = [page_of(lines(source.as_py() or "")) for source in batch.column(4)]
        columns = [pa.array([page[i] for page in found], t) for i, t in enumerate((_TEXTS, _NUMBERS, _TEXTS))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], names=[*batch.schema.names[:4], *_PAGE])


def _verdict(page: Page, neighbours: list[Page]) -> list[int] | None:
    """The lines that stay; None if all do."""
    kept = kept_lines(page, neighbours)
    return kept if len(kept) < len(page.marked or page.open) else None


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, host, path, row, marked, elements, open) in order of host and path to ``row`` and lines ``kept``, null for all.

    Pages at the ends of the range are undecided. They keep their columns, and have those of their neighbour within as ``inner_``.
    """
    out: list[tuple] = []
    names = ["row", "kept", "page_id", "url", "host", "path", *_PAGE, *[f"inner_{c}" for c in _PAGE], "first", "last"]
    types = [pa.int64(), _NUMBERS, None, pa.string(), pa.string(), pa.string(), *_PAGE_TYPES, *_PAGE_TYPES, pa.bool_(), pa.bool_()]

    def made() -> pa.RecordBatch:
        columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=names)

    def decided(page: tuple, before: tuple | None, after: tuple | None) -> None:
        sides = [Page(*x[5:]) for x in (before, after) if x is not None and page[2] and x[2] == page[2]]
        if before is None or after is None:
            inner = sides[0] if sides else (None, None, None)
            out.append((page[4], None, *page[:4], *page[5:], *inner, before is None, after is None))
        else:
            out.append((page[4], _verdict(Page(*page[5:]), sides), *[None] * 10, False, False))

    before = page = None
    for batch in batches:
        types[2] = batch.schema.field(0).type
        for after in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if page is not None:
                decided(page, before, after)
            before, page = page, after
            if len(out) >= 256:
                yield made()
    if page is not None:
        decided(page, before, None)
    if out:
        yield made()


def _at_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``row`` and four pages' columns (own, inner, outer before, outer after) to ``row`` and lines ``kept``."""
    for batch in batches:
        kept = []
        for _, *values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            own, *sides = [Page(*values[i:i + 3]) for i in range(0, 12, 3)]
            kept.append(_verdict(own, [side for side in sides if side.open is not None]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, _NUMBERS)], names=["row", "kept"])


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-case host and path without query, fragment, file ending or last slash; empty where the URL has none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)([^?#]*)", 2)
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(host), F.regexp_replace(rest, r"(\.[a-zA-Z]+)?/*$", "")


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` (blocks joined by an empty line) and ``n_chars`` of every row of ``df``."""
    host, path = host_and_path(F.col(url))
    keyed = df.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"), F.col(page).alias("html"))
    id_field = keyed.schema["page_id"]
    keys = T.StructType([id_field, *[T.StructField(name, T.StringType()) for name in ("url", "host", "path")]])
    texts = T.StructType.fromDDL("marked array<string>, elements array<int>, open array<string>")
    parsed = keyed.mapInArrow(_parsed, T.StructType([*keys, *texts])).withColumn("row", F.monotonically_increasing_id())
    parsed = written(parsed, "pages")
    # Pages without lines are nobody's neighbours. Hashes are dealt out, texts are not.
    hashed = [F.transform("marked", lambda x: F.xxhash64(x)).alias("marked"), "elements", F.transform("open", lambda x: F.xxhash64(x)).alias("open")]
    order = ["host", "path", "url", "page_id"]
    compared = parsed.where((F.size("marked") > 0) | (F.size("open") > 0)).select(*keys.names, "row", *hashed)
    in_order = compared.repartitionByRange(*order).sortWithinPartitions(*order)
    hashes = "marked array<bigint>, elements array<int>, open array<bigint>"
    paired = in_order.mapInArrow(_paired, T.StructType([
        *T.StructType.fromDDL("row bigint, kept array<int>"), *keys, *T.StructType.fromDDL(hashes),
        *T.StructType.fromDDL(", ".join(f"inner_{c}" for c in hashes.split(", ")) + ", first boolean, last boolean")]))
    paired = written(paired.withColumn("part", F.spark_partition_id()), "paired")
    # Two rows per range at most, so a window over a host holds no more than the ranges it spans.
    along = Window.partitionBy("host").orderBy("path", "url", "page_id", "part", "last")
    sides = [
        F.when(F.col(end) & (F.col("host") != ""), moved(c).over(along)).alias(f"{end}_{c}")
        for end, moved in (("first", F.lag), ("last", F.lead)) for c in _PAGE]
    met = paired.where("first or last").select("row", *_PAGE, *[f"inner_{c}" for c in _PAGE], *sides)
    decided = paired.where("not first and not last").select("row", "kept").unionByName(met.mapInArrow(_at_ends, "row bigint, kept array<int>"))
    # Written, so that Spark knows how few they are before it joins.
    dropping = written(decided.where("kept is not null"), "kept")
    own = F.when(F.size("marked") > 0, F.col("marked")).otherwise(F.col("open"))
    left = F.when(F.col("kept").isNull(), own).otherwise(F.transform("kept", lambda i: F.get(own, i)))
    result = parsed.join(dropping, "row", "left").select("page_id", "url", F.array_join(left, "\n\n").alias("text"))
    return result.withColumn("n_chars", F.char_length("text").cast("long"))

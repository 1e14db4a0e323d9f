"""Main text of web pages: the difference to the nearest pages of the host, checked by structure.

A page is cut into lines at its block elements. Pages of a host are sorted by URL path.
Consecutive ones that are copies or near copies, whose text is the same, form a run; the
neighbours of a page are the last page before its run and the first page after it. The
lines of both are aligned by a longest common subsequence; lines shared with the
neighbour that has the longer path prefix in common, and with the one on the other side if
there is one, are the template of the site and are deleted wherever they stand. So a line of
an article that only one neighbour repeats is kept. Structure checks what is left: lines
inside menus, headers, footers, side columns, notices, adverts, forms and comments are
furniture that differs from page to page, and go as well. Lines inside an article are main,
the rest is open. A page without a neighbour is left to structure: its main lines, or else
its open ones.

Runs are found in one pass over ranges of (host, path), so a host with a third of all pages
is spread over many tasks. What is shuffled is the codes of lines, 8 bytes each, and once the
compressed lines that structure keeps, never html.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm import words
from marketlake.llm.common import located, materialize, numbered

FURNITURE, OPEN, MAIN = 0, 1, 2
#: Pairs of lines, a bit each, that a subsequence is followed through at once.
PAIRS = 100_000_000
#: Percentage of shared lines from which a page is a near copy of another.
NEAR = 80
#: Consecutive pages whose numbers are searched for the ends of runs in one task.
BLOCK = 1 << 17

#: Elements whose content is never text of the page.
_HIDDEN = {
    name: re.compile(rf"</{name}\s*>", re.I)
    for name in (
        "script", "style", "noscript", "template", "textarea", "iframe", "svg", "canvas", "object", "math",
        "select", "head", "title",
    )
}
_FURNITURE = {
    "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "address",
}
_MAIN = {"article", "main"}
_CONTAINERS = _FURNITURE | _MAIN | {"div", "section", "ul", "ol", "dl", "table", "blockquote", "body"}
_BLOCKS = _CONTAINERS | {
    "p", "br", "hr", "li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "figure",
    "figcaption", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "html", "details",
    "summary", "center", "legend", "option", "video", "audio", "hgroup",
}
#: Words in class, id or role of a container that mark furniture.
_MARKS = re.compile(
    r"(?<![a-z])(ad|ads|advert\w*|banner|breadcrumbs?|comments?|comment\w*|cookies?|consent|copyright|"
    r"disclaimer|footer|form|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|"
    r"notices?|notification|pagination|pager|popup|promo\w*|related|replies|reply|search|share|"
    r"sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|topbar|widget\w*|alert|"
    r"complementary|contentinfo|disqus\w*|hidden)(?![a-z])"
)
_MAIN_MARKS = re.compile(r"(?<![a-z])(article|articlebody|main|main-content|post-content|entry-content)(?![a-z])")
#: What is furniture inside an article too, as a whole name or the start of a longer one.
_INSIDE = re.compile(
    r"(ads?|advert\w*|comments?|repl(?:y|ies)|disqus\w*|related|newsletter|subscribe|signup|social|share|sharing|"
    r"promo\w*|sponsor\w*|cookies?|consent|notices?|sidebar|breadcrumbs?|pagination|pager|popup|modal|banner|"
    r"nav|navbar|navigation|menu|footer|skip|widget|disclaimer|copyright)"
    r"(?:[-_](?:list|section|box|block|wrapper|container|area|form|item|items|banner|bar|links|buttons?|thread|"
    r"slot|unit|notice|posts?|articles?|menu|nav|inner|content|\d+))*"
)
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9-]*")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)\s*(=?)\s*|=")
_BARE = re.compile(r"[^\s>]*")
_NONE = re.compile(r"display\s*:\s*none", re.I)


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of a tag from behind its name on, and the place of its end, -1 without one.

    A quote begins a value only behind an equals sign, as in browsers.
    """
    found: dict[str, str] = {}
    while True:
        at = _GAP.match(page, at).end()
        if at >= len(page):
            return found, -1
        if page[at] == ">":
            return found, at
        name = _ATTRIBUTE.match(page, at)
        at, value = name.end(), ""
        if name[2]:
            quote = page[at : at + 1]
            if quote in ("'", '"') and quote:
                end = page.find(quote, at + 1)
                if end < 0:
                    return found, -1
                value, at = page[at + 1 : end], end + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        if name[1]:
            found.setdefault(name[1].lower(), value)


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, dict[str, str]]]:
    """Start, end, name, whether it closes, and attributes of every tag; comments, hidden elements
    with all they hold and other markup have no name. Linear in the length of the page: a tag that
    never ends makes the rest of the page be read without regard to quotes."""
    at, plain, never = 0, False, set()
    while (start := page.find("<", at)) >= 0:
        mark = page[start : start + 9]
        for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")):
            if mark.startswith(opening):
                end = page.find(closing, start + len(opening))
                at = len(page) if end < 0 else end + len(closing)
                yield start, at, "", False, {}
                break
        else:
            closes = mark.startswith("</")
            name = _NAME.match(page, start + 1 + closes)
            if not name:
                at = start + 1
                continue
            attributes, end = ({}, page.find(">", name.end())) if plain else _attributes(page, name.end())
            if end < 0 and not plain:
                plain, end = True, page.find(">", name.end())
            if end < 0:
                return
            at, tag = end + 1, name[0].lower()
            if tag in _HIDDEN and not closes and page[end - 1] != "/":
                # To the end tag of the name, or without one to the end of the page.
                after = None if tag in never else _HIDDEN[tag].search(page, at)
                if after is None:
                    never.add(tag)
                at = after.end() if after else len(page)
                tag = ""
            yield start, at, tag, closes, attributes


def _kind(name: str, attributes: dict[str, str], around: int) -> int:
    """Of a container, given the kind of what is around it."""
    if around == FURNITURE or name in _FURNITURE:
        return FURNITURE
    if attributes:
        if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
            return FURNITURE
        if _NONE.search(attributes.get("style", "")):
            return FURNITURE
        named = " ".join(attributes.get(x, "") for x in ("class", "id", "role")).lower()
        if around == MAIN or name in _MAIN:
            return FURNITURE if any(_INSIDE.fullmatch(x) for x in named.split()) else MAIN
        if _MARKS.search(named):
            return FURNITURE
        if _MAIN_MARKS.search(named):
            return MAIN
    return MAIN if name in _MAIN else around


def lines(page: str) -> list[tuple[int, str]]:
    """Kind and text of every line of a page, in order."""
    found: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    kind, text, at = OPEN, [], 0

    def flush() -> None:
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if line:
            found.append((kind, line))

    for start, end, name, closes, attributes in _tags(page):
        if start > at:
            text.append(page[at:start])
        at = end
        if name not in _BLOCKS:
            continue
        flush()
        if name not in _CONTAINERS:
            continue
        if not closes:
            if page[end - 2] != "/":
                stack.append((name, kind))
                opened[name] = opened.get(name, 0) + 1
                kind = _kind(name, attributes, kind)
            continue
        while opened.get(name):
            last, kind = stack.pop()
            opened[last] -= 1
            if last == name:
                break
    if at < len(page):
        text.append(page[at:])
    flush()
    return found


def code(line: str) -> int:
    digest = hashlib.blake2b(line.encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def _rows(one: list[int], two: list[int]) -> Iterator[int]:
    """After each line of ``one``, where the length of the longest common subsequence with a
    beginning of ``two`` grows: a bit of 0 at the place where that beginning ends."""
    places: dict[int, int] = {}
    for j, x in enumerate(two):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(two)) - 1
    row = full
    for x in one:
        met = row & places.get(x, 0)
        row = (row + met | row - met) & full
        yield row


def _lengths(one: list[int], two: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``one`` with every beginning of ``two``."""
    row = (1 << len(two)) - 1
    for row in _rows(one, two):
        pass
    bits = np.frombuffer(row.to_bytes(-(-len(two) // 8), "little"), np.uint8)
    grows = np.unpackbits(bits, bitorder="little")[: len(two)] == 0
    return np.concatenate(([0], np.cumsum(grows)))


def _longest(one: list[int], two: list[int]) -> Iterator[int]:
    """Places in ``one`` of a longest common subsequence. Of more than ``PAIRS`` pairs of lines
    ``one`` is halved and ``two`` cut where the lengths of both halves add up to the most."""
    parts = [(0, len(one), 0, len(two))]
    while parts:
        start, end, first, last = parts.pop()
        if start == end or first == last:
            continue
        some, others = one[start:end], two[first:last]
        if len(some) == 1:
            if some[0] in others:
                yield start
            continue
        if len(some) * len(others) > PAIRS:
            half = len(some) // 2
            after = _lengths(some[:half - 1 : -1], others[::-1])[::-1]
            cut = first + int(np.argmax(_lengths(some[:half], others) + after))
            parts += [(start, start + half, first, cut), (start + half, end, cut, last)]
            continue
        rows = list(_rows(some, others))
        i, j = len(some), len(others)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                yield start + i
                j -= 1


def common_lines(one: list[int], two: list[int]) -> set[int]:
    """Places in ``one`` of a longest common subsequence with ``two``, of pages of any size.

    Equal ends are taken off first, then lines that the other does not have.
    """
    start = 0
    while start < min(len(one), len(two)) and one[start] == two[start]:
        start += 1
    end = 0
    while end < min(len(one), len(two)) - start and one[-1 - end] == two[-1 - end]:
        end += 1
    shared = set(range(start)) | set(range(len(one) - end, len(one)))
    known = set(one[start : len(one) - end]) & set(two[start : len(two) - end])
    places = [i for i in range(start, len(one) - end) if one[i] in known]
    other = [x for x in two[start : len(two) - end] if x in known]
    shared.update(places[i] for i in _longest([one[i] for i in places], other))
    return shared


def place(url: str | None) -> tuple[str, str]:
    """Host without www, and path without query, of a URL; a broken one has no host."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return "", url or ""
    return host, parts.path


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host, path and the lines of each page, as codes and kinds."""
    for batch in batches:
        for part in words.slices(batch, "html", words.BATCH // 8):
            hosts, paths = zip(*[place(url) for url in part["url"].to_pylist()])
            found = [lines(page) for page in pc.fill_null(part["html"], "").to_pylist()]
            codes = [[code(text) for _, text in page] for page in found]
            kinds = [bytes(kind for kind, _ in page) for page in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part["_file"], part["_row"], pa.array(hosts, pa.string()), pa.array(paths, pa.string()),
                    pa.array(codes, pa.list_(pa.int64())), pa.array(kinds, pa.binary()),
                ],
                names=["_file", "_row", "host", "path", "codes", "kinds"],
            )


def copies(one: bytes, two: bytes, shared: set[int]) -> bool:
    """Whether a page is a near copy of another, given the kinds of the lines of both and the
    places of shared ones: most lines are shared, or much of the main text, which no template is."""
    if 100 * len(shared) >= NEAR * max(len(one), len(two)):
        return True
    mine, main = one.count(MAIN), sum(one[at] == MAIN for at in shared)
    return main > 0 and 2 * main >= mine or main > 1 and 2 * main >= two.count(MAIN)


def _alike(one: str, two: str) -> int:
    """Length of the common beginning of two paths."""
    for at, (x, y) in enumerate(zip(one, two)):
        if x != y:
            return at
    return min(len(one), len(two))


_OUTLINE = "_file string, _row long, host string, path string, codes array<long>, kinds binary"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pages with ``starts``: whether a page is no copy of the one before it, or of another
    host; NULL for the first page of a task."""
    last = None
    for batch in batches:
        for part in words.slices(batch, "kinds", words.BATCH // 8):
            starts = []
            for page in zip(*[part[name].to_pylist() for name in ("host", "codes", "kinds")]):
                starts.append(None if last is None else _parted(last, page))
                last = page
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(starts, pa.bool_())], names=[*part.schema.names, "starts"]
            )


def _parted(one: tuple, two: tuple) -> bool:
    """Whether two (host, codes, kinds) are of other hosts or no copies of each other."""
    return one[0] != two[0] or not copies(two[2], one[2], common_lines(two[1], one[1]))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages, before = ([tuple(x.values()) for x in batch[name].to_pylist()] for name in ("page", "before"))
        starts = [_parted(one, two) for one, two in zip(before, pages)]
        yield pa.RecordBatch.from_arrays([batch["rank"], pa.array(starts, pa.bool_())], names=["rank", "edge"])


def _ends(ranked: DataFrame) -> DataFrame:
    """(rank, before, after): the last page before the run of a page, and the first one after it."""
    outline = F.struct("host", "codes", "kinds")
    firsts = ranked.where("starts IS NULL").select("rank", outline.alias("page"))  # one a partition
    previous = ranked.select((F.col("rank") + 1).alias("rank"), outline.alias("before"))
    edges = previous.join(F.broadcast(firsts), "rank").select("rank", "page", "before")
    edges = materialize(edges.mapInArrow(_edges, "rank long, edge boolean"), "page-edges")
    starts = ranked.select("rank", "starts").join(F.broadcast(edges), "rank", "left").select(
        "rank", F.floor(F.col("rank") / BLOCK).alias("block"),
        F.when(F.coalesce("starts", "edge", F.lit(True)), F.col("rank")).alias("start"),
    )
    blocks = starts.groupBy("block").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    order = Window.orderBy("block")  # a row for every BLOCK pages
    blocks = blocks.select(
        "block",
        F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.min("low").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"),
    )
    inside = Window.partitionBy("block").orderBy("rank")
    back = Window.partitionBy("block").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        starts.withColumn("first", F.max("start").over(inside))
        .withColumn("next", F.min("start").over(back))
        .join(F.broadcast(materialize(blocks, "page-blocks")), "block")
        .select(
            "rank", (F.coalesce("first", "earlier") - 1).alias("before"),
            F.coalesce("next", "later").alias("after"),
        )
    )


def differing(page: dict, others: list[dict]) -> list[int] | None:
    """Places of the lines of a page that its neighbours share; None if there is no neighbour.

    ``others`` are the pages before and after its run. Those of another host, and copies, are
    passed over.
    """
    shared = None
    for other in sorted(others, key=lambda x: (-_alike(page["path"], x["path"]), x["rank"])):
        if other["host"] != page["host"]:
            continue
        common = common_lines(page["codes"], other["codes"])
        if not copies(page["kinds"], other["kinds"], common):
            same = set(other["codes"])
            # The nearest page is aligned; the other one only has to hold the line.
            shared = common if shared is None else {at for at in shared if page["codes"][at] in same}
    return None if shared is None else sorted(shared)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch, "kinds", words.BATCH // 8):
            found = [
                differing(page, page["others"] or [])
                for page in part.select(["host", "path", "codes", "kinds", "others"]).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [part["_file"], part["_row"], pa.array(found, pa.list_(pa.int32()))],
                names=["_file", "_row", "shared"],
            )


def _differences(outlines: DataFrame) -> DataFrame:
    """(_file, _row, shared): the lines that a page shares with its neighbours, NULL without any.

    All joins have the same form at every size. Pages of a run ask for the same neighbours;
    such a hot page is one row on its side of the join, and the planner splits the other.
    """
    ranked = numbered(
        outlines.where("host <> ''"), "host", "path", "_file", "_row",
        through=lambda rows: rows.mapInArrow(_runs, f"{_OUTLINE}, rank long, starts boolean"),
    )
    asked = _ends(ranked).select("rank", F.explode(F.array("before", "after")).alias("at")).where("at IS NOT NULL")
    other = ranked.select(
        F.col("rank").alias("at"), F.struct("rank", "host", "path", "codes", "kinds").alias("other")
    )
    others = asked.hint("merge").join(other, "at").groupBy("rank").agg(F.collect_list("other").alias("others"))
    return (
        ranked.drop("starts").hint("merge").join(others, "rank", "left")  # two others at most
        .select("_file", "_row", "host", "path", "codes", "kinds", "others")
        .mapInArrow(_compared, "_file string, _row long, shared array<int>")
    )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kinds of the lines of each page, and those that are no furniture as one zstandard frame.

    White space within a line is blanks only, so a line feed parts the lines.
    """
    frames = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for part in words.slices(batch, "html", words.BATCH // 8):
            found = [lines(page) for page in pc.fill_null(part["html"], "").to_pylist()]
            texts = ["\n".join(text for kind, text in page if kind > FURNITURE) for page in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part["_file"], part["_row"], part["page_id"], part["url"],
                    pa.array([bytes(kind for kind, _ in page) for page in found], pa.binary()),
                    pa.array([frames.compress(text.encode()) for text in texts], pa.binary()),
                ],
                names=["_file", "_row", "page_id", "url", "kinds", "packed"],
            )


def _text(kinds: bytes, packed: str, shared: list[int] | None) -> str:
    """The lines of a page that its neighbours do not share, or without any the main ones."""
    places = [at for at, kind in enumerate(kinds) if kind > FURNITURE]
    gone = set(shared or ())
    if shared is None:
        most = max(kinds, default=OPEN)
        gone = {at for at in places if kinds[at] != most}
    return " ".join(text for at, text in zip(places, packed.split("\n")) if at not in gone)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    frames = zstandard.ZstdDecompressor()
    for batch in batches:
        for part in words.slices(batch, "packed", words.BATCH // 32):
            shared = part["shared"].to_pylist()
            rows = zip(part["kinds"].to_pylist(), part["packed"].to_pylist(), shared)
            out = [_text(kinds, frames.decompress(packed).decode(), gone) for kinds, packed, gone in rows]
            yield pa.RecordBatch.from_arrays(
                [part["page_id"], part["url"], pa.array(out, pa.string()),
                 pa.array([len(x or ()) for x in shared], pa.int64())],
                names=["page_id", "url", "text", "n_shared"],
            )


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) for every row of ``pages`` (page_id, url, html).

    ``text`` joins by one blank the lines that the neighbours on the host do not share, but for
    those that structure tells to be furniture. Pages without a URL, alone on their host, or
    with copies on both sides of their run have no neighbour: of these it joins the main lines
    or, without any, the open ones. ``n_shared`` counts the lines shared. NULL and empty html
    gives an empty text. Repeated rows are pages of their own. Other columns are not read.
    """
    rows = located(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    outlines = materialize(
        rows.select("_file", "_row", "url", "html").mapInArrow(_outlines, _OUTLINE), "page-outlines"
    )
    shared = _differences(outlines)
    kept = rows.mapInArrow(
        _kept,
        "_file string, _row long, page_id long, url string, kinds binary, packed binary",
    )
    return (
        kept.join(shared.hint("merge"), ["_file", "_row"], "left")
        .select("page_id", "url", "kinds", "packed", "shared")
        .mapInArrow(_texts, "page_id long, url string, text string, n_shared long")
        .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")
    )

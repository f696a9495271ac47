"""Main text of web pages: nearest-URL differencing beside markup zones.

A page is read into blocks of text, each with the zone its markup puts it in.
Blocks in zones that markup names as furniture (menus, headers, footers,
adverts, forms, scripts, comments) go. Every page is compared with the nearest
other pages by URL path on the same host: lines that they also show, aligned by
longest common subsequence, are template text. On pages without an article
element all of it goes. A page with one gives the blocks in it, less template
lines that are nothing but links (share bars, lists of related pages): a
sentence of an article that its neighbours repeat is still its text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import cut, small_batches

#: Pages in URL order that one task compares.
GROUP = 2_000
#: Ranges that the URL order is sorted in, at most.
RANGES = 10_000
#: A page with so much of both pages' lines in common is a near copy, whose body would be taken for template.
NEAR = 0.8
RAW = frozenset({"script", "style", "noscript", "template", "iframe", "textarea", "noembed", "noframes"})
FURNITURE = frozenset({"nav", "header", "footer", "aside", "form", "menu", "head", "button", "select", "dialog", "svg", "label", "fieldset"})
BODY = frozenset({"article", "main"})
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr"
    " math mi mn mo mrow ms msqrt mroot msub msubsup msup mtext mfrac semantics annotation".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names of furniture in class and id, and names of its place that may stand before them.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice popup modal"
    " sidebar side menu nav navbar navigation breadcrumb breadcrumbs comment comments respond disqus footer header masthead share sharing social related"
    " newsletter subscribe signup login widget".split()
)
PLACES = frozenset("site page main global top bottom left right user reader primary secondary mobile the".split())
#: Names that make even an article element furniture: comments and adverts are often marked up as articles.
REPLIES = frozenset("ad ads advert adverts advertisement sponsor sponsored promo comment comments reply replies related teaser".split())
#: Last parts of compound names whose part before is the mark: an ad-slot, share-buttons, related-posts.
PARTS = frozenset("slot box unit wrapper container content block section bar buttons button links link list posts post articles items item signup form banner notice area panel thread icons".split())
#: Elements that hold others; only their names count in an article.
CONTAINERS = frozenset("div section ul ol dl table figure details".split())
#: Single names that even in an article name furniture.
INSERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion cookie cookies consent gdpr popup modal share sharing social related newsletter subscribe signup login comments respond disqus breadcrumb breadcrumbs navbar navigation pagination".split())
ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"})
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
PART = re.compile(r"[\s_-]+")
WORD = re.compile(r"[^\W_]")


def _named(value: str, marks: frozenset[str]) -> bool:
    """Whether a class or id names furniture: by one whole name, or by a compound that ends in one or in a part of such and has only furniture's names before it."""
    for name in value.lower().split():
        if name in marks:
            return True
        *places, last = PART.split(name)
        if places and (last in marks or last in PARTS and places[-1] in marks) and all(p in marks or p in PLACES for p in places):
            return True
    return False


def _compound(value: str) -> bool:
    """Whether a name of two or more parts names furniture, as ``share-buttons`` does, or a single one that the body of an article has no use for."""
    return any(name in INSERTS or PART.search(name) and _named(name, MARKS) for name in value.lower().split())


def _marked(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is furniture. In an article names count on containers alone, single ones only if they are INSERTS; text elements there stay."""
    if tag in FURNITURE:
        return True
    if tag in ("html", "body") or "=" not in attributes:
        return False
    named = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(attributes)}
    if named.get("role", "").lower() in ROLES:
        return True
    names = [named.get(k, "") for k in ("class", "id")]
    if inside and tag not in BODY:
        return tag in CONTAINERS and any(map(_compound, names))
    return any(_named(n, REPLIES if tag in BODY else MARKS) for n in names)


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name, rest)``: text, open and close tags in order, in time linear in the page.

    Quotes are honoured in tags. If one never closes, tags end at the next ``>`` from then on, quoted or not.
    """
    at, size, quoted, last = 0, len(page), True, page.rfind(">")
    while at < size:
        less = page.find("<", at)
        if less < 0 or less > last:
            # no tag can close any more; a comment or tag that is left open goes
            yield "text", "", page[at:less] if less >= 0 and re.match(r"<[!?/a-zA-Z]", page[less : less + 2]) else page[at:]
            return
        if less > at:
            yield "text", "", page[at:less]
        if page.startswith("<!--", less) or page.startswith("<![CDATA[", less):
            mark = "-->" if page[less + 2] == "-" else "]]>"
            end = page.find(mark, less + 4)
            at = size if end < 0 else end + 3
            continue
        if page[less + 1] in "!?":
            at = page.find(">", less) + 1
            continue
        m = NAME.match(page, less + 1)
        if not m:
            yield "text", "", "<"
            at = less + 1
            continue
        end = m.end()
        while quoted:
            stop = STOP.search(page, end)
            if not stop:
                quoted = False
            elif stop[0] == ">":
                end = stop.start()
                break
            else:
                closing = page.find(stop[0], stop.end())
                quoted = closing >= 0
                end = closing + 1
        if not quoted:
            end = page.find(">", m.end())
        at = end + 1
        tag = m[1].lower()
        if page[less + 1] == "/":
            yield "close", tag, ""
            continue
        yield "open", tag, page[m.end() : end]
        if tag in RAW:
            over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = size if not over else page.find(">", over.end()) + 1 or size


def blocks(page: str) -> list[tuple[str, bool]]:
    """``(text, in_article)`` of each text block outside furniture, in page order, as :func:`linked_blocks` reads them."""
    return [x[:2] for x in linked_blocks(page)]


def linked_blocks(page: str) -> list[tuple[str, bool, bool]]:
    """``(text, in_article, linked)`` of each text block outside furniture, in page order; ``linked`` if all its letters and digits, and there are some, are those of links.

    Inside an article, header elements that hold its heading are part of it, text elements stay whatever their names,
    and containers go by compound names and a few single ones. Labels of controls and titles of drawings are no text. Hidden elements are read like others.
    Unclosed and stray tags are tolerated; character references are decoded and
    white space within a block becomes one space.
    """
    found: list[tuple[str, bool, bool]] = []
    piece: list[str] = []
    words: list[bool] = []  # of each piece with letters or digits: whether it is a link's
    stack: list[tuple[str, bool, bool]] = []  # tag, furniture, article
    opened: dict[str, int] = {}
    gone = within = False

    def close() -> None:
        if piece:
            text = " ".join(entities.unescape("".join(piece)).split())
            piece.clear()
            if text:
                found.append((text, within, bool(words) and all(words)))
        words.clear()

    for kind, tag, rest in _tokens(page):
        if kind == "text":
            if not gone:
                piece.append(rest)
                link = bool(opened.get("a"))
                # text beside links decides by its first word; what has none, like bars between links, doesn't count
                if link not in words and WORD.search(entities.unescape(rest)):
                    words.append(link)
            continue
        if tag not in INLINE:
            close()
        if kind == "close":
            if opened.get(tag):
                while True:
                    popped = stack.pop()[0]
                    opened[popped] -= 1
                    if popped == tag:
                        break
                gone, within = stack[-1][1:] if stack else (False, False)
        elif tag not in VOID and tag not in RAW and not rest.rstrip().endswith("/"):
            gone = gone or (_marked(tag, rest, within) and not (tag == "header" and within))
            within = (within or tag in BODY) and not gone
            stack.append((tag, gone, within))
            opened[tag] = opened.get(tag, 0) + 1
    close()
    return found


def _lengths(mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Longest common subsequence lengths of ``mine`` with each prefix of ``other``."""
    row = np.zeros(len(other) + 1, np.int32)
    for x in mine:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(other == x, row[:-1] + 1, 0)))
    return row


def _aligned(mine: np.ndarray, other: np.ndarray) -> list[int]:
    """Positions of ``mine`` on a longest common subsequence, in space linear in the lines."""
    if not len(mine) or not len(other):
        return []
    if len(mine) == 1:
        return [0] if (other == mine[0]).any() else []
    half = len(mine) // 2
    left, right = _lengths(mine[:half], other), _lengths(mine[half:][::-1], other[::-1])[::-1]
    at = int(np.argmax(left + right))
    return _aligned(mine[:half], other[:at]) + [half + k for k in _aligned(mine[half:], other[at:])]


def shared_lines(mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Mask of the lines of ``mine`` on a longest common subsequence with ``other``. Equal ends need no alignment."""
    shared = np.zeros(len(mine), bool)
    n = min(len(mine), len(other))
    head = int(np.argmin(np.append(mine[:n] == other[:n], False)))
    tail = int(np.argmin(np.append(mine[len(mine) - n + head :][::-1] == other[len(other) - n + head :][::-1], False)))
    shared[:head] = True
    shared[len(mine) - tail :] = True
    rest, theirs = np.arange(head, len(mine) - tail), other[head : len(other) - tail]
    both = rest[np.isin(mine[rest], theirs)]
    shared[both[_aligned(mine[both], theirs[np.isin(theirs, mine[both])])]] = True
    return shared


Page = tuple[str, np.ndarray, np.ndarray]


def is_near(a: Page, b: Page, near: float = NEAR) -> bool:
    """Whether two pages (host, line hashes, line sizes) of one host share at least ``near``, by the sizes of the longer one's lines."""
    return a[0] == b[0] and a[2][shared_lines(a[1], b[1])].sum() >= near * max(a[2].sum(), b[2].sum())


def template_of(page: Page, sides: list[Page], near: float = NEAR) -> np.ndarray:
    """Positions of the lines of ``page`` that the pages beside its run share, if they are of its host and no near copies of it."""
    gone = np.zeros(len(page[1]), bool)
    for other in sides:
        if other[0] == page[0]:
            shared = shared_lines(page[1], other[1])
            if page[2][shared].sum() < near * max(page[2].sum(), other[2].sum()):
                gone |= shared
    return np.flatnonzero(gone)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")


READ = T.StructType([T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("guarded", T.ArrayType(T.BooleanType())), T.StructField("linked", T.ArrayType(T.BooleanType()))])


def read_blocks(page: Column) -> Column:
    """Texts of the blocks of a page, whether an article holds each and whether it is all links; null pages have none."""

    @F.arrow_udf(READ)
    def read(pages: pa.Array) -> pa.Array:
        rows = []
        for x in pages:
            found = linked_blocks(x.as_py() or "")
            rows.append({"texts": [t for t, _, _ in found], "guarded": [g for _, g, _ in found], "linked": [k for _, _, k in found]})
        return pa.array(rows, pa.struct([("texts", pa.list_(pa.string())), ("guarded", pa.list_(pa.bool_())), ("linked", pa.list_(pa.bool_()))]))

    return read(page)


def _numbered(df: DataFrame, by: list[str], group: int) -> DataFrame:
    """Add ``at``, each row's place in the order of ``by``, from 0: ranges are numbered on their own, after the sizes of the ranges before."""
    # more ranges than this only cost tasks: a range is sorted on disk if need be
    parts = min(max(1, df.count() // group), RANGES)
    ranged = cut(df.repartitionByRange(parts, *by).withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    begins = sizes.select(F.col("range").alias("r"), (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("begin"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(*by)) - 1
    return ranged.withColumn("within", within).join(begins, F.col("range") == F.col("r")).withColumn("at", F.col("begin") + F.col("within")).drop("range", "within", "r", "begin")


def _pages(part: pa.Table) -> list[Page]:
    columns = (part.column(c).to_pylist() for c in ("host", "lines", "sizes"))
    return [(h, np.array(x, np.int64), np.array(z, np.int64)) for h, x, z in zip(*columns, strict=True)]


def _runs(placed: DataFrame, group: int, near: float) -> tuple[DataFrame, DataFrame]:
    """(pages with ``begins``, tasks with the places beside them).

    A run is pages in a row of which each is a near copy of the one before, however many; ``begins`` marks its first. ``left`` and ``right``
    are the places before the run of a task's first page and after that of its last one.
    """
    task = F.floor(F.col("at") / group).cast("long")
    # each task also gets the page before its first one
    dealt = placed.withColumn("task", F.explode(F.array_distinct(F.array(task, F.floor((F.col("at") + 1) / group).cast("long")))))

    def mark(part: pa.Table) -> pa.Table:
        part = part.sort_by("at")
        rows, places, number = _pages(part), part.column("at").to_pylist(), part.column("task")[0].as_py()
        begins = [k == 0 or not is_near(rows[k - 1], rows[k], near) for k in range(len(rows))]
        own = [at // group == number for at in places]
        return part.append_column("begins", pa.array(begins, pa.bool_())).filter(pa.array(own))

    marked = cut(dealt.groupBy("task").applyInArrow(mark, "host string, lines array<long>, sizes array<int>, open boolean, at long, task long, begins boolean"))
    # a run is known by the place it begins at: for each task the last beginning before it, then the end of the run that crosses its border
    tasks = marked.groupBy("task").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min(F.when(F.col("begins"), F.col("at"))).alias("opens"), F.max(F.when(F.col("begins"), F.col("at"))).alias("opened"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("task").rowsBetween(1, Window.unboundedFollowing)
    start = F.when(F.col("opens") == F.col("first"), F.col("first")).otherwise(F.max("opened").over(before))
    sides = tasks.select("task", (start - 1).alias("left"), F.min("opens").over(after).alias("right"))
    return marked, sides


def template_lines(pages: DataFrame, group: int = GROUP, near: float = NEAR) -> DataFrame:
    """``(host, lines, gone)``: positions of the lines that neighbours share, of ``open`` pages with any.

    ``pages`` has host, path, url, lines (hashes), sizes and open; all of them are compared. Pages of a host with equal lines are
    one page, at the place of the first URL among theirs, so copies are no neighbours. The order is that of host, path and
    whole URL, whatever the size of a host. Near copies in a row are one run, of any length, whose pages all have the pages just
    before and just after it as their neighbours. Tasks take ``group`` pages in a row and those beside their first and last runs.
    """
    first = F.min(F.struct("path", "url")).alias("first")
    single = pages.groupBy("host", "lines").agg(first, F.first("sizes").alias("sizes"), F.bool_or("open").alias("open")).select("host", "first.*", "lines", "sizes", "open")
    placed = _numbered(single.withColumn("mark", F.xxhash64("lines")), ["host", "path", "url", "mark"], group).select("host", "lines", "sizes", "open", "at")
    marked, sides = _runs(placed, group, near)
    wanted = sides.select(F.col("task").alias("for"), F.explode(F.array_compact(F.array("left", "right"))).alias("place"))
    beside = wanted.join(marked, F.col("place") == F.col("at")).select("host", "lines", "sizes", "open", "at", F.col("for").alias("task"), "begins")
    dealt = marked.select("host", "lines", "sizes", "open", "at", "task", "begins").unionByName(beside)

    def compare(part: pa.Table) -> pa.Table:
        part = part.sort_by("at")
        rows, places, number = _pages(part), part.column("at").to_pylist(), part.column("task")[0].as_py()
        own = [k for k, at in enumerate(places) if at // group == number]
        begins = part.column("begins").to_pylist()
        runs = [k for k in own if begins[k] or k == own[0]] + [own[-1] + 1]
        gone = {}
        for a, b in zip(runs, runs[1:], strict=False):
            sides = [rows[k] for k in (a - 1, b) if 0 <= k < len(rows)]
            gone |= {k: template_of(rows[k], sides, near) for k in range(a, b)}
        loose = part.column("open").to_pylist()
        kept = [k for k in own if loose[k] and len(gone[k])]
        hosts, lines = part.column("host").take(pa.array(kept, pa.int64())), part.column("lines").take(pa.array(kept, pa.int64()))
        return pa.table({"host": hosts, "lines": lines, "gone": pa.array([gone[k].astype(np.int32) for k in kept], pa.list_(pa.int32()))})

    return dealt.groupBy("task").applyInArrow(compare, "host string, lines array<long>, gone array<int>")


def extract_pages(df: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id", group: int = GROUP, near: float = NEAR) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``df``.

    All pages are compared with their neighbours. Pages with an ``article`` or ``main`` element give
    its text less the shared lines that are all links; other pages give
    their unfurnished blocks less all shared lines. Null
    html gives an empty text; null URLs form a host of their own. Repeated
    rows each give a row, and equal pages of a host share one comparison. Pages are read once,
    and their blocks kept in the scratch folder. An empty table gives no rows; other columns of ``df`` are not read.
    """
    small_batches(df.sparkSession)
    pages = df.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    at = F.coalesce(F.col("url").cast("string"), F.lit(""))
    read = cut(pages.select("page_id", "url", url_host(at).alias("host"), url_path(at).alias("path"), read_blocks(F.col("html")).alias("b")).select("page_id", "url", "host", "path", "b.*"))
    closed = F.exists("guarded", lambda g: g)
    # blocks that go if neighbours share them: all of a page without an article, those that are all links in an article
    loose = F.when(closed, F.zip_with("guarded", "linked", lambda g, k: g & k)).otherwise(F.transform("guarded", lambda _: F.lit(True)))
    lined = read.withColumns({"lines": F.transform("texts", lambda t: F.xxhash64(t)), "loose": loose})
    shown = F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")
    marked = lined.where(F.size("texts") > 0).select("host", "path", shown, "lines", F.transform("texts", F.char_length).alias("sizes"), F.exists("loose", lambda x: x).alias("open"))
    # only pages that may lose a line are looked up, or all texts would travel to the lines that their articles keep
    drops = cut(template_lines(marked, group, near).select(F.col("host").alias("h"), F.col("lines").alias("l"), "gone"))
    joined = lined.join(drops, (F.col("host") == F.col("h")) & (F.col("lines") == F.col("l")), "left")
    gone = F.coalesce("gone", F.expr("cast(array() as array<int>)"))
    stays = lambda _, k: ~(F.array_contains(gone, k) & F.get("loose", k)) & (~closed | F.get("guarded", k))
    return joined.select("page_id", "url", F.array_join(F.filter("texts", stays), " ").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))

"""Main text of web pages, by nearest-URL page differencing.

A page is read as lines: one for each block of text, menus and footers included,
each with a mark that says whether markup already names it boilerplate. Pages of
a host are put in order of their URL path (of pages alike in all lines, the first
stands for all), and each is aligned, by longest common subsequence of lines, with
the nearest two pages on either side that are no copies of it. Pages are copies
where nine tenths of either's text is shared. Lines shared with a neighbour are
the host's, not the page's, and are deleted. Inside an article that markup names,
a line needs more evidence, since articles quote one another: it goes if two
neighbours, whose articles differ from each other too, have it at the same place,
counted from the first or the last line.

Only hashes of lines travel to the neighbour. The order within a host is found
on small rows: ranges of (host, path, page) are sorted apart, and only the rows
at the ends of each range are looked at again to join them up.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundloom.llm.common import cut, kept
from groundloom.llm.urls import url_parts

# Element names and the words by which class, id and role name boilerplate.
RAW = "script|style|noscript|template|textarea|title|iframe|svg|select|object|canvas|xmp"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
) - {"br"}
DROP = frozenset("aside button dialog footer form head label menu nav".split())
HINTS = frozenset(
    "ad ads adsbygoogle advert advertisement advertising adverts alert aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disqus footer gdpr hidden masthead menu modal nav navbar navigation newsletter notice notices overlay paywall popup promo promoted recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
MAIN = frozenset(("article", "main"))

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
OPEN = re.compile(r"<(?!!--|!\[CDATA\[)")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def _named_boilerplate(attributes: str) -> bool:
    if not attributes or attributes.isspace():
        return False
    if HIDDEN.search(attributes):
        return True
    names = " ".join("".join(m) for m in NAMED.findall(attributes)).lower()
    return any(w in HINTS for w in re.split(r"[^a-z0-9]+", names))


def closed(page: str) -> str:
    """page with each < after the last > written as text, but for comments: no tag can end there, and looking for its end again and again takes long."""
    at = page.rfind(">") + 1
    return page[:at] + OPEN.sub("&lt;", page[at:])


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """(text, place) for each block: place is 0 for boilerplate, 1 for other text, 2 for text inside the article."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    # Open elements: name, whether text below is boilerplate, whether it is inside the article.
    open_: list[tuple[str, bool, bool]] = [("", False, False)]
    page = closed(page or "")

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                _, boiler, main = open_[-1]
                out.append((text, 0 if boiler else 2 if main else 1))

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        if name in ("br", "td", "th"):
            held.append(" ")
        if name in BLOCKS:
            flush()
        if m[2] or m[5]:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i][0] == name:
                    if name not in BLOCKS and any(o[1] != open_[-1][1] for o in open_[i - 1 :]):
                        flush()
                    del open_[i:]
                    break
        elif name not in VOID:
            if name in BLOCKS and open_[-1][0] == "p":
                open_.pop()
            attributes = m[4] or m[7] or ""
            if attributes.rstrip().endswith("/") and name not in BLOCKS:
                continue
            _, boiler, main = open_[-1]
            if name in MAIN and not main:  # whatever the names around it say
                boiler = bad = False
            else:
                bad = name in DROP or (name == "header" and not main) or (name not in ("html", "body") and _named_boilerplate(attributes))
            if bad and not boiler:
                flush()
            open_.append((name, boiler or bad, main or name in MAIN))
    held.append(page[at:])
    flush()
    return out


def keys_of(lines: list[tuple[str, int]]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63) for t, _ in lines]


#: Cells of an alignment table; longer stretches are split first.
CELLS = 4_000_000


def _lengths(a: list[int], b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequence of a with each head of b, one row at a time."""
    row = np.zeros(len(b) + 1, np.int64)
    for k in a:
        step = np.where(b == k, row[:-1] + 1, 0)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], step))
    return row


def _aligned(a: list[int], b: list[int], cells: int) -> list[tuple[int, int]]:
    """Places in a and b of a longest common subsequence. Large tables are halved (Hirschberg), so memory stays linear."""
    if not a or not b:
        return []
    if len(a) * len(b) > cells and len(a) > 1:
        half, other = len(a) // 2, np.array(b)
        at = int(np.argmax(_lengths(a[:half], other) + _lengths(a[:half - 1:-1], other[::-1])[::-1]))
        return _aligned(a[:half], b[:at], cells) + [(i + half, j + at) for i, j in _aligned(a[half:], b[at:], cells)]
    table = [[0] * (len(b) + 1)]
    for k in reversed(a):
        below, row = table[-1], [0] * (len(b) + 1)
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if b[j] == k else max(below[j], row[j + 1])
        table.append(row)
    table.reverse()
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def matches(mine: list[int], other: list[int], cells: int = CELLS) -> list[tuple[int, int]]:
    """Places in mine and other of a longest common subsequence.

    Common heads and tails are in any such subsequence; a table is needed only
    for what lies between.
    """
    n, m = len(mine), len(other)
    head = 0
    while head < min(n, m) and mine[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and mine[n - 1 - tail] == other[m - 1 - tail]:
        tail += 1
    both = set(mine[head : n - tail]) & set(other[head : m - tail])
    a = [(i, k) for i, k in enumerate(mine[head : n - tail], head) if k in both]
    b = [(j, k) for j, k in enumerate(other[head : m - tail], head) if k in both]
    between = [(a[i][0], b[j][0]) for i, j in _aligned([k for _, k in a], [k for _, k in b], cells)]
    return [*((i, i) for i in range(head)), *between, *((n - i, m - i) for i in range(tail, 0, -1))]


def shared_lines(mine: list[int], other: list[int]) -> list[int]:
    """Places of the lines of mine in a longest common subsequence with other."""
    return [i for i, _ in matches(mine, other)]


def own_place(lines: list[tuple[str, int]]) -> int:
    """The place of the lines to return: the article where markup names one, else all that isn't boilerplate."""
    return 2 if any(p == 2 for _, p in lines) else 1


def main_text(lines: list[tuple[str, int]], shared: set[int]) -> str:
    place = own_place(lines)
    return "\n\n".join(t for i, (t, p) in enumerate(lines) if p == place and i not in shared)


#: Neighbours on either side; neighbours that must share a line of a named article.
NEAR, SEVERAL = 2, 2
#: A page as its neighbours see it: the hashes of its lines, and the length of those to return (others 0). form is a hash of both.
SEEN = "page_id bigint, mark bigint, host string, path string, form bigint, keys array<bigint>, sizes array<int>, needs int"
#: Lines shared with a neighbour (end false), or a page at the end of its range with the neighbours it has.
DIFF = "host string, path string, form bigint, part int, end boolean, shared array<int>, keys array<bigint>, sizes array<int>, needs int, before int, after int"


def seen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            lines = lines_of(r.html)
            place, keys = own_place(lines), keys_of(lines)
            sizes = [len(t) if p == place else 0 for t, p in lines]
            form = xxhash.xxh3_64_intdigest(np.array(keys + sizes, np.int64).tobytes()) - (1 << 63)
            out.append((r.page_id, r.mark, r.host, r.path, form, keys, sizes, SEVERAL if place == 2 else 1))
        yield pd.DataFrame(out, columns=["page_id", "mark", "host", "path", "form", "keys", "sizes", "needs"]).astype({"page_id": "Int64"})


class Page:
    __slots__ = ("host", "path", "form", "part", "keys", "sizes", "needs", "before", "after")

    def __init__(self, r) -> None:
        self.host, self.path, self.form, self.part, self.needs = r.host, r.path, r.form, r.part, r.needs
        self.keys, self.sizes, self.before, self.after = list(r.keys), list(r.sizes), r.before, r.after

    def ranks(self) -> dict[int, tuple[int, int]]:
        """The number of each line to return, from the first and from the last."""
        own = [i for i, n in enumerate(self.sizes) if n]
        return {i: (k, len(own) - k) for k, i in enumerate(own)}

    def loses(self, places: list[int]) -> tuple:
        return (self.host, self.path, self.form, self.part, False, places, None, None, self.needs, 0, 0)

    def at_end(self) -> tuple:
        return (self.host, self.path, self.form, self.part, True, None, self.keys, self.sizes, self.needs, self.before, self.after)


def _pair(a: Page, b: Page) -> tuple[bool, list[int], list[int]]:
    """Whether two pages are copies, and the lines to return that each shares with the other."""
    both = matches(a.keys, b.keys)
    mine, its = [i for i, _ in both if a.sizes[i]], [j for _, j in both if b.sizes[j]]
    copies = any(10 * sum(x.sizes[i] for i in s) > 9 * sum(x.sizes) for x, s in ((a, mine), (b, its)))
    if not copies and SEVERAL in (a.needs, b.needs):
        x, y = a.ranks(), b.ranks()
        fixed = [(i, j) for i, j in both if i in x and j in y and (x[i][0] == y[j][0] or x[i][1] == y[j][1])]
        mine = [i for i, _ in fixed] if a.needs == SEVERAL else mine
        its = [j for _, j in fixed] if b.needs == SEVERAL else its
    return copies, mine, its


def _walk(pages: Iterator[Page], inner: bool) -> Iterator[tuple]:
    """Rows of DIFF for pages in order. inner: one range; else the ends of all ranges, whose pages have met those of their own range."""
    # Runs of copies, the last touched at the end: the last page of each, and its pages that wait for later neighbours.
    live: list[tuple[Page, list[Page]]] = []
    host = first = None
    heads: list[Page] = []
    starts = 0
    for r in pages:
        if r.host != host:
            host, live = r.host, []
            first = first or host
        waiting: list[Page] = []
        others = []
        for last, waits in reversed(live):
            copies, mine, its = _pair(last, r)
            if copies:
                waiting += waits
                continue
            others.append((last, waits, mine))
            if r.before < NEAR and (inner or last.part != r.part):
                r.before += 1
                yield r.loses(its)
        if len(others) == len(live):  # a new run; the pages that wait have met all others
            starts += 1
            for last, waits, mine in others:
                for x in waits:
                    if inner or x.part != r.part:
                        x.after += 1
                        yield x.loses(mine if x is last else _pair(x, r)[1])
                waits[:] = [x for x in waits if x.after < NEAR]
            heads += [r] * (host == first and (starts <= NEAR + 1 or r.before < NEAR))
        else:
            heads += [r] * (host == first and r.before < NEAR)
        others.reverse()
        live = [(last, waits) for i, (last, waits, _) in enumerate(others) if waits or len(others) - i <= NEAR]
        live.append((r, [*waiting, *[r] * (r.after < NEAR)]))
    if inner:
        ends = [*heads, *(x for last, waits in live for x in (last, *waits))]
        yield from (x.at_end() for x in {id(x): x for x in ends}.values())


def _pages(frames: Iterator[pd.DataFrame]) -> Iterator[Page]:
    for f in frames:
        yield from map(Page, f.itertuples(index=False))


def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    names = ["host", "path", "form", "part", "end", "shared", "keys", "sizes", "needs", "before", "after"]
    while out := list(islice(rows, 2000)):
        yield pd.DataFrame(out, columns=names)


def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield from _frames(_walk(_pages(frames), True))


def across(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield from _frames(_walk(_pages(frames), False))


#: A template's line stands in so many of a host's articles at least, as a share and as a number, and of these in so many at one place.
OFTEN, FEWEST, FIXED = 0.1, 5, 0.9


def templates(forms: DataFrame, wanted: DataFrame) -> DataFrame:
    """host, key: of the wanted lines those that many of the host's articles have at one place, counted from the first or from the last line.

    A passage that articles quote stands now here, now there, and stays, as do
    lines that only a few articles share, such as copies of one another.
    Only hashes, places and counts are dealt out, summed before they are.
    """
    own_ = F.filter(F.arrays_zip("keys", "sizes"), lambda x: x["sizes"] > 0)
    each = forms.where(F.col("needs") == SEVERAL).select("host", F.size(own_).alias("n"), F.posexplode(own_).alias("first", "x"))
    each = each.select("host", F.col("x.keys").alias("key"), "first", (F.col("n") - F.col("first")).alias("last")).join(wanted, ["host", "key"])
    articles = forms.where(F.col("needs") == SEVERAL).groupBy("host").agg(F.count(F.lit(1)).alias("articles"))
    total = each.groupBy("host", "key").agg(F.count(F.lit(1)).alias("all")).join(articles, "host").where(F.col("all") >= F.greatest(F.lit(FEWEST), OFTEN * F.col("articles")))
    at = each.select("host", "key", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("first").alias("place")), F.struct(F.lit(1).alias("end"), F.col("last").alias("place")))).alias("x"))
    most = at.groupBy("host", "key", "x").agg(F.count(F.lit(1)).alias("c")).groupBy("host", "key").agg(F.max("c").alias("c"))
    return total.join(most, ["host", "key"]).where(F.col("c") >= FIXED * F.col("all")).select("host", "key")


def neighbours(pages: DataFrame) -> DataFrame:
    """page_id, mark, shared: for pages that lose lines, the places of those."""
    rows = kept(pages.mapInPandas(seen, SEEN), "seen")
    forms = rows.where(F.col("host") != "").groupBy("host", "form").agg(F.min("path").alias("path"), *(F.first(c).alias(c) for c in ("keys", "sizes", "needs")))
    order = ["host", "path", "form"]
    ranges = cut(forms.repartitionByRange(*order).sortWithinPartitions(*order))
    none = F.lit(0).alias("before"), F.lit(0).alias("after")
    diff = kept(ranges.select("*", F.spark_partition_id().alias("part"), *none).mapInPandas(compared, DIFF), "diff")
    ends = diff.where("end").repartition(1).sortWithinPartitions(*order)  # a few rows a range; of a run of copies, all that wait for a neighbour
    found = diff.where("not end").unionByName(ends.mapInPandas(across, DIFF)).select("host", "form", "needs", F.explode("shared").alias("line"))
    lines = kept(found.groupBy("host", "form", "needs", "line").agg(F.count(F.lit(1)).alias("n")).where("n >= needs"), "lines")
    named = lines.where(F.col("needs") == SEVERAL).join(forms.select("host", "form", "keys"), ["host", "form"]).select("host", "form", "needs", "line", F.get("keys", F.col("line")).alias("key"))
    fixed = named.join(templates(forms, named.select("host", "key").distinct()), ["host", "key"]).select("host", "form", "needs", "line")
    lines = lines.where(F.col("needs") != SEVERAL).select("host", "form", "needs", "line").unionByName(fixed)
    gone = lines.groupBy("host", "form").agg(F.collect_list("line").alias("shared"))
    return rows.join(gone, ["host", "form"]).select("page_id", "mark", "shared").dropDuplicates(["page_id", "mark"])


def texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        text = [main_text(lines_of(h), set(s) if s is not None else set()) for h, s in zip(f["html"], f["shared"], strict=True)]
        yield pd.DataFrame({"page_id": f["page_id"].astype("Int64"), "url": f["url"], "text": text})


#: Rows of lines to delete that are broadcast at most; beyond it, pages are dealt out to meet them.
FEW = 20_000


def extract_main(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages.

    A null html gives an empty text. Pages whose url is null or has no host have
    no neighbours. Repeated rows give repeated results; copies of a page are no
    neighbours of it. Ties of host and path are ordered by a hash of the lines. An empty table gives no rows; only page_id, url and html are read.
    A hot host is sorted over as many ranges as it needs.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", "url", "html", F.xxhash64("url", "html").alias("mark"))
    lost = cut(neighbours(rows.select("page_id", "mark", host.alias("host"), path.alias("path"), "html")))
    few = lost.count() <= FEW
    lost = lost.withColumnsRenamed({"page_id": "_id", "mark": "_mark"})
    met = rows.join(F.broadcast(lost) if few else lost, rows["page_id"].eqNullSafe(F.col("_id")) & (rows["mark"] == F.col("_mark")), "left")
    out = met.select("page_id", "url", "html", "shared").mapInPandas(texts, "page_id bigint, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))

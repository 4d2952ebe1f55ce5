"""Main text of HTML pages, by differencing pages with near URLs, checked by structure.

A page is cut into lines: text between block-level tags, character references decoded,
white space collapsed. Pages are ordered by host, URL path and id. Each is paired with a
page of other content beside it in that order, the one whose path shares the longer
prefix (of equals the one before it); the lines of both are aligned by longest common
subsequence, and lines that both have are deleted.

Structure has a veto on both sides. Lines inside article or main stay though another
page has them, as articles repeat lines of other articles; lines of elements that name
what surrounds a text (navigation, header, footer, aside, form, adverts, notices,
comments of readers) go though no other page has them, as menus and adverts differ from
page to page. An article's own header is part of it. A class or id counts if all its
words name surroundings, or places on a page besides, and only on elements that hold blocks.

A neighbour is a copy if differencing would leave less than COPY of the page's text; then
the neighbour on the other side decides, and if that's a copy too, no line goes by
differencing.

The order is cut into ranges, as even as Spark's, and each range also gets the pages of
other content nearest to its ends, found from keys and hashes alone. So a page's
neighbours don't depend on partitions, and a hot host or path spreads over ranges. Each
task streams its rows and holds three pages and the keys of one run of equal pages.

Defined cases: null html gives an empty text; null url is the empty host and path;
a page whose host has no other content keeps its open lines; equal pages give equal
texts; rows that repeat an id are pages of their own; a page is read whole, however
long; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from math import ceil, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualweave.session import cut

OPEN, CONTENT, BOILERPLATE = 0, 1, 2
#: Elements that start and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template svg math canvas iframe object audio video select textarea button".split())
#: Elements that hold what surrounds the main text.
AROUND = frozenset("nav header footer aside form menu dialog head".split())
#: Words of class, id and role values that name what surrounds the main text.
AROUND_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disqus "
    "footer header login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promotion related reply replies "
    "respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that only say where on a page something is.
PLACE_WORDS = frozenset("site page main top bottom left right box block area section wrap wrapper container list bar panel item inner outer global primary secondary user reader".split())
#: Elements whose class, id and role count: those that hold blocks.
HOLDERS = frozenset("div section ul ol dl table aside nav header footer form fieldset details center".split())
COPY = 0.05
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|</?[a-zA-Z][^>]*>|[^<]+|<", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")
#: Elements that a new block element closes if they are open.
CLOSED_BY_BLOCK = frozenset({"p"})


def _around(name: str, attributes: str, inside: int) -> bool:
    if name in AROUND:
        return name != "header" or inside != CONTENT
    if "=" not in attributes or name not in HOLDERS:
        return False
    tokens = " ".join("".join(m) for m in NAMES.findall(attributes)).lower().split()
    parts = [frozenset(re.findall(r"[a-z]+", t)) for t in tokens]
    return any(p & AROUND_WORDS and p <= AROUND_WORDS | PLACE_WORDS for p in parts)


def blocks(html: str | None) -> tuple[list[str], list[int]]:
    """Texts of the blocks in page order, and their roles."""
    texts: list[str] = []
    roles: list[int] = []
    pending: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements with the role inside each
    role, at, page = OPEN, 0, html or ""

    def flush() -> None:
        if pending:
            text = SPACE.sub(" ", "".join(pending)).strip()
            if text:
                texts.append(text)
                roles.append(role)
            pending.clear()

    while at < len(page):
        m = TOKEN.match(page, at)
        token, name = m[0], (m[2] or "").lower()
        at = m.end()
        if not name:
            if token[0] != "<" or token == "<":
                pending.append(entities.unescape(token))
        elif m[1]:  # an end tag closes its element and all inside it
            if name in BLOCKS:
                flush()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                inner = stack[depth:]
                if name in BLOCKS or all(x not in BLOCKS for x, _ in inner):
                    del stack[depth:]
                    if stack[-1:] and stack[-1][1] != role or not stack and role != OPEN:
                        flush()
                        role = stack[-1][1] if stack else OPEN
        elif name in SILENT:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
                pending.append(" ")
        else:
            if name in BLOCKS:
                flush()
                if stack and stack[-1][0] in CLOSED_BY_BLOCK or name == "p" and any(x == "p" for x, _ in stack):
                    while any(x in CLOSED_BY_BLOCK for x, _ in stack):
                        stack.pop()
                    role = stack[-1][1] if stack else OPEN
                elif name == "body":
                    stack.clear()
                    role = OPEN
            elif name in ("br", "img"):
                pending.append(" ")
            if name not in VOID:
                inside = BOILERPLATE if role == BOILERPLATE or _around(name, m[3] or "", role) else CONTENT if name in ("article", "main") else role
                if inside != role:
                    flush()
                stack.append((name, inside))
                role = inside
    flush()
    return texts, roles


def lcs(a: list[str], b: list[str]) -> list[int]:
    """Indexes in a of a longest common subsequence with b (Hunt-Szymanski: sparse in matches)."""
    where: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple[int, tuple | None]] = []
    for i, x in enumerate(a):
        for j in where.get(x, ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


Page = tuple[list[str], list[int]]


def difference(own: Page, neighbours: list[Page]) -> list[str]:
    """The page's lines without those that the first neighbour that is no copy has too, but for the vetoes of structure."""
    texts, roles = own
    stay = {i for i, r in enumerate(roles) if r != BOILERPLATE}
    before = sum(len(texts[i]) for i in stay)
    for near in neighbours:
        left = stay - {i for i in lcs(texts, near[0]) if roles[i] != CONTENT}
        if sum(len(texts[i]) for i in left) >= COPY * before:
            stay = left
            break
    return [texts[i] for i in sorted(stay)]


def by_nearness(path: str, before: tuple[str, Page] | None, after: tuple[str, Page] | None) -> list[Page]:
    """The pages beside a path, the one with the longer common prefix first, of equals the one before. Each: path, page."""
    some = [(-_common(path, x[0]), k, x[1]) for k, x in enumerate((before, after)) if x is not None]
    return [page for _, _, page in sorted(some, key=lambda n: n[:2])]


def _paired(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come ordered by range, host, path and id; a run of equal pages is written once the next page is known."""
    columns = ["page_id", "url", "text", "n_chars"]
    mark = before = run = None  # range and host; the run before, with its last path and page; this one, with its rows
    out: list[tuple] = []

    def write(after: tuple[str, Page] | None) -> None:
        known: dict[tuple[bool, bool], str] = {}
        for page_id, url, path, guest in run[2]:
            if not guest:
                near = by_nearness(path, before, after)
                first = (bool(near), bool(near) and before is not None and near[0] is before[1])
                if first not in known:
                    known[first] = "\n".join(difference(run[1], near))
                out.append((page_id, url, known[first], len(known[first])))

    for pdf in source:
        for row in pdf.itertuples(index=False):
            here = (row.part, row.host)
            if here != mark or row.content != run[0]:
                page = blocks(row.html)
                if run is not None:
                    write((row.path, page) if here == mark else None)
                before = (run[2][-1][2], run[1]) if here == mark else None
                mark, run = here, (row.content, page, [])
            run[2].append((row.page_id, row.url, row.path, row.guest))
        if len(out) >= 200:
            yield pd.DataFrame(out, columns=columns)
            out = []
    if run is not None:
        write(None)
    yield pd.DataFrame(out, columns=columns)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    part = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(part, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


_ORDER = ["host", "path", "page_id", "url", "content"]


def _ends(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row of each of the first two and last two runs of equal pages of a range, whose keys come in order; end: 0, 1 and -2, -1."""
    first: list[tuple] = []
    last: list[tuple] = []
    part = None
    for pdf in source:
        for row in pdf.itertuples(index=False):
            part = row.part
            if not last or (row.host, row.content) != (last[-1].host, last[-1].content):
                last = [*last[-1:], row]
                first = [*first, row][:2]
            else:
                last[-1] = row
    rows = [(part, k, r.host, r.content, r.mark) for k, r in enumerate(first)] + [(part, k - len(last), r.host, r.content, r.mark) for k, r in enumerate(last)]
    yield pd.DataFrame(rows, columns=["part", "end", "host", "content", "mark"])


def _guests(ends: list) -> list[tuple[int, int]]:
    """(mark, part) of rows that a range needs from others: the two nearest runs before and after it, on its own host."""
    by_part: dict[int, dict[int, tuple]] = {}
    for r in ends:
        by_part.setdefault(r.part, {})[r.end] = r
    parts, found = sorted(by_part), set()
    for order, near, far in ((parts, (-2, -1), 0), (parts[::-1], (1, 0), -1)):
        seen: list = []  # the two runs met last, the nearest one at the end
        for p in order:
            found |= {(r.mark, p) for r in seen if r.host == by_part[p][far].host}
            for r in (by_part[p][e] for e in near if e in by_part[p]):
                if seen and (r.host, r.content) == (seen[-1].host, seen[-1].content):
                    seen[-1] = r
                else:
                    seen = [*seen[-1:], r]
    return sorted(found)


def _part(bounds: list[tuple]) -> Column:
    """How many bounds (host, path, page_id) are at most a row's key, by two levels of comparison."""
    if not bounds:
        return F.lit(0)
    key = F.struct(F.col("host").alias("h"), F.col("path").alias("p"), F.col("place").alias("i"))
    literal = lambda b: F.struct(F.lit(b[0]).alias("h"), F.lit(b[1]).alias("p"), F.lit(b[2]).cast("long").alias("i"))
    step = ceil(sqrt(len(bounds)))
    groups = [F.array(*map(literal, bounds[i : i + step])) for i in range(0, len(bounds), step)]
    at_most = lambda values: F.size(F.filter(values, lambda b: b <= key))
    coarse = at_most(F.array(*map(literal, bounds[::step])))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + at_most(F.get(F.array(*groups), coarse - 1))).cast("int")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = keyed.withColumns({"content": F.xxhash64("html"), "place": F.coalesce("page_id", F.lit(-(1 << 63)))}).withColumn("mark", F.xxhash64(*_ORDER))
    light = keyed.drop("html").repartitionByRange(ranges, "host", "path", "place").sortWithinPartitions(*_ORDER)
    light = cut(light.withColumn("part", F.spark_partition_id()))
    # Bounds and guests: some rows a range, whatever the size of the table.
    bounds = sorted((r.k.host, r.k.path, r.k.place) for r in light.groupBy("part").agg(F.min(F.struct("host", "path", "place")).alias("k")).collect())
    guests = _guests(light.mapInPandas(_ends, "part int, end int, host string, content long, mark long").collect())
    parts = sorted({r.part for r in light.select("part").distinct().collect()})
    number = {p: k for k, p in enumerate(parts)}
    invited = spark.createDataFrame([(m, number[p]) for m, p in guests], "mark long, to int").groupBy("mark").agg(F.collect_list("to").alias("others"))
    own = F.struct(_part(bounds[1:]).alias("part"), F.lit(False).alias("guest"))
    sent = F.transform(F.coalesce("others", F.array().cast("array<int>")), lambda p: F.struct(p.alias("part"), F.lit(True).alias("guest")))
    placed = keyed.join(F.broadcast(invited), "mark", "left").withColumn("at", F.explode(F.concat(F.array(own), sent)))
    dealt = placed.select("page_id", "url", "host", "path", "html", "content", F.col("at.part").alias("part"), F.col("at.guest").alias("guest"))
    ordered = dealt.repartitionByRange(max(1, len(parts)), "part").sortWithinPartitions("part", *_ORDER)
    return ordered.mapInPandas(_paired, "page_id long, url string, text string, n_chars long")

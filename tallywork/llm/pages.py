"""Main text of web pages by nearest-URL page differencing.

Pages of a host are ordered by URL path, and a page is aligned, line by line, with its nearest neighbours on both sides
by their longest common subsequence: what they share in that order is the host's template. The element that holds most
of the text that is not shared is the main one. In an article or main element the lines go that two different neighbours
share, if they stand before or after all that is the page's own and are neither headings nor paragraphs, so that an article
that repeats a title or quotes another one loses nothing; and menus, forms, comments and the like. Elsewhere all shared
lines go, and marked-up navigation and notices with them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from .common import named

#: Pages that one task aligns at a time, and how many different pages on a side it sees.
BLOCK_PAGES, LOOK = 256, 2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|svg|math|iframe|object|head|title|select|textarea|canvas|video|audio)(?=[\s/>])[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_NEVER = frozenset("nav aside footer form menu dialog button label fieldset".split())
_MAIN = frozenset(("article", "main"))
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote".split())
_CLOSES_P = _BLOCK - {"br", "html", "body"}
_ROLE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|advertisement|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|masthead|"
    r"cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|"
    r"comments?|commentlist|respond|reply|replies|disqus|complementary|contentinfo|search)(?:$|[\s_-])",
    re.I,
)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)


@dataclass
class Line:
    """A block's text; the number of the article or main element around it (0: none); whether its element is never main text; whether it is a heading or paragraph."""

    text: str
    main: int
    never: bool
    prose: bool = False


def lines_of(html: str | None) -> list[Line]:
    """The blocks of a page in order, character references decoded and white space made one; scripts, styles and the head are left out."""
    out: list[Line] = []
    stack: list[tuple[str, int, bool]] = []  # tag, main element, never
    parts: list[str] = []
    mains = 0

    def here() -> tuple[int, bool]:
        return stack[-1][1:] if stack else (0, False)

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                block = next((tag for tag, _, _ in reversed(stack) if tag in _BLOCK), "")
                out.append(Line(text, *here(), block in _PROSE))

    at = 0
    html = html or ""
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            if m[1]:
                parts.append(" ")
            continue
        closing, names = m[2] or m[5], m[4] or m[7] or ""
        if tag in _BLOCK or tag in _NEVER:
            flush()
        elif tag in ("td", "th"):
            parts.append(" ")
        if closing:
            if any(t == tag for t, _, _ in stack):
                if tag not in _BLOCK and tag not in _NEVER and tag not in ("td", "th"):
                    # An inline element left open inside a block never closes the block.
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            del stack[k]
                            break
                        if stack[k][0] in _BLOCK:
                            break
                else:
                    while stack.pop()[0] != tag:
                        pass
            continue
        if tag in _VOID or names.endswith("/"):
            continue
        if tag in _CLOSES_P and any(t == "p" for t, _, _ in stack[-4:]):
            while stack.pop()[0] != "p":
                pass
        if tag == "li" and stack and stack[-1][0] == "li":
            stack.pop()
        main, never = here()
        if tag in _MAIN and not main:
            mains += 1
            main = mains
        named_as = " ".join(x for found in _NAMES.findall(names) for x in found if x) if names else ""
        role = bool(named_as) and tag not in ("body", "html") and tag not in _MAIN and bool(_ROLE.search(named_as))
        nested_comment = tag == "article" and main and any(t in _MAIN for t, _, _ in stack) and bool(_ROLE.search(named_as))
        never = never or tag in _NEVER or (tag == "header" and not main) or role or nested_comment or bool(names and _HIDDEN.search(names))
        stack.append((tag, main, never))
    parts.append(html[at:])
    flush()
    return out


def place_of(url: str | None) -> tuple[str, str]:
    """Host and path of a URL, lower-cased host, without query and fragment."""
    rest = re.sub(r"^[a-zA-Z][\w+.-]*:", "", (url or "").strip()).lstrip("/")
    host, _, path = re.split(r"[?#]", rest, maxsplit=1)[0].partition("/")
    return host.lower(), "/" + path


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Indexes of `a` that a longest common subsequence with `b` uses."""
    where: dict[int, list[int]] = defaultdict(list)
    for j in range(len(b) - 1, -1, -1):
        where[b[j]].append(j)
    ends: list[int] = []  # least end in b of a common subsequence of each length
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


def main_text(lines: list[Line], shared: frozenset[int] | set[int], twice: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text of a page whose lines of numbers `shared` a neighbour has too, and `twice` two different ones.

    In an article or main element the latter go where they stand outside the page's own lines: before the first or after the last
    line that no neighbour has. Headings and paragraphs stay, and so does all of a page that has no line of its own."""
    size: dict[int, int] = defaultdict(int)
    for i, line in enumerate(lines):
        if line.main and not line.never:
            size[line.main] += len(line.text) * (1000 if i not in shared else 1)
    if size:
        best = max(size, key=lambda k: (size[k], -k))
        own = [i for i, line in enumerate(lines) if line.main == best and not line.never]
        alone = [i for i in own if i not in shared]
        first, last = (alone[0], alone[-1]) if alone else (-1, len(lines))
        kept = [lines[i].text for i in own if first <= i <= last or i not in twice or lines[i].prose]
    else:
        kept = [line.text for i, line in enumerate(lines) if not line.never and i not in shared]
    return "\n".join(kept)


def template_lines(pages: DataFrame) -> DataFrame:
    """pages(key, url, html) -> key, shared, twice: numbers of the lines that a page shares with its nearest neighbours by path
    in its host, and with two of them at once (at the ends of a host the two nearest on one side).

    Pages of a host with the very same lines are one page, at the least of their paths."""
    def outline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *place_of(u), [xxhash.xxh64_intdigest(x.text) - (1 << 63) for x in lines_of(h)]) for k, u, h in zip(pdf["key"], pdf["url"], pdf["html"])]
            yield pd.DataFrame(rows, columns=["key", "host", "path", "lines"])

    narrow = pages.mapInPandas(outline, "key long, host string, path string, lines array<long>")
    narrow = store(narrow.withColumn("same", F.xxhash64("host", "lines")))
    least = narrow.groupBy("same").agg(F.min(F.struct("host", "path", "key")).alias("at"), F.first("lines").alias("lines"))
    single = least.select("same", "at.host", "at.path", "at.key", "lines")
    placed = single.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key").withColumn("at", F.monotonically_increasing_id())
    placed = store(placed)
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    tasks = placed.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = placed.join(F.broadcast(tasks), part == tasks["part"]).withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1))
    block = F.floor(F.col("rank") / BLOCK_PAGES)
    spread = F.array_distinct(F.array(block, F.floor((F.col("rank") - LOOK) / BLOCK_PAGES), F.floor((F.col("rank") + LOOK) / BLOCK_PAGES)))
    blocks = ranked.select("same", "host", "rank", "lines", block.alias("own"), F.explode(spread).alias("block"))

    def align(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        hosts, lines, out = pdf["host"].tolist(), [list(x) for x in pdf["lines"]], []
        for i, (same, own, number) in enumerate(zip(pdf["same"], pdf["own"], pdf["block"])):
            if own != number:
                continue
            in_host = [way for way in (-2, -1, 1, 2) if 0 <= i + way < len(hosts) and hosts[i + way] == hosts[i]]
            common = {way: set(common_lines(lines[i], lines[i + way])) for way in in_host if abs(way) == 1}
            shared = set().union(*common.values())
            if len(common) == 1:
                common |= {way: set(common_lines(lines[i], lines[i + way])) for way in in_host if abs(way) == 2}
            twice = set.intersection(*common.values()) if len(common) == 2 else set()
            out.append((same, sorted(shared), sorted(twice)))
        return pd.DataFrame(out, columns=["same", "shared", "twice"])

    found = store(blocks.groupBy("block").applyInPandas(align, "same long, shared array<int>, twice array<int>"))  # stored, so that the join can split many copies
    copies = narrow.select("key", F.col("same").alias("of")).distinct()
    return copies.join(found, copies["of"] == found["same"]).select("key", "shared", "twice")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per row of `pages`.

    Null or empty html gives an empty text. Pages equal in id, url and html share one result; pages of a host with the very same
    lines are compared as one. A page without neighbours shares no line. An empty table gives no rows."""
    d = named(pages, page_id=page_id, url=url, html=html).withColumn("key", F.xxhash64("page_id", "url", "html"))
    shared = template_lines(d.select("key", "url", "html"))
    kind = d.schema["page_id"].dataType.simpleString()
    joined = d.join(shared.withColumnRenamed("key", "of"), F.col("key") == F.col("of"), "left")
    joined = joined.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", *[F.coalesce(c, F.array().cast("array<int>")).alias(c) for c in ("shared", "twice")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(lines_of(h), set(s), set(t)) for h, s, t in zip(pdf["html"], pdf["shared"], pdf["twice"])]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    out = joined.mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast(kind))

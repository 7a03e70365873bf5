"""Main text of web pages by differencing each page with the pages nearest to it by URL.

Pages of a host are sorted by URL path; each is paired with the NEAR pages before and after it. Both pages' visible lines
are aligned by longest common subsequence, digits aside, and shared lines are taken for the site's furniture. A pair that
shares nearly all of both pages (COPY) is two copies of one page and shows nothing about the site, so it doesn't count.

Differencing alone can't give the text asked for where adverts and menus differ from page to page or articles share lines.
So lines also carry where they stand: in an article or main element a shared line is kept, and in a part that by its
element, role, class or id is never article text a line is dropped even if no other page has it. With `hints` off these
words count for nothing and differencing decides alone.

The sort is by ranges of (host, path), so a host of any size is spread over tasks. Ranges are drawn from the keys alone,
without html; a range gets copies of the NEAR pages before and behind it, so ranges don't change the result, and html
moves once.

A line is a block: text between block elements, with references decoded, white space made one space, and trimmed.

Defined cases: null and empty html have empty text; unclosed elements end with their parent, at the next sibling that
closes them, or with the page; a tag, comment or reference cut off by the end of the page is dropped (a reference stays
as text); script and style end at their own end tag only, or with the page; a null or broken URL has an empty host; pages
of one URL are paired with each other; repeated rows are kept; other columns are not read.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEAR = 2
#: Share of both pages' characters that must stand in equal lines for a pair to be copies.
COPY = 0.95
#: Bits of one table of the alignment; larger ones are divided in two.
TABLE = 1 << 26
#: Elements that start and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol option p pre section select"
    " style script summary table tbody td template textarea tfoot th thead title tr ul video".split()
)
#: Elements whose text is not shown as such.
UNSEEN = frozenset("head title style script noscript template select option textarea input iframe object svg canvas audio video".split())
#: Elements whose text is never part of an article.
NEVER = frozenset("nav header footer aside form menu button dialog label".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
#: Words that mark a furniture part in a class, id or role.
FURNITURE = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo(?:tion)?s?|nav(?:bar|igation)?|menus?|breadcrumbs?"
    r"|sidebars?|side-bar|footer|masthead|topbar|cookies?|consent|notices?|gdpr|popup|modal|overlay|newsletter"
    r"|subscribe|signup|login|share|sharing|social|related|recommended|comments?|comment-list|replies|reply|disqus|widgets?|toolbar|pagination"
    r"|pager|complementary|contentinfo|search|alert|skip-link)(?:$|[\s_-])"
)
_HEADER = re.compile(r"(?i)^(?:site-|page-|global-|main-)?header$")
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(>|$)", re.S)
_MARKED = re.compile(r"""(?i)(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_HIDDEN = re.compile(r"""(?i)(?:^|\s)hidden(?:\s|=|$)|style\s*=\s*["'][^"']*display\s*:\s*none|aria-hidden\s*=\s*["']?true""")
_WHITE = re.compile(r"\s+")
#: What a start tag closes among its open siblings.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
_CLOSES_P = BLOCKS - {"br", "button", "head", "body", "html", "title", "option", "select", "script", "style", "noscript", "template", "iframe", "textarea", "video"}
_DIGITS = re.compile(r"\d+")
OTHER, KEPT, DROPPED, HIDDEN = 0, 1, 2, 3


def lines_of(page: str) -> list[tuple[str, int]]:
    """(line, where) of each block of visible text that is not empty, in page order."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # element, where its text stands
    text: list[str] = []
    where = OTHER

    def close_block() -> None:
        line = _WHITE.sub(" ", html.unescape("".join(text))).strip() if text else ""
        text.clear()
        if line:
            out.append((line, where))

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCKS:
                close_block()
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if k is not None:
                if any(e in BLOCKS for e, _ in stack[k:]):
                    close_block()
                del stack[k:]
                where = stack[-1][1] if stack else OTHER
            continue
        if name in BLOCKS:
            close_block()
        if name in _CLOSES_P and any(e == "p" for e, _ in stack):
            k = max(i for i, (e, _) in enumerate(stack) if e == "p")
            if all(e not in BLOCKS for e, _ in stack[k + 1 :]):
                del stack[k:]
        elif name in CLOSES:
            while stack and stack[-1][0] in CLOSES[name]:
                stack.pop()
        where = stack[-1][1] if stack else OTHER
        if name in VOID or m[3].endswith("/"):
            continue
        own = where
        if name in UNSEEN or _HIDDEN.search(m[3]):
            own = HIDDEN
        elif where < DROPPED:
            # an article's own header may hold its title; it is furniture only outside of one
            header = name == "header" and where == KEPT
            values = [v.strip("\"'") for v in _MARKED.findall(m[3])] if name not in ("html", "body") else []
            marked = any(FURNITURE.search(v) or where == OTHER and any(map(_HEADER.match, v.split())) for v in values)
            if name in NEVER and not header or marked and not (name in MAIN):
                own = DROPPED
            elif name in MAIN:
                own = KEPT
        own = max(own, where) if where == HIDDEN else own
        stack.append((name, own))
        where = own
        if name in RAW:
            end = re.compile(rf"(?i)</{name}\s*(?:>|$)").search(page, at)
            at = end.start() if end else len(page)
    if at < len(page):
        rest = page[at:]
        cut = rest.find("<")
        text.append(rest if cut < 0 or not re.match(r"<[a-zA-Z/!?]", rest[cut:]) else rest[:cut])
    close_block()
    return [(line, w) for line, w in out if w != HIDDEN]


def _places(b: list[str]) -> dict[str, int]:
    at: dict[str, int] = {}
    for k, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << k
    return at


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """For each k the length of a longest common subsequence of a and the first k of b."""
    at, full = _places(b), (1 << len(b)) - 1
    row = full
    for x in a:
        u = row & at.get(x, 0)
        row = ((row + u) | (row - u)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions of a longest common subsequence; rows of the table are bits of whole numbers.

    Where the table would pass TABLE bits, a is halved and b is cut where both halves together give most.
    """
    if not a or not b:
        return []
    if len(a) * len(b) > TABLE and len(a) > 1:
        half = len(a) // 2
        best = _lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]
        cut = int(np.argmax(best))
        return _aligned(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in _aligned(a[half:], b[cut:])]
    at, full = _places(b), (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        u = row & at.get(x, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)  # a zero bit: the length grows here
    length = lambda r, k: ((1 << k) - 1 & ~r).bit_count()
    out = []
    i, k = len(a), len(b)
    while i and k:
        above = rows[i - 2] if i > 1 else full
        now = length(rows[i - 1], k)
        if length(above, k) == now:
            i -= 1
        elif length(rows[i - 1], k - 1) == now:
            k -= 1
        else:
            i, k = i - 1, k - 1
            out.append((i, k))
    return out[::-1]


def shared(a: list[str], b: list[str]) -> tuple[set[int], set[int]]:
    """Positions in a and in b of a longest common subsequence. Common ends are matched first."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    common = set(a[low : len(a) - high]).intersection(b[low : len(b) - high])
    ia = [i for i in range(low, len(a) - high) if a[i] in common]
    ib = [i for i in range(low, len(b) - high) if b[i] in common]
    found = _aligned([a[i] for i in ia], [b[i] for i in ib])
    ends_a, ends_b = ({*range(low), *range(len(x) - high, len(x))} for x in (a, b))
    return ends_a | {ia[i] for i, _ in found}, ends_b | {ib[j] for _, j in found}


def paired(a: list[str], b: list[str]) -> tuple[set[int], set[int]]:
    """Positions of lines that two pages share, digits aside; none if the pages are copies."""
    exact, size = shared(a, b), [sum(map(len, lines)) for lines in (a, b)]
    alike = [sum(len(lines[i]) for i in own) for lines, own in zip((a, b), exact, strict=True)]
    if all(n >= COPY * m for n, m in zip(alike, size, strict=True)):
        return set(), set()
    return shared(*[[_DIGITS.sub("0", x) for x in lines] for lines in (a, b)])


def main_text(lines: list[str], where: list[int], common: set[int], hints: bool = True) -> str:
    """The lines that are not shared, by differencing; with hints also shared ones of an article, and none of a part that never is one."""
    if not hints:
        return "\n".join(line for i, line in enumerate(lines) if i not in common)
    return "\n".join(line for i, (line, w) in enumerate(zip(lines, where, strict=True)) if (i not in common or w == KEPT) and w != DROPPED)


_URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"
_KEY = {"host": "string", "path": "string", "page_id": "long", "url": "string", "content": "long", "tie": "long"}


def _paired_pages(batches: Iterable[pa.RecordBatch], hints: bool) -> Iterator[pa.RecordBatch]:
    """(page_id, url, text) of the pages of ranges; guests are there for their neighbours only."""
    held: list[tuple] = []  # the last pages, which still wait for those behind them
    done: list[tuple] = []

    def packed() -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) if done else [[], [], []]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)], ["page_id", "url", "text"])

    def leave() -> None:
        _, _, guest, page_id, url, lines, where, common = held.pop(0)
        if not guest:
            done.append((page_id, url, main_text(lines, where, common, hints)))

    for b in batches:
        for at, host, guest, page_id, url, page in zip(*(b.column(k).to_pylist() for k in ("at", "host", "guest", "page_id", "url", "html")), strict=True):
            while held and (held[0][0] != at or len(held) > NEAR):
                leave()
            found = lines_of(page or "")
            now = (at, host, guest, page_id, url, [x for x, _ in found], [w for _, w in found], set())
            for before in held[-NEAR:]:
                if before[1] == host and not (before[2] and guest):
                    one, other = paired(before[5], now[5])
                    before[7].update(one)
                    now[7].update(other)
            held.append(now)
            if len(done) > 500:
                yield packed()
    while held:
        leave()
    yield packed()


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first NEAR and the last NEAR rows of a sorted range, numbered; all of a smaller one."""
    seen, tail = 0, None
    for b in batches:
        numbered = b.append_column("place", pa.array(range(seen, seen + b.num_rows), pa.int64()))
        yield numbered.slice(0, max(0, NEAR - seen))
        rest = pa.Table.from_batches([numbered.slice(max(0, NEAR - seen))])
        tail = pa.concat_tables([tail, rest]).slice(max(0, tail.num_rows + rest.num_rows - NEAR)) if tail else rest.slice(max(0, rest.num_rows - NEAR))
        seen += b.num_rows
    if tail:
        yield from tail.to_batches()


def _borders(keys: DataFrame, n: int) -> list[dict]:
    """Where ranges meet: the first key of each but the first, and the keys NEAR pages before and behind. A few rows a range."""
    ranges = keys.repartitionByRange(n, *_KEY).sortWithinPartitions(*_KEY).withColumn("part", F.spark_partition_id())
    kinds = ", ".join(f"{k} {t}" for k, t in _KEY.items())
    rows = ranges.mapInArrow(_ends, f"{kinds}, part int, place long").orderBy("part", "place").collect()
    plain = [{k: r[k] for k in _KEY} for r in rows]
    first = [i for i in range(1, len(rows)) if rows[i]["part"] != rows[i - 1]["part"]]
    return [
        {"j": j, "low": plain[max(0, i - NEAR)], "own": plain[i], "high": plain[min(len(rows), i + NEAR) - 1]} for j, i in enumerate(first, 1)
    ]


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", hints: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""

    url = F.col(url_col)
    host = F.coalesce(F.lower(F.regexp_extract(url, rf"{_URL}([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, rf"{_URL}[^/?#]*([^?#]*)", 1), F.lit(""))
    src = pages.select(
        host.alias("host"), path.alias("path"), F.col(id_col).cast("long").alias("page_id"), url.alias("url"),
        F.xxhash64(html_col).alias("content"), F.monotonically_increasing_id().alias("tie"), F.col(html_col).alias("html"),
    )  # tie only orders rows that are equal
    spark = pages.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # named, as ranges of keys alone look small
    kind = "struct<" + ",".join(f"{k}:{t}" for k, t in _KEY.items()) + ">"
    borders = F.from_json(F.lit(json.dumps(_borders(src.select(*_KEY), n))), f"array<struct<j:int,low:{kind},own:{kind},high:{kind}>>")
    row = F.struct(*_KEY)
    own = F.size(F.filter(borders, lambda x: row >= x["own"]))
    ahead = F.transform(F.filter(borders, lambda x: (row >= x["low"]) & (row < x["own"])), lambda x: x["j"])
    behind = F.transform(F.filter(borders, lambda x: (row >= x["own"]) & (row <= x["high"])), lambda x: x["j"] - 1)
    dealt = src.withColumn("range", own).withColumn("at", F.explode(F.concat(F.array("range"), ahead, behind)))
    dealt = dealt.withColumn("guest", F.col("at") != F.col("range")).repartition(n, "at").sortWithinPartitions("at", *_KEY)
    text = dealt.mapInArrow(lambda batches: _paired_pages(batches, hints), "page_id long, url string, text string")
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

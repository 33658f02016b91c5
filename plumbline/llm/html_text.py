"""Main text of web pages: markup roles, then differencing against the page of the nearest URL.

Pages are ordered by host and URL path over range partitions. Each page is paired with the neighbour in that order whose
path is nearer, past copies of itself and pages without such lines. Its lines are aligned with the partner's by a longest common subsequence, and lines that both share
(menus, notices, footers of the site) are deleted.

Markup decides first where it is explicit: scripts, styles, navigation, headers, footers, asides, forms, and elements
named as adverts, sidebars, notices or comments are no text; lines inside ``article`` or ``main`` are text and stay even
when another page shares them, as copies and quoted passages do. Differencing decides over all other lines, on pages with
such a part too: an ``article`` that is shorter than what no other page shares is a teaser of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements whose text is not shown or is no running text.
UNSHOWN = frozenset(
    "head title script style noscript template iframe object svg math canvas audio video map select button textarea "
    "datalist option meter progress dialog".split()
)
#: Elements around an article, not of it.
AROUND = frozenset("nav header footer aside form menu search".split())
#: Roles of the same kind.
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words in class or id names that mark such an element.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu "
    "submenu sidebar breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar banner cookie cookies consent "
    "gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended comment comments disqus respond replies widget copyright disclaimer skip hidden".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Share of a page's characters from which two pages may be copies of each other, which tell nothing about templates.
COPY_SHARE = 0.8
#: Cells of the alignment table that are held at once; larger pairs are split.
CELLS = 1 << 26

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|\Z)", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

OPEN, MAIN, OUT = 0, 1, 2


def _named_out(tag: str, attributes: str) -> bool:
    """Whether attributes say that an element is none of the text."""
    if tag in ("html", "body"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in _PARTS.findall(one)]
                if words and words[0] not in ("has", "with", "no", "without", "is") and NAMES.intersection(words):
                    return True
    return False


def lines_of(html: str | None) -> list[tuple[str, int]]:
    """Lines (blocks of text, white space folded) of a page with their role: open, main or out; empty blocks are left out."""
    if not html:
        return []
    found: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # open elements with the role inside them
    opened: Counter[str] = Counter()
    text: list[str] = []
    role, place, end = OPEN, 0, len(html)

    def close(role: int) -> None:
        if text:
            line = " ".join("".join(text).split())
            text.clear()
            if line:
                found.append((line, role))

    while place < end:
        match = _TOKEN.search(html, place)
        stop = match.start() if match else end
        if stop > place:
            text.append(unescape(html[place:stop]))
        if not match:
            break
        place = match.end()
        tag = match[2]
        if not tag:
            continue
        tag = tag.lower()
        if match[1]:
            if tag in BLOCKS:
                close(role)
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    closed = role
                    if any(name in BLOCKS for name, _ in stack[k:]) or stack[k][1] != (stack[k - 1][1] if k else OPEN):
                        close(closed)
                    opened.subtract(name for name, _ in stack[k:])
                    del stack[k:]
                    role = stack[-1][1] if stack else OPEN
                    break
            continue
        if tag in VOID:
            if tag == "hr":
                close(role)
            elif tag == "br":
                text.append(" ")
            continue
        if tag in BLOCKS:
            close(role)
            for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph, an item the item before it
                if stack[k][0] == "p" or stack[k][0] == tag and tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                    opened.subtract(name for name, _ in stack[k:])
                    del stack[k:]
                    role = stack[-1][1] if stack else OPEN
                    break
                if stack[k][0] in BLOCKS:
                    break
        inside = role
        if role != OUT:
            if tag in UNSHOWN or _named_out(tag, match[3]):
                inside = OUT
            elif tag in AROUND:
                inside = OUT
            elif tag in ("article", "main"):
                inside = MAIN
        elif tag in HEADINGS and stack and stack[-1][0] == "header" and any(n == "article" for n, _ in stack):
            inside = MAIN  # the headline of an article often stands in its header
        if inside != role:
            close(role)
        if tag in RAW:
            closing = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, place)
            place = closing.end() if closing else end
            continue
        if not match[3].rstrip().endswith("/") or tag in BLOCKS or inside != role:
            stack.append((tag, inside))
            opened[tag] += 1
            role = inside
    close(role)
    return found


def _rows(a: list, b: list) -> list[int]:
    """Bit rows of the longest common subsequence of ``a`` with prefixes of ``b``: zeros count matched places of ``a``."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, row, rows = (1 << len(a)) - 1, (1 << len(a)) - 1, []
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    return rows


def _lengths(a: list, b: list) -> list[int]:
    """Length of the longest common subsequence of ``b`` with every prefix of ``a``."""
    row = _rows(a, b)[-1] if b and a else (1 << len(a)) - 1
    counts, total = [0], 0
    for bit in reversed(bin(row | 1 << len(a))[3:]) if a else "":
        total += bit == "0"
        counts.append(total)
    return counts


def shared_lines(a: list, b: list) -> set[int]:
    """Places in ``a`` that a longest common subsequence with ``b`` uses."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    used = {*range(low), *range(len(a) - high, len(a))}
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    if not x or not y:
        return used
    if len(x) * len(y) > CELLS and len(y) > 1:
        half = len(y) // 2
        front, back = _lengths(x, y[:half]), _lengths(x[::-1], y[half:][::-1])[::-1]
        cut = max(range(len(x) + 1), key=lambda i: front[i] + back[i])
        found = shared_lines(x[:cut], y[:half]) | {cut + i for i in shared_lines(x[cut:], y[half:])}
        return used | {low + i for i in found}
    rows = [(1 << len(x)) - 1, *_rows(x, y)]
    i, j = len(x) - 1, len(y)
    while i >= 0 and j > 0:
        if rows[j] >> i & 1:
            i -= 1  # this place adds nothing to the prefix
        elif not rows[j - 1] >> i & 1:
            j -= 1  # already matched without the last line
        else:
            used.add(low + i)
            i, j = i - 1, j - 1
    return used


def open_lines(lines: list[tuple[str, int]]) -> list[str]:
    """Lines that differencing decides over and compares with."""
    return [line for line, role in lines if role == OPEN]


def _differ(a: list[str], b: list[str], shared: set[int]) -> bool:
    """Whether what two pages do not share has other words on either side, as pages of one template have and copies have not."""
    left = Counter(a) - Counter(a[i] for i in shared), Counter(b) - Counter(a[i] for i in shared)
    words = [{word for line in side for word in line.split()} for side in left]
    return bool(words[0] and words[1]) and 2 * len(words[0] & words[1]) < min(map(len, words))


def copies(a: list[str], b: list[str]) -> bool:
    """Whether open lines of two pages are copies: most characters of both shared, the rest alike or on one side only."""
    if a == b:
        return True
    shared = shared_lines(a, b)
    size = sum(len(a[i]) for i in shared)
    return size >= COPY_SHARE * max(sum(map(len, a)), sum(map(len, b))) and not _differ(a, b, shared)


def own_places(own: list[str], partners: list[list[str]]) -> set[int] | None:
    """Places of open lines that are the page's own, by alignment with its partners' open lines; None where none of them decides.

    Partners come nearest first; copies of the page are passed over. Where most of the page is shared and the rest
    differs, two partners must share a line, as they may be copies too.
    """
    size = sum(map(len, own))
    mostly = []
    for other in partners:
        shared = shared_lines(own, other)
        if sum(len(own[i]) for i in shared) < COPY_SHARE * size:
            return set(range(len(own))) - shared
        if _differ(own, other, shared):
            mostly.append(shared)
    return set(range(len(own))) - (mostly[0] & mostly[1]) if len(mostly) > 1 else None


def main_text(lines: list[tuple[str, int]], partners: list[list[tuple[str, int]]]) -> str:
    """Text of a page: its main lines, and those open lines that differencing against the partners leaves.

    Without a partner that decides, nothing is deleted from a page without main lines, and only main lines are the text
    of one with them. Where main lines outweigh the page's own open lines, these are remarks around an article; else the
    marked part is a teaser of them and they belong to the text.
    """
    own = open_lines(lines)
    chosen = own_places(own, [open_lines(partner) for partner in partners])
    main = sum(len(line) for line, role in lines if role == MAIN)
    if chosen is None:
        chosen = set() if main else set(range(len(own)))
    elif sum(len(own[i]) for i in chosen) <= main:
        chosen = set()
    text, place = [], 0
    for line, role in lines:
        if role == MAIN or role == OPEN and place in chosen:
            text.append(line)
        place += role == OPEN
    return "\n".join(text)


def _near(a: str, b: str) -> int:
    """Length of the common beginning of two paths."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pages to texts; lines of a run of copies and of a page on either side are held, those of equal pages once."""

    def pages():
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5))):
                page_id, url, html, host, path = (v.as_py() for v in row)
                yield page_id, url, host, path, lines_of(html)

    def texts():
        before, run = None, []  # the distinct page before a run of copies, and the run
        for page in pages():
            own = open_lines(page[4])
            if any(role == MAIN for _, role in page[4]) and not own:
                yield page, None, None  # needs no partner and is none
                continue
            if run and run[-1][2] == page[2] and page[2] is not None and copies(open_lines(run[-1][4]), own):
                run.append((*page[:4], run[-1][4]) if run[-1][4] == page[4] else page)
                continue
            for one in run:
                yield one, before, page
            before, run = run[-1] if run else None, [page]
        for one in run:
            yield one, before, None

    rows, held = [], 0

    def flushed():
        frame = pd.DataFrame(rows, columns=["page_id", "url", "text"], dtype=object)
        return pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)

    first = next(batches, None)
    if first is None:
        return
    schema = pa.schema([("page_id", first.schema.field(0).type), ("url", pa.string()), ("text", pa.string())])
    rest = batches
    batches = (b for part in ([first], rest) for b in part)
    for now, before, after in texts():
        page_id, url, host, path, lines = now
        near = [p for p in (before, after) if p is not None and host is not None and p[2] == host]
        near.sort(key=lambda p: -_near(path, p[3]))
        text = main_text(lines, [p[4] for p in near])
        rows.append((page_id, url, text))
        held += len(text)
        if held > 4_000_000:
            yield flushed()
            rows, held = [], 0
    yield flushed()


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text.

    ``pages`` needs page_id, url and html; other columns are not read. A null or empty html, or one without text, gives
    an empty text. A page whose url is null or holds no host has no partner, nor has one alone on its host; nothing is
    deleted from it by differencing. Repeated rows stand next to each other, count as copies and keep their text. An
    empty table gives no rows. Neighbours are taken inside a range partition: a page at its border has one, and a run of
    copies that fills the border has none beyond it.
    """
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    rows = pages.select("page_id", "url", "html", F.lower(F.nullif(host, F.lit(""))).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    # Paths in order of their numbers too: /en/9 stands before /en/10.
    order = ["host", F.regexp_replace("path", r"\d+", ""), F.length("path"), "path", "page_id"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    key = pages.schema["page_id"].dataType.simpleString()
    return placed.mapInArrow(_texts, f"page_id {key}, url string, text string")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))

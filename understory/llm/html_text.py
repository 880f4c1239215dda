"""Main text of web pages by nearest-URL page differencing.

Pages of a host are ordered by URL path; each is paired with that one of its nearest unlike neighbours whose path shares the
longer prefix, the one before if they tie. All their text lines (blocks), menus and footers too, are aligned by longest
common subsequence; lines of the alignment are the site's template and go. What the markup itself says comes
second: scripts, menus, adverts and the like go even where they differ from page to page, and inside an explicit article
a shared line goes only if it is mostly links, so that an article that is copied to another page of the site
isn't lost. Neighbours that equal the page line for line say nothing about the template and are passed over.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from understory.llm.common import enter, range_dealt, range_tasks, sliced, small_batches

# ---------------------------------------------------------------- blocks of a page

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z)""", re.S)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noframes", "noembed", "xmp", "svg", "annotation", "annotation-xml", "object", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol",
    "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
DROPPED = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "search", "fieldset", "head"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of class, id and role values that name something other than the article; of these, the parts of a page's layout, in which an article may lie.
LAYOUT = "sidebar|side-?bar|menu|nav|navbar|navigation|banner|header|footer|masthead|toolbar|widget|search|social|share|sharing|notices?|alert|cookies?|consent|modal|overlay"
APART = (
    "ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed|s)?|promo(?:tion|ted)?|gdpr|breadcrumbs?|comments?|comment-?list|replies|respond|disqus|related|recommended|newsletter|"
    "subscribe|subscription|signup|popup|pagination|pager|complementary|contentinfo|login|skip-?link"
)
OTHER = re.compile(rf"(?:^|[\s_-])(?:{LAYOUT}|{APART})(?:$|[\s_-])", re.I)
NEVER = re.compile(rf"(?:^|[\s_-])(?:{APART})(?:$|[\s_-])", re.I)
#: Names that say whether a page has such a part, and are not it.
ABOUT = re.compile(r"(?:^|(?<=\s))(?:[\w-]+-)?(?:with|has|no|without)[_-][\w-]*", re.I)
#: Inside an article the whole name must be of this kind: "related-posts", but not "related-work".
INSIDE = re.compile(
    rf"(?:^|\s)(?:(?:article|post|entry|page|site|story|inline|top|bottom|left|right|main|content|js|reader|user)[_-])?(?:{LAYOUT}|{APART})"
    r"(?:[_-](?:box|block|list|area|section|wrapper|container|inner|links?|posts?|articles?|stories|buttons?|bar|slot|unit|banner|form|widget|icons?|thread|text|content|item|\d+))*(?=\s|$)",
    re.I,
)
MAIN = re.compile(r"(?:^|[\s_-])(?:article-?body|post-?content|entry-?content|story-?body|main-?content|articlebody)(?:$|[\s_-])", re.I)
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
#: Elements that a new one of the key closes, up to the named boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
DROP, KEEP, PLAIN, ASIDE = 0, 1, 2, 3  # ASIDE is dropped too, but an article inside it stays


def blocks(page: str) -> list[tuple[str, int, bool]]:
    """(text, place, linked) of each block in page order: place is DROP, KEEP (in an article) or PLAIN; linked if links hold over half its letters.

    What is dropped inside a line, such as a mark in a paragraph, is a block of its own after it.
    """
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, int]] = []  # name, place inside
    place, links = PLAIN, 0
    words: list[str] = []
    gone: list[str] = []
    linked = plain = 0
    spot = PLAIN

    def flush() -> None:
        nonlocal words, gone, linked, plain
        for found, at_, of in ((words, spot, linked > plain), (gone, DROP, False)):
            if found and (text := " ".join(html.unescape("".join(found)).split())):
                out.append((text, at_, of))
        words, gone, linked, plain = [], [], 0, 0

    def add(s: str) -> None:
        nonlocal linked, plain, spot
        if s and place in (DROP, ASIDE):
            gone.append(s)
        elif s:
            if not words:
                spot = place
            words.append(s)
            if links:
                linked += len(s.strip())
            else:
                plain += len(s.strip())

    def pop(to: int) -> None:
        nonlocal place, links
        while len(stack) > to:
            name, was = stack.pop()
            if name in BLOCK:
                flush()
            if name == "a":
                links -= 1
            place = was

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
                if stack[k][0] in ("article", "main", "body") and name not in ("body", "html", "article", "main"):
                    break
            else:
                if name in BLOCK:
                    flush()
            continue
        if name in RAW:
            if name == "svg" and m[0].endswith("/>"):
                continue
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            add(" ")
            continue
        if name in BLOCK:
            flush()
            for k in range(len(stack) - 1, -1, -1):  # an open paragraph ends here, with what is open inside
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        if name in CLOSES:
            ends, limit = CLOSES[name]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in limit:
                    break
                if stack[k][0] in ends:
                    pop(k)
                    break
        if name in VOID:
            add(" " if name == "br" else "")
            continue
        marks = hidden = ""
        if m[3]:
            for a in ATTR.finditer(m[3]):
                key = a[1].lower()
                if key in ("class", "id", "role", "aria-label"):
                    marks += " " + (a[2] or "").strip("\"'")
                elif key == "hidden" or key == "aria-hidden" and "true" in (a[2] or "") or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a[2] or "", re.I):
                    hidden = key
                elif key == "itemprop" and "articlebody" in (a[2] or "").lower():
                    marks += " articlebody"
        stack.append((name, place))
        if name == "a":
            links += 1
        if place != DROP:
            marks = ABOUT.sub("", marks) if marks else marks
            other = None if name in HEADINGS | {"body", "html", "article", "main"} else (INSIDE if place == KEEP else OTHER).search(marks)
            if name in DROPPED or hidden or name == "header" and place != KEEP or other:
                flush() if name in BLOCK else None
                place = ASIDE if other and place != KEEP and not (name in DROPPED or hidden or NEVER.search(marks)) else DROP
            elif name in ("article", "main") or place == PLAIN and MAIN.search(marks):
                flush()
                place = KEEP
        if m[0].endswith("/>") and name not in BLOCK and stack[-1][0] == name and name != "a":
            pop(len(stack) - 1)
    pop(0)
    flush()
    return out


# ---------------------------------------------------------------- longest common subsequence


def _rows(a: list, where: dict, m: int, keep: bool) -> list[int]:
    """Bit-parallel LCS: row k has a zero at j where the LCS of a[:k] and b grows with b[j]."""
    full = (1 << m) - 1
    v, out = full, [full]
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            out.append(v)
    return out if keep else [v]


def _where(b: list) -> dict:
    out: dict = {}
    for j, x in enumerate(b):
        out[x] = out.get(x, 0) | 1 << j
    return out


def shared(a: list, b: list, most_bits: int = 1 << 28) -> list[int]:
    """Positions in ``a`` of one longest common subsequence with ``b``."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = [*range(lead), *range(len(a) - tail, len(a))]
    in_b, in_a = set(b[lead : len(b) - tail]), set(a[lead : len(a) - tail])
    at = [k for k in range(lead, len(a) - tail) if a[k] in in_b]
    x, y = [a[k] for k in at], [e for e in b[lead : len(b) - tail] if e in in_a]
    return sorted(ends + [at[k] for k in _lcs(x, y, most_bits)])


def _lcs(x: list, y: list, most_bits: int) -> list[int]:
    if not x or not y:
        return []
    if len(x) == 1:
        return [0] if x[0] in y else []
    if len(x) * len(y) > most_bits:  # in halves, so that memory stays linear
        mid = len(x) // 2
        low = _rows(x[:mid], _where(y), len(y), False)[0]
        high = _rows(x[mid:][::-1], _where(y[::-1]), len(y), False)[0]
        m, best, cut = len(y), -1, 0
        left, right = 0, m - bin(high).count("1")
        for j in range(m + 1):
            if left + right > best:
                best, cut = left + right, j
            if j < m:
                left += not low >> j & 1
                right -= not high >> (m - 1 - j) & 1
        return _lcs(x[:mid], y[:cut], most_bits) + [mid + k for k in _lcs(x[mid:], y[cut:], most_bits)]
    rows = _rows(x, _where(y), len(y), True)
    out, j = [], len(y) - 1
    for i in range(len(x), 0, -1):
        # drop columns whose growth isn't in this row; take x[i-1] if the column's growth begins here
        while j >= 0 and rows[i] >> j & 1:
            j -= 1
        if j < 0:
            break
        if rows[i - 1] >> j & 1:
            out.append(i - 1)
            j -= 1
    return out[::-1]


# ---------------------------------------------------------------- pages


Block = tuple[str, int, bool]


def main_lines(own: list[Block], other: list[Block] | None) -> tuple[list[str], int, int]:
    """The page's lines that stay, given its neighbour's blocks (None: no neighbour), and how many the alignment and the markup removed."""
    explicit = any(place == KEEP for _, place, _ in own)
    gone = set(shared([t for t, _, _ in own], [t for t, _, _ in other])) if other else set()
    stay, aligned, marked = [], 0, 0
    for k, (t, place, linked) in enumerate(own):
        if k in gone and (linked or not (explicit and place == KEEP)):
            aligned += 1
        elif place != (KEEP if explicit else PLAIN):
            marked += 1
        else:
            stay.append(t)
    return stay, aligned, marked


def url_key(url: Column) -> Column:
    """Host and path in sort order; scheme, ``www.``, query and fragment are left out."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://|[?#].*$", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^([^/]*)", 1), r"^www\.|:\d+$", "")
    return F.concat(host, F.lit("\x01"), F.regexp_replace(bare, r"^[^/]*", ""))


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Run:
    """Pages of equal lines in a row, which wait for the next unlike one."""

    def __init__(self, part: int, host: str, lines: list[str], before: tuple[str, list[Block]] | None):
        self.part, self.host, self.lines, self.before = part, host, lines, before
        self.path, self.blocks = "", []
        self.pages: list[tuple[object, str | None, str, list[Block]]] = []

    def add(self, copy: int, ident: object, url: str | None, path: str, found: list[Block]) -> None:
        if found == self.blocks:  # copies share one list
            found = self.blocks
        self.path, self.blocks = path, found
        if not copy:
            self.pages.append((ident, url, path, found))

    def done(self, after: tuple[str, list[Block]] | None) -> Iterator[tuple]:
        """(id, url, text, lines that the alignment removed, lines that the markup removed) of each page."""
        known: dict[tuple[int, int], tuple] = {}
        for ident, url, path, found in self.pages:
            best, size = None, -1
            for x in (self.before, after):
                if x and (n := _prefix(x[0], path)) > size:
                    best, size = x, n
            at = id(found), id(best)
            if at not in known:
                lines, aligned, marked = main_lines(found, best[1] if best else None)
                known[at] = "\n".join(lines), aligned, marked
            yield ident, url, *known[at]


def _neighbours(dealt: DataFrame, edges: list[tuple]) -> DataFrame:
    """(key, p): pages that ranges need from others: the pages beside each range, and the nearest ones unlike those.

    Reads keys and hashes of the pages; a few rows a range reach the driver.
    """
    spark, h = dealt.sparkSession, F.xxhash64("html")
    ends = {r["_part"]: r for r in dealt.groupBy("_part").agg(F.min(F.struct("key", h.alias("h"))).alias("lo"), F.max(F.struct("key", h.alias("h"))).alias("hi")).collect()}
    order = [e[0] for e in edges]
    wanted: set[tuple[str, int]] = set()
    if len(order) > 1:
        marks = spark.createDataFrame([(p, ends[p].lo.h, ends[p].hi.h) for p in order], "_part int, lo long, hi long")
        unlike = {r["_part"]: r for r in dealt.join(F.broadcast(marks), "_part").groupBy("_part").agg(F.min(F.when(h != F.col("lo"), F.col("key"))).alias("first"), F.max(F.when(h != F.col("hi"), F.col("key"))).alias("last")).collect()}
        for way in (1, -1):
            for k, p in enumerate(order):
                near = range(k - way, -1 if way > 0 else len(order), -way)  # outwards
                mine, seen = (ends[p].lo if way > 0 else ends[p].hi).h, False
                for j in near:
                    edge = ends[order[j]].hi if way > 0 else ends[order[j]].lo
                    if not seen or edge.h != mine:
                        wanted.add((edge.key, p))
                        seen = True
                    if edge.h != mine:
                        break
                    if other := unlike[order[j]].last if way > 0 else unlike[order[j]].first:
                        wanted.add((other, p))
                        break
    return spark.createDataFrame(sorted(wanted), "key string, p int")


def extracted(pages: DataFrame, ident: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(ident, url, text, aligned_lines, marked_lines): the main text of every page, lines joined by a line feed, empty if none, and how many lines the alignment and the markup removed.

    Pages move once, to ranges of (host, path, id); the pages beside each range, and the nearest ones unlike those, are sent to
    it too, so each page meets its unlike neighbours as in one global order. Null urls are one host without name,
    null html is empty, equal keys are ordered by html. Memory: a batch, three pages, and the ids and
    urls of a range's pages of equal lines.
    """
    spark = pages.sparkSession
    kind = dict(pages.dtypes)[ident]
    key = F.concat(url_key(F.col(url)), F.lit("\x01"), F.coalesce(F.lpad(F.col(ident).cast("string"), 20, "0"), F.lit("~")))
    rows = pages.select(F.col(ident).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("html"), key.alias("key"))
    tasks = range_tasks(pages)
    dealt, edges = range_dealt(rows, "key", 4 * tasks)
    dealt = dealt.withColumn("copy", F.lit(0))
    if len(edges) > 1:
        sent = dealt.join(F.broadcast(_neighbours(dealt, edges)), "key").withColumn("copy", F.lit(1)).withColumn("_part", F.col("p")).drop("p")  # bounded: a few rows a range
        dealt = dealt.unionByName(sent)
    dealt = dealt.withColumnRenamed("_part", "p").repartition(tasks, "p").sortWithinPartitions("p", "key", "html")
    names = ["id", "url", "text", "aligned_lines", "marked_lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter()
        types = None
        now: Run | None = None
        for b in (some for batch in batches for some in sliced(batch)):
            types = types or [b.schema.field(3).type, b.schema.field(4).type, pa.string(), pa.int64(), pa.int64()]
            out: list[tuple] = []
            for p, copy, k, i, u, h in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                host, path, _ = k.split("\x01")[:3]
                found = blocks(h)
                lines = [t for t, _, _ in found]
                if now is None or (now.part, now.host) != (p, host):
                    if now:
                        out += now.done(None)
                    now = Run(p, host, lines, None)
                elif now.lines != lines:
                    out += now.done((path, found))
                    now = Run(p, host, lines, (now.path, now.blocks))
                now.add(copy, i, u, path, found)
            for at in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 1000], strict=True), types, strict=True)], names)
        if now:
            out = list(now.done(None))
            for at in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 1000], strict=True), types, strict=True)], names)

    small_batches(spark)
    return dealt.select("p", "copy", "key", "id", "url", "html").mapInArrow(run, f"id {kind}, url string, text string, aligned_lines long, marked_lines long").withColumnRenamed("id", ident)

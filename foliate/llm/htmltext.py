"""Main text of web pages by differencing each page with its nearest page of the same host.

Pages are sorted by host and URL path, so a page's neighbours are those with the nearest paths. The lines of a page and of its nearer
neighbour are aligned by their longest common subsequence: what both hold is the site's template and goes, inside articles as
outside. What the markup itself says goes too: menus, forms, scripts and the like by their elements, notices, adverts and comments by
their names. One text is often served at two addresses: a neighbour that holds the page's content, as told by its article or main
element and by the other pages near it, is a copy and passed over for the next.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import chunks
from .columns import mapped
from .store import written

#: Elements whose content is never main text.
DROPPED = frozenset("nav footer aside form script style noscript template iframe svg math button select textarea title head object canvas audio video dialog menu".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
OWN = frozenset("article main".split())
#: Elements that end a block of text; others are part of the line they stand in.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody tfoot thead tr ul caption title script style template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may stay open; they are no containers here.
LEAVES = frozenset("p li dd dt tr h1 h2 h3 h4 h5 h6 option caption legend summary".split())
#: Names in class, id or role of parts that are not main text, and those that are so only outside the article.
_NAMED = re.compile(r"(?:^|(?<!has)(?<!with)(?<!no)[_-]|\s)(?:ad|ads|adsense|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|notices|alert|popup|modal|newsletter|subscribe|signup|sidebar|widget|menu|navigation|navbar|nav|breadcrumbs?|footer|share|sharing|social|related|recommended|comment|comments|commentlist|disqus|respond|replies|contentinfo|complementary|search)(?:$|[\s_-])", re.I)
_NAMED_OUTSIDE = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar|banner)(?:$|[\s_-])", re.I)
#: What a "<" begins: a comment, a declaration, or a tag with its slash, name and attributes up to the ">" outside quotes.
_OPEN = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*>")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Of an article or main element a whole class has to say so: "related-topic" is an article about something related.
_NAMED_WHOLE = re.compile(r"(?:^|\s)(?:ad|advert|banner|sponsored|promo|related|recommended|comment|sidebar|widget|teaser)(?:$|\s)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
#: A page that holds at least this part of another's content, by characters, is its copy, which says nothing about a template.
COPY_SHARE = 0.8
#: Without a third page to tell content from template, copies differ in this part of their characters at most.
SAME_SHARE = 0.02
#: Pages on either side that are looked at.
REACH = 2
#: Rows of the sample for each range of pages.
SAMPLED = 32
#: Pages of a range, as far as there are no more than MOST_RANGES, whose bounds one broadcast holds; beyond that ranges grow, and are sorted on disk.
RANGE_PAGES = 256
MOST_RANGES = 50_000
#: Ranges that a task gets on average: several even out.
RANGES_A_TASK = 8


@dataclass
class Line:
    text: str
    dropped: bool
    own: bool


def lines(page: str | None) -> list[Line]:
    """Blocks of text in page order, each with white space as single blanks, whether the markup rules it out, and whether it is inside an article."""
    out: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, dropped, own: including what is around
    at, page = 0, page or ""
    opened: Counter[str] = Counter()  # of the stack, by name
    closed: dict[str, int] = {}  # where the search for a closing tag has found none: from there on there is none
    quoted = True  # until a quote that never closes; from then on a tag ends with the next ">"

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Line(text, stack[-1][1] if stack else False, stack[-1][2] if stack else False))

    def after(name: str, otherwise: int) -> int:
        """The place behind the next closing tag of that name."""
        if name not in closed:
            if end := re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at):
                return end.end()
            closed[name] = at
        return otherwise

    while (begin := page.find("<", at)) >= 0:
        m = _OPEN.match(page, begin)
        if not m:  # a bare "<" is text
            parts.append(page[at : begin + 1])
            at = begin + 1
            continue
        if not m[2]:
            parts.append(page[at:begin])
            mark = "-->" if m[0] == "<!--" else ">"
            end = page.find(mark, m.end())
            at = end + len(mark) if end >= 0 else len(page)
            continue
        rest = _REST.match(page, m.end()) if quoted else None
        if rest is None:
            quoted = False
            end = page.find(">", m.end())
            if end < 0:
                break
            attributes, then = page[m.end() : end], end + 1
        else:
            attributes, then = rest[0][:-1], rest.end()
        parts.append(page[at:begin])
        at = then
        name, closing = m[2].lower(), bool(m[1])
        if name in BLOCKS:
            flush()
        elif name in ("br", "td", "th"):
            parts.append(" ")
        if closing:
            if opened[name]:
                flush()
                while (top := stack.pop()[0]) != name:
                    opened[top] -= 1
                opened[name] -= 1
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in RAW:
            at = after(name, len(page))
            continue
        dropped, own = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        names = " ".join(x for n in _NAMES.findall(attributes) for x in n if x) if attributes else ""
        if name in DROPPED or (name == "header" and not own):
            dropped = True
        elif name in OWN:
            dropped = dropped or bool(names and _NAMED_WHOLE.search(names)) or bool(attributes and _HIDDEN.search(attributes))
        elif name not in ("html", "body") and ((names and (_NAMED.search(names) or (not own and _NAMED_OUTSIDE.search(names)))) or (attributes and _HIDDEN.search(attributes))):
            dropped = True
        if name in BLOCKS and name not in LEAVES:
            stack.append((name, dropped, own or (name in OWN and not dropped)))
            opened[name] += 1
        elif dropped and not (stack and stack[-1][1]):
            # A small element ruled out by its name ends with its own closing tag.
            at = after(name, at)
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def common(a: list[str], b: list[str]) -> set[int]:
    """Positions in `a` of a longest common subsequence with `b`: what both begin and end with, and in between by chains of matches."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = {*range(head), *range(len(a) - tail, len(a))}
    return ends | {i + head for i in _chained(a[head : len(a) - tail], b[head : len(b) - tail])}


def _chained(a: list[str], b: list[str]) -> set[int]:
    places: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    ends: list[int] = []  # least end in b of a common subsequence of each length
    last: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(ends, j)
            link = (i, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(link)
            elif j < ends[k]:
                ends[k], last[k] = j, link
    found, link = set(), last[-1] if last else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def _weight(page: list[Line], at: set[int]) -> int:
    return sum(len(page[i].text) for i in at)


def template(page: list[Line], near: list[list[Line]]) -> set[int]:
    """Positions in `page` of the lines that the nearest page in `near` which is no copy of it holds too."""
    kept = {i for i, x in enumerate(page) if not x.dropped}
    own = {i for i in kept if page[i].own}
    total = _weight(page, kept)
    texts = [x.text for x in page]
    shared = [common(texts, [x.text for x in other]) for other in near]
    left = [kept - x for x in shared]
    for k, other in enumerate(near):
        # What a third page leaves of this one is content, if that page has the template: a copy holds nearly all of it.
        seen = [x for j, x in enumerate(left) if j != k and len(x) < len(kept) and _weight(page, x) > SAME_SHARE * total]
        copy = all(_weight(page, x & left[k]) <= (1 - COPY_SHARE) * _weight(page, x) for x in seen)
        theirs = sum(len(x.text) for x in other if x.own and not x.dropped)
        if own and theirs:
            copy = copy and _weight(page, own & shared[k]) >= COPY_SHARE * min(_weight(page, own), theirs)
        elif not seen:
            copy = _weight(page, left[k]) <= SAME_SHARE * total
            if copy and len(near) > 1:
                # Beside several pages with text of their own, one without any is bare template.
                copy = sum(len(x.text) for x in other if not x.dropped) <= (1 + SAME_SHARE) * total
        if not copy:
            return shared[k]
    return shared[0] - own if near and own else set()


def main_text(page: list[Line], near: list[list[Line]] | None) -> str:
    """The lines that neither the markup nor the pages near it, nearest first, rule out."""
    shared = template(page, near or [])
    return "\n".join(x.text for i, x in enumerate(page) if not x.dropped and i not in shared)


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _ranges(rows: DataFrame) -> tuple[DataFrame, int]:
    """`rows` with `part`, a range of (host, path, key), and `context`: true in copies of the REACH rows before and after each range; and into how many tasks to deal the ranges.

    The bounds of the ranges come from a sample and only balance the load. They, and the first and last places of the ranges, are
    all that reaches the driver: some tens of bytes for each range. The columns besides host, path and key are read once.
    """
    spark = rows.sparkSession
    names = ["host", "path", "key"]
    place = F.struct(*names)
    keys = rows.select(*names)
    n = keys.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(RANGES_A_TASK * tasks, min(n // RANGE_PAGES, MOST_RANGES))
    tasks = max(tasks, parts // RANGES_A_TASK)
    if not n:
        return rows.withColumns({"part": F.lit(0), "context": F.lit(False)}), 1
    # By hash, so that a second run of the plan takes the same rows: about SAMPLED for each range, whatever the table's size.
    some = keys.where(F.pmod(F.xxhash64(*names), F.lit(max(n // (parts * SAMPLED), 1))) == 0)
    some = some.withColumn("b", F.ntile(parts).over(Window.orderBy(*names)))
    bounds = some.groupBy("b").agg(F.min(place).alias("at")).where("b > 1").agg(F.sort_array(F.collect_set("at")).alias("bounds"))
    bounds = F.broadcast(written(bounds, "page-bounds"))  # one row of less than `parts` places
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(parts.bit_length()))])
    # How many bounds are not greater, by halving.
    count = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size("bounds")) & (F.get(F.col("bounds"), at + step - 1) <= place), at + step).otherwise(at))
    with_part = lambda df: df.crossJoin(bounds).withColumn("part", count).drop("bounds")
    first, last = (F.row_number().over(Window.partitionBy("part").orderBy(*[f(c) for c in names])) for f in (F.asc, F.desc))
    edges = with_part(keys.distinct()).select("*", first.alias("first"), last.alias("last")).where((F.col("first") <= REACH) | (F.col("last") <= REACH))
    ends = sorted(((r.part, -r.last, r.host, r.path, r.key) for r in edges.collect()), key=lambda r: r[:2])
    of = [r[0] for r in ends]
    wanted = set()
    for part in set(of):
        lo, hi = bisect_left(of, part), bisect_right(of, part)
        wanted |= {(*r[2:], part) for r in [*ends[max(lo - REACH, 0) : lo], *ends[hi : hi + REACH]]}
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    more = spark.createDataFrame(list(wanted), f"{kinds}, also int").groupBy(*names).agg(F.collect_list("also").alias("also"))
    more = F.broadcast(more.select(*[F.col(c).alias(f"m_{c}") for c in names], "also"))  # 2 * REACH rows a range at most
    own = F.array(F.struct(F.col("part").alias("to"), F.lit(False).alias("context")))
    theirs = F.coalesce(F.transform("also", lambda p: F.struct(p.alias("to"), F.lit(True).alias("context"))), F.slice(own, 1, 0))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in names])
    both = with_part(rows).join(more, same, "left").withColumn("x", F.explode(F.concat(own, theirs)))
    return both.select(*rows.columns, F.col("x.to").alias("part"), F.col("x.context").alias("context")), tasks


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text): the main text of each page, empty where there is none.

    Pages are dealt out by ranges of host, path and key, so a host of any size is spread over tasks; each task reads its ranges in
    order and holds five pages. Copies of the rows next to a range come along, so that the result does not depend on where ranges
    end. Of the two pages before and the two after, those with the longer common path come first, the nearer and then the later of
    equals. Null pages and URLs count as empty; pages without a host are no partners. Repeated rows each get a row, and are each
    other's neighbours, so a copy is passed over as any copy is. Other columns are not read.
    """
    place = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)", 2)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.lower(place).alias("host"), path.alias("path"), F.col(page).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: list[tuple] = []  # up to REACH pages before the one at `at`, it, and those after: all of one range
        at, done = 0, []

        def settle() -> None:
            own = window[at]
            if own[6]:
                return
            near = [(-_prefix(x[3], own[3]), abs(i - at), i < at, x) for i, x in enumerate(window) if i != at and own[2] and x[2] == own[2]]
            near.sort(key=lambda x: x[:3])
            done.append((own[0], own[1], main_text(own[7], [x[3][7] for x in near])))

        for batch in chunks(batches, "text"):
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if window and window[-1][5] != row[5]:
                    for at in range(at, len(window)):
                        settle()
                    window, at = [], 0
                window.append((*row, lines(row[4])))
                if len(window) > at + REACH:
                    settle()
                    at += 1
                    if at > REACH:
                        del window[0]
                        at -= 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((batch.column(0).type, pa.string(), pa.string()))], ["key", "url", "text"])
                done = []
            kind_of_key = batch.column(0).type
        for at in range(at, len(window)):
            settle()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((kind_of_key, pa.string(), pa.string()))], ["key", "url", "text"])

    ranged, tasks = _ranges(rows)
    near = ranged.repartition(tasks, "part").sortWithinPartitions("part", "host", "path", "key", "text")
    out = mapped(near, run, f"key {kind}, url string, text string")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text")

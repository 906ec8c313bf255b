"""Main text of web pages, by differencing each page with its nearest neighbour by URL.

A page becomes lines: its text blocks in page order. Within each host, pages are sorted by URL path and each
is paired with the neighbour that shares the longer part of its path (with the other one if the first has the
same lines all through). Their lines are aligned by longest common subsequence, and what a page shares with its
neighbour is deleted; of articles and main elements, those count whose text is longer without what is shared.
Markup is further evidence: what nav, footer, adverts and the like hold is furniture though no neighbour has it, and
paragraphs of an article stay though a neighbour has them, as passages are copied too.

Malformed markup: end tags that HTML lets one leave out are implied (p, li, dt, dd, tr, td, th and so on, as its
parsing rules state), an end tag that nothing open answers to is passed over, and one of an inline element ends
nothing outside its block. Comments, scripts and tags that do not end go to the end of the page.
"""

from __future__ import annotations

import hashlib
import html
import re
import struct
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut

#: Elements whose content is never text of the article.
DROPPED = frozenset("head nav header footer aside form script style noscript template svg iframe button select textarea dialog object audio video canvas menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of class and id names that mark furniture: these always, those below unless the name also speaks of content.
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar cookie cookies consent popup modal newsletter subscribe signup social share sharing comment comments disqus pagination pager".split())
WEAK_NAMES = frozenset("promotion banner widget footer header masthead notice related recommended teaser teasers card cards".split())
CONTENT_NAMES = frozenset("article post entry content story body main text title work".split())
#: Fixed values of HTML's rules: what ends an open p; what ends which open elements, within which others alone.
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd".split())
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("table",)),
    "th": (("td", "th"), ("table",)),
    "tr": (("tr",), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
    "optgroup": (("optgroup", "option"), ("select",)),
}
#: Elements that an open p outside them is not seen from.
P_SCOPE = ("td", "th", "caption", "button", "object", "table", "html")
#: Elements whose text is an article's own; other text inside an article, such as that of a bare div, may be furniture.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul title option".split())
RAW = frozenset("script style textarea title noscript iframe template".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.S)
#: One attribute, its value consumed with it, so that no name is looked for inside a value.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
_RAW_ENDS = {tag: re.compile(rf"</{tag}\b", re.I) for tag in RAW}
_SPACE = re.compile(r"\s+")
#: How a line stands: inside an article, inside a main element, elsewhere in the body, or inside furniture.
ARTICLE, MAIN, BODY, FURNITURE = 0, 1, 2, 3


def _named_furniture(names: str) -> bool:
    for name in names.split():
        words = set(re.split(r"[_-]+", name))
        if words & NAMES or words & WEAK_NAMES and not words & CONTENT_NAMES:
            return True
    return False


def _furniture(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is furniture, and whether it is the main element by its role. An article's own header is not;
    an article element is, if its name says that it is a comment, a teaser or the like."""
    if tag in DROPPED and not (tag == "header" and in_article):
        return True, False
    main = False
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False
        if name == "role":
            if value in ROLES:
                return True, False
            main = value == "main"
        elif name in ("class", "id") and tag not in ("body", "html", "main") and _named_furniture(value):
            return True, False
    return False, main


class Line(NamedTuple):
    text: str
    stands: int
    prose: bool


class _Open:
    """The open elements: each with its kind, and for each name where they stand, so that nothing is searched for."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.kinds = [0, 0, 0, 0]

    def push(self, tag: str, kind: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, kind))
        self.kinds[kind] += 1

    def pop(self) -> int:
        tag, kind = self.stack.pop()
        self.places[tag].pop()
        if tag in BLOCKS:
            self.blocks.pop()
        self.kinds[kind] -= 1
        return kind

    def last(self, tags: Sequence[str]) -> int:
        """Where the last open element of one of these names stands, -1 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def block(self) -> str:
        return self.stack[self.blocks[-1]][0] if self.blocks else ""

    def ended_by_start(self, tag: str) -> int:
        """From which place on a start tag ends what is open; beyond the last if it ends nothing."""
        place = len(self.stack)
        if tag in ENDS:
            ended, within = ENDS[tag]
            at = min((self.places[t][-1] for t in ended if self.places.get(t) and self.places[t][-1] > self.last(within)), default=-1)
            place = at if at >= 0 else place
        if tag in ENDS_P:
            at = self.last(("p",))
            place = min(place, at) if at > self.last(P_SCOPE) else place
        return place

    def ended_by_end(self, tag: str) -> int:
        at = self.last((tag,))
        # An inline element's end tag does not end the block that it stands in.
        return at if at >= 0 and (tag in BLOCKS or not self.blocks or self.blocks[-1] < at) else len(self.stack)


def lines_of(page: str | None) -> list[Line]:
    """Text blocks in page order, with white space inside made one space, and how each stands. Time is in step with
    the length of the page, whatever is left open in it."""
    page = page or ""
    out, text, open_, at = [], [], _Open(), 0

    def flush() -> None:
        line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        text.clear()
        if line:
            _, dropped, articles, mains = open_.kinds
            out.append(Line(line, FURNITURE if dropped else ARTICLE if articles else MAIN if mains else BODY, open_.block() in PROSE))

    def close(place: int) -> None:
        while len(open_.stack) > place:
            if open_.stack[-1][1] == 1 and open_.kinds[1] == 1:
                flush()
            open_.pop()

    while at < len(page):
        token = _TOKEN.search(page, at)
        text.append(page[at : token.start() if token else len(page)])
        if not token:
            break
        at, tag = token.end(), (token[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if token[1]:
            close(open_.ended_by_end(tag))
            continue
        close(open_.ended_by_start(tag))
        if tag in VOID or token[3].endswith("/") and tag not in BLOCKS:
            continue
        furniture, main = _furniture(tag, token[3], open_.kinds[2] > 0)
        if furniture and not open_.kinds[1]:
            flush()
        open_.push(tag, 1 if furniture else 2 if tag == "article" else 3 if tag == "main" or main else 0)
        if tag in RAW:
            end = _RAW_ENDS[tag].search(page, at)
            at = end.start() if end else len(page)
    flush()
    return out


def shared(own: Sequence, other: Sequence) -> set[int]:
    """Positions of `own` in one longest common subsequence with `other`; rows are bit vectors, memory linear."""
    lo, hi = 0, 0
    while lo < min(len(own), len(other)) and own[lo] == other[lo]:
        lo += 1
    while hi < min(len(own), len(other)) - lo and own[-1 - hi] == other[-1 - hi]:
        hi += 1
    found = {*range(lo), *range(len(own) - hi, len(own))}
    return found | {lo + i for i in _aligned(own[lo : len(own) - hi], other[lo : len(other) - hi])}


def _lengths(own: Sequence, other: Sequence) -> list[int]:
    """Of the longest common subsequence of `own` and each prefix of `other`."""
    places: dict = {}
    for j, x in enumerate(other):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(other)) - 1
    row = full
    for x in own:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    out = [0]
    for bit in reversed(f"{row:0{max(1, len(other))}b}") if other else "":
        out.append(out[-1] + (bit == "0"))
    return out


def _aligned(own: Sequence, other: Sequence) -> set[int]:
    places = {x: j for j, x in enumerate(other)}
    at = [i for i, x in enumerate(own) if x in places]
    if not at:
        return set()
    if len(places) == len(other) and len({own[i] for i in at}) == len(at):
        return {at[k] for k in _increasing([places[own[i]] for i in at])}
    return _split(own, other)


def _increasing(places: list[int]) -> set[int]:
    """Positions of one longest increasing run of distinct places."""
    tails, ends, before = [], [], []
    for i, p in enumerate(places):
        k = bisect_left(tails, p)
        before.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(p)
            ends.append(i)
        else:
            tails[k], ends[k] = p, i
    found, at = set(), ends[-1]
    while at >= 0:
        found.add(at)
        at = before[at]
    return found


def _split(own: Sequence, other: Sequence) -> set[int]:
    if len(own) == 1:
        return {0} if own[0] in other else set()
    half = len(own) // 2
    front, back = _lengths(own[:half], other), _lengths(own[half:][::-1], other[::-1])
    k = max(range(len(other) + 1), key=lambda j: front[j] + back[len(other) - j])
    return _aligned(own[:half], other[:k]) | {half + i for i in _aligned(own[half:], other[k:])}


def candidates(stands: Sequence[int], weights: Sequence[int] | None = None) -> list[int]:
    """Positions of the lines that can be main text: those of articles or those of main elements, whichever weigh more
    (articles, if alike), else those of the body outside furniture. Without weights each line weighs the same."""
    of = lambda place: [i for i, s in enumerate(stands) if s == place]
    weight = lambda place: sum(1 if weights is None else weights[i] for i in of(place))
    able = [p for p in (ARTICLE, MAIN) if p in stands]
    return of(max(able, key=weight) if able else BODY)


def kept(stands: Sequence[int], prose: Sequence[bool], lengths: Sequence[int], same: set[int]) -> list[int]:
    """Positions of the lines of the main text: the candidates by the length of what no neighbour shares (by their
    whole length, if all is shared), without those that a neighbour has too, but for the paragraphs of articles and
    main elements. A page that would lose all is a copy and loses none."""
    own = [0 if i in same else n for i, n in enumerate(lengths)]
    inside = any(own[i] for i, s in enumerate(stands) if s in (ARTICLE, MAIN))
    able = candidates(stands, own if inside else lengths)
    stay = [i for i in able if i not in same or stands[i] != BODY and prose[i]]
    return stay or able


_MARK = struct.Struct("<QBI")


def marks_of(lines: list[Line]) -> bytes:
    """Of each line a 64-bit digest of its text, how it stands and its length, which is all that a comparison needs."""
    return b"".join(_MARK.pack(int.from_bytes(hashlib.blake2b(x.text.encode("utf-8", "replace"), digest_size=8).digest(), "little"), x.stands | 4 * x.prose, min(len(x.text), 2**32 - 1)) for x in lines)


def compare(own: bytes, *others: bytes | None) -> tuple[int, int, int, list[int]]:
    """(lines, lines shared, lines that differencing decides, positions to delete among the lines outside furniture) of
    a page's marks against the first neighbour that has other lines. Differencing decides a line that would stay
    without a neighbour and goes, or the other way round."""
    lines = list(_MARK.iter_unpack(own))
    same: set[int] = set()
    for other in others:
        if other is not None and other != own:
            same = shared([d for d, _, _ in lines], [d for d, _, _ in _MARK.iter_unpack(other)])
            break
    stands, prose, lengths = [f & 3 for _, f, _ in lines], [bool(f & 4) for _, f, _ in lines], [n for _, _, n in lines]
    stay = set(kept(stands, prose, lengths, same))
    decided = stay ^ set(kept(stands, prose, lengths, set()))
    text = [i for i, s in enumerate(stands) if s != FURNITURE]
    return len(lines), len(same), len(decided), [k for k, i in enumerate(text) if i not in stay]


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""), r"[?#].*$", "")


def neighbours(pages: DataFrame, n_ranges: int) -> DataFrame:
    """(rid, near, far): of pages (rid, host, path) the neighbours of the same host in (host, path, rid) order, first
    the one that shares more of the path, of both alike the one before; null where there is none.

    Pages are dealt by ranges of that order, so a host of many pages spans many tasks; only the ends of each
    range, two rows a task, meet to link the ranges. The links do not depend on the ranges.
    """
    ranges = pages.repartitionByRange(n_ranges, "host", "path", "rid").sortWithinPartitions("host", "path", "rid")
    dealt = cut(ranges.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33)), "url-order")
    order = Window.partitionBy("range").orderBy("at")
    row = F.struct("rid", "host", "path")
    ends = dealt.groupBy("range").agg(F.min_by(row, "at").alias("first"), F.max_by(row, "at").alias("last"))
    across = Window.orderBy("range")  # one row for each range
    ends = ends.select("range", F.lag("last").over(across).alias("before"), F.lead("first").over(across).alias("after"))
    linked = dealt.withColumn("prev", F.lag(row).over(order)).withColumn("next", F.lead(row).over(order)).join(F.broadcast(ends), "range")
    linked = linked.withColumn("prev", F.coalesce("prev", "before")).withColumn("next", F.coalesce("next", "after"))

    def alike(side: str) -> Column:
        pieces, others = F.split("path", "/"), F.split(f"{side}.path", "/")
        same = F.transform(F.array(F.struct(pieces.alias("a"), others.alias("b"))), lambda x: F.aggregate(F.sequence(F.lit(0), F.least(F.size(x["a"]), F.size(x["b"])) - 1), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, i: F.struct((s["on"] & (F.get(x["a"], i) == F.get(x["b"], i))).alias("on"), (s["n"] + (s["on"] & (F.get(x["a"], i) == F.get(x["b"], i))).cast("int")).alias("n")))["n"])[0]
        return F.when(F.col(f"{side}.host") == F.col("host"), same)

    linked = linked.withColumn("p", alike("prev")).withColumn("n", alike("next"))
    # p and n are null where there is no such neighbour.
    turned = F.col("p").isNull() | (F.col("n") > F.col("p"))
    before, after = F.when(F.col("p").isNotNull(), F.col("prev.rid")), F.when(F.col("n").isNotNull(), F.col("next.rid"))
    return linked.select("rid", F.when(turned, after).otherwise(before).alias("near"), F.when(turned, before).otherwise(after).alias("far"))


def _parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(rid, page_id, url, text, marks): the lines outside furniture, and the marks of all lines."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lines_of(page) for page in batch.column(3).to_pylist()]
            texts = ["\n".join(x.text for x in f if x.stands != FURNITURE) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(texts, pa.string()), pa.array(map(marks_of, found), pa.binary())], ["rid", "page_id", "url", "text", "marks"])

    rows = bounded_batches(pages).select(F.monotonically_increasing_id().alias("rid"), pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    return cut(rows.mapInArrow(parse, "rid long, page_id long, url string, text string, marks binary"), "page-lines")


def _compared(parsed: DataFrame) -> DataFrame:
    """(rid, n_lines, n_shared, n_decided, gone) of every page (see compare)."""
    places = parsed.select("rid", _host(F.col("url")).alias("host"), _path(F.col("url")).alias("path")).filter("host is not null")
    links = cut(neighbours(places, max(1, min(2000, parsed.count() // 2000))).filter("near is not null"), "neighbours")
    marks = lambda side: parsed.select(F.col("rid").alias(side), F.col("marks").alias(f"{side}_marks"))
    paired = parsed.select("rid", "marks").join(links, "rid", "left").join(marks("near"), "near", "left").join(marks("far"), "far", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [compare(*x) for x in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            columns = zip(*got, strict=True) if got else ([], [], [], [])
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["rid", "n_lines", "n_shared", "n_decided", "gone"])

    return paired.select("rid", "marks", "near_marks", "far_marks").mapInArrow(run, "rid long, n_lines long, n_shared long, n_decided long, gone array<int>")


def differences(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Returns page_id, n_lines, n_shared (with its neighbour), n_deleted (lines whose fate differencing turns)."""
    parsed = _parsed(pages, id_col, url_col, html_col)
    return _compared(parsed).join(parsed.select("rid", "page_id"), "rid").select("page_id", "n_lines", "n_shared", F.col("n_decided").alias("n_deleted"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Returns page_id, url, text, n_chars (code points), one row per input row.

    Null html counts as empty and gives empty text. A null url belongs to no host, so its page has no neighbour.
    Pages that repeat an id or a url are pages of their own. Lines are compared by 64-bit digests. An empty table
    gives an empty result. Other columns are not read.
    """
    parsed = _parsed(pages, id_col, url_col, html_col)
    gone = cut(_compared(parsed).filter("size(gone) > 0").select("rid", "gone"), "page-differences")
    lines = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    out = parsed.join(gone, "rid", "left").select("page_id", "url", text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))

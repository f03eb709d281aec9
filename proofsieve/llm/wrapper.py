"""HTML extraction by wrappers: union-free regular expressions over token streams, inferred from pages of one host.

A page's tokens are its tags and texts. A level of an expression is what stands between an opening tag and its close: a
list of cells, each an element, a text or a repeated group of those. Pages are aligned one after the other. Where
streams differ in text, the text becomes a slot; where one has a token that the other lacks, it becomes optional; where
a token comes again or in another order, everything between becomes a repeated group of optional parts. No level has the
same token in two cells, so that aligning is finding the longest common sequence of tokens. Expressions align with each
other as pages do: tasks infer wrappers of the pages they have, which are aligned further, host by host.

Besides, each element of a wrapper knows how much text and how much link text a page has in it at most, and which of its
lines all pages have in common. All of that is the same however often a page is there and in whatever order pages come.
From it follows where a host has its text, see Reading: which of its elements hold the article, which lines are part of
the template wherever they stand, which blocks are lists of links, and whether an element named like a menu or an advert
is one.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsieve.session import checkpointed, ship

#: What stands in a tag behind its name: quotes hold a value only after an equals sign, elsewhere they are letters like others.
INSIDE = r"(?:=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?|[^>=])*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|svg|iframe)\b{INSIDE}(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({INSIDE})(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tags that end by themselves where the same tag, or one of the group, opens again.
CLOSES = {t: g for g in (frozenset({"p"}), frozenset({"li"}), frozenset({"dt", "dd"}), frozenset({"td", "th"}), frozenset({"tr"}), frozenset({"option"})) for t in g}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset({"article", "main"})
#: Elements whose names say nothing about their text, as they hold all of it.
WHOLE = MAIN | {"html", "body"}
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: What heads a page, and within an article the article.
HEADS = frozenset({"header", "masthead", "banner"})
#: Elements and roles, found in class, id or role, that are not the text of a page.
OTHER_TAGS = frozenset("head nav header footer aside form button select dialog menu object canvas audio video".split())
OTHER_ROLES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies consent disclaimer discussion disqus dialog footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related respond reply replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Beyond this depth the texts of elements belong to the one at it, but for those of main elements and of what is no text.
DEPTH = 60
#: Longer texts are compared by a hash.
LONG = 200
#: Different pages that it takes to tell a template from the text in it.
DIFFERENT = 2
#: Parts of names that say where an element stands or what it looks like, and not what it is.
PLAIN_PARTS = frozenset("bar block bottom box col column container global inner item items left list main outer page pane panel primary right row secondary section site text top wrap wrapper".split())
#: An article element is taken for the article if it has this share of the text, and if it has half as much as the largest.
TRUSTED, BESIDE = 0.2, 0.5
#: A block of a page without article elements is a list of links if links have this share of its text.
LINKS = 0.8

# A level is a list of cells [repeated, [entry, ...]]. An entry is ["#", optional, text or null for a slot], or for an
# element [label, optional, level, on every page, characters outside links, in links, [[hash, length] of common lines]].
Level = list


def label_of(tag: str, attributes: str) -> str:
    """The tag, and the roles that its attributes name: labels are few, whatever names a site invents.

    A name counts if all its parts are roles or say nothing: `ad-box` and `site-footer` do, `has-sidebar` does not.
    """
    roles = set()
    if attributes and "=" in attributes and tag not in WHOLE:
        for m in ATTRIBUTE.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "role" and value in MAIN:
                roles.add("main")
            for name in value.split():
                parts = WORDS.findall(CAMEL.sub("-", name).lower())
                named = OTHER_ROLES.intersection(parts)
                if named and all(x in named or x in PLAIN_PARTS for x in parts):
                    roles |= named
    return ".".join([tag, *sorted(roles)])


def parse(page: str) -> list:
    """The page's nested tokens: texts as strings, elements as (label, children)."""
    root: list = []
    # tag, where its texts go, the place of the nearest entry that is not inline, whether it is in main and in what is no text
    stack: list[tuple[str, list, int, bool, bool]] = [("", root, 0, False, False)]
    opened: Counter[str] = Counter()
    at = 0

    def close(k: int) -> None:
        for tag, *_ in stack[k:]:
            opened[tag] -= 1
        blocks = any(tag not in INLINE for tag, *_ in stack[max(k, DEPTH) :])
        del stack[k:]
        if blocks and len(stack) >= DEPTH:
            stack[-1][1].append(("div", []))  # a text after it is another block

    for m in TOKEN.finditer(page):
        if m.start() > at:
            stack[-1][1].append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue  # comments, declarations, and what holds no markup
        tag = name.lower()
        if m[2]:
            if opened[tag] > 0:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            continue
        if tag in CLOSES and stack[stack[-1][2]][0] in CLOSES[tag]:
            close(stack[-1][2])
        label = label_of(tag, m[4])
        _, parent, nearest, in_main, in_other = stack[-1]
        element = (label, [])
        parent.append(element)
        if tag not in VOID and not m[4].endswith("/"):
            main, other = in_main or _is_main(label), in_other or dropped(label, in_main)
            own = len(stack) < DEPTH or main > in_main or other > in_other
            stack.append((tag, element[1] if own else parent, nearest if tag in INLINE else len(stack), main, other))
            opened[tag] += 1
    if at < len(page):
        stack[-1][1].append(page[at:])
    return root


def build(entries: list, spans: list[tuple[int, int]], join: Callable[[list, list], list]) -> Level:
    """A level of entries in their order; entries of one label and all between them form one repeated cell.

    spans: places that form a repeated cell already; join: makes one of two entries of a label.
    """
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    for k, e in enumerate(entries):
        first.setdefault(e[0], k)
        last[e[0]] = k
    spans = sorted([*spans, *((a, last[x]) for x, a in first.items() if last[x] > a)])
    level: Level = []
    k = s = 0
    while k < len(entries):
        if s < len(spans) and spans[s][0] <= k:
            end = k
            while s < len(spans) and spans[s][0] <= end:
                end = max(end, spans[s][1])
                s += 1
            merged: dict[str, list] = {}
            for e in entries[k : end + 1]:
                merged[e[0]] = join(merged[e[0]], e) if e[0] in merged else e
            own = [*merged.values()]
            level.append([True, own if len(own) == 1 else [[e[0], True, *e[2:]] for e in own]])
            k = end + 1
        else:
            level.append([False, [entries[k]]])
            k += 1
    return level


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def lines_of(children: list) -> Iterator[tuple[str, range]]:
    """The lines of an element and the places of their pieces: runs of texts and inline elements between others."""
    start = 0
    for k, c in enumerate([*children, None]):
        if c is None or not (isinstance(c, str) or (c[0].split(".")[0] in INLINE and not _has_block(c[1]))):
            if line := " ".join("".join(_texts(children[start:k])).split()):
                yield line, range(start, k)
            start = k + 1


def _has_block(children: list) -> bool:
    return any(not isinstance(c, str) and (c[0].split(".")[0] not in INLINE or _has_block(c[1])) for c in children)


def _texts(nodes: list) -> Iterator[str]:
    for c in nodes:
        if isinstance(c, str):
            yield c
        else:
            yield from _texts(c[1])


def wrapper_of(children: list, label: str = "", linked: bool = False) -> list:
    """The entry of an element, or of a whole page, that stands for exactly what it holds."""
    tag = label.split(".")[0]
    linked = linked or tag == "a"
    entries: list = []
    chars = links = 0
    for c in children:
        if isinstance(c, str):
            if c and not c.isspace():
                text = " ".join(c.split())
                entries.append(["#", False, text if len(text) <= LONG else f"#{hash_of(text)}"])
                chars, links = chars + len(text) * (not linked), links + len(text) * linked
        else:
            own = wrapper_of(c[1], c[0], linked)
            entries.append(own)
            chars, links = chars + own[4], links + own[5]
    common = [] if tag in INLINE else sorted({(hash_of(line), len(line)) for line, _ in lines_of(children)})
    return [label, False, build(entries, [], beside), True, chars, links, [[*x] for x in common]]


def beside(a: list, b: list) -> list:
    """Two entries of one label on one page as one: together they have the lines and texts of both."""
    if a[0] == "#":
        return ["#", a[1] or b[1], a[2] if a[2] == b[2] else None]
    return [a[0], a[1] or b[1], aligned(a[2], b[2], beside), True, a[4] + b[4], a[5] + b[5], sorted(map(list, {*map(tuple, a[6]), *map(tuple, b[6])}))]


def align(a: list, b: list) -> list:
    """Two entries of one label on different pages as one."""
    if a[0] == "#":
        return ["#", a[1] or b[1], a[2] if a[2] == b[2] else None]
    shared = {*map(tuple, b[6])}
    return [a[0], a[1] or b[1], aligned(a[2], b[2], align), a[3] and b[3], max(a[4], b[4]), max(a[5], b[5]), [x for x in a[6] if tuple(x) in shared]]


def aligned(a: Level, b: Level, join: Callable[[list, list], list] = align) -> Level:
    """The expression for all that either level stands for."""
    if a == b and join is align:
        return a
    flat_a, flat_b = ([(k, c[0], e) for k, c in enumerate(x) for e in c[1]] for x in (a, b))
    x, y = [e[0] for _, _, e in flat_a], [e[0] for _, _, e in flat_b]
    entries: list = []
    cells: dict[tuple[int, int], list[int]] = {}

    def lone(entry: list, others: list[str]) -> list:
        every = [entry[3] and (join is beside or entry[0] in others), *entry[4:]] if entry[0] != "#" else []
        return [entry[0], True, entry[2], *every]

    def put(entry: list, *origins: tuple[int, int, bool]) -> None:
        for side, cell, repeated in origins:
            if repeated:
                cells.setdefault((side, cell), []).append(len(entries))
        entries.append(entry)

    if x == y:
        pairs = [(k, k) for k in range(len(x))]
    else:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        pairs, i, j = [], 0, 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                pairs.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    i = j = 0
    for p, q in [*pairs, (len(x), len(y))]:
        for k in range(i, p):
            put(lone(flat_a[k][2], y), (0, *flat_a[k][:2]))
        for k in range(j, q):
            put(lone(flat_b[k][2], x), (1, *flat_b[k][:2]))
        if p < len(x):
            put(join(flat_a[p][2], flat_b[q][2]), (0, *flat_a[p][:2]), (1, *flat_b[q][:2]))
        i, j = p + 1, q + 1
    return build(entries, [(min(v), max(v)) for v in cells.values()], join)


def expression(level: Level) -> str:
    """The wrapper as a regular expression over tokens; #PCDATA stands for a slot."""
    out = []
    for repeated, entries in level:
        parts = []
        for label, optional, inner, *_ in entries:
            own = ("#PCDATA" if inner is None else inner) if label == "#" else f"<{label}>{expression(inner)}</{label.split('.')[0]}>"
            parts.append(f"({own})?" if optional else own)
        out.append(f"({''.join(parts)})+" if repeated else "".join(parts))
    return "".join(out)


def _is_main(label: str) -> bool:
    tag, *roles = label.split(".")
    return tag in MAIN or "main" in roles


class Reading:
    """Where the pages of a host have their text, by their wrapper and how many different pages it is of.

    regions: the article elements that have the text. An article or main element is one if it has a share of the text
    beneath no menus and the like, and is not small beside the largest one. Elements that are named like a menu or an
    advert are passed over, unless they hold the heading or an article and half of all text, or all text that there is;
    what heads an article belongs to it. Lines that all pages have at a place are template if the wrapper is of
    different pages and most text of the region varies: where most is the same, pages are versions of one text.
    """

    def __init__(self, wrapper: list, pages: int) -> None:
        self.total, self.links = wrapper[4], pages >= DIFFERENT
        self.regions: set[tuple[str, ...]] = set()
        self.named: set[tuple[str, ...]] = set()  # passed over
        self.lists: set[tuple[str, ...]] = set()  # of links
        self.lines: dict[tuple[str, ...], set[int]] = {}  # that all pages have
        self.weights: dict[tuple[str, ...], int] = {}
        found: dict[tuple[str, ...], int] = {}
        common: dict[tuple[str, ...], dict[tuple[str, ...], list]] = {(): {}}  # by article element, () being the page
        self._visit(wrapper, (), (), True, True, found, common)
        other = sum(self.weights[p] for p in self.named)
        best = max(found.values(), default=0)
        if best and best >= TRUSTED * max(best, self.total - other):
            self.regions = {p for p, n in found.items() if n >= BESIDE * best}
        for top, chars in {p: found[p] for p in self.regions}.items() or [((), self.total)]:
            own = common[top]
            if pages >= DIFFERENT and 2 * sum(n for x in own.values() for _, n in x) < chars:
                self.lines |= {p: {h for h, _ in x} for p, x in own.items() if x}

    def _visit(self, entry: list, path: tuple[str, ...], top: tuple[str, ...], of_page: bool, of_top: bool, found: dict, common: dict) -> None:
        tag, _, level, _, chars, links, lines = entry
        self.weights[path] = chars
        if path and not top and _is_main(tag):
            found[path], common[path], top, of_top = chars, {}, path, True
        if self.links and path and not top and tag.split(".")[0] not in INLINE and links >= LINKS * (chars + links) > 0:
            self.lists.add(path)
        if of_page:
            common[()][path] = lines
        if top and of_top:
            common[top][path] = lines
        for _, entries in level:
            for e in entries:
                if e[0] == "#":
                    continue
                below = (*path, e[0])
                if dropped(e[0], bool(top)) and not self._holds(e):
                    self.named.add(below)
                    self.weights[below] = e[4]
                else:
                    self._visit(e, below, top, of_page and e[3], of_top and e[3], found, common)

    def _holds(self, e: list) -> bool:
        if e[0].split(".")[0] in OTHER_TAGS - {"form"} or not e[4]:
            return False
        return e[4] >= self.total or (2 * e[4] >= self.total and _heads(e))


def _heads(e: list) -> bool:
    return any(x[0] != "#" and (x[0] == "h1" or _is_main(x[0]) or _heads(x)) for _, entries in e[2] for x in entries)


def dropped(label: str, inside: bool) -> bool:
    """Whether an element is named like something that is no text, within an article or outside."""
    tag, *roles = label.split(".")
    if inside:
        return (tag in OTHER_TAGS and tag not in HEADS) or any(r in OTHER_ROLES and r not in HEADS for r in roles)
    return tag in OTHER_TAGS or any(r in OTHER_ROLES for r in roles)


def extract(children: list, reading: Reading) -> str:
    """The main text of a parsed page under its host's reading."""
    blocks: list[list[str]] = [[]]

    def passed_over(label: str, path: tuple[str, ...], inside: bool) -> bool:
        return path in reading.named or (path not in reading.weights and dropped(label, inside))

    def tops(nodes: list, path: tuple[str, ...], wanted: Callable[[str, tuple[str, ...]], bool]) -> Iterator[tuple[list, tuple[str, ...]]]:
        for c in nodes:
            if not isinstance(c, str):
                below = (*path, c[0])
                if wanted(c[0], below):
                    yield c[1], below
                elif not passed_over(c[0], below, False):
                    yield from tops(c[1], below, wanted)

    def walk(nodes: list, path: tuple[str, ...], inside: bool) -> None:
        lines = reading.lines.get(path)
        template = {k for line, run in lines_of(nodes) if hash_of(line) in lines for k in run} if lines else ()
        for k, c in enumerate(nodes):
            if k in template:
                continue
            if isinstance(c, str):
                blocks[-1].append(c)
                continue
            label, inner = c
            below = (*path, label)
            if passed_over(label, below, inside) or (not inside and below in reading.lists):
                continue
            block = label.split(".")[0] not in INLINE
            if block:
                blocks.append([])
            walk(inner, below, inside)
            if block:
                blocks.append([])

    found = [*tops(children, (), lambda label, path: path in reading.regions)] or [*tops(children, (), lambda label, path: _is_main(label))]
    if not reading.regions and reading.total:
        found = []  # the wrapper doesn't trust them
    for nodes, path in found or [(children, ())]:
        walk(nodes, path, bool(found))
        blocks.append([])
    texts = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return " ".join(t for t in texts if t)


def _host(url: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """Rows (host, pages, different, wrapper): the wrapper, as JSON, of each host's pages (host, html), and the least
    hashes, DIFFERENT at most, of pages that differ in tags or texts.

    Tasks align the pages they have; partial wrappers are aligned in groups of a few, until each host has one. What
    travels is wrappers, whose size doesn't depend on how many pages they stand for.
    """
    ship(pages.sparkSession)
    schema = "host string, pages long, different array<long>, wrapper string"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[int, list[int], list]] = {}

        def flushed() -> pa.RecordBatch:
            rows = [(h, n, d, json.dumps(w)) for h, (n, d, w) in found.items()]
            found.clear()
            return pa.RecordBatch.from_pydict({"host": pa.array([r[0] for r in rows], pa.string()), "pages": pa.array([r[1] for r in rows], pa.int64()), "different": pa.array([r[2] for r in rows], pa.list_(pa.int64())), "wrapper": pa.array([r[3] for r in rows], pa.string())})

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parsed = parse(page or "")
                own = wrapper_of(parsed)
                hashed = xxhash.xxh64_intdigest(json.dumps(parsed)) >> 1
                n, different, before = found.get(host, (0, [], None))
                found[host] = (n + 1, sorted({*different, hashed})[:DIFFERENT], own if before is None else align(before, own))
            if len(found) > 20_000:
                yield flushed()
        yield flushed()

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        ordered = sorted(zip(group["wrapper"], group["pages"]))
        level = reduce(align, (json.loads(w) for w, _ in ordered))
        different = sorted({int(x) for d in group["different"] for x in d})[:DIFFERENT]
        return pd.DataFrame({"host": [group["host"].iloc[0]], "pages": [int(group["pages"].sum())], "different": [different], "wrapper": [json.dumps(level)]})

    now = checkpointed(pages.select("host", "html").mapInArrow(partial, schema).groupBy("host", "wrapper").agg(F.sum("pages").alias("pages"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("different")))), 1, DIFFERENT).alias("different")).select("host", "pages", "different", "wrapper"))
    while (most := now.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        parts = 1 if most <= 64 else -(-most // 64)
        group = F.pmod(F.xxhash64("wrapper"), F.lit(parts)).alias("g")
        now = checkpointed(now.groupBy("host", group).applyInPandas(joined, schema))
    return now


NO_WRAPPER = ["", False, [], True, 0, 0, []]
#: Characters of wrappers that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_CHARS = 32_000_000


def main_text(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars) for each row of pages (page_id, url, html): the main text of whole pages.

    A null html is an empty page; pages without a host in their url form a group of their own; repeated rows come out
    as often as they come in; an empty table gives no rows; further columns are left out.
    """
    own = pages.select("page_id", "url", "html", _host("url").alias("host"))
    found = wrappers(own)
    size = found.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    sides = found.select("host", F.size("different").cast("long").alias("pages"), "wrapper")
    joined = own.join(F.broadcast(sides) if size <= BROADCAST_CHARS else sides, "host", "left").select("page_id", "url", "html", "pages", "wrapper")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[tuple[str | None, int | None], Reading] = {}
        for batch in batches:
            texts = []
            for page, n, w in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4))):
                if len(read) > 5000:
                    read.clear()
                if (w, n) not in read:
                    read[w, n] = Reading(json.loads(w) if w else NO_WRAPPER, n or 0)
                texts.append(extract(parse(page or ""), read[w, n]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(extracted, f"page_id {kind}, url string, text string, n_chars long")

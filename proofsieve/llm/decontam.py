"""Benchmark decontamination by pigeonhole edit matching.

Test items and documents are compared in lower case with every run of other characters than letters and digits as one
space. An item of n characters may be found with up to n * rate edits; it is split into one more piece than that, so
that at least one piece is found exactly in any such place. An Aho-Corasick automaton finds the pieces in whole texts,
and Myers' bit-parallel distance verifies the place around each hit.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsieve.session import ship

OTHER = re.compile(r"[\W_]+")
#: Characters of items that are searched for at once; more are searched for in further blocks.
BLOCK_CHARS = 4_000_000
RATE = 0.06
SLICE = 256

Item = tuple[int, str]


def plain(text: str | None) -> str:
    """The text as it is compared, with a space at either end; empty if it has no letters or digits."""
    words = OTHER.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else ""


def myers(pattern: str, text: str) -> list[int]:
    """For each end in text, the least edits between the pattern and some part of text that ends there."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[str, int] = defaultdict(int)
    for k, c in enumerate(pattern):
        masks[c] |= 1 << k
    up, down, score, out = full, 0, m, []
    for c in text:
        eq = masks.get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq
        h_up, h_down = down | ~(d | up) & full, up & d
        if h_up & top:
            score += 1
        elif h_down & top:
            score -= 1
        h_up = h_up << 1 & full
        h_down = h_down << 1 & full
        up, down = h_down | ~(x | h_up) & full, h_up & x
        out.append(score)
    return out


def places(pattern: str, text: str, budget: int) -> list[tuple[int, int, int]]:
    """(edits, start, end) of places of the pattern in text within the budget, from left to right and apart.

    Of ends that lie within half a pattern's length, that with the least edits counts, then the first; the next place
    ends a pattern less its budget and a space behind it, or later.
    """
    scores = myers(pattern, text)
    ends = [k for k, n in enumerate(scores) if n <= budget]
    m, reverse = len(pattern), pattern[::-1]
    found: list[tuple[int, int, int]] = []
    k = free = 0
    while k < len(ends):
        near = [e for e in ends[k : k + m] if e < ends[k] + max(1, m // 2)]
        best = min(near, key=scores.__getitem__)
        low = max(0, free - 1, best + 1 - m - budget)  # neighbours share the space between them
        back = myers(reverse, text[low : best + 1][::-1])
        least = min(back)
        if least <= budget:
            free = best + 1
            found.append((least, best - back.index(least), free))
            near = [e for e in ends[k : k + 2 * m] if e < best + max(1, m - 1 - budget)]
        k += len(near)
    return found


class Search:
    """Finds items in texts."""

    def __init__(self, items: list[Item], rate: float) -> None:
        self.items = [(item, text, int((len(text) - 2) * rate)) for item, text in items]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for own, (_, text, budget) in enumerate(self.items):  # by place: an id may have several texts
            cuts = [len(text) * k // (budget + 1) for k in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces[text[a:b]].append((own, a))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) of each place."""
        if not self.items or not text:
            return []
        windows: dict[int, list[list[int]]] = defaultdict(list)
        for last, (n, owners) in self.automaton.iter(text):
            for own, offset in owners:
                _, pattern, budget = self.items[own]
                start = last + 1 - n - offset - budget
                end = start + len(pattern) + 2 * budget
                spans = windows[own]
                if spans and start <= spans[-1][1]:
                    spans[-1][0], spans[-1][1] = min(start, spans[-1][0]), max(end, spans[-1][1])
                else:
                    spans.append([start, end])
        found = []
        for own, spans in windows.items():
            item, pattern, budget = self.items[own]
            for start, end in spans:
                start = max(0, start)
                found += [(item, n, start + a, start + b) for n, a, b in places(pattern, text[start:end], budget)]
        return sorted(found)


def blocks(benchmark: DataFrame) -> Iterator[list[Item]]:
    """The items, each plain text once under its least item_id, in blocks of bounded size."""
    own = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = 1 + chars // BLOCK_CHARS
    for k in range(parts):
        some = own if parts == 1 else own.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k)
        items: dict[str, int] = {}
        for r in some.toLocalIterator():
            if text := plain(r.text):
                items[text] = min(r.item_id, items.get(text, r.item_id))
        if items:
            yield sorted((i, t) for t, i in items.items())


def members(benchmark: DataFrame) -> DataFrame:
    """Rows (item_id, reported): the id that leaks() reports for each text of benchmark (item_id, text); repeated rows once."""
    ship(benchmark.sparkSession)
    as_compared = F.pandas_udf(lambda texts: texts.map(plain), "string")
    own = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), as_compared("text").alias("plain")).where("plain <> ''").distinct()
    return own.join(own.groupBy("plain").agg(F.min("item_id").alias("reported")), "plain").select("item_id", "reported").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """Rows (doc_id, item_id, edits, start, end): the places of items of benchmark (item_id, text) in docs (doc_id, text).

    start and end are code points of the plain text, see plain(). Items without letters and digits and null ids or
    texts are not searched for; of equal items the least item_id is reported, see members(); an item_id with several texts
    is searched for by each; null and empty documents have no places; repeated rows are searched one by one.
    Items of any length are searched for: those of less than 1 / rate characters without edits, single words too.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, item_id long, edits int, start int, end int"
    out = None
    for items in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = Search(shared.value, rate)
            for batch in batches:
                for k in range(0, batch.num_rows, SLICE):
                    part = batch.slice(k, SLICE)
                    rows = [(d, *hit) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for hit in search(plain(t))]
                    columns = [*zip(*rows)] or [[]] * 5
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "edits", "start", "end"])

        hits = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(searched, schema)
        out = hits if out is None else out.unionByName(hits)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _spotless(shared, rate: float):
    @F.pandas_udf("boolean")
    def spotless(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        search = Search(shared.value, rate)
        for texts in batches:
            yield pd.Series([not search(plain(t)) for t in texts], dtype=bool)

    return spotless


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs without any place of an item, with all their columns; edge cases as in leaks()."""
    ship(docs.sparkSession)
    out = docs
    for items in blocks(benchmark):
        out = out.where(_spotless(docs.sparkSession.sparkContext.broadcast(items), rate)("text"))
    return out

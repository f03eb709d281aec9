"""Collocations of words, by merged count-min sketches and an exact second pass.

A first pass hashes every run of one to five words to a cell in each row of a sketch. Tasks hand on the counts of the
cells that they met, sorted and packed by ranges of cells; Spark deals the ranges, and each is added up as its parts
come in. A cell says too much at most, so that a phrase all of whose cells reach the threshold may be frequent, and no
other is. Only whether a cell reaches it is kept, a bit for each.

The second pass counts the phrases that survive, by their words. What is frequent then is scored, freed of what longer
phrases say as well, and ranked, all by Spark.

The sketch has a cell for some bytes of text, so that it stays sparse whatever the corpus. It is cut into shards by a
phrase's hash; the second pass reads the texts once for each shard, that is once up to three gigabytes of text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsieve.llm.common import numbered
from proofsieve.session import checkpointed, ship, small_side

#: Rows of the sketch, bytes of text for a cell in each, cells of a shard's row at most, and of a range.
ROWS, BYTES_A_CELL, SHARD, RANGE = 2, 24, 1 << 27, 1 << 20
#: Cells of a row at least, and ranges that a row is cut into at least.
LEAST, RANGES = 1 << 24, 32
#: Bytes of text that are cut into words at once, cells that a task gathers before it packs them, rows before it adds them up.
SLICE, HELD, ROWS_HELD = 3_000_000, 8_000_000, 500_000
#: Bytes of text that a task of the second pass reads at most: the more, the fewer rows it hands on for each phrase.
TASK = 1_000_000_000
#: Language of texts without one.
UNKNOWN = "und"

BREAKS, BLANKS = b".,;:!?\n\v\f\r", b" \t"
#: 0 for a byte of a word, 1 for a blank, 2 for one that ends a piece.
KIND = np.array([2 if b in BREAKS else 1 if b in BLANKS else 0 for b in range(256)], np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


@dataclass(frozen=True)
class Settings:
    #: Occurrences of a candidate, and words in it at most.
    least: int = 100
    longest: int = 5
    #: A candidate goes if a longer one around it has so many hundredths of its occurrences.
    percent: int = 100
    #: Phrases of each language in the result.
    first: int = 2000


@dataclass(frozen=True)
class Sketch:
    shards: int
    width: int  # cells of a row in a shard
    span: int  # cells of a range

    @classmethod
    def over(cls, size: int) -> Sketch:
        """For so many bytes of text."""
        cells = max(LEAST, -(-size // BYTES_A_CELL))
        shards = -(-cells // SHARD)
        width = -(-cells // shards)
        span = min(RANGE, -(-width // RANGES))
        return cls(shards, width, -(-span // 8) * 8)

    @property
    def ranges(self) -> int:
        return -(-self.width // self.span)

    @property
    def cells(self) -> int:
        return self.shards * ROWS * self.ranges * self.span

    def of(self, hashes: np.ndarray, row: int) -> np.ndarray:
        """The cells of phrases in their shard's row."""
        return _mixed(hashes ^ SALTS[row]) % np.uint64(self.width)

    def shard(self, hashes: np.ndarray) -> np.ndarray:
        return hashes % np.uint64(self.shards)


GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SALTS = [np.uint64((row + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for row in range(ROWS)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes: each bit of the input tells on all of the output."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


# ---- words


@dataclass
class Words:
    """The words of some texts: their numbers in `known`, the pieces that they lie in, the languages of those, and how
    many of the first words have been counted before."""

    code: np.ndarray
    known: pa.Array
    piece: np.ndarray
    lang: np.ndarray
    langs: list[str]
    before: int

    def hashes(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, hashes of phrases of n words, the places of their last words) for n from 1."""
        own = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.known.to_pylist()), np.uint64, len(self.known))[self.code]
        seed = np.array([xxhash.xxh64_intdigest(x) for x in self.langs], np.uint64)
        now = own ^ seed[self.lang]
        for n in range(1, longest + 1):
            if n > 1:
                now = _mixed(now[:-1] * GOLDEN) + own[n - 1 :]
            ends = np.arange(n - 1, len(own))
            ok = (self.piece[n - 1 :] == self.piece[: max(0, len(own) - n + 1)]) & (ends >= self.before)
            yield n, now[ok], ends[ok]


def _words(data: np.ndarray, starts: np.ndarray, langs: tuple[np.ndarray, list[str]], before: int = 0) -> Words:
    """Cuts texts that lie one after the other in data from starts on."""
    kind = KIND[data]
    inside = kind == 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    firsts = starts[starts < len(data)]
    begin[firsts] = inside[firsts]
    at = np.flatnonzero(begin)
    length = np.cumsum(inside, dtype=np.int32)
    offsets = np.append(length[at] - 1, length[-1:] if len(at) else 0).astype(np.int32)
    letters = LOWER[data][inside]
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    edges = kind == 2
    edges[firsts] = True
    piece = np.searchsorted(np.flatnonzero(edges), at, side="right")
    doc = np.searchsorted(starts, at, side="right") - 1
    return Words(words.indices.to_numpy(), words.dictionary, piece, langs[0][doc], langs[1], before)


def cut(texts: pa.Array, langs: pa.Array, longest: int) -> Iterator[Words]:
    """The words of texts, some megabytes at a time; a longer text comes in parts that repeat the last words before."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    known = langs.cast(pa.string()).fill_null(UNKNOWN).dictionary_encode()
    names, which = known.dictionary.to_pylist(), known.indices.to_numpy()
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        own = data[offsets[at] : offsets[to]]
        if len(own) > SLICE:
            yield from _parts(own, (which[at:to], names), longest)
        elif len(own):
            yield _words(own, offsets[at:to] - offsets[at], (which[at:to], names))
        at = to


def _parts(text: np.ndarray, langs: tuple, longest: int) -> Iterator[Words]:
    zero, start, carried, words = np.zeros(1, np.int64), 0, 0, 0
    while start < len(text):
        end = start + SLICE
        while end < len(text):
            blank = np.flatnonzero(KIND[text[end : end + SLICE]])
            if len(blank):
                end += int(blank[0])
                break
            end += SLICE
        own = text[start - carried : end]
        out = _words(own, zero, langs, words)
        yield out
        inside = KIND[own] == 0
        begin = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        words = min(longest - 1, len(begin))
        carried = len(own) - int(begin[-words]) if words else 0
        start = end


# ---- the sketch


def _packed(cells: np.ndarray, span: int, cap: int) -> Iterator[tuple[int, bytes]]:
    """(range, counts of its cells) for the ranges that have any of the cells; counts end at cap."""
    cells = np.sort(cells)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    first = int(cells[0]) // span
    edges = np.searchsorted(cells, np.arange(first, int(cells[-1]) // span + 2).astype(cells.dtype) * cells.dtype.type(span))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:]), first):
        if a == b:
            continue
        own, count = np.unique((cells[a:b] - cells.dtype.type(k * span)).astype(np.int32), return_counts=True)
        count = np.minimum(count, cap).astype(np.min_scalar_type(cap))
        if len(own) > span >> 4:
            whole = np.zeros(span, count.dtype)
            whole[own] = count
            yield k, b"\1" + squeeze(whole.tobytes())
        else:
            steps = np.diff(own, prepend=0).astype(np.uint32).view(np.uint8).reshape(-1, 4).T
            yield k, b"\0" + squeeze(np.ascontiguousarray(steps).tobytes() + count.tobytes())


def _add(total: np.ndarray, packed: bytes, cap: int) -> None:
    """Adds the counts of a range to those before."""
    kind = np.min_scalar_type(cap)
    data = zstandard.ZstdDecompressor().decompress(packed[1:])
    if packed[:1] == b"\1":
        total += np.frombuffer(data, kind)
    else:
        n = len(data) // (4 + kind.itemsize)
        steps = np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n).reshape(4, n).T).view(np.uint32).ravel()
        total[np.cumsum(steps, dtype=np.int64)] += np.frombuffer(data, kind, n, 4 * n)
    np.minimum(total, cap, out=total)


def _sketching(sketch: Sketch, settings: Settings) -> Callable:
    kind = np.uint32 if sketch.cells < 1 << 32 else np.uint64

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def handed() -> Iterator[pa.RecordBatch]:
            for k, packed in _packed(np.concatenate(held), sketch.span, settings.least):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([packed], pa.binary())], ["range", "counts"])

        for batch in batches:
            for words in cut(batch.column("text"), batch.column("lang"), settings.longest):
                for _, hashes, _ in words.hashes(settings.longest):
                    shard = sketch.shard(hashes)
                    for row in range(ROWS):
                        held.append(((shard * np.uint64(ROWS) + np.uint64(row)) * np.uint64(sketch.ranges * sketch.span) + sketch.of(hashes, row)).astype(kind))
                        size += len(hashes)
                    if size > HELD:
                        yield from handed()
                        held, size = [], 0
        if size:
            yield from handed()

    return of


def _merging(sketch: Sketch, settings: Settings) -> Callable:
    """Adds up ranges, which come sorted, and keeps which of their cells reach the threshold."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sketch.span, np.uint64 if settings.least > 1 << 31 else np.uint32)
        now = None

        def row() -> pa.RecordBatch:
            bits = zstandard.ZstdCompressor().compress(np.packbits(total >= settings.least, bitorder="little").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([bits], pa.binary())], ["range", "bits"])

        for batch in batches:
            for k, packed in zip(batch.column("range").to_pylist(), batch.column("counts")):
                if k != now:
                    if now is not None:
                        yield row()
                    total[:], now = 0, k
                _add(total, packed.as_py(), settings.least)
        if now is not None:
            yield row()

    return of


def frequent_cells(docs: DataFrame, sketch: Sketch, settings: Settings) -> DataFrame:
    """Rows (range, bits) of the merged sketch over docs (text, lang)."""
    parts = docs.select("text", "lang").mapInArrow(_sketching(sketch, settings), "range long, counts binary")
    shuffle = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(parts.repartition(shuffle, "range").sortWithinPartitions("range").mapInArrow(_merging(sketch, settings), "range long, bits binary"))


# ---- the exact pass


def _counting(sketch: Sketch, settings: Settings, shard: int, shared) -> Callable:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for words in cut(batch.column("text"), batch.column("lang"), settings.longest):
                if shard == 0:
                    lang, n = np.unique(words.lang[words.before :], return_counts=True)
                    yield _rows(lang, words.langs, 0, pa.array([b""] * len(lang), pa.binary()), n)
                for n, hashes, ends in words.hashes(settings.longest):
                    stays = sketch.shard(hashes) == shard
                    for row in range(ROWS):
                        cell = sketch.of(hashes, row)
                        stays &= bits[row][cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1 == 1
                    yield _exact(words, n, ends[stays])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in found(batches):
            held.append(part)
            size += len(part)
            if size > ROWS_HELD:
                held = _added(held)
                size = sum(map(len, held))
                if size > ROWS_HELD // 2:  # adding up no longer helps much
                    yield from held
                    held, size = [], 0
        if held:
            yield from _added(held)

    return of


def _added(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """Rows of the same phrase added up."""
    sums = pa.Table.from_batches(parts).group_by(["lang", "words", "phrase"]).aggregate([("f", "sum")])
    return sums.rename_columns(["lang", "words", "phrase", "f"]).combine_chunks().to_batches()


def _exact(words: Words, n: int, ends: np.ndarray) -> pa.RecordBatch:
    """Counts the phrases of n words that end there, telling them apart by language and words, one word after another."""
    same = words.lang[ends].astype(np.int64)
    for k in range(n - 1, -1, -1):
        _, first, same, count = np.unique(same << 32 | words.code[ends - k], return_index=True, return_inverse=True, return_counts=True)
    at = ends[first]
    parts = [words.known.take(pa.array(words.code[at - k])) for k in range(n - 1, -1, -1)]
    return _rows(words.lang[at], words.langs, n, pc.binary_join_element_wise(*parts, b" ") if n > 1 else parts[0], count)


def _rows(lang: np.ndarray, langs: list[str], n: int, phrase: pa.Array, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(lang)), pa.array(np.full(len(lang), n, np.int32)), phrase, pa.array(count.astype(np.int64))], ["lang", "words", "phrase", "f"])


def counted(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows (lang, words, phrase, f) of all phrases of docs (text, lang) that occur `least` times or more, and one for
    each language with words = 0 and its number of words; checkpointed."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("text", "lang")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sketch = Sketch.over(size)
    cells = frequent_cells(docs, sketch, settings)
    docs = docs.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-size // TASK)))
    out = None
    for shard in range(sketch.shards):
        bits = np.zeros((ROWS, sketch.ranges * sketch.span // 8), np.uint8)  # 32 MB at most
        first = shard * ROWS * sketch.ranges
        for k, packed in cells.where(F.col("range").between(first, first + ROWS * sketch.ranges - 1)).toLocalIterator():
            own = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(packed)), np.uint8)
            row, at = divmod(k - first, sketch.ranges)
            bits[row, at * len(own) : (at + 1) * len(own)] = own
        part = docs.mapInArrow(_counting(sketch, settings, shard, spark.sparkContext.broadcast(bits)), "lang string, words int, phrase binary, f long")
        out = part if out is None else out.unionByName(part)
    sums = out.groupBy("lang", "words", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("f").alias("f"))
    return checkpointed(sums.where((F.col("words") == 0) | (F.col("f") >= settings.least)))


# ---- scores


def _joined(parts: Column, start: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(parts, start, n), " ")


def scored(counts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows (lang, phrase, a, l, r, n, score) of the phrases of counted() that no longer one subsumes."""
    parts = F.split("phrase", " ")
    phrases = counts.where("words >= 2").select("lang", "words", "phrase", F.col("f").alias("a"), parts.alias("parts"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("parts"), 1, F.col("k")).alias("left"), _joined(F.col("parts"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    known = counts.where("words >= 1")
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    whole = lambda c: f"CAST({c} AS DECIMAL(19, 0))"  # noqa: E731  products of two fit into 38 digits
    score = F.expr(f"({whole('1000 * a')} * {whole('n')}) DIV ({whole('l')} * {whole('r')})")
    lowest = cuts.join(small_side(total), "lang").groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: _joined(F.col("parts"), i, m))))
    around = phrases.where("words >= 3").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * settings.percent))
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the first phrases of each language of docs (text, lang), by score and
    frequency from the highest, and then by the bytes of the phrase.

    a is a phrase's occurrences, l and r are those of its two parts at the cut that scores lowest, n the language's
    words, score floor(1000 * a * n / (l * r)). A null text is empty; a null language is "und"; repeated rows count each
    for itself; a text of any length counts whole. An empty table, and languages without candidates, give no rows.
    """
    best = scored(counted(docs, settings), settings).withColumns({"_score": -F.col("score"), "_a": -F.col("a")})
    ranked = numbered(best, "lang", ["_score", "_a", "phrase"]).where(F.col("slot") < settings.first)
    return ranked.select("lang", (F.col("slot") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")

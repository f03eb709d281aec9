"""BPE encoding and decoding with a lexicon of frequent words.

Words are what the vocabulary's pre-tokenizer cuts. The most frequent of them, counted over all documents, are
compiled with their ids into a minimal acyclic automaton: equal suffixes share their states, each arc knows how many
words lie before it, so that a word's number leads to its ids. The automaton is one file of integers that executors
receive from Spark and map into memory. Words that it lacks are merged exactly, by rank and then from the left.
Vocabularies are files of the kind `word_bpe_49k.json`: lower case, white space dropped, ends of words marked.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import normalizers

from proofsieve.session import checkpointed, shared_file, ship

#: White space as the vocabulary's pattern understands it.
SPACES = "\t\n\v\f\r \x85\xa0  -     　"
#: Composition as the vocabularies' makers have it: by an older table of marks than that of Python.
NFC = normalizers.NFC().normalize_str
SPLIT = regex.compile(f"[^{SPACES}]+")
#: Python's own split() also cuts at these four.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
END = "</w>"
#: Bytes of the words that merge by scanning, and a rank above all others.
SHORT, NEVER = 48, 1 << 40
#: Marks that end a word and are one themselves.
MARKS = frozenset(",.!?;:")
#: Rows that are in Python at once.
SLICE = 256
#: Bytes, as estimated, that a worker's memories of chunks and of their words may take, and the longest that they remember.
REMEMBERED, WORDS, LONGEST = 200_000_000, 24_000_000, 64
#: Letters below this one are composed, keep their number in lower case but for one of them, and don't depend on others.
SIMPLE, NOT_SIMPLE = "\u0250", "\u0130"
#: Different chunks that a task counts before it hands them on, and words that it hands on at once.
COUNTED, HANDED = 300_000, 25_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [chars[b] for b in range(256)]


@dataclass
class Vocabulary:
    """What encoding needs of a vocabulary file."""

    pattern: str
    special: dict[str, int]
    inner: list[int]
    last: list[int]
    ranks: dict[int, int] = field(repr=False)  # of pairs of ids, the first one shifted by 20 bits
    made: list[int] = field(repr=False)  # the id that the pair of each rank becomes

    @classmethod
    def read(cls, path: str) -> tuple[Vocabulary, list[str | None]]:
        """What encoding needs of the file at path, and what decoding needs: the token of each id."""
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        ids = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks, made = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks[ids[a] << 20 | ids[b]] = rank
            made.append(ids[a + b])
        chars = byte_chars()
        cut = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        tokens = {i: t for t, i in (ids | special).items()}
        names = [tokens.get(i) for i in range(max(tokens, default=-1) + 1)]
        return cls(cut.replace("\\s", SPACES), special, [ids[c] for c in chars], [ids[c + END] for c in chars], ranks, made), names

    @cached_property
    def of_bytes(self) -> tuple[list[int], list[int]]:
        """The rank of each pair of bytes within a word, and at its end; NEVER where there is none."""
        every = [(a, b) for a in range(256) for b in range(256)]
        return tuple([self.ranks.get(self.inner[a] << 20 | end[b], NEVER) for a, b in every] for end in (self.inner, self.last))

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word: of the pairs that merge, always the one of least rank and then the leftmost."""
        inner, get, made = self.inner, self.ranks.get, self.made
        ids = [inner[b] for b in word[:-1]] + [self.last[b] for b in word[-1:]]
        n = len(ids)
        if n > SHORT:
            return self._merge_long(ids)
        if n < 2:
            return ids
        within, at_end = self.of_bytes
        ranks = [within[a << 8 | b] for a, b in zip(word, word[1:-1])]
        ranks.append(at_end[word[-2] << 8 | word[-1]])
        while ranks and (rank := min(ranks)) != NEVER:
            k = ranks.index(rank)
            ids[k : k + 2] = [new := made[rank]]
            del ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 20 | new, NEVER)
            if k < len(ranks):
                ranks[k] = get(new << 20 | ids[k + 1], NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a queue of pairs, for words whose length would tell."""
        n, get, made = len(ids), self.ranks.get, self.made
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        queue = [(rank, k, ids[k], ids[k + 1]) for k in range(n - 1) if (rank := get(ids[k] << 20 | ids[k + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, k, a, b = heapq.heappop(queue)
            new = made[rank]
            j = after[k] if ids[k] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two has merged already
            ids[k], ids[j] = new, -1
            after[k] = i = after[j]
            if i < n:
                before[i] = k
                if (rank := get(new << 20 | ids[i])) is not None:
                    heapq.heappush(queue, (rank, k, new, ids[i]))
            if (h := before[k]) >= 0 and (rank := get(ids[h] << 20 | new)) is not None:
                heapq.heappush(queue, (rank, h, ids[h], new))
        return [i for i in ids if i >= 0]


class Cutter:
    """Cuts chunks without white space into special tokens and words."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.words = regex.compile(vocabulary.pattern)
        self.special = vocabulary.special
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None

    def __call__(self, chunk: str) -> list[bytes | int]:
        if chunk.isalpha() and (chunk.isascii() or _simple(chunk)):
            return [chunk.lower().encode()]  # letters alone are one word
        if chunk[-1:] in MARKS and (head := chunk[:-1]).isalpha() and (head.isascii() or _simple(head)):
            return [head.lower().encode(), chunk[-1].encode()]  # and a mark after them is another
        out: list[bytes | int] = []
        for part in self.at_special.split(chunk) if self.at_special and "<" in chunk else (chunk,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                composed = part if part.isascii() else NFC(part)
                lowered = composed.lower() if composed.isascii() else "".join(map(str.lower, composed))
                out.extend(w.encode("utf-8", "surrogatepass") for w in self.words.findall(lowered))
        return out


def _simple(letters: str) -> bool:
    return max(letters) < SIMPLE and NOT_SIMPLE not in letters


def chunks(text: str | None) -> list[str]:
    if not text:
        return []
    return SPLIT.findall(text) if any(c in text for c in SEPARATORS) else text.split()


class Automaton:
    """A minimal acyclic automaton over bytes with a list of ids for each word, as one array of 32-bit integers.

    Layout: number of states, of arcs, of words; first arc of each state (and one past the last); label, target and
    words before it of each arc; whether each state is final; first id of each word (and one past the last); ids.
    """

    @staticmethod
    def compile(words: dict[bytes, list[int]]) -> bytes:
        order = sorted(words)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        path: list[list] = [[False, []]]  # states of the last word that may still grow: final, arcs

        def closed(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                key = (final, tuple(arcs))
                if key not in register:  # equal suffixes share a state
                    register[key] = len(states)
                    states.append(key)
                path[-1][1][-1] = (path[-1][1][-1][0], register[key])

        previous = b""
        for word in order:
            common = len(os.path.commonprefix([previous, word]))
            closed(common)
            for b in word[common:]:
                path[-1][1].append((b, -1))
                path.append([False, []])
            path[-1][0] = True
            previous = word
        closed(0)
        states.append((path[0][0], tuple(path[0][1])))
        below = []  # words from each state on; targets come before their sources
        for final, arcs in states:
            below.append(int(final) + sum(below[t] for _, t in arcs))
        first, labels, targets, skips = [0], [], [], []
        for final, arcs in states:
            skip = int(final)
            for b, t in arcs:
                labels.append(b)
                targets.append(t)
                skips.append(skip)
                skip += below[t]
            first.append(len(labels))
        outputs = [words[w] for w in order]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in outputs])]) if outputs else np.zeros(1)
        parts = [[len(states), len(labels), len(order)], first, labels, targets, skips, [int(f) for f, _ in states], starts, [i for x in outputs for i in x]]
        return np.concatenate([np.asarray(p, np.int32) for p in parts]).tobytes()

    def __init__(self, buffer) -> None:
        x = memoryview(buffer).cast("i")
        states, arcs, words = x[0], x[1], x[2]
        at = 3
        views = []
        for n in (states + 1, arcs, arcs, arcs, states, words + 1):
            views.append(x[at : at + n])
            at += n
        self.first, self.labels, self.targets, self.skips, self.final, self.starts = views
        self.ids = x[at:]
        self.root = states - 1
        self.arcs: dict[int, dict[int, tuple[int, int]]] = {}  # of the states that were visited

    def get(self, word: bytes) -> list[int] | None:
        state, number = self.root, 0
        for b in word:
            arcs = self.arcs.get(state)
            if arcs is None:
                own = range(self.first[state], self.first[state + 1])
                arcs = self.arcs[state] = {self.labels[k]: (self.targets[k], self.skips[k]) for k in own}
            arc = arcs.get(b)
            if arc is None:
                return None
            state = arc[0]
            number += arc[1]
        return [*self.ids[self.starts[number] : self.starts[number + 1]]] if self.final[state] else None


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, size: int) -> list[bytes]:
    """The most frequent words over all docs that occur twice or more, `size` at most: all words of a count or none."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Cutter(shared.value)
        seen: Counter = Counter()

        def flushed() -> Iterator[pa.RecordBatch]:
            words: Counter = Counter()
            for chunk, n in seen.items():
                for w in cut(chunk):
                    if isinstance(w, bytes):
                        words[w] += n
            seen.clear()
            own = iter(words.items())
            while part := [*islice(own, HANDED)]:
                yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in part], pa.binary()), "n": pa.array([n for _, n in part], pa.int64())})

        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                for text in batch.column(0).slice(k, SLICE).to_pylist():
                    seen.update(chunks(text))
                    if len(seen) > COUNTED:
                        yield from flushed()
        yield from flushed()

    counts = docs.select("text").mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    often = checkpointed(counts.where("n > 1"))
    least = least_count(often, size)
    return [] if least is None else [bytes(r.word) for r in often.where(F.col("n") >= least).select("word").collect()]  # size rows at most


def least_count(often: DataFrame, size: int, parts: int = 256) -> int | None:
    """The smallest n such that `size` rows of often (n) at most have n or more; null if not even the largest do.

    The range of n is split in parts whose rows are counted, and so is the part that the bound falls in.
    """
    top = often.agg(F.max("n")).first()[0]
    if top is None:
        return None
    low, high, above = 1, top, 0  # the answer lies in low to high + 1; `above` rows have more than high
    while low <= high:
        step = -(-(high - low + 1) // parts)
        part = F.floor((F.col("n") - low) / step).alias("part")
        rows = {r.part: r["count"] for r in often.where(F.col("n").between(low, high)).groupBy(part).count().collect()}  # parts rows at most
        full = next((k for k in sorted(rows, reverse=True) if (above := above + rows[k]) > size), None)
        if full is None:
            return low
        above -= rows[full]
        low, high = low + full * step, min(high, low + (full + 1) * step - 1)
        if step == 1:
            low = high + 1
    return low if low <= top else None


@dataclass(frozen=True)
class Lexicon:
    """A vocabulary and the name of the automaton's file among the application's files."""

    vocabulary: object
    names: object
    file: str


def build_lexicon(docs: DataFrame, path: str, size: int = 50_000) -> Lexicon:
    """Compiles the `size` most frequent words of docs (text) under the vocabulary file at path, and hands the file out."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    vocabulary, names = Vocabulary.read(path)
    compiled = Automaton.compile({w: vocabulary.merge(w) for w in frequent_words(docs, vocabulary, size)})
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(shared_file(spark, name, compiled))  # executors fetch it, those that come later too
    return Lexicon(spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(names), name)


class Memory:
    """What a worker remembers, in two generations: when the young one is full it becomes the old one, which goes.

    What is still asked for comes back to the young one. Sizes are estimates in bytes.
    """

    def __init__(self, size: int) -> None:
        self.size, self.held = size // 2, 0
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key) -> tuple[int, ...] | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, ids: tuple[int, ...]) -> None:
        if len(key) <= LONGEST:
            self.held += 200 + 2 * len(key) + 8 * len(ids)
            if self.held > self.size:
                self.old = self.young.copy()
                self.young.clear()  # the same dictionary, which others look up in
                self.held = 200 + 2 * len(key) + 8 * len(ids)
            self.young[key] = ids


class Encoder:
    """Encodes texts in a worker; what it remembers of chunks and words is bounded."""

    def __init__(self, vocabulary: Vocabulary, file: str) -> None:
        self.vocabulary, self.cut = vocabulary, Cutter(vocabulary)
        with open(SparkFiles.get(file), "rb") as f:
            self.automaton = Automaton(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        self.known, self.words = Memory(REMEMBERED), Memory(WORDS)  # of tuples, which the garbage collector passes over

    def look_up(self, word: bytes) -> tuple[int, ...]:
        """The ids of a word: those of the lexicon, or else what it merges to."""
        found = self.automaton.get(word)
        return tuple(self.vocabulary.merge(word) if found is None else found)

    def word(self, word: bytes) -> tuple[int, ...]:
        found = self.words.get(word)  # words stand in several chunks, with other marks around them
        if found is None:
            found = self.look_up(word)
            self.words.put(word, found)
        return found

    def chunk(self, chunk: str) -> tuple[int, ...]:
        ids = self.known.get(chunk)
        if ids is not None:
            return ids
        if chunk.isalpha() and (chunk.isascii() or _simple(chunk)):  # letters alone are one word
            ids = self.look_up(chunk.lower().encode())
        elif chunk[-1] in MARKS and (head := chunk[:-1]).isalpha() and (head.isascii() or _simple(head)):
            known = self.known.get(head)  # a mark after letters is a word of its own
            if known is None:
                return self.chunk(head) + self.word(chunk[-1].encode())  # rare: only its letters are remembered
            ids = known + self.word(chunk[-1].encode())
        else:
            ids = tuple(i for w in self.cut(chunk) for i in ((w,) if isinstance(w, int) else self.word(w)))
        self.known.put(chunk, ids)
        return ids

    def add(self, text: str | None, out: list[int]) -> None:
        """Appends the text's ids to out."""
        each = chunks(text)
        found = [*map(self.known.young.get, each)]
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = self.chunk(each[k])
        out.extend(chain.from_iterable(found))


_own: dict[str, Encoder] = {}


def encoder_of(vocabulary, file: str) -> Encoder:
    """The worker's encoder for a lexicon, which remembers words from task to task."""
    if file not in _own:
        _own.clear()
        _own[file] = Encoder(vocabulary.value, file)
    return _own[file]


class Decoder:
    """Decodes lists of ids in a worker."""

    def __init__(self, names: list[str | None]) -> None:
        self.names = np.array(names, object)
        self.there = np.array([x is not None for x in names], bool)

    def __call__(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of lists that lie in ids one after the other, each up to its end."""
        known = (ids >= 0) & (ids < len(self.names))
        known[known] = self.there[ids[known]]
        if not known.all():
            ends = np.concatenate([[0], np.cumsum(known)])[ends]
            ids = ids[known]
        strings = self.names[ids].tolist()
        return [" ".join(strings[a:b]) for a, b in zip([0, *ends], ends)]


def _encoded(docs: DataFrame, lexicon: Lexicon, names) -> DataFrame:
    """Rows (doc_id, ids) of docs (doc_id, text), with what the ids decode to if there are names."""
    ship(docs.sparkSession)
    vocabulary, file = lexicon.vocabulary, lexicon.file

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary, file)
        decoder = Decoder(names.value) if names else None
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                flat: list[int] = []
                ends = [0]
                for text in part.column(1).to_pylist():
                    encoder.add(text, flat)
                    ends.append(len(flat))
                ids = np.array(flat, np.int32)
                columns = {"doc_id": part.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))}
                yield pa.RecordBatch.from_pydict(columns | ({"decoded": pa.array(decoder(ids, np.array(ends[1:], np.int64)), pa.string())} if decoder else {}))

    schema = "doc_id long, ids array<int>" + (", decoded string" if names else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encoded, schema)


def encode(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Rows (doc_id, ids array<int>) for each row of docs (doc_id, text): whole texts, special tokens recognised.

    Null and blank texts have no ids; repeated rows are encoded one by one; an empty table gives no rows; further
    columns are left out.
    """
    return _encoded(docs, lexicon, None)


def round_trip(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """encode() and decode() in one pass: rows (doc_id, ids, decoded); edge cases as there."""
    return _encoded(docs, lexicon, lexicon.names)


def decode(tokens: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Adds the column decoded to tokens (doc_id, ids): the tokens' strings with a space between any two.

    That is what the vocabulary gives without a decoder of its own; ids that it doesn't have are passed over, no ids
    and null give the empty text.
    """
    ship(tokens.sparkSession)
    names = lexicon.names

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(names.value)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                lists = part.column(1)
                ids = lists.flatten().to_numpy(zero_copy_only=False)  # nulls have none
                ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoder(ids, ends), pa.string())], ["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, ids array<int>, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    """Digest columns of encoded and decoded documents (doc_id, ids, decoded)."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

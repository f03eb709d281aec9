"""Token ids as files of bit planes.

Texts become ids of a byte-level vocabulary. Ids go to files in blocks of fixed size: a block is transposed, so that the
first bits (or bytes) of all its ids lie together, then the second ones, and each of these planes is compressed by
itself with zstandard; the high planes of a block are all but constant. A file ends with an index of its chunks: where
each lies, how many values it has, and how long each plane is.

A file is `MAGIC`, chunks, the index (JSON, compressed), its length in eight bytes, `MAGIC`. Chunks of ids are followed
by those of documents: a chunk of lengths, one of doc_ids, one that tells which of those are null. The folder's
manifest lists the files in order with their numbers of documents and ids, so that every document's start is known
without reading the files before it. Spark reads and writes such folders as the data source "token_planes".
"""

from __future__ import annotations

import json
import os
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from tokenizers import Tokenizer

from proofsieve.session import shared_path, ship

MAGIC, MANIFEST = b"planes01", "_manifest.json"
#: Ids in a block, documents that are indexed together, ids in a file before the next one begins, ids read at once.
BLOCK, DOCS, FILE, READ = 65_536, 65_536, 1 << 27, 1 << 20
#: Bytes of text that are encoded at once, bytes of pieces that a worker remembers, and the longest of them.
SLICE, REMEMBERED, LONGEST = 2_000_000, 192_000_000, 64
#: The id that ends each document.
END = 0

SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


# ---- encoding


class Encoder:
    """Ids of texts as the tokenizers library has them.

    A byte-level vocabulary never joins across a space that another character than white space follows: its pattern
    takes such a space as the start of the next token, whatever lies before. Nor does it join a letter and what is none.
    Texts are cut there, and pieces that were seen before are not encoded again. Other vocabularies get whole texts.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        config = json.loads(spec)
        pre = config.get("pre_tokenizer") or {}
        added = config.get("added_tokens") or []
        plain = not config.get("normalizer") and not config.get("post_processor") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.cuts = plain and not any(" " in t["content"] or len(t["content"].encode()) > 64 or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        self.special = [t["content"].encode() for t in added]
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}  # what was remembered before known was begun
        self.size = 0

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of different pieces."""
        out = list(map(self.known.get, pieces))
        new = []
        if self.size > REMEMBERED // 2:
            self.old, self.known, self.size = self.known, {}, 0
        for k in [k for k, ids in enumerate(out) if ids is None]:
            if (ids := self.old.get(pieces[k])) is None:
                new.append(k)
            else:
                out[k] = self._keep(pieces[k], ids)
        got = self.tokenizer.encode_batch_fast([pieces[k].decode("utf-8", "replace") for k in new], add_special_tokens=False)
        for k, e in zip(new, got):
            out[k] = self._keep(pieces[k], array("I", e.ids).tobytes())
        return out

    def _keep(self, piece: bytes, ids: bytes) -> bytes:
        if len(piece) <= LONGEST:
            self.size += 180 + len(piece) + len(ids)
            self.known[piece] = ids
        return ids

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        """Whether a piece may begin at each byte; special tokens stay whole."""
        out, text = _apart(data), data.tobytes()
        for token in self.special:
            at = text.find(token)
            while at >= 0:
                out[at + 1 : at + len(token)] = False
                at = text.find(token, at + 1)
        return out

    def _encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that lie one after the other in data, and how many each has."""
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        begins = np.zeros(len(data) + 1, bool)
        if self.cuts:
            begins[:-1] = self._cuts(data)
        begins[starts[starts < ends]] = True
        first = np.flatnonzero(begins)
        offsets = np.append(first, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        own = self._ids(pieces.dictionary.to_pylist())
        which = pieces.indices.to_numpy()
        lengths = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat = np.frombuffer(b"".join(own), np.uint32)
        begin = np.cumsum(lengths) - lengths
        count = lengths[which]
        until = np.cumsum(count)
        ids = flat[np.repeat(begin[which] - (until - count), count) + np.arange(until[-1] if len(until) else 0)]
        total = np.concatenate(([0], until))
        return ids, total[np.searchsorted(first, ends)] - total[np.searchsorted(first, starts)]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null is empty."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        full = np.asarray(texts.is_valid())
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
            if offsets[to] - offsets[at] > SLICE:  # one long text, cut where pieces begin
                yield self._long(data[offsets[at] : offsets[to]] if full[at] else data[:0])
            else:
                lengths = np.where(full[at:to], offsets[at + 1 : to + 1] - offsets[at:to], 0)
                own = data[offsets[at] : offsets[to]]
                if lengths.sum() < len(own):  # nulls may have bytes of their own
                    own = own[np.repeat(full[at:to], offsets[at + 1 : to + 1] - offsets[at:to])]
                ids, counts = self._encode(own, np.cumsum(lengths))
                yield from np.split(ids, np.cumsum(counts)[:-1])
            at = to

    def _long(self, data: np.ndarray) -> np.ndarray:
        cuts, at = [0], max(64, SLICE)
        while self.cuts and at < len(data) - 1:
            near = np.flatnonzero(self._cuts(data[at - 64 : at + SLICE + 64])[64 : SLICE + 64])
            if len(near):
                cuts.append(at + int(near[0]))
            at = (cuts[-1] if len(near) else at) + SLICE
        parts = [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)])]
        return np.concatenate([self._encode(p, np.array([len(p)]))[0] for p in parts])


@lru_cache(maxsize=1)
def _encoder(spec: str) -> Encoder:
    """A worker's encoder, which remembers pieces from task to task."""
    return Encoder(spec)


def _apart(data: np.ndarray) -> np.ndarray:
    """Whether ordinary text may be cut before each byte."""
    out = np.zeros(len(data), bool)
    out[:-1] = (data[:-1] == 32) & SAFE[data[1:]]
    kind = LETTER[data]
    ends = kind[:-1] == 1
    ends[1:] |= (kind[:-2] >= 2) & (data[1:-1] >= 0x80) & (data[1:-1] < 0xC0) & ((kind[:-2] == 3) | (data[1:-1] != 0x97) & (data[1:-1] != 0xB7))
    out[1:] |= ends & (kind[1:] == 0)
    return out


#: 1 for ASCII letters, 0 for other ASCII, 3 for leads of two-byte characters that are all letters, 2 for the one that
#: leads U+00D7 and U+00F7 too.
LETTER = np.array([1 if 65 <= b & ~32 <= 90 else 0 if b < 128 else 2 if b == 0xC3 else 3 if b in (0xC4, 0xC5) else -1 for b in range(256)], np.int8)

#: Bytes that surely begin something else than white space: printable ASCII, and leads of characters none of which is white.
SAFE = np.array([0x21 <= b <= 0x7E or 0xC3 <= b <= 0xF4 and b not in (0xE1, 0xE2, 0xE3) for b in range(256)])


def ordered(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) in ascending order of doc_id, dealt by ranges of (doc_id, hash of the text, place), so that no
    id is too frequent for a task."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["doc_id", "_hash", "_place"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_place"))
    return rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("doc_id", "text")


# ---- the format


def to_planes(values: np.ndarray, unit: str) -> list[bytes]:
    """The compressed planes of unsigned integers, the lowest first; unit is "bit" or "byte"."""
    values = np.ascontiguousarray(values, values.dtype.newbyteorder("<"))
    rows = values.view(np.uint8).reshape(len(values), values.itemsize)
    if unit == "bit":
        planes = [np.packbits(rows[:, k >> 3] >> (k & 7) & 1).tobytes() for k in range(8 * values.itemsize)]
    else:
        planes = [rows[:, k].tobytes() for k in range(values.itemsize)]
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return [squeeze(p) if any(p) else b"" for p in planes]  # an empty plane is all zeros


def from_planes(planes: list[bytes], n: int, dtype: type, unit: str) -> np.ndarray:
    """The n integers that to_planes() has taken apart."""
    out = np.zeros((n, np.dtype(dtype).itemsize), np.uint8)
    inflate = zstandard.ZstdDecompressor().decompress
    for k, p in enumerate(planes):
        if not p:
            continue
        own = np.frombuffer(inflate(p), np.uint8)
        if unit == "bit":
            out[:, k >> 3] |= np.unpackbits(own, count=n) << (k & 7)
        else:
            out[:, k] = own
    return out.view(np.dtype(dtype).newbyteorder("<")).reshape(n)


class PlaneFile:
    """Writes one file."""

    def __init__(self, folder: str, name: str, unit: str):
        self.store, at = fs.FileSystem.from_uri(folder)
        self.store.create_dir(at)
        self.name, self.unit = name, unit
        self.out = self.store.open_output_stream(f"{at}/{name}")
        self.out.write(MAGIC)
        self.at, self.index = len(MAGIC), {"unit": unit, "ids": [], "docs": []}
        self.ids, self.held, self.docs, self.n_docs, self.n_ids = [], 0, [], 0, 0

    def _chunk(self, values: np.ndarray) -> list:
        planes = to_planes(values, self.unit)
        entry = [self.at, len(values), [len(p) for p in planes]]
        self.at += self.out.write(b"".join(planes)) or sum(entry[2])
        return entry

    def _blocks(self, last: bool) -> None:
        if self.held >= BLOCK or last and self.held:
            flat = np.concatenate(self.ids)
            end = len(flat) if last else len(flat) // BLOCK * BLOCK
            self.index["ids"] += [self._chunk(flat[k : k + BLOCK]) for k in range(0, end, BLOCK)]
            self.ids, self.held = [flat[end:]], len(flat) - end
        if len(self.docs) >= DOCS or last and self.docs:
            ids, lengths = zip(*self.docs)
            none = np.packbits([x is None for x in ids])
            self.index["docs"].append([self._chunk(np.array(lengths, np.uint64)), self._chunk(np.array([x or 0 for x in ids], np.int64).view(np.uint64)), self._chunk(none)])
            self.docs = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs.append((doc_id, len(ids)))
        self.held, self.n_docs, self.n_ids = self.held + len(ids), self.n_docs + 1, self.n_ids + len(ids)
        self._blocks(False)

    def close(self) -> tuple[str, int, int]:
        """The file's name, documents and ids."""
        self._blocks(True)
        index = zstandard.ZstdCompressor().compress(json.dumps(self.index).encode())
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return self.name, self.n_docs, self.n_ids


def read_file(path: str, start: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, whether they are null, lengths, ids) of consecutive documents, some READ ids at a time."""
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        f.seek(f.size() - 8 - len(MAGIC))
        tail = f.read()
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is no file of planes")
        size = int.from_bytes(tail[:8], "little")
        f.seek(f.size() - 8 - len(MAGIC) - size)
        index = json.loads(zstandard.ZstdDecompressor().decompress(f.read(size)))

        def chunk(entry: list, dtype: type) -> np.ndarray:
            f.seek(entry[0])
            data, planes, k = f.read(sum(entry[2])), [], 0
            for n in entry[2]:
                planes.append(data[k : k + n])
                k += n
            return from_planes(planes, entry[1], dtype, index["unit"])

        blocks, kept = iter(index["ids"]), np.zeros(0, np.uint32)
        for lengths, ids, none in index["docs"]:
            lengths, ids = chunk(lengths, np.uint64).astype(np.int64), chunk(ids, np.uint64).view(np.int64)
            none = np.unpackbits(chunk(none, np.uint8), count=len(ids)).astype(bool)
            until, at = np.cumsum(lengths), 0
            while at < len(lengths):
                before = until[at] - lengths[at]
                to = max(at + 1, int(np.searchsorted(until, before + READ, side="right")))
                need, got = int(until[to - 1] - before), [kept]
                while sum(map(len, got)) < need:
                    got.append(chunk(next(blocks), np.uint32))
                flat = np.concatenate(got)
                yield ids[at:to], none[at:to], lengths[at:to], flat[:need]
                kept, at = flat[need:], to


# ---- the data source


@dataclass
class Written(WriterCommitMessage):
    part: int
    files: list


@dataclass
class File(InputPartition):
    path: str
    start: int


class PlaneWriter(DataSourceArrowWriter):
    """Each task writes files under names of its own; only those of tasks that succeed come into the manifest."""

    def __init__(self, path: str, unit: str, overwrite: bool, spec: str | None, end: int | None):
        self.path, self.unit, self.overwrite, self.spec, self.end = path, unit, overwrite, spec, end

    def _ids(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        if self.spec is None:
            yield from (np.frombuffer(ids.as_buffer() or b"", "<u4") for ids in batch.column("ids"))
        else:
            last = np.array([] if self.end is None else [self.end], np.uint32)
            yield from (np.concatenate((ids, last)) for ids in _encoder(self.spec).encode(batch.column("text")))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        part, files, out = TaskContext.get().partitionId(), [], None
        for batch in iterator:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), self._ids(batch)):
                out = out or PlaneFile(self.path, f"part-{part:05d}-{uuid.uuid4().hex}.planes", self.unit)
                out.add(doc_id, ids)
                if out.n_ids >= FILE:
                    files.append(out.close())
                    out = None
        return Written(part, files + ([out.close()] if out else []))

    def commit(self, messages: list) -> None:
        store, at = fs.FileSystem.from_uri(self.path)
        store.create_dir(at)
        before = [] if self.overwrite else manifest(self.path, missing=[])
        files = before + [list(f) for m in sorted((m for m in messages if m), key=lambda m: m.part) for f in m.files]
        with store.open_output_stream(f"{at}/{MANIFEST}") as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        store, at = fs.FileSystem.from_uri(self.path)
        for name, *_ in (f for m in messages if m for f in m.files):
            store.delete_file(f"{at}/{name}")


def manifest(path: str, missing: list | None = None) -> list:
    """[name, documents, ids] of each file, in order."""
    store, at = fs.FileSystem.from_uri(path)
    if missing is not None and store.get_file_info(f"{at}/{MANIFEST}").type == fs.FileType.NotFound:
        return missing
    with store.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


class PlaneReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[File]:
        out, start = [], 0
        for name, _, n in manifest(self.path):
            out.append(File(f"{self.path.rstrip('/')}/{name}", start))
            start += n
        return out or [File("", 0)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        start = partition.start
        for ids, none, lengths, flat in read_file(partition.path) if partition.path else ():
            until = np.cumsum(lengths)
            offsets = np.concatenate(([0], until * 4)).astype(np.int32)
            values = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=none), pa.array(start + until - lengths), pa.array(lengths), values], ["doc_id", "start", "n_tokens", "ids"])
            start += int(until[-1])


class TokenPlanes(DataSource):
    """spark.read.format("token_planes").load(folder): rows (doc_id, start, n_tokens, ids), in the files' order by start.
    df.write.format("token_planes").mode("append").save(folder) takes rows (doc_id, ids) in the order of its partitions,
    or rows (doc_id, text) with the options vocabulary (a file of the tokenizers library) and end (an id that ends each
    document); option unit is "bit" or "byte"."""

    @classmethod
    def name(cls) -> str:
        return "token_planes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PlaneReader:
        return PlaneReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> PlaneWriter:
        spec = end = None
        if "vocabulary" in self.options:
            with open(self.options["vocabulary"], encoding="utf-8") as f:
                spec, end = f.read(), self.options.get("end")
        return PlaneWriter(self.options["path"], self.options.get("unit", "byte"), overwrite, spec, None if end is None else int(end))


def write(rows: DataFrame, path: str, unit: str = "byte", vocabulary: str | None = None, end: int | None = END) -> None:
    """Writes rows (doc_id, ids) in the order of partitions and rows, ids being 32-bit numbers, little-endian; or rows
    (doc_id, text) as the file `vocabulary` of the tokenizers library encodes them, with `end` after each text.

    A null text is empty; an empty table makes a folder without files. Tasks that are run again leave files that the
    manifest doesn't name.
    """
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(TokenPlanes)
    to = rows.write.format("token_planes").option("unit", unit).mode("append")
    if vocabulary is not None:
        to = to.option("vocabulary", vocabulary)
        to = to if end is None else to.option("end", end)
    to.save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of a folder; start counts the ids of all documents before."""
    ship(spark)
    spark.dataSource.register(TokenPlanes)
    return spark.read.format("token_planes").load(path)


def stored(docs: DataFrame, vocabulary: str, unit: str = "byte") -> DataFrame:
    """Encodes docs (doc_id, text), writes them in ascending order of doc_id to a folder in the shared one, and reads that:
    rows as read() gives them.

    A null text is empty; a null doc_id comes first; rows of one doc_id are ordered by a hash of their texts, and equal
    rows come out as often as they come in. An empty table gives no rows.
    """
    path = shared_path(docs.sparkSession, "planes")
    write(ordered(docs), path, unit, vocabulary)
    return read(docs.sparkSession, path)

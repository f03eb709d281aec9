"""Binary spreadsheets (.xls): compound files of sectors in chains, and the records of a workbook's stream.

A compound file is a header and sectors of equal size. The allocation table names for each sector the next of its chain; the
directory is a chain itself and names the streams, of which small ones lie in a chain of short sectors. A workbook's stream
is records of a number, a length and data; texts stand in a shared table, which may go on over several records.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsieve.session import ship

# The format's signature, ends of chains, streams' names and records' numbers.
SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
FREE, LAST, TABLE = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD
STREAMS = ("Workbook", "Book")
BOF, EOF, SHEET, SST, CONTINUE = 0x0809, 0x000A, 0x0085, 0x00FC, 0x003C
LABEL, RICH, SHARED, NUMBER, RK, MANY_RK, LOGICAL, FORMULA, STRING = 0x0204, 0x00D6, 0x00FD, 0x0203, 0x027E, 0x00BD, 0x0205, 0x0006, 0x0207
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}
#: Data of a record at most.
MOST = 8224
CELLS = "path string, sheet string, row int, values array<string>"


class Compound:
    """The streams of a compound file."""

    def __init__(self, data: bytes):
        if data[:8] != SIGNATURE:
            raise ValueError("no compound file")
        self.data = data
        shift, short = struct.unpack_from("<HH", data, 30)
        self.size, self.short = 1 << shift, 1 << short
        first_directory, self.cutoff, first_short, first_more = (struct.unpack_from("<I", data, k)[0] for k in (48, 56, 60, 68))
        places = [*struct.unpack_from("<109I", data, 76)]
        seen = set()
        while first_more < TABLE and first_more not in seen:  # the table's own sectors, beyond those in the header
            seen.add(first_more)
            *more, first_more = struct.unpack(f"<{self.size // 4}I", self.sector(first_more))
            places += more
        self.table = [n for p in places if p < TABLE for n in struct.unpack(f"<{self.size // 4}I", self.sector(p))]
        self.shorts = [n for p in self.chain(first_short, self.table) for n in struct.unpack(f"<{self.size // 4}I", self.sector(p))]
        entries = b"".join(map(self.sector, self.chain(first_directory, self.table)))
        self.entries: dict[str, tuple[int, int, int]] = {}  # kind, first sector, bytes
        for k in range(0, len(entries), 128):
            length, kind = struct.unpack_from("<HB", entries, k + 64)
            if kind:
                name = entries[k : k + max(0, length - 2)].decode("utf-16-le", "replace")
                self.entries.setdefault(name, (kind, *struct.unpack_from("<II", entries, k + 116)))
        root = next((e for e in self.entries.values() if e[0] == 5), None)
        self.small = self.read(root[1], root[2], self.table) if root else b""

    def sector(self, n: int) -> bytes:
        own = self.data[(n + 1) * self.size : (n + 2) * self.size]
        return own.ljust(self.size, b"\0")

    def chain(self, first: int, table: list[int]) -> Iterator[int]:
        seen = 0
        while first < len(table) and seen <= len(table):  # a chain that bites its tail ends
            yield first
            first, seen = table[first], seen + 1

    def read(self, first: int, size: int, table: list[int]) -> bytes:
        return b"".join(map(self.sector, self.chain(first, table)))[:size]

    def stream(self, name: str) -> bytes | None:
        if name not in self.entries:
            return None
        _, first, size = self.entries[name]
        if size >= self.cutoff:
            return self.read(first, size, self.table)
        return b"".join(self.small[k * self.short : (k + 1) * self.short] for k in self.chain(first, self.shorts))[:size]


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(number, pieces of data) from a place on: a record and those that continue it."""
    while at + 4 <= len(stream):
        kind, n = struct.unpack_from("<HH", stream, at)
        pieces = [stream[at + 4 : at + 4 + n]]
        at += 4 + n
        while at + 4 <= len(stream) and struct.unpack_from("<H", stream, at)[0] == CONTINUE:
            n = struct.unpack_from("<H", stream, at + 2)[0]
            pieces.append(stream[at + 4 : at + 4 + n])
            at += 4 + n
        yield kind, pieces
        if kind == EOF:
            return


class Pieces:
    """Reads data that goes on from one record to the next; letters begin anew there with how wide they are."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.k, self.at = pieces, 0, 0

    def left(self) -> int:
        return len(self.pieces[self.k]) - self.at if self.k < len(self.pieces) else 0

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.k < len(self.pieces):
            own = self.pieces[self.k][self.at : self.at + n]
            out, n, self.at = out + own, n - len(own), self.at + len(own)
            if n:
                self.k, self.at = self.k + 1, 0
        return out

    def letters(self, n: int, wide: bool) -> str:
        out = []
        while n and self.k < len(self.pieces):
            if not self.left():
                self.k, self.at = self.k + 1, 0
                if self.k >= len(self.pieces):
                    break
                wide = bool(self.take(1)[0] & 1)
            size = 2 if wide else 1
            most = min(n, self.left() // size)
            if not most:
                break
            out.append(self.take(most * size).decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= most
        return "".join(out)

    def text(self, short: bool = False) -> str:
        """A text with its length before it, and what it says of fonts behind it passed over."""
        n = self.take(1)[0] if short else struct.unpack("<H", self.take(2))[0]
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        spoken = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = self.letters(n, bool(flags & 1))
        self.take(4 * runs + spoken)
        return out


def shown(x: float) -> str:
    """A number as a cell without a format shows it."""
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def rk(value: int) -> float:
    """A number in four bytes: 30 bits of an integer or of a double's upper half, in hundredths if the lowest bit says so."""
    if value & 2:
        whole = value >> 2
        x = float(whole - (1 << 30) if whole & 1 << 29 else whole)
    else:
        x = struct.unpack("<d", b"\0\0\0\0" + struct.pack("<I", value & 0xFFFFFFFC))[0]
    return x / 100 if value & 1 else x


def sheets(data: bytes) -> list[tuple[str, dict[int, dict[int, str]]]]:
    """(name, {row: {column: value}}) of each sheet of a workbook."""
    file = Compound(data)
    stream = next((s for name in STREAMS if (s := file.stream(name)) is not None), None)
    if stream is None:
        raise ValueError("no workbook in the file")
    found, texts = [], []
    for kind, pieces in records(stream):
        if kind == SHEET:
            start, _, sort = struct.unpack_from("<IBB", pieces[0])
            if not sort:  # others are charts and the like
                found.append((Pieces([pieces[0][6:]]).text(short=True), start))
        elif kind == SST:
            own = Pieces(pieces)
            _, n = struct.unpack("<II", own.take(8))
            texts = [own.text() for _ in range(n)]
    return [(name, _cells(stream, start, texts)) for name, start in found]


def _cells(stream: bytes, start: int, texts: list[str]) -> dict[int, dict[int, str]]:
    out: dict[int, dict[int, str]] = {}
    pending = None
    for kind, pieces in records(stream, start):
        d = pieces[0]
        if kind == STRING and pending:
            out.setdefault(pending[0], {})[pending[1]] = Pieces(pieces).text()
            pending = None
            continue
        if kind not in (LABEL, RICH, SHARED, NUMBER, RK, MANY_RK, LOGICAL, FORMULA):
            continue
        row, column = struct.unpack_from("<HH", d)
        own = out.setdefault(row, {})
        if kind in (LABEL, RICH):
            own[column] = Pieces([d[6:], *pieces[1:]]).text()
        elif kind == SHARED:
            k = struct.unpack_from("<I", d, 6)[0]
            own[column] = texts[k] if k < len(texts) else ""
        elif kind == NUMBER:
            own[column] = shown(struct.unpack_from("<d", d, 6)[0])
        elif kind == RK:
            own[column] = shown(rk(struct.unpack_from("<I", d, 6)[0]))
        elif kind == MANY_RK:
            for k in range((len(d) - 6) // 6):
                own[column + k] = shown(rk(struct.unpack_from("<I", d, 6 + 6 * k)[0]))
        elif kind == LOGICAL:
            value, wrong = struct.unpack_from("<BB", d, 6)
            own[column] = ERRORS.get(value, "#") if wrong else str(bool(value)).upper()
        elif d[12:14] != b"\xff\xff":
            own[column] = shown(struct.unpack_from("<d", d, 6)[0])
        elif d[6] == 0:
            pending = row, column  # a formula whose text comes next
        elif d[6] in (1, 2):
            own[column] = str(bool(d[8])).upper() if d[6] == 1 else ERRORS.get(d[8], "#")
    return out


def cells(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, sheet, row, values) of the workbooks at path, a file, a folder or a pattern."""
    return read_contents(spark.read.format("binaryFile").load(path).select("path", "content"))


def read_contents(files: DataFrame) -> DataFrame:
    """Rows (path, sheet, row, values) of workbooks (path, content): values from the first column to the last that the row
    has, null where a cell is empty. What is no workbook fails the job, with its path."""
    ship(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    found = sheets(data.as_py())
                except (ValueError, struct.error) as e:
                    raise ValueError(f"{name} can't be read: {e}") from e
                rows = [(name, sheet, k, [own.get(c) for c in range(max(own) + 1)]) for sheet, table in found for k, own in sorted(table.items()) if own]
                columns = [*zip(*rows)] or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())))], ["path", "sheet", "row", "values"])

    return files.select("path", "content").mapInArrow(read, CELLS)


# ---- writing


def workbook(tables: list[tuple[str, list[list[str | float | None]]]]) -> bytes:
    """A workbook of sheets (name, rows): texts in the shared table, numbers as such, nulls as empty cells."""
    record = lambda kind, data: struct.pack("<HH", kind, len(data)) + data
    index: dict[str, int] = {}
    used = 0
    bodies = []
    for _, rows in tables:
        body = record(BOF, struct.pack("<HHHHII", 0x0600, 0x0010, 0, 0, 0, 0))
        for k, row in enumerate(rows):
            for c, value in enumerate(row):
                if isinstance(value, str):
                    used += 1
                    body += record(SHARED, struct.pack("<HHHI", k, c, 0, index.setdefault(value, len(index))))
                elif value is not None:
                    body += record(NUMBER, struct.pack("<HHHd", k, c, 0, value))
        bodies.append(body + record(EOF, b""))
    pieces = [bytearray(struct.pack("<II", used, len(index)))]
    for text in index:
        letters = text.encode("utf-16-le")
        if len(pieces[-1]) + 5 > MOST:
            pieces.append(bytearray())
        pieces[-1] += struct.pack("<HB", len(letters) // 2, 1)
        while letters:
            room = (MOST - len(pieces[-1])) // 2 * 2
            pieces[-1] += letters[:room]
            if letters := letters[room:]:
                pieces.append(bytearray(b"\1"))
    shared = b"".join(record(CONTINUE if k else SST, bytes(p)) for k, p in enumerate(pieces))
    names = [name.encode("utf-16-le") for name, _ in tables]
    head = record(BOF, struct.pack("<HHHHII", 0x0600, 0x0005, 0, 0, 0, 0))
    at = len(head) + sum(12 + len(n) for n in names) + len(shared) + 4
    listed = b""
    for name, body in zip(names, bodies):
        listed += record(SHEET, struct.pack("<IBBBB", at, 0, 0, len(name) // 2, 1) + name)
        at += len(body)
    return compound("Workbook", head + listed + shared + record(EOF, b"") + b"".join(bodies))


def compound(name: str, stream: bytes, size: int = 512) -> bytes:
    """A compound file with one stream, which is filled up so that it needs no short sectors."""
    stream = stream.ljust(4096, b"\0")
    n = -(-len(stream) // size)
    each = size // 4
    tables = more = 0
    while True:  # the allocation table has to hold its own sectors too
        need = -(-(n + 1 + tables + more) // each)
        need_more = max(0, -(-(need - 109) // (each - 1)))
        if (need, need_more) == (tables, more):
            break
        tables, more = need, need_more
    at_table, at_more = n + 1, n + 1 + tables
    chain = [*range(1, n), LAST, LAST, *[TABLE] * tables, *[TABLE - 1] * more]
    chain += [FREE] * (tables * each - len(chain))
    places = [*range(at_table, at_table + tables)]
    header = SIGNATURE + bytes(16) + struct.pack("<HHHHH6xIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, tables, n, 0, 4096, LAST, 0, at_more if more else LAST, more)
    header += struct.pack("<109I", *(places[:109] + [FREE] * (109 - len(places[:109]))))
    entry = lambda label, kind, child, first, length: (label.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBBIII36xIII", 2 * len(label) + 2, kind, 1, FREE, FREE, child, first, length, 0)
    directory = entry("Root Entry", 5, 1, LAST, 0) + entry(name, 2, FREE, 0, len(stream)) + bytes(size - 256)
    rest = places[109:]
    over = b"".join(struct.pack(f"<{each}I", *(rest[k : k + each - 1] + [FREE] * (each - 1 - len(rest[k : k + each - 1]))), at_more + k // (each - 1) + 1 if k + each - 1 < len(rest) else LAST) for k in range(0, len(rest), each - 1))
    return header + stream.ljust(n * size, b"\0") + directory + struct.pack(f"<{len(chain)}I", *chain) + over


def workbooks(rows: DataFrame) -> DataFrame:
    """Rows (book, content) of rows (book, sheet, row, values array<string>): a workbook each, which holds 65,536 rows in a
    sheet at most. Rows that are missing come out empty."""
    ship(rows.sparkSession)

    def written(table: pa.Table) -> pa.Table:
        tables: dict[str, dict[int, list]] = {}
        for sheet, row, values in zip(*(table[c].to_pylist() for c in ("sheet", "row", "values"))):
            tables.setdefault(sheet, {})[row] = values
        content = workbook([(name, [own.get(k, []) for k in range(max(own) + 1)]) for name, own in sorted(tables.items())])
        return pa.table({"book": table["book"][:1], "content": pa.array([content], pa.binary())})

    own = rows.select(F.col("book").cast("string"), F.col("sheet").cast("string"), "row", "values")
    return own.groupBy("book").applyInArrow(written, "book string, content binary")

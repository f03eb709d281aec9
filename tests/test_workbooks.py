import random
import struct

import pytest

from proofsieve.sources import registers, workbooks


def grids(found):
    return [(name, {(k, c): v for k, row in table.items() for c, v in row.items()}) for name, table in found]


def expected(tables):
    show = lambda v: v if isinstance(v, str) else workbooks.shown(v)
    return [(name, {(k, c): show(v) for k, row in enumerate(rows) for c, v in enumerate(row) if v is not None}) for name, rows in tables]


def test_round_trip_of_texts_and_numbers():
    rng = random.Random(1)
    for n in (0, 1, 40, 900):
        words = ["", "a", "Ünï", "漢字", "🔎x", "long " * 3000, *(f"text {k}" * rng.randrange(1, 40) for k in range(n))]
        tables = [(name, [[rng.choice([rng.choice(words), None, rng.randrange(10**9), rng.random(), -2.5]) for _ in range(rng.randrange(6))] for _ in range(n)]) for name in ("One", "Zwei ü")]
        assert grids(workbooks.sheets(workbooks.workbook(tables))) == expected(tables)


def test_large_files_need_tables_of_tables():
    tables = [("Big", [[float(k), f"row {k} " + "y" * 700] for k in range(6000)])]
    data = workbooks.workbook(tables)
    assert struct.unpack_from("<I", data, 72)[0] > 0 and grids(workbooks.sheets(data)) == expected(tables)


def test_other_records():
    record = lambda kind, data: struct.pack("<HH", kind, len(data)) + data
    head = record(workbooks.BOF, bytes(16))
    sheet = record(workbooks.BOF, bytes(16))
    sheet += record(workbooks.RK, struct.pack("<HHHI", 0, 0, 0, 1234 << 2 | 2)) + record(workbooks.RK, struct.pack("<HHHI", 0, 1, 0, (-5 & 0x3FFFFFFF) << 2 | 3))
    sheet += record(workbooks.MANY_RK, struct.pack("<HHHIHIH", 1, 2, 0, 7 << 2 | 2, 0, struct.unpack("<I", struct.pack("<d", 2.5)[4:])[0], 3))
    sheet += record(workbooks.LOGICAL, struct.pack("<HHHBB", 2, 0, 0, 1, 0)) + record(workbooks.LOGICAL, struct.pack("<HHHBB", 2, 1, 0, 0x2A, 1))
    sheet += record(workbooks.FORMULA, struct.pack("<HHHd", 3, 0, 0, 6.25) + bytes(6)) + record(workbooks.FORMULA, struct.pack("<HHH", 3, 1, 0) + b"\0\0\0\0\0\0\xff\xff" + bytes(6)) + record(workbooks.STRING, struct.pack("<HB", 3, 0) + b"abc")
    sheet += record(workbooks.LABEL, struct.pack("<HHHHB", 4, 0, 0, 2, 1) + "é漢".encode("utf-16-le")) + record(workbooks.RICH, struct.pack("<HHHHBH", 4, 1, 0, 2, 8, 1) + b"hi" + bytes(4)) + record(workbooks.EOF, b"")
    start = len(head) + len(record(workbooks.SHEET, bytes(6 + 3))) + 4
    stream = head + record(workbooks.SHEET, struct.pack("<IBBBB", start, 0, 0, 1, 0) + b"S") + record(workbooks.EOF, b"") + sheet
    got = grids(workbooks.sheets(workbooks.compound("Book", stream)))
    assert got == [("S", {(0, 0): "1234", (0, 1): "-0.05", (1, 2): "7", (1, 3): "2.5", (2, 0): "TRUE", (2, 1): "#N/A", (3, 0): "6.25", (3, 1): "abc", (4, 0): "é漢", (4, 1): "hi"})]


def test_small_streams_lie_in_short_sectors():
    table = lambda entries: struct.pack("<128I", *(entries + [workbooks.FREE] * (128 - len(entries))))
    small = b"0123456789" * 20  # 200 bytes: four short sectors
    header = workbooks.SIGNATURE + bytes(16) + struct.pack("<HHHHH6xIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, 1, 1, 0, 4096, 2, 1, workbooks.LAST, 0) + struct.pack("<109I", 0, *[workbooks.FREE] * 108)
    entry = lambda label, kind, first, length: (label.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBBIII36xIII", 2 * len(label) + 2, kind, 1, workbooks.FREE, workbooks.FREE, 1, first, length, 0)
    directory = (entry("Root Entry", 5, 3, 256) + entry("Own", 2, 0, 200)).ljust(512, b"\0")
    shuffled = [small[0:64], small[128:192], small[64:128], small[192:200].ljust(64, b"\0")]
    data = header + table([workbooks.TABLE, workbooks.LAST, workbooks.LAST, workbooks.LAST]) + directory + table([2, 3, 1, workbooks.LAST]) + b"".join(shuffled).ljust(512, b"\0")
    assert workbooks.Compound(data).stream("Own") == small and workbooks.Compound(data).stream("None") is None


def test_exports_are_read_from_files(spark, tmp_path):
    head = [["Advisers as on Oct 03, 2026"], ["", "", "", "Correspondence Address"], ["Name", "Registration No.", "City", "City"]]
    for k in range(3):
        (tmp_path / f"export{k}.xls").write_bytes(workbooks.workbook([("Sheet1", [*head, [f"Firm {k}", float(1000 + k), "Pune", None], ["Other", "INA1", None, "Delhi"]])]))
    found = workbooks.cells(spark, str(tmp_path / "*.xls")).withColumn("sheet", workbooks.F.col("path"))
    titles, rows = registers.rows_of_sheets(found.select("sheet", "row", "values"))
    assert {(r.title, str(r.as_of)) for r in titles.collect()} == {("Advisers as on Oct 03, 2026", "2026-10-03")}
    got = sorted((r.sheet[-5], r.row, r.fields["name"], r.fields["registration_no"], r.fields["city"], r.fields["corr_city"]) for r in rows.collect())
    assert got == [x for k in range(3) for x in ((str(k), 3, f"Firm {k}", str(1000 + k), "Pune", ""), (str(k), 4, "Other", "INA1", "", "Delhi"))]
    (tmp_path / "export9.xls").write_bytes(b"no workbook at all")
    with pytest.raises(Exception, match=r"export9.xls can't be read: no compound file"):
        workbooks.cells(spark, str(tmp_path / "*.xls")).count()

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from proofsieve.llm import planes, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["word,", "café, café×b Ä÷c é", "a1 é2 ī3", "I'll café's", "x\x80", " ", "  ", "a", " a", "a ", "a  b", "\n\n x", "x\n y", "x\n  y", "a  b", "　 c", " 　c", "é ñ", "it's  we'll", "<|endoftext|>", "a <|endoftext|> b", "a  <|endoftext|>  b", "\t \t", "\x1c \x1d x", "汉字 漢", " " * 50 + "x", "1 22  333", "\x85 y", "don't!a", "ÿ", "ÿ ​   z", "x" * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def made(seed, n):
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", "\t", " ", " ", "　", "a", "word", "It's", "é", "ß", "×", "÷", "ż", ",", "'s", "b", "漢", "12", "!", "...", "<|endoftext|>", "🙂", "‍", "\x00", "\x1f", " ", "́"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_encoder_equals_library(library, monkeypatch):
    encoder = planes.Encoder(open(PATH, encoding="utf-8").read())
    assert encoder.cuts
    texts = [*ODD, None, *made(1, 4000), None]
    got = [x.tolist() for x in encoder.encode(pa.array(texts))]
    assert got == [expected(library, t) for t in texts]
    monkeypatch.setattr(planes, "SLICE", 40)
    monkeypatch.setattr(planes, "REMEMBERED", 2000)
    assert [x.tolist() for x in encoder.encode(pa.array(texts).slice(3, 600))] == got[3:603]
    long = " ".join(made(2, 500))
    assert [x.tolist() for x in encoder.encode(pa.array([long, "tail"]))] == [expected(library, long), expected(library, "tail")]


def test_whole_texts_for_other_vocabularies():
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    encoder = planes.Encoder(json.dumps(spec))
    library = Tokenizer.from_str(json.dumps(spec))
    assert not encoder.cuts
    assert [x.tolist() for x in encoder.encode(pa.array(["a b", None, "c"]))] == [library.encode(t, add_special_tokens=False).ids for t in ("a b", "", "c")]


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_planes_round_trip(unit):
    rng = np.random.default_rng(3)
    for dtype in (np.uint8, np.uint32, np.uint64):
        for n in (0, 1, 7, 8, 1000):
            x = rng.integers(0, np.iinfo(dtype).max, n, dtype, endpoint=True)
            assert (planes.from_planes(planes.to_planes(x, unit), n, dtype, unit) == x).all()
    few = planes.to_planes(np.full(100, 5, np.uint32), unit)
    assert sum(map(len, few[8 if unit == "bit" else 1 :])) == 0


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_files_of_several_blocks(tmp_path, monkeypatch, unit):
    monkeypatch.setattr(planes, "BLOCK", 10)
    monkeypatch.setattr(planes, "DOCS", 4)
    monkeypatch.setattr(planes, "READ", 12)
    rng = random.Random(4)
    docs = [(None if k == 3 else k - 2, [rng.randrange(2**32) for _ in range(rng.randrange(40))]) for k in range(30)]
    out = planes.PlaneFile(str(tmp_path), "one.planes", unit)
    for doc_id, ids in docs:
        out.add(doc_id, np.array(ids, np.uint32))
    assert out.close() == ("one.planes", 30, sum(len(ids) for _, ids in docs))
    got = []
    for ids, none, lengths, flat in planes.read_file(str(tmp_path / "one.planes")):
        for doc_id, missing, own in zip(ids.tolist(), none, np.split(flat, np.cumsum(lengths)[:-1])):
            got.append((None if missing else doc_id, own.tolist()))
    assert got == docs
    (tmp_path / "other").write_bytes(b"x" * 100)
    with pytest.raises(ValueError, match="no file of planes"):
        next(planes.read_file(str(tmp_path / "other")))


def check(spark, tmp_path, library, rows, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.op13_plane_files(spark, str(tmp_path))
    assert df.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    got = sorted(map(tuple, df.collect()), key=lambda r: r[1])
    assert len(got) == len(rows)
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    start, left = 0, {}
    for doc_id, text, *_ in rows:
        ids = np.array([*expected(library, text), 0], "<u4")
        left.setdefault(doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for doc_id, at, n, crc in got:
        assert at == start
        start += n
        left[doc_id].remove((n, crc))
    assert not any(left.values())


def test_query_against_library(spark, tmp_path, library, monkeypatch):
    rows = [(i * 7 % 301 - 20, t) for i, t in enumerate(made(5, 300))] + [(None, "null id"), (None, None), (5, None), (2**62, "x " * 20000)] + [(9, "same text")] * 50 + [(9, "other text")]
    check(spark, tmp_path, library, rows)


def test_empty_table(spark, tmp_path, library):
    check(spark, tmp_path, library, [])


def test_clashing_columns(spark, tmp_path, library):
    rows = [(k, f"text {k}", "a", "b", "c", "d") for k in range(20)]
    check(spark, tmp_path, library, rows, "doc_id long, text string, ids string, start string, _hash string, _place string")


def test_two_writes_are_read_as_one(spark, tmp_path):
    folder = str(tmp_path / "planes")
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    for unit in ("bit", "byte"):
        planes.write(planes.ordered(docs).coalesce(1), folder, unit, PATH)
    copy = str(tmp_path / "copy")
    planes.write(planes.read(spark, folder).orderBy("start").select("doc_id", "ids"), copy, "bit")
    assert [r.start for r in planes.read(spark, copy).orderBy("start").collect()] == [0, 3, 5, 8]
    got = planes.read(spark, folder).withColumn("n", F.octet_length("ids")).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.n) for r in got] == [(1, 0, 3, 12), (2, 3, 2, 8), (1, 5, 3, 12), (2, 8, 2, 8)]


def test_pieces_that_are_asked_for_stay_remembered(library, monkeypatch):
    monkeypatch.setattr(planes, "REMEMBERED", 40_000)
    encoder = planes.Encoder(open(PATH, encoding="utf-8").read())
    asked, original = [], encoder.tokenizer

    class Asked:
        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return original.encode_batch_fast(texts, **more)

    encoder.tokenizer = Asked()
    for k in range(300):
        text = f"often this {k:05}word"
        assert [x.tolist() for x in encoder.encode(pa.array([text]))] == [expected(library, text)]
    assert len(encoder.known) < 200 and asked.count(" this") == 1

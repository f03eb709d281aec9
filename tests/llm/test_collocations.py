import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from proofsieve.llm import collocations, queries
from proofsieve.llm.collocations import Settings, Sketch


def brute(rows, least=100, first=2000):
    """The contract over rows (text, lang), phrase by phrase."""
    words, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for n in range(1, 6):
                for i in range(len(ws) - n + 1):
                    f[lang, tuple(ws[i : i + n])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in candidates.items():
        if any(b >= a for (other, q), b in candidates.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
            continue
        score, _, left, right = min((1000 * a * words[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    got, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= first:
            got.append((lang, rank[lang], phrase.decode(), -a, left, right, words[lang], -score))
    return got


def made(seed, n, size=30):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "of", "Ünion", "état", "a", "b'c", "x-y", "\x00z", "new", "york", "漢字", "\x1c", "end"]
    seps = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "!?", " ; "]
    texts = []
    for _ in range(n):
        texts.append("".join(rng.choice(vocabulary[: rng.randrange(3, 14)]) + rng.choice(seps) for _ in range(rng.randrange(size))))
    return [(t, rng.choice(["en", "en", "de", None, "und", ""])) for t in texts]


def run(spark, tmp_path, rows, settings=None, schema="text string, lang string"):
    df = spark.createDataFrame(rows, schema).repartition(3)
    if settings:
        got = collocations.collocations(df, settings)
    else:
        df.write.parquet(str(tmp_path / "documents.parquet"))
        got = queries.op11_count_min(spark, str(tmp_path))
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, got.collect()), key=lambda r: r[:2])


def test_query_against_brute_force_and_sql(spark, tmp_path):
    rows = [*made(1, 9000), (None, "en"), ("", None), ("new york " * 3000, "en"), *[("One line that repeats. New, York", "fr")] * 150]
    got = run(spark, tmp_path, rows)
    assert got == brute(rows) and len(got) > 50
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.sql(queries.OP11_SQL).fetchall()) == got


def test_ranks_end_at_the_first(spark, tmp_path):
    rows = made(2, 400)
    assert run(spark, tmp_path, rows, Settings(least=3, first=7)) == brute(rows, 3, 7)


def test_small_sketches_lose_nothing(spark, tmp_path, monkeypatch):
    rows = made(3, 300)
    want = brute(rows, 5)
    monkeypatch.setattr(collocations, "HELD", 500)
    monkeypatch.setattr(collocations, "SLICE", 300)
    monkeypatch.setattr(collocations, "ROWS_HELD", 50)
    monkeypatch.setattr(collocations, "LEAST", 8)
    for bytes_a_cell, shard in ((40, 1 << 27), (4000, 1 << 27), (2, 1000)):
        monkeypatch.setattr(collocations, "BYTES_A_CELL", bytes_a_cell)
        monkeypatch.setattr(collocations, "SHARD", shard)
        assert run(spark, tmp_path, rows, Settings(least=5)) == want


@pytest.mark.parametrize("rows", [[], [(None, None)], [("", "en"), ("one two", None)]])
def test_nothing_frequent(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows) == []


def test_clashing_columns(spark, tmp_path):
    rows = [(t, lang, *"abcdefg") for t, lang in made(4, 700)]
    schema = "text string, lang string, phrase string, a string, n string, words string, range string, slot string, _score string"
    assert run(spark, tmp_path, rows, schema=schema) == brute([r[:2] for r in rows])


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice(["word", "an", "x" * 60, "é"]) + rng.choice([" ", "\t", ". ", "  ", "\n"]) for _ in range(400))
    count = lambda: sum((Counter({b" ".join(w.known[c].as_py() for c in w.code[e - n + 1 : e + 1]): 1}) for w in collocations.cut(pa.array([text]), pa.array(["en"]), 5) for n, _, ends in w.hashes(5) for e in ends), Counter())
    whole = count()
    for limit in (10, 33, 200):
        monkeypatch.setattr(collocations, "SLICE", limit)
        assert count() == whole


def test_sketches_never_say_too_little(monkeypatch):
    monkeypatch.setattr(collocations, "LEAST", 8)
    rng = np.random.default_rng(6)
    sketch = Sketch.over(40_000)
    cells = [rng.integers(0, sketch.cells, n).astype(np.uint32) for n in (5000, 30, 900)]
    total = {}
    for part in cells:
        for k, packed in collocations._packed(part, sketch.span, 100):
            collocations._add(total.setdefault(k, np.zeros(sketch.span, np.uint32)), packed, 100)
    want = np.minimum(np.bincount(np.concatenate(cells), minlength=sketch.cells), 100)
    got = np.concatenate([total.get(k, np.zeros(sketch.span)) for k in range(sketch.cells // sketch.span)])
    assert (got == want).all()
    hashes = rng.integers(0, 2**63, 1000).astype(np.uint64)
    assert all((sketch.of(hashes, row) < sketch.width).all() for row in range(2))
    assert Sketch.over(10**12).shards > 1

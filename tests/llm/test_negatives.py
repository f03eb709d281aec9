import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofsieve.llm import negatives, queries


def brute(rows):
    """The contract, pair by pair, over rows (vec_id, embedding, label)."""
    good = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, (anchor, label, v) in enumerate(good):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, lab) for b, (i, lab, w) in enumerate(good) if b != a]
        for p, pid, _ in sorted((s for s in scored if s[2] == label), key=order)[:5]:
            fit = sorted((s for s in scored if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p), key=order)[:10]
            out += [(anchor, pid, r + 1, i, p, s) for r, (s, i, _) in enumerate(fit)]
    return sorted(out, key=str)


def mined(spark, tmp_path, rows, schema="vec_id long, embedding array<float>, label int"):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op12_bit_sliced(spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()), key=str)


def made(n, d, seed, labels=3):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 0.2) for _ in range(d)] for _ in range(4)]
    f32 = lambda x: float(np.float32(x))
    return [(i, [f32(x + rng.gauss(0, 0.05)) for x in base[rng.randrange(4)]], rng.randrange(labels)) for i in range(n)]


def test_matches_brute_force_with_ties(spark, tmp_path):
    rows = made(330, 6, 1)
    rows += [(i + 1000, v, lab) for i, v, lab in rows[:90]]  # the same vectors again: ties
    assert mined(spark, tmp_path, rows) == brute(rows)


def test_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [*made(120, 3, 2), (500, None, 1), (501, [1.0, None, 0.0], 1), (600, [nan, 0.0, 0.0], 1), (700, [inf, 0.0, 0.0], 0), (800, [1.0, 1.0, 1.0], None)]
    rows += [(None, [0.3, 0.1, 0.2], 1), (None, [0.3, 0.1, 0.2], 2), (-100, [0.5, 0.5, -0.5], 1), (-7, [0.5, 0.5, -0.5], 9), (900, [], 1), (1000, [0.0], 2)]
    rows += [(0, *r[1:]) for r in rows[:3]] * 2  # one id on many rows
    same_width = [r if r[1] is None else (r[0], [*r[1], *[0.0] * (3 - len(r[1]))], r[2]) for r in rows]
    assert mined(spark, tmp_path, rows) == brute(same_width)


def test_large_components_stay_exact(spark, tmp_path):
    rng = random.Random(3)
    for k, scale in enumerate((1e3, 1e6)):
        rows = [(i, [float(np.float32(rng.gauss(0.2, 0.5) * scale)) for _ in range(3)], i % 2) for i in range(60)]
        (tmp_path / str(k)).mkdir()
        got = mined(spark, tmp_path / str(k), rows)
        assert got == brute(rows) and got
    huge = [(i, [1e30 * (i + 1), -1e38], i % 2) for i in range(20)]
    (tmp_path / "huge").mkdir()
    assert isinstance(mined(spark, tmp_path / "huge", huge), list)  # past 64 bits; it just must not fail


def test_small_tiles_and_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(negatives, "CELL_VALUES", 12)
    monkeypatch.setattr(negatives, "CELLS", 3)
    rows = made(250, 4, 4)
    assert mined(spark, tmp_path, rows) == brute(rows)


def test_tiles_carry_their_bars():
    rng = np.random.default_rng(5)
    a, c = rng.integers(-90, 90, (7, 12)), rng.integers(-90, 90, (400, 12))
    near = negatives.Nearest(5, 7)
    best = np.sort(a @ c.T, axis=1)[:, -5:]
    kept = 0
    for at in range(0, 400, 50):
        i, j, s = negatives.products(a, c[at : at + 50], np.ones((7, 50), bool), near.keep(slice(0, 7)))
        assert (s == (a[i] * c[at + j]).sum(axis=1)).all()
        near.saw(0, i, s)
        kept += len(i)
    assert (near.best == best).all() and kept < 7 * 400 / 4


@pytest.mark.parametrize("rows", [[], [(1, [0.1], 1)], [(100, [0.1, 0.2], 1)]])
def test_nothing_to_mine(spark, tmp_path, rows):
    assert mined(spark, tmp_path, rows) == []


def test_clashing_columns(spark, tmp_path):
    rows = made(210, 4, 6)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for c in ("key", "v", "cell", "part", "w", "rank", "is_anchor", "scores"):
        df = df.withColumn(c, F.lit("x"))
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(map(tuple, queries.op12_bit_sliced(spark, str(tmp_path)).collect()), key=str) == brute(rows)

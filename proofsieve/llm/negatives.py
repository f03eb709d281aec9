"""Hard negatives by bit-sliced integer products.

Vectors are integers. A cell of candidates is cut into the bit planes of their components in two's complement. Planes
are multiplied with the anchors from the most significant one on; after each, what the planes to come can add at most
and at least gives an interval for each pair's product. A pair whose interval cannot reach what its anchor asks for is
dropped; the last planes are only multiplied for the pairs that are left, whose products are then exact.

Anchors are a stated set of rows that is held against all rows: both are dealt into a grid of cells of bounded size,
and each cell hands on a few best rows for each anchor, from which Spark takes the best of all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsieve.session import checkpointed, ship

#: Components of a cell's candidates or anchors at most, and cells that candidates are dealt into at least.
CELL_VALUES, CELLS = 2_097_152, 32
#: Anchors and candidates that are multiplied at once.
TILE = 1024, 4096
#: Share of a tile's pairs below which planes are multiplied pair by pair.
FEW = 0.04
#: Products up to this are exact as floating-point numbers, and up to that as 64-bit ones.
EXACT, LONG = 1 << 52, 1 << 62


@dataclass(frozen=True)
class Settings:
    positives: int = 5
    negatives: int = 10
    #: Of a positive's score, what a negative's score is at least and at most, in hundredths.
    least: int = 30
    most: int = 90


def quantised(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component as a long; null for a null vector and one with a null or non-finite component.
    What passes 64 bits counts as the largest or smallest long."""
    inf = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != inf))
    whole = F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * factor, F.lit(-(2.0**62))), F.lit(2.0**62))).cast("long"))
    return F.when(finite, whole)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones end in zeros."""
    lists = column.combine_chunks()
    lengths = np.asarray(lists.value_lengths())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = np.asarray(lists.flatten())
    return out


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and whether they are null."""
    return column.fill_null(0).to_numpy().astype(np.int64), column.is_null().to_numpy().astype(bool)


def _first(group: np.ndarray, score: np.ndarray, ids: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """Places of the first k of each group: by score from the highest, then by id, nulls last."""
    order = np.lexsort((ids[0], ids[1], -score, group))
    own = group[order]
    start = np.concatenate(([True], own[1:] != own[:-1]))[: len(own)]
    rank = np.arange(len(own)) - np.maximum.accumulate(np.where(start, np.arange(len(own)), 0))
    return order[rank < k]


def products(anchors: np.ndarray, candidates: np.ndarray, alive: np.ndarray, keep: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, product) of the pairs of rows that stay; alive says which pairs come into question.

    keep(low, high, alive, rows) gets the bounds of products, as a matrix or as those of pairs whose anchors are
    `rows`, and says which pairs can still qualify.
    """
    top = max(int(candidates.max(initial=0)), -1 - int(candidates.min(initial=0)))
    bits = top.bit_length() + 1
    widest = max(1, int(np.abs(anchors).sum(axis=1, initial=0, dtype=np.float64).max(initial=0))) << bits
    kind = np.float64 if widest < EXACT else np.int64 if widest < LONG else object
    left = anchors.astype(kind)
    low, high = np.minimum(left, 0).sum(axis=1), np.maximum(left, 0).sum(axis=1)
    score = np.zeros((len(anchors), len(candidates)), kind)
    i = None
    for k in range(bits - 1, -1, -1):
        weight, rest = -(1 << k) if k == bits - 1 else 1 << k, (1 << k) - 1
        plane = candidates >> k & 1
        if i is None:
            score += left @ plane.T.astype(kind) * weight
            alive = keep(score + (rest * low)[:, None], score + (rest * high)[:, None], alive, None)
            if np.count_nonzero(alive) < FEW * alive.size or k == 0:
                i, j = np.nonzero(alive)
                score = score[i, j]
        else:
            score = score + (left[i] * plane[j]).sum(axis=1) * weight
            stay = keep(score + rest * low[i], score + rest * high[i], None, i)
            i, j, score = i[stay], j[stay], score[stay]
    return i, j, score.astype(np.int64) if kind is not object else score


def _reach(values: np.ndarray, k: int) -> np.ndarray:
    """The kth largest of each row, -inf where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    bar = np.partition(values, values.shape[1] - k, axis=1)[:, -k]
    return np.where(np.abs(bar) < EXACT, bar, bar - np.abs(bar) * 1e-12)  # never above the number that it stands for


class Nearest:
    """Rows of the anchor's label, the k with the highest products; what earlier tiles found raises the bar."""

    def __init__(self, k: int, n: int):
        self.k, self.bar, self.best = k, np.full(n, -np.inf), np.full((n, k), -np.inf)

    def keep(self, at: slice) -> Callable:
        bar = self.bar[at]

        def rule(low, high, alive, rows):
            if rows is not None:
                return high >= bar[rows]
            np.maximum(bar, _reach(np.where(alive, low, -np.inf).astype(float), self.k), out=bar)
            return alive & (high >= bar[:, None])

        return rule

    def saw(self, at: int, i: np.ndarray, score: np.ndarray) -> None:
        """Takes in the products of a tile's pairs, whose anchors are those from `at` on."""
        if not len(i):
            return
        rows = np.unique(i)
        order = np.lexsort((-score.astype(float), i))
        rank = np.arange(len(i)) - np.searchsorted(i[order], i[order])
        few = order[rank < self.k]
        found = np.full((len(rows), self.k), -np.inf)
        found[np.searchsorted(rows, i[few]), rank[rank < self.k]] = score[few].astype(float)
        found = np.where(np.abs(found) < EXACT, found, found - np.abs(found) * 1e-12)
        both = np.sort(np.concatenate([self.best[rows + at], found], axis=1), axis=1)[:, -self.k :]
        self.best[rows + at] = both
        self.bar[rows + at] = np.maximum(self.bar[rows + at], both[:, 0])


def _windowed(least: np.ndarray, most: np.ndarray, k: int) -> Callable:
    """Rows whose products lie in one of the anchor's windows, and among the k highest that surely do."""
    bars = np.full(least.shape, -np.inf)

    def rule(low, high, alive, rows):
        if rows is not None:
            return ((high[:, None] >= least[rows]) & (high[:, None] >= bars[rows]) & (low[:, None] <= most[rows])).any(axis=1)
        out = np.zeros(alive.shape, bool)
        for w in range(least.shape[1]):
            fits = alive & (high >= least[:, w, None]) & (low <= most[:, w, None])
            sure = fits & (low >= least[:, w, None]) & (high <= most[:, w, None])
            enough = np.flatnonzero(np.count_nonzero(sure, axis=1) >= k)
            if len(enough):
                bars[enough, w] = np.maximum(bars[enough, w], _reach(np.where(sure[enough], low[enough], -np.inf).astype(float), k))
            out |= fits & (high >= bars[:, w, None])
        return out

    return rule


def _tiles(anchors: int, candidates: int) -> Iterator[tuple[slice, slice]]:
    for a in range(0, anchors, TILE[0]):
        for c in range(0, candidates, TILE[1]):
            yield slice(a, a + TILE[0]), slice(c, c + TILE[1])


def _sides(anchors: pa.Table, rows: pa.Table) -> tuple:
    width = max(np.asarray(t["v"].combine_chunks().value_lengths()).max(initial=0) for t in (anchors, rows))
    return _matrix(anchors["v"], width), _matrix(rows["v"], width), anchors["key"].to_numpy(), rows["key"].to_numpy(), anchors["label"].to_numpy(), rows["label"].to_numpy(), _ids(rows["vec_id"])


def _best_positives(k: int) -> Callable:
    def of(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        a, c, akey, ckey, alabel, clabel, ids = _sides(anchors, rows)
        near, found = Nearest(k, len(a)), []
        for x, y in _tiles(len(a), len(c)):
            alive = (alabel[x, None] == clabel[y]) & (akey[x, None] != ckey[y])
            i, j, score = products(a[x], c[y], alive, near.keep(x))
            near.saw(x.start, i, score)
            found.append((i + x.start, j + y.start, score))
        i, j, score = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        few = _first(i, score, (ids[0][j], ids[1][j]), k)
        i, j, score = i[few], j[few], score[few]
        return pa.table({"key": akey[i], "positive_id": pa.array(ids[0][j], mask=ids[1][j]), "positive_score": _longs(score)})

    return of


def _longs(score: np.ndarray) -> pa.Array:
    """Products past 64 bits are handed on as the largest or smallest long."""
    return pa.array([min(max(s, -(2**63)), 2**63 - 1) for s in score.tolist()] if score.dtype == object else score.astype(np.int64), pa.int64())


def _best_negatives(settings: Settings) -> Callable:
    def of(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        a, c, akey, ckey, alabel, clabel, ids = _sides(anchors, rows)
        scores = anchors["scores"].to_pylist()
        width = max(map(len, scores), default=0)
        kind = np.int64 if all(abs(p) < LONG // 128 for own in scores for p in own) else object
        least, most = (np.full((len(a), width), x, kind) for x in (1, 0))  # windows without a positive hold nothing
        for n, own in enumerate(scores):
            for w, p in enumerate(own):
                least[n, w], most[n, w] = -(-settings.least * p // 100), settings.most * p // 100
        found = []
        for x, y in _tiles(len(a), len(c)):
            i, j, score = products(a[x], c[y], alabel[x, None] != clabel[y], _windowed(least[x], most[x], settings.negatives))
            i, j = i + x.start, j + y.start
            for w in range(width):
                own = np.flatnonzero((score >= least[i, w]) & (score <= most[i, w]))
                own = own[_first(i[own], score[own], (ids[0][j[own]], ids[1][j[own]]), settings.negatives)]
                found.append((i[own], np.full(len(own), w), j[own], score[own]))
        i, w, j, score = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
        few = _first(i * max(1, width) + w, score, (ids[0][j], ids[1][j]), settings.negatives)
        i, w, j, score = i[few], w[few], j[few], score[few]
        return pa.table({"key": akey[i], "w": w.astype(np.int32), "negative_id": pa.array(ids[0][j], mask=ids[1][j]), "negative_score": _longs(score)})

    return of


def _ranked(df: DataFrame, by: list[str], score: str, id: str, k: int) -> DataFrame:
    """The first k rows of each group with their rank from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(id))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, settings: Settings = Settings()) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among vectors
    (vec_id, label, v), v being a list of longs, and is_anchor a column over them.

    An anchor's positives are the other rows of its label with the highest products, of equal ones those with the
    smallest vec_id; its negatives for a positive are the rows of other labels whose product is `least` to `most`
    hundredths of the positive's, in the same order. Rows with a null label or vector take no part; a null vec_id comes
    last among equals and is no anchor unless is_anchor says so; shorter vectors end in zeros; rows with equal ids are
    rows of their own; scores past 64 bits become the largest long. An empty table, and anchors without positives or
    negatives, give no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    usable = vectors.where(F.col("label").isNotNull() & F.col("v").isNotNull())
    rows = checkpointed(usable.select(F.monotonically_increasing_id().alias("key"), "vec_id", F.col("label").cast("long").alias("label"), "v", F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")))
    n, n_anchors, width = rows.agg(F.count("*"), F.count_if("is_anchor"), F.max(F.size("v"))).first()
    most = max(1, CELL_VALUES // max(1, width or 0))
    cells, groups = max(CELLS, -(-n // most)), max(1, -(-n_anchors // most))
    dealt = lambda m: F.pmod(F.xxhash64("key"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    own = (F.col(c).alias(c) for c in ("key", "vec_id", "label", "v"))  # columns of their own beside those of the anchors
    candidates = rows.select(dealt(cells).alias("cell"), every(groups).alias("part"), *own).groupBy("part", "cell")
    anchors = rows.where("is_anchor")
    spread = lambda df, *more: df.select(dealt(groups).alias("part"), every(cells).alias("cell"), "key", "label", "v", *more).groupBy("part", "cell")
    near = spread(anchors).cogroup(candidates).applyInArrow(_best_positives(settings.positives), "key long, positive_id long, positive_score long")
    positives = checkpointed(_ranked(near, ["key"], "positive_score", "positive_id", settings.positives).withColumnRenamed("rank", "w"))
    scores = positives.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "positive_score"))), lambda p: p.positive_score).alias("scores"))
    hard = spread(anchors.join(scores, "key"), "scores").cogroup(candidates).applyInArrow(_best_negatives(settings), "key long, w int, negative_id long, negative_score long")
    negatives = _ranked(hard.withColumn("w", F.col("w") + 1), ["key", "w"], "negative_score", "negative_id", settings.negatives)
    named = anchors.select("key", F.col("vec_id").alias("anchor_id"))
    return negatives.join(positives, ["key", "w"]).join(named, "key").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

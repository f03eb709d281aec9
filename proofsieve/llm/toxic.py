"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the mean of hashed embeddings: its own and those of its runs of four to six letters, so that words
are known by their stems. Filters one, two and three words wide pass over the whole text, the strongest answer of each
filter counts, and a logistic layer weighs them. Labelled documents are dealt into shards; a task for each trains
embeddings, filters and weights by Adam, and the models are averaged; embeddings start from how unevenly labels hold each
bucket. For scoring, a worker keeps the answers of
the words it has met to each word of every filter, so that a convolution is a sum of rows. Thresholds for each language
are calibrated on labelled documents that training didn't see; they are not part of the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsieve.session import checkpointed, ship, small_side

WORD = re.compile(r"[^\W\d_]+")
WIDTHS = (1, 2, 3)
#: Lengths of the runs of letters that words are known by, their ends counting as letters.
RUNS = (4, 5, 6)
#: Words that a worker remembers, and those of a text that are scored at once; parts overlap by the widest filter.
REMEMBERED, PART = 100_000, 50_000
SLICE = 256
STEP, ODD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """sample: labelled documents that a shard of training has at most, about, and sample_chars: characters that these have
    together; of more there are as many shards as they fill. All whole texts are in one of them."""

    buckets: int = 1 << 17
    size: int = 8
    filters: int = 8
    epochs: int = 4
    batch: int = 32
    rate: float = 0.02
    sample: int = 6_000
    sample_chars: int = 20_000_000
    seed: int = 11


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def parts_of(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their runs of letters, word by word, and how many each word has."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    letters = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    starts = ends - lengths
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(max(*RUNS, int(lengths.max())), STEP, np.uint64))
        at = np.arange(len(letters)) - np.repeat(starts, lengths)
        codes = [np.add.reduceat(letters * powers[at], starts)]
        owners = [np.arange(len(words))]
        left = np.repeat(ends, lengths) - np.arange(len(letters))
        for n in RUNS:
            first = np.flatnonzero(left >= n)
            code = sum((letters[first + k] * powers[k] for k in range(n)), np.uint64(n))
            codes.append(code)
            owners.append(np.searchsorted(ends, first, "right"))
        owner = np.concatenate(owners)
        mixed = np.concatenate(codes)
        mixed = (mixed ^ mixed >> np.uint64(29)) * ODD
    order = np.argsort(owner, kind="stable")
    return ((mixed >> np.uint64(24)) % np.uint64(buckets)).astype(np.int32)[order], np.bincount(owner, minlength=len(words))


class Words:
    """Numbers for words from 1 on, 0 being for places beyond a text, and their parts."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """The numbers of words, and the parts of those that are new."""
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        for w in new:
            known[w] = len(known) + 1
        return np.fromiter(map(known.__getitem__, words), np.int32, len(words)), parts_of(new, self.buckets)


def means(E: np.ndarray, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The embedding of each word that has n of these parts."""
    if not len(n):
        return np.zeros((0, E.shape[1]), np.float32)
    return np.add.reduceat(E[flat], np.cumsum(n) - n, axis=0) / n[:, None].astype(np.float32)


@dataclass
class Model:
    """E: embeddings of buckets; W, C: filters of each width and their offsets; V, bias: the logistic layer."""

    E: np.ndarray
    W: list[np.ndarray]
    C: list[np.ndarray]
    V: np.ndarray
    bias: float


class Scorer:
    """Scores texts in a worker."""

    def __init__(self, model: Model) -> None:
        self.model = model
        # What each word of each filter answers to, side by side.
        self.filters = [F_[k] for F_ in model.W for k in range(len(F_))]
        self.words = Words(len(model.E))
        self.rows = [np.zeros((1024, x.shape[1]), np.float32) for x in self.filters]

    def _numbers(self, words: list[str]) -> np.ndarray:
        if len(self.words.known) > REMEMBERED:
            self.words.known.clear()
        before = len(self.words.known) + 1
        ids, (flat, n) = self.words(words)
        need = before + len(n)
        if need > (had := len(self.rows[0])):
            self.rows = [np.concatenate([x, np.zeros((max(need, 2 * had) - had, x.shape[1]), np.float32)]) for x in self.rows]
        if len(n):
            new = means(self.model.E, flat, n)
            for x, f in zip(self.rows, self.filters):
                x[before:need] = new @ f
        return ids

    def pooled(self, words: list[str]) -> np.ndarray:
        """The strongest answer of every filter, at least zero."""
        return self.pooled_all([words])[0]

    def pooled_all(self, texts: list[list[str]]) -> np.ndarray:
        """The same for many texts, which are numbered and held together."""
        best = np.full((len(texts), sum(map(len, self.model.C))), -np.inf, np.float32)
        beyond = max(WIDTHS) - 1
        for group in pieces([max(1, len(t)) for t in texts], PART):
            # Behind each stretch are the words that its last places look at, or none.
            near = [texts[i][a : b + beyond] for i, a, b in group]
            numbers = self._numbers([*chain.from_iterable(near)])
            sizes = np.array([b - a for _, a, b in group])
            ends = np.cumsum(sizes + beyond)
            starts = ends - sizes - beyond
            given = np.fromiter(map(len, near), np.int64, len(near))
            ids = np.zeros(ends[-1] + beyond, np.int32)
            ids[np.repeat(starts - (np.cumsum(given) - given), given) + np.arange(len(numbers))] = numbers
            bounds = np.stack([starts, starts + sizes], 1).ravel()
            own = [i for i, _, _ in group]
            at = column = 0
            for w, c in zip(WIDTHS, self.model.C):
                answer = self.rows[at].take(ids[: ends[-1]], 0)
                for k in range(1, w):
                    answer += self.rows[at + k].take(ids[k : k + ends[-1]], 0)
                at += w
                top = np.maximum.reduceat(answer, bounds, axis=0)[::2]  # what lies between stretches is left out
                part = best[:, column : column + len(c)]
                part[own] = np.maximum(part[own], top)  # a text is in a group once
                column += len(c)
        return np.maximum(best + np.concatenate(self.model.C), 0)

    def __call__(self, text: str | None) -> float:
        return next(self.of_all([text]))

    def of_all(self, texts: list[str | None]) -> Iterator[float]:
        """The score of each text; their words are held for about PART at once."""
        held: list[list[str]] = []
        n = 0
        for k, text in enumerate(texts, 1):
            held.append(words_of(text))
            n += len(held[-1])
            if n >= PART or k == len(texts):
                for z in self.pooled_all(held):
                    yield float(1 / (1 + np.exp(-np.clip(z @ self.model.V + self.model.bias, -30, 30))))
                held, n = [], 0


def pieces(lengths: list[int], most: int) -> Iterator[list[tuple[int, int, int]]]:
    """(text, start, end) of stretches of texts of these lengths, in groups of `most` places at most together."""
    group: list[tuple[int, int, int]] = []
    room = most
    for i, n in enumerate(lengths):
        for a in range(0, n, most):
            b = min(n, a + most)
            if b - a > room:
                yield group
                group, room = [], most
            group.append((i, a, b))
            room -= b - a
    if group:
        yield group


def fit(texts: list[str | None], labels: np.ndarray, settings: Settings = Settings()) -> Model:
    """A model of texts with labels 0 or 1; without both labels it scores the share of label 1."""
    return fitted(texts, labels, settings)[0]


def fitted(texts: list[str | None], labels: np.ndarray, settings: Settings) -> tuple[Model, np.ndarray]:
    """The model that fit() makes, and how many texts have each bucket."""
    s, rng = settings, np.random.default_rng(settings.seed)
    y = np.asarray(labels, np.float32)
    share = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    beyond = max(WIDTHS) - 1
    words = Words(s.buckets)
    ids, parts = [], [(np.zeros(1, np.int32), np.ones(1, np.int64))]
    for t in texts:
        own, new = words(words_of(t))
        parts.append(new)
        ids.append(np.concatenate([own if len(own) else np.zeros(1, np.int32), np.zeros(beyond, np.int32)]))
    flat = np.concatenate([x for x, _ in parts])
    starts = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in parts]))])
    del words, parts
    parts_at = lambda w: np.repeat(starts[w] - np.cumsum(n := starts[w + 1] - starts[w]) + n, n) + np.arange(n.sum())
    E = rng.normal(0, 0.05, (s.buckets, s.size)).astype(np.float32)
    seen = np.zeros((2, s.buckets))
    for own, label in zip(ids, y):
        seen[int(label), np.unique(flat[parts_at(np.unique(own))])] += 1
    total = np.array([(y == 0).sum(), (y == 1).sum()])
    odds = np.log((seen[1] + share) / (total[1] + 1)) - np.log((seen[0] + 1 - share) / (total[0] + 1))
    E[:, 0] = np.clip(odds, -3, 3)
    W = [rng.normal(0, 0.3, (w, s.size, s.filters)).astype(np.float32) for w in WIDTHS]
    for x in W:
        x[0, 0] = np.abs(x[0, 0]) + 0.5
    C = [np.zeros(s.filters, np.float32) for _ in WIDTHS]
    V = np.abs(rng.normal(0, 0.3, s.filters * len(WIDTHS))).astype(np.float32)
    B = np.array([np.log(share / (1 - share))], np.float32)
    if len(y) and 0 < y.sum() < len(y):
        P = [E, *W, *C, V, B]
        M, R = [np.zeros_like(p) for p in P], [np.zeros_like(p) for p in P]
        step = 0
        for epoch in range(s.epochs):
            order = rng.permutation(len(y))
            rate = s.rate * (1 - epoch / s.epochs)
            for at in range(0, len(order), s.batch):
                own = order[at : at + s.batch]
                best = [np.full((len(own), s.filters), -np.inf, np.float32) for _ in WIDTHS]
                place = [np.zeros((len(own), s.filters), np.int64) for _ in WIDTHS]
                for group in pieces([len(ids[i]) - beyond for i in own], PART):
                    near = np.concatenate([ids[own[i]][a : b + beyond] for i, a, b in group])
                    different, where = np.unique(near, return_inverse=True)
                    n = starts[different + 1] - starts[different]
                    X = means(E, flat[parts_at(different)], n)
                    X[different == 0] = 0
                    X = X[where]
                    for j, (w, F_) in enumerate(zip(WIDTHS, W)):
                        answer = X[: len(X) - beyond] @ F_[0]
                        for k in range(1, w):
                            answer += X[k : len(X) - beyond + k] @ F_[k]
                        first = 0
                        for i, a, b in group:
                            some = answer[first : first + b - a]
                            top = some.argmax(0)
                            value = np.take_along_axis(some, top[None], 0)[0]
                            better = value > best[j][i]
                            best[j][i] = np.where(better, value, best[j][i])
                            place[j][i] = np.where(better, a + top, place[j][i])
                            first += b - a + beyond
                H = np.concatenate([x + c for x, c in zip(best, C)], 1)
                Z = np.maximum(H, 0)
                p = 1 / (1 + np.exp(-np.clip(Z @ V + B[0], -30, 30)))
                g = (p - y[own]) / len(own)
                G = [None, *(np.zeros_like(x) for x in W), *(np.zeros_like(x) for x in C), Z.T @ g, np.array([g.sum()], np.float32)]
                D = np.outer(g, V) * (H > 0)
                at_words, grads = [], []
                for j, (w, found) in enumerate(zip(WIDTHS, place)):
                    d = D[:, j * s.filters : (j + 1) * s.filters]
                    G[1 + len(W) + j] = d.sum(0)
                    for k in range(w):
                        here = np.stack([ids[i][f + k] for i, f in zip(own, found)])
                        at_words.append(here.ravel())
                        grads.append((j, k, d))
                every, where = np.unique(np.concatenate(at_words), return_inverse=True)
                n = starts[every + 1] - starts[every]
                X = means(E, flat[parts_at(every)], n)
                X[every == 0] = 0
                of_word = np.zeros_like(X)
                size = len(own) * s.filters
                for m, (j, k, d) in enumerate(grads):
                    here = where[m * size : (m + 1) * size]
                    G[1 + j][k] = np.einsum("df,dfe->ef", d, X[here].reshape(len(own), s.filters, s.size))
                    np.add.at(of_word, here, (d[:, :, None] * W[j][k].T[None]).reshape(-1, s.size))
                of_word[every == 0] = 0
                rows, where = np.unique(flat[parts_at(every)], return_inverse=True)
                G[0] = np.zeros((len(rows), s.size), np.float32)
                np.add.at(G[0], where, np.repeat(of_word / n[:, None], n, axis=0))
                step += 1
                for i, (p_, m, r, grad) in enumerate(zip(P, M, R, G)):
                    at_ = rows if i == 0 else slice(None)
                    m[at_] = 0.9 * m[at_] + 0.1 * grad
                    r[at_] = 0.99 * r[at_] + 0.01 * grad * grad
                    p_[at_] -= rate * (m[at_] / (1 - 0.9**step)) / (np.sqrt(r[at_] / (1 - 0.99**step)) + 1e-7)
    return Model(E, W, C, V, float(B[0])), seen.sum(0)


def fold(doc_id: str = "doc_id") -> Column:
    """The crc32 of the id as text modulo 3; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % 3


def known_labels(labels: DataFrame, folds: tuple[int, ...]) -> DataFrame:
    """Rows (doc_id, toxic) of labels (doc_id, toxic) in these folds: a document's label is the largest that it has."""
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold().isin(*folds))
    return own.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def sampled(docs: DataFrame, labels: DataFrame, folds: tuple[int, ...], settings: Settings) -> list[tuple[str, str | None, int]]:
    """(lang, text, label) of labelled docs (doc_id, lang, text) of these folds: settings.sample documents at most, for a
    look at them; train() takes all.

    Of several rows with an id the shortest text counts, of equally short ones that with the smallest hash.
    """
    known = known_labels(labels, folds)
    own = docs.select("doc_id", "lang", "text", F.coalesce(F.length("text"), F.lit(0)).alias("chars")).join(small_side(known), "doc_id")
    sizes = checkpointed(own.groupBy("doc_id").agg(F.min("chars").alias("chars")))
    n, chars = sizes.agg(F.count("*"), F.sum("chars")).first()
    if not n:
        return []
    share = min(1.0, 0.95 * settings.sample / n, 0.9 * settings.sample_chars / max(1, chars))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    chosen = sizes if share == 1 else sizes.where(drawn < share)
    if chosen.isEmpty():
        chosen = sizes.orderBy("chars", "doc_id").limit(1)
    own = own.join(small_side(chosen), ["doc_id", "chars"])
    rows = own.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", F.coalesce("lang", F.lit("")).alias("lang"), "toxic")).alias("r"))
    table = rows.select("doc_id", "r.lang", "r.text", "r.toxic").toArrow().sort_by("doc_id")  # settings.sample rows and sample_chars at most, about
    return [*zip(*(table.column(k).to_pylist() for k in (1, 2, 3)))]


def labelled(docs: DataFrame, labels: DataFrame, folds: tuple[int, ...]) -> DataFrame:
    """Rows (doc_id, lang, text, toxic) of all docs (doc_id, lang, text) that have a label of these folds.

    Of several rows with an id the shortest text counts, of equally short ones that with the smallest hash.
    """
    own = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text").join(small_side(known_labels(labels, folds)), "doc_id")
    one = F.min(F.struct(F.coalesce(F.length("text"), F.lit(0)).alias("chars"), F.xxhash64("text").alias("hash"), "text", "lang", "toxic")).alias("r")
    return own.groupBy("doc_id").agg(one).select("doc_id", "r.lang", "r.text", "r.toxic")


def rows_of(model: Model, seen: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, weights, rows) of a model of n texts: embeddings of buckets that texts have, weighted by how many do, and
    behind all buckets the other parameters."""
    size = model.E.shape[1]
    rest = np.concatenate([x.ravel() for x in (*model.W, *model.C, model.V, np.array([model.bias]))]).astype(np.float64)
    rest = np.pad(rest, (0, -len(rest) % size)).reshape(-1, size)
    at = np.flatnonzero(seen)
    numbers = np.concatenate([at, len(model.E) + np.arange(len(rest))])
    return numbers, np.concatenate([seen[at], np.full(len(rest), float(n))]), np.concatenate([model.E[at].astype(np.float64), rest])


def averaged(base: Model, numbers: np.ndarray, rows: np.ndarray) -> Model:
    """A model of rows of these numbers, see rows_of(); other buckets are those of base."""
    E = base.E.copy()
    own = numbers < len(E)
    E[numbers[own]] = rows[own]
    flat = rows[~own][np.argsort(numbers[~own])].ravel().astype(np.float32)
    out, at = [], 0
    for x in (*base.W, *base.C, base.V):
        out.append(flat[at : at + x.size].reshape(x.shape))
        at += x.size
    n = len(base.W)
    return Model(E, out[:n], out[n : 2 * n], out[-1], float(flat[at]))


def fit_all(own: DataFrame, settings: Settings) -> Model:
    """A model of all labelled documents own (doc_id, text, toxic): the average of models of its shards, in which a bucket
    counts by the documents that have it."""
    base = fit([], np.zeros(0), settings)  # where all shards begin
    n, chars, true = own.agg(F.count("*"), F.sum(F.length("text")), F.sum("toxic")).first()
    if not n:
        return base
    share = float(np.clip(true / n, 1e-3, 1 - 1e-3))
    base.E[:, 0] = np.clip(np.log(share / (true + 1)) - np.log((1 - share) / (n - true + 1)), -3, 3)  # as in fit(), of buckets that no text has
    shards = int(max(1, -(-n // max(1, settings.sample)), -(-(chars or 0) // max(1, settings.sample_chars))))
    ship(own.sparkSession)
    names = [f"v{k}" for k in range(settings.size)]

    def of_shard(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        model, seen = fitted(table.column("text").to_pylist(), np.array(table.column("toxic").to_pylist()), settings)
        numbers, weights, rows = rows_of(model, seen, table.num_rows)
        return pa.table([pa.array(numbers, pa.int64()), pa.array(weights, pa.float64()), *(pa.array(rows[:, k], pa.float64()) for k in range(settings.size))], ["number", "weight", *names])

    dealt = own.select("doc_id", "text", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))
    each = dealt.groupBy("shard").applyInArrow(of_shard, "number long, weight double, " + ", ".join(f"{v} double" for v in names))
    mean = each.groupBy("number").agg(*((F.sum(F.col("weight") * F.col(v)) / F.sum("weight")).alias(v) for v in names))
    table = mean.toArrow()  # its size depends on the settings alone
    return averaged(base, table.column("number").to_numpy(), np.stack([table.column(v).to_numpy() for v in names], 1))


def best_cut(scores: np.ndarray, labels: np.ndarray, weight: float = 1.0) -> float | None:
    """The score from which on calling label 1 has the best F score; null without both labels."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    if not 0 < y.sum() < len(y):
        return None
    true = np.cumsum(y)
    f = (1 + weight**2) * true / (np.arange(1, len(y) + 1) + weight**2 * y.sum())
    f[:-1][s[:-1] == s[1:]] = -1  # a cut lies between different scores
    k = int(np.argmax(f))
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else s[k])) / 2)


def best_cut_of(low: np.ndarray, high: np.ndarray, n: np.ndarray, true: np.ndarray, weight: float = 1.0) -> float | None:
    """The score from which on calling label 1 has the best F score; null without both labels. Scores come in groups, each
    with its lowest and highest, how many it has, and how many of these have label 1."""
    order = np.argsort(-low, kind="stable")
    low, high, n, true = low[order], high[order], n[order], true[order]
    if not 0 < true.sum() < n.sum():
        return None
    f = (1 + weight**2) * np.cumsum(true) / (np.cumsum(n) + weight**2 * true.sum())
    k = int(np.argmax(f))
    return float((low[k] + (high[k + 1] if k + 1 < len(low) else low[k])) / 2)


def logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), cut: float = 0.7) -> tuple[Model, dict[str, float]]:
    """A model of docs (doc_id, lang, text) with labels (doc_id, toxic), and a threshold for each language.

    Fold 0 trains it. Fold 2 calibrates: the bias is set so that `cut` is the best threshold over all languages, and
    each language with both labels gets its own. Either takes all labelled documents.
    """
    model = fit_all(checkpointed(labelled(docs, labels, (0,))), settings)
    held = checkpointed(labelled(docs, labels, (2,)))
    # Scores whose logits agree to three places are one group: there are 28,000 at most in a language.
    p = F.least(F.greatest("score", F.lit(1e-6)), F.lit(1 - 1e-6))  # scores may be 0 or 1
    group = F.round(F.log(p / (1 - p)), 3).alias("group")
    told = scores(held, model).join(held.select("doc_id", "toxic"), "doc_id").groupBy("lang", group)
    table = told.agg(F.min("score"), F.max("score"), F.count("*"), F.sum("toxic")).drop("group").toArrow()
    langs = np.array(table.column(0).to_pylist(), object)
    counted = [table.column(k).to_numpy().astype(np.float64) for k in range(1, 5)]
    within = lambda p: min(max(p, 1e-6), 1 - 1e-6)
    every: dict[float, list[float]] = {}  # a group of all languages
    for low, high, n, true in zip(*counted):
        g = every.setdefault(round(logit(within(low)), 3), [low, high, 0, 0])
        g[:] = min(g[0], low), max(g[1], high), g[2] + n, g[3] + true
    best = best_cut_of(*np.array([*every.values()]).T) if every else None
    if best is None:
        return model, {}
    shift = logit(cut) - logit(within(best))
    model.bias += shift
    found = {}
    for lang in sorted(set(langs)):
        if (limit := best_cut_of(*(x[langs == lang] for x in counted))) is not None:
            found[lang] = float(1 / (1 + np.exp(-logit(within(limit)) - shift)))
    return model, found


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, lang, text) as rows (doc_id, lang, score), one for each; null and blank texts have the score of no words."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on the settings alone

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                out = [*score.of_all(part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.float64())], ["doc_id", "lang", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "lang", "text").mapInArrow(scored, f"doc_id {kind}, lang string, score double")


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), cut: float = 0.7) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, flagged) for each row of docs (doc_id, lang, text).

    Labels (doc_id, toxic) of fold 1 are never used; fold 0 trains, fold 2 calibrates the language's threshold, which
    decides flagged; predicted is 1 from `cut` on for all languages. Null and blank texts are scored as no words, a
    null language is one of its own, languages without labels take `cut`; null ids are not held out; repeated rows are
    scored one by one; an empty table gives no rows; without labels all scores are low. Further columns are left out.
    """
    model, limits = train(docs, labels, settings, cut)
    scored = scores(docs, model)
    limit = F.lit(cut)
    for lang, x in limits.items():
        limit = F.when(F.coalesce("lang", F.lit("")) == lang, F.lit(x)).otherwise(limit)
    held_out = F.coalesce(fold() == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= cut).cast("int").alias("predicted"), (F.col("score") >= limit).alias("flagged"))

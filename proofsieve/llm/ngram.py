"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

Each language has its own model. Tasks count the n-grams of highest order in their share of the trusted text, Spark
sums them, and everything else is joined from that table: lower orders count different left neighbours, contexts sum
their continuations, discounts come from counts of counts. All that predicts a character shares the two characters
before it; the finished tables are sharded by a hash of those two, in as many shards of bounded size as it takes. Each
shard is joined with the documents in one pass, which adds up the log-probabilities of the places that are its own;
the sums over shards give the perplexity. A part of the trusted texts is held out of training: quantiles of their
perplexities set the threshold of a language, whatever junk the other documents are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsieve.session import checkpointed, ship, small_side

#: Length of the longest n-grams, in characters; train() spells its orders out.
ORDER = 5
#: Rows of a shard, about 20 bytes each.
SHARD_ROWS = 4_000_000
SLICE = 64
#: Different n-grams that a task holds before it hands them on, and letters that its codes can tell apart.
HELD, LETTERS = 3_000_000, 4096
ODD = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0x100000001B3)


@dataclass(frozen=True)
class Fence:
    """A document is rejected if its log-perplexity lies above the quantile `middle` of its language's trusted texts that
    training didn't see, one in `held_out`, by more than `factor` times the distance from there to their quantile
    `upper`, and `slack` over the square root of its length besides: the perplexity of short texts says little."""

    held_out: int = 5
    middle: float = 0.5
    upper: float = 0.75
    factor: float = 4.0
    slack: float = 1.0
    accuracy: int = 10_000


def code_points(text: str) -> np.ndarray:
    """Code points of the text as it is modelled: runs of ASCII white space are one space, digits are 0, the text
    stands between ORDER - 1 spaces and one."""
    joined = " " * (ORDER - 1) + " ".join(text.split()) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[(points >= 48) & (points <= 57)] = 48
    points[points == 0] = 0xFFFD
    return points


def _top_grams(docs: DataFrame) -> DataFrame:
    """Rows (lang, gram, n): n-grams of highest order in docs (lang, text) with their counts in each task."""
    ship(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        ids = np.full(0x110000, -1, np.int64)
        chars: list[int] = []

        def pack(lang: str) -> None:
            rows = np.concatenate(waiting.pop(lang))
            codes, n = np.unique(rows, return_counts=True)
            held.setdefault(lang, []).append((codes, n))
            if len(held[lang]) >= 16:
                squeeze(lang)

        def squeeze(lang: str) -> None:
            codes = np.concatenate([c for c, _ in held[lang]])
            n = np.concatenate([k for _, k in held[lang]])
            codes, where = np.unique(codes, return_inverse=True)
            held[lang] = [(codes, np.bincount(where, n).astype(np.int64))]

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang in [*waiting]:
                pack(lang)
            table = np.array(chars, np.uint32)
            for lang in [*held]:
                squeeze(lang)
                ((codes, n),) = held.pop(lang)
                for k in range(0, len(codes), 50_000):
                    part = codes[k : k + 50_000]
                    points = np.stack([table[part >> (12 * j) & 4095] for j in range(ORDER - 1, -1, -1)], 1)
                    grams = np.ascontiguousarray(points).view(f"<U{ORDER}").ravel()
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(part), pa.string()), "gram": pa.array(grams.tolist(), pa.string()), "n": pa.array(n[k : k + 50_000], pa.int64())})
            chars.clear()
            ids[:] = -1

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                points = code_points(text)
                # A text of more letters than codes tell apart is counted in stretches that have no more of them.
                step = len(points) if len(np.unique(points)) <= LETTERS else LETTERS - ORDER
                for start in range(0, len(points) - ORDER + 1, step):
                    some = points[start : start + step + ORDER - 1]
                    new = np.unique(some[ids[some] < 0])
                    if len(chars) + len(new) > LETTERS:
                        yield from flushed()
                        new = np.unique(some)
                    ids[new] = np.arange(len(chars), len(chars) + len(new))
                    chars.extend(new.tolist())
                    dense = ids[some]
                    codes = dense[ORDER - 1 :].copy()
                    for j in range(1, ORDER):
                        codes |= dense[ORDER - 1 - j : -j] << (12 * j)
                    own = waiting.setdefault(lang or "", [])
                    own.append(codes)
                    if sum(map(len, own)) > 1_000_000:
                        pack(lang or "")
            if sum(len(c) for x in held.values() for c, _ in x) > HELD:
                yield from flushed()
        yield from flushed()

    return docs.select("lang", "text").mapInArrow(counted, "lang string, gram string, n long")


def _discount(n: list[Column], k: int) -> Column:
    """The modified Kneser-Ney discount of counts of k, 3 standing for all from there on; n[j] things have count j."""
    y = F.try_divide(n[1], n[1] + 2 * n[2])
    own = k - (k + 1) * y * F.try_divide(n[k + 1], F.when(n[k] > 0, n[k]))
    own = F.when((n[1] > 0) & (n[2] > 0) & (n[k] > 0) & (n[k + 1] > 0), own)
    return F.least(F.lit(float(k)), F.greatest(F.lit(0.0), F.coalesce(own, F.lit(k / 2))))


def _estimate(df: DataFrame, k: int, count: str, copies: Column, keys: list[str], discounts: DataFrame) -> DataFrame:
    """Adds kept{k} and b{k}, the discounted share of a k-gram and the weight of the shorter context.

    df has a row, or `copies` of them, for each k-gram with the column `count`; all of a context are found by keys.
    """
    here = Window.partitionBy(*keys)
    once = 1 / copies
    total = F.sum(F.col(count) * once).over(here)
    some = lambda c: F.sum(F.when(c, once).otherwise(0.0)).over(here)
    c = F.col(count)
    lost = sum((F.col(f"d{j}") * some((c == j) if j < 3 else (c >= 3)) for j in (1, 2, 3)), F.lit(0.0))
    d = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
    own = discounts.where(F.col("k") == k).select("lang", "d1", "d2", "d3")
    out = df.join(F.broadcast(own), "lang")  # a row for each language
    kinds = [F.sum(once).over(here).alias("kinds")] if k == 1 else []
    return out.select(*df.columns, (F.greatest(F.lit(0.0), c - d) / total).alias(f"kept{k}"), (lost / total).alias(f"b{k}"), *kinds)


def train(trusted: DataFrame) -> DataFrame:
    """Rows (lang, k, gram, logp, logb) of the model of trusted (lang, text).

    For k from 1 to ORDER, logp is the log-probability of the last character after those before it; rows with logb have
    the weight of the shorter context of the gram as a context, and no logp. k = 0 has one row per language with the
    log-probability of characters that it hasn't seen. The n-grams of the two highest orders are dealt out once, by
    language and the three characters before the last, which all that they are compared with shares; there are no more
    of a key than the alphabet has pairs. Lower orders are sums over these, of a few rows for each key.
    """
    spare = int(trusted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = _top_grams(trusted).withColumn("x4", F.substring("gram", ORDER - 3, 3)).repartition(spare, "lang", "x4")
    rows = top.groupBy("lang", "x4", "gram").agg(F.sum("n").alias("c5"))
    rows = rows.select("*", F.substring("gram", ORDER - 3, 4).alias("g4"), F.substring("gram", 1, ORDER - 1).alias("x5"))
    rows = checkpointed(rows.withColumn("c4", F.count("*").over(Window.partitionBy("lang", "x4", "g4"))))
    threes = checkpointed(rows.groupBy("lang", "x4", "g4").agg(F.lit(1).alias("one")).groupBy("lang", F.substring("g4", 2, 3).alias("g3")).agg(F.count("*").alias("c3")))
    pairs = checkpointed(threes.groupBy("lang", F.substring("g3", 2, 2).alias("g2")).agg(F.count("*").alias("c2")))
    single = checkpointed(pairs.groupBy("lang", F.substring("g2", 2, 1).alias("g1")).agg(F.count("*").alias("c1")))
    found = None
    for k, df, count, copies in ((5, rows, "c5", F.lit(1.0)), (4, rows, "c4", F.col("c4")), (3, threes, "c3", F.lit(1.0)), (2, pairs, "c2", F.lit(1.0)), (1, single, "c1", F.lit(1.0))):
        n = [F.round(F.sum(F.when(F.col(count) == j, 1 / copies).otherwise(0.0))) for j in range(5)]
        own = df.groupBy("lang").agg(*(_discount(n, j).alias(f"d{j}") for j in (1, 2, 3))).withColumn("k", F.lit(k))
        found = own if found is None else found.unionByName(own)
    discounts = checkpointed(found)
    one = checkpointed(_estimate(single, 1, "c1", F.lit(1.0), ["lang"], discounts).withColumn("p1", F.col("kept1") + F.col("b1") / (F.col("kinds") + 1)))
    two = _estimate(pairs.withColumn("x2", F.substring("g2", 1, 1)).withColumn("g1", F.substring("g2", 2, 1)), 2, "c2", F.lit(1.0), ["lang", "x2"], discounts)
    two = checkpointed(two.join(small_side(one.select("lang", "g1", "p1")), ["lang", "g1"]).withColumn("p2", F.col("kept2") + F.col("b2") * F.col("p1")))
    three = _estimate(threes.withColumn("x3", F.substring("g3", 1, 2)).withColumn("g2", F.substring("g3", 2, 2)), 3, "c3", F.lit(1.0), ["lang", "x3"], discounts)
    three = checkpointed(three.join(small_side(two.select("lang", "g2", "p2")), ["lang", "g2"]).withColumn("p3", F.col("kept3") + F.col("b3") * F.col("p2")))
    rows = _estimate(rows, 5, "c5", F.lit(1.0), ["lang", "x4", "x5"], discounts)
    rows = _estimate(rows, 4, "c4", F.col("c4"), ["lang", "x4"], discounts)
    rows = rows.withColumn("g3", F.substring("g4", 2, 3)).join(small_side(three.select("lang", "g3", "p3")), ["lang", "g3"])
    rows = rows.withColumn("p4", F.col("kept4") + F.col("b4") * F.col("p3")).withColumn("p5", F.col("kept5") + F.col("b5") * F.col("p4"))
    least, none = F.lit(1e-9), F.lit(None).cast("double")
    p = lambda k, gram, x: F.struct(F.lit(k).alias("k"), F.col(gram).alias("gram"), F.log(x).alias("logp"), none.alias("logb"))
    b = lambda k, gram, x: F.struct(F.lit(k).alias("k"), F.col(gram).alias("gram"), none.alias("logp"), F.log(F.greatest(F.col(x), least)).alias("logb"))
    entries = F.explode(F.array(p(5, "gram", "p5"), p(4, "g4", "p4"), b(4, "x5", "b5"), b(3, "x4", "b4")))
    wide = rows.select("lang", "x4", entries.alias("e")).groupBy("lang", "x4", "e.k", "e.gram", F.col("e.logb").isNull()).agg(F.max("e.logp").alias("logp"), F.max("e.logb").alias("logb"))
    narrow = three.select("lang", p(3, "g3", "p3").alias("e")).unionByName(three.select("lang", b(2, "x3", "b3").alias("e")).distinct())
    narrow = narrow.unionByName(two.select("lang", p(2, "g2", "p2").alias("e"))).unionByName(two.select("lang", b(1, "x2", "b2").alias("e")).distinct()).unionByName(one.select("lang", p(1, "g1", "p1").alias("e")))
    unseen = one.groupBy("lang").agg(F.max(F.log(F.greatest(F.col("b1"), least) / (F.col("kinds") + 1))).alias("logp")).select("lang", F.lit(0).alias("k"), F.lit("").alias("gram"), "logp", none.alias("logb"))
    columns = ["lang", "k", "gram", "logp", "logb"]
    return wide.select(columns).unionByName(narrow.select("lang", "e.*").select(columns)).unionByName(unseen.select(columns))


def _salt(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 7) | 1)


def codes(points: np.ndarray, lang: str) -> list[np.ndarray]:
    """For k from 1 to ORDER, the 64-bit codes of the k-grams that end at each place from ORDER - 1 on."""
    salt, n = _salt(lang), len(points) - ORDER + 1
    wide = points.astype(np.uint64) + np.uint64(1)
    out = []
    with np.errstate(over="ignore"):
        for k in range(1, ORDER + 1):
            code = np.zeros(n, np.uint64)
            for j in range(k):
                at = ORDER - k + j
                code = code * STEP + wide[at : at + n]
            out.append((code + np.uint64(k)) * salt * ODD | np.uint64(1))
    return out


class Lookup:
    """Numbers by 64-bit keys other than zero: open addressing in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float32)
        left, slots = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slots] == 0
            self.keys[slots[free]] = keys[left[free]]  # of several at a slot the last stays
            placed = free & (self.keys[slots] == keys[left])
            self.values[slots[placed]] = values[left[placed]]
            left, slots = left[~placed], slots[~placed] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * ODD) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values, NaN for keys that are not there."""
        out = np.full(len(keys), np.nan, np.float32)
        left, slots = np.arange(len(keys)), self._slot(keys)
        while len(left):
            there = self.keys[slots]
            same = there == keys[left]
            out[left[same]] = self.values[slots[same]]
            go = ~same & (there != 0)
            left, slots = left[go], slots[go] + 1 & self.mask
        return out


def _shard_of(points: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each place from ORDER - 1 on: by the two characters before it."""
    a, b = points[ORDER - 3 : -2].astype(np.uint64), points[ORDER - 2 : -1].astype(np.uint64)
    with np.errstate(over="ignore"):
        return (((a * STEP + b) * ODD) >> np.uint64(40)) % np.uint64(shards)


def _with_keys(model: DataFrame, shards: int) -> DataFrame:
    """Rows (shard, kind, key, value): kind 0 log-probabilities, 1 weights; shard -1 is for all: what has fewer than two characters of context."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, float]] = []
            groups: dict[tuple[str, int], list[tuple[str, float | None, float | None]]] = {}
            for lang, k, gram, logp, logb in zip(*(batch.column(c).to_pylist() for c in range(5))):
                groups.setdefault((lang, k), []).append((gram, logp, logb))
            for (lang, k), members in groups.items():
                if k == 0:
                    with np.errstate(over="ignore"):
                        rows += [(-1, 0, int((_salt(lang) * ODD | np.uint64(1)).view(np.int64)), p) for _, p, _ in members]
                    continue
                points = np.array([[*map(ord, g)] for g, _, _ in members], np.uint32)
                padded = np.concatenate([np.zeros((len(points), ORDER - k), np.uint32), points], 1)
                flat = _codes_of(padded, k, lang)
                for kind, two in ((0, padded[:, -3:-1]), (1, padded[:, -2:])):
                    with np.errstate(over="ignore"):
                        shard = ((two[:, 0].astype(np.uint64) * STEP + two[:, 1].astype(np.uint64)) * ODD >> np.uint64(40)) % np.uint64(shards)
                    everywhere = k < 3 if kind == 0 else k < 2
                    rows += [(-1 if everywhere else int(s), kind, int(c), m[1 + kind]) for m, s, c in zip(members, shard, flat.view(np.int64)) if m[1 + kind] is not None]
            columns = [*zip(*rows)] or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.float32()))], ["shard", "kind", "key", "value"])

    return model.select("lang", "k", "gram", "logp", "logb").mapInArrow(keyed, "shard int, kind int, key long, value float")


def _codes_of(padded: np.ndarray, k: int, lang: str) -> np.ndarray:
    wide = padded.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        code = np.zeros(len(padded), np.uint64)
        for j in range(k):
            code = code * STEP + wide[:, ORDER - k + j]
        return (code + np.uint64(k)) * _salt(lang) * ODD | np.uint64(1)


def log_likelihoods(points: np.ndarray, lang: str, p: Lookup, b: Lookup, unseen: float) -> np.ndarray:
    """The log-probability of the character at each place from ORDER - 1 on, after those before it."""
    own = codes(points, lang)
    before = codes(np.concatenate([points[:1], points[:-1]]), lang)
    total = p(own[ORDER - 1])
    left = np.flatnonzero(np.isnan(total))
    weight = np.zeros(len(left), np.float32)
    for k in range(ORDER - 1, -1, -1):
        if not len(left):
            break
        if k:
            found = b(before[k - 1][left])
            weight = weight + np.where(np.isnan(found), 0, found)
            value = p(own[k - 1][left])
        else:
            value = np.full(len(left), unseen, np.float32)
        hit = ~np.isnan(value)
        total[left[hit]] = weight[hit] + value[hit]
        left, weight = left[~hit], weight[~hit]
    return total


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """Rows (rid, log_sum, places) for each row of docs (rid, lang, text), summed over all shards of the model.

    Rows that share a rid have the same language and text; each of them comes out. log_sum is null for null and blank
    texts and for languages that the model hasn't got.
    """
    spark = docs.sparkSession
    ship(spark)
    shards = 1 + model.count() // SHARD_ROWS
    while True:
        table = checkpointed(_with_keys(model, shards))
        sizes = {r.shard: r["count"] for r in table.groupBy("shard").count().collect()}
        most = max([n for s, n in sizes.items() if s >= 0], default=0)
        if most <= 2 * SHARD_ROWS or shards >= 4096:
            break
        shards *= 2
    langs = {r.lang: r.logp for r in model.where("k = 0").select("lang", "logp").collect()}
    out = None
    for s in range(shards):
        own = table.where(F.col("shard").isin(-1, s)).select("kind", "key", "value").toArrow()
        kind, key, value = (own.column(c).to_numpy() for c in range(3))
        shared = spark.sparkContext.broadcast((langs, *((key[kind == k].view(np.uint64), value[kind == k]) for k in (0, 1))))

        def scored(batches: Iterator[pa.RecordBatch], s=s, shared=shared) -> Iterator[pa.RecordBatch]:
            known, (pk, pv), (bk, bv) = shared.value
            p, b = Lookup(pk, pv), Lookup(bk, bv)
            for batch in batches:
                sums: list[float | None] = []
                places: list[int] = []
                for lang, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    lang = lang or ""
                    points = code_points(text or "")
                    places.append(len(points) - ORDER + 1 if text and not text.isspace() else 0)
                    if lang not in known or not places[-1]:
                        sums.append(None)
                        continue
                    total = 0.0
                    for k in range(0, len(points) - ORDER + 1, 1 << 20):
                        part = points[k : k + (1 << 20) + ORDER - 1]
                        each = log_likelihoods(part, lang, p, b, known[lang])
                        total += float((each if shards == 1 else each[_shard_of(part, shards) == s]).sum(dtype=np.float64))
                    sums.append(total)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.float64()), pa.array(places, pa.int64())], ["rid", "log_sum", "places"])

        found = docs.select("rid", "lang", "text").mapInArrow(scored, "rid string, log_sum double, places long")
        if shards == 1:
            return found
        found = found.withColumn("shard", F.lit(s))
        out = found if out is None else out.unionByName(found)
    passes = checkpointed(out)
    # Each row is in every pass once, so that a rid's rows are its count over the shards, and all have the same sum.
    sums = passes.groupBy("rid").agg((F.sum("log_sum") * shards / F.count("*")).alias("log_sum"))
    return passes.where("shard = 0").select("rid", "places").join(sums, "rid").select("rid", "log_sum", "places")


def classify(docs: DataFrame, labels: DataFrame, fence: Fence = Fence()) -> DataFrame:
    """Rows (doc_id, lang, perplexity, threshold, kept) for each row of docs (doc_id, lang, text).

    Trusted text is that of documents whose labels (doc_id, quality) all say 1; a part of the texts, by their hashes, is
    not trained on and sets the language's threshold. Perplexity is per character. Null and blank texts have no
    perplexity and are not kept; a language without trusted text has no model, one without such text held out no
    threshold: nothing speaks against its documents; a null language is a language of its own. Repeated rows are scored
    one by one, an empty table gives no rows, further columns are left out.
    """
    trusted = small_side(labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("least")).where("least = 1").select("doc_id"))
    held = lambda h: F.pmod(h, F.lit(fence.held_out)) == 0
    model = checkpointed(train(docs.select("doc_id", "lang", "text").where(~held(F.xxhash64("text"))).join(trusted, "doc_id", "left_semi")))
    rows = docs.select(F.to_json(F.struct(F.col("doc_id").cast("long").alias("d"), F.coalesce("lang", F.lit("")).alias("l"), F.xxhash64("text").alias("h"))).alias("rid"), "lang", "text")
    sums = score(rows, model).select(F.from_json("rid", "d long, l string, h long").alias("r"), "log_sum", "places")
    scored = checkpointed(sums.select(F.col("r.d").alias("doc_id"), F.col("r.l").alias("lang"), F.col("r.h").alias("hash"), (-F.col("log_sum") / F.greatest("places", F.lit(1))).alias("x"), "places"))
    apart = scored.where("x IS NOT NULL").where(held(F.col("hash"))).join(trusted, "doc_id", "left_semi").groupBy("lang", "hash").agg(F.min("x").alias("x"))  # each text once
    q = apart.groupBy("lang").agg(F.percentile_approx("x", [fence.middle, fence.upper], fence.accuracy).alias("q"))
    limits = q.select("lang", (F.col("q")[0] + fence.factor * (F.col("q")[1] - F.col("q")[0])).alias("high"))
    joined = scored.join(F.broadcast(limits), "lang", "left")  # a row for each language
    high = F.col("high") + fence.slack / F.sqrt(F.greatest("places", F.lit(1)))
    kept = F.when(F.col("places") > 0, F.coalesce(F.col("x") <= high, F.lit(True))).otherwise(False)
    return joined.select("doc_id", "lang", F.exp("x").alias("perplexity"), F.exp(high).alias("threshold"), kept.alias("kept"))

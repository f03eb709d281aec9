"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints of 64 bits link at up to three differing bits. Two that link differ in at most one bit in one of their
halves of 32 bits, so each half is searched for pairs within one bit. The anchors of a half are the code words of the
perfect Hamming code of length 31 (the last bit of the half is left out, which can only bring pairs closer): its
covering radius is one, so each fingerprint has one home anchor within one bit. A fingerprint is replicated to every
anchor within covering radius plus threshold, two bits: 1 or 16 anchors. If x and y are within one bit, y is at the home
of x. At each anchor those that are at home are compared with all that came, so that no link is lost, and a rule
says which half reports a pair, so that no link comes twice. Equal fingerprints are one fingerprint throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsieve.llm.common import components
from proofsieve.session import checkpointed, ship, small_side

LENGTH = 31
SEED = 42
THRESHOLD = 3


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit number; zero if the text is null or has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: both only know ASCII
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [*accumulate(len(w) + 1 for w in words)]
    starts = [0, *ends]
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        hashes = [xxhash.xxh64_intdigest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[shingle - 1 :])]
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        part = np.array(hashes[k : k + 65536], np.uint64)
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, fp) for each row of docs (doc_id, text)."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return docs.select("doc_id", of("text").alias("fp"))


def _syndrome(half: Column) -> Column:
    """XOR of the places (1 to 31) of the bits set: zero for code words, else the place of the wrong bit."""
    bits = [F.bit_count(half.bitwiseAND(F.lit(sum(1 << (p - 1) for p in range(1, LENGTH + 1) if p >> j & 1)))) % 2 * (1 << j) for j in range(5)]
    return sum(bits[1:], bits[0])


def _flips() -> list[list[int]]:
    """For each syndrome, the changes that lead to the code words within two bits, the home anchor first."""
    bit = lambda p: 1 << (p - 1)
    return [[0], *([bit(s), *(bit(p) | bit(p ^ s) for p in range(1, LENGTH + 1) if p < p ^ s)] for s in range(1, LENGTH + 1))]


def links(fps: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, of different fingerprints in column fp (without repeats) at up to three bits, each once."""
    low = (1 << LENGTH) - 1
    halves = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.shiftrightunsigned("fp", 32 * k).bitwiseAND(F.lit(low)).alias("half")) for k in (0, 1))))
    split = fps.select("fp", halves.alias("h")).select("fp", "h.side", "h.half", _syndrome(F.col("h.half")).cast("int").alias("s"))
    anchor = lambda flip: F.col("half").bitwiseXOR(flip) * 2 + F.col("side")
    flips = F.array(*(F.array(*(F.lit(x).cast("long") for x in row)) for row in _flips()))
    near = split.select("fp", "side", "half", F.explode(F.element_at(flips, F.col("s") + 1)).alias("flip")).select(anchor(F.col("flip")).alias("anchor"), F.col("fp").alias("b"))
    own = split.select(anchor(F.element_at(F.element_at(flips, F.col("s") + 1), 1)).alias("anchor"), F.col("fp").alias("a"))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    first = F.bit_count(apart.bitwiseAND(F.lit(low)))
    once = F.when(F.col("o.anchor") % 2 == 0, first <= 1).otherwise(first >= 2)
    return own.alias("o").join(near.alias("n"), (F.col("o.anchor") == F.col("n.anchor")) & (F.col("a") < F.col("b")) & (F.bit_count(apart) <= THRESHOLD) & once).select("a", "b")


def _least(own: DataFrame, value: Column) -> DataFrame:
    """Rows (fp, least): for each fingerprint of own the smallest `value` of the rows of its component."""
    distinct = checkpointed(own.groupBy("fp").agg(F.min(value).alias("least")))
    joined = components(links(distinct.select("fp")))
    class_of = joined.join(distinct.withColumnRenamed("fp", "node"), "node").select(F.col("node").alias("fp"), "component", "least")
    least = class_of.groupBy("component").agg(F.min("least").alias("id"))
    moved = class_of.join(least, "component").select("fp", "id")
    return distinct.join(moved, "fp", "left").select("fp", F.coalesce("id", "least").alias("least"))


def groups(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id) for each row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over links, the row's own included; null only if no row of the
    component has a doc_id. Null and blank texts have fingerprint zero and link like any other; repeated rows come
    out as often as they come in; an empty table gives no rows.
    """
    own = checkpointed(fingerprints(docs))
    ids = _least(own, F.col("doc_id")).withColumnRenamed("least", "component_id")
    return own.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest doc_id stays, once.

    Rows count each for itself, also those with one doc_id; rows without doc_id come last, and one of them stays where
    a component has no others. All columns stay.
    """
    rows = checkpointed(docs.withColumn("_row", F.monotonically_increasing_id()))
    own = checkpointed(fingerprints(rows.select(F.struct("doc_id", "_row").alias("doc_id"), "text")).select("fp", "doc_id.doc_id", "doc_id._row"))
    first = _least(own, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    lost = checkpointed(own.join(first, "fp").where(F.col("_row") != F.col("least._row")).select("_row"))
    return rows.join(small_side(lost), "_row", "left_anti").select(docs.columns)

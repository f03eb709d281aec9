"""Personal data: patterns for what is protected, and information theory for what reveals it.

Four patterns find e-mail addresses, IP addresses, card and phone numbers. Each is a protected entity. Terms that stand
near an entity may give it away: over the whole corpus, a term t with document frequency f(t) that stands near an
entity e in f(t, e) texts tells log2(N f(t, e) / (f(t) f(e))) bits about it, of the log2(N / f(e)) that
there are. Terms that tell more than a share of them are generalised or removed where they stand near the entity.
Where a term and an entity share few contexts, the share is higher: of an entity that is seen once, only terms that
hardly any other text has say who it is, such as names, codes and numbers of other kinds.
All frequencies, and N, count different texts, so that copies of a text count once; contexts are compared by their words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsieve.session import checkpointed, ship, small_side

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# All of these take time in proportion to the text: what has failed from the first digit of a run fails from the others.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]{3,}")
#: Slots of the filter that candidate terms pass; one bit each.
SLOTS = 1 << 22
SLICE = 256


@dataclass(frozen=True)
class Disclosure:
    """window: characters on either side of an entity that are its context; share: of the entity's information that a
    term may tell if they have `contexts` different contexts or more in common; rare: the same for fewer contexts."""

    window: int = 60
    share: float = 0.6
    contexts: int = 3
    rare: float = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Places of addresses: what is allowed before an at sign, back to the end of the last address, and a domain."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind in the order of KINDS and then by start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def contexts_of(text: str, window: int) -> Iterator[tuple[str, int, list[tuple[str, int, int]]]]:
    """For each entity its name, a hash of its context, and the terms near it that no pattern covers."""
    spans = base_spans(text)
    covered = sorted((a, b) for _, a, b in spans)
    for kind, a, b in spans:
        name = kind + ":" + (text[a:b].lower() if kind in ("email", "ip") else "".join(c for c in text[a:b] if c.isdigit()))
        low, high = max(0, a - window), min(len(text), b + window)
        terms = []
        for start, end in ((low, a), (b, high)):
            for m in TERM.finditer(text, start, end):
                cut = (m.start() == low > 0 and text[low - 1].isalnum()) or (m.end() == high < len(text) and text[high].isalnum())
                if not cut and not any(s < m.end() and m.start() < e for s, e in covered):
                    terms.append((m[0].lower(), m.start(), m.end()))
        yield name, xxhash.xxh64_intdigest(" ".join([name, *(t for t, _, _ in terms)]).encode("utf-8", "surrogatepass")) >> 1, terms


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells documents apart: id and text. Rows that are equal in both have equal spans."""
    return F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.xxhash64(text).cast("string"), F.lit("")))


def slot_of(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), 9) % SLOTS


def disclosing(docs: DataFrame, near: DataFrame, limits: Disclosure) -> DataFrame:
    """Rows (entity, term) of near (key, entity, context, term, ...): what reveals what in docs (text)."""
    spark = docs.sparkSession
    near = near.withColumn("copy", F.substring_index("key", ":", -1))  # the text's hash
    contexts = near.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("copy").alias("both"))
    pairs = checkpointed(contexts.select("entity", "term", "both", F.when(F.col("contexts") >= limits.contexts, limits.share).otherwise(limits.rare).alias("share")))
    slots = pairs.select("term").distinct().mapInArrow(_slots, "slot int")
    word = F.shiftright("slot", 5).alias("word")
    filled = slots.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, slot % 32)")).alias("bits")).toArrow()  # SLOTS / 32 rows at most
    if not filled.num_rows:
        return pairs.select("entity", "term")
    words = np.zeros(SLOTS // 32, "<u4")
    words[filled.column(0).to_numpy()] = filled.column(1).to_numpy()
    shared = spark.sparkContext.broadcast(words.view(np.uint8))  # SLOTS bits, whatever the corpus

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = np.unpackbits(shared.value, bitorder="little")
        known: dict[str, bool] = {}
        seen: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"term": pa.array([*seen], pa.string()), "n": pa.array([*seen.values()], pa.float64())})
            seen.clear()
            return out

        for batch in batches:
            for text, copies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set(TERM.findall((text or "").lower()))
                if len(known) > 400_000:
                    known.clear()
                for w in own:
                    if w not in known:
                        known[w] = bool(passed[slot_of(w)])
                    if known[w]:
                        seen[w] += 1 / (copies or 1)
            if len(seen) > 200_000:
                yield flushed()
        yield flushed()

    hashed = docs.select("text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("hash"))
    copies = checkpointed(hashed.groupBy("hash").agg(F.count("*").alias("copies")))
    total = copies.count()
    each = hashed.join(small_side(copies.where("copies > 1")), "hash", "left").select("text", "copies")
    terms = each.mapInArrow(counted, "term string, n double").groupBy("term").agg(F.round(F.sum("n")).alias("of_term"))
    entities = near.groupBy("entity").agg(F.count_distinct("copy").alias("of_entity"))
    tells = F.log2(total * F.col("both") / (F.col("of_term") * F.col("of_entity")))
    there = F.log2(total / F.col("of_entity"))
    return checkpointed(pairs.join(terms, "term").join(entities, "entity").where((there > 0) & (tells >= F.col("share") * there)).select("entity", "term"))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"slot": pa.array([slot_of(t) for t in batch.column(0).to_pylist()], pa.int32())})


def term_spans(docs: DataFrame, limits: Disclosure = Disclosure()) -> DataFrame:
    """Rows (key, terms array<struct<start int, end int>>) of docs (doc_id, text) in which terms reveal entities."""
    ship(docs.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                rows = [(key, name, context, *t) for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for name, context, terms in contexts_of(text or "", limits.window) for t in terms]
                columns = [*zip(*rows)] or [[]] * 6
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "entity", "context", "term", "start", "end"])

    near = checkpointed(docs.select(row_key().alias("key"), "text").mapInArrow(found, "key string, entity string, context long, term string, start int, end int"))
    spans = near.join(small_side(disclosing(docs, near, limits)), ["entity", "term"])
    return checkpointed(spans.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("terms")))


def find(docs: DataFrame, limits: Disclosure = Disclosure()) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of docs (doc_id, text).

    spans: kind:start:end of all spans, by kind in the order of KINDS and then by start, joined by commas; start and
    end count code points. A null text is an empty one, without spans; repeated rows come out one by one; rows without
    doc_id have a null one; an empty table gives no rows; further columns are left out.
    """
    terms = term_spans(docs, limits)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def based(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                each = [base_spans(t or "") for t in part.column(2).to_pylist()]
                counts = [[sum(s[0] == kind for s in spans) for spans in each] for kind in KINDS[:4]]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array([joined(s) for s in each], pa.string())], ["key", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base"])

    based_ = docs.select(row_key().alias("key"), "doc_id", "text").mapInArrow(based, f"key string, doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string")
    extra = F.array_join(F.transform("terms", lambda t: F.concat(F.lit("term:"), t["start"].cast("string"), F.lit(":"), t["end"].cast("string"))), ",")
    both = based_.join(small_side(terms), "key", "left")
    return both.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif(extra, F.lit(""))).alias("spans"))


def cleaned(text: str | None, terms: list[tuple[int, int]]) -> str | None:
    """The text with each entity replaced by its kind, revealing numbers and capitalised terms by what they are, and
    other revealing terms removed; of spans that overlap the first kind counts for all."""
    if not text:
        return text
    spans = [(a, b, f"[{k.upper()}]") for k, a, b in base_spans(text)]
    for a, b in terms:
        word = text[a:b]
        spans.append((a, b, "[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[:1].isupper() else ""))
    if not spans:
        return text
    out, at = [], 0
    spans.sort(key=lambda s: s[:2])
    k = 0
    while k < len(spans):
        a, b, mark = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < b:
            b = max(b, spans[k][1])
            k += 1
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, limits: Disclosure = Disclosure()) -> DataFrame:
    """docs (doc_id, text, ...) with all rows and columns, the text sanitised; n_chars follows the text where there is one.

    Null and empty texts stay as they are; repeated rows come out one by one; an empty table gives no rows; further
    columns stay, whatever their names.
    """
    terms = term_spans(docs, limits)

    @F.pandas_udf("string")
    def clean(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cleaned(t, [(s["start"], s["end"]) for s in x] if x is not None else []) for t, x in zip(texts, spans)], dtype=object)

    rows = docs.select(row_key().alias("key"), F.struct("*").alias("row"))  # so that no name clashes
    out = rows.join(small_side(terms), "key", "left").select("row", clean(F.col("row.text"), F.col("terms")).alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))

"""Quality rules: how far a text's characters and common words diverge from those of its language.

The reference of a language is two histograms summed over all its documents: eight classes of characters, and its
`common` most frequent words with one bin for all other words. A document is rejected if the Jensen-Shannon distance
of either histogram exceeds its threshold; histograms of short texts are noise, so each has a minimum length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsieve.llm.common import WORD
from proofsieve.session import checkpointed, ship

#: Character classes, in bin order; all other ASCII characters are bin 6, all beyond ASCII bin 7.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\v\f\r", ".,;:!?'\"()-", "#*$%&|<>")
SYMBOLS = CLASSES[5]
#: Rows that are in Python at once, different words that a task counts before it hands them on, and words handed on at once.
SLICE, COUNTED, HANDED = 256, 200_000, 25_000


@dataclass(frozen=True)
class Rules:
    """Thresholds of the operator. Distances are square roots of divergences in bits, so from 0 to 1."""

    common: int = 200
    max_char_distance: float = 0.26
    min_chars: int = 200
    max_word_distance: float = 0.56
    min_words: int = 100
    base_min_words: int = 20
    base_max_repeat_percent: int = 30
    window: int = 8


def _class_table() -> np.ndarray:
    table = np.full(0x110000, 7, np.uint8)
    table[:128] = 6
    for k, members in enumerate(CLASSES):
        table[[ord(c) for c in members]] = k
    return table


def class_counts(text: str, table: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(table[points], minlength=8)


def distance(counts: np.ndarray, reference: np.ndarray) -> float:
    """Jensen-Shannon distance of a histogram to a distribution; 0 for an empty histogram."""
    total = counts.sum()
    if not total:
        return 0.0
    used = np.flatnonzero(counts)
    p, q = counts[used] / total, reference[used]
    middle = p + q
    divergence = (p * np.log2(2 * p / middle) - q).sum() + 1
    known = q > 0
    divergence += (q[known] * np.log2(2 * q[known] / middle[known])).sum()
    return float(np.sqrt(max(0.0, divergence / 2)))


def repeated_words(words: list[str], width: int) -> int:
    """Words that lie in a window of `width` words found twice or more in the text."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[str, int] = {}
    rank = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    if len(ids) == n:
        return 0
    have = 1
    while have < width:  # ranks of windows of `have` words become ranks of wider ones
        step = min(have, width - have)
        pairs = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        _, rank = np.unique(pairs, return_inverse=True)
        have += step
    starts = np.flatnonzero(np.bincount(rank)[rank] > 1)
    if not len(starts):
        return 0
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int((np.cumsum(cover[:n]) > 0).sum())


def references(docs: DataFrame, rules: Rules = Rules()) -> dict[str, tuple[np.ndarray, dict[str, int], np.ndarray]]:
    """Per language: its distribution of character classes, the bins of its common words and their distribution.

    Counts cover all documents and are summed on Spark; the driver gets `common` + 9 rows for each language.
    """
    ship(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _class_table()
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}

        def part(rows: list[tuple]) -> pa.RecordBatch:
            columns = [*zip(*rows)] or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()))], ["lang", "word", "bin", "n"])

        def flushed() -> Iterator[pa.RecordBatch]:
            yield part([(lang, "", k, int(n)) for lang, c in classes.items() for k, n in enumerate(c) if n])
            for lang, c in words.items():
                own = iter(c.items())
                while some := [*islice(own, HANDED)]:
                    yield part([(lang, w, -1, n) for w, n in some])
            words.clear()
            classes.clear()

        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                some = batch.slice(k, SLICE)
                for text, lang in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    text, lang = text or "", lang or ""
                    words.setdefault(lang, Counter()).update(WORD.findall(text))
                    classes[lang] = classes.get(lang, 0) + class_counts(text, table)
                    if sum(map(len, words.values())) > COUNTED:
                        yield from flushed()
        yield from flushed()

    each = docs.select("text", "lang").mapInArrow(counted, "lang string, word string, bin int, n long")
    counts = checkpointed(each.groupBy("lang", "bin", "word").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang", "bin").orderBy(F.desc("n"), "word"))
    top = counts.where("bin < 0").withColumn("k", rank).where(F.col("k") <= rules.common).select("lang", "word", "k", "n")
    sums = counts.groupBy("lang", "bin").agg(F.sum("n").alias("n")).select("lang", F.lit(None).cast("string").alias("word"), F.col("bin").alias("k"), "n")
    found: dict[str, dict] = {}
    for r in top.unionByName(sums).toLocalIterator():
        own = found.setdefault(r.lang, {"words": {}, "classes": np.zeros(8), "total": 0})
        if r.word is not None:
            own["words"][r.k - 1] = (r.word, r.n)
        elif r.k >= 0:
            own["classes"][r.k] = r.n
        else:
            own["total"] = r.n
    out = {}
    for lang, own in found.items():
        common = [own["words"][k] for k in range(len(own["words"]))]
        bins = np.array([n for _, n in common] + [own["total"] - sum(n for _, n in common)], float)
        out[lang] = (own["classes"] / max(1, own["classes"].sum()), {w: k for k, (w, _) in enumerate(common)}, bins / max(1, bins.sum()))
    return out


def _verdict(text: str | None, lang: str | None, known: dict, table: np.ndarray, rules: Rules) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    classes = class_counts(text, table)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeat = repeated_words(words, rules.window)
    failed = n < rules.base_min_words or 100 * repeat > rules.base_max_repeat_percent * n
    chars, bins, spread = known[lang or ""]
    by_char = distance(classes, chars) if len(text) >= rules.min_chars else 0.0
    by_word = 0.0
    if n >= rules.min_words:
        other = len(bins)
        by_word = distance(np.bincount([bins.get(w, other) for w in words], minlength=other + 1), spread)
    kept = not failed and by_char <= rules.max_char_distance and by_word <= rules.max_word_distance
    return n, sum(map(len, words)), int(classes[table[ord(SYMBOLS[0])]]), len(lines) - len(set(lines)), repeat, failed, by_char, by_word, kept


def verdicts(docs: DataFrame, rules: Rules = Rules()) -> Column:
    """The verdict on a row of docs as a struct, from its columns text and lang."""
    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(references(docs, rules))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        table = _class_table()
        for texts, langs in batches:
            yield pd.DataFrame([_verdict(t, x, known.value, table, rules) for t, x in zip(texts, langs)], columns=names)

    return judged(docs["text"], docs["lang"])


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per row of docs (doc_id, text, lang; further columns are left out).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance,
    word_distance, kept. A null text counts as empty and fails the base rules; a null language is a language of its
    own; repeated rows are judged one by one; an empty table gives no rows. Texts shorter than the minimum lengths are
    judged by the base rules alone.
    """
    return docs.select("doc_id", verdicts(docs, rules).alias("v")).select("doc_id", "v.*")


def reject(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; edge cases as in judge()."""
    return docs.where(verdicts(docs, rules)["kept"])

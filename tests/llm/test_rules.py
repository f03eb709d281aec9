"""The rules against the definition, read text by text."""

import math
import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from proofsieve.llm import queries, rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def classes(text):
    out = [0] * 8
    for c in text:
        out[next((k for k, own in enumerate(rules.CLASSES) if c in own), 6 if ord(c) < 128 else 7)] += 1
    return out


def distance(p, q):
    total, whole = sum(p), sum(q)
    if not total:
        return 0.0
    js = 0.0
    for a, b in zip((x / total for x in p), (x / whole for x in q)):
        m = (a + b) / 2
        js += sum(x / 2 * math.log2(x / m) for x in (a, b) if x)
    return math.sqrt(max(0.0, js))


def brute(rows, r=rules.Rules()):
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept)."""
    of_class, of_word = {}, {}
    for _, text, lang in rows:
        own = of_class.setdefault(lang or "", [0] * 8)
        own[:] = map(sum, zip(own, classes(text or "")))
        of_word.setdefault(lang or "", Counter()).update(WORDS.findall(text or ""))
    common = {lang: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[: r.common]] for lang, c in of_word.items()}
    out = []
    for doc_id, text, lang in rows:
        text, lang = text or "", lang or ""
        ws = WORDS.findall(text)
        windows = [tuple(ws[i : i + r.window]) for i in range(len(ws) - r.window + 1)]
        times = Counter(windows)
        covered = {k for i, w in enumerate(windows) if times[w] > 1 for k in range(i, i + r.window)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        failed = len(ws) < r.base_min_words or 100 * len(covered) > r.base_max_repeat_percent * len(ws)
        by_char = distance(classes(text), of_class[lang]) if len(text) >= r.min_chars else 0.0
        spread = lambda c, lang=lang: [*(c[w] for w in common[lang]), sum(c.values()) - sum(c[w] for w in common[lang])]
        by_word = distance(spread(Counter(ws)), spread(of_word[lang])) if len(ws) >= r.min_words else 0.0
        kept = not failed and by_char <= r.max_char_distance and by_word <= r.max_word_distance
        out.append((doc_id, len(ws), sum(map(len, ws)), sum(text.count(c) for c in rules.SYMBOLS), len(lines) - len(set(lines)), len(covered), failed, round(by_char, 9), round(by_word, 9), kept))
    return sorted(out, key=str)


def judged(spark, rows, r=rules.Rules(), schema="doc_id long, text string, lang string", more=()):
    df = spark.createDataFrame([(*x, *more) for x in rows], schema).repartition(3)
    got = rules.judge(df, r).collect()
    return sorted(((*x[:7], round(x.char_distance, 9), round(x.word_distance, 9), x.kept) for x in got), key=str)


def made(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "Étude", "漢字", "alpha", "beta", "x1", "#tag", "a", "b", "c.", "d,"]
    rows = []
    for k in range(n):
        text = "".join(rng.choice(vocabulary[: rng.randrange(2, 14)]) + rng.choice([" ", " ", "\n", "\t", "  ", "\x0b"]) for _ in range(rng.randrange(160)))
        if k % 7 == 0:
            text += "####" * rng.randrange(200)
        rows.append((k % 40, text, rng.choice(["en", "fr", None, ""])))
    return rows


def test_rules_match_the_definition(spark):
    rows = [*made(1, 150), (None, "one two " * 40, "en"), (3, None, "en"), (4, "", None), (5, "same line\n" * 30, "fr"), (6, "word " * 30_000, "en"), (7, "x" * 100_000, "de")]
    rows += [rows[9]] * 5
    want = brute(rows)
    assert judged(spark, rows) == want
    assert {x[9] for x in want} == {True, False} and {x[6] for x in want} == {True, False}


def test_ties_at_the_last_common_word(spark):
    r = rules.Rules(common=3, min_words=3, min_chars=1, base_min_words=1, max_word_distance=0.4, max_char_distance=0.5)
    rows = [(k, " ".join(w), "en") for k, w in enumerate((["a", "a", "b"], ["é", "c", "b"], ["Z", "c", "é"], ["d", "d", "Z"]))]
    assert judged(spark, rows, r) == brute(rows, r)


def test_kept_rows_keep_their_columns(spark):
    rows = made(2, 60)
    schema = "doc_id long, text string, lang string, kept string, v string, word string, n string"
    df = spark.createDataFrame([(*x, "k", "v", "w", "n") for x in rows], schema)
    kept = rules.reject(df)
    assert kept.columns == df.columns
    want = sorted((x[0] for x in brute(rows) if x[9]), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == want and want
    assert judged(spark, rows, schema=schema, more=("k", "v", "w", "n")) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert rules.judge(df).count() == 0 and rules.reject(df).count() == 0


def test_query_and_sql(spark, tmp_path):
    rows = [*made(3, 120), (None, None, None), (2, "", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n_chars", F.length("text")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_quality_rules(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.sql(queries.OP5_SQL).fetchall(), key=str)


def test_repeated_words():
    rng = random.Random(4)
    for _ in range(300):
        ws = [rng.choice("ab") for _ in range(rng.randrange(40))]
        for width in (1, 2, 3, 8):
            windows = [tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)]
            times = Counter(windows)
            want = {k for i, w in enumerate(windows) if times[w] > 1 for k in range(i, i + width)}
            assert rules.repeated_words(ws, width) == (len(want) if len(ws) > width else 0)

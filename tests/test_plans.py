"""What plans of columns and joins must not grow to."""

import random

from pyspark.sql import functions as F

from proofsieve.functions import identifiers
from proofsieve.operators import claims, registry, verify


def length(df):
    return len(df._jdf.queryExecution().analyzed().toString())


def test_facts_of_a_match_stand_in_plans_once(spark):
    df = spark.createDataFrame([("a",)], "c string")
    assert length(df.select(identifiers.phones(F.col("c")))) < 60_000
    assert length(df.select(identifiers.registration_numbers(F.col("c")))) < 30_000
    rows = spark.createDataFrame([("1", "Alpha", ["Alpha"], ["Beta"], None)], "number string, name string, names array<string>, trade_names array<string>, contact_person string")
    assert length(verify.name_comparisons(rows.select(F.col("number").alias("id"), "number", "name"), rows.withColumnRenamed("number", "registration_no"))) < 60_000


def test_names_are_held_against_few_and_the_best_are_found(spark, monkeypatch):
    dice, seen = random.Random(3), spark.sparkContext.accumulator(0)
    names = [f"Supplier#{dice.randrange(10**6):09d}" for _ in range(400)] + ["Alpha Supplier Suplier", "Suplier#000"]
    register = spark.createDataFrame([(f"N{i:04d}", n) for i, n in enumerate(names)], "registration_no string, name string")
    asked = spark.createDataFrame([(n.replace("pp", "p"),) for n in names[:30]] + [("Suplier#000",), ("no such name",)], "query string")
    similarity = registry.word_similarity
    rated = lambda q, n: F.when(similarity(q, n).isNotNull(), similarity(q, n))
    every = asked.distinct().crossJoin(register).select("query", "registration_no", "name", rated(registry.text.fold_for_match(F.col("query")), registry.text.fold_for_match(F.col("name"))).alias("s")).collect()
    want = {}
    for r in every:
        if r.s >= 0.6 or r.query.lower() in r.name.lower():
            want.setdefault(r.query, []).append((-r.s, r.registration_no))
    counting = F.udf(lambda x: (seen.add(1), x)[1], "double").asNondeterministic()
    monkeypatch.setattr(registry, "word_similarity", lambda q, n: counting(similarity(q, n)))
    got = {}
    for r in registry.search_names(asked, register).collect():
        got.setdefault(r.query, []).append((-r.similarity, r.registration_no))
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v)[:5] for q, v in want.items()}
    assert seen.value < len(names) * 32 / 2


def test_names_are_located_on_lines_near_a_number_only(spark):
    lines = ["Alpha Capital"] + [f"line {k}" for k in range(500)] + ["Alpha Capital", "SEBI registered", "INH000011431", "end"]
    segments = spark.createDataFrame([(1, 0, "\n".join(lines), "text", "good", None)], "msg_id long, seq int, text string, origin string, quality string, unclear array<string>")
    r = claims.read(segments)
    names, located = spark.createDataFrame([(1, "Alpha Capital")], "msg_id long, name string"), []
    keep = claims.checkpointed
    claims.checkpointed = lambda df: located.append(df.count()) or keep(df)
    try:
        assert [tuple(x) for x in claims.adjacent(r, names).collect()] == [(1, "reg-1", "Alpha Capital")]
    finally:
        claims.checkpointed = keep
    assert located == [5]

"""What the cost of a query must not hang on, and rows that an order has to tell apart."""

import datetime as dt
import time

from pyspark.sql import functions as F

from proofsieve.functions import spans
from proofsieve.operators import answers, verify
from proofsieve.plans import QUERIES
from proofsieve.sources import messages


def test_lines_of_one_part_are_told_apart_by_their_day(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    orders = [(1, 1, "P", day)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    for late_first in (True, False):
        days = sorted((day, day + dt.timedelta(9)), reverse=late_first)
        rows = spark.createDataFrame([(5, 2, 7, d) for d in days], "l_orderkey long, l_linenumber int, l_partkey long, l_shipdate timestamp").coalesce(1)
        rows.write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
        spark.catalog.clearCache()
        assert [r.run_at for r in QUERIES["follow_up_jobs"](spark, str(tmp_path)).collect()] == [day]


def test_fields_of_forms_are_decoded_once(spark):
    body = "&".join(f"k{i}=v%20{i}" for i in range(4000)) + "&Body=first&From=%2B1&Body=last+one"
    began = time.time()
    r = messages.form_messages(spark.createDataFrame([(body, None)], "body string, received_at timestamp")).first()
    assert (r.text, r.reply_to, r.media) == ("last one", "+1", []) and time.time() - began < 15


def test_answers_are_parsed_once(spark):
    items, wrong = answers.items_of(spark.createDataFrame([(1, '{"investmentRelated": true}'), (2, "none")], "msg_id long, answer string"))
    plan = items.unionByName(items)._jdf.queryExecution().toString()
    assert "from_json" not in plan and [(r.msg_id, r.issues) for r in wrong.collect()] == [(2, ["no JSON object"])]


def test_names_of_a_number_are_compared_once(spark):
    records = spark.createDataFrame([("7", ["Alpha Capital"], ["Beta Trust"], None)], "registration_no string, names array<string>, trade_names array<string>, contact_person string")
    claimed = spark.range(60).select("id", F.when(F.col("id") % 3 > 0, "7").alias("number"), F.when(F.col("id") % 2 == 0, "Alpha Capital").alias("name"))
    told = verify.name_comparisons(claimed, records)
    assert "Deduplicate" in told._jdf.queryExecution().analyzed().toString() or "Distinct" in told._jdf.queryExecution().analyzed().toString()
    got = {r.id: (r.result, r.matched) for r in told.collect()}
    assert len(got) == 60 and all(v == (("same", "Alpha Capital (Proprietor: Beta Trust)") if k % 3 and not k % 2 else ("inconclusive", None)) or v[0] == "same" for k, v in got.items())


def test_several_quotes_are_located_like_one(spark):
    df = spark.createDataFrame([(["never said", "b c", None], [(0, "a b"), (1, "x b c d")]), (["q"], None)], "quotes array<string>, segments array<struct<seq int, text string>>")
    each = df.select(spans.locate_quotes(F.col("quotes"), F.col("segments")).alias("x")).collect()
    one = df.select(spans.locate_quote(F.get("quotes", F.lit(1)), F.col("segments")).alias("x")).first().x
    assert [x and (x.seq, x.start, x.end) for x in each[0].x] == [None, (1, 2, 5), None] and each[1].x == [None] and (one.seq, one.start, one.end) == (1, 2, 5)


def test_locating_reads_only_what_is_around_a_quote(monkeypatch):
    text = "one two " * 3000 + "registered by by Zeta Capital 77, call " + "three é39 " * 3000
    at, read, keep = text.index("by Zeta"), [], spans.tokens
    monkeypatch.setattr(spans, "tokens", lambda t: read.append(len(t)) or keep(t))
    assert spans.locate("by Zeta Capital", text) == (at - 3, at + 15)  # the first of the windows that have all words
    assert spans.locate("by Omega Capital", text) is None
    assert max(read) < 2000


def test_jobs_of_one_call_run_together(spark):
    from threading import Barrier

    from proofsieve.session import together

    met = Barrier(3, timeout=20)
    found = together(spark, *(lambda n=n: (met.wait(), spark.range(n).where(spans.identifier_occurs(F.lit("abcd"), F.array(F.struct(F.lit("xabcd").alias("alnum"))))).count())[1] for n in range(3)))
    assert found == [0, 1, 2]

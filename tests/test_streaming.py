import datetime as dt
import random
import time

from pyspark.sql import functions as F

from proofsieve.operators import adjudicate, queue, registry
from proofsieve.streaming import inbound

T0 = dt.datetime(2026, 10, 4, 10, 0, 0)


def run(spark, path, f, schema):
    stream = spark.readStream.schema(schema).parquet(path)
    q = f(stream).writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{path}-{time.time_ns()}").start()
    q.awaitTermination(120)
    return spark.table("found").collect()


def test_streams_give_what_batches_give(spark, tmp_path):
    schema = "id long, user string, ts timestamp"
    rows = [(1, "a", T0), (1, "a", T0 + dt.timedelta(seconds=1)), (2, "a", T0 + dt.timedelta(seconds=3)), (3, "b", T0), (4, "a", T0 + dt.timedelta(seconds=60)), (5, "z", T0 + dt.timedelta(hours=2))]
    path = str(tmp_path / "in")
    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    batch = spark.createDataFrame(rows, schema)
    once = run(spark, path, lambda s: inbound.each_once(s, "id", "ts").select("id"), schema)
    assert sorted(r.id for r in once) == [1, 2, 3, 4, 5] == sorted(r.id for r in inbound.each_once(batch, "id", "ts").collect())
    want = {(r.user, r.start, r.n) for r in inbound.sessions(batch, "user", "ts").collect()}
    assert want == {("a", T0, 3), ("b", T0, 1), ("a", T0 + dt.timedelta(seconds=60), 1), ("z", T0 + dt.timedelta(hours=2), 1)}
    closed = {(r.user, r.start, r.n) for r in run(spark, path, lambda s: inbound.sessions(s, "user", "ts"), schema)}
    assert closed == {r for r in want if r[0] != "z"}  # the last session may still grow


def test_windows_of_messages_close_alike_on_streams_and_batches(spark, tmp_path):
    sec = lambda n: T0 + dt.timedelta(seconds=n)
    rows = [("a", sec(k * 4), f"a{k}") for k in range(8)] + [("b", sec(0), "b0"), ("b", sec(5), "b1"), ("b", sec(6), "b2")] + [("c", sec(k / 10), f"c{k}") for k in range(10)] + [("z", sec(7200), "z")]
    schema = "key string, at timestamp, message_id string"
    path = str(tmp_path / "in")
    for part in (rows[:5], rows[5:-1], rows[-1:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    want = {("a", sec(0), sec(20), ("a0", "a1", "a2", "a3", "a4"), 0), ("a", sec(20), sec(33), ("a5", "a6", "a7"), 0), ("b", sec(0), sec(5), ("b0",), 0), ("b", sec(5), sec(11), ("b1", "b2"), 0), ("c", sec(0), sec(5.9), tuple(f"c{k}" for k in range(8)), 2)}
    plain = lambda found: {(r.key, r.start, r.closes, tuple(r.message_ids), r.dropped) for r in found if r.key != "z"}
    assert plain(queue.collected(spark.createDataFrame(rows, schema)).collect()) == want
    assert plain(run(spark, path, inbound.collect_stream, schema)) == want


def test_queue_and_commands(spark):
    log = spark.createDataFrame([(1, T0, "enqueue"), (1, T0 + dt.timedelta(seconds=1), "start"), (2, T0, "start"), (2, T0 + dt.timedelta(seconds=1), "done"), (3, T0, "start"), (3, T0, "fail")], "job_id long, ts timestamp, event string")
    now = F.lit(T0 + dt.timedelta(seconds=100))
    assert {r.job_id: r.status for r in inbound.queue_state(log, now).collect()} == {1: "running", 2: "done", 3: "running"}
    assert {r.job_id: r.status for r in inbound.queue_state(log, F.lit(T0 + dt.timedelta(hours=1))).collect()} == {1: "pending", 2: "done", 3: "pending"}
    words = spark.createDataFrame([("STOP!",), ("hello ",), ("what",), (None,)], "t string")
    assert [r.v for r in words.select(inbound.command(F.col("t")).alias("v")).collect()] == [None, "help", None, None]


def test_days_and_validity(spark):
    df = spark.sql("SELECT DATE '2026-10-04' AS until, TIMESTAMP '2026-10-04 18:00:00' AS now, TIMESTAMP '2026-10-03 19:00:00' AS since")
    r = df.select(registry.is_active(F.col("until"), F.col("now")).alias("a"), registry.is_active(F.col("until"), F.col("now") + F.expr("INTERVAL 1 HOUR")).alias("b"), adjudicate.age_in_days(F.col("since"), F.col("now")).alias("d")).first()
    assert (r.a, r.b, r.d) == (True, False, 0)


def test_decision_tables(spark):
    c = lambda x: F.lit(x)
    args = dict(covered=True, format_valid=True, clear=True, available=True, found=True, inactive=False, active=True, binding="explicit", comparison="different", perpetual=False)
    cases = [({}, "REG_BELONGS_TO_OTHER"), ({"clear": False}, "REG_NAME_MISMATCH_UNCERTAIN"), ({"binding": "inferred"}, "REG_NAME_MISMATCH_INFERRED"), ({"active": False}, "REG_EXPIRED"), ({"found": False}, "REG_NOT_IN_REGISTER"), ({"found": False, "inactive": True}, "REG_INACTIVE"), ({"available": False}, "REG_SOURCE_UNAVAILABLE"), ({"format_valid": False}, "REG_FORMAT_INVALID"), ({"covered": False}, "REG_SCHEME_NOT_COVERED"), ({"comparison": "same"}, "REG_MATCH"), ({"comparison": "same", "perpetual": True}, "REG_MATCH_PERPETUAL"), ({"comparison": "similar"}, "REG_NAME_SIMILAR"), ({"binding": "none"}, "REG_REAL_SENDER_UNKNOWN")]
    row = spark.range(1).select(*(adjudicate.registration_reason(**{k: c(v) for k, v in (args | change).items()}).alias(f"r{k}") for k, (change, _) in enumerate(cases))).first()
    assert list(row) == [want for _, want in cases]
    bare = lambda *a: adjudicate.bare_registration_reason(*map(c, a))
    row = spark.range(1).select(bare(True, False, 0, False), bare(True, True, 1, True), bare(True, True, 1, False), bare(True, True, 2, True), bare(True, True, 0, True), bare(False, True, 0, True)).first()
    assert list(row) == ["REG_SOURCE_UNAVAILABLE_NAME", "REG_NAME_FOUND", "REG_EXPIRED", "REG_NAME_AMBIGUOUS", "REG_NAME_NOT_FOUND", "REG_NO_DETAILS"]


def brute_admitted(times, most, seconds):
    kept, out = [], []
    for at in times:
        ok = sum(at - seconds < k for k in kept) < most
        if ok:
            kept.append(at)
        out.append(ok)
    return out


def test_refused_windows_do_not_count(spark):
    rng = random.Random(4)
    times = {k: sorted(rng.sample(range(40_000), 60)) for k in "abc"} | {"busy": [*range(0, 12_000, 60)]}
    rows = [(k, T0 + dt.timedelta(seconds=s), [f"{k}{s}"]) for k, own in times.items() for s in own]
    df = spark.createDataFrame(rows, "key string, closes timestamp, message_ids array<string>")
    got = {}
    for r in queue.admitted(df, most=5, seconds=3600).collect():
        got.setdefault(r.key, {})[int((r.closes - T0).total_seconds())] = r.admitted
    for k, own in times.items():
        assert [got[k][s] for s in own] == brute_admitted(own, 5, 3600)
    assert got["busy"][0] and not got["busy"][1800] and got["busy"][3600]  # admitted again after an hour
    assert queue.admitted(df.limit(0)).count() == 0


def test_admission_on_streams_and_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(5)
    rows = sorted((k, T0 + dt.timedelta(seconds=s), f"{k}{s}") for k in "ab" for s in rng.sample(range(600), 60))
    rows = sorted(rows, key=lambda r: r[1])
    schema = "key string, at timestamp, message_id string"
    path = str(tmp_path / "in")
    parts = [rows[:40], rows[40:90], rows[90:], [("z", T0 + dt.timedelta(hours=3), "z")], [("z", T0 + dt.timedelta(hours=6), "z2")]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.1)
    plain = lambda found: {(r.key, r.start, r.closes, tuple(r.message_ids), r.dropped, r.admitted) for r in found if r.key != "z"}
    want = plain(queue.admitted(queue.collected(spark.createDataFrame(rows, schema)), most=4, seconds=120).collect())
    stream = lambda s: inbound.admit_stream(s, quota=4, seconds=120)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = stream(source).writeStream.format("memory").queryName("admitted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination(180)
    assert plain(spark.table("admitted").collect()) == want and {r[5] for r in want} == {True, False}
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    days = spark.createDataFrame([(T0,), (T0 + dt.timedelta(days=1),)], "received_at timestamp")
    assert queue.latest_received(days).first().received_at == T0 + dt.timedelta(days=1) and queue.latest_received(days.limit(0)).first().received_at is None

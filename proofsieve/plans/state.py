"""Queries over tables that change: queues, sessions, snapshots, retention, and messages as they are collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsieve.operators import queue
from proofsieve.plans.base import NOW, flat, made, now, query, table

JOBS = f"SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'collect' ELSE 'send' END AS kind, 'p' || CAST(o_orderkey AS STRING) AS payload, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'running' END AS status, CAST(o_orderdate AS TIMESTAMP) AS run_at, CAST(o_custkey % 4 AS INT) AS attempts, 3 AS max_attempts, CASE WHEN o_orderstatus = 'P' THEN {NOW} - INTERVAL 1 MINUTE * (o_orderkey % 20) END AS locked_at, CASE WHEN o_orderstatus <> 'F' THEN 'k' || CAST(o_orderkey AS STRING) END AS dedupe_key, CAST(NULL AS STRING) AS last_error, CAST(o_orderdate AS TIMESTAMP) AS updated_at FROM orders"
ASKED = "SELECT l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linenumber = 7 THEN NULL ELSE 'k' || CAST(l_orderkey + l_linenumber AS STRING) END AS dedupe_key, 'n' || CAST(l_orderkey AS STRING) AS payload, CAST(l_shipdate AS TIMESTAMP) AS run_at, l_orderkey AS o, l_linenumber AS line, l_partkey AS part FROM lineitem"
#: Lines may come twice with one number, also of one part; what asks for a job is the first part of each, on its first day.
ONE_LINE = f"a AS (SELECT * FROM ({ASKED}) QUALIFY row_number() OVER (PARTITION BY o, line ORDER BY part, run_at) = 1)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, JOBS)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.first_of_each(made(spark, sf_dir, ASKED), [F.col("o"), F.col("line")], [F.col("part"), F.col("run_at")]).drop("o", "line", "part")


@query(f"""WITH j AS ({JOBS}), {ONE_LINE} SELECT seq, dedupe_key FROM a WHERE dedupe_key IS NULL UNION ALL
 SELECT min(seq), dedupe_key FROM a WHERE dedupe_key NOT IN (SELECT dedupe_key FROM j WHERE dedupe_key IS NOT NULL) GROUP BY dedupe_key""")
def enqueued_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.enqueue(jobs(spark, sf_dir), asked(spark, sf_dir)).select("seq", "dedupe_key")


@query(f"""WITH j AS ({JOBS}), {ONE_LINE}, l AS (SELECT dedupe_key, arg_max(payload, seq) AS payload, arg_max(run_at, seq) AS run_at FROM a WHERE dedupe_key IS NOT NULL GROUP BY dedupe_key)
 SELECT id, CASE WHEN status = 'pending' AND l.dedupe_key IS NOT NULL THEN l.payload ELSE j.payload END AS payload, CASE WHEN status = 'pending' AND l.dedupe_key IS NOT NULL THEN l.run_at ELSE j.run_at END AS run_at FROM j LEFT JOIN l ON j.dedupe_key = l.dedupe_key""")
def debounced_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.debounce(jobs(spark, sf_dir), asked(spark, sf_dir).where("dedupe_key IS NOT NULL"))[0].select("id", "payload", "run_at")


@query(f"""WITH j AS ({JOBS}), {ONE_LINE} SELECT NULL AS dedupe_key, payload, run_at FROM a WHERE dedupe_key IN (SELECT dedupe_key FROM j WHERE status <> 'pending' AND dedupe_key IS NOT NULL) UNION ALL
 SELECT dedupe_key, arg_max(payload, seq), arg_max(run_at, seq) FROM a WHERE dedupe_key NOT IN (SELECT dedupe_key FROM j WHERE dedupe_key IS NOT NULL) GROUP BY dedupe_key""")
def follow_up_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.debounce(jobs(spark, sf_dir), asked(spark, sf_dir).where("dedupe_key IS NOT NULL"))[1]


@query(f"WITH j AS ({JOBS}), {ONE_LINE} SELECT id, dedupe_key FROM j WHERE status = 'pending' AND dedupe_key IN (SELECT dedupe_key FROM a)")
def pending_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.pending_by_key(jobs(spark, sf_dir), asked(spark, sf_dir)).select("id", "dedupe_key")


@query(f"WITH j AS ({JOBS}) SELECT id, kind FROM j WHERE status = 'pending' AND kind = 'send' AND run_at <= {NOW}")
def due_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.due(jobs(spark, sf_dir), now(), ["send"]).select("id", "kind")


ENDED = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN 'broke' END AS error, CASE WHEN o_orderkey % 3 = 1 THEN 30 END AS delay FROM orders WHERE o_orderstatus = 'P'"


@query(f"""WITH j AS ({JOBS}), e AS ({ENDED}), x AS (SELECT j.*, e.id IS NOT NULL AS gone, error, delay, e.id IS NOT NULL AND error IS NOT NULL AND delay IS NOT NULL AND attempts < max_attempts AS again FROM j LEFT JOIN e ON j.id = e.id)
 SELECT id, CASE WHEN NOT gone THEN status WHEN again THEN 'pending' WHEN error IS NULL THEN 'done' ELSE 'failed' END AS status, CASE WHEN gone AND error IS NOT NULL AND delay IS NOT NULL THEN {NOW} + INTERVAL 30 SECONDS ELSE run_at END AS run_at, CASE WHEN NOT gone OR again THEN dedupe_key END AS dedupe_key, CASE WHEN NOT gone OR again THEN payload ELSE '{{}}' END AS payload, CASE WHEN gone THEN error END AS last_error FROM x""")
def finished_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.finish(jobs(spark, sf_dir), made(spark, sf_dir, ENDED), now()).select("id", "status", "run_at", "dedupe_key", "payload", "last_error")


@query(f"WITH j AS ({JOBS}) SELECT id, CASE WHEN status = 'running' AND locked_at <= {NOW} - INTERVAL 10 MINUTES THEN 'pending' ELSE status END AS status, least(60, CAST(pow(2, attempts + 1) AS INT)) AS delay FROM j")
def recovered_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.recover(jobs(spark, sf_dir), now(), 600).select("id", "status", queue.retry_delay(F.col("attempts")).alias("delay"))


@query(f"WITH j AS ({JOBS}) SELECT status, count(*) AS n, (SELECT min(run_at) FROM j WHERE status = 'pending') AS next_run FROM j GROUP BY status")
def job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir)
    return queue.counts(j, "status").crossJoin(F.broadcast(queue.next_run(j).withColumnRenamed("run_at", "next_run")))  # one row


SESSIONS = f"SELECT c_custkey AS key, c_mktsegment AS locale, c_name AS pending, {NOW} + INTERVAL 1 DAY * (c_nationkey - 12) AS expires_at FROM customer"
PATCHES = "SELECT o_custkey AS key, o_orderkey AS seq, o_orderkey % 2 = 0 AS has_locale, o_orderkey % 3 = 0 AS has_pending, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS locale, CASE WHEN o_orderkey % 9 = 0 THEN o_orderstatus END AS pending FROM orders"


@query(f"""WITH s AS ({SESSIONS}), p AS ({PATCHES}), l AS (SELECT key, max(seq) FILTER (WHERE has_locale) AS a, max(seq) FILTER (WHERE has_pending) AS b FROM p GROUP BY key)
 SELECT coalesce(s.key, l.key) AS key, CASE WHEN l.a IS NOT NULL THEN pa.locale ELSE s.locale END AS locale, CASE WHEN l.b IS NOT NULL THEN pb.pending ELSE s.pending END AS pending, CASE WHEN l.key IS NOT NULL THEN {NOW} + INTERVAL 30 DAYS ELSE s.expires_at END AS expires_at
 FROM s FULL JOIN l ON s.key = l.key LEFT JOIN p pa ON pa.key = l.key AND pa.seq = l.a LEFT JOIN p pb ON pb.key = l.key AND pb.seq = l.b""")
def patched_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = made(spark, sf_dir, PATCHES)
    named = F.array_compact(F.array(F.when(F.col("has_locale"), "locale"), F.when(F.col("has_pending"), "pending")))
    return queue.patched(made(spark, sf_dir, SESSIONS), p.withColumn("set", named), ["locale", "pending"], now())


#: Tables that are swept, by kind: what of each expires when.
KEPT = {"investigations": f"SELECT o_orderkey AS id, {NOW} + INTERVAL 1 DAY * (o_custkey % 9 - 4) AS expires_at FROM orders", "blobs": f"SELECT p_partkey AS id, {NOW} + INTERVAL 1 MINUTE * (p_size - 25) AS expires_at FROM part", "cache": f"SELECT l_partkey AS id, {NOW} + INTERVAL 1 HOUR * (l_linenumber - 3) AS expires_at FROM lineitem"}


@query(f"WITH s AS ({SESSIONS}), j AS ({JOBS}) SELECT 'sessions' AS kind, count(*) FILTER (WHERE expires_at <= {NOW}) AS removed FROM s UNION ALL SELECT 'jobs', count(*) FILTER (WHERE status IN ('done', 'failed') AND updated_at < {NOW} - INTERVAL 7 DAYS) FROM j UNION ALL SELECT 'inbound', count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 14 DAYS) FROM events" + "".join(f" UNION ALL SELECT '{kind}', count(*) FILTER (WHERE expires_at <= {NOW}) FROM ({sql})" for kind, sql in KEPT.items()))
def swept_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    inbound = table(spark, sf_dir, "events").withColumnRenamed("ts", "received_at")
    found = [queue.swept(made(spark, sf_dir, SESSIONS), now(), "sessions"), queue.swept(jobs(spark, sf_dir), now(), "jobs"), queue.swept(inbound, F.expr("TIMESTAMP '2024-01-20 00:00:00'"), "inbound")]
    found += [queue.swept(made(spark, sf_dir, sql), now(), kind) for kind, sql in KEPT.items()]
    return reduce(DataFrame.unionByName, (removed for _, removed in found))


@query("SELECT max(ts) AS received_at FROM events")
def latest_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.latest_received(table(spark, sf_dir, "events").withColumnRenamed("ts", "received_at"))


@query(f"WITH s AS ({SESSIONS}) SELECT key, locale FROM s WHERE expires_at > {NOW}")
def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.live(made(spark, sf_dir, SESSIONS), now()).select("key", "locale")


LOG = "SELECT o_orderkey AS id, 1 AS seq, o_orderdate AS at, 'start' AS event, 'reg' AS source, o_orderpriority AS scope, CAST(NULL AS DATE) AS as_of, CAST(NULL AS BIGINT) AS record_count, CAST(NULL AS STRING) AS error FROM orders"
ENDS = "SELECT o_orderkey AS id, 2 AS seq, o_orderdate + INTERVAL 1 HOUR AS at, CASE o_orderstatus WHEN 'F' THEN 'succeed' ELSE 'fail' END AS event, 'reg' AS source, o_orderpriority AS scope, CAST(o_orderdate AS DATE) AS as_of, o_custkey AS record_count, repeat('e', 3000) AS error FROM orders WHERE o_orderstatus <> 'P'"


@query("""SELECT o_orderkey AS id, 'reg' AS source, o_orderpriority AS scope, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'failed' ELSE 'running' END AS status, o_orderdate AS started_at, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 1 HOUR END AS completed_at, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS as_of, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS record_count, CASE WHEN o_orderstatus = 'O' THEN repeat('e', 2000) END AS error FROM orders""")
def snapshot_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.snapshot_states(made(spark, sf_dir, LOG).unionByName(made(spark, sf_dir, ENDS)))


@query("SELECT o_orderkey AS id, o_orderdate AS started_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def recent_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.recent(made(spark, sf_dir, "SELECT o_orderkey AS id, o_orderdate AS started_at FROM orders"))


NAMES = "SELECT 'list' AS source, c_custkey AS ord, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) || ' ' || CAST(c_nationkey AS STRING) ELSE c_mktsegment || '  ' || CAST(c_nationkey AS STRING) END AS name FROM customer"


@query(f"WITH n AS ({NAMES}) SELECT source, replace(lower(name), '  ', ' ') AS name_folded, arg_min(name, ord) AS name FROM n GROUP BY ALL")
def replaced_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = made(spark, sf_dir, NAMES)
    return queue.replace_alerts(names).select("source", "name_folded", "name")


STAGES = "SELECT l_orderkey AS id, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS seq, CASE WHEN l_linenumber = 1 THEN 'create' WHEN l_linenumber = 4 AND l_returnflag = 'R' THEN 'complete' WHEN l_linenumber = 4 AND l_returnflag = 'A' THEN 'fail' ELSE 'stage' END AS event, CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS stage FROM lineitem"


@query(f"""WITH l AS ({STAGES}), e AS (SELECT id, min(seq) FILTER (WHERE event IN ('complete', 'fail')) AS first, arg_min(event, (seq, event)) FILTER (WHERE event IN ('complete', 'fail')) AS how FROM l GROUP BY id),
 s AS (SELECT l.id, arg_max(stage, seq) AS stage FROM l JOIN e ON l.id = e.id WHERE event = 'stage' AND (first IS NULL OR seq < first) GROUP BY l.id)
 SELECT e.id, CASE WHEN how = 'complete' THEN 'completed' WHEN how = 'fail' THEN 'failed' WHEN s.id IS NOT NULL THEN 'running' ELSE 'queued' END AS status, stage FROM e LEFT JOIN s ON e.id = s.id""")
def investigation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.investigation_states(made(spark, sf_dir, STAGES))


EXPORTS = "SELECT l_orderkey AS scope, l_partkey AS part, CAST(l_shipdate AS DATE) AS as_of, CASE WHEN l_quantity > 40 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS records, CASE WHEN l_discount > 0.095 THEN 'down' END AS error FROM lineitem"


@query(f"WITH e AS ({EXPORTS}) SELECT scope, max(error) IS NULL AND sum(records) >= 10 AS ok, CASE WHEN max(error) IS NULL AND sum(records) >= 10 THEN min(as_of) END AS as_of, CASE WHEN max(error) IS NOT NULL THEN max(error) WHEN sum(records) < 10 THEN 'unexpectedly few entries (' || CAST(CAST(sum(records) AS BIGINT) AS STRING) || ')' END AS error FROM e GROUP BY scope")
def refreshed_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.refreshed(made(spark, sf_dir, EXPORTS), least=10)


@query(f"SELECT min(o_orderdate) < {NOW} - INTERVAL 24 HOURS AS due FROM orders")
def refresh_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.refresh_due(table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("completed_at")), now())


INBOUND = "SELECT event_id AS message_id, user_id AS key, CASE event_type WHEN 'click' THEN ' Delete my  data! ' WHEN 'view' THEN 'नमस्ते।' WHEN 'error' THEN 'join blue-sky' ELSE 'we are registered' END AS text, CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS n_media FROM events"


@query(f"""WITH m AS ({INBOUND}) SELECT message_id, key, CASE WHEN c_custkey IS NOT NULL THEN 'hi' WHEN text = 'नमस्ते।' THEN 'hi' ELSE 'en' END AS locale, CASE WHEN n_media > 0 THEN NULL WHEN text LIKE '%Delete%' THEN 'delete' WHEN text = 'नमस्ते।' THEN 'help' WHEN text LIKE 'join%' THEN 'join' END AS command FROM m LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) ON key = c_custkey""")
def message_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = made(spark, sf_dir, "SELECT c_custkey AS key, 'hi' AS locale FROM customer WHERE c_nationkey < 5")
    return queue.routes(made(spark, sf_dir, INBOUND), sessions)


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS key, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS STRING)) AS n FROM events),
 w AS (SELECT key, n, ts AS start, ts AS last, true AS opens, event_id FROM e WHERE n = 1 UNION ALL
  SELECT e.key, e.n, CASE WHEN e.ts >= least(w.last + INTERVAL 1 HOUR, w.start + INTERVAL 4 HOUR) THEN e.ts ELSE w.start END, e.ts, e.ts >= least(w.last + INTERVAL 1 HOUR, w.start + INTERVAL 4 HOUR), e.event_id FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1),
 g AS (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY key ORDER BY n) AS run FROM w), c AS (SELECT *, row_number() OVER (PARTITION BY key, run ORDER BY n) AS place FROM g),
 x AS (SELECT key, run, min(start) AS start, least(max(last) + INTERVAL 1 HOUR, min(start) + INTERVAL 4 HOUR) AS closes, string_agg(CAST(event_id AS STRING), '|' ORDER BY n) FILTER (WHERE place <= 8) AS message_ids, CAST(count(*) FILTER (WHERE place > 8) AS INT) AS dropped FROM c GROUP BY key, run),
 a AS (SELECT key, run, true AS admitted, [closes] AS kept FROM x WHERE run = 1 UNION ALL
  SELECT x.key, x.run, len(list_filter(a.kept, lambda k: k > x.closes - INTERVAL 1 DAY)) < 2, CASE WHEN len(list_filter(a.kept, lambda k: k > x.closes - INTERVAL 1 DAY)) < 2 THEN list_append(list_filter(a.kept, lambda k: k > x.closes - INTERVAL 1 DAY), x.closes) ELSE a.kept END FROM a JOIN x ON x.key = a.key AND x.run = a.run + 1)
 SELECT CAST(x.key AS STRING) AS key, start, closes, message_ids, dropped, admitted FROM x JOIN a ON x.key = a.key AND x.run = a.run""")
def collected_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = made(spark, sf_dir, "SELECT user_id AS key, ts AS at, event_id AS message_id FROM events")
    return queue.admitted(queue.collected(events, gap=3600, cap=14_400), most=2, seconds=86_400).withColumn("message_ids", flat(F.col("message_ids")))


@query("SELECT event_id AS id, CAST(1 + event_id % 13 AS INT) - CASE WHEN event_id % 13 = 12 THEN 1 ELSE 0 END AS n_parts FROM events")
def input_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.struct(F.lit("text").alias("kind"))
    given = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.array_repeat(part, (1 + F.col("event_id") % 13).cast("int")).alias("parts"))
    return queue.shapes(given).select("id", "n_parts")

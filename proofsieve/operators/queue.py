"""Tables that change: job queues, sessions, snapshots and retention, as joins of a table with what is asked of it.

Each function returns the table as it is afterwards, so that a caller can write it as the next version; none needs locks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from proofsieve.functions import text
from proofsieve.quota import Quota
from proofsieve.session import ship
from proofsieve.streaming.inbound import command

#: Jobs are (id, kind, payload, status, run_at, attempts, max_attempts, locked_at, dedupe_key, last_error, updated_at).
ERROR_CHARS, DELAY, LONGEST_DELAY = 2000, 2, 60


def first_of_each(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key, whatever columns the rows have."""
    row = F.struct("*").alias("row")
    ranked = rows.select(row, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("n"))
    return ranked.where("n = 1").select("row.*")


def enqueue(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of asked (seq, dedupe_key, ...) that become jobs: those without a key, and of each key that no job has the first."""
    keyed = asked.where("dedupe_key IS NOT NULL").join(jobs.where("dedupe_key IS NOT NULL").select("dedupe_key").distinct(), "dedupe_key", "left_anti")
    return asked.where("dedupe_key IS NULL").unionByName(first_of_each(keyed, [F.col("dedupe_key")], [F.col("seq")]))


def debounce(jobs: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, follow-ups) after asked (seq, dedupe_key, payload, run_at), each with a key.

    The last payload and time of a key replace those of its pending job; a key without a job gets one, with what came
    last; for a key whose job runs already, each request becomes a follow-up without a key.
    """
    last = asked.groupBy("dedupe_key").agg(F.max_by(F.struct("payload", "run_at"), "seq").alias("new"))
    joined = jobs.join(last, "dedupe_key", "left")
    moved = F.col("new").isNotNull() & (F.col("status") == "pending")
    own = {"payload": F.when(moved, F.col("new.payload")).otherwise(F.col("payload")), "run_at": F.when(moved, F.col("new.run_at")).otherwise(F.col("run_at"))}
    kept = joined.select(*(own.get(c, F.col(c)).alias(c) for c in jobs.columns))
    held = jobs.where("dedupe_key IS NOT NULL").select("dedupe_key", "status")
    fresh = last.join(held, "dedupe_key", "left_anti").select("dedupe_key", "new.*")
    late = asked.join(held.where("status <> 'pending'"), "dedupe_key").select(F.lit(None).cast("string").alias("dedupe_key"), "payload", "run_at")
    return kept, fresh.unionByName(late)


def pending_by_key(jobs: DataFrame, keys: DataFrame) -> DataFrame:
    """The pending jobs of keys (dedupe_key)."""
    return jobs.where("status = 'pending'").join(keys.select("dedupe_key").distinct(), "dedupe_key", "left_semi")


def due(jobs: DataFrame, now: Column, kinds: list[str] | None = None) -> DataFrame:
    """Pending jobs whose time has come, of these kinds or of all."""
    return jobs.where((F.col("status") == "pending") & (F.col("run_at") <= now) & (F.col("kind").isin(kinds) if kinds else F.lit(True)))


def finish(jobs: DataFrame, ended: DataFrame, now: Column) -> DataFrame:
    """jobs after ended (id, error, delay): done without an error, else pending again after the delay (seconds) or failed.

    Jobs that end give up their keys and payloads; those that are tried again keep them. A null delay means no retry.
    """
    j = jobs.join(ended.select("id", F.lit(True).alias("ended"), "error", "delay"), "id", "left")
    is_ended, done = F.coalesce("ended", F.lit(False)), F.col("error").isNull()
    again = is_ended & ~done & F.col("delay").isNotNull() & (F.col("attempts") < F.col("max_attempts"))
    over = is_ended & ~again
    own = {
        "status": F.when(again, "pending").when(over & done, "done").when(over, "failed").otherwise(F.col("status")),
        "run_at": F.when(is_ended & ~done & F.col("delay").isNotNull(), now + F.make_dt_interval(secs=F.col("delay").cast("decimal(18,6)"))).otherwise(F.col("run_at")),
        "dedupe_key": F.when(~over, F.col("dedupe_key")),
        "payload": F.when(over, "{}").otherwise(F.col("payload")),
        "last_error": F.when(is_ended & ~done, F.left("error", F.lit(ERROR_CHARS))).otherwise(F.col("last_error")),
        "locked_at": F.when(~is_ended, F.col("locked_at")),
        "updated_at": F.when(is_ended, now).otherwise(F.col("updated_at")),
    }
    return j.select(*(own.get(c, F.col(c)).alias(c) for c in jobs.columns))


def retry_delay(attempts: Column) -> Column:
    """Seconds before the next attempt: doubling with each, up to a minute."""
    return F.least(F.lit(LONGEST_DELAY), DELAY * F.pow(F.lit(2), attempts)).cast("int")


def recover(jobs: DataFrame, now: Column, lease_seconds: int) -> DataFrame:
    """jobs with those pending again that run for longer than their lease."""
    stale = (F.col("status") == "running") & (F.col("locked_at") <= now - F.expr(f"INTERVAL {lease_seconds} SECONDS"))
    own = {"status": F.when(stale, "pending").otherwise(F.col("status")), "locked_at": F.when(~F.coalesce(stale, F.lit(False)), F.col("locked_at")), "updated_at": F.when(stale, now).otherwise(F.col("updated_at"))}
    return jobs.select(*(own.get(c, F.col(c)).alias(c) for c in jobs.columns))


def next_run(jobs: DataFrame) -> DataFrame:
    """One row: when the next pending job is due."""
    return jobs.where("status = 'pending'").agg(F.min("run_at").alias("run_at"))


def counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def patched(sessions: DataFrame, patches: DataFrame, fields: list[str], now: Column, days: int = 30) -> DataFrame:
    """sessions (key, *fields, expires_at) after patches (key, seq, set array<string>, *fields): a patch changes the
    fields that it names, to null as well, and puts off the end; the last patch of each field counts."""
    named = lambda f: F.array_contains("set", f)
    own = patches.groupBy("key").agg(*(F.max_by(F.struct(F.lit(True).alias("is"), F.col(f).alias("v")), F.when(named(f), F.col("seq"))).alias(f"p_{k}") for k, f in enumerate(fields)), *(F.bool_or(named(f)).alias(f"s_{k}") for k, f in enumerate(fields)), F.lit(True).alias("p"))
    old = sessions.select("key", F.struct(*fields, "expires_at").alias("old"))
    value = lambda k, f: F.when(F.col(f"s_{k}"), F.col(f"p_{k}.v")).otherwise(F.col(f"old.{f}")).alias(f)
    until = F.when(F.col("p"), now + F.expr(f"INTERVAL {days} DAYS")).otherwise(F.col("old.expires_at"))
    return old.join(own, "key", "full").select("key", *(value(k, f) for k, f in enumerate(fields)), until.alias("expires_at"))


def live(rows: DataFrame, now: Column) -> DataFrame:
    """Rows that have not expired: what a reader sees."""
    return rows.where(F.col("expires_at") > now)


def swept(rows: DataFrame, now: Column, kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row with the number removed) under the retention of a kind of table.

    Most rows end at expires_at; inbound messages 14 days after received_at; jobs that ended 7 days after updated_at.
    """
    gone = {"inbound": F.col("received_at") < now - F.expr("INTERVAL 14 DAYS"), "jobs": F.col("status").isin("done", "failed") & (F.col("updated_at") < now - F.expr("INTERVAL 7 DAYS"))}[kind] if kind in ("inbound", "jobs") else F.col("expires_at") <= now
    gone = F.coalesce(gone, F.lit(False))
    return rows.where(~gone), rows.agg(F.count_if(gone).alias("removed")).select(F.lit(kind).alias("kind"), "removed")


def snapshot_states(log: DataFrame) -> DataFrame:
    """Rows (id, source, scope, status, started_at, completed_at, as_of, record_count, error) of a log of snapshots
    (id, seq, at, event start | succeed | fail, source, scope, as_of, record_count, error); the last event counts."""
    last = F.max_by(F.struct("event", "at", "as_of", "record_count", "error"), "seq")
    started = F.min_by(F.struct("at", "source", "scope"), F.when(F.col("event") == "start", F.col("seq")))
    rows = log.groupBy("id").agg(last.alias("l"), started.alias("s"))
    status = F.when(F.col("l.event") == "start", "running").when(F.col("l.event") == "succeed", "succeeded").otherwise("failed")
    ok = F.col("l.event") == "succeed"
    return rows.select("id", "s.source", "s.scope", status.alias("status"), F.col("s.at").alias("started_at"), F.when(F.col("l.event") != "start", F.col("l.at")).alias("completed_at"), F.when(ok, F.col("l.as_of")).alias("as_of"), F.when(ok, F.col("l.record_count")).alias("record_count"), F.when(F.col("l.event") == "fail", F.left("l.error", F.lit(ERROR_CHARS))).alias("error"))


def recent(snapshots: DataFrame, n: int = 20) -> DataFrame:
    """The n snapshots that started last."""
    return snapshots.orderBy(F.desc("started_at"), F.desc("id")).limit(n)


def replace_alerts(entries: DataFrame) -> DataFrame:
    """The list as entries (source, ord, name, ...) leave it: of names that fold to the same the first, in order of names."""
    folded = entries.withColumn("name_folded", text.fold_for_match(F.col("name")))
    return first_of_each(folded, [F.col("source"), F.col("name_folded")], [F.col("ord")]).orderBy("name", "ord")


def latest_received(inbound: DataFrame) -> DataFrame:
    """One row: when the last of inbound (received_at, ...) came; null if none did."""
    return inbound.agg(F.max("received_at").alias("received_at"))


def investigation_states(log: DataFrame) -> DataFrame:
    """Rows (id, status, stage) of a log (id, seq, event create | stage | complete | fail, stage): stages count while it
    is queued or running, which the first one makes it; the first end counts."""
    ended = F.min(F.when(F.col("event").isin("complete", "fail"), F.col("seq")))
    log = log.withColumn("ended", ended.over(Window.partitionBy("id")))
    counted = (F.col("event") == "stage") & (F.col("ended").isNull() | (F.col("seq") < F.col("ended")))
    status = F.min_by("event", F.when(F.col("event").isin("complete", "fail"), F.struct("seq", "event")))
    rows = log.groupBy("id").agg(F.max_by("stage", F.when(counted, F.col("seq"))).alias("stage"), F.bool_or(counted).alias("staged"), status.alias("end"))
    return rows.select("id", F.when(F.col("end") == "complete", "completed").when(F.col("end") == "fail", "failed").when(F.col("staged"), "running").otherwise("queued").alias("status"), "stage")


def refreshed(categories: DataFrame, least: int = 1) -> DataFrame:
    """Rows (scope, ok, as_of, error) of exports (scope, part, as_of, records, error): a scope is refreshed if all its
    parts came and have `least` records together; its date is the earliest of theirs. Others keep what they had."""
    g = categories.groupBy("scope").agg(F.min("as_of").alias("as_of"), F.sum("records").alias("records"), F.min(F.struct("part", "error")).alias("x"), F.max("error").alias("error"))
    ok = F.col("error").isNull() & (F.coalesce("records", F.lit(0)) >= least)
    return g.select("scope", ok.alias("ok"), F.when(ok, F.col("as_of")).alias("as_of"), F.when(~ok, F.coalesce("error", F.format_string("unexpectedly few entries (%d)", F.coalesce("records", F.lit(0))))).alias("error"))


def refresh_due(latest: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """One row: whether the registers are to be loaded: none are, or the oldest of the latest snapshots is too old."""
    oldest = F.min("completed_at")
    return latest.agg((oldest.isNull() | (oldest < now - F.expr(f"INTERVAL {hours} HOURS"))).alias("due"))


def routes(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows (message_id, key, locale, command) of messages (message_id, key, text, n_media): which way each goes.

    The locale is the session's, else Hindi for texts in Devanagari, else English; messages with media are no commands.
    """
    m = messages.join(sessions.select("key", F.col("locale").alias("own")), "key", "left")
    locale = F.coalesce("own", F.when(text.has_devanagari(F.coalesce("text", F.lit(""))), "hi").otherwise("en"))
    return m.select("message_id", "key", locale.alias("locale"), F.when(F.col("n_media") == 0, command(F.col("text"))).alias("command"))


def collected(events: DataFrame, gap: float = 5.0, cap: float = 20.0, most: int = 8) -> DataFrame:
    """Rows (key, start, closes, message_ids, dropped) of messages (key, at, message_id) as they are collected.

    A window closes `gap` seconds after its last message, and `cap` seconds after its first one at the latest; a message
    at the close begins the next. It holds `most` messages, further ones are dropped. Messages without longer gaps lie
    in one task in their order, which holds one window at a time.
    """
    ship(events.sparkSession)
    events = events.select("key", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "message_id")
    own = Window.partitionBy("key").orderBy("at", "message_id")
    apart = F.coalesce(F.col("at") - F.lag("at").over(own) >= int(gap * 1e6), F.lit(True))
    runs = events.select("key", "at", "message_id", F.sum(F.when(apart, 1).otherwise(0)).over(own).alias("run"))
    dealt = runs.repartition("key", "run").sortWithinPartitions("key", "run", "at", "message_id").select("key", "run", "at", "message_id")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None  # key, run, start, last, messages, dropped
        out: list[list] = []

        def flushed() -> pa.RecordBatch:
            rows = [(k, a, min(z + int(gap * 1e6), a + int(cap * 1e6)), ids, d) for k, _, a, z, ids, d in out]
            out.clear()
            columns = [*zip(*rows)] or [[]] * 5
            kinds = (pa.string(), pa.timestamp("us", tz="UTC"), pa.timestamp("us", tz="UTC"), pa.list_(pa.string()), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "start", "closes", "message_ids", "dropped"])

        for batch in batches:
            for key, run, at, message in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if now is None or now[:2] != [key, run] or at >= now[2] + int(cap * 1e6):
                    if now:
                        out.append(now)
                    now = [key, run, at, at, [], 0]
                now[3] = at
                if len(now[4]) < most:
                    now[4].append(message)
                else:
                    now[5] += 1
            yield flushed()
        if now:
            out.append(now)
        yield flushed()

    columns = [F.col("key").cast("string"), "run", "at", F.col("message_id").cast("string")]
    return dealt.select(*columns).mapInArrow(windows, "key string, start timestamp, closes timestamp, message_ids array<string>, dropped int")


def admitted(collected: DataFrame, most: int = 15, seconds: int = 3600) -> DataFrame:
    """collected (key, closes, ...) with `admitted`: whether fewer than `most` of the key's were admitted in the time before.

    Refused ones don't count, so that each key is folded in order. After a pause of `seconds` a key starts anew; what lies
    between pauses is in one task, which holds `most` times.
    """
    ship(collected.sparkSession)
    at = F.unix_micros(F.col("closes").cast("timestamp"))
    rows = collected.select("*", at.alias("_at"), F.monotonically_increasing_id().alias("_row"))
    own = Window.partitionBy("key").orderBy("_at", "_row")
    fresh = F.coalesce(F.col("_at") - F.lag("_at").over(own) >= seconds * 1_000_000, F.lit(True))
    runs = rows.withColumn("_run", F.sum(F.when(fresh, 1).otherwise(0)).over(own))
    dealt = runs.repartition("key", "_run").sortWithinPartitions("key", "_run", "_at", "_row")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, quota = None, Quota(most, seconds)
        for batch in batches:
            out = []
            for key, run, time in zip(*(batch.column(c).to_pylist() for c in ("key", "_run", "_at"))):
                if (key, run) != now:
                    now, quota = (key, run), Quota(most, seconds)
                out.append(quota(time))
            kept = [n for n in batch.schema.names if n not in ("_at", "_row", "_run")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(out, pa.bool_())], [*kept, "admitted"])

    return dealt.mapInArrow(folded, StructType([*collected.schema, StructField("admitted", BooleanType())]))


def shapes(messages: DataFrame, most: int = 12) -> DataFrame:
    """Rows (id, n_parts, kinds map) of messages (id, parts): what is kept of an input, its shape and not its content."""
    kinds = F.slice(F.transform("parts", lambda p: p["kind"]), 1, most)
    tally = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k.alias("key"), F.size(F.filter(kinds, lambda x: x == k)).alias("value"))))
    return messages.select("id", F.size(kinds).alias("n_parts"), tally.alias("kinds"))

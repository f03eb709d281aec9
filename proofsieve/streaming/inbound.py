"""Messages as a stream: each once, grouped into sessions, limited in rate. All work on batches as well."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from proofsieve.quota import Quota
from proofsieve.session import ship


def each_once(events: DataFrame, key: str, at: str, keep: str = "14 days") -> DataFrame:
    """The events, repeated keys dropped: within the watermark `keep` on a stream, the earliest ones on a batch."""
    if events.isStreaming:
        return events.withWatermark(at, keep).dropDuplicatesWithinWatermark([key])
    first = F.row_number().over(Window.partitionBy(key).orderBy(at, F.to_json(F.struct("*"))))
    return events.select(F.struct("*").alias("row"), first.alias("n")).where("n = 1").select("row.*")


def sessions(events: DataFrame, user: str, at: str, gap: str = "5 seconds", late: str = "20 seconds") -> DataFrame:
    """Rows (user, start, end, n): the events of a user without a longer gap between them."""
    watermarked = events.withWatermark(at, late) if events.isStreaming else events
    return watermarked.groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


COLLECTED = "key string, start timestamp, closes timestamp, message_ids array<string>, dropped int"


def collect_stream(events: DataFrame, gap: float = 5.0, cap: float = 20.0, most: int = 8, late: str = "1 minute") -> DataFrame:
    """Rows COLLECTED of a stream of messages (key, at, message_id): each window once it has closed.

    A window closes `gap` seconds after its last message, `cap` after its first at the latest, when the watermark passes;
    it holds `most` messages, further ones are dropped. A key's state is its open window.
    """
    wait, longest = pd.Timedelta(seconds=gap), pd.Timedelta(seconds=cap)

    def close(key: tuple, w: tuple) -> pd.DataFrame:
        start, last, ids, dropped = w
        return pd.DataFrame({"key": [key[0]], "start": [start], "closes": [min(last + wait, start + longest)], "message_ids": [list(ids)], "dropped": [dropped]})

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = None
        if state.exists:
            start, last, ids, dropped = state.get
            now = (pd.Timestamp(start, unit="us"), pd.Timestamp(last, unit="us"), list(ids), dropped)
        if state.hasTimedOut:
            state.remove()
            yield close(key, now)
            return
        for at, message in sorted((r.at, r.message_id) for b in batches for r in b.itertuples()):
            if now and at >= min(now[1] + wait, now[0] + longest):
                yield close(key, now)
                now = None
            if now is None:
                now = (at, at, [message], 0)
            elif len(now[2]) < most:
                now = (now[0], max(now[1], at), [*now[2], message], now[3])
            else:
                now = (now[0], max(now[1], at), now[2], now[3] + 1)
        state.update((int(now[0].value // 1000), int(now[1].value // 1000), now[2], now[3]))
        due = int(min(now[1] + wait, now[0] + longest).value // 1_000_000)
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    own = events.select(F.col("key").cast("string"), F.col("at").cast("timestamp"), F.col("message_id").cast("string")).withWatermark("at", late)
    return own.groupBy("key").applyInPandasWithState(step, COLLECTED, "start long, last long, ids array<string>, dropped int", "append", "EventTimeTimeout")


class Collector(StatefulProcessor):
    """Collects a key's messages into windows, as collect_stream() does, and admits windows by a quota.

    State is the open window and the times of what was admitted; a timer closes the window when the watermark passes.
    """

    def __init__(self, gap: float, cap: float, most: int, quota: int, seconds: int):
        self.gap, self.cap, self.most, self.quota, self.seconds = int(gap * 1e6), int(cap * 1e6), most, quota, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, last long, ids array<string>, dropped int")
        self.admitted = handle.getListState("admitted", "at long")

    def due(self, w: tuple) -> int:
        return min(w[1] + self.gap, w[0] + self.cap)

    def closed(self, key: tuple, w: tuple, quota: Quota) -> tuple:
        at = self.due(w)
        return key[0], pd.Timestamp(w[0], unit="us"), pd.Timestamp(at, unit="us"), list(w[2]), w[3], quota(at)

    def rows(self, out: list[tuple], quota: Quota) -> Iterator[pd.DataFrame]:
        if out:
            self.admitted.put([(at,) for at in quota.times])
            yield pd.DataFrame(out, columns=["key", "start", "closes", "message_ids", "dropped", "admitted"])

    def known(self) -> Quota:
        return Quota(self.quota, self.seconds, [at for (at,) in self.admitted.get()])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        w = tuple(self.window.get()) if self.window.exists() else None
        quota, out = self.known(), []
        for at, message in sorted((r.at.value // 1000, r.message_id) for b in rows for r in b.itertuples()):
            if w and at >= self.due(w):
                out.append(self.closed(key, w, quota))
                w = None
            if w is None:
                w = (at, at, [message], 0)
            else:
                room = len(w[2]) < self.most
                w = (w[0], max(w[1], at), [*w[2], message] if room else w[2], w[3] + (not room))
        self.window.update(w)
        self.handle.registerTimer(-(-self.due(w) // 1000))
        yield from self.rows(out, quota)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        w = tuple(self.window.get()) if self.window.exists() else None
        if w and self.due(w) <= expiredTimerInfo.getExpiryTimeInMs() * 1000:  # else the window has grown, and has a later timer
            quota = self.known()
            out = [self.closed(key, w, quota)]
            self.window.clear()
            yield from self.rows(out, quota)

    def close(self) -> None:
        pass


def admit_stream(events: DataFrame, gap: float = 5.0, cap: float = 20.0, most: int = 8, quota: int = 15, seconds: int = 3600, late: str = "1 minute") -> DataFrame:
    """Rows COLLECTED, and `admitted`, of a stream of messages (key, at, message_id): each window once it has closed, and
    whether fewer than `quota` of the key's were admitted in the seconds before. Needs the RocksDB state store."""
    ship(events.sparkSession)
    own = events.select(F.col("key").cast("string"), F.col("at").cast("timestamp"), F.col("message_id").cast("string")).withWatermark("at", late)
    return own.groupBy("key").transformWithStateInPandas(Collector(gap, cap, most, quota, seconds), COLLECTED + ", admitted boolean", "Append", "EventTime")


def recent_counts(events: DataFrame, user: str, at: str, seconds: int = 3600) -> DataFrame:
    """events with `recent`: how many of the user's lie within the seconds up to each, itself included."""
    order = F.unix_micros(F.col(at).cast("timestamp"))
    back = Window.partitionBy(user).orderBy(order).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(back))


def rate_counts(events: DataFrame, user: str, at: str, every: str = "1 minute", late: str = "20 seconds") -> DataFrame:
    """Rows (user, start, n) of fixed windows."""
    watermarked = events.withWatermark(at, late) if events.isStreaming else events
    return watermarked.groupBy(user, F.window(at, every).alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), "n")


# What each command is written as.
COMMANDS = {
    "help": "hi hello hey help start menu namaste namaskar नमस्ते नमस्कार मदद हेल्प".split(),
    "hindi": "hindi हिंदी हिन्दी".split(),
    "english": "english angrezi इंग्लिश अंग्रेज़ी अंग्रेजी".split(),
    "paid": ["paid", "i paid", "already paid", "i already paid", "payment done", "maine paise bhej diye", "paise bhej diye", "पेमेंट कर दिया", "पैसे भेज दिए", "भुगतान कर दिया"],
    "delete": ["delete", "forget", "forget me", "delete my data", "डिलीट", "मिटाओ", "मिटा दो"],
    "report": ["report", "link", "full report", "रिपोर्ट"],
}


def command(text: Column) -> Column:
    """The command that a message is, or null: all of it, whatever its case, with punctuation after it."""
    word = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[!.?।\s]+$", ""), r"\s+", " ")
    found = F.when(F.length(word) > 40, None).when(word.rlike("^join [a-z]+(-[a-z]+)*$"), "join")
    for name, words in COMMANDS.items():
        found = found.when(word.isin(*words), name)
    return found


def queue_state(log: DataFrame, now: Column, lease_seconds: int = 300, max_attempts: int = 3) -> DataFrame:
    """The last state of each job of log (job_id, ts, event): pending, running, done or failed.

    A job that runs longer than its lease is pending again; one that fails is, too, until its attempts are used up.
    """
    state = log.groupBy("job_id").agg(F.max_by("event", F.struct("ts", "event")).alias("last"), F.max("ts").alias("at"), F.count_if(F.col("event") == "start").alias("attempts"))
    expired = F.col("at") <= now - F.expr(f"INTERVAL {lease_seconds} SECONDS")
    status = (
        F.when(F.col("last") == "done", "done")
        .when((F.col("last") == "fail") & (F.col("attempts") >= max_attempts), "failed")
        .when((F.col("last") == "start") & ~expired, "running")
        .otherwise("pending")
    )
    return state.select("job_id", "attempts", "at", status.alias("status"))

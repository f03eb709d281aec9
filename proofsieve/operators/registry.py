"""Registers: snapshots and their replacement, merging of records, lookups by number and by name, alert lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from sys import intern

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofsieve.functions import identifiers, text
from proofsieve.session import checkpointed, ship, small_side


def latest_per_scope(snapshots: DataFrame) -> DataFrame:
    """The last successful row of each scope of snapshots (id, scope, status, completed_at, ...)."""
    newest = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("completed_at"), F.desc("id")))
    ranked = snapshots.where("status = 'succeeded'").select(F.struct("*").alias("row"), newest.alias("n"))
    return ranked.where("n = 1").select("row.*")


def freshness(latest: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """One row over latest (as_of, completed_at): the most frequent date, the latest of several, the oldest load, whether stale."""
    dates = latest.groupBy("as_of").count().agg(F.max_by("as_of", F.struct("count", "as_of")).alias("as_of"))
    loads = latest.agg(F.min("completed_at").alias("retrieved_at"), F.count("*").alias("scopes"))
    old = F.col("retrieved_at").isNull() | (F.col("retrieved_at") < now - F.expr(f"INTERVAL {hours} HOURS"))
    return dates.join(F.broadcast(loads)).select("as_of", "retrieved_at", "scopes", old.alias("stale"))  # one row each


def replace_category(old: DataFrame, new: DataFrame) -> DataFrame:
    """What an atomic replacement of old by new (key, payload) does to each key: inserted, updated, kept or removed."""
    a, b = old.select("key", F.col("payload").alias("before"), F.lit(True).alias("had")), new.select("key", F.col("payload").alias("after"), F.lit(True).alias("has"))
    joined = a.join(b, "key", "full")
    change = F.when(F.col("had").isNull(), "inserted").when(F.col("has").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "kept").otherwise("updated")
    return joined.select("key", "before", "after", change.alias("change"))


def merge_records(rows: DataFrame) -> DataFrame:
    """One record for each (category, registration_no) of rows (ord, name, email, valid_from, valid_to, ...).

    Names and emails are united in the order of ord; validity runs from the first start to the last end, without end
    if any row has none.
    """
    in_order = lambda c: F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c]), lambda x: x.isNotNull()))
    until = F.when(F.bool_or(F.col("valid_to").isNull()), F.lit(None)).otherwise(F.max("valid_to"))
    return rows.groupBy("category", "registration_no").agg(in_order("name").alias("names"), in_order("email").alias("emails"), F.min("valid_from").alias("valid_from"), until.alias("valid_to"), F.count("*").alias("n_rows"))


def is_active(valid_to: Column, now: Column) -> Column:
    """Whether a registration holds at `now` (UTC): without end, or to the end of that day in India."""
    return valid_to.isNull() | (F.to_utc_timestamp(valid_to.cast("timestamp") + F.expr("INTERVAL '23:59:59' HOUR TO SECOND"), "Asia/Kolkata") >= now)


def lookup_numbers(numbers: DataFrame, registry: DataFrame) -> DataFrame:
    """numbers (normalized, ...) left-joined with registry (registration_no, ...); a register within the bound is broadcast."""
    return numbers.join(small_side(registry), numbers["normalized"] == registry["registration_no"], "left")


def variant_hits(numbers: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows (msg_id, normalized, hits): the registered numbers that an unregistered one may be a misreading of."""
    known = small_side(registry.select(F.col("registration_no").alias("variant")).distinct())
    missing = numbers.join(known, F.col("normalized") == F.col("variant"), "left_anti")
    tried = missing.select("msg_id", "normalized", F.explode(identifiers.confusable_variants(F.col("normalized"))).alias("variant"))
    return tried.join(known, "variant").groupBy("msg_id", "normalized").agg(F.array_sort(F.collect_set("variant")).alias("hits"))


#: Names that a query's rarest pairs of trigrams may have, to find out how like the best are; it changes the cost only.
FIRST = 100


def trigrams(c: Column) -> Column:
    """The trigrams of a folded text's words, each once: a word has two blanks before it and one behind."""
    words = F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


@lru_cache(maxsize=100_000)
def ordered_trigrams(text_: str) -> tuple[str, ...]:
    """The trigrams of a folded text's words, in their order; a worker remembers those of names that come again."""
    return tuple(intern(w[i : i + 3]) for word in regex.findall(r"[\p{L}\p{N}]+", text_) for w in [f"  {word} "] for i in range(len(w) - 2))


@lru_cache(maxsize=100_000)
def _distinct(wanted: tuple[str, ...]) -> frozenset[str]:
    return frozenset(wanted)


@lru_cache(maxsize=100_000)
def _ends(given: tuple[str, ...]) -> tuple[dict[str, int], dict[str, int]]:
    """Where each trigram stands first and last."""
    return {g: k for k, g in reversed([*enumerate(given)])}, {g: k for k, g in enumerate(given)}


def extent_similarity(wanted: Sequence[str], given: Sequence[str], floor: float = 0.0) -> float:
    """The greatest similarity of a set of trigrams and a contiguous extent of others: what they share of what either has.
    If that is less than `floor`, it may be anything less.

    The best extent begins and ends with a trigram that is wanted. From each such end, the last first, extents grow to the left.
    """
    own = _distinct(wanted if isinstance(wanted, tuple) else tuple(wanted))
    if floor:
        common = own.intersection(given)
        if len(common) < len(own) * floor - 1e-9:
            return 0.0
        # An extent with all of them holds what else stands between the first to end and the last to begin; others have one less.
        first, last = _ends(given if isinstance(given, tuple) else tuple(given))
        between = set(given[min(map(last.__getitem__, common)) : max(map(first.__getitem__, common)) + 1]) - own if common else ()
        if max(len(common) / (len(own) + len(between)), (len(common) - 1) / len(own)) < floor - 1e-9:
            return 0.0
    hits = [k for k, g in enumerate(given) if g in own]
    if hits and hits[-1] - hits[0] + 1 == len(own) == len(hits) and len(set(given[hits[0] : hits[-1] + 1])) == len(own):
        return 1.0
    best = max(floor - 1e-9, 0.0)
    for n in range(len(hits) - 1, -1, -1):
        if (n + 1) / len(own) <= best:  # so many are shared at most
            break
        seen: set[str] = set()
        shared, at = 0, hits[n]
        for start in reversed(hits[: n + 1]):
            while at >= start:
                if given[at] not in seen:
                    seen.add(given[at])
                    shared += given[at] in own
                at -= 1
            best = max(best, shared / (len(own) + len(seen) - shared))
            if len(own) / max(len(own), len(seen)) <= best:  # longer extents hold too much else
                break
    return best


def word_similarity(query: Column, name: Column) -> Column:
    """How like a folded query is to the best stretch of a folded name, by trigrams: 0 to 1."""
    return similarity_from(query, name, F.lit(0.0))


def similarity_from(query: Column, name: Column, floor: Column) -> Column:
    """The same; if it is less than a floor, anything less. It is computed once, where it stands: conditions on it are not moved
    to before what thins out the pairs."""
    ship(SparkSession.active())

    @F.pandas_udf("double")
    def of(queries: pd.Series, names: pd.Series, floors: pd.Series) -> pd.Series:
        return pd.Series([None if q is None or n is None else extent_similarity(ordered_trigrams(q), ordered_trigrams(n), f) for q, n, f in zip(queries, names, floors.fillna(0.0))], dtype="float64")

    return of.asNondeterministic()(query, name, floor)


def search_names(queries: DataFrame, registry: DataFrame, least: float = 0.6, top: int = 5) -> DataFrame:
    """Rows (query, registration_no, similarity, place): the `top` names of registry (registration_no, name) like each query.

    Queries in Devanagari are put into Latin letters, both are folded. A name is found if its word similarity is `least`
    or more, or if it holds the query, and ordered by that similarity, then by number. What is as like as one of the best
    matches shares so many trigrams with the query that it has two of its rarest ones, however many those must be; names are
    looked up by such pairs, so that none is lost and common trigrams pair nothing. What is joined are names that differ,
    by a number for each. Queries of less than three letters find nothing.
    """
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folded = checkpointed(registry.select("registration_no", "name").repartition(parts, "registration_no").select("registration_no", text.fold_for_match(F.col("name")).alias("name")))
    hashed = lambda c: F.transform(trigrams(c), lambda g: F.xxhash64(g))
    names = folded.select("name").distinct().repartition(parts, "name").select(F.xxhash64("name").alias("id"), "name", hashed(F.col("name")).alias("grams"))
    names = checkpointed(names)
    counts = names.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("of"))
    latin = queries.select(F.col("query").alias("asked")).repartition(parts, "asked").select("asked", text.fold_for_match(text.name_to_latin(F.col("asked"))).alias("query")).where(F.length("query") >= 3).distinct()
    latin = checkpointed(latin)
    each = latin.select("query").distinct().select("query", F.explode(hashed(F.col("query"))).alias("gram")).join(counts, "gram", "left")
    asked = each.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("of", F.lit(0)).alias("of"), "gram"))).alias("rare"))
    asked = asked.select("query", F.transform("rare", lambda x: x["gram"]).alias("rare"), F.size("rare").alias("size"))
    # A name that holds the query may split its first and last words: it lacks three trigrams at most.
    share = F.greatest(F.least(F.ceil(F.col("size") * least - 1e-9), F.col("size") - 3), F.lit(1)).cast("int")
    asked = checkpointed(asked.withColumn("share", share))

    # Of the rarest trigrams, all but share - 2 of them, such names have two; one, where they need not share more.
    key = lambda g, h: F.xxhash64(F.least(g, h), F.greatest(g, h))
    rarest = F.slice("rare", F.lit(1), F.least(F.col("size") - F.col("share") + 2, F.col("size")))
    keyed = lambda of, alone: F.flatten(F.transform(of, lambda h, j: F.transform(F.slice(of, F.lit(1), j + alone), lambda g: F.struct(key(g, h).alias("key"), (j + 1).alias("last")))))
    wanted = asked.select("query", "size", F.inline(keyed(rarest, F.when(F.col("share") > 1, 0).otherwise(1))))
    used = asked.select(F.explode(rarest).alias("gram")).distinct()
    own = names.select("id", F.explode("grams").alias("gram")).join(small_side(used), "gram").groupBy("id").agg(F.collect_list("gram").alias("own"))
    held = own.select("id", F.explode(keyed(F.col("own"), F.lit(1))["key"]).alias("key")).join(small_side(wanted.select("key").distinct()), "key")
    held = checkpointed(held.select("key", "id").repartition(parts, "key"))
    wanted = checkpointed(wanted.join(held.groupBy("key").agg(F.count("*").alias("of")), "key").repartition(parts, "key"))
    known, told = small_side(names), small_side(asked)

    def near(probes: DataFrame, bar: Column) -> DataFrame:
        """Pairs (query, name, both, bar) of queries and names that have one of their probes (query, key) and share enough
        trigrams, both, to be like each other, `bar` or more where a query has one."""
        pairs = probes.withColumn("bar", bar).join(held, "key").drop("key").join(told, "query").join(known, "id")
        asks, holds = F.coalesce("bar", F.lit(least)), F.col("bar").isNull() & F.contains("name", "query")
        pairs = pairs.withColumn("both", F.size(F.array_intersect("rare", "grams")))
        return pairs.where(holds | (F.col("both") >= F.ceil(F.col("size") * asks - 1e-9))).select("query", "name", "both", "bar").distinct()

    def like(pairs: DataFrame, barred: bool) -> DataFrame:
        pairs = pairs.select("query", "name", "bar").repartition(parts, "query", "name")  # short rows, but much work for each
        similarity = similarity_from(F.col("query"), F.col("name"), F.col("bar")) if barred else word_similarity(F.col("query"), F.col("name"))
        rated = pairs.select("query", "name", "bar", similarity.alias("similarity"))
        return rated.where((F.col("similarity") >= F.coalesce("bar", F.lit(least))) | (F.col("bar").isNull() & F.contains("name", "query"))).drop("bar")

    # Of the names that the rarest pairs find, those that share most say how like the last of the best names is at least; a
    # query that they find too few names for keeps all pairs.
    by_query = Window.partitionBy("query")
    before = F.coalesce(F.sum("of").over(by_query.orderBy("of", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rarer = wanted.withColumn("before", before).where((F.col("before") < FIRST) & (F.col("of") <= 4 * FIRST)).select("query", "key")
    shares_most = F.row_number().over(by_query.orderBy(F.desc("both"), "name"))
    first = near(rarer.repartition(parts, "key"), F.lit(None).cast("double")).withColumn("n", shares_most).where(F.col("n") <= 3 * top)
    nth = F.row_number().over(by_query.orderBy(F.desc("similarity"), "name"))
    bars = checkpointed(like(first, False).withColumn("nth", nth).where((F.col("nth") == top) & (F.col("similarity") >= least)).select("query", F.col("similarity").alias("bar")))
    fewer = F.col("size") - F.ceil(F.col("size") * F.col("bar") - 1e-9) + 2
    probes = wanted.join(small_side(bars), "query", "left").where(F.col("bar").isNull() | (F.col("last") <= fewer)).select("query", "key", "bar")
    best = like(near(probes.repartition(parts, "key"), F.col("bar")), True).withColumn("rank", F.rank().over(by_query.orderBy(F.desc("similarity")))).where(F.col("rank") <= top).drop("rank")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "registration_no"))
    found = best.join(folded, "name").select("query", "registration_no", "similarity").distinct().withColumn("place", place).where(F.col("place") <= top)
    return found.join(latin, "query").select(F.col("asked").alias("query"), "registration_no", "similarity", "place")


def match_alerts(names: DataFrame, alerts: DataFrame) -> DataFrame:
    """Rows (msg_id, name, alert): names (msg_id, name) that are an alert's name, or hold it as whole words.

    Names are folded, and all but letters and digits are blanks. Every run of words of a name, up to as many as an alert
    has, is a key, so that phrases are found by an equi-join; alerts of one word of less than eight letters match whole
    names only.
    """
    plain = lambda c: F.trim(F.regexp_replace(text.fold_for_match(c), r"[^\p{L}\p{N}]+", " "))
    folded = names.select("msg_id", "name", plain(F.col("name")).alias("plain")).select("msg_id", "name", F.filter(F.split("plain", " "), lambda w: w != "").alias("words"))
    own = checkpointed(alerts.select(F.col("name").alias("alert"), plain(F.col("name")).alias("phrase")))
    longest = own.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1  # one number
    n = F.size("words")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(n - i + 1, F.lit(longest))), lambda k: F.struct(F.array_join(F.slice("words", i, k), " ").alias("phrase"), (k == n).alias("whole")))))
    phrases = folded.where(n > 0).select("msg_id", "name", F.explode(spans).alias("s")).select("msg_id", "name", "s.phrase", "s.whole")
    found = phrases.join(small_side(own), "phrase")
    return found.where(F.col("whole") | (F.size(F.split("phrase", " ")) >= 2) | (F.length("phrase") >= 8)).select("msg_id", "name", "alert").distinct()


def source_runs(lookups: DataFrame) -> DataFrame:
    """One row for each (msg_id, source) of lookups (ord, status, mode, ms, as_of, stale, fixture)."""
    return lookups.groupBy("msg_id", "source").agg(
        F.when(F.bool_or(F.col("status") == "ok"), "ok").otherwise("unavailable").alias("status"),
        F.count("*").alias("queries"),
        F.max("ms").alias("latency_ms"),
        F.when(F.bool_or(F.col("mode") == "live"), "live").otherwise("snapshot").alias("mode"),
        F.min_by("as_of", F.when(F.col("as_of").isNotNull(), F.struct("ord", "as_of"))).alias("as_of"),
        F.bool_and("stale").alias("stale"),
        F.bool_or("fixture").alias("fixture"),
    )

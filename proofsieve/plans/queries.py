"""Queries over the tables at hand, one or more for each family of operators, and the same in SQL for comparison.

Messages are the documents, each with a line of a firm's wording; registers, snapshots, queues and lookups are made of
the other tables. What makes them is written once, in SQL that either engine reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsieve.functions import identifiers, numbering, phrases, text
from proofsieve.operators import adjudicate, registry
from proofsieve.plans.base import NOW, QUERIES, SQL, made, now, query, table
from proofsieve.streaming import inbound

LINE = """CASE doc_id % 8
 WHEN 0 THEN 'We are SEBI registered by Supplier#' || lpad(CAST(1 + doc_id % 130 AS STRING), 9, '0') || ', INH' || lpad(CAST(doc_id % 150 AS STRING), 9, '0') || '. Guaranteed returns 10% weekly on stocks. Pay desk.ra@validhdfc'
 WHEN 1 THEN 'Call +91 98765 4' || lpad(CAST(doc_id % 10000 AS STRING), 4, '0') || ' or 9123456789. Mail Desk' || CAST(doc_id % 9 AS STRING) || '@gmail.com, ra@firm' || CAST(doc_id % 7 AS STRING) || '.example.com'
 WHEN 2 THEN 'Number INA OOOOOOl' || lpad(CAST(doc_id % 100 AS STRING), 2, '0') || ' of Suplier#' || lpad(CAST(1 + doc_id % 130 AS STRING), 9, '0') || '. Risk-free, 2.5% per month in FD. Hurry, limited seats'
 WHEN 3 THEN 'Not guaranteed returns but 12% a year. Pay 98765432' || lpad(CAST(doc_id % 100 AS STRING), 2, '0') || '@ybl to A/c no. 1234 5678 ' || lpad(CAST(doc_id % 10000 AS STRING), 4, '0')
 WHEN 4 THEN 'See https://www.bit.ly/x' || CAST(doc_id % 50 AS STRING) || ', http://10.0.0.' || CAST(doc_id % 200 AS STRING) || '/app.apk. Download our app and share OTP'
 WHEN 5 THEN 'INZ' || lpad(CAST(doc_id % 150 AS STRING), 9, '0') || ' and INP-' || lpad(CAST(doc_id % 150 AS STRING), 9, '0') || ' by Supplier#' || lpad(CAST(1 + doc_id % 130 AS STRING), 9, '0')
 WHEN 6 THEN 'Keep this secret: zero loss trading, account number 00998877665' || CAST(doc_id % 10 AS STRING)
 ELSE 'Thanks, see you.' END"""
MESSAGES = f"SELECT doc_id AS msg_id, coalesce(text, '') || chr(10) || {LINE} AS text FROM documents"
CATEGORY = "CASE s_suppkey % 4 WHEN 0 THEN 'RA' WHEN 1 THEN 'IA' WHEN 2 THEN 'BROKER' ELSE 'PMS' END AS category"
NUMBER = "CASE s_suppkey % 4 WHEN 0 THEN 'INH' WHEN 1 THEN 'INA' WHEN 2 THEN 'INZ' ELSE 'INP' END || lpad(CAST(s_suppkey AS STRING), 9, '0') AS registration_no"
REGISTRY = f"SELECT {NUMBER}, {CATEGORY}, s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN DATE '2021-12-31' WHEN s_suppkey % 3 = 0 THEN NULL ELSE DATE '2027-06-30' END AS valid_to FROM supplier"
M = f"WITH m AS ({MESSAGES}) "


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, MESSAGES)


def alone(words: str) -> str:
    """A pattern with look-arounds in the dialect without them: ends of words as characters that it takes in."""
    ends = r"[^\p{L}\p{M}\p{N}]"
    return words.replace(phrases.L, f"(?:^|{ends})").replace(phrases.R, f"(?:{ends}|$)")


def quoted(words: str) -> str:
    return "'" + words.replace("'", "''") + "'"


@query(M + r"""SELECT DISTINCT msg_id, 'IN' || upper(substring(x, 3, 1)) || translate(regexp_replace(substring(x, 4), '[ \t:.\-]', '', 'g'), 'OoDQIl|iSsBZzG', '00001111558226') AS normalized,
 CASE upper(substring(x, 3, 1)) WHEN 'H' THEN 'SEBI_RA' WHEN 'A' THEN 'SEBI_IA' WHEN 'Z' THEN 'SEBI_BROKER' WHEN 'P' THEN 'SEBI_PMS' ELSE 'SEBI_MB' END AS scheme, length(regexp_replace(substring(x, 4), '[ \t:.\-]', '', 'g')) = 9 AS format_valid,
 regexp_matches(substring(x, 4), '[A-Za-z|]') OR x[1:2] <> 'IN' AS reinterpreted
 FROM (SELECT msg_id, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9])([I1l][Nn][HAZPMhazpm][ \t:.\-–]{0,3}(?:[0-9OoDQIl|iSsBZzG][ \t\-]?){8,10}[0-9OoDQIl|iSsBZzG])(?:[^A-Za-z0-9]|$)', 1)) AS x FROM m)""")
def extract_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("msg_id", F.inline(identifiers.registration_numbers(F.col("text")))).select("msg_id", "normalized", "scheme", "format_valid", "reinterpreted")


@query(M + r"""SELECT msg_id, array_to_string(list_sort(list_distinct(list_concat(list_transform(list_filter(regexp_extract_all(text, '(?:^|[^\w.@])(\+[0-9][0-9() .-]{6,18}[0-9])', 1), lambda x: regexp_full_match(regexp_replace(x, '[^0-9]', '', 'g'), 'PLAN')), lambda x: '+' || regexp_replace(x, '[^0-9]', '', 'g')),
   list_transform(regexp_extract_all(regexp_replace(text, '\+[0-9][0-9() .-]{6,18}[0-9]', ' ', 'g'), '(?:^|[^\w.@+])((?:0|91[ -]?)?[6-9][0-9]{4}[ -]?[0-9]{5})(?:[^0-9@]|$)', 1), lambda x: '+91' || right(regexp_replace(x, '[^0-9]', '', 'g'), 10))))), ',') AS phones,
 array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_.-])([A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24})(?:[^A-Za-z0-9_-]|$)', 1), lambda x: lower(x)))), ',') AS emails,
 array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_.@-])([A-Za-z0-9][A-Za-z0-9._-]{1,255}@(?:ybl|validhdfc))(?:[^A-Za-z0-9_.@]|$)', 1), lambda x: lower(x)))), ',') AS upis,
 array_to_string(list_sort(list_distinct(list_transform(list_filter(list_transform(regexp_extract_all(text, '(?i)(?:a/c|acc(?:ount)?\.?|acct)\s*(?:no\.?|number|num|#)?\s*[:-]?\s*([0-9][0-9\s-]{7,20}[0-9])', 1), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda d: length(d) BETWEEN 9 AND 18), lambda d: 'XXXX' || right(d, 4)))), ',') AS accounts FROM m""".replace("PLAN", numbering.pattern()))
def extract_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    flat = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    m = messages(spark, sf_dir).select("msg_id", "text", identifiers.others(t).alias("found"))
    found = F.col("found")
    return m.select("msg_id", flat(identifiers.phones(t)["e164"]).alias("phones"), flat(identifiers.emails(t, found)["address"]).alias("emails"), flat(identifiers.upi_ids(t, found)["value"]).alias("upis"), flat(identifiers.bank_accounts(t, found)["masked"]).alias("accounts"))


@query(M + r"""SELECT DISTINCT msg_id, regexp_replace(url, '^(https?://[^/?#]+)$', '\1/') AS href, host, host IN ('bit.ly') AS shortener, regexp_matches(lower(url), '\.apk(?:$|[?#])') AS apk, regexp_full_match(host, '[0-9]{1,3}(\.[0-9]{1,3}){3}') AS ip_host
 FROM (SELECT msg_id, url, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS host FROM (SELECT msg_id, regexp_replace(unnest(regexp_extract_all(text, '(https?://[^\s<>"]+)', 1)), '[.,;:!?)]+$', '') AS url FROM m))""")
def extract_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.urls(messages(spark, sf_dir)).where("raw LIKE 'http%'").select("msg_id", "href", "host", "shortener", "apk", "ip_host")


@query(M + "SELECT DISTINCT msg_id, period, percent, CAST(round(percent * CASE period WHEN 'day' THEN 365 WHEN 'week' THEN 52 WHEN 'month' THEN 12 WHEN 'year' THEN 1 END) AS BIGINT) AS annual_percent FROM (" + " UNION ALL ".join(f"SELECT msg_id, '{attr}' AS period, CAST(unnest(regexp_extract_all(text, {quoted('(?i)' + alone(words))}, 1)) AS DOUBLE) AS percent FROM m" for kind, attr, _, words in phrases.RULES if kind == "RETURN_RATE") + ") WHERE percent > 0")
def extract_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = messages(spark, sf_dir).select("msg_id", F.inline(phrases.phrases(F.col("text")))).where("kind = 'RETURN_RATE'")
    return p.select("msg_id", F.col("attr").alias("period"), "percent", phrases.annual_percent(F.col("percent"), F.col("attr")).alias("annual_percent")).distinct()


def _kinds_sql() -> str:
    """Kinds of phrases: each rule as it stands, negatable ones in texts from which what is negated has been cut."""
    negated = r"(?i)(?:^|[^A-Za-z0-9])(?:not|no|never|nor|cannot|can't|cant|isn't|aren't|don't|doesn't|won't|neither|without\s+any)[^A-Za-z0-9.\n][^.\n]{0,23}"
    each = []
    for kind, attr, negatable, words in phrases.RULES:
        bare = words.replace(phrases.L, "").replace(phrases.R, "")
        where = f"regexp_replace(text, {quoted(negated + bare)}, ' ', 'g')" if negatable else "text"
        if kind != "RETURN_RATE":
            each.append(f"SELECT msg_id, '{kind}' AS kind, {quoted(attr) if attr else 'NULL'} AS attr FROM m WHERE regexp_matches({where}, {quoted('(?i)' + alone(words))})")
    return M + "SELECT DISTINCT msg_id, kind, attr FROM (" + " UNION ALL ".join(each) + ")"


@query(_kinds_sql())
def phrase_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = messages(spark, sf_dir).select("msg_id", F.inline(phrases.phrases(F.col("text"))))
    return p.where("kind <> 'RETURN_RATE'").select("msg_id", "kind", "attr").distinct()


@query(M + f"""SELECT msg_id, md5(c) AS cleaned, CASE WHEN regexp_matches(c, {quoted('(?i)' + alone(phrases.MARKET))}) THEN 'market' WHEN regexp_matches(c, {quoted('(?i)' + alone(phrases.DEPOSIT))}) THEN 'deposit' ELSE 'unknown' END AS context
 FROM (SELECT msg_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfkc_text || ' 12', '[\\t ]', ' ', 'g'), ' {{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS c FROM (SELECT msg_id, text AS nfkc_text FROM m))""")
def clean_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text.clean_text(F.concat("text", F.lit("​ 1२")))
    return messages(spark, sf_dir).select("msg_id", c.alias("c")).select("msg_id", F.md5("c").alias("cleaned"), phrases.product_context(F.col("c")).alias("context"))


#: Numbers of all messages, misread ones too, and the firm that the message names.
REGISTRATION = r"SELECT msg_id, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9])([I1l]N[HAZP][ \t:.\-–]{0,3}(?:[0-9OoDQIl|iSsBZzG][ \t\-]?){8,10}[0-9OoDQIl|iSsBZzG])(?:[^A-Za-z0-9]|$)', 1)) AS raw, regexp_extract(text, '(?:by|of) (Sup+lier#[0-9]{9})', 1) AS holder FROM m"


@query(M + f""", r AS ({REGISTRY}), n AS (SELECT DISTINCT msg_id, upper(raw[1:3]) || translate(regexp_replace(raw[4:], '[ \\t:.\\-]', '', 'g'), 'OoDQIl|iSsBZzG', '00001111558226') AS normalized, regexp_matches(raw[4:], '[A-Za-z|]') AS unclear, holder FROM ({REGISTRATION})),
 j AS (SELECT n.*, r.name, r.valid_to, r.registration_no FROM n LEFT JOIN r ON normalized = registration_no)
 SELECT msg_id, normalized, CASE WHEN registration_no IS NULL AND unclear THEN 'CANT_CHECK' WHEN registration_no IS NULL THEN 'NOT_FOUND' WHEN valid_to < DATE '2026-10-04' THEN 'CONTRADICTED' WHEN len(list_filter(string_split_regex(lower(holder), '[^a-z0-9]+'), lambda t: len(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda u: t = u OR jaro_winkler_similarity(t, u) >= 0.92)) > 0)) = 2 THEN 'MATCHES' WHEN true THEN 'CANT_CHECK' END AS verdict FROM j""")
def registration_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = messages(spark, sf_dir).withColumn("holder", F.regexp_extract("text", "(?:by|of) (Sup+lier#[0-9]{9})", 1))
    numbers = named.select("msg_id", "holder", F.inline(identifiers.registration_numbers(F.col("text"))))
    joined = registry.lookup_numbers(numbers, made(spark, sf_dir, REGISTRY))
    found = F.col("registration_no").isNotNull()
    same = text.compare_tokens(text.name_tokens(F.col("holder")), text.name_tokens(F.coalesce("name", F.lit(""))))
    joined = joined.withColumn("comparison", same)
    covered = identifiers.dimension(identifiers.CATEGORY)[F.col("scheme")].isNotNull()
    reason = adjudicate.registration_reason(covered, F.col("format_valid"), ~F.col("reinterpreted"), F.lit(True), found, F.lit(False), registry.is_active(F.col("valid_to"), now()), F.when(F.col("holder") == "", "none").otherwise("inferred"), F.col("comparison"), F.col("valid_to").isNull())
    return joined.select("msg_id", "normalized", adjudicate.verdict_of(reason).alias("verdict"))


SWAPS = "CASE substring(normalized, i, 1) " + " ".join(f"WHEN '{d}' THEN {[*alts]}" for d, alts in identifiers.SWAPS.items()) + " END"


#: Registered numbers, whose first digit has been misread.
MISREAD = f"SELECT s_suppkey AS msg_id, left(registration_no, 3) || '8' || right(registration_no, 8) AS normalized FROM (SELECT s_suppkey, {NUMBER} FROM supplier)"


@query(f"""WITH r AS ({REGISTRY}), q AS ({MISREAD}),
 p AS (SELECT q.*, i, unnest({SWAPS}) AS d, generate_subscripts({SWAPS}, 1) AS k FROM q, (SELECT unnest(range(4, 13)) AS i)),
 v AS (SELECT msg_id, normalized, substring(normalized, 1, i - 1) || d || substring(normalized, i + 1) AS variant FROM p QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY i, k) <= 12)
 SELECT msg_id, normalized, string_agg(DISTINCT variant, ',' ORDER BY variant) AS hits FROM v JOIN (SELECT DISTINCT registration_no FROM r) ON variant = registration_no WHERE normalized NOT IN (SELECT registration_no FROM r) GROUP BY ALL""")
def number_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = made(spark, sf_dir, f"SELECT s_suppkey AS msg_id, {NUMBER} FROM supplier")
    misread = own.select("msg_id", F.concat(F.left("registration_no", F.lit(3)), F.lit("8"), F.right("registration_no", F.lit(8))).alias("normalized"))
    return registry.variant_hits(misread, made(spark, sf_dir, REGISTRY)).withColumn("hits", F.array_join("hits", ","))


#: Trigrams of words in their order, two blanks before each word and one behind.
GRAMS = "flatten(list_transform(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))"


@query(f"""WITH q AS (SELECT DISTINCT replace(s_name, 'Supplier', 'Suplier') AS query FROM supplier), n AS (SELECT s_suppkey, {NUMBER}, s_name AS name FROM supplier),
 g AS (SELECT query, registration_no, list_distinct({GRAMS.format(c='query')}) AS a, {GRAMS.format(c='name')} AS b FROM q, n),
 e AS (SELECT query, registration_no, len(a) AS n, a, b[i:k] AS x FROM (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM g), LATERAL (SELECT unnest(range(i, len(b) + 1)) AS k)),
 p AS (SELECT query, registration_no, max(len(list_intersect(a, x)) / (n + len(list_distinct(x)) - len(list_intersect(a, x)))) AS similarity FROM e GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, registration_no) AS place FROM p WHERE similarity >= 0.6)
 SELECT query, registration_no, similarity, CAST(place AS INT) AS place FROM k WHERE place <= 5""")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    asked = suppliers.select(F.replace("s_name", F.lit("Supplier"), F.lit("Suplier")).alias("query"))
    return registry.search_names(asked, made(spark, sf_dir, REGISTRY).select("registration_no", "name"))


@query("""WITH a AS (SELECT s_name AS alert, lower(s_name) AS p FROM supplier WHERE s_acctbal > 3000), n AS (SELECT c_custkey AS msg_id, 'The Supplier#' || lpad(CAST(c_custkey % 200 AS STRING), 9, '0') || ' Trading Desk' AS name FROM customer)
 SELECT DISTINCT msg_id, name, alert FROM n JOIN a ON contains(' ' || lower(name) || ' ', ' ' || p || ' ')""")
def alert_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = made(spark, sf_dir, "SELECT c_custkey AS msg_id, 'The Supplier#' || lpad(CAST(c_custkey % 200 AS STRING), 9, '0') || ' Trading Desk' AS name FROM customer")
    return registry.match_alerts(names, table(spark, sf_dir, "supplier").where("s_acctbal > 3000").select(F.col("s_name").alias("name")))


LOOKUPS = "SELECT l_orderkey AS msg_id, l_returnflag AS source, l_partkey AS ord, CASE WHEN l_linestatus = 'O' THEN 'ok' ELSE 'failed' END AS status, CASE WHEN l_linenumber > 3 THEN 'live' ELSE 'snapshot' END AS mode, l_quantity AS ms, CASE WHEN l_linenumber > 1 THEN CAST(l_shipdate AS DATE) END AS as_of, l_discount > 0.05 AS stale, l_tax > 0.07 AS fixture FROM lineitem"


@query(f"""WITH l AS ({LOOKUPS}) SELECT msg_id, source, CASE WHEN bool_or(status = 'ok') THEN 'ok' ELSE 'unavailable' END AS status, count(*) AS queries, max(ms) AS latency_ms,
 CASE WHEN bool_or(mode = 'live') THEN 'live' ELSE 'snapshot' END AS mode, (list(as_of ORDER BY ord, as_of) FILTER (WHERE as_of IS NOT NULL))[1] AS as_of, bool_and(stale) AS stale, bool_or(fixture) AS fixture FROM l GROUP BY msg_id, source""")
def source_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.source_runs(made(spark, sf_dir, LOOKUPS))


RECORDS = "SELECT c_mktsegment AS category, c_nationkey AS registration_no, c_custkey AS ord, c_name AS name, CASE WHEN c_custkey % 4 > 0 THEN 'd' || CAST(c_custkey % 7 AS STRING) || '@x.example.com' END AS email, CAST('2020-01-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') AS DATE) AS valid_from, CASE WHEN c_custkey % 97 > 0 THEN CAST('2027-01-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') AS DATE) END AS valid_to FROM customer"


@query(f"""WITH r AS ({RECORDS}), e AS (SELECT category, registration_no, email, min(ord) AS ord FROM r WHERE email IS NOT NULL GROUP BY ALL)
 SELECT category, registration_no, string_agg(name, ',' ORDER BY ord) AS names, (SELECT string_agg(email, ',' ORDER BY e.ord) FROM e WHERE e.category = r.category AND e.registration_no = r.registration_no) AS emails,
 min(valid_from) AS valid_from, CASE WHEN bool_or(valid_to IS NULL) THEN NULL ELSE max(valid_to) END AS valid_to, count(*) AS n_rows FROM r GROUP BY category, registration_no""")
def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = registry.merge_records(made(spark, sf_dir, RECORDS))
    return merged.withColumn("names", F.array_join("names", ",")).withColumn("emails", F.nullif(F.array_join("emails", ","), F.lit("")))


SNAPSHOTS = "SELECT o_orderkey AS id, o_orderpriority AS scope, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS completed_at, CAST(o_orderdate AS DATE) AS as_of FROM orders"


@query(f"WITH s AS ({SNAPSHOTS}) SELECT id, scope, as_of FROM s WHERE status = 'succeeded' QUALIFY row_number() OVER (PARTITION BY scope ORDER BY completed_at DESC, id DESC) = 1")
def latest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.latest_per_scope(made(spark, sf_dir, SNAPSHOTS)).select("id", "scope", "as_of")


@query(f"""WITH s AS ({SNAPSHOTS}), l AS (SELECT * FROM s WHERE status = 'succeeded' QUALIFY row_number() OVER (PARTITION BY scope ORDER BY completed_at DESC, id DESC) = 1)
 SELECT (SELECT as_of FROM l GROUP BY as_of ORDER BY count(*) DESC, as_of DESC LIMIT 1) AS as_of, count(*) AS scopes, min(completed_at) < {NOW} - INTERVAL 72 HOURS AS stale FROM l""")
def register_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.freshness(registry.latest_per_scope(made(spark, sf_dir, SNAPSHOTS)), now()).drop("retrieved_at")


@query("""WITH o AS (SELECT c_custkey AS key, c_mktsegment AS payload FROM customer WHERE c_acctbal > 2000), n AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 7 = 0 THEN 'NEW' ELSE c_mktsegment END AS payload FROM customer WHERE c_acctbal < 8000)
 SELECT coalesce(o.key, n.key) AS key, o.payload AS before, n.payload AS after, CASE WHEN o.key IS NULL THEN 'inserted' WHEN n.key IS NULL THEN 'removed' WHEN o.payload IS NOT DISTINCT FROM n.payload THEN 'kept' ELSE 'updated' END AS change FROM o FULL JOIN n ON o.key = n.key""")
def category_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = made(spark, sf_dir, "SELECT c_custkey AS key, c_mktsegment AS payload FROM customer WHERE c_acctbal > 2000")
    new = made(spark, sf_dir, "SELECT c_custkey AS key, CASE WHEN c_custkey % 7 = 0 THEN 'NEW' ELSE c_mktsegment END AS payload FROM customer WHERE c_acctbal < 8000")
    return registry.replace_category(old, new)


RESULTS = "SELECT l_orderkey AS msg_id, CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS claim_id, CASE WHEN l_quantity > 49 THEN 'REG_BELONGS_TO_OTHER' WHEN l_quantity > 47 THEN 'REG_EXPIRED' WHEN l_quantity > 40 THEN 'REG_NOT_IN_REGISTER' WHEN l_quantity > 20 THEN 'REG_MATCH' ELSE 'REG_NO_DETAILS' END AS reason FROM lineitem"
RESULT_SQL = f"""WITH x AS ({RESULTS}), r AS (SELECT *, CASE WHEN reason IN ('REG_BELONGS_TO_OTHER', 'REG_EXPIRED') THEN 'CONTRADICTED' WHEN reason = 'REG_MATCH' THEN 'MATCHES' WHEN reason = 'REG_NOT_IN_REGISTER' THEN 'NOT_FOUND' ELSE 'CANT_CHECK' END AS verdict FROM x) """


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, RESULTS).withColumn("verdict", adjudicate.verdict_of(F.col("reason")))


@query(RESULT_SQL + "SELECT msg_id, " + ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v.lower()}" for v in adjudicate.VERDICTS) + " FROM r GROUP BY msg_id")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjudicate.verdict_counts(results(spark, sf_dir))


@query(RESULT_SQL + """, f AS (SELECT o_orderkey AS msg_id, o_totalprice > 400000 AS high, o_totalprice > 300000 AS medium FROM orders), c AS (SELECT msg_id, bool_or(reason = 'REG_BELONGS_TO_OTHER') AS theirs, count(*) FILTER (WHERE verdict = 'CONTRADICTED') AS c, count(*) FILTER (WHERE verdict = 'NOT_FOUND') AS n, count(*) FILTER (WHERE verdict = 'MATCHES') AS m FROM r GROUP BY msg_id)
 SELECT coalesce(c.msg_id, f.msg_id) AS msg_id, CASE WHEN theirs THEN 'H_REG_NOT_THEIRS' WHEN c = 1 THEN 'H_CONTRADICTED_ONE' WHEN c > 1 THEN 'H_CONTRADICTED_MANY' WHEN n > 0 THEN 'H_NOT_FOUND' WHEN high THEN 'H_WARNINGS' WHEN m > 0 THEN 'H_ALL_MATCH' WHEN c IS NOT NULL THEN 'H_ONLY_CANT_CHECK' WHEN medium THEN 'H_WARNINGS' ELSE 'H_NO_CLAIMS' END AS headline FROM c FULL JOIN f ON c.msg_id = f.msg_id""")
def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = made(spark, sf_dir, "SELECT o_orderkey AS msg_id, CASE WHEN o_totalprice > 400000 THEN 'high' WHEN o_totalprice > 300000 THEN 'medium' ELSE 'info' END AS severity FROM orders")
    return adjudicate.headlines(results(spark, sf_dir), findings)


@query(RESULT_SQL + """SELECT DISTINCT msg_id, claim_id AS source, 'r-' || claim_id AS target, 'judged' AS kind FROM r UNION ALL SELECT DISTINCT msg_id, 'r-' || claim_id, 'ev-' || reason, 'rests_on' FROM r""")
def evidence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).withColumn("evidence", F.array(F.concat(F.lit("ev-"), "reason")))
    return adjudicate.graph(r.select("msg_id", "claim_id"), r)[1]


@query(RESULT_SQL + """SELECT DISTINCT msg_id, node, kind FROM (SELECT msg_id, claim_id AS node, 'claim' AS kind FROM r UNION ALL SELECT msg_id, 'r-' || claim_id, 'result' FROM r UNION ALL SELECT msg_id, 'ev-' || reason, 'evidence' FROM r)""")
def evidence_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).withColumn("evidence", F.array(F.concat(F.lit("ev-"), "reason")))
    return adjudicate.graph(r.select("msg_id", "claim_id"), r)[0]


PAYMENTS = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'upi' WHEN 'O' THEN 'upi' ELSE 'bank' END AS method, o_orderkey % 3 = 0 AS validated, CASE o_orderkey % 4 WHEN 0 THEN 'RA' WHEN 1 THEN 'OTHER' WHEN 2 THEN 'PMS' END AS category, CASE WHEN o_custkey % 2 = 0 THEN DATE '2026-01-01' ELSE DATE '2025-01-01' END AS day, CASE o_custkey % 3 WHEN 0 THEN 'deposit' WHEN 1 THEN 'market' ELSE 'unknown' END AS context FROM orders"


@query(f"""WITH p AS ({PAYMENTS}) SELECT id, CASE WHEN method <> 'upi' THEN 'BANK_OWNER_UNKNOWN' WHEN validated THEN 'UPI_VALIDATED_CHECK' WHEN category IN ('RA', 'PMS') AND day >= DATE '2025-12-08' THEN 'UPI_NOT_VALIDATED' ELSE 'UPI_OWNER_UNKNOWN' END AS payment,
 CASE WHEN context = 'deposit' THEN 'RETURNS_DEPOSIT' WHEN category IS NOT NULL THEN 'RETURNS_BY_REGISTERED' ELSE 'RETURNS_UNVERIFIABLE' END AS returns FROM p""")
def payment_and_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    p = made(spark, sf_dir, PAYMENTS)
    return p.select("id", adjudicate.payment_reason(c("method"), c("validated"), c("category"), c("day"), F.lit(True)).alias("payment"), adjudicate.returns_reason(c("context"), c("category"), F.lit("pattern")).alias("returns"))


@query("""WITH d AS (SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'zer0dha.com' WHEN 1 THEN 'zerodha-support.com' WHEN 2 THEN 'zerodha.com' WHEN 3 THEN 'zerodha.net' WHEN 4 THEN 'zerodhaa1.org' ELSE 'example.com' END AS candidate FROM supplier)
 SELECT id, candidate, candidate IN ('zer0dha.com', 'zerodha-support.com', 'zerodha.net', 'zerodhaa1.org') AS lookalike FROM d""")
def lookalike_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = made(spark, sf_dir, "SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'zer0dha.com' WHEN 1 THEN 'zerodha-support.com' WHEN 2 THEN 'zerodha.com' WHEN 3 THEN 'zerodha.net' WHEN 4 THEN 'zerodhaa1.org' ELSE 'example.com' END AS candidate FROM supplier")
    return d.select("id", "candidate", text.is_lookalike(F.col("candidate"), F.lit("zerodha.com")).alias("lookalike"))


@query("""SELECT o_orderkey AS id, CASE WHEN length(d) <= 3 THEN d WHEN length(d) <= 5 THEN substring(d, 1, length(d) - 3) || ',' || right(d, 3) WHEN length(d) <= 7 THEN substring(d, 1, length(d) - 5) || ',' || substring(d, length(d) - 4, 2) || ',' || right(d, 3) ELSE substring(d, 1, length(d) - 7) || ',' || substring(d, length(d) - 6, 2) || ',' || substring(d, length(d) - 4, 2) || ',' || right(d, 3) END AS amount,
 'Order ' || CAST(o_orderkey AS STRING) || ' of ' || o_orderpriority || '.' AS sentence FROM (SELECT *, CAST(CAST(floor(o_totalprice) AS BIGINT) * (1 + o_orderkey % 40) AS STRING) AS d FROM orders)""")
def rendered_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.floor("o_totalprice").cast("long") * (1 + F.col("o_orderkey") % 40)
    params = F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("what"), F.col("o_orderpriority"), F.lit("none"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.indian_number(amount).alias("amount"), text.fill_template(F.lit("Order {id} ({none}) of {what}."), params).alias("sentence"))


EVENTS = "SELECT event_id % 5000 AS id, user_id, event_type, ts, event_id FROM events"


@query(f"WITH e AS ({EVENTS}) SELECT id, min(ts) AS ts, count(*) AS sent FROM e GROUP BY id")
def inbound_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = made(spark, sf_dir, EVENTS)
    return inbound.each_once(e, "id", "ts").select("id", "ts").join(e.groupBy("id").agg(F.count("*").alias("sent")), "id")


@query(f"""WITH e AS ({EVENTS}), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOURS THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbound.sessions(made(spark, sf_dir, EVENTS), "user_id", "ts", "6 hours")


@query(f"WITH e AS ({EVENTS}) SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS recent FROM e")
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbound.recent_counts(made(spark, sf_dir, EVENTS), "user_id", "ts", 86_400).select("event_id", "user_id", "recent")


@query(f"WITH e AS ({EVENTS}) SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM e GROUP BY ALL")
def hourly_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbound.rate_counts(made(spark, sf_dir, EVENTS), "user_id", "ts", "1 hour")


JOBS = "SELECT user_id AS job_id, ts, CASE event_type WHEN 'view' THEN 'enqueue' WHEN 'click' THEN 'start' WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'done' ELSE 'start' END AS event FROM events"


@query(f"""WITH j AS ({JOBS}), s AS (SELECT job_id, arg_max(event, (ts, event)) AS last, max(ts) AS seen, count(*) FILTER (WHERE event = 'start') AS attempts FROM j GROUP BY job_id)
 SELECT job_id, attempts, CASE WHEN last = 'done' THEN 'done' WHEN last = 'fail' AND attempts >= 3 THEN 'failed' WHEN last = 'start' AND seen > TIMESTAMP '2024-06-01 00:00:00' - INTERVAL 300 SECONDS THEN 'running' ELSE 'pending' END AS status FROM s""")
def queue_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbound.queue_state(made(spark, sf_dir, JOBS), F.expr("TIMESTAMP '2024-06-01 00:00:00'")).select("job_id", "attempts", "status")

"""Queries that check all messages from end to end. What a model has read is taken from the messages' own wording; the
register, the alert list and domain records are made of the other tables."""

from __future__ import annotations

import datetime as dt
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsieve.functions import catalog
from proofsieve.operators import answers, claims, investigate, render, report, verify
from proofsieve.plans.base import made, now, query
from proofsieve.plans.checks import segments
from proofsieve.plans.queries import MESSAGES, REGISTRY
from proofsieve.session import checkpointed, shared_path
from proofsieve.sources import reports
from proofsieve.sources.fixtures import ACCESS

GONE = "SELECT 'INP' || lpad(CAST(s_suppkey + 100 AS STRING), 9, '0') AS registration_no, s_name AS name, 'Portfolio Manager' AS category_label, 'Cancelled' AS status FROM supplier"
DOMAINS = "SELECT 'firm' || CAST(p_partkey AS STRING) || '.example.com' AS domain, CASE WHEN p_size % 10 = 0 THEN 'not_found' ELSE 'found' END AS status, TIMESTAMP '2026-10-01 00:00:00' - INTERVAL 1 DAY * (p_partkey % 400) AS registered_on, p_brand AS registrar FROM part"
#: A registration number as messages write it.
NUMBER = r"([I1l]N[HAZP][ \t:.\-–]{0,3}(?:[0-9OoDQIl|iSsBZzG][ \t\-]?){8,10}[0-9OoDQIl|iSsBZzG])"
HOLDER = "(?:by|of) (Sup+lier#[0-9]{9})"


def sources(spark: SparkSession, sf_dir: str) -> investigate.Sources:
    none = F.array().cast("array<string>")
    text = lambda x: F.lit(x).cast("string")
    r = made(spark, sf_dir, REGISTRY)
    registry = r.select(
        "registration_no", "category", F.col("category").alias("category_label"), F.array("name").alias("names"), none.alias("trade_names"), text(None).alias("contact_person"), F.array(F.concat(F.lit("desk@firm"), F.regexp_extract("name", r"#0*(\d+)$", 1), F.lit(".example.com"))).alias("emails"),
        none.alias("phones"), text(None).alias("address"), text("Pune").alias("city"), none.alias("exchanges"), F.lit(None).cast("date").alias("valid_from"), "valid_to", text(investigate.SEARCHED_AT).alias("source_url"), F.lit(0).alias("ord"),
    )
    inactive = made(spark, sf_dir, GONE).withColumn("source_url", text(investigate.SEARCHED_AT))
    alerts = made(spark, sf_dir, "SELECT s_name AS name, s_acctbal FROM supplier").where("s_acctbal > 3000").select("name", none.alias("websites"), none.alias("domains"), text(investigate.SEARCHED_AT).alias("list_url"))
    domains = made(spark, sf_dir, DOMAINS).withColumn("rdap_url", text(None))
    day, loaded = dt.date(2026, 10, 3), dt.datetime(2026, 10, 4, 2, 0)
    access = [(name, True, "snapshot", day, loaded, False, False) for name in (investigate.REGISTER, investigate.ALERTS, investigate.AGES)]
    covered = verify.covered_categories(registry.select(F.col("category").alias("scope")), False, ())
    return investigate.Sources(registry, inactive, alerts, domains, covered, spark.createDataFrame(access, ACCESS))


def items(segments: DataFrame) -> DataFrame:
    """What a model says of messages that name a firm: its registration, and that it sends what it says of itself."""
    t = F.col("text")
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = segments.repartition(parts, "msg_id").select("msg_id", F.regexp_extract(t, HOLDER, 1).alias("name"), F.regexp_extract(t, NUMBER, 1).alias("number"), F.get(F.filter(F.split(t, "\n"), lambda row: row.rlike(HOLDER)), F.lit(0)).alias("line")).where("name <> ''")
    category = F.create_map(*(F.lit(x) for kv in {"H": "research_analyst", "A": "investment_adviser", "Z": "stock_broker", "P": "portfolio_manager"}.items() for x in kv))[F.substring("number", 3, 1)]
    own = {"quote": F.col("line"), "name": F.col("name")}
    row = lambda kind, n, **more: F.struct(*[(own | more | {"item": F.lit(kind), "ord": F.lit(n), "msg_id": F.col("msg_id")}).get(f, F.lit(None)).cast(k).alias(f) for f, k in (c.split() for c in claims.ITEM.split(", "))])
    told = row("registration", 0, regulator=F.lit("SEBI"), category=category, number=F.col("number"))
    sends = F.when(F.col("line").contains("registered by"), row("sender", 0))
    return checkpointed(named.select(F.inline(F.array_compact(F.array(told, sends)))))  # texts are read once for all who ask


@lru_cache(maxsize=1)
def _investigation(app: str, sf_dir: str) -> investigate.Investigation:
    spark = SparkSession.active()
    own = segments(spark, sf_dir)
    told = items(own)
    alone = own.join(told.select("msg_id").distinct(), "msg_id", "left_anti").select("msg_id")
    return investigate.investigate(own, sources(spark, sf_dir), now(), told, without_model=alone)


def investigation(spark: SparkSession, sf_dir: str) -> investigate.Investigation:
    """The check of all messages; its tables are checkpoints, which the queries of an application share."""
    return _investigation(spark.sparkContext.applicationId, sf_dir)


#: Numbers in the order in which they are written; the firm is said to hold the first.
READ = rf"""WITH m AS ({MESSAGES}), r AS ({REGISTRY}), gone AS ({GONE}), x AS (SELECT msg_id, regexp_extract_all(text, '(?:^|[^A-Za-z0-9]){NUMBER}(?:[^A-Za-z0-9]|$)', 1) AS raws, regexp_extract(text, '{HOLDER}', 1) AS holder FROM m),
 n AS (SELECT msg_id, unnest(raws) AS raw, generate_subscripts(raws, 1) AS i, holder FROM x),
 q AS (SELECT msg_id, upper(raw[1:3]) || translate(regexp_replace(raw[4:], '[ \t:.\-]', '', 'g'), 'OoDQIl|iSsBZzG', '00001111558226') AS number, regexp_matches(raw[4:], '[A-Za-z|]') AS unclear, CASE WHEN i = 1 THEN holder END AS holder FROM n),
 j AS (SELECT q.*, r.name, r.valid_to, r.registration_no, number IN (SELECT registration_no FROM gone) AS ended, len(list_filter(string_split_regex(lower(holder), '[^a-z0-9]+'), lambda t: len(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda u: t = u OR jaro_winkler_similarity(t, u) >= 0.92)) > 0)) = 2 AS same FROM q LEFT JOIN r ON number = registration_no),
 told AS (SELECT msg_id, CASE WHEN registration_no IS NULL AND unclear THEN 'REG_UNCLEAR_NUMBER' WHEN registration_no IS NULL AND ended THEN 'REG_INACTIVE' WHEN registration_no IS NULL THEN 'REG_NOT_IN_REGISTER' WHEN valid_to < DATE '2026-10-04' THEN 'REG_EXPIRED' WHEN holder IS NULL THEN 'REG_REAL_SENDER_UNKNOWN'
  WHEN same AND valid_to IS NULL THEN 'REG_MATCH_PERPETUAL' WHEN same THEN 'REG_MATCH' ELSE 'REG_NAME_SIMILAR' END AS reason FROM j) """


@query(READ + """SELECT msg_id, reason, CASE WHEN reason IN ('REG_INACTIVE', 'REG_EXPIRED') THEN 'CONTRADICTED' WHEN reason IN ('REG_MATCH', 'REG_MATCH_PERPETUAL') THEN 'MATCHES' WHEN reason = 'REG_NOT_IN_REGISTER' THEN 'NOT_FOUND' ELSE 'CANT_CHECK' END AS verdict FROM told""")
def investigated_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return investigation(spark, sf_dir).results.where("reason LIKE 'REG_%'").select("msg_id", "reason", "verdict")


HANDLES = r"regexp_extract_all(text, '(?:^|[^A-Za-z0-9_.@-])([A-Za-z0-9][A-Za-z0-9._-]{1,255}@(?:ybl|validhdfc))(?:[^A-Za-z0-9_.@]|$)', 1)"


@query(f"""WITH m AS ({MESSAGES}), h AS (SELECT msg_id, unnest(list_distinct({HANDLES})) AS upi FROM m)
 SELECT msg_id, 'PAYMENT_DESTINATION' AS type, CASE WHEN upi LIKE '%@valid%' THEN 'UPI_VALIDATED_CHECK' ELSE 'UPI_OWNER_UNKNOWN' END AS reason FROM h UNION ALL SELECT msg_id, 'APP_INSTALL', 'APP_SIDELOAD' FROM m WHERE regexp_matches(text, '(?i)http[^ ]+\\.apk')""")
def investigated_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = investigation(spark, sf_dir)
    types = inv.claims.where("type IN ('PAYMENT_DESTINATION', 'APP_INSTALL')").select("msg_id", "claim_id", "type")
    return inv.results.join(types, ["msg_id", "claim_id"]).select("msg_id", "type", "reason")


@query(rf"""WITH m AS ({MESSAGES}) SELECT msg_id, 'F_UPI_PERSONAL' AS code, 'medium' AS severity FROM m WHERE regexp_matches(text, '[^0-9][6-9][0-9]{{9}}@ybl') UNION ALL SELECT msg_id, 'F_APP_SIDELOAD', 'high' FROM m WHERE regexp_matches(text, '(?i)http[^ ]+\.apk')
 UNION ALL SELECT DISTINCT msg_id, 'F_URL_IP_HOST', 'high' FROM (SELECT msg_id, unnest(regexp_extract_all(text, 'https?://([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)', 1)) AS host FROM m) UNION ALL SELECT msg_id, 'F_URL_SHORTENER', 'medium' FROM m WHERE text LIKE '%https://www.bit.ly/%'""")
def investigated_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return investigation(spark, sf_dir).findings.where(F.col("code").isin("F_UPI_PERSONAL", "F_APP_SIDELOAD", "F_URL_IP_HOST", "F_URL_SHORTENER")).select("msg_id", "code", "severity")


@query(READ + ", c AS (SELECT DISTINCT reason FROM told) SELECT reason AS code, 2 AS languages FROM c")
def registration_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reason that registrations of the messages came to, and in how many languages it can be told alike."""
    told = investigation(spark, sf_dir).results.where("reason LIKE 'REG_%'").select(F.col("reason").alias("code")).distinct()
    known = catalog.catalog(spark)
    odd = report.catalog_gaps(known, "en", "hi").select("code")
    return told.join(F.broadcast(known), "code").join(F.broadcast(odd), "code", "left_anti").groupBy("code").agg(F.count_distinct("locale").cast("int").alias("languages"))  # a few hundred rows


@query("SELECT doc_id AS msg_id, true AS complete FROM documents")
def message_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each message has a report in JSON whose claims all have a statement, an explanation and a verdict."""
    inv = investigation(spark, sf_dir)
    told = render.views(inv, "en")
    claimed = inv.claims.groupBy("msg_id").agg(F.count("*").alias("n"))
    full = F.forall(F.coalesce("claims", F.array().cast(told.schema["claims"].dataType)), lambda c: (c["statement"] != "") & (c["explanation"] != "") & c["verdict"].isNotNull())
    headline = F.get_json_object(report.as_json(told), "$.headline_code")
    told = told.select("msg_id", full.alias("full"), F.coalesce(F.size("claims"), F.lit(0)).alias("size"), headline.alias("headline"))  # views are made once
    every = told.join(claimed, "msg_id", "left")
    return every.select("msg_id", (F.col("full") & (F.col("size") == F.coalesce("n", F.lit(0))) & F.col("headline").startswith("H_")).alias("complete"))


@query("SELECT doc_id AS msg_id, true AS fits FROM documents")
def message_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each message's report in a chat is one or two bodies of 1500 units at most."""
    told = render.chat(investigation(spark, sf_dir), "hi", "https://reports.example/{id}", 7)
    return told.select("msg_id", (F.size("bodies").between(1, 2) & F.forall("bodies", lambda b: render.utf16(b).between(1, render.CHAT_CHARS))).alias("fits"))


@query("SELECT doc_id AS msg_id, true AS told FROM documents")
def evidence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each message has a text to keep that names it and ends with what it is."""
    inv = investigation(spark, sf_dir)
    told = render.summary(inv, "en", now())
    return told.select("msg_id", (F.col("summary").contains(F.concat(F.lit("Number: "), F.col("msg_id").cast("string"))) & F.col("summary").endswith(catalog.FRAME["UI_DISCLAIMER"][0])).alias("told"))


#: What a model writes about a message: some that restate the report, some that don't.
WRITTEN = "SELECT doc_id AS msg_id, doc_id % 3 AS k, CASE doc_id % 3 WHEN 0 THEN 'This message was checked against the registers and rules, see below.' WHEN 1 THEN 'Call 98' || CAST(doc_id AS STRING) || '77 to hear more about this message and its sender.' ELSE 'This is surely a scam, and nobody should trust the one who sent it.' END AS text FROM documents"


@query(f"""WITH w AS ({WRITTEN}) SELECT msg_id, CASE k WHEN 0 THEN text END AS told, CASE k WHEN 0 THEN '' WHEN 1 THEN 'unknown_number:98' || CAST(msg_id AS STRING) || '77' ELSE 'banned_term' END AS problems FROM w""")
def guarded_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model has written of each message, if it may be told; else the report's own sentences stand in its place."""
    written = made(spark, sf_dir, WRITTEN)
    told = render.narratives(investigation(spark, sf_dir), "en", written.select("msg_id", "text"))
    return told.join(written, "msg_id").select("msg_id", F.when(F.col("narrative") == F.col("text"), F.col("text")).alias("told"), F.array_join("problems", "|").alias("problems"))


#: Answers of a model, in prose and fences as they come; some name a category that there isn't.
ANSWERS = """SELECT doc_id AS msg_id, CASE WHEN doc_id % 7 = 0 THEN 'I cannot read this.' ELSE 'Here: {"investmentRelated": true, "registrationClaims": [{"regulator": "SEBI", "category": "' || CASE WHEN doc_id % 5 = 0 THEN 'guru' ELSE 'stock_broker' END || '", "number": "INZ' || lpad(CAST(doc_id AS STRING), 9, '0') || '", "holderName": null, "quote": "' || source || '"}]} Thanks.' END AS answer FROM documents"""


@query("""SELECT doc_id AS msg_id, 'stock_broker' AS category, 'INZ' || lpad(CAST(doc_id AS STRING), 9, '0') AS number, source AS quote, NULL AS issue FROM documents WHERE doc_id % 7 > 0 AND doc_id % 5 > 0
 UNION ALL SELECT doc_id, NULL, NULL, NULL, CASE WHEN doc_id % 7 = 0 THEN 'no JSON object' ELSE 'registrationClaims.0.category' END FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a model's answers, and what is wrong with those that can't be used."""
    items_, wrong = answers.items_of(made(spark, sf_dir, ANSWERS))
    none = F.lit(None).cast("string")
    told = wrong.select("msg_id", none.alias("category"), none.alias("number"), none.alias("quote"), F.split_part(F.get("issues", F.lit(0)), F.lit(":"), F.lit(1)).alias("issue"))
    return items_.select("msg_id", "category", "number", "quote", none.alias("issue")).unionByName(told)


#: Messages of all kinds of claims: those in one language speak of approval and of a group as well.
ALL_KINDS = f"SELECT msg_id, m.text || CASE WHEN lang = 'fr' THEN chr(10) || 'SEBI approved tips for you. Enter our VIP group now' ELSE '' END AS text FROM ({MESSAGES}) m JOIN documents ON msg_id = doc_id"


@query(READ + f""", a AS ({ALL_KINDS}), of_number AS (SELECT n.msg_id, CASE WHEN i > 1 THEN 'pattern' WHEN regexp_matches(text, 'SEBI registered') THEN 'model+pattern' ELSE 'model' END AS origin FROM n JOIN a ON a.msg_id = n.msg_id)
 SELECT msg_id, 'SEBI_REGISTRATION' AS type, origin FROM of_number UNION ALL SELECT msg_id, 'IDENTITY', 'model' FROM a WHERE regexp_matches(text, 'registered by Supplier|Mail Desk[0-9]')
 UNION ALL SELECT msg_id, 'GUARANTEED_RETURNS', 'pattern' FROM a WHERE regexp_matches(text, 'Guaranteed returns 10%|Risk-free|zero loss') UNION ALL SELECT msg_id, 'PAYMENT_DESTINATION', 'pattern' FROM (SELECT msg_id, unnest(list_distinct({HANDLES})) AS upi FROM a)
 UNION ALL SELECT msg_id, 'APP_INSTALL', 'pattern' FROM a WHERE regexp_matches(text, 'http[^ ]+\\.apk') UNION ALL SELECT msg_id, unnest(['REGULATOR_ENDORSEMENT', 'SPECIAL_ACCESS']), 'pattern' FROM a WHERE text LIKE '%SEBI approved tips%VIP group%'""")
def message_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of all seven types, from patterns and from what a model has read."""
    own = segments(spark, sf_dir)
    langs = made(spark, sf_dir, "SELECT doc_id AS msg_id, lang FROM documents")
    more = F.when(F.col("lang") == "fr", "\nSEBI approved tips for you. Enter our VIP group now").otherwise("")
    own = own.join(langs, "msg_id").withColumn("text", F.concat("text", more)).drop("lang")
    return claims.build(claims.read(own, items(own))).select("msg_id", "type", "origin")


@query("SELECT doc_id AS msg_id, 'second' AS batch, true AS told FROM documents")
def stored_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of all messages after two batches were stored, read from disk."""
    views, path = checkpointed(render.views(investigation(spark, sf_dir), "en")), shared_path(spark, "reports")
    for batch in ("first", "second"):
        reports.store(path, views, batch)
    return reports.load(spark, path).select("msg_id", "batch", F.get_json_object("report", "$.headline_code").startswith("H_").alias("told"))


@query(READ + f""", linked AS (SELECT msg_id FROM n UNION ALL SELECT msg_id FROM (SELECT msg_id, unnest(list_distinct({HANDLES})) AS upi FROM m) UNION ALL SELECT msg_id FROM m WHERE regexp_matches(text, '(?i)http[^ ]+\\.apk')),
 absent AS (SELECT msg_id FROM told WHERE reason IN ('REG_NOT_IN_REGISTER', 'REG_UNCLEAR_NUMBER'))
 SELECT msg_id, 'mentions' AS kind, count(*) AS edges FROM linked GROUP BY msg_id UNION ALL SELECT msg_id, 'absent_in', count(*) FROM absent GROUP BY msg_id""")
def investigation_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edges to identifiers, and from searches that found nothing to registrations, the graph of each message has."""
    inv = investigation(spark, sf_dir)
    evidence = inv.evidence.select("msg_id", "id", "kind", "title", "source")
    findings = inv.findings.select("msg_id", "id", "code", "evidence", "claim_ids")
    edges = report.graph(inv.claims, inv.results, findings, evidence, inv.entities)[1]
    registrations = inv.claims.where("type = 'SEBI_REGISTRATION'").select("msg_id", F.col("claim_id").alias("target"))
    absent = edges.where("kind = 'absent_in'").join(registrations, ["msg_id", "target"], "left_semi")
    return edges.where("kind = 'mentions'").unionByName(absent).groupBy("msg_id", "kind").agg(F.count("*").alias("edges"))


@query(READ + f""", told_numbers AS (SELECT msg_id, number, holder, CASE WHEN i > 1 THEN 'kind not said' ELSE CASE number[3] WHEN 'H' THEN 'research analyst' WHEN 'A' THEN 'investment adviser' WHEN 'Z' THEN 'stock broker' ELSE 'portfolio manager' END END AS category FROM (SELECT n.msg_id, i, CASE WHEN i = 1 THEN holder END AS holder, upper(raw[1:3]) || translate(regexp_replace(raw[4:], '[ \\t:.\\-]', '', 'g'), 'OoDQIl|iSsBZzG', '00001111558226') AS number FROM n))
 SELECT msg_id, coalesce(holder, 'Whoever sent this') || ' holds SEBI registration ' || number || ' (' || category || ').' AS statement FROM told_numbers UNION ALL SELECT msg_id, 'Money is to go to ' || upi || '.' FROM (SELECT msg_id, unnest(list_distinct(list_transform({HANDLES}, lambda x: lower(x)))) AS upi FROM m)
 UNION ALL SELECT msg_id, 'An app is to be installed from ' || regexp_extract(text, 'http://([0-9.]+)/app', 1) || '.' FROM m WHERE regexp_matches(text, '(?i)http[^ ]+\\.apk')""")
def message_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What claims about numbers, payments and apps say, in words."""
    inv = investigation(spark, sf_dir)
    speak = render.Speaker(spark, "en")
    told = speak(report.claim_statements(inv.claims, inv.entities)).join(inv.claims.select("msg_id", "claim_id", "type"), ["msg_id", "claim_id"])
    return told.where("type IN ('SEBI_REGISTRATION', 'PAYMENT_DESTINATION', 'APP_INSTALL')").select("msg_id", F.col("text").alias("statement"))

"""Queries that verify, adjudicate and report. Messages, entities and records are made of the tables by SQL that either
engine reads; claims of whole messages have tests against a plain reading of small ones instead of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsieve.functions import domains, text
from proofsieve.operators import adjudicate, claims, report, verify
from proofsieve.plans.base import NOW, flat, made, now, query, table
from proofsieve.plans.queries import MESSAGES
from proofsieve.sources import messages


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = made(spark, sf_dir, MESSAGES)
    none = F.lit(None).cast("array<string>")
    return m.select("msg_id", F.lit(0).alias("seq"), "text", F.lit("text").alias("origin"), F.lit("good").alias("quality"), none.alias("unclear"))


@query(f"""WITH m AS ({MESSAGES}) SELECT msg_id, kind, 'pattern' AS origin FROM (SELECT msg_id, 'URGENCY' AS kind FROM m WHERE regexp_matches(text, 'Hurry, limited seats') UNION ALL SELECT msg_id, 'SECRECY' FROM m WHERE regexp_matches(text, 'Keep this secret')
 UNION ALL SELECT msg_id, 'REMOTE_ACCESS_OR_OTP' FROM m WHERE regexp_matches(text, 'share OTP') UNION ALL SELECT msg_id, 'PERSONAL_ACCOUNT_PAYMENT' FROM m WHERE regexp_matches(text, '[^0-9][6-9][0-9]{{9}}@ybl'))""")
def message_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.behaviours(claims.read(segments(spark, sf_dir))).select("msg_id", "kind", "origin")


#: Entities of messages: one table row gives a phone, a mailbox or a link.
PHONES = "SELECT c_custkey AS msg_id, CASE WHEN c_custkey % 4 = 0 THEN '+91' || lpad(CAST(9876500000 + c_custkey % 150 AS STRING), 10, '0') WHEN c_custkey % 4 = 1 THEN '+447911' || lpad(CAST(c_custkey % 1000000 AS STRING), 6, '0') END AS e164 FROM customer"
MAILS = "SELECT c_custkey AS msg_id, 'desk' || CAST(c_custkey % 5 AS STRING) || '@' || CASE c_custkey % 6 WHEN 0 THEN 'mail.firm' || CAST(c_custkey % 120 AS STRING) || '.co.in' WHEN 1 THEN 'gmail.com' WHEN 2 THEN 'f1rm' || CAST(c_custkey % 120 AS STRING) || '.com' ELSE 'other' || CAST(c_custkey % 7 AS STRING) || '.org' END AS address FROM customer"
RECORDS = "SELECT s_suppkey AS record_id, s_name AS name, CASE WHEN s_suppkey % 3 > 0 THEN '0' || CAST(9876500000 + s_suppkey AS STRING) || ';x' END AS phones, CASE WHEN s_suppkey % 5 > 0 THEN 'Desk' || CAST(s_suppkey % 5 AS STRING) || '@firm' || CAST(s_suppkey AS STRING) || '.co.in;info@gmail.com' END AS emails FROM supplier"


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = lambda **own: F.map_filter(F.create_map(*(x for k, v in own.items() for x in (F.lit(k), v.cast("string")))), lambda k, v: v.isNotNull())
    p = made(spark, sf_dir, PHONES).where("e164 IS NOT NULL")
    phones = p.select("msg_id", F.lit("phone").alias("kind"), F.lit("phone-1").alias("entity_id"), F.col("e164").alias("key"), put(e164=F.col("e164"), indian=F.col("e164").startswith("+91")).alias("attrs"))
    m = made(spark, sf_dir, MAILS).withColumn("domain", F.split_part("address", F.lit("@"), F.lit(2)))
    mails = m.select("msg_id", F.lit("email").alias("kind"), F.lit("email-1").alias("entity_id"), F.col("address").alias("key"), put(address=F.col("address"), domain=F.col("domain"), free_mail=F.col("domain") == "gmail.com").alias("attrs"))
    return phones.unionByName(mails)


PAIRS = "SELECT c_custkey AS msg_id, c_custkey % 120 AS record_id FROM customer"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda c: F.when(F.col(c).isNotNull(), F.split(c, ";")).otherwise(F.array().cast("array<string>"))
    r = made(spark, sf_dir, RECORDS)
    return r.select("record_id", F.col("record_id").cast("string").alias("registration_no"), F.array("name").alias("names"), F.array(F.concat("name", F.lit(" (Proprietor: Brand "), F.col("record_id").cast("string"), F.lit(")"))).alias("trade_names"), F.lit("Mr. Contact").alias("contact_person"), listed("phones").alias("phones"), listed("emails").alias("emails"), F.lit("1 Road, new delhi, State, 110001").alias("address"), F.lit("").alias("city"))


@query(f"""WITH p AS ({PHONES}), m AS ({MAILS}), r AS ({RECORDS}), x AS (SELECT * FROM ({PAIRS}) JOIN r USING (record_id))
 SELECT x.msg_id, x.record_id, 'phone' AS field, e164 AS in_message, CASE WHEN phones IS NULL THEN 'record_has_none' WHEN right(e164, 10) = right(split_part(phones, ';', 1), 10) THEN 'same' ELSE 'not_in_record' END AS status, CAST(NULL AS STRING) AS official_domain FROM x JOIN p ON x.msg_id = p.msg_id AND e164 IS NOT NULL
 UNION ALL SELECT x.msg_id, x.record_id, 'phone', NULL, 'not_given', NULL FROM x JOIN p ON x.msg_id = p.msg_id AND e164 IS NULL WHERE phones IS NOT NULL
 UNION ALL SELECT x.msg_id, x.record_id, 'email', address, CASE WHEN emails IS NULL THEN 'record_has_none' WHEN lower(split_part(emails, ';', 1)) = address OR 'mail.firm' || CAST(x.record_id AS STRING) || '.co.in' = split_part(address, '@', 2) THEN 'same' WHEN 'f1rm' || CAST(x.record_id AS STRING) || '.com' = split_part(address, '@', 2) THEN 'lookalike' ELSE 'not_in_record' END,
  CASE WHEN emails IS NOT NULL AND 'f1rm' || CAST(x.record_id AS STRING) || '.com' = split_part(address, '@', 2) THEN 'firm' || CAST(x.record_id AS STRING) || '.co.in' END FROM x JOIN m ON x.msg_id = m.msg_id""")
def contact_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.compare_contacts(made(spark, sf_dir, PAIRS), _entities(spark, sf_dir), _records(spark, sf_dir))


@query(f"WITH r AS ({RECORDS}) SELECT record_id, name || '|' || name || ' (Proprietor: Brand ' || CAST(record_id AS STRING) || ')|Brand ' || CAST(record_id AS STRING) || '|Contact' AS variants, name || ' (trade name: ' || name || ' (Proprietor: Brand ' || CAST(record_id AS STRING) || '))' AS shown, 'New Delhi' AS city, lower(name) || ' | ' || lower(name) || ' (proprietor: brand ' || CAST(record_id AS STRING) || ') | mr. contact' AS searched FROM r")
def record_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir).select("record_id", F.struct("registration_no", "names", "trade_names", "contact_person", "address", "city").alias("r"))
    rec = F.col("r")
    return r.select("record_id", flat(verify.name_variants(rec)).alias("variants"), verify.display_name(rec).alias("shown"), verify.city_of(rec).alias("city"), verify.search_text(rec).alias("searched"))


CLAIMED = "SELECT c_custkey AS id, CAST(c_custkey % 120 AS STRING) AS number, CASE c_custkey % 3 WHEN 0 THEN 'Brand ' || CAST(c_custkey % 120 AS STRING) WHEN 1 THEN 'Nobody Else' ELSE 'Contact' END AS name FROM customer"


@query(f"WITH c AS ({CLAIMED}), r AS ({RECORDS}) SELECT id, CASE WHEN record_id IS NULL THEN 'inconclusive' WHEN id % 3 = 1 THEN 'different' ELSE 'same' END AS result, CASE WHEN record_id IS NULL THEN NULL WHEN id % 3 = 1 THEN r.name WHEN id % 3 = 0 THEN r.name || ' (Proprietor: Brand ' || number || ')' ELSE 'Contact' END AS matched FROM c LEFT JOIN r ON number = CAST(record_id AS STRING)")
def name_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.name_comparisons(made(spark, sf_dir, CLAIMED), _records(spark, sf_dir))


LOOK = "SELECT l_orderkey AS msg_id, 'd' || CAST(l_partkey AS STRING) || '.com' AS domain, l_linenumber AS place FROM lineitem"
AGES = "SELECT 'd' || CAST(p_partkey AS STRING) || '.com' AS domain, CASE WHEN p_size % 10 = 0 THEN 'not_found' ELSE 'found' END AS status, TIMESTAMP '2026-10-01 00:00:00' - INTERVAL 1 DAY * (p_partkey % 400) AS registered_on, p_brand AS registrar FROM part WHERE p_size % 7 > 0"


@query(f"""WITH l AS ({LOOK}), a AS ({AGES}), j AS (SELECT l.*, coalesce(status, 'unavailable') AS status, CAST(floor(epoch({NOW} - registered_on) / 86400) AS BIGINT) AS days FROM l LEFT JOIN a ON l.domain = a.domain)
 SELECT msg_id, 'domain-new:' || domain AS key, 'F_DOMAIN_NEW' AS code, CASE WHEN days < 30 THEN 'high' ELSE 'medium' END AS severity, days FROM j WHERE status = 'found' AND days BETWEEN 0 AND 179 UNION ALL SELECT msg_id, 'domain-age:' || domain, 'U_DOMAIN_AGE', 'unchecked', NULL FROM j WHERE status = 'unavailable'""")
def domain_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.domain_findings(verify.domain_lookups(made(spark, sf_dir, LOOK), made(spark, sf_dir, AGES)), now())


@query(f"WITH p AS ({PHONES}), m AS ({MAILS}) SELECT p.msg_id, 'foreign-number:' || e164 AS key, 'F_FOREIGN_NUMBER' AS code, 'medium' AS severity FROM p WHERE e164 LIKE '+44%' AND msg_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def foreign_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = made(spark, sf_dir, "SELECT c_custkey AS msg_id, 'SEBI_REGISTRATION' AS type FROM customer WHERE c_acctbal > 0")
    return report.foreign_numbers(_entities(spark, sf_dir), asked)


@query(f"WITH m AS ({MAILS}) SELECT msg_id, split_part(address, '@', 2) AS domain, 1 AS place FROM m WHERE address NOT LIKE '%gmail.com'")
def domain_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.domain_plan(_entities(spark, sf_dir))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'x' || CAST(s_suppkey AS STRING) || '.co.in' WHEN 1 THEN 'b.com' WHEN 2 THEN NULL WHEN 3 THEN 'www.ck' ELSE 'github.io' END AS domain FROM supplier")
def registrable_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = made(spark, sf_dir, "SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'www.a.x' || CAST(s_suppkey AS STRING) || '.co.in' WHEN 1 THEN 'A.B.com' WHEN 2 THEN '10.0.0.1' WHEN 3 THEN 'www.ck' ELSE 'a.github.io' END AS host FROM supplier")
    return h.select("id", domains.registrable_domain(F.col("host")).alias("domain"))


NUMBERS = "SELECT DISTINCT 'INA' || lpad(CAST(c_custkey AS STRING), 9, '0') AS number FROM customer"


@query("""SELECT 'INA' || lpad(CAST(c_custkey AS STRING), 9, '0') AS number, CASE WHEN c_custkey IN (SELECT s_suppkey FROM supplier) OR c_custkey % 10 = 1 THEN 'found' WHEN c_custkey % 7 = 0 THEN 'inactive' WHEN c_custkey % 10 = 2 THEN 'unavailable' ELSE 'not_found' END AS status,
 CASE WHEN c_custkey NOT IN (SELECT s_suppkey FROM supplier) AND c_custkey % 10 <> 1 AND c_custkey % 7 = 0 THEN 'Cancelled' END AS inactive_status FROM customer""")
def number_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = "'INA' || lpad(CAST({} AS STRING), 9, '0')"
    registry = made(spark, sf_dir, f"SELECT {number.format('s_suppkey')} AS registration_no FROM supplier")
    inactive = made(spark, sf_dir, f"SELECT {number.format('c_custkey')} AS registration_no, 'Cancelled' AS status FROM customer WHERE c_custkey % 7 = 0")
    live = made(spark, sf_dir, f"SELECT {number.format('c_custkey')} AS number, CASE c_custkey % 10 WHEN 1 THEN 'found' WHEN 2 THEN 'failed' ELSE 'not_found' END AS status FROM customer")
    return verify.lookups(made(spark, sf_dir, NUMBERS), registry, inactive, live, covered=False)


OFFERS = "SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'fpi_account' WHEN 1 THEN 'vip_group' WHEN 2 THEN 'otc' WHEN 3 THEN 'institutional_account' ELSE 'pre_ipo' END AS kind, CASE WHEN o_custkey % 2 = 0 THEN 'model' ELSE 'pattern' END AS origin, CASE o_custkey % 5 WHEN 0 THEN 'SEBI' WHEN 1 THEN 'NSE' WHEN 2 THEN 'BSE' WHEN 3 THEN 'RBI' ELSE 'GOVT' END AS authority, CASE o_orderkey % 3 WHEN 0 THEN 'app' WHEN 1 THEN 'tip' ELSE 'scheme' END AS object, CASE o_custkey % 3 WHEN 0 THEN 'play' END AS store, o_custkey % 2 = 1 AS sideload, o_orderkey % 2 = 0 AS linked, CASE o_custkey % 4 WHEN 0 THEN 'BROKER' WHEN 1 THEN 'RA' WHEN 2 THEN 'UNKNOWN' END AS category FROM orders"


@query(f"""WITH o AS ({OFFERS}) SELECT id, CASE WHEN kind = 'fpi_account' AND origin = 'pattern' THEN 'ACCESS_FPI_NOT_FOR_RESIDENTS' WHEN kind = 'otc' THEN 'ACCESS_UNVERIFIABLE' ELSE 'ACCESS_CAUTIONED' END AS access, CASE WHEN kind IN ('vip_group', 'otc') THEN 'medium' ELSE 'high' END AS severity,
 CASE WHEN object = 'app' THEN 'ENDORSE_APP_OR_GROUP' WHEN origin = 'model' THEN 'ENDORSE_NOT_CHECKABLE' WHEN authority = 'SEBI' THEN 'ENDORSE_SEBI_DOES_NOT_APPROVE' WHEN authority IN ('NSE', 'BSE') THEN 'ENDORSE_EXCHANGES_DO_NOT_ENDORSE' ELSE 'ENDORSE_NOT_CHECKABLE' END AS endorsement,
 CASE WHEN store = 'play' THEN 'APP_STORE_CHECK_DEVELOPER' WHEN sideload AND linked THEN 'APP_SIDELOAD' ELSE 'APP_NO_LINK' END AS app,
 CASE WHEN category IS NULL OR origin = 'model' THEN 'ASSURED_RETURN_SCHEMES_PROHIBITED' WHEN category = 'BROKER' THEN 'BROKER_NO_GUARANTEED_RETURN_SCHEMES' WHEN category = 'RA' THEN 'RA_IA_NO_ASSURED_RETURNS' ELSE 'RA_IA_NO_ASSURED_RETURNS|BROKER_NO_GUARANTEED_RETURN_SCHEMES' END AS returns_rules FROM o""")
def offers_and_endorsements(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    returns = adjudicate.returns_reason(F.lit("market"), c("category"), c("origin"))
    return made(spark, sf_dir, OFFERS).select("id", adjudicate.access_reason(c("kind"), c("origin")).alias("access"), adjudicate.access_severity(c("kind")).alias("severity"), adjudicate.endorsement_reason(c("authority"), c("object"), c("origin")).alias("endorsement"), adjudicate.app_reason(c("store"), c("sideload"), c("linked")).alias("app"), flat(adjudicate.returns_rules(returns, c("category"))).alias("returns_rules"))


IDENTITY = "SELECT o_orderkey AS id, o_orderkey % 11 = 0 AS sebi, o_custkey % 2 = 0 AS foreign_mail, o_orderkey % 13 = 0 AS regulator, o_orderkey % 3 > 0 AS record, o_orderkey % 5 = 0 AS ambiguous, o_custkey % 3 > 0 AS intermediary, o_custkey % 5 > 0 AS searched, o_custkey % 4 AS contacts, o_orderkey % 2 AS same, o_custkey % 7 AS odd FROM orders"


@query(f"""WITH i AS ({IDENTITY}) SELECT id, CASE WHEN sebi AND foreign_mail THEN 'ID_SEBI_EMAIL_MISMATCH' WHEN sebi OR regulator THEN 'ID_REGULATOR_UNVERIFIED' WHEN NOT record AND ambiguous THEN 'ID_AMBIGUOUS' WHEN NOT record AND NOT intermediary THEN 'ID_NOT_CHECKABLE' WHEN NOT record AND NOT searched THEN 'ID_SOURCE_UNAVAILABLE' WHEN NOT record THEN 'ID_NOT_IN_REGISTER' WHEN contacts = 0 THEN 'ID_NO_CONTACTS' WHEN same > 0 AND odd = 0 THEN 'ID_CONTACTS_MATCH' ELSE 'ID_CONTACTS_NOT_ON_RECORD' END AS reason FROM i""")
def identity_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return made(spark, sf_dir, IDENTITY).select("id", adjudicate.identity_reason(c("sebi"), c("foreign_mail"), c("regulator"), c("record"), c("ambiguous"), c("intermediary"), c("searched"), c("contacts"), c("same"), c("odd")).alias("reason"))


BARE = "SELECT o_orderkey AS id, o_orderkey % 4 > 0 AS holder, o_custkey % 5 > 0 AS searched, o_orderkey % 3 AS same, o_custkey % 2 = 0 AS active FROM orders"


@query(f"WITH b AS ({BARE}) SELECT id, CASE WHEN NOT holder THEN 'REG_NO_DETAILS' WHEN NOT searched THEN 'REG_SOURCE_UNAVAILABLE_NAME' WHEN same = 1 AND active THEN 'REG_NAME_FOUND' WHEN same = 1 THEN 'REG_EXPIRED' WHEN same > 1 THEN 'REG_NAME_AMBIGUOUS' ELSE 'REG_NAME_NOT_FOUND' END AS reason FROM b")
def bare_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return made(spark, sf_dir, BARE).select("id", adjudicate.bare_registration_reason(c("holder"), c("searched"), c("same"), c("active")).alias("reason"))


CLAIMS = "SELECT l_orderkey AS msg_id, l_linenumber * 100000 + l_partkey AS seq_no, CASE l_partkey % 4 WHEN 0 THEN 'OTHER' WHEN 1 THEN 'RA' END AS category, CASE WHEN l_suppkey % 3 = 0 THEN 'PMS' END AS record_category FROM lineitem"


@query(f"WITH c AS ({CLAIMS}) SELECT msg_id, coalesce(arg_min(coalesce(nullif(category, 'OTHER'), record_category), (seq_no, coalesce(nullif(category, 'OTHER'), record_category))) FILTER (WHERE coalesce(nullif(category, 'OTHER'), record_category) IS NOT NULL), 'UNKNOWN') AS category FROM c GROUP BY msg_id")
def claimed_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = made(spark, sf_dir, CLAIMS).groupBy("msg_id", "seq_no", "category").agg(F.max("record_category").alias("record_category"))
    return adjudicate.claimed_category(c)


FINDINGS = "SELECT l_orderkey AS msg_id, l_linenumber * 100000 + l_partkey AS seq, 'k' || CAST(l_suppkey % 4 AS STRING) AS key, CASE WHEN l_suppkey % 4 = 0 THEN 'info' WHEN l_suppkey % 4 = 1 THEN 'high' WHEN l_suppkey % 4 = 2 THEN 'low' ELSE 'medium' END AS severity, 'text ' || CAST(l_suppkey % 4 AS STRING) AS text FROM lineitem"


@query(f"""WITH f AS ({FINDINGS}), k AS (SELECT msg_id, key, severity, min(seq) AS seq FROM f GROUP BY ALL), i AS (SELECT *, 'find-' || CAST(row_number() OVER (PARTITION BY msg_id ORDER BY seq, key) AS STRING) AS id FROM k)
 SELECT msg_id, key, id, severity, CAST(row_number() OVER (PARTITION BY msg_id ORDER BY list_position(['high', 'medium', 'low', 'info'], severity), seq, key) AS INT) AS place FROM i""")
def findings_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, FINDINGS).groupBy("msg_id", "key", "severity").agg(F.min("seq").alias("seq"))
    return report.ordered_findings(report.keyed(rows, "find")).select("msg_id", "key", "id", "severity", "place")


FACTS = "SELECT o_orderkey AS msg_id, o_orderkey % 3 = 0 AS contradicted, o_orderkey % 4 = 0 AS high, o_custkey % 2 = 0 AS payment, o_custkey % 3 = 0 AS app, o_custkey % 5 = 0 AS issue, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '111 / a@b.com' END AS contact, o_orderkey % 2 = 0 AS matched FROM orders"


@query(f"""WITH f AS ({FACTS}), s AS (SELECT msg_id, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS priority, * EXCLUDE msg_id FROM f)
 SELECT msg_id, CASE priority WHEN 1 THEN 'pause' WHEN 2 THEN 'contact' WHEN 3 THEN 'sebi-check' WHEN 4 THEN 'upi-name' WHEN 5 THEN 'official-app' WHEN 6 THEN 'verify-sebi' WHEN 7 THEN 'chakshu' WHEN 8 THEN 'already-paid' ELSE 'sebi-helpline' END AS step, priority, CASE WHEN priority = 2 THEN contact END AS param, CASE WHEN priority = 9 THEN '1800 266 7575' END AS phone FROM s
 WHERE CASE WHEN priority IN (1, 7) THEN contradicted OR high WHEN priority = 2 THEN coalesce(contact, '') <> '' WHEN priority IN (3, 4) THEN payment WHEN priority = 5 THEN app WHEN priority = 6 THEN issue ELSE true END""")
def next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.next_steps(made(spark, sf_dir, FACTS)).select("msg_id", "step", "priority", "param", "phone")


@query(f"WITH f AS ({FACTS}) SELECT msg_id, count(*) AS steps, string_agg(step, '|' ORDER BY priority) AS names FROM (SELECT msg_id, matched, unnest(range(1, 9)) AS priority, unnest(['call-1930', 'cybercrime', 'bank', 'upi-complaint', 'evidence', 'scores', 'recovery-scams', 'summary']) AS step FROM f) WHERE step <> 'scores' OR matched GROUP BY msg_id")
def recovery_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = report.recovery_steps(made(spark, sf_dir, FACTS))
    return s.groupBy("msg_id").agg(F.count("*").alias("steps"), flat(F.transform(F.array_sort(F.collect_list(F.struct("priority", "step"))), lambda x: x["step"])).alias("names"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'banned_term' WHEN o_orderkey % 4 = 1 THEN 'unknown_number:99' || CAST(o_orderkey AS STRING) || '99' WHEN o_orderkey % 4 = 2 THEN 'length' ELSE 'unknown_identifier:x@y.zz' END AS problems, 'H Ends here. do this' AS fallback FROM orders""")
def narrative_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    n = F.col("id") % 4
    facts = F.concat(F.lit("The record of order "), F.col("id").cast("string"), F.lit(" is from 2024, 12,000 rupees"))
    told = F.when(n == 0, "This order is surely a scam from the year 2024, all of it").when(n == 1, F.concat(F.lit("The number is and was this: 99"), F.col("id").cast("string"), F.lit("99, and 12000"))).when(n == 2, "too short").otherwise("The mail to write to is no other than x@y.zz, it says")
    text_ = report.template_narrative(F.lit("H"), F.array(F.lit("a"), F.lit("b → c: Ends here.")), F.array(F.lit("w")), F.array(F.lit("do this")))
    return o.select("id", flat(report.narrative_problems(told, facts, F.lit("en"))).alias("problems"), text_.alias("fallback"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'One, Two' WHEN o_orderkey % 3 = 1 THEN 'One' END AS named, strftime(o_orderdate + INTERVAL 330 MINUTES, '%-d ') || CASE month(o_orderdate + INTERVAL 330 MINUTES) WHEN 9 THEN 'Sept' ELSE strftime(o_orderdate + INTERVAL 330 MINUTES, '%b') END || strftime(o_orderdate + INTERVAL 330 MINUTES, ' %Y') AS day, 'Paid 12,34,567.5 (x).' AS shown FROM orders""")
def rendered_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    entries = F.create_map(F.lit("a"), F.lit("One"), F.lit("b"), F.lit("Two"))
    ref = F.when(F.col("o_orderkey") % 3 == 0, "@@a,b").when(F.col("o_orderkey") % 3 == 1, "@a").otherwise("@@a,zz")
    shown = report.tidy(F.concat(F.lit("Paid  "), report.format_number(F.lit(1234567.499).cast("double")), F.lit(" ( ; x) ( , ) .")))
    return o.select(F.col("o_orderkey").alias("id"), report.dictionary_value(ref, entries).alias("named"), report.format_day(F.col("o_orderdate")).alias("day"), shown.alias("shown"))


@query("SELECT o_orderkey AS msg_id, CASE WHEN o_orderkey % 3 < 2 THEN 1 ELSE 2 END AS n, CASE o_orderkey % 3 WHEN 0 THEN 1022 WHEN 1 THEN 1202 ELSE 2500 END AS chars FROM orders")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("msg_id"), (F.col("o_orderkey") % 3).alias("k"))
    many = lambda n: F.repeat(F.lit("x"), n)
    tiers = o.select("msg_id", F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), many(first).alias("first"), many(second).alias("second")) for t, first, second in ((0, F.when(F.col("k") == 0, 1000).when(F.col("k") == 1, 600).otherwise(5000), F.when(F.col("k") == 1, 600).otherwise(20)), (1, F.when(F.col("k") == 2, 3000).otherwise(9), F.when(F.col("k") == 2, 1000).otherwise(9)))))).alias("t")).select("msg_id", "t.*")
    m = report.chat_messages(tiers)
    return m.select("msg_id", F.size("bodies").alias("n"), F.aggregate("bodies", F.lit(0), lambda a, b: a + F.length(b)).alias("chars"))


@query("SELECT c_custkey AS id, 'Sharma ' || CAST(c_custkey AS STRING) AS name, CASE WHEN c_custkey % 2 = 0 THEN 'same' ELSE 'different' END AS compared FROM customer")
def transliterated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey").cast("string")
    hindi = F.concat(F.lit("शर्मा "), n)
    other = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("SHARMA "), n, F.lit(" Limited"))).otherwise("Gupta")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.initcap(text.name_to_latin(hindi)).alias("name"), text.compare_tokens(text.name_tokens(hindi), text.name_tokens(other)).alias("compared"))


GRAPH_EVIDENCE = "SELECT o_orderkey AS msg_id, 'ev-1' AS id, CASE o_custkey % 3 WHEN 0 THEN 'rule' WHEN 1 THEN 'registry_absence' ELSE 'registry_record' END AS kind, 'RULE_X' AS title, 'register' AS source FROM orders"


@query(f"""WITH e AS ({GRAPH_EVIDENCE}), v AS (SELECT o_orderkey AS msg_id, CASE o_orderstatus WHEN 'F' THEN 'CONTRADICTED' WHEN 'O' THEN 'MATCHES' ELSE 'CANT_CHECK' END AS verdict FROM orders)
 SELECT msg_id, 'claim-1' AS source, 'reg-1' AS target, 'mentions' AS kind FROM v UNION ALL SELECT msg_id, id, 'source:register', CASE WHEN kind = 'rule' THEN 'cites' ELSE 'checked_in' END FROM e
 UNION ALL SELECT v.msg_id, 'ev-1', 'claim-1', CASE WHEN kind = 'registry_absence' THEN 'absent_in' WHEN verdict = 'CONTRADICTED' THEN 'contradicts' WHEN verdict = 'MATCHES' THEN 'supports' WHEN kind = 'rule' THEN 'cites' ELSE 'checked_in' END FROM v JOIN e ON v.msg_id = e.msg_id
 UNION ALL SELECT msg_id, 'find-1', unnest(['ev-1', 'claim-1']), 'flags' FROM v""")
def provenance_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1]


@query(f"""WITH e AS ({GRAPH_EVIDENCE}) SELECT msg_id, unnest(['claim-1', 'reg-1', 'ev-1', 'source:register', 'find-1']) AS node, unnest(['claim', 'entity', CASE WHEN kind = 'rule' THEN 'rule' ELSE 'evidence' END, 'source', 'finding']) AS kind, unnest(['SEBI_REGISTRATION', 'INH000000001', CASE WHEN kind = 'rule' THEN 'X' ELSE 'RULE_X' END, 'register', 'F_X']) AS label FROM e""")
def provenance_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0]


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("msg_id"), "o_orderstatus")
    none = F.lit(None).cast("string")
    c = o.select("msg_id", F.lit("claim-1").alias("claim_id"), F.lit("SEBI_REGISTRATION").alias("type"), F.lit("reg-1").alias("reg_id"), none.alias("upi_id"), none.alias("url_id"))
    r = o.select("msg_id", F.lit("claim-1").alias("claim_id"), F.when(F.col("o_orderstatus") == "F", "CONTRADICTED").when(F.col("o_orderstatus") == "O", "MATCHES").otherwise("CANT_CHECK").alias("verdict"), F.array(F.lit("ev-1")).alias("evidence"))
    f = o.select("msg_id", F.lit("find-1").alias("id"), F.lit("F_X").alias("code"), F.array(F.lit("ev-1")).alias("evidence"), F.array(F.lit("claim-1")).alias("claim_ids"))
    e = o.select("msg_id", F.lit("reg-1").alias("entity_id"), F.lit("INH000000001").alias("key"), F.create_map(F.lit("scheme"), F.lit("SEBI_RA")).alias("attrs"))
    return report.graph(c, r, f, made(spark, sf_dir, GRAPH_EVIDENCE), e)


#: Claims of one message for each order, with the entities that they name.
SAID = "SELECT o_orderkey AS msg_id, o_orderkey % 12 AS k FROM orders"
STATEMENTS = """CASE k WHEN 0 THEN 'Holder Firm says it is registered as INH000000001 (adviser).' WHEN 1 THEN 'Registered as INH000000001 (?).' WHEN 2 THEN 'Firm says it is registered (?).' WHEN 3 THEN 'Registered (adviser).' WHEN 4 THEN 'Says it is Firm.' WHEN 5 THEN 'CLAIM_ENDORSEMENT' WHEN 6 THEN 'Promises 12.5 % a month.' WHEN 7 THEN 'Asks to pay x@ybl.' WHEN 8 THEN 'Asks to pay to account XXXX1234.' WHEN 9 THEN 'Asks to pay by QR.' WHEN 10 THEN 'Asks to install from a.b.com.' ELSE 'Offers early shares.' END"""
TEMPLATES = {"CLAIM_REG_NUMBER_NAME": "Holder {holderName} says it is registered as {regNo} ({category}).", "CLAIM_REG_NUMBER": "Registered as {regNo} ({category}).", "CLAIM_REG_NAME": "{holderName} says it is registered ({category}).", "CLAIM_REG_BARE": "Registered ({category}).", "CLAIM_IDENTITY": "Says it is {orgName} .", "CLAIM_RETURNS_RATE": "Promises {percent} % {period}.", "CLAIM_PAYMENT_UPI": "Asks to pay {upi}.", "CLAIM_PAYMENT_BANK": "Asks to pay to account {account}.", "CLAIM_PAYMENT": "Asks to pay by {method}.", "CLAIM_APP_LINK": "Asks to install from {domain}.", "CLAIM_ACCESS": "Offers {kind}."}
DICTIONARY = {"cat.IA": "adviser", "cat.UNKNOWN": "?", "period.month": "a month", "method.qr": "QR", "access.pre_ipo": "early shares"}


@query(f"WITH s AS ({SAID}) SELECT msg_id, 'claim-1' AS claim_id, {STATEMENTS} AS text FROM s")
def claim_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = made(spark, sf_dir, SAID)
    k = F.col("k")
    when = lambda ks, v: F.when(k.isin(*ks), v).cast("string")
    kinds = ["SEBI_REGISTRATION"] * 4 + ["IDENTITY", "REGULATOR_ENDORSEMENT", "GUARANTEED_RETURNS"] + ["PAYMENT_DESTINATION"] * 3 + ["APP_INSTALL", "SPECIAL_ACCESS"]
    c = m.select("msg_id", F.lit("claim-1").alias("claim_id"), F.element_at(F.array(*map(F.lit, kinds)), (k + 1).cast("int")).alias("type"), when([0, 1], "reg-1").alias("reg_id"), when([7], "upi-1").alias("upi_id"), when([8], "bank-1").alias("bank_id"), when([10], "url-1").alias("url_id"), when([0, 2], "Firm").alias("holder_name"), when([0, 3], "IA").alias("category"), when([4], "Firm").alias("org_name"), when([5], "SEBI").alias("authority"), when([5], "tip").alias("object"), F.when(k == 6, 12.5).alias("percent"), when([6], "month").alias("period"), F.when(k == 6, "assured").when(k == 11, "pre_ipo").alias("kind"), when([7, 9], "qr").alias("method"), F.lit(None).cast("string").alias("app_name"))
    row = lambda kind, key, **a: F.struct(F.lit(kind).alias("kind"), F.lit(f"{kind}-1").alias("entity_id"), F.lit(key).alias("key"), F.create_map(*(F.lit(x) for kv in (a or {"none": ""}).items() for x in kv)).alias("attrs"))
    e = m.select("msg_id", F.explode(F.array(row("reg", "INH000000001"), row("upi", "x@ybl"), row("bank", "b", masked="XXXX1234"), row("url", "u", host="a.b.com"))).alias("e")).select("msg_id", "e.*")
    told = report.claim_statements(c, e).withColumn("locale", F.lit("en"))
    catalog = spark.createDataFrame([("en", *kv) for kv in TEMPLATES.items()], "locale string, code string, template string")
    words = spark.createDataFrame([("en", *kv) for kv in DICTIONARY.items()], "locale string, key string, value string")
    return report.rendered(told, catalog, words).select("msg_id", "claim_id", "text")


CITED = "SELECT l_orderkey AS msg_id, l_linenumber * 100000 + l_partkey AS seq, CASE l_suppkey % 3 WHEN 0 THEN 'CAUTION_VIP_GROUPS' WHEN 1 THEN 'CAUTION_FAKE_INSTITUTIONAL_ACCOUNTS' ELSE 'NO_SUCH_RULE' END AS rule FROM lineitem"


@query(f"WITH c AS ({CITED}) SELECT msg_id, min(seq) AS seq, 'rule:' || rule AS key, 'RULE_' || rule AS title, CASE WHEN rule LIKE '%VIP%' THEN 'SEBI' ELSE 'NSE/BSE' END AS authority FROM c WHERE rule <> 'NO_SUCH_RULE' GROUP BY msg_id, rule")
def rule_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rule_evidence(made(spark, sf_dir, CITED).withColumn("rules", F.array("rule"))).select("msg_id", "seq", "key", "title", "authority")


LIVE = "SELECT c_mktsegment AS category, c_nationkey AS registration_no, c_custkey AS ord, c_name AS name, 'p' || CAST(c_custkey % 5 AS STRING) AS phone, CAST(c_acctbal AS STRING) AS note FROM customer"


@query(f"""WITH r AS ({LIVE}), p AS (SELECT category, registration_no, phone, min(ord) AS ord FROM r GROUP BY ALL)
 SELECT category, registration_no, string_agg(name, '|' ORDER BY ord) AS names, (SELECT string_agg(phone, '|' ORDER BY p.ord) FROM p WHERE p.category = r.category AND p.registration_no = r.registration_no) AS phones, arg_min(note, ord) AS note FROM r GROUP BY category, registration_no""")
def live_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a live register answers, one record for each number."""
    rows = made(spark, sf_dir, LIVE)
    merged = verify.merge_live(rows.select("category", "registration_no", "ord", F.array("name").alias("names"), F.array("phone").alias("phones"), "note"))
    return merged.select("category", "registration_no", flat(F.col("names")).alias("names"), flat(F.col("phones")).alias("phones"), "note")


PROBES = "SELECT l_returnflag AS task, l_linestatus || CAST(l_linenumber AS STRING) AS model, CAST(sum(l_quantity) AS BIGINT) AS hits, count(*) * 50 AS total, CAST(max(l_partkey) AS BIGINT) AS ms FROM lineitem GROUP BY l_returnflag, l_linestatus || CAST(l_linenumber AS STRING)"


@query(f"WITH p AS ({PROBES}) SELECT task, model, hits / total AS score FROM p QUALIFY row_number() OVER (PARTITION BY task ORDER BY hits / total DESC, ms, model) = 1")
def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model that does each task best."""
    line = table(spark, sf_dir, "lineitem")
    probes = line.groupBy(F.col("l_returnflag").alias("task"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("model")).agg(F.sum("l_quantity").cast("long").alias("hits"), (F.count("*") * 50).alias("total"), F.max("l_partkey").cast("long").alias("ms"))
    return report.best_models(probes)


KEY = b"a key of this deployment"
INNER, OUTER = (bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))


@query(f"SELECT c_custkey AS id, translate(to_base64(unhex(sha256(unhex('{OUTER}' || sha256(unhex('{INNER}' || hex(encode(c_name)))))))), '+/=', '-_') AS token FROM customer")
def signed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed digest of each name, as addresses carry it."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), report.hmac_base64url(KEY, F.col("c_name")).alias("token"))


@query("""SELECT doc_id AS msg_id, text IS NOT NULL AND length(text) BETWEEN 1 AND LIMIT AND doc_id % 14 BETWEEN 1 AND 12 AS valid FROM documents""".replace("LIMIT", str(messages.TEXT_CHARS)))
def message_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether messages of some parts, each the document's text, are within the interface's bounds."""
    none = F.lit(None).cast("string")
    part = F.struct(F.lit("text").alias("kind"), "text", none.alias("url"), none.alias("blob_ref"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("msg_id"), messages.valid_parts(F.array_repeat(part, (F.col("doc_id") % 14).cast("int"))).alias("valid"))

"""Queries that read registers, lists and messages from the forms in which they come. The forms are written from the
tables by SQL that either engine reads; what should come out is told by the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofsieve.plans.base import flat, made, query, table
from proofsieve.session import shared_path
from proofsieve.sources import messages, registers, snapshots, workbooks

MONTH = "CASE s_suppkey % 3 WHEN 0 THEN 'Feb' WHEN 1 THEN 'October' ELSE 'Sept.' END"
DAY = "CAST(1 + s_suppkey % 28 AS STRING)"
ISO = "CAST('2023-' || CASE s_suppkey % 3 WHEN 0 THEN '02' WHEN 1 THEN '10' ELSE '09' END || '-' || lpad(CAST(1 + s_suppkey % 28 AS STRING), 2, '0') AS DATE)"
CITY = "'Town ' || CAST(s_suppkey % 9 AS STRING)"
EXPORT = f"SELECT s_suppkey AS ord, ' ina ' || lpad(CAST(s_suppkey % 70 AS STRING), 9, '0') AS registration_no, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN upper(s_name) WHEN s_suppkey % 4 = 1 THEN 'Brand ' || CAST(s_suppkey AS STRING) ELSE '' END AS trade_name, 'A' || CAST(s_suppkey AS STRING) || '@x.com; none,b@y.in/A' || CAST(s_suppkey AS STRING) || '@x.com' AS email, '' AS corr_email, '111;222' AS telephone, CASE WHEN s_suppkey % 2 = 0 THEN '222, 333' END AS corr_telephone, 'Street 1' AS address, {CITY} AS city, CASE WHEN s_suppkey % 5 > 0 THEN 'State' ELSE '' END AS state, '' AS pincode, {MONTH} || ' ' || {DAY} || ', 2023' AS valid_from, CASE s_suppkey % 3 WHEN 0 THEN 'Perpetual' WHEN 1 THEN 'Feb 16, 2028' ELSE 'soon' END AS valid_to FROM supplier"
RECORDS = f"""SELECT 'INA' || lpad(CAST(s_suppkey % 70 AS STRING), 9, '0') AS registration_no, s_suppkey AS ord, s_name AS names, CASE WHEN s_suppkey % 4 = 1 THEN 'Brand ' || CAST(s_suppkey AS STRING) ELSE '' END AS trade_names, 'a' || CAST(s_suppkey AS STRING) || '@x.com|b@y.in' AS emails, CASE WHEN s_suppkey % 2 = 0 THEN '111|222|333' ELSE '111|222' END AS phones,
 'Street 1, ' || {CITY} || CASE WHEN s_suppkey % 5 > 0 THEN ', State' ELSE '' END AS address, {ISO} AS valid_from, CASE WHEN s_suppkey % 3 = 1 THEN DATE '2028-02-16' END AS valid_to FROM supplier"""


@query(RECORDS)
def export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = registers.records_of_rows(made(spark, sf_dir, EXPORT), "IA")
    return r.select("registration_no", "ord", *(flat(F.col(c)).alias(c) for c in ("names", "trade_names", "emails", "phones")), "address", "valid_from", "valid_to")


SHEET = "['Name', 'Registration No.', 'City', 'City', 'Odd  Header!', 'From']"


@query(f"SELECT s_nationkey AS sheet, 10 + s_suppkey AS row, s_name AS name, 'R' || CAST(s_suppkey AS STRING) AS registration_no, {CITY} AS city, 'Corr' AS corr_city, 'odd' AS odd_header_, CAST('2026-10-03' AS DATE) AS as_of FROM supplier")
def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = made(spark, sf_dir, f"SELECT s_nationkey AS sheet, CAST(10 + s_suppkey AS INT) AS row, array(s_name, 'R' || CAST(s_suppkey AS STRING), {CITY}, 'Corr', 'odd') AS values FROM supplier")
    sheets = data.select("sheet").distinct()
    head = F.array(*(F.struct(F.lit(k).alias("row"), F.array(*map(F.lit, v)).alias("values")) for k, v in enumerate((["Advisers as on Oct 03, 2026"], ["", "Office", "", "Correspondence Address", "", ""], ["Name", "Registration No.", "City", "City", "Odd  Header!"]))))
    # The group Office ends where the next begins; the odd header has none of its own and goes on with the last.
    titles, rows = registers.rows_of_sheets(data.unionByName(sheets.select("sheet", F.inline(head))))
    f = F.col("fields")
    return rows.join(F.broadcast(titles), "sheet").select("sheet", "row", f["name"].alias("name"), f["registration_no"].alias("registration_no"), f["city"].alias("city"), f["corr_city"].alias("corr_city"), f["corr_odd_header_"].alias("odd_header_"), "as_of")


CARD = f"""'<div class="fixed-table-body card-table"><div class="card-view"><div class="title"><span>Name</span></div><div class="value varun-text"><span>' || s_name || ' &amp; Co<br></span></div></div><div class="card-view"><div class="title"><span>Registration No.</span></div><div class="value"><span>inz ' || lpad(CAST(s_suppkey AS STRING), 9, '0') || '</span></div></div><div class=card-view><div class=title><span>Type</span></div><div class=value><span>' || CASE WHEN s_suppkey % 2 = 0 THEN 'Stock Broker (equity)' ELSE 'unknown' END || '</span></div></div><div class=card-view><div class=title><span>Address</span></div><div class=value><span>Street,  1, ' || {CITY} || ', State, 110001</span></div></div><div class=card-view><div class=title><span>E-mail</span></div><div class=value><span>X' || CAST(s_suppkey AS STRING) || '&#64;b.com</span></div></div><div class=card-view><div class=title><span>Validity</span></div><div class=value><span>' || {MONTH} || ' ' || {DAY} || ', 2023 - ' || CASE WHEN s_suppkey % 2 = 0 THEN 'Perpetual' ELSE 'Feb 16, 2028' END || '</span></div></div><div class=card-view><div class=title><span>Name</span></div><div class=value><span>second</span></div></div>' || CASE WHEN s_suppkey % 7 = 0 THEN '<div class=card-view><div class=title><span>Status</span></div><div class=value><span>Cancelled</span></div></div>' ELSE '' END || '</div>'"""
PAGES = f"SELECT s_suppkey AS page_id, '<html><body>' || {CARD} || '<p>1 to 1 of ' || CAST(s_suppkey AS STRING) || ' records</p></body></html>' AS html FROM supplier"


@query(f"""SELECT s_suppkey AS page_id, 'INZ' || lpad(CAST(s_suppkey AS STRING), 9, '0') AS registration_no, CASE WHEN s_suppkey % 2 = 0 THEN 'BROKER' ELSE 'RA' END AS category, s_name || ' & Co' AS names, 'x' || CAST(s_suppkey AS STRING) || '@b.com' AS emails, {CITY} AS city, 'State' AS state, {ISO} AS valid_from, CASE WHEN s_suppkey % 2 = 1 THEN DATE '2028-02-16' END AS valid_to FROM supplier""")
def card_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = registers.records_of_cards(made(spark, sf_dir, PAGES), "RA")
    return r.select("page_id", "registration_no", "category", flat(F.col("names")).alias("names"), flat(F.col("emails")).alias("emails"), "city", "state", "valid_from", "valid_to")


@query("SELECT 'INZ ' || lpad(CAST(s_suppkey AS STRING), 9, '0') AS registration_no, s_name || ' & Co' AS name, 'Cancelled' AS status FROM supplier WHERE s_suppkey % 7 = 0")
def inactive_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.inactive_of_cards(made(spark, sf_dir, PAGES)).select("registration_no", "name", "status")


@query("SELECT s_suppkey AS page_id, DATE '2026-09-05' AS as_of, s_name AS name, 'www.a' || CAST(s_suppkey AS STRING) || '.co.in/x|http://b.c' || CAST(s_suppkey AS STRING) || '.com|www.b.c' || CAST(s_suppkey AS STRING) || '.com' AS websites, 'a' || CAST(s_suppkey AS STRING) || '.co.in|c' || CAST(s_suppkey AS STRING) || '.com' AS domains FROM supplier")
def alert_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = made(spark, sf_dir, "SELECT s_suppkey AS page_id, '<p>(updated as on September 5,  2026)</p><table><tr><th>x</th></tr><tr><td>1</td><td>a</td><td>b.com</td></tr></table><table><tr><th>Sr. No</th><th>Name</th><th>Website</th></tr><tr><td>1</td><td> ' || s_name || '</td><td>www.a' || CAST(s_suppkey AS STRING) || '.co.in/x, http://b.c' || CAST(s_suppkey AS STRING) || '.com; none www.b.c' || CAST(s_suppkey AS STRING) || '.com</td></tr><tr><td>2</td><td></td><td>c.com</td></tr></table>' AS html FROM supplier")
    return registers.alert_entries(pages).select("page_id", "as_of", "name", flat(F.col("websites")).alias("websites"), flat(F.col("domains")).alias("domains"))


@query("SELECT s_suppkey AS id, TIMESTAMP '2010-02-17 12:26:39' AS registered_on, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS registrar FROM supplier")
def domain_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, """SELECT s_suppkey AS id, '{"events": [{"eventAction": "expiration", "eventDate": "2030-01-01T00:00:00Z"}, {"eventAction": "registration", "eventDate": "2010-02-17T12:26:39Z"}], "entities": [{"roles": ["abuse"]}, {"roles": ["registrar"], "vcardArray": ["vcard", [["version", {}, "text", "4.0"], ["fn", {}, "text", "' || CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END || '"]]]}]}' AS json FROM supplier""")
    return rows.select("id", registers.domain_record(F.col("json")).alias("r")).select("id", F.col("r.registered_on"), F.col("r.registrar"))


WEBHOOK = """SELECT event_id, '{"object": "whatsapp_business_account", "entry": [{"changes": [{"field": "messages", "value": {"metadata": {"phone_number_id": "' || CASE WHEN user_id % 5 = 0 THEN '8' ELSE '7' END || '"}, "messages": [{"id": "m' || CAST(event_id AS STRING) || '", "from": "+91 ' || lpad(CAST(user_id AS STRING), 10, '9') || '", "timestamp": "' || CAST(1700000000 + event_id AS STRING) || '", ' || CASE event_type WHEN 'click' THEN '"type": "text", "text": {"body": "hello"}' WHEN 'view' THEN '"type": "image", "image": {"id": "i1", "caption": "see"}, "context": {"forwarded": true}' WHEN 'purchase' THEN '"type": "interactive", "interactive": {"list_reply": {"title": "pick"}}' WHEN 'signup' THEN '"type": "audio", "audio": {"id": "a1", "mime_type": "audio/mp4"}' ELSE '"type": "sticker"' END || '}]' || CASE WHEN event_type = 'error' THEN ', "statuses": [{"id": "s' || CAST(event_id AS STRING) || '", "status": "failed", "errors": [{"code": 131, "title": "t"}]}]' ELSE '' END || '}}, {"field": "other"}]}]}' AS payload FROM events"""


@query("""SELECT 'm' || CAST(event_id AS STRING) AS message_id, 'tel:91' || lpad(CAST(user_id AS STRING), 10, '9') AS user_key, CASE event_type WHEN 'click' THEN 'hello' WHEN 'view' THEN 'see' WHEN 'purchase' THEN 'pick' ELSE '' END AS text, CASE event_type WHEN 'view' THEN 'image/jpeg:i1' WHEN 'signup' THEN 'audio/mp4:a1' ELSE '' END AS media, event_type = 'view' AS forwarded, 1700000000 + event_id AS seconds FROM events WHERE event_type <> 'error' AND user_id % 5 <> 0""")
def webhook_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages.webhook_messages(made(spark, sf_dir, WEBHOOK), "7")
    media = flat(F.transform("media", lambda x: F.concat(x["content_type"], F.lit(":"), x["media_id"])))
    return m.select("message_id", "user_key", "text", media.alias("media"), "forwarded", F.unix_seconds("received_at").alias("seconds"))


@query("SELECT 's' || CAST(event_id AS STRING) AS id, 'failed' AS status, 131 AS code FROM events WHERE event_type = 'error' AND user_id % 5 <> 0")
def webhook_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.webhook_statuses(made(spark, sf_dir, WEBHOOK), "7").select("id", "status", F.col("errors")[0]["code"].alias("code"))


@query("SELECT 'SM' || CAST(event_id AS STRING) AS message_id, 'tel:91' || lpad(CAST(user_id AS STRING), 9, '0') AS user_key, 'a & b = ' || event_type AS text, CASE WHEN event_id % 2 = 0 THEN 'image/png:ME' || CAST(event_id AS STRING) ELSE '' END AS media, event_id % 3 = 0 AS forwarded FROM events")
def form_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = made(spark, sf_dir, "SELECT 'MessageSid=SM' || CAST(event_id AS STRING) || '&From=whatsapp%3A%2B1&WaId=91' || lpad(CAST(user_id AS STRING), 9, '0') || '&Body=a+%26+b+%3D+' || event_type || '&NumMedia=' || CASE WHEN event_id % 2 = 0 THEN '2&MediaUrl0=https%3A%2F%2Fx.org%2FME' || CAST(event_id AS STRING) || '&MediaContentType0=image%2Fpng' ELSE '0' END || '&Forwarded=' || CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'no' END AS body, ts AS received_at FROM events")
    media = flat(F.transform("media", lambda x: F.concat(x["content_type"], F.lit(":"), x["media_id"])))
    return messages.form_messages(forms).select("message_id", "user_key", "text", media.alias("media"), "forwarded")


@query("""WITH p AS (SELECT event_id AS msg_id, unnest([1, 3, 4]) AS k, event_type, event_id FROM events)
 SELECT msg_id, 'seg-' || CAST(k AS STRING) AS segment_id, CASE k WHEN 1 THEN 'text' WHEN 3 THEN 'url' ELSE 'image' END AS kind, CASE k WHEN 1 THEN 'turn ' || event_type WHEN 3 THEN 'https://x.org/' || CAST(event_id AS STRING) ELSE 'read ' || event_type END AS text FROM p WHERE k < 4 OR event_type = 'click'""")
def readable_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, "SELECT event_id AS msg_id, event_type, ' turn' || chr(9) || event_type AS t, ' https://x.org/' || CAST(event_id AS STRING) || ' ' AS u FROM events")
    none = F.lit(None).cast("string")
    part = lambda kind, t=none, u=none, b=none: F.struct(F.lit(kind).alias("kind"), t.alias("text"), u.alias("url"), b.alias("blob_ref"))
    given = rows.select("msg_id", F.array(part("text", F.col("t")), part("text", F.lit(" ")), part("url", u=F.col("u")), part("image", b=F.col("event_type"))).alias("parts"))
    readings = spark.createDataFrame([("click", "read  click", "good", None)], "blob_ref string, text string, quality string, reason string")
    return messages.segments(given, readings)[0].select("msg_id", "segment_id", "kind", "text")


@query("SELECT event_id AS msg_id, k - 1 AS seq, CASE WHEN k = 2 THEN 'empty' ELSE 'not_read' END AS reason FROM (SELECT event_id, event_type, unnest([2, 4]) AS k FROM events) WHERE k = 2 OR event_type <> 'click'")
def unread_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("msg_id"), F.array(*(F.struct(F.lit(k).alias("kind"), (F.lit(t) if t else none).alias("text"), none.alias("url"), (F.col("event_type") if k == "image" else none).alias("blob_ref")) for k, t in (("text", "x"), ("text", " "), ("text", "y"), ("image", None)))).alias("parts"))
    readings = spark.createDataFrame([("click", "read  click", "good", None)], "blob_ref string, text string, quality string, reason string")
    return messages.segments(rows, readings)[1].select("msg_id", "seq", "reason")


LOAD = "SELECT 'register' AS source, c_mktsegment AS category, CAST(c_custkey AS STRING) AS registration_no, {name} AS name FROM customer WHERE {kept}"
LOADS = [LOAD.format(name="c_name", kept="c_acctbal > 2000"), LOAD.format(name="CASE WHEN c_nationkey < 5 THEN upper(c_name) ELSE c_name END", kept="c_acctbal < 8000 AND c_mktsegment <> 'BUILDING'")]


@query(f"""WITH a AS ({LOADS[0]}), b AS ({LOADS[1]})
 SELECT category, b.registration_no, b.name, CASE WHEN a.registration_no IS NULL THEN 'second' ELSE 'first' END AS first_seen, 'second' AS last_seen FROM b LEFT JOIN a USING (category, registration_no)
 UNION ALL SELECT category, registration_no, name, 'first', 'first' FROM a WHERE category NOT IN (SELECT category FROM b)""")
def replaced_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table on disk after two loads, and after the second one once more."""
    table_ = shared_path(spark, "register")
    at = lambda day: F.to_timestamp(F.lit(f"2026-10-0{day} 12:00:00"))
    loads = [made(spark, sf_dir, sql) for sql in LOADS]
    for name, new, day in (("first", loads[0], 1), ("second", loads[1], 2), ("second", loads[1], 3)):
        snapshots.replace(table_, new, name, at(day))
    told = lambda c: F.when(F.col(c) == at(1), "first").when(F.col(c) == at(2), "second")
    return snapshots.entries(spark, table_, loads[0].schema).select("category", "registration_no", "name", told("first_seen_at").alias("first_seen"), told("last_seen_at").alias("last_seen"))


@query(f"SELECT s_nationkey AS sheet, s_name AS name, CAST(s_suppkey AS STRING) AS registration_no, {CITY} AS city, 'Corr' AS corr_city, CAST('2026-10-03' AS DATE) AS as_of FROM supplier")
def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports written as binary workbooks, one for each nation, and read back."""
    data = made(spark, sf_dir, f"SELECT s_nationkey AS book, s_suppkey, array(s_name, CAST(s_suppkey AS STRING), {CITY}, 'Corr') AS values FROM supplier")
    place = F.row_number().over(Window.partitionBy("book").orderBy("s_suppkey"))
    head = F.array(*(F.struct(F.lit(k).alias("row"), F.array(*map(F.lit, v)).alias("values")) for k, v in enumerate((["Advisers as on Oct 03, 2026"], ["", "", "", "Correspondence Address"], ["Name", "Registration No.", "City", "City"]))))
    cells = data.select("book", (place + 2).alias("row"), "values").unionByName(data.select("book").distinct().select("book", F.inline(head)))
    read = workbooks.read_contents(workbooks.workbooks(cells.withColumn("sheet", F.lit("Sheet1"))).select(F.col("book").alias("path"), "content"))
    titles, rows = registers.rows_of_sheets(read.select(F.col("path").cast("int").alias("sheet"), "row", "values"))
    f = F.col("fields")
    return rows.join(F.broadcast(titles), "sheet").select("sheet", f["name"].alias("name"), f["registration_no"].alias("registration_no"), f["city"].alias("city"), f["corr_city"].alias("corr_city"), "as_of")  # a title for each nation

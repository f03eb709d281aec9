"""Reports: evidence and findings as keyed rows, the graph of what rests on what, next steps, texts and their checks."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsieve.functions import text
from proofsieve.operators import citations
from proofsieve.operators.claims import first_by

# Findings that behaviour raises, with severity and rules; official places and numbers.
PATTERN_FINDINGS = {
    "URGENCY": ("F_URGENCY", "medium", []),
    "SECRECY": ("F_SECRECY", "medium", []),
    "CONTACT_SHIFT": ("F_CONTACT_SHIFT", "medium", ["CAUTION_VIP_GROUPS"]),
    "REMOTE_ACCESS_OR_OTP": ("F_OTP_REMOTE", "high", ["RA_IA_NEVER_ASK_OTP"]),
    "PAY_TO_WITHDRAW": ("F_PAY_TO_WITHDRAW", "high", []),
    "PROFIT_SCREENSHOTS": ("F_PROFIT_PROOF", "low", ["RA_IA_NO_ACCURACY_CLAIMS"]),
    "CRYPTO_PAYMENT": ("F_CRYPTO_PAYMENT", "medium", []),
    "PERSONAL_ACCOUNT_PAYMENT": ("F_UPI_PERSONAL_PATTERN", "medium", []),
    "ACCURACY_CLAIM": ("F_ACCURACY_CLAIM", "medium", ["RA_IA_NO_ACCURACY_CLAIMS"]),
}
SEVERITIES = ("high", "medium", "low", "info")
LINKS = {"sebi-check": "https://siportal.sebi.gov.in/intermediary/sebi-check", "verify-sebi": "https://www.sebi.gov.in/intermediaries.html", "chakshu": "https://sancharsaathi.gov.in/sfc/", "cybercrime": "https://cybercrime.gov.in", "scores": "https://scores.sebi.gov.in", "upi-complaint": "https://www.upihelp.npci.org.in"}
PHONES = {"call-1930": "1930", "sebi-helpline": "1800 266 7575"}
RECOVERY = [("call-1930", "RC_CALL_1930"), ("cybercrime", "RC_CYBERCRIME"), ("bank", "RC_BANK"), ("upi-complaint", "RC_UPI_COMPLAINT"), ("evidence", "RC_EVIDENCE"), ("scores", "RC_SCORES"), ("recovery-scams", "RC_RECOVERY_SCAMS"), ("summary", "RC_SUMMARY")]
BANNED = r"(?i)\b(safe|unsafe|scam|scams|scammer|scammers|fraudster|fraudsters|legit|legitimate|genuine|trustworthy|trusted|recommend|recommended|buy|sell|hold|invest now|should invest|definitely|certainly)\b|100\s?%"
BANNED_HINDI = "(सुरक्षित|धोखेबाज़|धोखेबाज|फ़्रॉड है|फ्रॉड है|भरोसेमंद|असली है|ख़रीदें|खरीदें|बेचें|निवेश करें|ज़रूर निवेश)"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sept Oct Nov Dec".split()


def keyed(rows: DataFrame, prefix: str) -> DataFrame:
    """The first of rows (msg_id, seq, key, ...) with each key, numbered in their order: id is prefix-n."""
    first = first_by(rows, ["msg_id", "key"], ["seq"])
    n = F.row_number().over(Window.partitionBy("msg_id").orderBy("seq", "key"))  # keys tell rows of one place apart
    return first.withColumn("id", F.concat(F.lit(f"{prefix}-"), n.cast("string")))


def merge_bindings(bindings: DataFrame) -> DataFrame:
    """bindings (msg_id, record_evidence_id, claimed_name, claim_id, seq, ...): one for each record and name, with the
    claims of all in their order and all else from the first."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("seq", "claim_id"))), lambda x: x["claim_id"])
    keys = ["msg_id", "record_evidence_id", "claimed_name"]
    other = [c for c in bindings.columns if c not in (*keys, "claim_id", "seq")]
    return bindings.groupBy(*keys).agg(F.array_distinct(ids).alias("claim_ids"), F.min("seq").alias("seq"), *(F.min_by(c, "seq").alias(c) for c in other))


def ordered_findings(findings: DataFrame) -> DataFrame:
    """findings (msg_id, seq, severity, ...) with their place: high ones first, those of one severity in their order."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return findings.withColumn("place", F.row_number().over(Window.partitionBy("msg_id").orderBy(rank, "seq", "key")))


def pattern_findings(patterns: DataFrame, claims: DataFrame, personal: DataFrame) -> DataFrame:
    """Rows (msg_id, key, code, severity, rules, quote) of patterns (msg_id, kind, quote).

    Claims of accuracy are high where the message claims to be registered; payments to personal accounts go where
    personal (msg_id) has them for a handle already.
    """
    facts = F.create_map(*(x for k, (code, sev, rules) in PATTERN_FINDINGS.items() for x in (F.lit(k), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.array(*map(F.lit, rules)).cast("array<string>").alias("rules")))))
    registered = claims.where("type = 'SEBI_REGISTRATION'").select("msg_id").distinct().withColumn("registered", F.lit(True))
    known = personal.select("msg_id").distinct().withColumn("personal", F.lit(True))
    p = patterns.join(registered, "msg_id", "left").join(known, "msg_id", "left").where("NOT (kind = 'PERSONAL_ACCOUNT_PAYMENT' AND coalesce(personal, false))")
    own = facts[F.col("kind")]
    severity = F.when((F.col("kind") == "ACCURACY_CLAIM") & F.coalesce("registered", F.lit(False)), "high").otherwise(own["severity"])
    return p.select("msg_id", F.concat(F.lit("pattern:"), "kind").alias("key"), own["code"].alias("code"), severity.alias("severity"), own["rules"].alias("rules"), "quote")


def link_findings(entities: DataFrame) -> DataFrame:
    """Rows (msg_id, key, code, severity) of links that hide where they lead, or name no domain; each host once."""
    a = F.col("attrs")
    u = entities.where("kind = 'url'")
    short = u.where(a["shortener"] == "true").select("msg_id", F.concat(F.lit("shortener:"), a["host"]).alias("key"), F.lit("F_URL_SHORTENER").alias("code"), F.lit("medium").alias("severity"))
    bare = u.where(a["ip_host"] == "true").select("msg_id", F.concat(F.lit("ip-host:"), a["host"]).alias("key"), F.lit("F_URL_IP_HOST").alias("code"), F.lit("high").alias("severity"))
    return short.unionByName(bare).distinct()


def domain_findings(lookups: DataFrame, now: Column, young: int = 180, newest: int = 30) -> DataFrame:
    """Rows (msg_id, key, code, severity, days) of lookups (msg_id, domain, status, registered_on): young domains, and
    those whose age is not known as unchecked."""
    days = F.floor((F.unix_micros(now) - F.unix_micros("registered_on")) / 86_400_000_000)
    new = lookups.where("status = 'found' AND registered_on IS NOT NULL").withColumn("days", days).where(F.col("days").between(0, young - 1))
    found = new.select("msg_id", F.concat(F.lit("domain-new:"), "domain").alias("key"), F.lit("F_DOMAIN_NEW").alias("code"), F.when(F.col("days") < newest, "high").otherwise("medium").alias("severity"), "days")
    missing = lookups.where("status = 'unavailable'").select("msg_id", F.concat(F.lit("domain-age:"), "domain").alias("key"), F.lit("U_DOMAIN_AGE").alias("code"), F.lit("unchecked").alias("severity"), F.lit(None).cast("long").alias("days"))
    return found.unionByName(missing)


def foreign_numbers(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """Rows (msg_id, key, code, severity): numbers of other countries in messages that claim to be registered."""
    registered = claims.where("type = 'SEBI_REGISTRATION'").select("msg_id").distinct()
    own = entities.where("kind = 'phone' AND attrs['indian'] = 'false'").join(registered, "msg_id", "left_semi")
    return own.select("msg_id", F.concat(F.lit("foreign-number:"), F.col("attrs")["e164"]).alias("key"), F.lit("F_FOREIGN_NUMBER").alias("code"), F.lit("medium").alias("severity")).distinct()


def unchecked(messages: DataFrame, entities: DataFrame, claims: DataFrame, runs: DataFrame, unread: DataFrame) -> DataFrame:
    """Rows (msg_id, key, code, cause): what could not be checked, each thing once for a message."""
    a = F.col("attrs")
    row = lambda df, key, code, cause: df.select("msg_id", key.alias("key"), F.lit(code).alias("code") if isinstance(code, str) else code.alias("code"), (F.lit(cause) if isinstance(cause, str) else cause).alias("cause"))
    lit = F.lit
    down = row(runs.where("status IN ('unavailable', 'error')"), F.concat(lit("source-down:"), "source"), "U_SOURCE_DOWN", "source_unavailable")
    phones = row(entities.where("kind = 'phone'"), lit("phone-owner"), "U_PHONE_OWNER", "no_source")
    groups = row(entities.where((F.col("kind") == "handle") | ((F.col("kind") == "url") & a["invite"].isNotNull())), lit("group-links"), "U_GROUP_LINKS", "no_source")
    pages = row(entities.where((F.col("kind") == "url") & a["invite"].isNull()), lit("url-content"), "U_URL_CONTENT", "not_verifiable")
    future = row(claims.where("type = 'GUARANTEED_RETURNS'"), lit("future-returns"), "U_FUTURE_RETURNS", "not_verifiable")
    audio = (F.col("kind") == "audio") & F.col("reason").isin("unsupported", "reader_unavailable")
    parts = row(unread, F.concat(lit("unread:"), F.col("seq").cast("string")), F.when(audio, "U_AUDIO_UNSUPPORTED").otherwise("U_UNREADABLE_PART"), F.when(F.col("reason") == "unreadable", "unclear_input").otherwise("unsupported_input"))
    every = down.unionByName(phones).unionByName(groups).unionByName(pages).unionByName(future).unionByName(parts)
    return every.distinct().join(messages.select("msg_id").distinct(), "msg_id", "left_semi")


def graph(claims: DataFrame, results: DataFrame, findings: DataFrame, evidence: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of claims (msg_id, claim_id, type, reg_id, upi_id, url_id), results (msg_id, claim_id, verdict,
    evidence), findings (msg_id, id, code, evidence, claim_ids), evidence (msg_id, id, kind, title, source) and entities.

    Nodes are (msg_id, node, kind, label), edges (msg_id, source, target, kind); a node's first label counts.
    """
    lit = F.lit
    label = entities.select("msg_id", F.col("entity_id").alias("target"), F.coalesce(F.col("attrs")["host"], "key").alias("label"))
    linked = claims.select("msg_id", F.col("claim_id").alias("source"), F.when(F.col("type") == "SEBI_REGISTRATION", F.col("reg_id")).when(F.col("type") == "PAYMENT_DESTINATION", F.col("upi_id")).when(F.col("type") == "APP_INSTALL", F.col("url_id")).alias("target")).where("target IS NOT NULL")
    mentions = linked.join(label, ["msg_id", "target"])
    rule = F.col("kind") == "rule"
    nodes = [
        claims.select("msg_id", F.col("claim_id").alias("node"), lit("claim").alias("kind"), F.col("type").alias("label")),
        mentions.select("msg_id", F.col("target").alias("node"), lit("entity").alias("kind"), "label"),
        evidence.select("msg_id", F.col("id").alias("node"), F.when(rule, "rule").otherwise("evidence").alias("kind"), F.when(rule, F.regexp_replace("title", "^RULE_", "")).otherwise(F.col("title")).alias("label")),
        evidence.select("msg_id", F.concat(lit("source:"), "source").alias("node"), lit("source").alias("kind"), F.col("source").alias("label")),
        findings.select("msg_id", F.col("id").alias("node"), lit("finding").alias("kind"), F.col("code").alias("label")),
    ]
    of = evidence.select("msg_id", F.col("id").alias("ev"), F.col("kind").alias("ev_kind"))
    held = results.select("msg_id", "claim_id", "verdict", F.explode("evidence").alias("ev")).join(of, ["msg_id", "ev"])
    how = F.when(F.col("ev_kind") == "registry_absence", "absent_in").when(F.col("verdict") == "CONTRADICTED", "contradicts").when(F.col("verdict") == "MATCHES", "supports").when(F.col("ev_kind") == "rule", "cites").otherwise("checked_in")
    edges = [
        mentions.select("msg_id", "source", "target", lit("mentions").alias("kind")),
        evidence.select("msg_id", F.col("id").alias("source"), F.concat(lit("source:"), "source").alias("target"), F.when(rule, "cites").otherwise("checked_in").alias("kind")),
        held.select("msg_id", F.col("ev").alias("source"), F.col("claim_id").alias("target"), how.alias("kind")),
        findings.select("msg_id", F.col("id").alias("source"), F.explode(F.concat("evidence", "claim_ids")).alias("target"), lit("flags").alias("kind")),
    ]
    every, lines = nodes[0], edges[0]
    for n in nodes[1:]:
        every = every.unionByName(n)
    for e in edges[1:]:
        lines = lines.unionByName(e)
    return every.groupBy("msg_id", "node").agg(F.min(F.struct("kind", "label")).alias("x")).select("msg_id", "node", "x.*"), lines


def next_steps(facts: DataFrame) -> DataFrame:
    """Rows (msg_id, step, code, priority, href, phone, param) of facts (msg_id, contradicted, high, payment, app, issue,
    official_name, contact): what to do next, by priority. contact is the official one, or null or blank."""
    serious = F.col("contradicted") | F.col("high")
    given = F.coalesce("contact", F.lit("")) != ""
    plan = [
        ("pause", "NS_PAUSE", serious),
        ("contact", "NS_CONTACT_OFFICIAL", given),
        ("sebi-check", "NS_SEBI_CHECK", F.col("payment")),
        ("upi-name", "NS_UPI_NAME", F.col("payment")),
        ("official-app", "NS_OFFICIAL_APP", F.col("app")),
        ("verify-sebi", "NS_VERIFY_SEBI_SITE", F.col("issue")),
        ("chakshu", "NS_REPORT_CHAKSHU", serious),
        ("already-paid", "NS_ALREADY_PAID", F.lit(True)),
        ("sebi-helpline", "NS_SEBI_HELPLINE", F.lit(True)),
    ]
    return facts.select("msg_id", F.explode(F.array_compact(F.array(*(F.when(when, _step(k, name, code, F.col("contact") if name == "contact" else None)) for k, (name, code, when) in enumerate(plan, 1))))).alias("s")).select("msg_id", "s.*")


def _step(priority: int, name: str, code: str, param: Column | None = None) -> Column:
    text_ = lambda x: F.lit(x).cast("string")
    return F.struct(F.lit(name).alias("step"), F.lit(code).alias("code"), F.lit(priority).alias("priority"), text_(LINKS.get(name)).alias("href"), text_(PHONES.get(name)).alias("phone"), (text_(None) if param is None else param).alias("param"))


def recovery_steps(facts: DataFrame) -> DataFrame:
    """Rows (msg_id, step, code, priority, href, phone, param) of facts (msg_id, matched): what to do after paying; the
    sixth step is for senders that matched an official record."""
    steps = [F.when(F.col("matched") if name == "scores" else F.lit(True), _step(k, name, code)) for k, (name, code) in enumerate(RECOVERY, 1)]
    return facts.select("msg_id", F.explode(F.array_compact(F.array(*steps))).alias("s")).select("msg_id", "s.*")


def official_contacts(bindings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows (msg_id, contact, official_name): of bindings (msg_id, seq, record_evidence_id, official_name) the first whose
    evidence (msg_id, id, telephone, email) has a phone or a mailbox; of lists the first of each."""
    first = lambda c: F.trim(F.split_part(F.coalesce(F.col(c), F.lit("")), F.lit(","), F.lit(1)))
    joined = bindings.join(evidence.select("msg_id", F.col("id").alias("record_evidence_id"), "telephone", "email"), ["msg_id", "record_evidence_id"])
    contact = F.concat_ws(" / ", F.nullif(first("telephone"), F.lit("")), F.nullif(first("email"), F.lit("")))
    return first_by(joined.select("msg_id", "seq", contact.alias("contact"), "official_name").where("contact <> ''"), ["msg_id"], ["seq"]).select("msg_id", "contact", "official_name")


def narrative_facts(findings: DataFrame, steps: DataFrame) -> DataFrame:
    """Rows (msg_id, warnings, steps): the first four high or medium findings (msg_id, place, severity, text), and the
    first three steps (msg_id, priority, text)."""
    top = lambda df, by, most: df.withColumn("n", F.row_number().over(Window.partitionBy("msg_id").orderBy(by))).where(F.col("n") <= most).groupBy("msg_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("texts"))
    warned = top(findings.where("severity IN ('high', 'medium')"), "place", 4).withColumnRenamed("texts", "warnings")
    none = F.array().cast("array<string>")
    return top(steps, "priority", 3).withColumnRenamed("texts", "steps").join(warned, "msg_id", "full").select("msg_id", F.coalesce("warnings", none).alias("warnings"), F.coalesce("steps", none).alias("steps"))


def template_narrative(headline: Column, claims: Column, warnings: Column, steps: Column) -> Column:
    """Headline, what supports it most, and the first step, as one text."""
    arrow = F.get(F.filter(claims, lambda c: c.contains("→")), F.lit(0))
    support = F.coalesce(arrow, F.get(warnings, F.lit(0)), F.lit(""))
    told = F.when(support.contains(": "), F.substring(support, F.locate(": ", support) + 2, F.length(support))).otherwise(support)
    parts = F.filter(F.array(headline, told, F.coalesce(F.get(steps, F.lit(0)), F.lit(""))), lambda p: p != "")
    return F.array_join(parts, " ")


def narrative_problems(narrative: Column, facts: Column, locale: Column) -> Column:
    """Array of what is wrong with a narrative: its length, words that judge, numbers or identifiers that facts lack."""
    without = F.regexp_replace(facts, ",", "")
    numbers = F.transform(F.regexp_extract_all(narrative, F.lit(r"(\d[\d,.]*)"), F.lit(1)), lambda n: F.regexp_replace(F.regexp_replace(n, ",", ""), r"\.$", ""))
    unknown = F.transform(F.filter(numbers, lambda n: (n != "") & ~F.contains(without, n)), lambda n: F.concat(F.lit("unknown_number:"), n))
    names = F.regexp_extract_all(narrative, F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|https?://\S+|\b[A-Z]{3}\d{9}\b)"), F.lit(1))
    strange = F.transform(F.filter(names, lambda n: ~F.contains(facts, F.regexp_replace(n, "[.,]$", ""))), lambda n: F.concat(F.lit("unknown_identifier:"), n))
    length = F.when(~F.length(narrative).between(30, 700), "length")
    banned = F.when(narrative.rlike(BANNED) | ((locale == "hi") & narrative.rlike(BANNED_HINDI)), "banned_term")
    return F.concat(F.array_compact(F.array(length, banned)), unknown, strange)


def dictionary_value(value: Column, entries: Column) -> Column:
    """What `@key`, or `@@key,key`, stands for in a map; null unless all keys are there, as other texts may begin so."""
    keys = F.split(F.substring(value, F.lit(3), F.length(value)), ",")
    listed = F.when(F.forall(keys, lambda k: F.map_contains_key(entries, k)), F.array_join(F.transform(keys, lambda k: entries[k]), ", "))
    return F.when(value.startswith("@@"), listed).when(value.startswith("@"), entries[F.substring(value, F.lit(2), F.length(value))])


def format_day(when: Column) -> Column:
    """The day in India of a moment: 4 Oct 2026."""
    local = F.from_utc_timestamp(when, "Asia/Kolkata")
    return F.concat_ws(" ", F.dayofmonth(local).cast("string"), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(local)), F.year(local).cast("string"))


def format_number(n: Column) -> Column:
    """A number with at most two decimals and groups as in India."""
    rounded = F.round(F.abs(n), 2)
    whole = F.floor(rounded)
    part = F.regexp_replace(F.lpad(F.round((rounded - whole) * 100).cast("int").cast("string"), 2, "0"), "0+$", "")
    return F.concat(F.when((n < 0) & (rounded > 0), "-").otherwise(""), text.indian_number(whole.cast("long")), F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))


def tidy(c: Column) -> Column:
    """A filled template without what blank values leave: brackets, and spaces before punctuation."""
    c = F.regexp_replace(F.regexp_replace(c, r"\(\s*[;,]?\s*\)", ""), r"\(\s*;\s*", "(")
    c = F.regexp_replace(F.regexp_replace(c, r";\s*\)", ")"), r"\s+([.,;:!?।)])", "$1")
    return F.trim(F.regexp_replace(c, " {2,}", " "))


def evidence_summary(sections: DataFrame) -> DataFrame:
    """Rows (msg_id, summary): the lines of sections (msg_id, section, title, ord, line) as one text, blank lines between."""
    block = sections.groupBy("msg_id", "section", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    body = F.concat_ws("\n", "title", "lines")
    return block.groupBy("msg_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", body.alias("text")))), lambda x: x["text"]), "\n\n").alias("summary"))


def chat_messages(parts: DataFrame, most: int = 1500) -> DataFrame:
    """Rows (msg_id, bodies) of parts (msg_id, tier, first, second): one body if both fit in `most` characters, else two,
    of the first tier in which each fits; of the last tier, cut, if none does."""
    both = F.concat_ws("\n\n", "first", "second")
    fits = (F.length(both) <= most) | ((F.length("first") <= most) & (F.length("second") <= most))
    cut = lambda c: F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 1), F.lit("…")))
    bodies = F.when(F.length(both) <= most, F.array(both)).otherwise(F.array(cut(F.col("first")), cut(F.col("second"))))
    order = F.when(fits, F.col("tier")).otherwise(1_000_000 - F.col("tier"))
    return parts.groupBy("msg_id").agg(F.min_by(bodies, order).alias("bodies"))


def as_json(rows: DataFrame) -> Column:
    """All columns of rows but msg_id as JSON text."""
    return F.to_json(F.struct(*(c for c in rows.columns if c != "msg_id")))


def report_json(rows: DataFrame) -> DataFrame:
    """Rows (msg_id, report): all other columns of rows as JSON text."""
    return rows.select("msg_id", as_json(rows).alias("report"))


def best_models(probes: DataFrame) -> DataFrame:
    """Of probes (task, model, hits, total, ms) the model of each task with the highest share, then the least time."""
    scored = probes.withColumn("score", F.col("hits") / F.col("total"))
    n = F.row_number().over(Window.partitionBy("task").orderBy(F.desc("score"), "ms", "model"))
    return scored.select("task", "model", "score", n.alias("n")).where("n = 1").drop("n")


def hmac_base64url(key: bytes, value: Column) -> Column:
    """HMAC-SHA256 of a text under a key, in base64 for addresses."""
    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in block).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(value, "utf-8")), 256))
    return F.translate(F.base64(F.unhex(F.sha2(F.concat(pad(0x5C), inner), 256))), "+/=", "-_")


def rule_evidence(results: DataFrame) -> DataFrame:
    """Evidence rows (msg_id, seq, key, kind, title, authority, reference, fields map, url, as_of) of the rules that results
    (msg_id, seq, rules) cite, each once for a message; rules that are not known are left out."""
    known = citations.rules(results.sparkSession)  # fifteen rows
    cited = results.select("msg_id", "seq", F.posexplode("rules").alias("k", "rule_id")).join(F.broadcast(known), "rule_id")
    first = first_by(cited, ["msg_id", "rule_id"], ["seq", "k"])
    primary = F.get("citations", F.lit(0))
    return first.select("msg_id", "seq", F.concat(F.lit("rule:"), "rule_id").alias("key"), F.lit("rule").alias("kind"), F.concat(F.lit("RULE_"), "rule_id").alias("title"), "authority", primary["reference"].alias("reference"), citations.citation_fields(F.col("citations")).alias("fields"), primary["url"].alias("url"), F.col("verified_on").alias("as_of"))


def params(**values: Column) -> Column:
    """A map of what templates are filled with, without what is null."""
    return F.map_filter(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string")))), lambda k, v: v.isNotNull())


def ref(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"@{kind}."), value)


def record_fields() -> Column:
    """What a report shows of a record, whose columns are named as in the register."""
    joined = lambda c, by: F.nullif(F.array_join(c, by), F.lit(""))
    span = F.concat_ws(" – ", F.coalesce(F.col("valid_from").cast("string"), F.lit("?")), F.coalesce(F.col("valid_to").cast("string"), F.lit("Perpetual")))
    return params(name=joined("names", " / "), trade_name=joined("trade_names", " / "), registration_no=F.col("registration_no"), category=F.col("category_label"), validity=span, email=joined("emails", ", "), telephone=joined("phones", ", "), address=F.col("address"), contact_person=F.col("contact_person"), exchange=joined("exchanges", ", "))


def shown_fields(fields: Column, labels: Column) -> Column:
    """Array of structs (key, label, value) of an evidence's fields that have a value, labels from a map."""
    return F.transform(F.map_entries(F.map_filter(fields, lambda k, v: F.coalesce(v, F.lit("")) != "")), lambda e: F.struct(e["key"].alias("key"), F.coalesce(labels[e["key"]], e["key"]).alias("label"), e["value"].alias("value")))


def claim_statements(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows (msg_id, claim_id, code, params map): what each claim asserts, as the code of a template and what fills it."""
    of = lambda kind, id_, value, name: entities.where(F.col("kind") == kind).select("msg_id", F.col("entity_id").alias(id_), value.alias(name))
    a = F.col("attrs")
    j = claims.join(of("reg", "reg_id", F.col("key"), "number"), ["msg_id", "reg_id"], "left").join(of("upi", "upi_id", F.col("key"), "handle"), ["msg_id", "upi_id"], "left")
    j = j.join(of("bank", "bank_id", a["masked"], "account"), ["msg_id", "bank_id"], "left").join(of("url", "url_id", a["host"], "host"), ["msg_id", "url_id"], "left")
    c, there = F.col, lambda x: F.col(x).isNotNull()
    category = ref("cat", F.coalesce("category", F.lit("UNKNOWN")))
    told = [
        ((c("type") == "SEBI_REGISTRATION") & there("number") & there("holder_name"), "CLAIM_REG_NUMBER_NAME", params(holderName=c("holder_name"), regNo=c("number"), category=category)),
        ((c("type") == "SEBI_REGISTRATION") & there("number"), "CLAIM_REG_NUMBER", params(regNo=c("number"), category=category)),
        ((c("type") == "SEBI_REGISTRATION") & there("holder_name"), "CLAIM_REG_NAME", params(holderName=c("holder_name"), category=category)),
        (c("type") == "SEBI_REGISTRATION", "CLAIM_REG_BARE", params(category=category)),
        (c("type") == "IDENTITY", "CLAIM_IDENTITY", params(orgName=c("org_name"))),
        (c("type") == "REGULATOR_ENDORSEMENT", "CLAIM_ENDORSEMENT", params(authority=ref("auth", c("authority")), object=ref("obj", c("object")))),
        ((c("type") == "GUARANTEED_RETURNS") & there("percent"), "CLAIM_RETURNS_RATE", params(kind=ref("kind", c("kind")), percent=format_number(c("percent")), period=ref("period", c("period")))),
        (c("type") == "GUARANTEED_RETURNS", "CLAIM_RETURNS", params(kind=ref("kind", c("kind")))),
        ((c("type") == "PAYMENT_DESTINATION") & there("handle"), "CLAIM_PAYMENT_UPI", params(upi=c("handle"))),
        ((c("type") == "PAYMENT_DESTINATION") & there("account"), "CLAIM_PAYMENT_BANK", params(account=c("account"))),
        (c("type") == "PAYMENT_DESTINATION", "CLAIM_PAYMENT", params(method=ref("method", c("method")))),
        ((c("type") == "APP_INSTALL") & there("host"), "CLAIM_APP_LINK", params(domain=c("host"))),
        ((c("type") == "APP_INSTALL") & there("app_name"), "CLAIM_APP", params(appName=c("app_name"))),
        (c("type") == "APP_INSTALL", "CLAIM_APP_GENERIC", params(kind=F.expr("CAST(NULL AS STRING)"))),
        (c("type") == "SPECIAL_ACCESS", "CLAIM_ACCESS", params(kind=ref("access", c("kind")))),
    ]
    code, own = F, F
    for when, name, values in told:
        code, own = code.when(when, name), own.when(when, values)
    return j.select("msg_id", "claim_id", code.alias("code"), own.alias("params"))


def rendered(rows: DataFrame, catalog: DataFrame, dictionary: DataFrame, most: int = 160) -> DataFrame:
    """rows (locale, code, params map, ...) with `text`: the template of catalog (locale, code, template) filled, each value
    with `most` characters.

    Values that refer to the dictionary (locale, key, value) are what it says, dates are days in India, others are
    cleaned; codes without a template stand for themselves. Both tables are a few hundred rows.
    """
    words = dictionary.groupBy("locale").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("words"))
    j = rows.join(F.broadcast(catalog), ["locale", "code"], "left").join(F.broadcast(words), "locale", "left")
    day = lambda v: format_day(F.to_utc_timestamp(F.try_to_timestamp(v, F.lit("yyyy-MM-dd")), "Asia/Kolkata"))
    value = lambda k, v: F.coalesce(dictionary_value(v, F.col("words")), F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), day(v)), text.sanitise_value(v, most))
    filled = text.fill_template(F.coalesce("template", "code"), F.transform_values("params", value))
    return j.select(*rows.columns, tidy(filled).alias("text"))


def claim_views(statements: DataFrame, results: DataFrame) -> DataFrame:
    """Rows (msg_id, claim_id, statement, verdict, reason, evidence, rules) of statements (msg_id, claim_id, text) and
    results (msg_id, claim_id, verdict, reason, evidence, rules); claims without a result can't be checked."""
    none = F.array().cast("array<string>")
    j = statements.join(results, ["msg_id", "claim_id"], "left")
    return j.select("msg_id", "claim_id", F.col("text").alias("statement"), F.coalesce("verdict", F.lit("CANT_CHECK")).alias("verdict"), F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("evidence", none).alias("evidence"), F.coalesce("rules", none).alias("rules"))


def catalog_gaps(catalog: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (code, problem): templates that one locale lacks, or whose placeholders differ between locales a and b."""
    names = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\{(\w+)\}"), F.lit(1))))
    own = lambda x: catalog.where(F.col("locale") == x).select("code", F.col("template").alias(f"in_{x}"))
    j = own(a).join(own(b), "code", "full")
    left, right = F.col(f"in_{a}"), F.col(f"in_{b}")
    problem = F.when(left.isNull(), f"missing in {a}").when(right.isNull(), f"missing in {b}").when(names(left) != names(right), "placeholders differ")
    return j.select("code", problem.alias("problem")).where("problem IS NOT NULL")

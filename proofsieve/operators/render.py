"""Investigations as reports in a language: views of all parts, chat messages of limited length, and texts to keep."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsieve.functions import catalog
from proofsieve.operators import adjudicate, citations, report
from proofsieve.operators.investigate import Investigation
from proofsieve.operators.report import params
from proofsieve.session import checkpointed, together

# Signs of verdicts; how much of each part a chat message shows, from the fullest version on; limits.
MARKS = {"CONTRADICTED": "❌", "MATCHES": "✅", "NOT_FOUND": "🔍", "CANT_CHECK": "❔"}
TIERS = ((3, 2, 3), (2, 1, 2), (1, 1, 2))  # findings, unchecked, steps
CHAT_CHARS, CHAT_VALUE, COMPACT_CLAIMS = 1500, 90, 8
NOT_IN_CHAT = ("sebi-helpline", "already-paid")
IDENTIFIERS = ("reg", "phone", "upi", "url", "email", "handle", "bank")


@dataclass
class Texts:
    """Parts of investigations with their texts: statements and explanations of claims, findings, what is unchecked, steps,
    headlines (msg_id, headline, counts), each row keyed and ordered."""

    claims: DataFrame
    findings: DataFrame
    unchecked: DataFrame
    steps: DataFrame
    heads: DataFrame


class Speaker:
    """Fills the templates of a language."""

    def __init__(self, spark, locale: str, most: int = 160):
        self.locale, self.most = locale, most
        self.catalog, self.dictionary = catalog.catalog(spark), catalog.dictionary(spark)

    def __call__(self, rows: DataFrame, name: str = "text") -> DataFrame:
        """rows (code, params, ...) with their text."""
        out = report.rendered(rows.withColumn("locale", F.lit(self.locale)), self.catalog, self.dictionary, self.most)
        return out.drop("locale").withColumnRenamed("text", name)

    def word(self, key: Column) -> Column:
        """What a key of the dictionary stands for, itself if nothing."""
        own = {k: texts[catalog.LOCALES.index(self.locale)] for k, texts in (catalog.WORDS | {f"label.{k}": v for k, v in catalog.LABELS.items()}).items()}
        return F.coalesce(F.create_map(*(F.lit(x) for kv in own.items() for x in kv))[key], key)

    def frame(self, code: str, **values: str) -> str:
        """A text that depends on no message."""
        text = catalog.TEMPLATES[code][catalog.LOCALES.index(self.locale)]
        return reduce(lambda t, kv: t.replace("{" + kv[0] + "}", kv[1]), values.items(), text)


def facts(inv: Investigation) -> DataFrame:
    """Rows (msg_id, contradicted, high, payment, app, issue, matched, contact, official_name): what steps depend on."""
    c, some = F.col, lambda when: F.coalesce(F.bool_or(when), F.lit(False))
    r = inv.results.groupBy("msg_id").agg(some(c("verdict") == "CONTRADICTED").alias("contradicted"), some((c("verdict") == "NOT_FOUND") | c("reason").isin("REG_NO_DETAILS", "REG_REAL_SENDER_UNKNOWN")).alias("issue"), some(c("reason") == "ID_CONTACTS_MATCH").alias("matched"))
    f = inv.findings.groupBy("msg_id").agg(some(c("severity") == "high").alias("high"))
    k = inv.claims.groupBy("msg_id").agg(some(c("type") == "PAYMENT_DESTINATION").alias("pays"), some(c("type") == "APP_INSTALL").alias("app"))
    u = inv.entities.where("kind = 'upi'").select("msg_id", F.lit(True).alias("upi")).distinct()
    contacts = report.official_contacts(inv.bindings, inv.evidence.select("msg_id", "id", c("fields")["telephone"].alias("telephone"), c("fields")["email"].alias("email")))
    j = reduce(lambda a, b: a.join(b, "msg_id", "left"), [r, f, k, u, contacts], inv.messages)
    no = lambda x: F.coalesce(x, F.lit(False))
    return j.select("msg_id", *(no(n).alias(n) for n in ("contradicted", "high", "app", "issue", "matched")), (no("pays") | no("upi")).alias("payment"), "contact", "official_name")


def texts(inv: Investigation, speak: Speaker) -> Texts:
    """The parts with their texts; they are checkpoints, as each is shown in several places, and their plans are made at the same time."""
    c = F.col
    statements = speak(report.claim_statements(inv.claims, inv.entities)).select("msg_id", "claim_id", "text")
    told = report.claim_views(statements, inv.results.select("msg_id", "claim_id", "verdict", "reason", "evidence", "rules"))
    why = speak(inv.results.select("msg_id", "claim_id", c("reason").alias("code"), "params"), "why").select("msg_id", "claim_id", "why")
    base = inv.claims.select("msg_id", "claim_id", "seq_no", "type", "quote", "legibility")
    claims = base.join(told, ["msg_id", "claim_id"]).join(why, ["msg_id", "claim_id"], "left").withColumn("why", F.coalesce("why", F.lit("")))
    claims = claims.withColumn("label", speak.word(F.concat(F.lit("verdict."), "verdict")))
    findings = speak(inv.findings).withColumn("label", speak.word(F.concat(F.lit("severity."), "severity")))
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("int")
    unchecked = speak(inv.unchecked).withColumn("n", number)
    known = checkpointed(facts(inv))
    steps = report.next_steps(known).join(known.select("msg_id", "official_name"), "msg_id")
    steps = speak(steps.withColumn("params", params(contact=c("param"), officialName=F.when(c("step") == "contact", c("official_name")))))
    counts = adjudicate.verdict_counts(inv.results)
    lines = adjudicate.headlines(inv.results.select("msg_id", "verdict", "reason"), inv.findings.select("msg_id", "severity"))
    heads = inv.messages.join(lines, "msg_id", "left").join(counts, "msg_id", "left").withColumn("code", F.coalesce("headline", F.lit("H_NO_CLAIMS")))
    heads = speak(heads.withColumn("params", params(count=c("contradicted"))), "headline_text")
    has = inv.claims.select("msg_id").distinct().withColumn("claimed", F.lit(True))
    made_up = inv.evidence.where("fixture").select("msg_id", F.lit(True).alias("made_up")).distinct()
    heads = heads.join(has, "msg_id", "left").join(made_up, "msg_id", "left")
    return Texts(*together(inv.results.sparkSession, *(lambda part=part: checkpointed(part) for part in (claims, findings, unchecked, steps, heads))))


def gathered(rows: DataFrame, order: str, name: str, value: Column) -> DataFrame:
    """Rows (msg_id, name): the values of each message as an array, in their order."""
    own = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])
    return rows.groupBy("msg_id").agg(own.alias(name))


# ---- views


def evidence_views(inv: Investigation, speak: Speaker) -> DataFrame:
    """Rows (msg_id, id, view): what a report shows of a piece of evidence; rules are shown as such."""
    c = F.col
    labels = F.create_map(*(x for k in catalog.LABELS for x in (F.lit(k), speak.word(F.lit(f"label.{k}")))))
    words = {k: v[catalog.LOCALES.index(speak.locale)] for k, v in catalog.WORDS.items()}
    entries = F.create_map(*(F.lit(x) for kv in words.items() for x in kv))
    shown = F.transform(report.shown_fields(c("fields"), labels), lambda f: F.struct(f["key"].alias("key"), f["label"].alias("label"), F.coalesce(report.dictionary_value(f["value"], entries), f["value"]).alias("value")))
    rows = speak(inv.evidence.where("kind <> 'rule'").withColumn("code", c("title")), "told")
    return rows.select("msg_id", "id", F.struct("id", c("told").alias("title"), speak.word(F.concat(F.lit("src."), "source")).alias("source"), "kind", shown.alias("fields"), "url", c("as_of").cast("string").alias("as_of"), c("fixture").alias("made_up")).alias("view"))


def rule_views(inv: Investigation, speak: Speaker) -> DataFrame:
    """Rows (rule_id, view): the statement of each rule, and who says so where."""
    rules = citations.rules(inv.results.sparkSession).withColumns({"code": F.concat(F.lit("RULE_"), "rule_id"), "params": params(none=F.lit(None))})
    return speak(rules, "statement").select("rule_id", F.struct("rule_id", "statement", "authority", "citations").alias("view"))


def _nested(rows: DataFrame, by: str, inv: Investigation, speak: Speaker) -> DataFrame:
    """rows with evidence_views and rule_views, arrays in the order of their ids."""
    e = rows.select("msg_id", by, F.posexplode("evidence").alias("k", "id")) if by != "id" else rows.select("msg_id", F.col("id").alias("own"), F.posexplode("evidence").alias("k", "ev"))
    e = e.withColumnRenamed("id", "ev").withColumnRenamed(by, "own") if by != "id" else e
    e = e.join(evidence_views(inv, speak).withColumnRenamed("id", "ev"), ["msg_id", "ev"])
    collect = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("k", "view"))), lambda x: x["view"]).alias(name)
    e = e.groupBy("msg_id", "own").agg(collect("evidence_views"))
    r = rows.select("msg_id", F.col(by).alias("own"), F.posexplode("rules").alias("k", "rule_id")).join(F.broadcast(rule_views(inv, speak)), "rule_id")  # fifteen rows
    r = r.groupBy("msg_id", "own").agg(collect("rule_views"))
    return rows.withColumn("own", F.col(by)).join(e, ["msg_id", "own"], "left").join(r, ["msg_id", "own"], "left").drop("own")


def views(inv: Investigation, locale: str) -> DataFrame:
    """Rows (msg_id, headline, counts, claims, bindings, findings, unchecked, steps, sources, identifiers): all of a report in a
    language, nested as it is shown. Messages without claims have a report as well."""
    c = F.col
    speak = Speaker(inv.results.sparkSession, locale)
    t = texts(inv, speak)
    caveats = inv.results.select("msg_id", "claim_id", F.posexplode("caveats").alias("k", "v")).select("msg_id", "claim_id", "k", "v.code", "v.params")
    caveats = speak(caveats).groupBy("msg_id", "claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]).alias("caveats"))
    claims = _nested(t.claims, "claim_id", inv, speak).join(caveats, ["msg_id", "claim_id"], "left")
    claim = F.struct("claim_id", "type", "statement", "quote", "verdict", "label", c("why").alias("explanation"), "caveats", c("evidence_views").alias("evidence"), c("rule_views").alias("rules"), "legibility")
    found = _nested(t.findings, "id", inv, speak)
    finding = F.struct("id", "code", "severity", "label", "text", c("evidence_views").alias("evidence"), c("rule_views").alias("rules"))
    status = lambda r: F.when((r["status"] == "same") & r["field"].isin("email", "website"), "bstatus.same_domain").otherwise(F.concat(F.lit("bstatus."), r["status"]))
    compared = F.transform("rows", lambda r: F.struct(r["field"].alias("field"), speak.word(F.concat(F.lit("field."), r["field"])).alias("label"), r["in_message"].alias("in_message"), r["in_record"].alias("in_record"), r["status"].alias("status"), speak.word(status(r)).alias("status_label")))
    bound = F.struct("id", "official_name", "registration_no", "claimed_name", "claim_ids", compared.alias("rows"))
    shown = F.when(c("kind") == "bank", F.concat_ws(" · ", c("attrs")["masked"], c("attrs")["ifsc"])).when(c("kind") == "handle", F.concat_ws(": ", c("attrs")["platform"], "key")).otherwise(c("key"))
    rank = F.array_position(F.array(*map(F.lit, IDENTIFIERS)), c("kind"))
    ids = inv.entities.where(c("kind").isin(*IDENTIFIERS)).withColumn("at", F.struct(rank.alias("rank"), F.regexp_extract("entity_id", r"(\d+)$", 1).cast("int").alias("n")))
    parts = [
        gathered(claims, "seq_no", "claims", claim),
        gathered(inv.bindings, "seq", "bindings", bound),
        gathered(found, "place", "findings", finding),
        gathered(t.unchecked, "n", "unchecked", F.struct("id", "text", "cause")),
        gathered(t.steps, "priority", "steps", F.struct("step", "text", "href", "phone")),
        gathered(inv.runs, "source", "sources", F.struct("source", speak.word(F.concat(F.lit("src."), "source")).alias("name"), "status", "mode", c("as_of").cast("string").alias("as_of"), "stale", "fixture")),
        gathered(ids, "at", "identifiers", F.struct("kind", shown.alias("value"))),
    ]
    counts = F.struct(*(F.coalesce(v.lower(), F.lit(0)).alias(v.lower()) for v in adjudicate.VERDICTS))
    head = t.heads.select("msg_id", c("code").alias("headline_code"), c("headline_text").alias("headline"), counts.alias("counts"))
    return reduce(lambda a, b: a.join(b, "msg_id", "left"), parts, head)


def reports(inv: Investigation, locale: str) -> DataFrame:
    """Rows (msg_id, report): views as JSON."""
    return report.report_json(views(inv, locale))


# ---- chats


def utf16(c: Column) -> Column:
    """The length of a text as chat services count it, in units of sixteen bits."""
    return F.floor(F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def clip(c: Column, most: int) -> Column:
    """A text of `most` units at most, an ellipsis in place of what is cut."""
    return F.when(utf16(c) <= most, c).otherwise(F.concat(F.substring(c, F.lit(1), most - 1 - (utf16(c) - F.length(c))), F.lit("…")))


def _joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), "\n\n")


def section(title: str, lines: Column) -> Column:
    """A titled list, empty without lines."""
    own = F.coalesce(lines, F.array().cast("array<string>"))
    return F.when(F.size(own) > 0, F.concat(F.lit(f"*{title}*\n"), F.array_join(own, "\n"))).otherwise("")


def chat(inv: Investigation, locale: str, url: str | None = None, days: int | None = None, most: int = CHAT_CHARS) -> DataFrame:
    """Rows (msg_id, bodies): one or two messages of `most` units each, the fullest version that fits; else a compact one.

    The first body has headline and claims, the second warnings, what is open, steps and where to go on; they are one
    message if both fit. url is an address with {id} in it, days how long reports are kept, told if given.
    """
    c = F.col
    speak = Speaker(inv.results.sparkSession, locale, CHAT_VALUE)
    t = texts(inv, speak)
    mark = F.create_map(*(F.lit(x) for kv in MARKS.items() for x in kv))[c("verdict")]
    full = F.concat(mark, F.lit(" *"), "label", F.lit("* — "), "statement", F.lit("\n   "), "why")
    short = F.concat_ws(" ", mark, "label", F.lit("—"), "statement")
    shown = t.steps.where(~c("step").isin(*NOT_IN_CHAT)).withColumn("n", F.row_number().over(report.Window.partitionBy("msg_id").orderBy("priority")))
    numbered = F.concat(c("n").cast("string"), F.lit(". "), "text")
    lists = [
        gathered(t.claims, "seq_no", "claims", full),
        gathered(t.claims, "seq_no", "short", short),
        gathered(t.findings.where("severity IN ('high', 'medium')"), "place", "warnings", F.concat(F.lit("⚠️ "), "text")),
        gathered(t.unchecked, "n", "open", F.concat(F.lit("• "), "text")),
        gathered(shown, "n", "steps", F.concat(numbered, F.coalesce(F.concat(F.lit(" "), "href"), F.lit("")))),
        gathered(shown, "n", "bare_steps", numbered),
    ]
    x = reduce(lambda a, b: a.join(b, "msg_id", "left"), lists, t.heads)
    head = F.concat(F.lit(f"*{speak.frame('UI_REPORT_TITLE')}* 🔎\n"), "headline_text")
    link = F.lit("") if url is None else F.concat(F.lit(speak.frame("UI_FULL_REPORT") + ": "), F.replace(F.lit(url), F.lit("{id}"), c("msg_id").cast("string")))
    tail = _joined(link, F.lit(speak.frame("WA_MENU")), F.lit("" if days is None else speak.frame("WA_PRIVACY", days=str(days))))
    made_up = F.when(c("made_up"), "⚠️ " + speak.frame("UI_FIXTURE_BANNER")).otherwise("")
    claims = F.when(c("claimed"), section(speak.frame("UI_CLAIMS"), c("claims"))).otherwise(speak.frame("WA_NOTHING_TO_CHECK"))
    x = x.withColumns({"head": head, "tail": tail}).withColumn("first", _joined(made_up, c("head"), claims))
    part = lambda name, n: F.slice(c(name), 1, n)
    for k, (findings, unchecked, steps) in enumerate(TIERS):
        second = _joined(section(speak.frame("UI_WARNINGS"), part("warnings", findings)), section(speak.frame("UI_UNCHECKED"), part("open", unchecked)), section(speak.frame("UI_NEXT"), part("steps", steps)), c("tail"))
        x = x.withColumn(f"second{k}", second)
        single = F.concat_ws("\n\n", "first", f"second{k}")
        own = F.when(utf16(single) <= most, F.array(single)).when((utf16(c("first")) <= most) & (utf16(c(f"second{k}")) <= most), F.array("first", f"second{k}"))
        x = x.withColumn(f"tier{k}", own)
    compact = F.array(clip(_joined(c("head"), section(speak.frame("UI_CLAIMS"), part("short", COMPACT_CLAIMS))), most), clip(_joined(section(speak.frame("UI_NEXT"), part("bare_steps", 2)), c("tail")), most))
    return x.select("msg_id", F.coalesce(*(c(f"tier{k}") for k in range(len(TIERS))), compact).alias("bodies"))


def recovery(asked: DataFrame, inv: Investigation, locale: str, url: str | None = None, most: int = CHAT_CHARS) -> DataFrame:
    """Rows (msg_id, body) for asked (msg_id) of those who have paid: the steps for a message with a report, in general for one
    without."""
    speak = Speaker(inv.results.sparkSession, locale, CHAT_VALUE)
    steps = speak(report.recovery_steps(facts(inv)).withColumn("params", params(none=F.lit(None)))).withColumn("n", F.row_number().over(report.Window.partitionBy("msg_id").orderBy("priority")))
    lines = gathered(steps, "n", "lines", F.concat(F.col("n").cast("string"), F.lit(". "), "text", F.coalesce(F.concat(F.lit(" "), "href"), F.lit(""))))
    link = F.lit("") if url is None else F.concat(F.lit(speak.frame("UI_SUMMARY_TITLE") + ": "), F.replace(F.lit(url), F.lit("{id}"), F.col("msg_id").cast("string")))
    body = clip(_joined(F.lit(f"*{speak.frame('UI_RECOVERY')}*"), F.array_join("lines", "\n"), link), most)
    return asked.select("msg_id").distinct().join(lines, "msg_id", "left").select("msg_id", F.when(F.col("lines").isNull(), speak.frame("WA_PAID_NO_REPORT")).otherwise(body).alias("body"))


# ---- narratives


def narratives(inv: Investigation, locale: str, written: DataFrame) -> DataFrame:
    """Rows (msg_id, narrative, problems): a few sentences for each message. A model's (written: msg_id, text) count if they only
    restate what the report says; else, and where there are none, the report's own."""
    c = F.col
    t = texts(inv, Speaker(inv.results.sparkSession, locale))
    own = report.narrative_facts(t.findings, t.steps)
    claims = gathered(t.claims, "seq_no", "claims", F.concat("statement", F.lit(" → "), "label", F.lit(": "), "why"))
    none = F.array().cast("array<string>")
    x = t.heads.select("msg_id", c("headline_text").alias("headline")).join(own, "msg_id", "left").join(claims, "msg_id", "left").join(written.select("msg_id", c("text").alias("told")), "msg_id", "left")
    x = x.select("msg_id", "headline", "told", *(F.coalesce(n, none).alias(n) for n in ("claims", "warnings", "steps")))
    facts_ = F.concat_ws(" ", "headline", F.array_join("claims", " "), F.array_join("warnings", " "), F.array_join("steps", " "))
    x = x.withColumn("problems", F.when(c("told").isNotNull(), report.narrative_problems(c("told"), facts_, F.lit(locale))))
    plain = report.template_narrative(c("headline"), c("claims"), c("warnings"), c("steps"))
    return x.select("msg_id", F.when(F.size("problems") == 0, c("told")).otherwise(plain).alias("narrative"), F.coalesce("problems", none).alias("problems"))


# ---- texts to keep


def summary(inv: Investigation, locale: str, made: Column, url: str | None = None) -> DataFrame:
    """Rows (msg_id, summary): what is claimed and what records say, warnings, identifiers and sources, as plain text to add to
    a complaint."""
    c = F.col
    speak = Speaker(inv.results.sparkSession, locale)
    t = texts(inv, speak)
    frame = speak.frame
    line = lambda rows, n, title, order, text: rows.select("msg_id", F.lit(n).alias("section"), F.lit(title).alias("title"), order.cast("struct<a:long,b:long>").alias("ord"), text.alias("line"))
    at = lambda a, b: F.struct((F.lit(a) if isinstance(a, int) else c(a)).cast("long").alias("a"), (F.lit(b) if isinstance(b, int) else c(b)).cast("long").alias("b"))
    dated = lambda when: F.when(when.isNull(), "").otherwise(F.concat(F.lit(" ("), F.replace(F.lit(frame("UI_AS_OF")), F.lit("{date}"), report.format_day(F.to_utc_timestamp(when.cast("timestamp"), "Asia/Kolkata"))), F.lit(")")))
    cited = t.claims.select("msg_id", "seq_no", F.posexplode("evidence").alias("k", "id"))
    titles = speak(inv.evidence.withColumn("code", c("title")), "told").select("msg_id", "id", "told", "as_of", "url")
    cited = cited.join(titles, ["msg_id", "id"]).withColumn("k", c("k") + 3)
    link = [] if url is None else [line(inv.messages, 0, frame("UI_SUMMARY_TITLE"), at(0, 2), F.concat(F.lit(frame("UI_LINK") + ": "), F.replace(F.lit(url), F.lit("{id}"), c("msg_id").cast("string"))))]
    names = {"reg": "Reg.", "phone": "Phone", "upi": "UPI", "url": "Link", "email": "Mail", "handle": "Handle", "bank": "Bank"}
    kinds = inv.entities.where(c("kind").isin(*names)).withColumn("n", F.regexp_extract("entity_id", r"(\d+)$", 1).cast("long"))
    value = F.when(c("kind") == "bank", F.concat_ws(" / ", c("attrs")["masked"], c("attrs")["ifsc"])).otherwise(c("key"))
    listed = kinds.groupBy("msg_id", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", value.alias("v")))), lambda x: x["v"]), ", ").alias("values"))
    label = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[c("kind")]
    rank = F.array_position(F.array(*map(F.lit, names)), c("kind"))
    sections = [
        line(inv.messages, 0, frame("UI_SUMMARY_TITLE"), at(0, 0), F.concat(F.lit(frame("UI_REPORT_ID") + ": "), c("msg_id").cast("string"))),
        line(inv.messages, 0, frame("UI_SUMMARY_TITLE"), at(0, 1), F.concat(F.lit(frame("UI_CREATED") + ": "), report.format_day(made))),
        *link,
        line(t.heads.where("made_up"), 0, frame("UI_SUMMARY_TITLE"), at(0, 3), F.lit("!! " + frame("UI_FIXTURE_BANNER"))),
        line(t.heads.where("claimed IS NULL"), 1, frame("UI_CLAIMS") + ":", at(0, 0), F.concat(F.lit("- "), F.lit(frame("H_NO_CLAIMS")))),
        line(t.claims, 1, frame("UI_CLAIMS") + ":", at("seq_no", 0), F.concat(c("seq_no").cast("string"), F.lit('. "'), "quote", F.lit('"'))),
        line(t.claims, 1, frame("UI_CLAIMS") + ":", at("seq_no", 1), F.concat(F.lit("   → "), "statement")),
        line(t.claims, 1, frame("UI_CLAIMS") + ":", at("seq_no", 2), F.concat(F.lit("   "), "label", F.lit(": "), "why")),
        line(cited, 1, frame("UI_CLAIMS") + ":", at("seq_no", "k"), F.concat(F.lit(f"   {frame('UI_SOURCE')}: "), "told", dated(c("as_of")), F.coalesce(F.concat(F.lit(" — "), "url"), F.lit("")))),
        line(t.findings.where("severity <> 'info'"), 2, frame("UI_WARNINGS") + ":", at("place", 0), F.concat(F.lit("- "), "text")),
        line(listed.withColumn("rank", rank), 3, frame("UI_IDENTIFIERS") + ":", at("rank", 0), F.concat(F.lit("- "), label, F.lit(": "), "values")),
        line(inv.runs.withColumn("rank", F.dense_rank().over(report.Window.partitionBy("msg_id").orderBy("source"))), 4, frame("UI_SOURCES") + ":", at("rank", 0), F.concat(F.lit("- "), speak.word(F.concat(F.lit("src."), "source")), F.lit(" ["), "status", F.lit("]"), dated(c("as_of")))),
    ]
    out = report.evidence_summary(reduce(DataFrame.unionByName, sections))
    return out.select("msg_id", F.concat("summary", F.lit("\n\n" + frame("UI_DISCLAIMER"))).alias("summary"))

"""The whole check of messages: lookups for all of them together, verdicts, findings, bindings and evidence.

Messages ask for numbers, names, alert entries and domains. What is asked is looked up once, however many messages ask,
and joined back; a source that is down answers nothing, which its row of the status table says. Verdicts come from
decision tables over the joined rows; the same rows give caveats, findings, bindings and evidence. Every table is keyed by
message, and what has an order carries it in `seq`: registrations come before other claims, those before signals.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsieve.functions import identifiers
from proofsieve.operators import adjudicate, claims, registry, report, verify
from proofsieve.operators.claims import first_by
from proofsieve.operators.report import params, ref
from proofsieve.session import checkpointed, small_side, together

# Sources, and the page that says how registers are searched.
REGISTER, ALERTS, AGES, RULES = "sebi_intermediaries", "rbi_alert_list", "domain_rdap", "rules"
SEARCHED_AT = "https://www.sebi.gov.in/intermediaries.html"
SUFFIX_LABELS = {"brk": "Stock broker", "bti": "Banker to an issue", "dp": "Depository participant", "ra": "Research analyst", "ia": "Investment adviser", "invit": "InvIT", "mf": "Mutual fund", "pms": "Portfolio manager", "sreit": "SM REIT", "reit": "REIT"}
#: What a record of the register has.
RECORD = ("record_id", "registration_no", "category", "category_label", "names", "trade_names", "contact_person", "emails", "phones", "address", "city", "exchanges", "valid_from", "valid_to", "source_url")
REASONS = "array<struct<code string, params map<string, string>>>"
TEXTS = "array<string>"
#: Findings as they are gathered.
FINDING = ("msg_id", "seq", "key", "kind", "severity", "code", "params", "evidence_keys", "rules", "claim_ids")
EVIDENCE = ("msg_id", "seq", "key", "source", "kind", "title", "params", "fields", "url")
CLAIM, SIGNAL = 1_000_000, 1_000_000_000_000


@dataclass
class Sources:
    """What messages are checked against.

    registry has RECORD without record_id, and ord, the order of records of one number; inactive (registration_no, name,
    category_label, status, source_url); alerts (name, websites, domains, list_url); domains (domain, status,
    registered_on, registrar, rdap_url); covered (category); access (source, up, mode, as_of, retrieved_at, stale,
    fixture), a row for each source; live (number, status found | not_found | failed) may be left out.
    """

    registry: DataFrame
    inactive: DataFrame
    alerts: DataFrame
    domains: DataFrame
    covered: DataFrame
    access: DataFrame
    live: DataFrame | None = None


@dataclass
class Found:
    """Answers: to numbers, names, alert names and domains, and how each source did for each message."""

    records: DataFrame
    numbers: DataFrame
    variants: DataFrame
    searches: DataFrame
    alerts: DataFrame
    domains: DataFrame
    runs: DataFrame


@dataclass
class Investigation:
    """Tables keyed by message: messages, claims, results, findings, unchecked, bindings, evidence, runs, entities,
    organizations, and how many of a model's items were discarded."""

    messages: DataFrame
    claims: DataFrame
    results: DataFrame
    findings: DataFrame
    unchecked: DataFrame
    bindings: DataFrame
    evidence: DataFrame
    runs: DataFrame
    entities: DataFrame
    organizations: DataFrame
    discarded: DataFrame


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _is(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _texts(*names: str) -> Column:
    return F.array(*map(F.lit, names)).cast(TEXTS)


def _reason(when: Column, code: str, values: Column | None = None) -> Column:
    """An item of an array of reasons, null unless `when` holds."""
    return F.when(when, F.struct(F.lit(code).alias("code"), (F.create_map().cast("map<string, string>") if values is None else values).alias("params")))


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


# ---- looking up


def look_up(r: claims.Read, built: DataFrame, orgs: DataFrame, apps: DataFrame, sources: Sources) -> Found:
    """Answers to all that claims (claims.build) and entities of messages ask for."""
    spark = built.sparkSession
    access = F.broadcast(sources.access)  # a row for each source
    of_source = lambda df, name: df.withColumn("source", F.lit(name)).join(access, "source", "left").withColumn("up", _is(F.col("up")))
    records = checkpointed(sources.registry.withColumn("record_id", F.concat_ws(":", "registration_no", "category")).select(*RECORD, "ord"))
    regs = r.entities.where("kind = 'reg'").select("msg_id", F.col("entity_id").alias("reg_id"), F.col("key").alias("number"), "legibility")

    asked_names, asked_domains = verify.alert_plan(orgs, apps, r.entities)

    def of_numbers() -> tuple[DataFrame, DataFrame, DataFrame]:
        wanted = verify.number_plan(built, r.entities, sources.covered)
        told = of_source(verify.lookups(wanted, records, sources.inactive, sources.live), REGISTER)
        gone = first_by(sources.inactive, ["registration_no"], ["status"]).select(F.col("registration_no").alias("number"), F.struct("name", "category_label", "source_url").alias("inactive"))
        numbers = told.join(gone, "number", "left").select("number", F.when(F.col("up"), F.col("status")).otherwise("unavailable").alias("status"), "inactive_status", "inactive")
        numbers = checkpointed(numbers)
        variants, searches = together(spark, lambda: of_variants(numbers), lambda: of_names(numbers))
        return numbers, variants, searches

    def of_variants(numbers: DataFrame) -> DataFrame:
        unclear = regs.where("legibility = 'uncertain'").join(numbers.where("status = 'not_found'"), "number").select("msg_id", F.col("number").alias("normalized"))
        hits = registry.variant_hits(unclear, records).withColumnRenamed("normalized", "number")
        one = first_by(records, ["registration_no"], ["ord"]).select(F.col("registration_no").alias("variant"), verify.display_name(F.struct(*RECORD)).alias("variant_name"))
        return checkpointed(hits.select("msg_id", "number", F.when(F.size("hits") == 1, F.col("hits")[0]).alias("variant")).join(one, "variant", "left"))

    def of_names(numbers: DataFrame) -> DataFrame:
        names = checkpointed(verify.name_plan(built, r.entities, numbers))
        rec = F.struct(*RECORD)
        near = registry.search_names(names.select(F.col("name").alias("query")), records.select(F.col("record_id").alias("registration_no"), verify.search_text(rec).alias("name")), top=30)
        near = near.withColumnRenamed("registration_no", "record_id").join(records.select(*RECORD), "record_id")
        ranked = verify.rank_by_name(near.select("query", "place", "record_id", "names", "trade_names", "contact_person")).where("rank <= 5")
        candidates = ranked.where("result = 'same'").join(records.select("record_id", rec.alias("rec")), "record_id").groupBy(F.col("query").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "rec"))), lambda x: x["rec"]).alias("same"))
        searches = of_source(names, REGISTER).join(candidates, "name", "left").select("name", F.when(F.col("up"), F.col("same")).alias("same"), F.col("up").alias("searched"))
        return checkpointed(searches)

    def of_alerts() -> DataFrame:
        by_name = registry.match_alerts(asked_names, sources.alerts).select("msg_id", "alert", F.col("name").alias("query"), F.lit("name").alias("matched_on"))
        by_domain = verify.match_alert_domains(asked_domains, sources.alerts).select("msg_id", "alert", F.col("domain").alias("query"), F.lit("domain").alias("matched_on"))
        matched = first_by(by_name.unionByName(by_domain).withColumn("later", F.col("matched_on") == "domain"), ["msg_id", "alert"], ["later", "query"]).drop("later")
        return checkpointed(of_source(matched, ALERTS).where("up").select("msg_id", "alert", "query", "matched_on"))

    def of_domains() -> DataFrame:
        ages = verify.domain_lookups(verify.domain_plan(r.entities), sources.domains)
        links = sources.domains.select("domain", "rdap_url")
        ages = of_source(ages, AGES).join(links, "domain", "left").select("msg_id", "domain", "place", F.when(F.col("up"), F.col("status")).otherwise("unavailable").alias("status"), "registered_on", "registrar", "rdap_url")
        return checkpointed(ages)

    (numbers, variants, searches), alerts, ages = together(spark, of_numbers, of_alerts, of_domains)
    number_asks = built.where("type = 'SEBI_REGISTRATION'").join(regs, ["msg_id", "reg_id"]).join(numbers, "number").select("msg_id", "number", (F.col("status") != "unavailable").alias("ok")).distinct()
    name_asks = built.select("msg_id", F.explode(F.array("holder_name", "org_name")).alias("name")).distinct().join(searches, "name").select("msg_id", F.col("searched").alias("ok"))
    alert_asks = asked_names.select("msg_id").unionByName(asked_domains.select("msg_id")).distinct().withColumn("ok", F.lit(True))
    asks = [(number_asks.select("msg_id", "ok"), REGISTER, 0), (name_asks, REGISTER, 1), (alert_asks, ALERTS, 2), (ages.select("msg_id", (F.col("status") != "unavailable").alias("ok")), AGES, 3)]
    log = _union([df.select("msg_id", "ok", F.lit(name).alias("source"), F.lit(n).alias("ord")) for df, name, n in asks]).join(access, "source", "left")
    ok = _is(F.col("up")) & F.col("ok")
    log = log.select("msg_id", "source", "ord", F.when(ok, "ok").otherwise("unavailable").alias("status"), F.coalesce("mode", F.lit("live")).alias("mode"), _none("long").alias("ms"), F.when(ok, F.col("as_of")).alias("as_of"), _is(F.col("stale")).alias("stale"), _is(F.col("fixture")).alias("fixture"))
    return Found(records, numbers, variants, searches, alerts, ages, checkpointed(registry.source_runs(log)))


# ---- registrations and identities


def registrations(r: claims.Read, built: DataFrame, found: Found, sources: Sources, now: Column) -> DataFrame:
    """Claims to be registered, each with its reason, params, evidence key, rules, caveats, and the record it led to (rec)."""
    a, c = F.col("attrs"), F.col
    regs = r.entities.where("kind = 'reg'").select("msg_id", c("entity_id").alias("reg_id"), c("key").alias("number"), "raw", a["scheme"].alias("scheme"), (a["format_valid"] == "true").alias("format_valid"), (c("legibility") == "clear").alias("clear"))
    x = built.where("type = 'SEBI_REGISTRATION'").select("msg_id", "claim_id", "seq_no", "category", "reg_id", "holder_name", "holder_binding", (c("legibility") == "clear").alias("claim_clear")).join(regs, ["msg_id", "reg_id"], "left")
    covered = sources.covered.select(c("category").alias("register")).distinct().withColumn("covered", F.lit(True))
    x = x.withColumn("register", identifiers.dimension(identifiers.CATEGORY)[c("scheme")]).join(F.broadcast(covered), "register", "left")  # twelve rows
    x = x.join(small_side(found.numbers), "number", "left")
    rec = F.struct(*RECORD)
    listed = found.records.groupBy(c("registration_no").alias("number")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", rec.alias("rec")))), lambda y: y["rec"]).alias("recs"))
    x = checkpointed(x.join(listed, "number", "left").withColumn("recs", F.when(c("status") == "found", c("recs"))))
    pairs = x.select(c("holder_name").alias("name"), "number", F.explode("recs").alias("rec")).select("name", "number", "rec.record_id")
    rank = identifiers.dimension({k: str(v) for k, v in verify.RANKS.items()})[c("result")].cast("int")
    alike = pairs.distinct().join(verify.compared(pairs, found.records), ["name", "record_id"]).groupBy(c("name").alias("holder_name"), "number").agg(F.max_by("result", rank).alias("comparison"))
    x = x.join(alike, ["holder_name", "number"], "left").withColumn("comparison", F.coalesce("comparison", F.lit("inconclusive")))
    x = x.join(found.searches.select(c("name").alias("holder_name"), "same", "searched"), "holder_name", "left").join(found.variants, ["msg_id", "number"], "left")
    x = x.join(F.broadcast(sources.access.where(c("source") == REGISTER).select("mode", "as_of", "stale", "fixture").withColumn("there", F.lit(True))), F.lit(True), "left")  # one row at most
    there = c("number").isNotNull()
    hit = F.size(F.coalesce("same", F.array().cast(x.schema["same"].dataType)))
    first = F.get("recs", F.lit(0))
    active = F.when(there, F.exists("recs", lambda y: registry.is_active(y["valid_to"], now))).otherwise(registry.is_active(F.get("same", F.lit(0))["valid_to"], now))
    x = x.withColumns({"rec": F.when(there, first).when(hit == 1, F.get("same", F.lit(0))), "hits": hit, "active": _is(active), "there": there})
    found_ = c("status") == "found"
    numbered = adjudicate.registration_reason(_is(c("covered")), _is(c("format_valid")), _is(c("clear")), _is(c("status") != "unavailable"), _is(found_), _is(c("status") == "inactive"), c("active"), F.coalesce("holder_binding", F.lit("none")), c("comparison"), c("rec")["valid_to"].isNull(), c("claim_clear"))
    numbered = F.when(numbered.isin("REG_MATCH", "REG_MATCH_PERPETUAL", "REG_NAME_SIMILAR") & c("holder_name").isNull(), "REG_REAL_SENDER_UNKNOWN").otherwise(numbered)
    x = x.withColumn("reason", F.when(there, numbered).otherwise(adjudicate.bare_registration_reason(c("holder_name").isNotNull(), _is(c("searched")), c("hits"), c("active"))))
    reason, official = c("reason"), verify.display_name(c("rec"))
    own = F.when(reason == "REG_NO_DETAILS", F.coalesce("category", F.lit("UNKNOWN"))).otherwise(c("rec")["category"])
    categories = sources.covered.agg(F.sort_array(F.collect_set("category")).alias("every"))
    x = x.join(F.broadcast(categories), F.lit(True), "left")  # one row
    values = params(
        regNo=F.when(reason.isin("REG_UNCLEAR_NUMBER", "REG_FORMAT_INVALID"), c("raw")).otherwise(F.coalesce("number", c("rec")["registration_no"])),
        claimedName=c("holder_name"),
        officialName=F.coalesce(F.when(reason == "REG_INACTIVE", c("inactive")["name"]), F.when(c("rec").isNotNull(), official)),
        officialCity=F.when(reason == "REG_BELONGS_TO_OTHER", verify.city_of(c("rec"))),
        category=ref("cat", own),
        validTo=c("rec")["valid_to"],
        status=F.when(reason == "REG_INACTIVE", ref("regstatus", c("inactive_status"))),
        scheme=F.when(reason == "REG_SCHEME_NOT_COVERED", ref("scheme", c("scheme"))),
        shape=F.when(reason == "REG_FORMAT_INVALID", identifiers.shape_of(c("scheme"))),
        count=F.when(reason == "REG_NAME_AMBIGUOUS", c("hits")),
        registers=F.when(reason.isin("REG_NOT_IN_REGISTER", "REG_NAME_NOT_FOUND"), adjudicate.registers_param(c("every"))),
        asOf=F.when(reason.isin("REG_NOT_IN_REGISTER", "REG_NAME_NOT_FOUND"), c("as_of")),
    )
    absent = reason.isin("REG_NOT_IN_REGISTER", "REG_NAME_NOT_FOUND") | ((reason == "REG_UNCLEAR_NUMBER") & _is(c("status").isin("not_found", "inactive")))
    key = F.when(c("rec").isNotNull(), F.concat(F.lit("sebi:"), c("rec")["registration_no"])).when(reason == "REG_INACTIVE", F.concat(F.lit("sebi-inactive:"), "number")).when(absent, F.concat(F.lit("sebi-absent:"), F.coalesce("number", "holder_name")))
    aged = F.when(c("status").isin("found", "not_found", "inactive") | (reason == "REG_NAME_NOT_FOUND"), True).otherwise(False)
    differs = there & c("category").isNotNull() & (c("category") != "OTHER") & _is(~F.exists("recs", lambda y: y["category"] == c("category")))
    elsewhere = F.get(F.filter("same", lambda y: y["registration_no"] != c("number")), F.lit(0))
    named_elsewhere = there & c("active") & c("holder_name").isNotNull() & (c("comparison") != "same") & elsewhere.isNotNull()
    of_categories = params(claimedCategory=ref("cat", c("category")), actualCategory=ref("cat", c("rec")["category"]), regNo=c("number"))
    caveats = F.array_compact(F.array(
        _reason(aged & _is(c("fixture")), "CAVEAT_FIXTURE"),
        _reason(aged & _is(c("stale")), "CAVEAT_SNAPSHOT_STALE", params(asOf=c("as_of"))),
        _reason((reason == "REG_UNCLEAR_NUMBER") & c("variant").isNotNull() & _is(c("status") == "not_found"), "CAVEAT_POSSIBLE_READING", params(variant=c("variant"), officialName=c("variant_name"))),
        _reason(~there & c("rec").isNotNull(), "CAVEAT_NO_NUMBER_GIVEN"),
        _reason(differs, "CAVEAT_CATEGORY_DIFFERS", of_categories),
        _reason(named_elsewhere, "CAVEAT_CLAIMED_NAME_REGISTERED_ELSEWHERE", params(claimedName=c("holder_name"), otherRegNo=elsewhere["registration_no"])),
    )).cast(REASONS)
    rules = F.when(~there & (c("rec").isNotNull() | (reason == "REG_NO_DETAILS")), _texts("REGISTRATION_DETAILS_IN_COMMUNICATIONS")).otherwise(_texts())
    absence = params(searched=adjudicate.registers_param(c("every")), as_on=c("as_of"), mode=c("mode"))
    gone = params(name=c("inactive")["name"], registration_no=c("number"), category=c("inactive")["category_label"], status=c("inactive_status"))
    return checkpointed(x.select(
        "msg_id", "claim_id", "seq_no", "number", "holder_name", "category", "comparison", "rec", "reason", values.alias("params"), key.alias("evidence_key"), rules.alias("rules"), caveats.alias("caveats"),
        differs.alias("differs"), of_categories.alias("of_categories"), F.when(reason == "REG_INACTIVE", gone).when(absent, absence).alias("fields"), c("inactive")["source_url"].alias("inactive_url"), "inactive_status",
    ))


def identities(r: claims.Read, built: DataFrame, regs: DataFrame, found: Found, sources: Sources) -> tuple[DataFrame, DataFrame]:
    """(claims to be someone, contacts): claims with reason, params, evidence key, rules, caveats and the record (rec) that the
    sender is held against; contacts (msg_id, record_id, field, in_message, in_record, status, official_domain) of all
    records that messages were held against."""
    c, a = F.col, F.col("attrs")
    x = built.where("type = 'IDENTITY'").select("msg_id", "claim_id", "seq_no", "org_name", "presented_as")
    x = x.withColumns({"sebi": verify.is_sebi_name(c("org_name")), "regulator": verify.is_regulator_name(c("org_name"))})
    number = F.regexp_extract("entity_id", r"(\d+)$", 1).cast("int")
    strange = r.entities.where("kind = 'email'").where(~a["address"].endswith("@sebi.gov.in")).groupBy("msg_id").agg(F.min_by(a["address"], number).alias("email"))
    led = regs.where("rec IS NOT NULL").select("msg_id", c("seq_no").alias("reg_seq"), "rec")
    tried = x.select("msg_id", c("org_name").alias("name")).join(led, "msg_id")
    tried = tried.withColumn("record_id", c("rec.record_id"))
    own = tried.join(verify.compared(tried, found.records).where("result = 'same'"), ["name", "record_id"]).groupBy("msg_id").agg(F.min_by("rec", "reg_seq").alias("own"))
    x = x.join(strange, "msg_id", "left").join(own, "msg_id", "left").join(found.searches.select(c("name").alias("org_name"), "same", "searched"), "org_name", "left")
    x = checkpointed(x.withColumn("same", F.when(~c("sebi") & ~c("regulator") & c("own").isNull(), c("same"))))

    held = _union([x.select("msg_id", c("own.record_id").alias("record_id")), x.select("msg_id", F.explode("same").alias("s")).select("msg_id", "s.record_id"), regs.select("msg_id", c("rec.record_id").alias("record_id"))]).where("record_id IS NOT NULL").distinct()
    compared = verify.compare_contacts(held, r.entities, found.records.select("record_id", "phones", "emails"))
    sites = verify.official_domains(found.records.select("record_id", "emails")).groupBy("record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "domain"))), lambda y: y["domain"]), ", ").alias("sites"))
    listed = lambda col: F.nullif(F.array_join(col, ", "), F.lit(""))
    books = found.records.select("record_id", listed("phones").alias("phones"), listed("emails").alias("emails")).join(sites, "record_id", "left")
    in_record = F.when(c("field") == "phone", c("phones")).when(c("field") == "email", c("emails")).otherwise(c("sites"))
    contacts = checkpointed(compared.join(books, "record_id", "left").select("msg_id", "record_id", "field", "in_message", in_record.alias("in_record"), "status", "official_domain"))

    several = x.where(F.size("same") > 1).select("msg_id", F.explode("same").alias("rec")).withColumn("record_id", c("rec.record_id"))
    agreeing = contacts.where("status = 'same'").select("msg_id", "record_id").distinct()
    chosen = several.join(agreeing, ["msg_id", "record_id"]).groupBy("msg_id").agg(F.count("*").alias("n"), F.any_value("rec").alias("chosen")).where("n = 1").drop("n")
    n = F.size(F.coalesce("same", F.array().cast(x.schema["same"].dataType)))
    x = x.join(chosen, "msg_id", "left").withColumn("hits", n).withColumn("rec", F.coalesce("own", F.when(n == 1, F.get("same", F.lit(0))), "chosen"))
    x = x.withColumn("record_id", c("rec.record_id"))
    given = contacts.where("in_message IS NOT NULL").groupBy("msg_id", "record_id").agg(*(F.sort_array(F.collect_list(F.when(c("status").isin(*s), c("in_message")))).alias(k) for k, s in (("agree", ("same",)), ("off", ("lookalike", "not_in_record")), ("every", ("same", "lookalike", "not_in_record", "record_has_none")))))
    x = x.join(given, ["msg_id", "record_id"], "left")
    size = lambda k: F.size(F.coalesce(k, _texts()))
    ambiguous = (c("hits") > 1) & c("chosen").isNull()
    reason = adjudicate.identity_reason(c("sebi"), c("email").isNotNull(), c("regulator"), c("rec").isNotNull(), ambiguous, c("presented_as") == "intermediary", _is(c("searched")), size("every"), size("agree"), size("off"))
    x = x.withColumn("reason", reason).join(F.broadcast(sources.access.where(c("source") == REGISTER).select("mode", "as_of")), F.lit(True), "left")  # one row
    x = x.join(F.broadcast(sources.covered.agg(F.sort_array(F.collect_set("category")).alias("searched_in"))), F.lit(True), "left")  # one row
    reason = c("reason")
    channels = F.when(reason == "ID_CONTACTS_MATCH", F.array_join("agree", ", ")).when(reason == "ID_CONTACTS_NOT_ON_RECORD", F.coalesce(F.nullif(F.array_join("off", ", "), F.lit("")), F.array_join("every", ", ")))
    values = params(
        email=F.when(reason == "ID_SEBI_EMAIL_MISMATCH", c("email")),
        orgName=F.when(c("rec").isNull() & (reason != "ID_SEBI_EMAIL_MISMATCH"), c("org_name")),
        count=F.when(reason == "ID_AMBIGUOUS", c("hits")),
        officialName=F.when(c("rec").isNotNull(), verify.display_name(c("rec"))),
        channels=channels,
        asOf=F.when(reason == "ID_NOT_IN_REGISTER", c("as_of")),
    )
    key = F.when(reason.isin("ID_NO_CONTACTS", "ID_CONTACTS_MATCH", "ID_CONTACTS_NOT_ON_RECORD"), F.concat(F.lit("sebi:"), c("rec")["registration_no"])).when(reason == "ID_NOT_IN_REGISTER", F.concat(F.lit("sebi-absent:"), "org_name"))
    caveats = F.array_compact(F.array(_reason(reason == "ID_CONTACTS_MATCH", "CAVEAT_CONTACTS_CAN_BE_COPIED"))).cast(REASONS)
    absence = F.when(reason == "ID_NOT_IN_REGISTER", params(searched=adjudicate.registers_param(c("searched_in")), as_on=c("as_of"), mode=c("mode")))
    rules = F.when(c("sebi"), _texts("SEBI_EMAIL_DOMAIN")).otherwise(_texts())
    out = x.select("msg_id", "claim_id", "seq_no", "org_name", "rec", "same", "reason", values.alias("params"), key.alias("evidence_key"), rules.alias("rules"), caveats.alias("caveats"), absence.alias("fields"))
    return checkpointed(out), contacts


# ---- other claims


def other_results(r: claims.Read, built: DataFrame, regs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(results, findings) of promised returns, endorsements, payments, apps and access."""
    c, a = F.col, F.col("attrs")
    of_message = adjudicate.claimed_category(regs.select("msg_id", "seq_no", "category", c("rec")["category"].alias("record_category"))).withColumnRenamed("category", "claimed")
    upis = r.entities.where("kind = 'upi'").select("msg_id", c("entity_id").alias("upi_id"), c("key").alias("upi"), a["category_suffix"].alias("suffix"), (a["mobile_based"] == "true").alias("personal"), (c("legibility") == "clear").alias("upi_clear"))
    urls = r.entities.where("kind = 'url'").select("msg_id", c("entity_id").alias("url_id"), a["host"].alias("host"), a["app_store"].alias("store"))
    x = built.where("type NOT IN ('SEBI_REGISTRATION', 'IDENTITY')").drop("category").join(of_message, "msg_id", "left").join(upis, ["msg_id", "upi_id"], "left").join(urls, ["msg_id", "url_id"], "left")
    is_ = lambda name: c("type") == name
    valid = c("suffix").isNotNull()
    method = F.when(c("upi").isNotNull(), "upi").when(c("method") == "upi", "other").otherwise(c("method"))
    payment = adjudicate.payment_reason(method, valid, c("claimed"), now.cast("date"), _is(c("upi_clear")))
    reason = (
        F.when(is_("GUARANTEED_RETURNS"), adjudicate.returns_reason(c("product_context"), c("claimed"), c("origin")))
        .when(is_("REGULATOR_ENDORSEMENT"), adjudicate.endorsement_reason(c("authority"), c("object"), c("origin")))
        .when(is_("PAYMENT_DESTINATION"), payment)
        .when(is_("APP_INSTALL"), adjudicate.app_reason(c("store"), _is(c("sideload")), c("host").isNotNull()))
        .otherwise(adjudicate.access_reason(c("kind"), c("origin")))
    )
    x = checkpointed(x.withColumn("reason", reason))
    reason, due = c("reason"), adjudicate.mandated(c("claimed"))
    rules = (
        F.when(is_("GUARANTEED_RETURNS"), adjudicate.returns_rules(reason, c("claimed")))
        .when(reason == "ENDORSE_APP_OR_GROUP", _texts("CAUTION_SOCIAL_MEDIA_LURES"))
        .when(reason == "ENDORSE_SEBI_DOES_NOT_APPROVE", _texts("SEBI_DOES_NOT_APPROVE_SECURITIES", "EXCHANGES_SEBI_DO_NOT_ENDORSE"))
        .when(reason == "ENDORSE_EXCHANGES_DO_NOT_ENDORSE", _texts("EXCHANGES_SEBI_DO_NOT_ENDORSE"))
        .when(reason.isin("UPI_NOT_VALIDATED", "UPI_VALIDATED_CHECK") | ((reason == "UPI_OWNER_UNKNOWN") & due), _texts("VALIDATED_UPI_FOR_INTERMEDIARIES"))
        .when(is_("APP_INSTALL") & _is(c("sideload")) & c("store").isNull(), _texts("CAUTION_SOCIAL_MEDIA_LURES"))
        .when(is_("SPECIAL_ACCESS"), adjudicate.access_rules(c("kind"), c("origin")))
        .otherwise(_texts())
    )
    named = F.when((is_("REGULATOR_ENDORSEMENT")) & (reason == "ENDORSE_NOT_CHECKABLE"), ref("auth", c("authority"))).otherwise(c("authority"))
    values = params(
        category=F.when(reason.isin("RETURNS_BY_REGISTERED", "UPI_NOT_VALIDATED"), ref("cat", c("claimed"))),
        authority=F.when(is_("REGULATOR_ENDORSEMENT"), named),
        object=F.when(is_("REGULATOR_ENDORSEMENT"), ref("obj", c("object"))),
        upi=c("upi"),
        store=F.when(reason == "APP_STORE_CHECK_DEVELOPER", ref("store", c("store"))),
        domain=F.when(reason == "APP_SIDELOAD", c("host")),
        kind=F.when(is_("SPECIAL_ACCESS"), ref("access", c("kind"))),
    )
    results = x.select("msg_id", "claim_id", "seq_no", "reason", values.alias("params"), _none("string").alias("evidence_key"), rules.alias("rules"), F.array().cast(REASONS).alias("caveats"))

    at = lambda n: (F.lit(CLAIM) * 1000 + c("seq_no") * 10 + n).cast("long")
    item = lambda when, n, key, kind, severity, code, own, cites=None: F.when(when, F.struct(at(n).alias("seq"), key.alias("key"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(code).alias("code"), own.alias("params"), (_texts() if cites is None else cites).alias("rules")))
    yearly = identifiers.dimension({"day": "365", "week": "52", "month": "12"})[c("period")].cast("int")
    sure, access = c("origin") != "model", adjudicate.access_rules(c("kind"), c("origin"))
    foreign = is_("SPECIAL_ACCESS") & (c("kind") == "fpi_account") & sure
    suffix = identifiers.dimension(identifiers.UPI_SUFFIXES)
    promised = is_("GUARANTEED_RETURNS")
    found = F.array_compact(F.array(
        item(promised & yearly.isNotNull() & c("percent").isNotNull(), 0, F.concat_ws(":", F.lit("rate-math"), c("percent").cast("string"), "period"), "pattern", "info", "F_RETURN_RATE_MATH", params(percent=report.format_number(c("percent")), period=ref("period", c("period")), annualPercent=report.format_number(F.round(c("percent") * yearly)))),
        item(promised & sure & (reason != "RETURNS_DEPOSIT"), 1, F.lit("guaranteed-returns"), "rule", "high", "F_GUARANTEED_RETURNS", params(quote=c("quote")), _texts("ASSURED_RETURN_SCHEMES_PROHIBITED")),
        item(c("upi").isNotNull() & ~valid & _is(c("personal")), 2, F.concat(F.lit("upi-personal:"), "upi"), "payment", "medium", "F_UPI_PERSONAL", params(upi=c("upi"))),
        item(c("upi").isNotNull() & valid & _is(suffix[c("claimed")].isNotNull()) & adjudicate.suffix_differs(c("suffix"), c("claimed")), 3, F.concat(F.lit("upi-suffix:"), "upi"), "payment", "medium", "F_UPI_SUFFIX_DIFFERS", params(upi=c("upi"), suffixLabel=F.coalesce(identifiers.dimension(SUFFIX_LABELS)[c("suffix")], "suffix"), category=ref("cat", c("claimed"))), _texts("VALIDATED_UPI_FOR_INTERMEDIARIES")),
        item(reason == "PAYMENT_CRYPTO", 4, F.lit("crypto-payment"), "payment", "medium", "F_CRYPTO_PAYMENT", params(none=_none("string"))),
        item(is_("APP_INSTALL") & _is(c("sideload")) & c("store").isNull(), 5, F.lit("app-sideload"), "pattern", "high", "F_APP_SIDELOAD", params(none=_none("string")), _texts("CAUTION_SOCIAL_MEDIA_LURES")),
        item(foreign, 6, F.lit("access:fpi"), "rule", "high", "F_SPECIAL_ACCESS", params(kind=ref("access", c("kind"))), _texts("FPI_ROUTE_NOT_FOR_RESIDENTS", "CAUTION_FAKE_INSTITUTIONAL_ACCOUNTS")),
        item(is_("SPECIAL_ACCESS") & ~foreign, 7, F.concat(F.lit("access:"), "kind"), F.when(F.size(access) > 0, "rule").otherwise("pattern"), adjudicate.access_severity(c("kind")), "F_SPECIAL_ACCESS", params(kind=ref("access", c("kind"))), access),
    ))
    findings = x.select("msg_id", "claim_id", F.explode(found).alias("f")).select("msg_id", "f.*", _texts().alias("evidence_keys"), F.array("claim_id").alias("claim_ids"))
    return results, findings.select(*FINDING)


# ---- signals


def signals(r: claims.Read, built: DataFrame, found: Found, sources: Sources, before: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(findings, evidence) of behaviour, links, domains, alert entries and phones; before are the findings of claims."""
    c = F.col
    patterns = claims.behaviours(r)
    personal = before.where("code = 'F_UPI_PERSONAL'").select("msg_id")
    told = report.pattern_findings(patterns, built, personal).join(patterns.select("msg_id", F.concat(F.lit("pattern:"), "kind").alias("key"), F.regexp_extract("pattern_id", r"(\d+)$", 1).cast("long").alias("n")), ["msg_id", "key"])
    at = lambda group, n: (F.lit(SIGNAL) + group * CLAIM + n).cast("long").alias("seq")
    row = lambda df, seq, kind, values, evidence=None, rules=None: df.select("msg_id", seq, "key", F.lit(kind).alias("kind"), "severity", "code", values.alias("params"), (_texts() if evidence is None else evidence).alias("evidence_keys"), (_texts() if rules is None else rules).alias("rules"), _texts().alias("claim_ids"))
    number = F.regexp_extract("entity_id", r"(\d+)$", 1).cast("long")
    hosts = r.entities.where("kind = 'url'").groupBy("msg_id", c("attrs")["host"].alias("host")).agg(F.min(number).alias("n"))
    links = report.link_findings(r.entities).withColumn("host", F.regexp_replace("key", "^[a-z-]+:", "")).join(hosts, ["msg_id", "host"])
    ages = report.domain_findings(found.domains, now).where("code = 'F_DOMAIN_NEW'").withColumn("domain", F.regexp_replace("key", "^domain-new:", "")).join(found.domains.select("msg_id", "domain", "place", F.to_date("registered_on").alias("since")), ["msg_id", "domain"])
    day = sources.access.where(c("source") == ALERTS).select("as_of")
    hits = found.alerts.join(F.broadcast(day), F.lit(True), "left").select("msg_id", F.concat(F.lit("rbi:"), "alert").alias("key"), F.lit("high").alias("severity"), F.lit("F_RBI_ALERT").alias("code"), "alert", "query", "matched_on", "as_of")
    rank = F.row_number().over(claims.Window.partitionBy("msg_id").orderBy("alert"))
    hits = hits.withColumn("n", rank)
    phones = r.entities.where("kind = 'phone'").select("msg_id", F.concat(F.lit("foreign-number:"), c("attrs")["e164"]).alias("key"), c("attrs")["e164"].alias("phone"), F.coalesce(c("attrs")["country"], F.lit("?")).alias("country"), number.alias("n"))
    foreign = report.foreign_numbers(r.entities, built).join(phones, ["msg_id", "key"])
    findings = _union([
        row(told, at(0, c("n")), "pattern", params(quote=c("quote")), rules=c("rules")),
        row(links, at(1, c("n")), "domain", params(domain=F.when(c("code") == "F_URL_SHORTENER", c("host")), host=F.when(c("code") == "F_URL_IP_HOST", c("host")))),
        row(ages, at(2, c("place")), "domain", params(domain=c("domain"), days=c("days"), date=c("since")), F.array(F.concat(F.lit("rdap:"), "domain"))),
        row(hits, at(3, c("n")), "list_hit", params(name=c("alert"), query=c("query"), asOf=c("as_of")), F.array("key")),
        row(foreign, at(4, c("n")), "contact", params(phone=c("phone"), country=c("country"))),
    ])
    entry = first_by(sources.alerts.select(c("name").alias("alert"), F.nullif(F.array_join("websites", ", "), F.lit("")).alias("website"), "list_url"), ["alert"], ["list_url"])
    listed = hits.join(small_side(entry), "alert", "left").select("msg_id", at(3, c("n")), "key", F.lit(ALERTS).alias("source"), F.lit("list_entry").alias("kind"), F.lit("EV_RBI_ALERT").alias("title"), params(name=c("alert")).alias("params"), params(name=c("alert"), website=c("website"), matched_on=c("matched_on"), matched_text=c("query")).alias("fields"), c("list_url").alias("url"))
    known = found.domains.where("status = 'found' AND registered_on IS NOT NULL")
    dated = known.select("msg_id", at(2, c("place")), F.concat(F.lit("rdap:"), "domain").alias("key"), F.lit(AGES).alias("source"), F.lit("domain_record").alias("kind"), F.lit("EV_RDAP").alias("title"), params(domain=c("domain")).alias("params"), params(domain=c("domain"), registered_on=F.to_date("registered_on"), registrar=c("registrar")).alias("fields"), c("rdap_url").alias("url"))
    return findings, listed.unionByName(dated)


def what_is_unchecked(r: claims.Read, built: DataFrame, found: Found, unread: DataFrame, without_model: DataFrame | None = None) -> DataFrame:
    """Rows (msg_id, seq, key, code, params, cause): what could not be checked, in the order in which it is told.

    unread (msg_id, seq, kind, reason) are parts that no reader could read; without_model (msg_id) messages that no model has read.
    """
    c = F.col
    ages = report.domain_findings(found.domains, F.current_timestamp()).where("code = 'U_DOMAIN_AGE'").join(found.domains.select("msg_id", F.concat(F.lit("domain-age:"), "domain").alias("key"), "domain", "place"), ["msg_id", "key"]).select("msg_id", c("place").cast("long").alias("seq"), "key", "code", params(domain=c("domain")).alias("params"), F.lit("source_unavailable").alias("cause"))
    rest = report.unchecked(r.segments, r.entities, built, found.runs, unread)
    place = F.when(c("code") == "U_SOURCE_DOWN", 0).when(c("code") == "U_PHONE_OWNER", 1).when(c("code") == "U_GROUP_LINKS", 2).when(c("code") == "U_URL_CONTENT", 3).when(c("code") == "U_FUTURE_RETURNS", 4).otherwise(5)
    part = unread.select("msg_id", F.concat(F.lit("unread:"), c("seq").cast("string")).alias("key"), ref("part", c("kind")).alias("part"), ref("unread", c("reason")).alias("why"))
    rest = rest.join(part, ["msg_id", "key"], "left")
    rest = rest.select("msg_id", (F.lit(1000) + place).cast("long").alias("seq"), "key", "code", params(source=F.when(c("code") == "U_SOURCE_DOWN", ref("src", F.regexp_replace("key", "^source-down:", ""))), kind=F.when(c("code") == "U_UNREADABLE_PART", c("part")), why=F.when(c("code") == "U_UNREADABLE_PART", c("why"))).alias("params"), "cause")
    out = ages.unionByName(rest)
    if without_model is not None:
        out = out.unionByName(without_model.select("msg_id").distinct().select("msg_id", F.lit(2000).cast("long").alias("seq"), F.lit("model").alias("key"), F.lit("U_MODEL_UNAVAILABLE").alias("code"), params(none=_none("string")).alias("params"), F.lit("model_unavailable").alias("cause")))
    return out


# ---- all together


def investigate(segments: DataFrame, sources: Sources, now: Column, items: DataFrame | None = None, unread: DataFrame | None = None, without_model: DataFrame | None = None) -> Investigation:
    """Checks messages, whose parts are segments (see claims.read), against sources at the time now.

    Results have (msg_id, claim_id, seq_no, verdict, reason, params, evidence, rules, caveats), evidence being ids; the other
    tables are described where they are made. Messages without claims have no results.
    """
    c = F.col
    r = claims.read(segments, items)
    orgs, apps = checkpointed(claims.organizations(r)), claims.apps(r)
    built = checkpointed(claims.build(r, orgs))
    found = look_up(r, built, orgs, apps, sources)
    regs = registrations(r, built, found, sources, now)
    spark = segments.sparkSession
    (ids, contacts), (others, other_findings) = together(spark, lambda: identities(r, built, regs, found, sources), lambda: other_results(r, built, regs, now))
    columns = ["msg_id", "claim_id", "seq_no", "reason", "params", "evidence_key", "rules", "caveats"]
    results = _union([regs.select(columns), ids.select(columns), others.select(columns)])
    group = lambda n: (F.lit(n * CLAIM * 1000) + c("seq_no") * 10).cast("long").alias("seq")

    # Findings of registrations and identities.
    own = lambda df, seq, key, kind, severity, code, values, evidence, rules: df.select("msg_id", seq, key.alias("key"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), values.alias("params"), evidence.alias("evidence_keys"), rules.alias("rules"), F.array("claim_id").alias("claim_ids"))
    bare = own(regs.where("reason = 'REG_NO_DETAILS'"), group(0), F.lit("no-reg-details"), "registration", "medium", "F_NO_REG_DETAILS", params(none=_none("string")), _texts(), _texts("REGISTRATION_DETAILS_IN_COMMUNICATIONS"))
    differ = own(regs.where("differs"), group(0), F.concat(F.lit("category-differs:"), "number"), "registration", "medium", "F_CATEGORY_DIFFERS", c("of_categories"), F.array("evidence_key"), _texts())
    held = ids.select("msg_id", "claim_id", "seq_no", F.explode(F.when(c("rec").isNotNull(), F.array("rec")).when(c("reason") == "ID_AMBIGUOUS", c("same"))).alias("rec")).withColumn("record_id", c("rec.record_id"))
    like = held.join(contacts.where("status = 'lookalike'"), ["msg_id", "record_id"])
    like = own(like, group(1), F.concat(F.lit("lookalike:"), "in_message"), "domain", "high", "F_DOMAIN_LOOKALIKE", params(domain=c("in_message"), officialDomain=c("official_domain"), officialName=verify.display_name(c("rec"))), F.array(F.concat(F.lit("sebi:"), c("rec")["registration_no"])), _texts())
    of_claims = checkpointed(_union([bare, differ, like, other_findings]))
    of_signals, signal_evidence = signals(r, built, found, sources, of_claims, now)
    findings = checkpointed(report.keyed(of_claims.unionByName(of_signals), "finding"))

    # Evidence: records, absences, entries and rules, each once for a message.
    record = lambda df, seq: df.select("msg_id", seq, F.explode(F.array("rec")).alias("rec")).where("rec IS NOT NULL").select("msg_id", "seq", "rec.*")
    cited = _union([record(regs.where("rec IS NOT NULL"), group(0)), record(ids.where("evidence_key LIKE 'sebi:%'"), group(1)), record(held.join(contacts.where("status = 'lookalike'").select("msg_id", "record_id").distinct(), ["msg_id", "record_id"]), group(1))])
    records = cited.select("msg_id", "seq", F.concat(F.lit("sebi:"), "registration_no").alias("key"), F.lit(REGISTER).alias("source"), F.lit("registry_record").alias("kind"), F.lit("EV_SEBI_RECORD").alias("title"), params(regNo=c("registration_no"), category=ref("cat", c("category"))).alias("params"), report.record_fields().alias("fields"), c("source_url").alias("url"))
    absent = _union([regs.select("msg_id", group(0), "evidence_key", "fields"), ids.select("msg_id", group(1), "evidence_key", "fields")]).where("evidence_key LIKE 'sebi-absent:%'").select("msg_id", "seq", c("evidence_key").alias("key"), F.lit(REGISTER).alias("source"), F.lit("registry_absence").alias("kind"), F.lit("EV_SEBI_ABSENT").alias("title"), params(query=F.regexp_replace("evidence_key", "^sebi-absent:", "")).alias("params"), "fields", F.lit(SEARCHED_AT).alias("url"))
    gone = regs.where("evidence_key LIKE 'sebi-inactive:%'").select("msg_id", group(0), c("evidence_key").alias("key"), F.lit(REGISTER).alias("source"), F.lit("registry_record").alias("kind"), F.lit("EV_SEBI_INACTIVE").alias("title"), params(regNo=c("number"), status=ref("regstatus", c("inactive_status"))).alias("params"), "fields", c("inactive_url").alias("url"))
    ruled = _union([results.select("msg_id", (F.when(c("reason").startswith("REG_"), 0).otherwise(CLAIM * 1000) + c("seq_no") * 10 + 1).cast("long").alias("seq"), "rules"), findings.select("msg_id", (c("seq") + 1).alias("seq"), "rules")])
    rules = report.rule_evidence(ruled).select("msg_id", "seq", "key", F.lit(RULES).alias("source"), "kind", "title", params(none=_none("string")).alias("params"), "fields", "url")
    evidence = report.keyed(_union([x.select(*EVIDENCE) for x in (records, absent, gone, signal_evidence, rules)]), "ev")
    evidence = checkpointed(evidence.join(F.broadcast(sources.access.select("source", "as_of", "retrieved_at", "fixture")), "source", "left"))  # a row for each source

    with_ids = lambda df, keys, by: _ids(df, keys, evidence, by)
    keys = F.concat(F.when(c("evidence_key").isNotNull(), F.array("evidence_key")).otherwise(_texts()), F.transform("rules", lambda x: F.concat(F.lit("rule:"), x)))
    told = with_ids(results.withColumn("verdict", adjudicate.verdict_of(c("reason"))), keys, "claim_id").select("msg_id", "claim_id", "seq_no", "verdict", "reason", "params", "evidence", "rules", "caveats")
    keys = F.concat("evidence_keys", F.transform("rules", lambda x: F.concat(F.lit("rule:"), x)))
    findings = report.ordered_findings(with_ids(findings, keys, "id")).drop("evidence_keys")
    unread = spark.createDataFrame([], "msg_id long, seq int, kind string, reason string") if unread is None else unread
    left = report.keyed(what_is_unchecked(r, built, found, unread, without_model), "unchecked")
    messages = segments.select("msg_id").distinct()
    told, findings, left, bound = together(spark, lambda: checkpointed(told), lambda: checkpointed(findings), lambda: checkpointed(left), lambda: checkpointed(bindings(built, regs, ids, contacts, evidence)))
    return Investigation(messages, built, told, findings, left, bound, evidence, found.runs, r.entities, orgs, r.discarded)


def _ids(rows: DataFrame, keys: Column, evidence: DataFrame, by: str) -> DataFrame:
    """rows with `evidence`: the ids of what their keys stand for, in order."""
    each = rows.select("msg_id", by, F.posexplode(keys).alias("k", "key")).join(evidence.select("msg_id", "key", F.col("id").alias("ev")), ["msg_id", "key"])
    own = each.groupBy("msg_id", by).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("k", "ev"))), lambda x: x["ev"])).alias("evidence"))
    return rows.join(own, ["msg_id", by], "left").withColumn("evidence", F.coalesce("evidence", _texts()))


def bindings(built: DataFrame, regs: DataFrame, ids: DataFrame, contacts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows (msg_id, id, claim_ids, claimed_name, record_evidence_id, official_name, registration_no, rows): how what a message
    gives compares with a record, each record and name once; rows are structs (field, in_message, in_record, status)."""
    c = F.col
    line = lambda field, mine, theirs, status: F.struct(F.lit(field).alias("field"), mine.cast("string").alias("in_message"), theirs.cast("string").alias("in_record"), status.alias("status"))
    official = verify.display_name(c("rec"))
    named = F.when(c("holder_name").isNull(), "not_given").when(~F.coalesce(c("there"), F.lit(True)) | (c("comparison") == "same"), "same").otherwise("different")
    given = F.when(c("there"), c("rec")["registration_no"])
    by_number = regs.where("rec IS NOT NULL").withColumn("there", c("number").isNotNull()).select("msg_id", "claim_id", (c("seq_no") * 10).cast("long").alias("seq"), c("holder_name").alias("claimed_name"), "rec", F.array(line("name", c("holder_name"), official, named), line("registration", given, c("rec")["registration_no"], F.when(c("there"), "same").otherwise("not_given"))).alias("head"))
    by_name = ids.where("rec IS NOT NULL AND evidence_key IS NOT NULL").select("msg_id", "claim_id", (F.lit(CLAIM) * 1000 + c("seq_no") * 10).cast("long").alias("seq"), c("org_name").alias("claimed_name"), "rec", F.array(line("name", c("org_name"), official, F.lit("same"))).alias("head"))
    rank = F.when(c("field") == "phone", 0).when(c("field") == "email", 1).otherwise(2)
    compared = contacts.groupBy("msg_id", "record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "in_message", "field", "in_record", "status"))), lambda x: F.struct(x["field"].alias("field"), x["in_message"].alias("in_message"), x["in_record"].alias("in_record"), x["status"].alias("status"))).alias("tail"))
    every = by_number.unionByName(by_name).withColumn("record_id", c("rec.record_id")).join(compared, ["msg_id", "record_id"], "left")
    every = every.withColumn("key", F.concat(F.lit("sebi:"), c("rec.registration_no"))).join(evidence.select("msg_id", "key", c("id").alias("record_evidence_id")), ["msg_id", "key"])
    rows = every.select("msg_id", "claim_id", "seq", "claimed_name", "record_evidence_id", official.alias("official_name"), c("rec.registration_no").alias("registration_no"), F.concat("head", F.coalesce("tail", F.array().cast(every.schema["tail"].dataType))).alias("rows"))
    merged = report.merge_bindings(rows)
    n = F.row_number().over(claims.Window.partitionBy("msg_id").orderBy("seq"))
    return merged.withColumn("id", F.concat(F.lit("binding-"), n.cast("string")))

"""Verification: what to look up for which claims, in registers, alert lists and domain records, and how contacts compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsieve.functions import domains, identifiers, text
from proofsieve.operators.claims import first_by
from proofsieve.session import small_side

# Domains whose age says nothing about a sender; how regulators and exchanges are called.
PLATFORMS = "google.com youtube.com youtu.be facebook.com fb.com instagram.com whatsapp.com wa.me t.me telegram.me telegram.org x.com twitter.com linkedin.com apple.com microsoft.com gov.in nic.in sebi.gov.in rbi.org.in nseindia.com bseindia.com amazon.in amazon.com github.com".split()
SEBI_NAME = r"(?iu)(?<![A-Za-z0-9])(sebi|securities\s+and\s+exchange\s+board)(?![A-Za-z0-9])|सेबी"
REGULATOR_NAME = r"(?iu)(?<![A-Za-z0-9])(sebi|securities\s+and\s+exchange\s+board|rbi|reserve\s+bank|nse|national\s+stock\s+exchange|bse|bombay\s+stock\s+exchange|amfi|irdai?|pfrda|nsdl|cdsl)(?![A-Za-z0-9])|सेबी|आरबीआई|रिज़र्व\s*बैंक"
NOTHING = "CAST(NULL AS STRING)"
RANKS = {"same": 3, "similar": 2, "different": 1, "inconclusive": 0}


def is_sebi_name(name: Column) -> Column:
    return F.coalesce(name.rlike(SEBI_NAME), F.lit(False))


def is_regulator_name(name: Column) -> Column:
    return F.coalesce(name.rlike(REGULATOR_NAME), F.lit(False))


def covered_categories(latest: DataFrame, live: bool, every: tuple[str, ...]) -> DataFrame:
    """Rows (category): those of the latest snapshots (scope), and all of them where a live register answers."""
    own = latest.select(F.col("scope").alias("category")).distinct()
    return own.unionByName(latest.sparkSession.createDataFrame([(c,) for c in every], "category string")).distinct() if live else own


def number_plan(claims: DataFrame, entities: DataFrame, covered: DataFrame) -> DataFrame:
    """Rows (number): valid numbers of registration claims whose category is covered, each once for all messages."""
    regs = entities.where("kind = 'reg' AND attrs['format_valid'] = 'true'").select("msg_id", F.col("entity_id").alias("reg_id"), F.col("key").alias("number"), identifiers.dimension(identifiers.CATEGORY)[F.col("attrs")["scheme"]].alias("category"))
    asked = claims.where("type = 'SEBI_REGISTRATION' AND reg_id IS NOT NULL").select("msg_id", "reg_id").join(regs, ["msg_id", "reg_id"])
    return asked.join(F.broadcast(covered), "category").select("number").distinct()  # a row for each category


def lookups(numbers: DataFrame, registry: DataFrame, inactive: DataFrame, live: DataFrame | None = None, covered: bool = True) -> DataFrame:
    """Rows (number, status, inactive_status): found, inactive, not_found or unavailable.

    The register counts first, then answers of a live one (number, status found | not_found | failed), then the list of
    inactive registrations; unavailable is a number that only a live register could know and that failed to tell.
    """
    known = registry.select(F.col("registration_no").alias("number")).distinct().withColumn("known", F.lit(True))
    gone = first_by(inactive.select(F.col("registration_no").alias("number"), F.col("status").alias("inactive_status")), ["number"], ["inactive_status"])
    rows = numbers.join(small_side(known), "number", "left").join(small_side(gone), "number", "left")
    rows = rows.join(live.select("number", F.col("status").alias("answer")), "number", "left") if live is not None else rows.withColumn("answer", F.expr(NOTHING))
    failed = (F.col("answer") == "failed") & F.lit(not covered)
    status = F.when(F.col("known") | (F.col("answer") == "found"), "found").when(F.col("inactive_status").isNotNull(), "inactive").when(F.coalesce(failed, F.lit(False)), "unavailable").otherwise("not_found")
    return rows.select("number", status.alias("status"), F.when(status == "inactive", F.col("inactive_status")).alias("inactive_status"))


def name_plan(claims: DataFrame, entities: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (name): holders of claims, unless their number couldn't be looked up, and senders that are no regulators."""
    regs = entities.where("kind = 'reg'").select("msg_id", F.col("entity_id").alias("reg_id"), F.col("key").alias("number"))
    holders = claims.where("type = 'SEBI_REGISTRATION' AND holder_name IS NOT NULL").join(regs, ["msg_id", "reg_id"], "left").join(found.select("number", "status"), "number", "left")
    holders = holders.where("status IS NULL OR status <> 'unavailable'").select(F.col("holder_name").alias("name"))
    senders = claims.where(F.col("type") == "IDENTITY").where(~is_regulator_name(F.col("org_name"))).select(F.col("org_name").alias("name"))
    return holders.unionByName(senders).distinct()


def alert_plan(organizations: DataFrame, apps: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, domains) to match with alert lists: rows (msg_id, name) of firms and apps, rows (msg_id, domain) of links
    and of mailboxes that aren't free."""
    names = organizations.where("role NOT IN ('regulator', 'exchange')").select("msg_id", "name").unionByName(apps.select("msg_id", "name"))
    links = entities.where("kind = 'url'").select("msg_id", F.col("attrs")["domain"].alias("domain"))
    mails = entities.where("kind = 'email' AND attrs['free_mail'] = 'false'").select("msg_id", F.col("attrs")["domain"].alias("domain"))
    return names.distinct(), links.unionByName(mails).where("domain IS NOT NULL").distinct()


def match_alert_domains(asked: DataFrame, alerts: DataFrame) -> DataFrame:
    """Rows (msg_id, domain, alert) of domains (msg_id, domain) that entries of an alert list (name, domains) have."""
    own = alerts.select(F.col("name").alias("alert"), F.explode("domains").alias("domain")).distinct()
    return asked.select("msg_id", F.lower("domain").alias("domain")).join(small_side(own), "domain").select("msg_id", "domain", "alert").distinct()


def domain_plan(entities: DataFrame, most: int = 5) -> DataFrame:
    """Rows (msg_id, domain, place): the first `most` domains of each message whose age may tell something: those of links
    first, without shorteners, stores, invitations and large platforms, then those of mailboxes that aren't free."""
    a = F.col("attrs")
    n = F.regexp_extract("entity_id", r"(\d+)$", 1).cast("int")
    links = entities.where(F.col("kind") == "url").where((a["shortener"] == "false") & a["app_store"].isNull() & a["invite"].isNull()).select("msg_id", F.lit(0).alias("group"), n.alias("n"), a["domain"].alias("domain"))
    mails = entities.where((F.col("kind") == "email") & (a["free_mail"] == "false")).select("msg_id", F.lit(1).alias("group"), n.alias("n"), a["domain"].alias("domain"))
    each = first_by(links.unionByName(mails).where(F.col("domain").isNotNull() & ~F.col("domain").isin(PLATFORMS)), ["msg_id", "domain"], ["group", "n"])
    place = F.row_number().over(Window.partitionBy("msg_id").orderBy("group", "n"))
    return each.select("msg_id", "domain", place.alias("place")).where(F.col("place") <= most)


def domain_lookups(plan: DataFrame, records: DataFrame) -> DataFrame:
    """plan (msg_id, domain) with status, registered_on and registrar of records (domain, status, registered_on,
    registrar); unavailable where there is no record. Each domain is looked up once, however many messages have it."""
    asked = plan.select("domain").distinct().join(records, "domain", "left").select("domain", F.coalesce("status", F.lit("unavailable")).alias("status"), "registered_on", "registrar")
    return plan.join(small_side(asked), "domain")


def name_variants(record: Column) -> Column:
    """All names that a record (names, trade_names, contact_person) may be called, each once, in their order."""
    form = r"(?i)^(.*?)\s*\((?:proprietor|prop\.?|trade\s*name)\s*[:-]?\s*(.+?)\)\s*$"
    empty = F.array().cast("array<string>")
    every = F.filter(F.concat(F.coalesce(record["names"], empty), F.coalesce(record["trade_names"], empty)), lambda n: F.trim(n) != "")
    parts = F.flatten(F.transform(every, lambda n: F.array(n, F.regexp_extract(n, form, 1), F.regexp_extract(n, form, 2))))
    contact = F.regexp_replace(F.coalesce(record["contact_person"], F.lit("")), r"(?i)^(mr|mrs|ms|dr|shri|smt)\.?\s+", "")
    return F.array_distinct(F.filter(F.concat(parts, F.array(contact)), lambda n: F.trim(n) != ""))


def display_name(record: Column) -> Column:
    """The legal name, with the first trade name that differs."""
    legal = F.coalesce(F.get(record["names"], F.lit(0)), record["registration_no"])
    trade = F.get(F.filter(record["trade_names"], lambda t: (t != "") & (F.lower(t) != F.lower(legal))), F.lit(0))
    return F.when(trade.isNotNull(), F.concat(legal, F.lit(" (trade name: "), trade, F.lit(")"))).otherwise(legal)


def title_case(c: Column) -> Column:
    """Capital letters at the beginning of words, which punctuation ends too."""
    pieces = F.regexp_extract_all(F.lower(c), F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def city_of(record: Column) -> Column:
    """The city, or the part of the address that is usually one."""
    parts = F.filter(F.transform(F.split(F.coalesce(record["address"], F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    guess = F.when(F.size(parts) >= 3, F.try_element_at(parts, F.lit(-3))).otherwise(F.try_element_at(parts, F.lit(-1)))
    return F.coalesce(title_case(F.coalesce(F.nullif(record["city"], F.lit("")), guess)), F.lit(""))


def phone_key(raw: Column) -> Column:
    digits = F.regexp_replace(raw, r"\D", "")
    return F.when(F.length(digits) >= 8, F.right(digits, F.lit(10)))


def name_comparisons(claimed: DataFrame, records: DataFrame) -> DataFrame:
    """Rows (id, result, matched): how names of claimed (id, number, name) compare with records (registration_no, names,
    trade_names, contact_person) of their number: the best over all variants, of equally good ones the first. Names that
    several claim of a number are compared once."""
    rec = F.struct(*(F.col(c) for c in ("names", "trade_names", "contact_person")))
    known = records.select(F.col("registration_no").alias("number"), F.posexplode(name_variants(rec)).alias("k", "official"))
    asked = claimed.select("number", "name").distinct()
    tried = asked.join(known, "number", "left")
    tried = tried.withColumns({"mine": text.name_tokens(F.coalesce("name", F.lit(""))), "theirs": text.name_tokens(F.coalesce("official", F.lit("")))})
    same = text.compare_tokens(F.col("mine"), F.col("theirs"))
    rank = F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair))
    rated = tried.select("number", "name", "k", "official", same.alias("result")).withColumn("rank", rank[F.col("result")])
    best = lambda rows, *keys: rows.groupBy(*keys).agg(F.max_by(F.struct("result", "official", "rank", "k"), F.struct("rank", -F.coalesce("k", F.lit(0)))).alias("b"))
    each = best(rated, F.col("number").alias("of_number"), F.col("name").alias("of_name")).select("of_number", "of_name", "b.*")
    told = best(claimed.join(each, F.col("number").eqNullSafe(F.col("of_number")) & F.col("name").eqNullSafe(F.col("of_name"))), "id")
    return told.select("id", F.col("b.result"), F.when(F.col("b.result") != "inconclusive", F.col("b.official")).alias("matched"))


def rank_by_name(candidates: DataFrame) -> DataFrame:
    """candidates (query, place, names, trade_names, contact_person, ...) that are the same or similar, the same first,
    with `result` and `rank`."""
    rec = F.struct(*(F.col(c) for c in ("names", "trade_names", "contact_person")))
    ids = candidates.select("query", "place", F.col("query").alias("name"), F.posexplode(name_variants(rec)).alias("k", "official"))
    ids = ids.withColumns({"mine": text.name_tokens(F.col("name")), "theirs": text.name_tokens(F.col("official"))})
    ids = ids.select("query", "place", text.compare_tokens(F.col("mine"), F.col("theirs")).alias("result"))
    rank = F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair))
    best = ids.select("query", "place", rank[F.col("result")].alias("rank")).groupBy("query", "place").agg(F.max("rank").alias("rank")).where("rank >= 2")
    n = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rank"), "place"))
    result = F.when(F.col("rank") == RANKS["same"], "same").otherwise("similar")
    return candidates.join(best, ["query", "place"]).withColumns({"result": result, "rank": n})


def compared(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Rows (name, record_id, result): how names of pairs (name, record_id) compare with records (record_id, names,
    trade_names, contact_person), each pair once however many messages have it."""
    asked = pairs.select("name", "record_id").where("name IS NOT NULL").distinct().select(F.struct("name", "record_id").alias("id"), F.col("record_id").alias("number"), "name")
    known = records.join(asked.select(F.col("number").alias("record_id")).distinct(), "record_id", "left_semi").withColumn("registration_no", F.col("record_id"))
    return name_comparisons(asked, known).select("id.name", "id.record_id", "result")


def search_text(record: Column) -> Column:
    """What names are searched in: all names, trade names and the contact person, folded."""
    empty = F.array().cast("array<string>")
    return text.fold_for_match(F.concat_ws(" | ", F.concat(F.coalesce(record["names"], empty), F.coalesce(record["trade_names"], empty), F.array_compact(F.array(record["contact_person"])))))


def merge_live(rows: DataFrame) -> DataFrame:
    """Answers of a live register, one for each (category, registration_no): lists are united in the order of ord, all
    else is the first row's."""
    lists = ("names", "trade_names", "emails", "phones", "exchanges")
    united = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c]))).alias(c)
    other = [c for c in rows.columns if c not in (*lists, "ord", "category", "registration_no")]
    return rows.groupBy("category", "registration_no").agg(*(united(c) for c in lists if c in rows.columns), *(F.min_by(c, "ord").alias(c) for c in other))


def official_domains(records: DataFrame) -> DataFrame:
    """Rows (record_id, ord, domain): registrable domains of the mailboxes of records (record_id, emails) that aren't free."""
    each = records.select("record_id", F.posexplode("emails").alias("k", "email")).select("record_id", "k", F.lower(F.trim(F.split_part("email", F.lit("@"), F.lit(2)))).alias("host"))
    own = each.where((F.col("host") != "") & ~F.col("host").isin(identifiers.FREE_MAIL)).select("record_id", "k", domains.registrable_domain(F.col("host")).alias("domain")).where("domain IS NOT NULL")
    return own.groupBy("record_id", "domain").agg(F.min("k").alias("ord"))


def compare_contacts(pairs: DataFrame, entities: DataFrame, records: DataFrame) -> DataFrame:
    """Rows (msg_id, record_id, field, in_message, status, official_domain): each contact of a message against a record.

    pairs (msg_id, record_id) say which are compared; records have (record_id, phones, emails). Phones agree in their
    last ten digits, mailboxes in address or, if not free, domain, links in domain; names that imitate an official
    domain are look-alikes. Phones that only the record has are not_given.
    """
    keys = records.select("record_id", F.explode("phones").alias("p")).select("record_id", phone_key(F.col("p")).alias("key")).where("key IS NOT NULL").distinct()
    has = records.select("record_id", F.size(F.filter(F.transform("phones", phone_key), lambda k: k.isNotNull())).alias("n_phones"), F.size("phones").alias("n_listed"), F.size("emails").alias("n_emails"))
    asked = pairs.select("msg_id", "record_id").distinct().join(has, "record_id")
    a = F.col("attrs")
    phones = asked.join(entities.where("kind = 'phone'").select("msg_id", a["e164"].alias("in_message")), "msg_id").withColumn("key", phone_key(F.col("in_message")))
    phones = phones.join(keys.withColumn("same", F.lit(True)), ["record_id", "key"], "left")
    status = F.when(F.col("same"), "same").when(F.col("n_phones") > 0, "not_in_record").otherwise("record_has_none")
    out = phones.select("msg_id", "record_id", F.lit("phone").alias("field"), "in_message", status.alias("status"), F.expr(NOTHING).alias("official_domain"))
    given = entities.where("kind = 'phone'").select("msg_id").distinct()
    silent = asked.where("n_listed > 0").join(given, "msg_id", "left_anti").select("msg_id", "record_id", F.lit("phone").alias("field"), F.expr(NOTHING).alias("in_message"), F.lit("not_given").alias("status"), F.expr(NOTHING).alias("official_domain"))
    official = official_domains(records)
    per_record = official.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("ord", "domain"))).alias("official"))
    asked = asked.join(per_record, "record_id", "left")
    none = F.array().cast("array<struct<ord int, domain string>>")
    mails = entities.where("kind = 'email'").select("msg_id", F.lit("email").alias("field"), a["address"].alias("in_message"), a["domain"].alias("host"), (a["free_mail"] == "true").alias("free"))
    sites = entities.where(F.col("kind") == "url").where(a["domain"].isNotNull() & a["invite"].isNull() & a["app_store"].isNull() & (a["shortener"] == "false") & (a["ip_host"] == "false")).select("msg_id", F.lit("website").alias("field"), a["host"].alias("in_message"), a["host"].alias("host"), F.lit(False).alias("free"))
    each = mails.unionByName(sites)
    each = each.withColumn("domain", F.coalesce(domains.registrable_domain(F.col("host")), F.col("host")))
    listed = records.select("record_id", F.explode("emails").alias("e")).select("record_id", F.lower("e").alias("in_message")).distinct().withColumn("listed", F.lit(True))
    web = asked.join(each, "msg_id").join(listed, ["record_id", "in_message"], "left").withColumn("official", F.coalesce("official", none))
    # Official domains of a record are few; each is compared as a row, so that its label is read once.
    pairs_ = web.select("msg_id", "record_id", "field", "in_message", "domain", "free", "listed", "n_emails", F.size("official").alias("n_official"), F.posexplode_outer("official").alias("k", "o")).withColumn("o", F.col("o.domain"))
    labels = pairs_.select("*", domains.domain_parts(F.col("domain"))["label"].alias("own_label"), domains.domain_parts(F.col("o"))["label"].alias("o_label"))
    imitates = F.coalesce((F.col("domain") != F.col("o")) & text.imitates(F.col("own_label"), F.col("o_label")), F.lit(False))
    folded = labels.groupBy("msg_id", "record_id", "field", "in_message", "domain", "free", "listed", "n_emails", "n_official").agg(F.bool_or(F.coalesce(F.col("domain") == F.col("o"), F.lit(False))).alias("same"), F.min_by("o", F.when(imitates, F.col("k"))).alias("like"))
    same = F.when(F.col("field") == "email", F.coalesce("listed", F.lit(False)) | (~F.col("free") & F.col("same"))).otherwise(F.col("same"))
    known = F.when(F.col("field") == "email", F.col("n_emails")).otherwise(F.col("n_official"))
    status = F.when(same, "same").when(F.col("like").isNotNull(), "lookalike").when(known > 0, "not_in_record").otherwise("record_has_none")
    return out.unionByName(silent).unionByName(folded.select("msg_id", "record_id", "field", "in_message", status.alias("status"), F.col("like").alias("official_domain")))

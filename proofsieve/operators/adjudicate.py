"""Verdicts: decision tables over joined rows, and what reports make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsieve.functions import identifiers

VERDICTS = ("CONTRADICTED", "MATCHES", "NOT_FOUND", "CANT_CHECK")


def verdict_of(reason: Column) -> Column:
    """The verdict that a reason stands for."""
    # Reasons by verdict.
    contradicted = ("REG_EXPIRED", "REG_INACTIVE", "REG_BELONGS_TO_OTHER", "UPI_NOT_VALIDATED", "RETURNS_BY_REGISTERED", "ENDORSE_SEBI_DOES_NOT_APPROVE", "ENDORSE_EXCHANGES_DO_NOT_ENDORSE", "ID_SEBI_EMAIL_MISMATCH", "ACCESS_FPI_NOT_FOR_RESIDENTS")
    matches = ("REG_MATCH", "REG_MATCH_PERPETUAL", "REG_NAME_FOUND", "ID_CONTACTS_MATCH")
    missing = ("REG_FORMAT_INVALID", "REG_NOT_IN_REGISTER", "REG_NAME_NOT_FOUND", "ID_NOT_IN_REGISTER")
    return F.when(reason.isin(*contradicted), "CONTRADICTED").when(reason.isin(*matches), "MATCHES").when(reason.isin(*missing), "NOT_FOUND").otherwise("CANT_CHECK")


def registration_reason(covered: Column, format_valid: Column, clear: Column, available: Column, found: Column, inactive: Column, active: Column, binding: Column, comparison: Column, perpetual: Column, claim_clear: Column | None = None) -> Column:
    """The reason for a registration claim with a number; the first condition that holds decides. clear is the number,
    claim_clear the claim, as it was read."""
    read = clear if claim_clear is None else clear & claim_clear
    different = F.when((binding == "explicit") & read, "REG_BELONGS_TO_OTHER").when(binding == "explicit", "REG_NAME_MISMATCH_UNCERTAIN").otherwise("REG_NAME_MISMATCH_INFERRED")
    return (
        F.when(~covered, "REG_SCHEME_NOT_COVERED")
        .when(~format_valid & ~clear, "REG_UNCLEAR_NUMBER")
        .when(~format_valid, "REG_FORMAT_INVALID")
        .when(~available, "REG_SOURCE_UNAVAILABLE")
        .when(~found & inactive & clear, "REG_INACTIVE")
        .when(~found & ~clear, "REG_UNCLEAR_NUMBER")
        .when(~found, "REG_NOT_IN_REGISTER")
        .when(~active, "REG_EXPIRED")
        .when((binding == "none") | (comparison == "inconclusive"), "REG_REAL_SENDER_UNKNOWN")
        .when((comparison == "same") & perpetual, "REG_MATCH_PERPETUAL")
        .when(comparison == "same", "REG_MATCH")
        .when(comparison == "similar", "REG_NAME_SIMILAR")
        .otherwise(different)
    )


def bare_registration_reason(holder_given: Column, searched: Column, same: Column, active: Column) -> Column:
    """The reason for a registration claim without a number, of which `same` records have the holder's name."""
    return (
        F.when(holder_given & ~searched, "REG_SOURCE_UNAVAILABLE_NAME")
        .when(holder_given & (same == 1) & active, "REG_NAME_FOUND")
        .when(holder_given & (same == 1), "REG_EXPIRED")
        .when(holder_given & (same > 1), "REG_NAME_AMBIGUOUS")
        .when(holder_given, "REG_NAME_NOT_FOUND")
        .otherwise("REG_NO_DETAILS")
    )


def identity_reason(is_sebi: Column, foreign_email: Column, is_regulator: Column, record: Column, ambiguous: Column, intermediary: Column, searched: Column, contacts: Column, same: Column, odd: Column) -> Column:
    """The reason for an identity claim; contacts, same and odd count what the message gives and how it compares."""
    return (
        F.when(is_sebi & foreign_email, "ID_SEBI_EMAIL_MISMATCH")
        .when(is_sebi | is_regulator, "ID_REGULATOR_UNVERIFIED")
        .when(~record & ambiguous, "ID_AMBIGUOUS")
        .when(~record & ~intermediary, "ID_NOT_CHECKABLE")
        .when(~record & ~searched, "ID_SOURCE_UNAVAILABLE")
        .when(~record, "ID_NOT_IN_REGISTER")
        .when(contacts == 0, "ID_NO_CONTACTS")
        .when((same > 0) & (odd == 0), "ID_CONTACTS_MATCH")
        .otherwise("ID_CONTACTS_NOT_ON_RECORD")
    )


def payment_reason(method: Column, validated: Column, category: Column, day: Column, clear: Column) -> Column:
    """The reason for a payment claim; validated handles are due from a fixed day on for some categories, and for a
    registration of unknown category."""
    # The categories and the day.
    due = mandated(category) & (day >= F.lit("2025-12-08").cast("date")) & clear
    other = F.when(method == "bank", "BANK_OWNER_UNKNOWN").when(method == "qr", "PAYMENT_QR").when(method == "crypto", "PAYMENT_CRYPTO").otherwise("PAYMENT_OTHER")
    return F.when(method != "upi", other).when(validated, "UPI_VALIDATED_CHECK").when(F.coalesce(due, F.lit(False)), "UPI_NOT_VALIDATED").otherwise("UPI_OWNER_UNKNOWN")


def mandated(category: Column) -> Column:
    return F.coalesce(category.isin(*identifiers.UPI_SUFFIXES, "UNKNOWN"), F.lit(False))


def suffix_differs(suffix: Column, category: Column) -> Column:
    """Whether a validated handle's suffix is another than the claimed category's."""
    return F.coalesce(suffix != identifiers.dimension(identifiers.UPI_SUFFIXES)[category], F.lit(False))


def returns_reason(context: Column, category: Column, origin: Column) -> Column:
    return F.when(context == "deposit", "RETURNS_DEPOSIT").when(category.isNotNull() & (origin != "model"), "RETURNS_BY_REGISTERED").otherwise("RETURNS_UNVERIFIABLE")


def returns_rules(reason: Column, category: Column) -> Column:
    """Rules that a result on promised returns cites."""
    rules = lambda *names: F.array(*map(F.lit, names))
    own = F.when(category == "BROKER", rules("BROKER_NO_GUARANTEED_RETURN_SCHEMES")).when(category.isin("RA", "IA"), rules("RA_IA_NO_ASSURED_RETURNS")).otherwise(rules("RA_IA_NO_ASSURED_RETURNS", "BROKER_NO_GUARANTEED_RETURN_SCHEMES"))
    return F.when(reason == "RETURNS_BY_REGISTERED", own).when(reason == "RETURNS_UNVERIFIABLE", rules("ASSURED_RETURN_SCHEMES_PROHIBITED")).otherwise(F.array().cast("array<string>"))


def endorsement_reason(authority: Column, object_: Column, origin: Column) -> Column:
    return F.when(object_.isin("app", "group"), "ENDORSE_APP_OR_GROUP").when(origin == "model", "ENDORSE_NOT_CHECKABLE").when(authority == "SEBI", "ENDORSE_SEBI_DOES_NOT_APPROVE").when(authority.isin("NSE", "BSE"), "ENDORSE_EXCHANGES_DO_NOT_ENDORSE").otherwise("ENDORSE_NOT_CHECKABLE")


def app_reason(store: Column, sideload: Column, linked: Column) -> Column:
    """The reason for an app to install: from a store, from elsewhere, or without a link."""
    return F.when(store.isNotNull(), "APP_STORE_CHECK_DEVELOPER").when(sideload & linked, "APP_SIDELOAD").otherwise("APP_NO_LINK")


def access_rules(kind: Column, origin: Column) -> Column:
    """Rules that an offer of special access comes under."""
    rules = lambda *names: F.array(*map(F.lit, names)).cast("array<string>")
    return F.when((kind == "fpi_account") & (origin != "model"), rules("FPI_ROUTE_NOT_FOR_RESIDENTS")).when(kind == "vip_group", rules("CAUTION_VIP_GROUPS")).when(kind == "otc", rules()).when(kind.isin("institutional_account", "fpi_account"), rules("CAUTION_FAKE_INSTITUTIONAL_ACCOUNTS", "CAUTION_SOCIAL_MEDIA_LURES")).otherwise(rules("CAUTION_SOCIAL_MEDIA_LURES"))


def access_reason(kind: Column, origin: Column) -> Column:
    return F.when((kind == "fpi_account") & (origin != "model"), "ACCESS_FPI_NOT_FOR_RESIDENTS").when(F.size(access_rules(kind, origin)) > 0, "ACCESS_CAUTIONED").otherwise("ACCESS_UNVERIFIABLE")


def access_severity(kind: Column) -> Column:
    return F.when(kind.isin("vip_group", "otc"), "medium").otherwise("high")


def claimed_category(claims: DataFrame) -> DataFrame:
    """Rows (msg_id, category) of registration claims (msg_id, seq_no, category, record_category): the first that a claim
    names, or else that its record has; UNKNOWN if none does."""
    own = F.coalesce(F.when(F.col("category") != "OTHER", F.col("category")), "record_category")
    return claims.groupBy("msg_id").agg(F.coalesce(F.min_by(own, F.when(own.isNotNull(), F.col("seq_no"))), F.lit("UNKNOWN")).alias("category"))


def registers_param(searched: Column, every: int = 12) -> Column:
    """How a report names the registers that were searched: all of them, a list of references, or nothing."""
    own = F.array_distinct(searched)
    return F.when(F.size(own) == every, "@word.all_registers").when(F.size(own) > 0, F.concat(F.lit("@@"), F.array_join(F.transform(own, lambda c: F.concat(F.lit("cat."), c)), ",")))


def age_in_days(since: Column, now: Column) -> Column:
    """Whole days of elapsed time, which are not calendar days."""
    return F.floor((F.unix_micros(now) - F.unix_micros(since)) / 86_400_000_000)


def verdict_counts(results: DataFrame) -> DataFrame:
    """For each msg_id of results (msg_id, verdict) how often it has each verdict, zeros included."""
    return results.groupBy("msg_id").agg(*(F.count_if(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS))


def headlines(results: DataFrame, findings: DataFrame) -> DataFrame:
    """Rows (msg_id, headline) of results (msg_id, verdict, reason) and findings (msg_id, severity); the first rule that holds decides."""
    r = results.groupBy("msg_id").agg(F.bool_or(F.col("reason") == "REG_BELONGS_TO_OTHER").alias("theirs"), *(F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS))
    f = findings.groupBy("msg_id").agg(F.bool_or(F.col("severity") == "high").alias("high"), F.bool_or(F.col("severity") == "medium").alias("medium"))
    is_ = lambda c: F.coalesce(c, F.lit(False))
    return r.join(f, "msg_id", "full").select(
        "msg_id",
        F.when(is_(F.col("theirs")), "H_REG_NOT_THEIRS")
        .when(F.col("CONTRADICTED") == 1, "H_CONTRADICTED_ONE")
        .when(F.col("CONTRADICTED") > 1, "H_CONTRADICTED_MANY")
        .when(F.col("NOT_FOUND") > 0, "H_NOT_FOUND")
        .when(is_(F.col("high")), "H_WARNINGS")
        .when(F.col("MATCHES") > 0, "H_ALL_MATCH")
        .when(F.col("CANT_CHECK") > 0, "H_ONLY_CANT_CHECK")
        .when(is_(F.col("medium")), "H_WARNINGS")
        .otherwise("H_NO_CLAIMS")
        .alias("headline"),
    )


def graph(claims: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (msg_id, node, kind) and edges (msg_id, source, target, kind) of claims (msg_id, claim_id) and their
    results (msg_id, claim_id, verdict, evidence array<string>)."""
    of_evidence = results.select("msg_id", "claim_id", F.explode("evidence").alias("evidence"))
    nodes = claims.select("msg_id", F.col("claim_id").alias("node"), F.lit("claim").alias("kind"))
    nodes = nodes.unionByName(results.select("msg_id", F.concat(F.lit("r-"), "claim_id").alias("node"), F.lit("result").alias("kind")))
    nodes = nodes.unionByName(of_evidence.select("msg_id", F.col("evidence").alias("node"), F.lit("evidence").alias("kind")))
    edges = results.select("msg_id", F.col("claim_id").alias("source"), F.concat(F.lit("r-"), "claim_id").alias("target"), F.lit("judged").alias("kind"))
    edges = edges.unionByName(of_evidence.select("msg_id", F.concat(F.lit("r-"), "claim_id").alias("source"), F.col("evidence").alias("target"), F.lit("rests_on").alias("kind")))
    return nodes.distinct(), edges.distinct()

"""The rules that results cite, as a dimension: who made them, which documents say so, and when they were last read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Documents (title, reference, date, address); of each rule the authority, and its documents with the clause.
READ_ON = "2026-10-04"
PAGES = "https://www.sebi.gov.in/sebi_data/attachdocs/"
NEWS = "https://www.sebi.gov.in/media-and-notifications/press-releases/"
DOCUMENTS = {
    "analysts": ("SEBI Master Circular for Research Analysts", "HO/38/12/11(1)2026-MIRSD-POD/I/4360/2026", "2026-02-06", PAGES + "feb-2026/1770375507051.pdf"),
    "advisers": ("SEBI Master Circular for Investment Advisers", "HO/38/12/11(2)2026-MIRSD-POD/I/4300/2026", "2026-02-06", PAGES + "feb-2026/1770375291405.pdf"),
    "upi": ("SEBI circular: Standardised, validated and exclusive UPI IDs for payment collection by SEBI registered intermediaries", "SEBI/HO/DEPA-II/DEPA-II_SRG/P/CIR/2025/86", "2025-06-11", PAGES + "jun-2025/1749641449497.pdf"),
    "upi-live": ("SEBI press release: Validated UPI handles and SEBI Check now live", "PR No. 64/2025", "2025-10-01", PAGES + "oct-2025/1759322811695.pdf"),
    "brokers": ("SEBI (Stock Brokers) Regulations, 2026", "SEBI/LAD-NRO/GN/2026/291", "2026-01-07", PAGES + "jan-2026/1767852346757.pdf"),
    "issues": ("SEBI (Issue of Capital and Disclosure Requirements) Regulations, 2018 (consolidated text)", "Schedule VI, Part A — General Risk statement", "2026-03-27", PAGES + "mar-2026/1774592300989.pdf"),
    "risks": ("SEBI Master Circular for Stock Brokers — Risk Disclosure Document", "SEBI/HO/MIRSD/MIRSD-PoD/P/CIR/2025/90", "2025-06-17", PAGES + "jun-2025/1750158789381.pdf"),
    "media": ("SEBI press release: Caution to public against fraudulent activities on social media platforms", "PR No. 22/2025", "2025-04-11", NEWS + "apr-2025/caution-to-public-against-fraudulent-manipulative-activities-on-social-media-platforms-smps-related-to-securities-market_93444.html"),
    "groups": ("SEBI press release: Caution to investors on stock market scams through social media platforms", "PR No. 27/2025", "2025-05-21", NEWS + "may-2025/caution-to-investors-on-stock-market-scams-through-social-media-platforms_94064.html"),
    "fpi": ("SEBI press release: Advisory against fraudulent trading schemes claiming to be offered to Indian residents by FPIs", "PR No. 53/2025", "2025-08-22", NEWS + "aug-2025/advisory-against-investment-in-fraudulent-trading-schemes-claiming-to-be-offered-to-indian-residents-by-fpis_96244.html"),
    "mail": ("SEBI press release: Caution to the public regarding impersonation of SEBI", "PR No. 60/2025", "2025-09-05", NEWS + "sep-2025/caution-to-the-public-regarding-impersonation-of-sebi_96449.html"),
    "exchanges": ("Joint press release by stock exchanges: caution against fake FPI/FII sub-accounts and institutional accounts", "Joint release, NSE/BSE", "2024-08-23", "https://nsearchives.nseindia.com/web/sites/default/files/2024-08/PR_cc_23082024_0.pdf"),
}
RULES = {
    "RA_IA_NO_ASSURED_RETURNS": ("SEBI", [("analysts", "Para 11.1(c)(x); Annex B (MITC) items (vi)–(vii)"), ("advisers", "Para 10.1(c)(x); Annex B (MITC)")]),
    "BROKER_NO_GUARANTEED_RETURN_SCHEMES": ("SEBI", [("brokers", "Regulation 20(a)")]),
    "ASSURED_RETURN_SCHEMES_PROHIBITED": ("SEBI", [("analysts", "Annex B (MITC) item (vi)"), ("media", None)]),
    "RA_IA_NO_ACCURACY_CLAIMS": ("SEBI", [("analysts", "Para 11.1(c)(x) and (xii)"), ("advisers", "Para 10.1(c)(x)")]),
    "REGISTRATION_DETAILS_IN_COMMUNICATIONS": ("SEBI", [("analysts", "Para 11.1(b)(i), 11.1(b)(vi), 11.2(i)–(ii)"), ("advisers", "Para 10.1(b), 10.2")]),
    "SEBI_DOES_NOT_APPROVE_SECURITIES": ("SEBI", [("issues", "Para (1)(a)(2)(j)"), ("analysts", "Para 11.1(b)(viii) and 11.2(iii) — mandatory disclaimer")]),
    "EXCHANGES_SEBI_DO_NOT_ENDORSE": ("SEBI", [("risks", "Annexure-10 (Risk Disclosure Document for capital market and derivatives segments)")]),
    "VALIDATED_UPI_FOR_INTERMEDIARIES": ("SEBI", [("upi", "Paras 2, 6.1, 7, 8 and Annexure F (FAQs)"), ("upi-live", None)]),
    "RA_IA_NEVER_ASK_OTP": ("SEBI", [("analysts", "Annex B (MITC) item (xii)"), ("advisers", "Annex B (MITC) item 15")]),
    "RA_IA_NO_CLIENT_FUNDS": ("SEBI", [("advisers", "Annex B (MITC) item 1"), ("analysts", "Investor Charter — \"Do not provide funds for investment to the Research Analyst\"")]),
    "FPI_ROUTE_NOT_FOR_RESIDENTS": ("SEBI", [("fpi", None)]),
    "CAUTION_SOCIAL_MEDIA_LURES": ("SEBI", [("media", None)]),
    "CAUTION_VIP_GROUPS": ("SEBI", [("groups", None)]),
    "CAUTION_FAKE_INSTITUTIONAL_ACCOUNTS": ("NSE/BSE", [("exchanges", None), ("media", None)]),
    "SEBI_EMAIL_DOMAIN": ("SEBI", [("mail", None)]),
}
SCHEMA = "rule_id string, authority string, verified_on string, citations array<struct<title string, reference string, clause string, date string, url string>>"


def rules(spark: SparkSession) -> DataFrame:
    """The dimension of rules (rule_id, authority, verified_on, citations)."""
    cited = lambda name, clause: (DOCUMENTS[name][0], DOCUMENTS[name][1], clause, *DOCUMENTS[name][2:])
    return spark.createDataFrame([(k, who, READ_ON, [cited(*x) for x in docs]) for k, (who, docs) in RULES.items()], SCHEMA)


def citation_fields(citations: Column) -> Column:
    """The citations of a rule as a map: source_1, reference_1 with its clause, date_1, url_1, source_2 and so on."""
    entry = lambda name, k, value: F.struct(F.concat(F.lit(name), (k + 1).cast("string")).alias("key"), value.alias("value"))
    each = F.transform(citations, lambda c, k: F.array(entry("source_", k, c["title"]), entry("reference_", k, F.concat_ws(" — ", c["reference"], c["clause"])), entry("date_", k, c["date"]), entry("url_", k, c["url"])))
    return F.map_from_entries(F.flatten(each))

"""Identifiers in texts: registration numbers, phones, payment handles, addresses of mail and pages, accounts, names."""

from __future__ import annotations

from collections.abc import Callable

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsieve.functions import domains, numbering, spans, text

# What is read for a digit; families of numbers, their forms, and what their first letters stand for.
DIGITISH, DIGITS = "OoDQIl|iSsBZzG", "00001111558226"
BODY = "[0-9OoDQIl|iSsBZzG]"
PREFIXES = {"INH": "SEBI_RA", "INA": "SEBI_IA", "INZ": "SEBI_BROKER", "INB": "SEBI_BROKER", "INF": "SEBI_BROKER", "INE": "SEBI_BROKER", "INP": "SEBI_PMS", "INM": "SEBI_MB", "INR": "SEBI_RTA", "IND": "SEBI_DT"}
FORMATS = {
    "SEBI_RA": ("INH + 9 digits", r"^INH\d{9}$"),
    "SEBI_IA": ("INA + 9 digits", r"^INA\d{9}$"),
    "SEBI_BROKER": ("INZ + 9 digits", r"^IN[ZBFE]\d{9}$"),
    "SEBI_PMS": ("INP + 9 digits", r"^INP\d{9}$"),
    "SEBI_MB": ("INM + 9 digits", r"^INM\d{9}$"),
    "SEBI_RTA": ("INR + 9 digits", r"^INR\d{9}$"),
    "SEBI_DT": ("IND + 9 digits", r"^IND\d{9}$"),
    "SEBI_DP": ("IN-DP-…", r"^IN-DP-(?:(?:NSDL|CDSL)-)?\d{1,5}-\d{2}(?:\d{2})?$"),
    "SEBI_MF": ("MF/xxx/yy/z", r"^MF/\d{3}/\d{2}/\d{1,2}$"),
    "SEBI_AIF": ("IN/AIFn/yy-yy/nnnn", r"^IN/AIF[123]/\d{2}-\d{2}/\d{3,5}$"),
    "AMFI_ARN": ("ARN-number", r"^ARN-\d{1,7}$"),
}
CATEGORY = {"SEBI_RA": "RA", "SEBI_IA": "IA", "SEBI_BROKER": "BROKER", "SEBI_PMS": "PMS", "SEBI_MB": "MB", "SEBI_RTA": "RTA", "SEBI_DT": "DT", "SEBI_DP": "DP", "SEBI_MF": "MF", "SEBI_AIF": "AIF"}
NUMBERS = (
    rf"(?<![A-Za-z0-9])([I1l][Nn][HAZPMRDBFEhazpmrdbfe])([ \t:.\-–]{{0,3}})((?:{BODY}[ \t\-]?){{8,10}}{BODY})(?![A-Za-z0-9])",
    r"(?i)(?<![A-Za-z0-9])IN[\s-]?DP[\s-]?(?:(NSDL|CDSL)[\s-]?)?(\d{1,5})[\s-](\d{4}|\d{2})(?![0-9])",
    r"(?<![A-Za-z0-9])MF\s?/\s?(\d{3})\s?/\s?(\d{2})\s?/\s?(\d{1,2})(?![0-9])",
    r"(?i)(?<![A-Za-z0-9])IN\s?/\s?AIF\s?(\d)\s?/\s?(\d{2})\s?-\s?(\d{2})\s?/\s?(\d{3,5})(?![0-9])",
    r"(?i)(?<![A-Za-z0-9])ARN[\s:.\-–]{0,3}(\d{1,7})(?![0-9])",
)
#: Suffixes of validated handles by category.
UPI_SUFFIXES = {"RA": "ra", "IA": "ia", "BROKER": "brk", "PMS": "pms", "MF": "mf"}
#: Digits that are read for each other.
SWAPS = {"0": "869", "1": "74", "3": "8", "5": "63", "6": "580", "7": "1", "8": "0369", "9": "80"}
# Wording of accounts and payments; handles of payment services; free mailboxes; shorteners of links.
ACCOUNT = r"(?:a/c|acc(?:ount)?\.?|acct|खाता)"
ACCOUNT_BEFORE = r"(?i)(a/c|acc(?:ount)?\.?|acct|खाता|khata)\s*(no\.?|number|num|#|संख्या)?\s*[:-]?\s*$"
PAYING = r"(?iU)\b(upi|vpa|gpay|google ?pay|phone ?pe|phonepe|paytm|bhim|pay|payment|transfer|send|qr)\b|भुगतान|यूपीआई|पेमेंट"
SERVICES = "ybl ibl axl paytm ptyes ptaxis pthdfc ptsbi okicici okhdfcbank oksbi okaxis upi apl yapl rapl icici hdfcbank sbi axisbank axisb kotak kbl idfcbank idfcfirst indus federal fbl freecharge airtel jio pingpay abfspay ikwik mbk timecosmos superyes fam jupiteraxis slice naviaxis yesbank yesbankltd cnrb barodampay pnb unionbank uboi allbank aubank citi dbs equitas hsbc idbi iob kvb rbl sc tjsb ubi utbi waicici wahdfcbank wasbi waaxis postbank cmsidfc kmbl dlb ezeepay boi mahb cbin psb csbpay".split()
FREE_MAIL = "gmail.com googlemail.com yahoo.com yahoo.co.in yahoo.in ymail.com rediffmail.com rediff.com hotmail.com outlook.com outlook.in live.com live.in msn.com icloud.com me.com aol.com protonmail.com proton.me zoho.com zohomail.in gmx.com mail.com yandex.com tutanota.com".split()
SHORTENERS = "bit.ly tinyurl.com t.co goo.gl cutt.ly rb.gy is.gd ow.ly shorturl.at tiny.cc rebrand.ly bl.ink shorte.st buff.ly surl.li v.gd qr.ae lnkd.in shrtco.de urlz.fr clck.ru linktr.ee bitly.com short.gy i8.ae".split()
INVITES = {"t.me": "telegram", "telegram.me": "telegram", "telegram.dog": "telegram", "chat.whatsapp.com": "whatsapp_group", "wa.me": "whatsapp_chat", "api.whatsapp.com": "whatsapp_chat"}
# Shapes of firms' names.
SP, WORD = r"[ \t]+", r"[A-Z0-9][A-Za-z0-9&.'-]*"
INDUSTRY = rf"(?:Investments?|Capital|Research|Advisory|Advisors?|Advisers?|Securities|Wealth|Financial(?:{SP}Services)?|Broking|Finserv|Fintech|Markets|Trading|Ventures|Associates|Analytics)"
LEGAL = rf"(?:Pvt\.?[ \t]*Ltd\.?|Private{SP}Limited|Limited|Ltd\.?|LLP)"
DESK = rf"(?:Support|Team|Desk|Care|Helpdesk|Help{SP}Desk|Customer{SP}Care|Official|Calls)"
NAMES = (
    rf"(?<![A-Za-z])((?:{WORD}{SP}){{1,4}}{INDUSTRY}(?:{SP}{LEGAL})?)(?![A-Za-z])",
    rf"(?<![A-Za-z])((?:{WORD}{SP}){{1,5}}{LEGAL})(?![A-Za-z])",
    rf"(?<![A-Za-z])({WORD}(?:{SP}{WORD}){{0,2}}){SP}{DESK}(?![A-Za-z])",
)
NO_NAME = r"^(SEBI|NSE|BSE|RBI|Our|Your|The|This|Join|Pay|Get|Earn|Daily|Free|Best|Top|Premium|VIP|Registered|Dear|Hello|Hi|Contact|Call|Customer|Investments?|Research)\b"
URL = r"(?i)\bhttps?://[^\s<>\"'`)\]}]+"
BARE = r"(?i)(?<![@\w./-])((?:www\.)?(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24})(/[^\s<>\"'`)\]}]*)?"

NUMBER_FINDER = spans.Finder(NUMBERS, r"(?i)[I1l]N|MF\s?/|ARN", 0)
#: Numbers that phones are written as: with a country's code; ten digits of an Indian mobile; an Indian area's code and number.
PHONE_FINDER = spans.Finder((r"\+\d[\d() .-]{6,18}\d", r"(?<![\d+])(?:0|91[ -]?)?[6-9]\d{4}[ -]?\d{5}(?!\d)", r"(?<![\d+])\(?0[1-8]\d{1,3}\)?[ -]\d{3,4}[ -]?\d{3,4}(?!\d)"), r"\d{3}|\+\d", 0)
OTHER_FINDER = spans.Finder(
    (
        r"(?<![\w.@-])([a-zA-Z0-9][a-zA-Z0-9._-]{1,255})@([a-zA-Z][a-zA-Z0-9]{1,63})(?![\w@]|\.[a-zA-Z])",
        r"(?<![\w.-])([a-zA-Z0-9._%+-]{1,64})@([a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)*\.[a-zA-Z]{2,24})(?![\w-])",
        r"(?i)(?:telegram|टेलीग्राम|\btg\b)[^\n@]{0,30}(?<![\w.])@([a-zA-Z][a-zA-Z0-9_]{4,31})\b",
        r"(?i)(?<![\w.])@([a-zA-Z][a-zA-Z0-9_]{4,31})\b[^\n@]{0,30}?(?:telegram|टेलीग्राम|\btg\b)",
        rf"(?i){ACCOUNT}\s*(?:no\.?|number|num|#|संख्या)?\s*[:-]?\s*(\d[\d\s-]{{7,20}}\d)",
        r"\b([A-Z]{4}0[A-Z0-9]{6})\b",
    ),
    r"(?i)@|a/c|acc|खाता|[A-Z]{4}0",
    0,
)
URL_FINDER = spans.Finder((URL, BARE), r"(?i)https?://|[a-z0-9]\.[a-z]{2}", 0)
NAME_FINDER = spans.Finder(NAMES, rf"{INDUSTRY}|{LEGAL}|{DESK}", 0)


def dimension(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def first_of_each(items: Column, key: str) -> Column:
    """The items of an array of structs whose key no earlier one has."""
    return F.filter(items, lambda x, i: F.forall(F.slice(items, F.lit(1), i), lambda y: y[key] != x[key]))


def _told(found: Column, told: Callable[[Column], Column], key: str, keep: Callable[[Column], Column] = lambda ms: ms) -> Column:
    """What matches tell, of those that count (`is`), each key once."""
    each = spans.let(found, lambda ms: F.filter(F.transform(keep(ms), told), lambda x: x["is"]))
    return spans.let(each, lambda every: F.transform(first_of_each(every, key), lambda x: x.dropFields("is")))


def trim_at_ninth(body: Column) -> Column:
    """A number's body up to the group that makes nine characters, if groups do so exactly."""


    def of(groups: Column) -> Column:
        sizes = lambda k: F.aggregate(F.slice(groups, F.lit(1), k), F.lit(0), lambda a, g: a + F.length(g))
        full = F.get(F.filter(F.sequence(F.lit(1), F.greatest(F.size(groups) - 1, F.lit(1))), lambda k: sizes(k) == 9), F.lit(0))
        return spans.let(full, lambda n: F.when(n.isNotNull() & (n < F.size(groups)), F.array_join(F.slice(groups, F.lit(1), n), " ")).otherwise(body))

    return spans.let(F.filter(F.split(body, r"[ \t-]+"), lambda g: g != ""), of)


def read_digits(body: Column) -> Column:
    """Digits as they are meant, what stands between them left out."""
    return F.translate(F.regexp_replace(body, rf"[^0-9{regex.escape(DIGITISH)}]", ""), DIGITISH, DIGITS)


def scheme_of(number: Column) -> Column:
    """Struct (scheme, format_valid) of a normalised number."""


    def of(n: Column) -> Column:
        known = None
        for name, (_, form) in FORMATS.items():
            known = F.when(n.rlike(form), name) if known is None else known.when(n.rlike(form), name)
        other = F.coalesce(dimension(PREFIXES)[F.substring(n, 1, 3)], F.when(n.startswith("ARN"), "AMFI_ARN").otherwise("SEBI_OTHER"))
        return spans.let(known, lambda scheme: F.struct(F.coalesce(scheme, other).alias("scheme"), scheme.isNotNull().alias("format_valid")))

    return spans.let(number, of)


def shape_of(scheme: Column) -> Column:
    return dimension({k: shape for k, (shape, _) in FORMATS.items()})[scheme]


def registration_numbers(t: Column) -> Column:
    """Array of structs (raw, normalized, scheme, format_valid, reinterpreted, start, end), each number once."""

    def told(m: Column) -> Column:
        g = lambda k: F.coalesce(F.get(m["groups"], F.lit(k)), F.lit(""))
        letters = m["rule"] == 0
        prefix = F.concat(F.lit("IN"), F.upper(F.substring(g(0), 3, 1)))

        def of_body(a: Column) -> Column:
            number = (
                F.when(letters, F.concat(prefix, a["digits"]))
                .when(m["rule"] == 1, F.concat(F.lit("IN-DP-"), F.when(g(0) != "", F.concat(F.upper(g(0)), F.lit("-"))).otherwise(""), g(1), F.lit("-"), g(2)))
                .when(m["rule"] == 2, F.concat(F.lit("MF/"), g(0), F.lit("/"), g(1), F.lit("/"), g(2)))
                .when(m["rule"] == 3, F.concat(F.lit("IN/AIF"), g(0), F.lit("/"), g(1), F.lit("-"), g(2), F.lit("/"), g(3)))
                .otherwise(F.concat(F.lit("ARN-"), g(0)))
            )
            raw = F.trim(F.when(letters, F.concat(g(0), g(1), a["body"])).otherwise(spans.piece(t, m["start"], m["end"])))
            plain = F.regexp_replace(a["body"], r"[ \t\-]", "")
            read = F.when(letters, (plain != a["digits"]) | ~g(0).startswith("IN")).otherwise(F.lit(False))
            return F.struct(number.alias("number"), raw.alias("raw"), read.alias("read"), scheme_of(number).alias("of"))

        def of_number(a: Column) -> Column:
            # Sums in rupees and country tags, bankers to an issue, and legacy numbers with letters in them are no numbers.
            sum_ = prefix.isin("INR", "IND") & ((g(1) != "") | ~g(2).rlike("^[0Oo]"))
            other = (prefix == "INB") & g(2).rlike("^[Il|i]")
            legacy = prefix.isin("INE", "INF", "INB") & g(2).rlike(r"[^0-9\s-]")
            valid = F.when(letters, a["of"]["format_valid"]).otherwise(F.lit(True))
            kind = F.when(letters, a["of"]["scheme"]).otherwise(F.element_at(F.array(*map(F.lit, ("SEBI_DP", "SEBI_MF", "SEBI_AIF", "AMFI_ARN"))), F.greatest(m["rule"], F.lit(1))))
            return F.struct(F.when(letters, ~(sum_ | other | legacy)).otherwise(F.lit(True)).alias("is"), a["raw"].alias("raw"), a["number"].alias("normalized"), kind.alias("scheme"), valid.alias("format_valid"), a["read"].alias("reinterpreted"), m["start"].alias("start"), (m["start"] + F.length(a["raw"])).alias("end"))

        digits = spans.let(trim_at_ninth(g(2)), lambda body: F.struct(body.alias("body"), read_digits(body).alias("digits")))
        return spans.let(spans.let(digits, of_body), of_number)

    return _told(spans.matches(t, NUMBER_FINDER), told, "normalized")


def confusable_variants(number: Column, most: int = 12) -> Column:
    """Numbers that differ in one digit which is easily misread, from left to right, `most` by definition."""
    swaps = F.create_map(*(x for d, alts in SWAPS.items() for x in (F.lit(d), F.array(*map(F.lit, alts)))))
    at = F.sequence(F.lit(4), F.greatest(F.length(number), F.lit(4)))
    one = lambda i: F.transform(F.coalesce(swaps[F.substring(number, i, F.lit(1))], F.array().cast("array<string>")), lambda a: F.concat(F.substring(number, F.lit(1), i - 1), a, F.substring(number, i + 1, F.length(number))))
    return F.when(F.substring(number, F.lit(4), F.length(number)).rlike(r"^\d+$"), F.slice(F.flatten(F.transform(at, one)), 1, most)).otherwise(F.array().cast("array<string>"))


def phones(t: Column) -> Column:
    """Array of structs (raw, e164, country, indian, start, end), each number once: not those of accounts, handles and
    addresses, nor what no country's numbering plan has."""

    def told(m: Column) -> Column:
        def of(a: Column) -> Column:
            whole = F.when(m["rule"] == 0, a["digits"]).otherwise(F.concat(F.lit("91"), F.right(a["digits"], F.lit(10))))
            return spans.let(whole, lambda w: F.struct(a["raw"].alias("raw"), a["digits"].alias("digits"), F.concat(F.lit("+"), w).alias("number"), numbering.analyse(w).alias("plan")))

        return spans.let(spans.let(spans.let(spans.piece(t, m["start"], m["end"]), lambda raw: F.struct(raw.alias("raw"), F.regexp_replace(raw, r"\D", "").alias("digits"))), of), lambda a: counted(m, a))

    def counted(m: Column, a: Column) -> Column:
        plan = a["plan"]
        before, at = spans.piece(t, m["start"] - 24, m["start"]), spans.piece(t, m["start"] - 1, m["start"])
        own = ~before.rlike(ACCOUNT_BEFORE) & ~at.rlike(r"[\w.@]") & (spans.piece(t, m["end"], m["end"] + 1) != "@")
        valid = plan["valid"] & F.when(m["rule"] == 2, F.length(a["digits"]) == 11).otherwise(F.lit(True))
        return F.struct((own & valid).alias("is"), a["raw"].alias("raw"), a["number"].alias("e164"), plan["country"].alias("country"), (plan["country"] == "IN").alias("indian"), m["start"].alias("start"), m["end"].alias("end"))

    def apart(ms: Column) -> Column:
        sooner = lambda m: F.exists(ms, lambda c: (c["rule"] < m["rule"]) & (m["start"] < c["end"]) & (c["start"] < m["end"]))
        return F.filter(ms, lambda m: ~sooner(m))

    return _told(spans.matches(t, PHONE_FINDER), told, "e164", apart)


def analyse_upi(v: Column) -> Column:
    """Struct (value, username, psp, category_suffix, mobile_based); the suffix is there for validated handles only."""


    def of(low: Column) -> Column:
        user = F.split_part(low, F.lit("@"), F.lit(1))
        suffix = F.regexp_extract(low, r"^[a-z0-9._-]+\.([a-z]{2,6})@valid[a-z]+$", 1)
        return F.struct(low.alias("value"), user.alias("username"), F.split_part(low, F.lit("@"), F.lit(2)).alias("psp"), F.nullif(suffix, F.lit("")).alias("category_suffix"), user.rlike(r"^(\+?91)?[6-9]\d{9}(-\d)?$").alias("mobile_based"))

    return spans.let(F.lower(v), of)


def others(t: Column) -> Column:
    """Matches that upi_ids(), emails(), handles() and bank_accounts() are told by, for those who ask for several."""
    return spans.matches(t, OTHER_FINDER)


def _found(t: Column, found: Column | None, *rules: int) -> Column:
    return F.filter(others(t) if found is None else found, lambda m: m["rule"].isin(*rules))


def upi_ids(t: Column, found: Column | None = None) -> Column:
    """Array of structs (value, username, psp, category_suffix, mobile_based, start, end), each once: of known services,
    or of any if the text speaks of paying."""

    def told(m: Column) -> Column:
        def of(u: Column) -> Column:
            known = u["psp"].isin(SERVICES) | u["psp"].startswith("valid") | u["psp"].startswith("ok") | t.rlike(PAYING)
            return F.struct(*(u[k].alias(k) for k in ("value", "username", "psp", "category_suffix", "mobile_based")), m["start"].alias("start"), m["end"].alias("end"), known.alias("is"))

        return spans.let(analyse_upi(spans.piece(t, m["start"], m["end"])), of)

    return _told(_found(t, found, 0), told, "value")


def emails(t: Column, found: Column | None = None) -> Column:
    """Array of structs (address, domain, free_mail, start, end), each once; domains whose suffix is one are left to emails_of()."""

    def told(m: Column) -> Column:
        def of(address: Column) -> Column:
            domain = F.split_part(address, F.lit("@"), F.lit(2))
            return F.struct(address.alias("address"), domain.alias("domain"), domain.isin(FREE_MAIL).alias("free_mail"), m["start"].alias("start"), m["end"].alias("end"), F.lit(True).alias("is"))

        return spans.let(F.lower(spans.piece(t, m["start"], m["end"])), of)

    return _told(_found(t, found, 1), told, "address")


def handles(t: Column, found: Column | None = None) -> Column:
    """Array of structs (platform, value, start, end) of handles beside a platform's name, each once."""

    def told(m: Column) -> Column:
        at = F.concat(F.lit("@"), F.get(m["groups"], F.lit(0)))
        start = m["start"] + F.locate("@", spans.piece(t, m["start"], m["end"])) - 1
        return F.struct(F.lit("telegram").alias("platform"), F.lower(at).alias("value"), start.alias("start"), (start + F.length(at)).alias("end"), F.lit(True).alias("is"))

    return _told(_found(t, found, 2, 3), told, "value", lambda ms: F.concat(F.filter(ms, lambda m: m["rule"] == 2), F.filter(ms, lambda m: m["rule"] == 3)))


def bank_accounts(t: Column, found: Column | None = None) -> Column:
    """Array of structs (masked, ifsc, start, end) of account numbers after wording that says so; the code is the first
    that stands within 200 characters."""

    def all_of(ms: Column) -> Column:
        def told(m: Column) -> Column:
            digits = F.regexp_replace(F.get(m["groups"], F.lit(0)), r"\D", "")
            near = F.get(F.filter(ms, lambda c: (c["rule"] == 5) & (F.abs(c["start"] - m["start"]) < 200)), F.lit(0))
            return F.struct(F.length(digits).between(9, 18).alias("is"), F.concat(F.lit("XXXX"), F.right(digits, F.lit(4))).alias("masked"), F.get(near["groups"], F.lit(0)).alias("ifsc"), m["start"].alias("start"), (m["start"] + 1).alias("end"))

        return F.transform(F.filter(F.transform(F.filter(ms, lambda m: m["rule"] == 4), told), lambda x: x["is"]), lambda x: x.dropFields("is"))

    return spans.let(_found(t, found, 4, 5), all_of)


def analyse_url(raw: Column) -> Column:
    """Struct (href, host, path, apk, ip_host, app_store, app_store_id, invite) of an address, with or without a scheme."""

    def parts(full: Column) -> Column:
        host = F.lower(F.regexp_extract(full, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))
        path = spans.let(F.regexp_extract(full, r"^[A-Za-z]+://[^/?#]+(.*)$", 1), lambda rest: F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))
        return F.struct(F.lower(F.regexp_extract(full, r"^([A-Za-z]+)://", 1)).alias("scheme"), host.alias("host"), path.alias("path"))

    def told(a: Column) -> Column:
        path, short = a["path"], F.regexp_replace(a["host"], r"^www\.", "")
        store = F.when(short == "play.google.com", "play").when(short == "apps.apple.com", "apple")
        store_id = F.when(store == "play", F.regexp_extract(path, r"[?&]id=([^&#]+)", 1)).when(store == "apple", F.regexp_extract(path, r"/id(\d+)", 1))
        return F.struct(F.concat(a["scheme"], F.lit("://"), a["host"], path).alias("href"), short.alias("host"), path.alias("path"), F.lower(path).rlike(r"\.apk(\?|#|$)").alias("apk"), short.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$").alias("ip_host"), store.alias("app_store"), F.nullif(store_id, F.lit("")).alias("app_store_id"), dimension(INVITES)[short].alias("invite"))

    full = spans.let(F.regexp_replace(raw, r"[.,;:!?]+$", ""), lambda own: F.when(own.rlike("(?i)^https?://"), own).otherwise(F.concat(F.lit("https://"), own)))
    return spans.let(spans.let(full, parts), told)


def url_candidates(t: Column) -> Column:
    """Array of structs (url struct, raw, bare, start, end): addresses with a scheme, and names outside them that may be one."""

    def told(m: Column) -> Column:
        of = lambda raw: F.struct(analyse_url(raw).alias("url"), raw.alias("raw"), (m["rule"] == 1).alias("bare"), m["start"].alias("start"), (m["start"] + F.length(raw)).alias("end"))
        return spans.let(F.regexp_replace(spans.piece(t, m["start"], m["end"]), r"[.,;:!?]+$", ""), of)

    # Abbreviations and sums look like names, too: "Rs.500", "e.g."; one host has a single letter.
    name = lambda m: spans.piece(t, m["start"], m["end"])
    maybe = lambda m: name(m).rlike(r"(?i)[a-z]{2,}\.[a-z]{2,}") | name(m).rlike(r"(?i)^t\.me/.")

    def all_of(ms: Column) -> Column:
        inside = lambda m: F.exists(ms, lambda s: (s["rule"] == 0) & (m["start"] >= s["start"]) & (m["start"] < s["end"]))
        with_scheme, alone = F.filter(ms, lambda m: m["rule"] == 0), F.filter(ms, lambda m: (m["rule"] == 1) & ~inside(m) & maybe(m))
        return F.transform(F.concat(with_scheme, alone), told)

    return spans.let(spans.matches(t, URL_FINDER), all_of)


def urls(segments: DataFrame) -> DataFrame:
    """Rows (*keys, href, host, domain, shortener, apk, ip_host, app_store, app_store_id, invite, raw, start, end) of the
    addresses in segments (..., text), whose suffix is a public one; of each text and address the first."""
    keys = [c for c in segments.columns if c != "text"]
    each = segments.select(*keys, F.posexplode(url_candidates(F.col("text"))).alias("ord", "u")).select(*keys, "ord", "u.url.*", "u.raw", "u.bare", "u.start", "u.end")
    each = each.withColumn("parts", domains.domain_parts(F.col("host")))
    there = F.when(F.col("ip_host"), ~F.col("bare")).otherwise(F.coalesce(F.col("parts.known"), F.lit(False)))
    each = each.where(there).withColumn("domain", F.when(~F.col("ip_host"), F.col("parts.domain")))
    first = F.row_number().over(Window.partitionBy(*keys, F.regexp_replace("href", "/$", "")).orderBy("ord"))
    each = each.withColumn("n", first).where("n = 1")
    short = F.col("host").isin(SHORTENERS) | F.coalesce(F.col("domain").isin(SHORTENERS), F.lit(False))
    return each.select(*keys, "href", "host", "domain", short.alias("shortener"), "apk", "ip_host", "app_store", "app_store_id", "invite", "raw", "start", "end")


def business_names(t: Column) -> Column:
    """Array of structs (name, start, end) of what looks like a firm's name; of names in each other the longest."""

    def told(m: Column) -> Column:
        name = F.trim(F.get(m["groups"], F.lit(0)))
        return F.struct(name.alias("name"), m["start"].alias("start"), (m["start"] + F.length(name)).alias("end"))

    fit = spans.let(spans.matches(t, NAME_FINDER), lambda ms: F.filter(F.transform(ms, told), lambda x: F.length(x["name"]).between(3, 70) & ~x["name"].rlike(NO_NAME)))
    low = lambda x: F.lower(x["name"])

    def longest(every: Column) -> Column:
        numbered = F.transform(every, lambda y, k: F.struct(y.alias("y"), k.alias("k")))
        inside = lambda x, i: F.exists(numbered, lambda o: (o["k"] != i) & F.contains(low(o["y"]), low(x)) & ((F.length(o["y"]["name"]) > F.length(x["name"])) | (o["k"] < i)))
        return F.filter(every, lambda x, i: ~inside(x, i))

    return spans.let(fit, longest)


def legibility(origin: Column, quality: Column, unclear: Column, raw: Column, reinterpreted: Column | None = None) -> Column:
    """clear or uncertain: what was reinterpreted, spoken or read poorly is uncertain, and what an unclear fragment shares."""
    plain = lambda f: F.lower(F.regexp_replace(f, r"[^\p{L}\p{N}]+", ""))
    fragments = F.coalesce(unclear, F.array().cast("array<string>"))
    shared = spans.let(text.alnum_only(raw), lambda v: F.exists(fragments, lambda f: (plain(f) != "") & (F.contains(v, plain(f)) | F.contains(plain(f), v))))
    return (
        F.when(F.lit(False) if reinterpreted is None else reinterpreted, "uncertain")
        .when(origin.isin("text", "url"), "clear")
        .when(origin == "audio", "uncertain")
        .when(quality.isin("poor", "unreadable"), "uncertain")
        .when(shared, "uncertain")
        .otherwise("clear")
    )


def entities(segments: DataFrame) -> DataFrame:
    """Rows (msg_id, kind, entity_id, key, raw, attrs map, legibility, spans array<struct<seq, start, end>>) of segments
    (msg_id, seq, text, origin, quality, unclear).

    What several segments have is one entity with several spans; it is numbered among its kind by where it stands first.
    A registration number that is clear in one segment is clear; other kinds are as clear as their first reading.
    """
    t, m = F.col("text"), F.col("found")
    s = segments.select("msg_id", "seq", "text", "origin", "quality", "unclear", others(t).alias("found"))
    put = lambda **own: F.map_filter(F.create_map(*(x for k, v in own.items() for x in (F.lit(k), v.cast("string")))), lambda k, v: v.isNotNull())
    item = lambda kind, key, raw, attrs, x, read=None: F.struct(F.lit(kind).alias("kind"), key.alias("key"), raw.alias("raw"), attrs.alias("attrs"), (F.lit(False) if read is None else read).alias("read"), x["start"].alias("start"), x["end"].alias("end"))
    found = [
        F.transform(registration_numbers(t), lambda x: item("reg", x["normalized"], x["raw"], put(normalized=x["normalized"], scheme=x["scheme"], format_valid=x["format_valid"]), x, x["reinterpreted"])),
        F.transform(phones(t), lambda x: item("phone", x["e164"], x["raw"], put(e164=x["e164"], country=x["country"], indian=x["indian"]), x)),
        F.transform(upi_ids(t, m), lambda x: item("upi", x["value"], x["value"], put(value=x["value"], psp=x["psp"], category_suffix=x["category_suffix"], mobile_based=x["mobile_based"]), x)),
        F.transform(emails(t, m), lambda x: item("email", x["address"], x["address"], put(address=x["address"], domain=x["domain"], free_mail=x["free_mail"]), x)),
        F.transform(handles(t, m), lambda x: item("handle", x["value"], x["value"], put(platform=x["platform"], value=x["value"]), x)),
        F.transform(bank_accounts(t, m), lambda x: item("bank", F.concat_ws(":", x["masked"], F.coalesce(x["ifsc"], F.lit(""))), x["masked"], put(masked=x["masked"], ifsc=x["ifsc"]), x)),
    ]
    base = ["msg_id", "seq", "origin", "quality", "unclear"]
    rows = s.select(*base, F.explode(F.concat(*found)).alias("x")).select(*base, "x.*")
    rows = rows.withColumn("suffix", F.when(F.col("kind") == "email", domains.registrable_domain(F.col("attrs")["domain"]))).where("kind <> 'email' OR suffix IS NOT NULL").drop("suffix")
    u = urls(s.drop("found"))
    pages = u.select(*base, F.lit("url").alias("kind"), F.col("href").alias("key"), "raw", put(**{c: F.col(c) for c in ("href", "host", "domain", "shortener", "apk", "ip_host", "app_store", "app_store_id", "invite")}).alias("attrs"), F.lit(False).alias("read"), "start", "end")
    rows = rows.unionByName(pages).withColumn("legible", legibility(F.col("origin"), F.col("quality"), F.col("unclear"), F.col("raw"), F.col("read")))
    first = lambda c: F.min_by(c, F.struct("seq", "start")).alias(c)
    merged = rows.groupBy("msg_id", "kind", "key").agg(first("raw"), first("attrs"), first("legible"), F.bool_or(F.col("legible") == "clear").alias("ever"), F.array_sort(F.collect_list(F.struct("seq", "start", "end"))).alias("spans"))
    number = F.row_number().over(Window.partitionBy("msg_id", "kind").orderBy("spans"))
    clear = F.when(F.col("kind").isin("reg", "phone", "upi"), F.when((F.col("kind") == "reg") & F.col("ever"), "clear").otherwise(F.col("legible")))
    return merged.select("msg_id", "kind", F.concat("kind", F.lit("-"), number.cast("string")).alias("entity_id"), "key", "raw", "attrs", clear.alias("legibility"), "spans")


def disagreements(first: DataFrame, second: DataFrame) -> DataFrame:
    """The identifiers (msg_id, kind, key) of a first reading that an independent second one doesn't have."""
    return first.select("msg_id", "kind", "key").distinct().join(second.select("msg_id", "kind", "key"), ["msg_id", "kind", "key"], "left_anti")

"""Wording in English, Hindi and both mixed: kinds of phrases, where they stand, and what they say."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofsieve.functions import spans

# The wording of each kind. L and R are the ends of words, in any script.
L, R = r"(?<![\p{L}\p{M}\p{N}])", r"(?![\p{L}\p{M}\p{N}])"
GUARANTEES = [  # kind, whether a negation undoes it, wording
    ("guaranteed", True, f"{L}(?:guarantee(?:d)?|guaranty){R}"),
    ("assured", True, f"{L}assured{R}"),
    ("fixed", True, rf"{L}fixed\s+(?:daily\s+|weekly\s+|monthly\s+)?(?:returns?|profits?|income|payouts?|earnings?){R}"),
    ("risk_free", True, rf"{L}(?:risk[\s-]?free|zero[\s-]?risk){R}"),
    ("risk_free", False, rf"{L}(?:no|without\s+(?:any\s+)?)[\s-]?risk{R}"),
    ("no_loss", False, rf"{L}(?:no[\s-]?loss|loss[\s-]?proof|zero[\s-]?loss){R}"),
    ("guaranteed", True, rf"{L}100\s?%\s*(?:profit|returns?|sure|safe|guaranteed|accura(?:cy|te)|success){R}"),
    ("guaranteed", True, rf"{L}sure[\s-]?shot{R}"),
    ("guaranteed", True, rf"{L}(?:double\s+(?:your|the)\s+(?:money|investment|capital)|money\s+double){R}"),
    ("no_loss", True, rf"{L}capital\s+(?:protection|protected|safe){R}"),
    ("guaranteed", True, r"गारंटी(?:ड|शुदा)?"),
    ("guaranteed", True, r"पक्का\s*(?:मुनाफा|मुनाफ़ा|रिटर्न|प्रॉफिट|लाभ|फायदा|फ़ायदा)"),
    ("fixed", True, r"निश्चित\s*(?:रिटर्न|लाभ|मुनाफा|मुनाफ़ा|आय|कमाई)"),
    ("risk_free", False, r"बिना\s*(?:किसी\s*)?(?:जोखिम|रिस्क|नुकसान|नुक़सान)"),
    ("no_loss", False, r"(?:कोई\s*)?(?:जोखिम|रिस्क|नुकसान|नुक़सान|लॉस)\s*नहीं"),
    ("guaranteed", True, r"(?:पैसा|पैसे|रकम)\s*(?:डबल|दोगुना|दुगना)"),
    ("guaranteed", True, rf"{L}pakk?a\s+(?:profit|munafa|return|returns|fayda){R}"),
    ("no_loss", False, rf"{L}(?:loss|nuksaan|nuksan|risk)\s+(?:nahi|nahin|nhi)\s*(?:hoga|hai|hota)?{R}"),
    ("guaranteed", True, rf"{L}paisa\s+double{R}"),
]
NEGATORS = rf"{L}(?:not|no|never|nor|cannot|can't|cant|isn't|aren't|don't|doesn't|won't|neither|without\s+any){R}[^.\n]{{0,24}}$"
NEGATED_BEHIND = rf"^[^.\n]{{0,12}}{L}(?:नहीं|नही|nahi|nahin|nhi|not){R}"
PERIODS = {
    "day": r"daily|per\s*day|a\s*day|/\s*day|every\s*day|each\s*day|roz|rozana|roj|rojana|daily\s*basis|प्रतिदिन|रोज़ाना|रोजाना|रोज़|रोज|हर\s*दिन|दिन",
    "week": r"weekly|per\s*week|a\s*week|/\s*week|every\s*week|hafte|hafta|साप्ताहिक|हर\s*हफ्ते|हफ्ते|हफ़्ते|सप्ताह",
    "month": r"monthly|per\s*month|a\s*month|/\s*month|every\s*month|p\.\s*m\.|mahina|mahine|mahiney|मासिक|हर\s*महीने|महीने|महीना|प्रति\s*माह",
    "year": r"yearly|annual(?:ly)?|per\s*(?:year|annum)|a\s*year|p\.\s*a\.|/\s*year|saal|वार्षिक|सालाना|प्रति\s*वर्ष|साल",
    "trade": r"per\s*trade|every\s*trade|each\s*trade|har\s*trade",
}
PERCENT = r"(\d{1,5}(?:\.\d{1,2})?)\s?(?:%|percent|प्रतिशत|फीसदी|फ़ीसदी)"
GAINS = "return|returns|profit|profits|income|interest|gain|gains|munafa|मुनाफा|रिटर्न|लाभ"
GAINS_BEFORE = "return|returns|profit|profits|income|munafa|मुनाफा|रिटर्न|लाभ"
MARKET = rf"{L}(?:stocks?|shares?|trading|trade|traders?|intraday|options?|f\s?&\s?o|futures|derivatives?|nifty|bank\s?nifty|sensex|ipo|crypto|bitcoin|usdt|forex|fx|commodit(?:y|ies)|mcx|tips?|calls?|jackpot|multibagger|demat|portfolio|equity|mutual\s+funds?|शेयर|ट्रेडिंग|स्टॉक|आईपीओ|निफ्टी|क्रिप्टो|फॉरेक्स|टिप्स|कॉल){R}"
DEPOSIT = rf"{L}(?:fd|fixed\s+deposits?|recurring\s+deposits?|rd|savings?\s+(?:account|scheme)|ppf|nsc|post\s+office|senior\s+citizens?\s+savings|bank\s+deposits?|term\s+deposits?|एफडी|सावधि\s+जमा){R}"
MENTIONS = [
    rf"{L}(?:sebi|सेबी)[\s\-:]*(?:regd\.?|registered|registration|reg\.?|regn\.?|licen[cs]ed|पंजीकृत|रजिस्टर्ड|रजिस्ट्रेशन|में\s*पंजीकृत)",
    rf"{L}registered\s+(?:with|under|by)\s+sebi{R}",
    rf"{L}sebi\s+(?:me|mein|se)\s+(?:registered|regd){R}",
    rf"{L}(?:sebi|सेबी)\s*(?:approved|certified|verified|authori[sz]ed|अनुमोदित|प्रमाणित)\s*(?:research\s*analyst|investment\s*advis[eo]r|advis[eo]r|analyst|ra|ia|ria|broker|company|firm|entity|सलाहकार|विश्लेषक)",
]
CATEGORIES = {
    "RA": rf"{L}(?:research\s*analysts?|ra|रिसर्च\s*एनालिस्ट|अनुसंधान\s*विश्लेषक){R}",
    "IA": rf"{L}(?:investment\s*advis[eo]rs?|ria|ia|निवेश\s*सलाहकार){R}",
    "BROKER": rf"{L}(?:stock\s*brokers?|broker|trading\s*member|ब्रोकर){R}",
    "PMS": rf"{L}(?:portfolio\s*manag(?:er|ement)|pms){R}",
    "MF": rf"{L}(?:mutual\s*fund|amc|म्यूचुअल\s*फंड){R}",
}
ENDORSEMENTS = [
    rf"{L}(sebi|nse|bse|rbi|government|govt\.?|सेबी|आरबीआई|सरकार)[\s\-]*(?:approved|certified|recommended|verified|authori[sz]ed|backed|guaranteed|endorsed|अनुमोदित|प्रमाणित|मान्यता\s*प्राप्त|स्वीकृत){R}",
    rf"{L}(?:approved|certified|recommended|verified|authori[sz]ed|backed|guaranteed|endorsed)\s+by\s+(?:the\s+)?(sebi|nse|bse|rbi|government|govt){R}",
    rf"{L}(sebi|nse|bse|rbi)\s+se\s+(?:approved|certified|verified){R}",
]
OBJECTS = {
    "entity_registration": rf"^[\s\-:]*(?:research\s*analyst|investment\s*advis[eo]r|advis[eo]r|analyst|ra|ia|ria|broker|company|firm|entity|registered|सलाहकार|विश्लेषक|कंपनी){R}",
    "tip": rf"^[\s\-:]*(?:tips?|calls?|stocks?|shares?|recommendations?|टिप्स|कॉल){R}",
    "scheme": rf"^[\s\-:]*(?:schemes?|plans?|investment|products?|strateg(?:y|ies)|course|योजना|स्कीम){R}",
    "app": rf"^[\s\-:]*(?:apps?|application|platform|software|ऐप){R}",
    "group": rf"^[\s\-:]*(?:groups?|channel|community|ग्रुप){R}",
    "returns": rf"^[\s\-:]*(?:returns?|profits?|income|रिटर्न|मुनाफा){R}",
}
ACCESS = {
    "institutional_account": rf"{L}(?:institution(?:al)?\s+(?:trading\s+)?(?:accounts?|a\/c|id|quota)|संस्थागत\s+(?:खाता|अकाउंट))",
    "fpi_account": rf"{L}(?:fpi|fii|qib)\s+(?:accounts?|a\/c|quota|trading){R}",
    "pre_ipo": rf"{L}pre[\s\-]?ipo{R}",
    "ipo_allotment": rf"{L}(?:(?:guaranteed|assured|confirmed|100\s?%|pakka)\s+(?:ipo\s+)?allot(?:ment)?|ipo\s+allot(?:ment)?\s+(?:guaranteed|assured|confirmed|pakka)){R}",
    "otc": rf"{L}otc\s+(?:trades?|trading|stocks?|shares?|deals?|market){R}",
    "block_deal": rf"{L}(?:block|bulk)\s+deals?\s+(?:access|allotment|shares?|stocks?|discount){R}",
    "vip_group": rf"{L}(?:vip|premium|exclusive)\s+(?:group|membership|channel|club|plan){R}",
}
BEHAVIOUR = [
    ("APP_INSTALL", rf"{L}(?:download|install)\s+(?:the\s+|our\s+|this\s+|my\s+)?(?:app|application|apk){R}"),
    ("APP_INSTALL", rf"{L}apk\s*(?:file|download|link)?{R}"),
    ("APP_INSTALL", rf"{L}not\s+(?:available\s+)?on\s+(?:the\s+)?(?:play\s?store|google\s+play|app\s+store){R}"),
    ("APP_INSTALL", r"ऐप\s*(?:डाउनलोड|इंस्टॉल|इंस्टाल)"),
    ("URGENCY", rf"{L}(?:today\s+only|only\s+today|offer\s+only|limited\s+(?:seats?|slots?|time|period|offer|members|spots)|last\s+(?:chance|day|few\s+(?:seats?|slots?|hours?))|hurry(?:\s+up)?|act\s+(?:now|fast)|urgent(?:ly)?|offer\s+(?:ends|valid\s+till|closes)|(?:closing|ending)\s+(?:soon|today|tonight)){R}"),
    ("URGENCY", rf"{L}(?:within|in)\s+(?:the\s+next\s+)?\d{{1,3}}\s*(?:min(?:ute)?s?|hours?|hrs?){R}"),
    ("URGENCY", rf"{L}(?:aaj\s+hi|sirf\s+aaj|jaldi\s+(?:karo|karein|join)|turant){R}"),
    ("URGENCY", r"(?:आज\s*ही|सिर्फ\s*आज|जल्दी\s*करें|तुरंत|सीमित\s*(?:सीट|समय)|अंतिम\s*मौका)"),
    ("SECRECY", rf"{L}(?:don'?t|do\s+not)\s+(?:tell|share\s+(?:this\s+)?with)\s+(?:anyone|anybody|others|your\s+family){R}"),
    ("SECRECY", rf"{L}(?:keep\s+(?:it|this)\s+(?:secret|confidential|private)|confidential\s+(?:tip|call|information|info)|insider\s+(?:information|info|tip|news|trading)|operator\s+(?:call|stock|info|news)){R}"),
    ("SECRECY", r"(?:kisi\s+ko\s+(?:mat|na)\s+(?:batana|batayein|bataye)|किसी\s*को\s*(?:मत|न)\s*(?:बताना|बताएं|बताइए)|गोपनीय)"),
    ("CONTACT_SHIFT", rf"{L}join\s+(?:our\s+|my\s+|the\s+)?(?:telegram|whatsapp|vip|free)?\s*(?:group|channel|community){R}"),
    ("CONTACT_SHIFT", rf"{L}(?:message|contact|call|dm|ping|whatsapp)\s+(?:me|us)?\s*(?:on|at)\s+(?:my\s+|our\s+)?(?:personal|private)\s+(?:number|whatsapp|no\.?){R}"),
    ("CONTACT_SHIFT", r"(?:ग्रुप\s*(?:जॉइन|ज्वाइन)|group\s+join\s+(?:karo|karein|kare))"),
    ("REMOTE_ACCESS_OR_OTP", rf"{L}(?:any\s?desk|team\s?viewer|quick\s?support|rust\s?desk|airdroid){R}"),
    ("REMOTE_ACCESS_OR_OTP", rf"{L}(?:(?:share|send|tell|give)(?:\s+me|\s+us)?\s+(?:the\s+|your\s+)?otp|otp\s+(?:share|bata|batao|bhejo|send)|screen\s?shar(?:e|ing)){R}"),
    ("REMOTE_ACCESS_OR_OTP", r"ओटीपी\s*(?:शेयर|बताएं|बताइए|भेजें)"),
    ("PAY_TO_WITHDRAW", rf"{L}(?:pay|deposit|submit|clear)(?:\s+the|\s+a|\s+your)?\s+(?:tax|taxes|fee|fees|charges?|commission|gst|tds|penalty|margin)\s+(?:to|for|before)\s+(?:withdraw(?:al|ing)?|unlock(?:ing)?|releas(?:e|ing)|transfer(?:ring)?){R}"),
    ("PAY_TO_WITHDRAW", rf"{L}(?:withdrawal\s+(?:fee|fees|charges?|tax)|(?:unlock|release)\s+(?:your\s+)?(?:profits?|funds|money|account)){R}"),
    ("PAY_TO_WITHDRAW", r"(?:निकासी\s*(?:शुल्क|चार्ज)|withdraw\s+karne\s+(?:ke\s+liye|se\s+pehle))"),
    ("CRYPTO_PAYMENT", rf"{L}(?:usdt|trc[\s\-]?20|erc[\s\-]?20|bitcoin|btc|crypto\s+(?:wallet|payment|deposit)|binance\s+(?:id|pay)){R}"),
    ("PROFIT_SCREENSHOTS", rf"{L}(?:(?:see|check|look\s+at)\s+(?:our\s+|the\s+)?(?:members?'?|clients?'?|students?'?)\s+(?:profits?|earnings?|results?)|profit\s+screenshots?){R}"),
    ("ACCURACY_CLAIM", rf"{L}\d{{2,3}}(?:\.\d)?\s?%\s*(?:accuracy|accurate|success\s*rate|hit\s*rate|winning\s*rate|सटीकता){R}"),
    ("ACCURACY_CLAIM", rf"{L}(?:accuracy|success\s*rate|hit\s*rate)\s*(?:of\s*)?(?:upto\s*|up\s*to\s*)?\d{{2,3}}(?:\.\d)?\s?%"),
    ("PAYMENT_REQUEST", rf"{L}(?:pay|send|transfer|deposit)\s+(?:rs\.?|₹|inr)?\s?\d"),
    ("PAYMENT_REQUEST", rf"{L}(?:registration|joining|membership|subscription|activation)\s+(?:fee|fees|charges?|amount){R}"),
    ("PAYMENT_REQUEST", rf"{L}scan\s+(?:the\s+|this\s+)?qr{R}"),
    ("PAYMENT_REQUEST", r"(?:भुगतान\s*करें|पेमेंट\s*करें|payment\s+karo|payment\s+karein)"),
]

#: Parts of words one of which is in whatever a rule matches.
STEMS = "guarant assured fixed risk loss 100 sure double capital pakka paka nuksa paisa % percent daily day week month year annu annum saal trade roz roj hafta hafte mahin sebi nse bse rbi gov approved certified recommended verified authori backed endorsed instituti fpi fii qib ipo otc block bulk vip premium exclusive download install apk store only limited last hurry act urgent offer closing ending within in aaj jaldi turant tell share keep confidential insider operator kisi join group personal private desk viewer support airdroid otp screen pay deposit submit clear withdraw unlock release usdt trc erc bitcoin btc crypto binance profit member client student accura success hit rate send transfer fee charge amount scan p.".split()

_RATES = [(p, rf"{PERCENT}\s*(?:{GAINS})?\s*(?:{words}){R}") for p, words in PERIODS.items()] + [(p, rf"{L}(?:{words})\s*(?:{GAINS_BEFORE})?\s*(?:of\s*|upto\s*|up\s*to\s*)?{PERCENT}") for p, words in PERIODS.items()]
#: Rules in the order in which matches at one place are told: kind, what it says, whether a negation undoes it, wording.
RULES = (
    [("GUARANTEE", kind, negatable, w) for kind, negatable, w in GUARANTEES]
    + [("RETURN_RATE", period, False, w) for pair in zip(_RATES[: len(PERIODS)], _RATES[len(PERIODS) :]) for period, w in pair]
    + [("SEBI_REGISTRATION_MENTION", None, False, w) for w in MENTIONS]
    + [("ENDORSEMENT", None, True, w) for w in ENDORSEMENTS]
    + [("SPECIAL_ACCESS", kind, False, w) for kind, w in ACCESS.items()]
    + [(kind, None, False, w) for kind, w in BEHAVIOUR]
)
composed = lambda w: unicodedata.normalize("NFKC", w)
FINDER = spans.Finder(tuple(composed(w) for *_, w in RULES), "[\\p{Devanagari}]|" + "|".join(s.replace(".", r"\.") for s in STEMS))


def _java(words: str) -> str:
    return "(?iu)" + composed(words)


def first_that(text: Column, named: dict[str, str]) -> Column:
    """The first name whose wording the text has."""
    found = None
    for name, words in named.items():
        there = text.rlike(_java(words))
        found = F.when(there, name) if found is None else found.when(there, name)
    return found


def category_near(text: Column) -> Column:
    return first_that(text, CATEGORIES)


def product_context(text: Column) -> Column:
    """market, which wins over deposit, or unknown."""
    return F.coalesce(first_that(text, {"market": MARKET, "deposit": DEPOSIT}), F.lit("unknown"))


def is_negated(text: Column, start: Column, end: Column) -> Column:
    """Whether a negation stands up to 24 characters before a match, in its sentence and line, or up to 12 behind."""
    return spans.piece(text, start - 40, start).rlike(_java(NEGATORS)) | spans.piece(text, end, end + 20).rlike(_java(NEGATED_BEHIND))


def phrases(text: Column) -> Column:
    """Array of structs (kind, attr, percent, category, authority, object, start, end, quote) in the order of the text.

    attr is the kind of a promise or an offer, or the period of a rate; category, authority and object belong to
    mentions of registration and to endorsements. Promises and endorsements that are negated, and rates of zero, go.
    """
    facts = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(attr).cast("string").alias("attr"), F.lit(neg).alias("negatable")) for kind, attr, neg, _ in RULES))

    def told(x: Column) -> Column:
        return spans.let(spans.line_around(text, x["m"]["start"], x["m"]["end"]), lambda line: on_line(x["m"], x["rule"], line))

    def on_line(m: Column, rule: Column, line: Column) -> Column:
        start, end = m["start"], m["end"]
        is_ = lambda kind: rule["kind"] == kind
        who = F.lower(F.get(m["groups"], F.lit(0)))
        authority = F.when(who.startswith("se") | (who == "सेबी"), "SEBI").when(who == "nse", "NSE").when(who == "bse", "BSE").when(who.isin("rbi", "आरबीआई"), "RBI").otherwise("GOVT")
        return F.struct(
            rule["kind"].alias("kind"),
            rule["attr"].alias("attr"),
            F.when(is_("RETURN_RATE"), F.get(m["groups"], F.lit(0)).cast("double")).alias("percent"),
            F.when(is_("SEBI_REGISTRATION_MENTION"), category_near(line)).alias("category"),
            F.when(is_("ENDORSEMENT"), authority).alias("authority"),
            F.when(is_("ENDORSEMENT"), first_that(spans.piece(text, end, end + 40), OBJECTS)).alias("object"),
            start.alias("start"),
            end.alias("end"),
            line.alias("quote"),
        )

    ruled = lambda m: F.struct(m.alias("m"), F.element_at(facts, m["rule"] + 1).alias("rule"))
    holds = lambda x: ~(x["rule"]["negatable"] & is_negated(text, x["m"]["start"], x["m"]["end"]))
    return spans.let(spans.matches(text, FINDER), lambda ms: F.filter(F.transform(F.filter(F.transform(ms, ruled), holds), told), lambda p: F.coalesce(p["percent"] > 0, F.lit(True))))


#: Times of a period in a year.
PER_YEAR = {"day": 365, "week": 52, "month": 12, "year": 1}


def annual_percent(percent: Column, period: Column) -> Column:
    """A rate in percent a year; null for rates of each trade."""
    times = F.create_map(*(F.lit(x) for pair in PER_YEAR.items() for x in pair))
    return F.round(percent * times[period]).cast("long")

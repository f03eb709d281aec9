"""The world's numbering plan: which country a number's first digits stand for, and how many digits follow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Country, and the fewest and most digits after the country's code.
PLAN = {
    **{"1": ("US", 10, 10), "7": ("RU", 10, 10)},
    **{"20": ("EG", 8, 10), "27": ("ZA", 9, 9), "30": ("GR", 10, 10), "31": ("NL", 9, 9), "32": ("BE", 8, 9), "33": ("FR", 9, 9), "34": ("ES", 9, 9), "36": ("HU", 8, 9), "39": ("IT", 8, 11)},
    **{"40": ("RO", 9, 9), "41": ("CH", 9, 9), "43": ("AT", 7, 12), "44": ("GB", 9, 10), "45": ("DK", 8, 8), "46": ("SE", 7, 9), "47": ("NO", 8, 8), "48": ("PL", 9, 9), "49": ("DE", 7, 11)},
    **{"51": ("PE", 8, 9), "52": ("MX", 10, 10), "53": ("CU", 8, 8), "54": ("AR", 10, 11), "55": ("BR", 10, 11), "56": ("CL", 9, 9), "57": ("CO", 10, 10), "58": ("VE", 10, 10)},
    **{"60": ("MY", 8, 10), "61": ("AU", 9, 9), "62": ("ID", 8, 12), "63": ("PH", 8, 10), "64": ("NZ", 8, 10), "65": ("SG", 8, 8), "66": ("TH", 8, 9)},
    **{"81": ("JP", 9, 10), "82": ("KR", 8, 10), "84": ("VN", 9, 10), "86": ("CN", 10, 11)},
    **{"90": ("TR", 10, 10), "91": ("IN", 10, 10), "92": ("PK", 9, 10), "93": ("AF", 9, 9), "94": ("LK", 9, 9), "95": ("MM", 8, 10), "98": ("IR", 10, 10)},
    **{"211": ("SS", 9, 9), "212": ("MA", 9, 9), "213": ("DZ", 8, 9), "216": ("TN", 8, 8), "218": ("LY", 9, 9), "220": ("GM", 7, 7), "221": ("SN", 9, 9), "223": ("ML", 8, 8), "224": ("GN", 9, 9), "225": ("CI", 10, 10)},
    **{"226": ("BF", 8, 8), "227": ("NE", 8, 8), "228": ("TG", 8, 8), "229": ("BJ", 8, 10), "230": ("MU", 7, 8), "231": ("LR", 7, 9), "232": ("SL", 8, 8), "233": ("GH", 9, 9), "234": ("NG", 8, 10), "235": ("TD", 8, 8)},
    **{"236": ("CF", 8, 8), "237": ("CM", 9, 9), "243": ("CD", 9, 9), "244": ("AO", 9, 9), "249": ("SD", 9, 9), "250": ("RW", 9, 9), "251": ("ET", 9, 9), "252": ("SO", 7, 9), "253": ("DJ", 8, 8), "254": ("KE", 9, 9)},
    **{"255": ("TZ", 9, 9), "256": ("UG", 9, 9), "257": ("BI", 8, 8), "258": ("MZ", 8, 9), "260": ("ZM", 9, 9), "261": ("MG", 9, 9), "263": ("ZW", 9, 9), "264": ("NA", 9, 9), "265": ("MW", 7, 9), "267": ("BW", 7, 8)},
    **{"351": ("PT", 9, 9), "352": ("LU", 6, 9), "353": ("IE", 7, 9), "354": ("IS", 7, 7), "355": ("AL", 8, 9), "356": ("MT", 8, 8), "357": ("CY", 8, 8), "358": ("FI", 6, 11), "359": ("BG", 8, 9)},
    **{"370": ("LT", 8, 8), "371": ("LV", 8, 8), "372": ("EE", 7, 8), "373": ("MD", 8, 8), "374": ("AM", 8, 8), "375": ("BY", 9, 9), "380": ("UA", 9, 9), "381": ("RS", 8, 9), "382": ("ME", 8, 8), "385": ("HR", 8, 9), "386": ("SI", 8, 8), "387": ("BA", 8, 8), "389": ("MK", 8, 8)},
    **{"420": ("CZ", 9, 9), "421": ("SK", 9, 9), "502": ("GT", 8, 8), "503": ("SV", 8, 8), "504": ("HN", 8, 8), "505": ("NI", 8, 8), "506": ("CR", 8, 8), "507": ("PA", 7, 8), "509": ("HT", 8, 8), "591": ("BO", 8, 8), "593": ("EC", 8, 9), "595": ("PY", 9, 9), "598": ("UY", 8, 8)},
    **{"673": ("BN", 7, 7), "675": ("PG", 7, 8), "679": ("FJ", 7, 7), "852": ("HK", 8, 8), "853": ("MO", 8, 8), "855": ("KH", 8, 9), "856": ("LA", 8, 10), "880": ("BD", 8, 10), "886": ("TW", 8, 9)},
    **{"960": ("MV", 7, 7), "961": ("LB", 7, 8), "962": ("JO", 8, 9), "963": ("SY", 8, 9), "964": ("IQ", 8, 10), "965": ("KW", 8, 8), "966": ("SA", 8, 9), "967": ("YE", 7, 9), "968": ("OM", 8, 8), "970": ("PS", 8, 9), "971": ("AE", 8, 9), "972": ("IL", 8, 9)},
    **{"973": ("BH", 8, 8), "974": ("QA", 8, 8), "975": ("BT", 7, 8), "976": ("MN", 8, 8), "977": ("NP", 8, 10), "992": ("TJ", 9, 9), "993": ("TM", 8, 8), "994": ("AZ", 9, 9), "995": ("GE", 9, 9), "996": ("KG", 9, 9), "998": ("UZ", 9, 9)},
}
#: Of each code whose national numbers don't begin with any digit, those that they begin with.
BEGINS = {"1": "[2-9]", "91": "[1-9]", "44": "[1-9]", "49": "[1-9]", "33": "[1-9]", "61": "[1-9]", "65": "[3689]", "86": "[1-9]", "7": "[3-9]", "971": "[1-9]"}


def pattern() -> str:
    """A pattern of all digits of a number with its country's code."""
    return "|".join(rf"{code}{BEGINS.get(code, '[0-9]')}[0-9]{{{low - 1},{high - 1}}}" for code, (_, low, high) in PLAN.items())


def analyse(digits: Column) -> Column:
    """Struct (code, country, valid) of a number's digits, country's code first: codes are told by their longest prefix,
    numbers are valid if they have as many digits as the country's plan says, and begin as its numbers do."""
    each = (f"'{code}', named_struct('code', '{code}', 'country', '{country}', 'low', {low}, 'high', {high}, 'begins', '{BEGINS.get(code, '[0-9]')}')" for code, (country, low, high) in PLAN.items())
    known = F.expr(f"map({', '.join(each)})")

    def told(own: Column) -> Column:
        rest = F.length(digits) - F.length(own["code"])
        begins = F.regexp_like(digits, F.concat(F.lit("^"), own["code"], own["begins"]))
        return F.struct(own["code"].alias("code"), own["country"].alias("country"), F.coalesce(rest.between(own["low"], own["high"]) & begins, F.lit(False)).alias("valid"))

    # The plan stands in the expression once, and so does what is found in it.
    prefixes = F.transform(F.array(*map(F.lit, (3, 2, 1))), lambda n: known[F.substring(digits, F.lit(1), n)])
    own = F.get(F.filter(prefixes, lambda x: x.isNotNull()), F.lit(0))
    return F.get(F.transform(F.array(own), told), F.lit(0))

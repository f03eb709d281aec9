"""Text normalisation, names and look-alikes as columns."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from proofsieve.functions import domains
from proofsieve.session import ship

# First code points of nine blocks of digits; invisible characters; look-alikes of Latin letters.
DIGIT_BLOCKS = (0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66)
INVISIBLE = "­᠎​⁠⁡⁢⁣⁤﻿"
JOINERS = "‌‍"
LOOKALIKES = ("авеёкмнорстухіјѕԁɡոսαβεικνορτυχ", "abeekmhopctyxijsdgnuabeikvoptux")
# Words that don't tell firms apart.
LEGAL_FORMS = "private pvt pvtltd limited ltd llp opc inc co company corporation corp plc the and of m s ms mr mrs dr shri smt sri kumari proprietor prop".split()
GENERIC_WORDS = (
    "investment investments invest investing capital capitals securities security broking brokers broker stock stocks share shares financial finance finserv fin fintech services service advisory advisors advisers adviser advisor research analyst analysts wealth management managers asset assets consultancy consultants consulting analytics technologies technology tech solutions ventures group global india indian international enterprises enterprise associates partners markets market trading traders trade equity equities commodities commodity derivatives fund funds money portfolio holdings holding house hub academy institute team official desk support care help sebi registered ra ia pms"
).split()


def indic_digits_to_ascii(c: Column) -> Column:
    digits = "".join(chr(b + k) for b in DIGIT_BLOCKS for k in range(10))
    return F.translate(c, digits, "0123456789" * len(DIGIT_BLOCKS))


def fold_lookalikes(c: Column) -> Column:
    return F.translate(c, *LOOKALIKES)


def _shipped() -> None:
    ship(SparkSession.active())


def _normal(form: str):
    _shipped()

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return normal


def clean_text(c: Column) -> Column:
    """Readable text: compatibility forms composed, digits ASCII, invisible characters gone, white space in order."""
    c = F.translate(indic_digits_to_ascii(_normal("NFKC")(c)), INVISIBLE, "")
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, r"[\t\x0B\f   -   　]", " ")
    c = F.regexp_replace(F.regexp_replace(c, " {2,}", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fold_for_match(c: Column) -> Column:
    """Text for comparisons: lower case, without accents, joiners and look-alikes, single spaces."""
    c = F.regexp_replace(_normal("NFKD")(clean_text(c)), "[̀-ͯ‌‍]", "")
    return F.trim(F.regexp_replace(fold_lookalikes(F.lower(c)), r"\s+", " "))


def alnum_only(c: Column) -> Column:
    return F.regexp_replace(fold_for_match(c), r"[^\p{L}\p{N}]+", "")


def clip(c: Column, most: int) -> Column:
    c = F.regexp_replace(clean_text(c), r"\s+", " ")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 1), F.lit("…")))


def has_devanagari(c: Column) -> Column:
    return c.rlike("[\\x{0900}-\\x{097F}]")


# Devanagari letters in Latin ones.
CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलळवशषसह", "k kh g gh n ch chh j jh n t th d dh n t th d dh n p ph b bh m y r l l v sh sh s h".split()))
NUKTAS = dict(zip("कखगजडढफ", "q kh gh z r rh f".split()))
VOWELS = dict(zip("अआइईउऊऋएऐओऔऑऍ", "a a i i u u ri e ai o au o e".split()))
MATRAS = dict(zip("ािीुूृेैोौॉॅ", "a i i u u ri e ai o au o e".split()))
COMPOSED = dict(zip("\u0958\u0959\u095a\u095b\u095c\u095d\u095e\u095f", "कखगजडढफय"))


def transliterate(c: Column) -> Column:
    """Devanagari as Latin letters, to compare names: consonants have an `a` but before vowel signs, the sign that takes
    it away, and the ends of words; nasals are m before labials, else n."""
    each = lambda c, pairs: reduce(lambda a, kv: F.replace(a, F.lit(kv[0]), F.lit(kv[1])), pairs.items(), c)
    c = each(c, {k: v + "़" for k, v in COMPOSED.items()})
    letters = "".join(CONSONANTS)
    c = F.regexp_replace(c, f"([{letters}]़?)(?![़्{''.join(MATRAS)}])(?=[\u0900-\u097f])", "$1a")
    c = F.regexp_replace(F.regexp_replace(c, "[ंँ](?=[पफबभम])", "m"), "[ंँ]", "n")
    c = F.translate(each(c, {k + "़": v for k, v in NUKTAS.items()}), "ः़्", "h")
    return each(c, CONSONANTS | VOWELS | MATRAS)


def name_to_latin(c: Column) -> Column:
    return F.when(has_devanagari(c), transliterate(c)).otherwise(c)


def name_tokens(c: Column) -> Column:
    """Struct of a name's distinctive and generic words, each once, in their order."""
    folded = F.regexp_replace(fold_for_match(name_to_latin(c)), "&", " and ")
    words = F.array_distinct(F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(LEGAL_FORMS)))
    told = lambda ws: F.struct(F.filter(ws, lambda w: ~w.isin(GENERIC_WORDS)).alias("distinctive"), F.filter(ws, lambda w: w.isin(GENERIC_WORDS)).alias("generic"))
    return F.get(F.transform(F.array(words), told), F.lit(0))  # words are read once for both


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with a boost for up to four equal first characters, at any similarity."""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    matched = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                matched.append(x)
                break
    m = len(matched)
    if not m:
        return 0.0
    other = [y for y, f in zip(b, free) if not f]
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(matched, other)) / 2) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def covered(words: Column, by: Column) -> Column:
    """How many of the words have an equivalent in the other list: equal, or alike from four letters on."""
    _shipped()

    @F.pandas_udf("int")
    def counted(words: pd.Series, by: pd.Series) -> pd.Series:
        alike = lambda t, u: t == u or (min(len(t), len(u)) >= 4 and jaro_winkler(t, u) >= 0.92)
        none = lambda x: () if x is None else x
        return pd.Series([sum(any(alike(t, u) for u in none(b)) for t in none(a)) for a, b in zip(words, by)], dtype="int32")

    return counted(words, by)


def compare_tokens(claimed: Column, official: Column) -> Column:
    """same, similar, different or inconclusive, of two structs of name_tokens()."""
    mine, theirs = claimed["distinctive"], official["distinctive"]
    forth, back = covered(mine, theirs), covered(theirs, mine)
    shared = F.size(F.array_intersect(claimed["generic"], official["generic"])) > 0
    generic = (F.size(claimed["generic"]) > 0) & (F.size(official["generic"]) > 0)
    full = (forth == F.size(mine)) & (back == F.size(theirs))
    return (
        F.when((F.size(mine) == 0) | (F.size(theirs) == 0), "inconclusive")
        .when(forth == 0, "different")
        .when(full & ~(generic & ~shared), "same")
        .when(full, "similar")
        .when((forth == F.size(mine)) & (F.size(mine) >= 2), "same")
        .otherwise("similar")
    )


def domain_skeleton(label: Column) -> Column:
    c = F.translate(fold_lookalikes(F.lower(label)), "0134578", "oleastb")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "rn", "m"), "vv", "w"), "[^a-z]", "")


def imitates(c: Column, o: Column) -> Column:
    """Whether the label of a domain is like that of an official one, of four letters or more."""
    parts = F.split(F.regexp_replace(c, r"(?<=[^0-9])(?=[0-9])|(?<=[0-9])(?=[^0-9])", "-"), r"[-_.]")
    skeletons = domain_skeleton(c), domain_skeleton(o)
    alike = (c == o) | (skeletons[0] == skeletons[1]) | ((F.length(o) >= 5) & (F.levenshtein(c, o) <= 2)) | F.array_contains(parts, o) | ((F.length(o) >= 5) & F.contains(skeletons[0], skeletons[1]))
    return (F.length(o) >= 4) & alike


def is_lookalike(candidate: Column, official: Column) -> Column:
    """Whether one registrable domain imitates the other, by their labels before the public suffix."""
    label = lambda d: domains.domain_parts(d)["label"]
    return F.coalesce((candidate != official) & imitates(label(candidate), label(official)), F.lit(False))


def redact_number(text: Column, digits: Column, mark: str = "[your number]") -> Column:
    """Replaces a number in any writing by the mark: its last ten digits, where there are eight or more."""
    own = F.right(F.regexp_replace(digits, r"\D", ""), F.lit(10))
    pattern = F.concat(F.lit(r"(?:\+?[0-9]{1,3}[ -]?)?"), F.array_join(F.filter(F.split(own, ""), lambda d: d != ""), "[ -]?"))
    return F.when(F.length(own) >= 8, F.regexp_replace(text, pattern, F.lit(mark))).otherwise(text)


def sanitise_value(c: Column, most: int = 200) -> Column:
    c = F.regexp_replace(c, "[\\x00-\\x1f\\x7f‎‏‪-‮⁦-⁩]", " ")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, "[*_~`]", ""), " {2,}", " ")), 1, most)


def strip_reasoning(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""), r"(?is)^.*?</think>", ""))


def indian_number(n: Column) -> Column:
    """Whole numbers with groups of two digits above the thousands."""
    digits = F.abs(n).cast("string")
    head = F.regexp_replace(F.substring(digits, F.lit(1), F.length(digits) - 3), r"(?<=[0-9])(?=(?:[0-9]{2})+$)", ",")
    return F.concat(F.when(n < 0, "-").otherwise(""), F.when(F.length(digits) <= 3, digits).otherwise(F.concat(head, F.lit(","), F.right(digits, F.lit(3)))))


def sha256_base64url(c: Column) -> Column:
    return F.translate(F.base64(F.unhex(F.sha2(c, 256))), "+/=", "-_")


def fill_template(template: Column, params: Column) -> Column:
    """Puts params (map of strings) into {names}; what has no value becomes empty, and brackets that it emptied go."""
    filled = F.aggregate(F.map_entries(params), template, lambda s, e: F.replace(s, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(filled, r"\{\w+\}", ""), r" ?\( *\)", ""), " {2,}", " "))

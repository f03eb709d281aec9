from pyspark.sql import functions as F

from proofsieve.functions import text


def values(spark, f, *rows):
    width = len(rows[0]) if isinstance(rows[0], tuple) else 1
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    df = spark.createDataFrame(rows, ", ".join(f"c{k} string" for k in range(width)))
    return [r.v for r in df.select(f(*(F.col(f"c{k}") for k in range(width))).alias("v")).collect()]


def test_normalisation(spark):
    assert values(spark, text.clean_text, "INH​००००११४३१", "a  b", "x\r\n\n\n\ny ", "ﬁ", None, "") == ["INH000011431", "a b", "x\n\ny", "fi", None, ""]
    assert values(spark, text.fold_for_match, "Zеrodha", "Élan  VITAL", None) == ["zerodha", "elan vital", None]
    assert values(spark, lambda c: text.clip(c, 5), "abcdef", "abcde") == ["abcd…", "abcde"]
    assert values(spark, text.has_devanagari, "राम", "ram") == [True, False]
    assert values(spark, text.alnum_only, "A-b c.1") == ["abc1"]
    assert values(spark, text.strip_reasoning, "<think>x</think> y", "z</think>w", "v") == ["y", "w", "v"]
    assert values(spark, text.sanitise_value, "*a*\x07 _b_  c") == ["a b c"]


def test_names(spark):
    assert round(text.jaro_winkler("martha", "marhta"), 3) == 0.961 and text.jaro_winkler("ab", "xy") == 0.0
    same = lambda a, b: text.compare_tokens(text.name_tokens(a), text.name_tokens(b))
    got = values(spark, same, ("Zenith Research", "Zenith Research Pvt Ltd"), ("Zenith Research", "Zenith Capital"), ("Alpha Omega", "Alpha Omega Beta"), ("Alpha", "Alpha Beta"), ("Alpha", "Gamma"), ("Research Ltd", "Alpha"), ("Zerodhaa", "Zerodha"))
    assert got == ["same", "similar", "same", "similar", "different", "inconclusive", "same"]


def test_domains_and_numbers(spark):
    got = values(spark, text.is_lookalike, ("zer0dha.com", "zerodha.com"), ("zerodha.com", "zerodha.com"), ("zerodha-support.com", "zerodha.com"), ("vvisdom.in", "wisdom.in"), ("example.com", "zerodha.com"), ("abc.in", "abd.in"))
    assert got == [True, False, True, True, False, False]
    assert values(spark, lambda c: text.indian_number(c.cast("long")), "1234567", "999", "1000", "-123456789", "0") == ["12,34,567", "999", "1,000", "-12,34,56,789", "0"]
    got = values(spark, text.redact_number, ("call +91 98765-43210 now", "919876543210"), ("9876543210 98765 43210", "+91 98765 43210"), ("12345", "12345"))
    assert got == ["call [your number] now", "[your number] [your number]", "12345"]
    assert values(spark, text.sha256_base64url, "abc") == ["ungWv48Bz-pBQUDeXa4iI7ADYaOWF3qctBD_YfIAFa0"]


def test_devanagari_names(spark):
    assert values(spark, text.transliterate, "शर्मा", "राम", "संजय", "ज़फ़र ज़", "कंपनी अं", "दुःख", "abc", None) == ["sharma", "ram", "sanjay", "zafar z", "kampani an", "duhkh", "abc", None]
    same = lambda a, b: text.compare_tokens(text.name_tokens(a), text.name_tokens(b))
    assert values(spark, same, ("राहुल शर्मा", "RAHUL KUMAR SHARMA"), ("Zerodha", "ZERODHA BROKING LIMITED"), ("Groww", "GROWW INVEST TECH PRIVATE LIMITED"), ("Sharma", "RAHUL KUMAR SHARMA"), ("Research Desk", "ABC RESEARCH PRIVATE LIMITED")) == ["same", "same", "same", "similar", "inconclusive"]

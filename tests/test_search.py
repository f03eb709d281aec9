"""Names, numbers and wording, each against a plain definition."""

import itertools
import random
import time

import regex
from pyspark.sql import functions as F

from proofsieve.functions import identifiers, numbering, phrases, spans
from proofsieve.operators import registry


def trigrams(text):
    return [w[i : i + 3] for word in regex.findall(r"[\p{L}\p{N}]+", text) for w in [f"  {word} "] for i in range(len(w) - 2)]


def brute_similarity(query, name):
    """The greatest share over all contiguous extents."""
    a, b = set(trigrams(query)), trigrams(name)
    extents = [set(b[i:k]) for i, k in itertools.combinations(range(len(b) + 1), 2)]
    return max((len(a & x) / len(a | x) for x in extents), default=0.0) if a else 0.0


def test_word_similarity_is_the_best_of_all_extents():
    assert registry.extent_similarity(trigrams("word"), trigrams("two words")) == 0.8
    rng = random.Random(1)
    syllables = ["ba", "na", "ab", "an", "xy", "b", "a ", " n"]
    for _ in range(1500):
        q, n = ("".join(rng.choice(syllables) for _ in range(rng.randrange(0, k))) for k in (6, 14))
        assert abs(registry.extent_similarity(trigrams(q), trigrams(n)) - brute_similarity(q, n)) < 1e-12


def test_similarity_is_exact_from_a_floor_on():
    rng = random.Random(4)
    syllables = ["ba", "na", "ab", "a ", "000", "12", "b", " n"]
    for _ in range(1500):
        q, n = (registry.ordered_trigrams("".join(rng.choice(syllables) for _ in range(rng.randrange(1, k)))) for k in (7, 14))
        exact, floor = registry.extent_similarity(q, n), rng.random()
        assert not q or registry.extent_similarity(q, n, exact) == exact
        told = registry.extent_similarity(q, n, floor)
        assert told == exact if exact >= floor else told < floor


def test_names_that_share_all_but_digits_are_held_against_few(spark, monkeypatch):
    register = spark.range(20_000).select(F.format_string("N%06d", "id").alias("registration_no"), F.format_string("Supplier#%09d", "id").alias("name"))
    asked, seen = spark.range(300).select(F.format_string("Suplier#%09d", F.col("id") * 61 + 1000).alias("query")), spark.sparkContext.accumulator(0)
    counting = F.udf(lambda x: (seen.add(1), x)[1], "double").asNondeterministic()
    for kind in ("word_similarity", "similarity_from"):
        monkeypatch.setattr(registry, kind, lambda *own, rated=getattr(registry, kind): counting(rated(*own)))
    found = registry.search_names(asked, register).collect()
    assert len(found) == 1500 and seen.value < 300 * 400  # of 20,000
    for n in (1000, 9357, 18202):
        query = f"suplier#{n:09d}"
        every = sorted((-registry.extent_similarity(registry.ordered_trigrams(query), registry.ordered_trigrams(f"supplier#{k:09d}")), f"N{k:06d}") for k in range(20_000))
        assert [(-r.similarity, r.registration_no) for r in sorted(found, key=lambda r: r.place) if r.query.lower() == query] == every[:5]


def test_search_finds_what_each_pair_says(spark):
    rng = random.Random(2)
    parts = ["sharma", "sharm", "wealth", "weal", "alpha", "alph", "one", "on", "capital", "cap", "x"]
    names = {f"N{k:03}": " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for k in range(120)}
    names |= {"N900": "Sharma Wealth", "N901": "xsharma wealthy"}
    queries = sorted({" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(40)} | {"शर्मा", "ab", "sharma wealth"})
    found = registry.search_names(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame([*names.items()], "registration_no string, name string"), top=1000)
    got = {}
    for r in found.collect():
        got.setdefault(r.query, []).append((r.place, r.registration_no, round(r.similarity, 12)))
    for q in queries:
        latin = "sharma" if q == "शर्मा" else q
        pairs = [(-brute_similarity(latin, n.lower()), no) for no, n in names.items() if len(latin) >= 3 and (brute_similarity(latin, n.lower()) >= 0.6 or latin in n.lower())]
        assert sorted(got.get(q, [])) == [(k, no, round(-s, 12)) for k, (s, no) in enumerate(sorted(pairs), 1)], q
    assert "शर्मा" in got and "ab" not in got


def test_matches_may_be_of_any_length():
    for blanks in (10, 500, 5000):
        text = "x " * 1000 + "fixed" + " " * blanks + "returns and https://a.com/" + "y" * blanks + " end"
        kinds = [m for m in phrases.FINDER(text) if text[m["start"] : m["end"]].startswith("fixed")]
        assert kinds and kinds[0]["end"] - kinds[0]["start"] == len("fixedreturns") + blanks
        url = next(m for m in identifiers.URL_FINDER(text) if m["rule"] == 0)
        assert text[url["start"] : url["end"]].endswith("y" * blanks)


def test_triggers_miss_nothing():
    rng = random.Random(3)
    words = ["guaranteed", "fixed", "  ", "\n", "returns", "risk", "free", "no", "loss", "10%", "daily", "SEBI", "registered", "INH", "000", "123", "456789", "+44", "98765", "43210", "x@ybl", "a/c", "no.", "@", "telegram", "www.", "a.co", "http://", "Capital", "Ltd", "Support", "pay", "गारंटी", "सेबी", "IN/AIF1", "/22-23/", "ARN-", "MF/", "012", "/", "100%", "sure", "shot", "otp", "urgent"]
    finders = [phrases.FINDER, identifiers.NUMBER_FINDER, identifiers.PHONE_FINDER, identifiers.OTHER_FINDER, identifiers.URL_FINDER, identifiers.NAME_FINDER]
    hits = 0
    for _ in range(1500):
        text = "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(12)))
        for f in finders:
            want = [(m.start(), k) for k, p in enumerate(f.patterns) for m in regex.finditer(p, text, f.flags)]
            assert sorted((m["start"], m["rule"]) for m in f(text)) == sorted(want)
            hits += len(want)
    assert hits > 200


def test_loosened_patterns_miss_nothing():
    rng = random.Random(4)
    words = ["guaranteed", "ſure", "ſhot", "rısk", "free", "RİSK", "tic\u212aet", "fixed", "\u2003", "\x1f", "\x85", "returns", "no", "loss", "१०%", "daily", "SEBI", "registered", "INH", "000", "123456", "+44", "98765", "43210", "x@ybl", "a/c", "@", "telegram", "www.", "a.co", "http://", "Capital", "Ltd", "गारंटी", "MF/", "ARN-", "don't", "tell", "otp", "share", "VIP", "group"]
    finders = [phrases.FINDER, identifiers.NUMBER_FINDER, identifiers.PHONE_FINDER, identifiers.OTHER_FINDER, identifiers.URL_FINDER, identifiers.NAME_FINDER]
    texts = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(12))) for _ in range(1500)] + [None, "", "é"]
    hits = 0
    for f in finders:
        told = f.of_all(texts)
        hits += sum(map(len, filter(None, told)))
        assert told[-3:] == [None, [], []]
        for text, own in zip(texts[:-3], told):
            want = [(m.start(), k, m.end()) for k, p in enumerate(f.patterns) for m in regex.finditer(p, text, f.flags)]
            assert [(m["start"], m["rule"], m["end"]) for m in own] == sorted(want)
    assert hits > 200


def test_many_words_are_told_apart_in_little_time():
    text = "".join(f"w{k}x{k % 977} é{k}-y. " for k in range(40_000))
    began = time.process_time()
    assert spans.place_of("w39999x919", text) is not None and spans.locate("w39999x919 é39999-y", text) is not None
    assert time.process_time() - began < 6  # 18.7 s before, 1.2 s now
    slow = [(spans.folded(m[0]).rstrip("._-/:"), m.start(), m.end()) for m in spans.TOKEN.finditer(text[:5000])]
    assert spans.tokens(text[:5000]) == tuple((w, spans.bare(w), a, b) for w, a, b in slow if w)


def test_numbers_of_all_countries(spark):
    texts = {
        "Call +44 7911 123456": ("+447911123456", "GB"),
        "+1 (212) 555-0187": ("+12125550187", "US"),
        "tel. +971-50-123-4567": ("+971501234567", "AE"),
        "+880 1711-123456": ("+8801711123456", "BD"),
        "office 022 2400 1234": ("+912224001234", "IN"),
        "(011) 2345 6789": None,
        "+91 22 4000 1234": ("+912240001234", "IN"),
        "98765 43210": ("+919876543210", "IN"),
        "+999 12345678": None,
        "+44 12": None,
        "+65 1234 5678": None,
        "+91 0123456789": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: [(p.e164, p.country) for p in r.p] for r in df.select("t", identifiers.phones(F.col("t")).alias("p")).collect()}
    for t, want in texts.items():
        if want:
            assert got[t] == [want], t
    assert got["+999 12345678"] == got["+44 12"] == got["+65 1234 5678"] == got["+91 0123456789"] == []
    assert got["(011) 2345 6789"] in ([("+911123456789", "IN")], [])
    digits = spark.createDataFrame([(c + "2" + "3" * (low - 1), country) for c, (country, low, _) in numbering.PLAN.items() if c not in numbering.BEGINS], "d string, want string")
    assert digits.select((numbering.analyse(F.col("d"))["country"] == F.col("want")).alias("ok"), numbering.analyse(F.col("d"))["valid"].alias("v")).where("NOT ok OR NOT v").count() == 0
    assert all(bool(regex.fullmatch(numbering.pattern(), r.d)) for r in digits.collect())


def test_quotes_align_as_read_by_hand():
    text = "Alpha One sells tips.\nPay to alpha-one@ybl now, and be quick about it"
    assert spans.locate("alpha one sells tips", text) == (0, 21)
    assert spans.locate("pay to now and be quick", text) is not None and spans.locate("pay nobody at all", text) is None
    assert text[slice(*spans.locate("sellstips", text))] == "sells tips."
    assert spans.locate("", text) is None and spans.locate("alpha", None) is None


def test_lines_have_their_places(spark):
    for t in ("", "a", "a\n", "\n\nbc\nd", "é\n漢字"):
        rows = spans.lines_of(t)
        assert [r["text"] for r in rows] == t.split("\n") and all(t[r["start"] : r["end"]] == r["text"] for r in rows)


def test_texts_are_read_from_the_first_place_a_rule_may_match():
    rng = random.Random(6)
    words = ["é", "भारत ", "\u212a", "x y ", "\n", "12 ", "98765 43210", "INH000001234 ", "a/c no. 123456789 ", "pay@ybl ", "१०% daily ", "keep this secret ", "\u212aeep it private ", "गारंटी ", "www.a.co "]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(400)]
    for f in (phrases.FINDER, identifiers.NUMBER_FINDER, identifiers.PHONE_FINDER, identifiers.OTHER_FINDER, identifiers.URL_FINDER):
        assert f.of_all(texts) == [f(t) for t in texts]
    long = "é 1 " * 500_000 + "call 98765 43210"
    before = time.perf_counter()
    want = identifiers.PHONE_FINDER(long)
    plain = time.perf_counter() - before
    before = time.perf_counter()
    assert identifiers.PHONE_FINDER.of_all([long]) == [want] and len(want) == 1
    assert time.perf_counter() - before < plain / 2


def test_quotes_are_looked_for_around_their_rarest_word():
    text = "some words that stand before it. " * 20_000 + "\nSupplier#000000123 holds INZ000000123, as it says.\n" + "others follow here " * 20_000
    spans.tokens.cache_clear()
    at = text.index("Supplier")
    assert spans.locate("Supplier#000000123", text) == (at, at + len("Supplier#000000123"))
    assert spans.tokens.cache_info().misses and all(len(t) < 4000 for t in _remembered_by(text))


def _remembered_by(text):
    """Stretches of a text that hold its only quote and were read for it."""
    seen, plain = [], spans.tokens.__wrapped__
    spans.tokens.cache_clear()
    try:
        original, spans.tokens = spans.tokens, lambda t: seen.append(t) or plain(t)
        spans.locate("Supplier#000000123", text)
    finally:
        spans.tokens = original
    return seen

import random

import pytest
from pyspark.sql import functions as F

from proofsieve.functions import domains, identifiers, phrases, spans, text


def values(spark, f, *rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r.v for r in df.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


def test_registration_numbers(spark):
    three = lambda c: F.transform(identifiers.registration_numbers(c), lambda x: F.concat_ws(" ", x["normalized"], x["scheme"], x["format_valid"].cast("string"), x["reinterpreted"].cast("string")))
    got = values(
        spark,
        three,
        "SEBI Regd RA: INH000011431. Also IA INA 000 012 345 and broker INZ000031633",
        "Reg No INH0000I1431",
        "Reg No 1NH000011431",
        "SEBI RA No. INH0001143112",
        "Invest INR 500000000 today",
        "Call IND 9876543210 now",
        "Registrar INR000003761",
        "INB011326437, IN-DP-NSDL-123-2015, IN-DP-456-2016, MF/001/93/0, ARN-155, INBI00000012",
        "Reg No: INH000011431\n10:02",
        "Reg No: INH 000 011 431 10:02",
        "Reg No: INH00001143110",
        "AIF IN / AIF3 / 20-21 / 0811, twice INH000011431 INH000011431",
        None,
    )
    assert got == [
        ["INH000011431 SEBI_RA true false", "INA000012345 SEBI_IA true false", "INZ000031633 SEBI_BROKER true false"],
        ["INH000011431 SEBI_RA true true"],
        ["INH000011431 SEBI_RA true true"],
        ["INH0001143112 SEBI_RA false false"],
        [],
        [],
        ["INR000003761 SEBI_RTA true false"],
        ["INB011326437 SEBI_BROKER true false", "IN-DP-NSDL-123-2015 SEBI_DP true false", "IN-DP-456-2016 SEBI_DP true false", "MF/001/93/0 SEBI_MF true false", "ARN-155 AMFI_ARN true false"],
        ["INH000011431 SEBI_RA true false"],
        ["INH000011431 SEBI_RA true false"],
        ["INH00001143110 SEBI_RA false false"],
        ["IN/AIF3/20-21/0811 SEBI_AIF true false", "INH000011431 SEBI_RA true false"],
        None,
    ]
    t = "x INH 000 011 431 10:02"
    (found,) = values(spark, identifiers.registration_numbers, t)[0]
    assert t[found.start : found.end] == found.raw == "INH 000 011 431"
    v = values(spark, identifiers.confusable_variants, "INH000011431", "INH00", "INHx", "INH999999999")
    assert v[0][:4] == ["INH800011431", "INH600011431", "INH900011431", "INH080011431"] and len(v[0]) == 12 and len(v[1]) == 6 and v[2] == [] and len(v[3]) == 12
    assert values(spark, lambda c: identifiers.shape_of(identifiers.scheme_of(c)["scheme"]), "INH1", "XX", "MF/001/93/0") == ["INH + 9 digits", None, "MF/xxx/yy/z"]


def test_phones_handles_and_addresses(spark):
    e164 = lambda c: identifiers.phones(c)["e164"]
    assert values(spark, e164, "WhatsApp +91 98765 43210 or call +44 7911 123456", "A/c No: 9876543210", "Pay to UPI: 9876501234@ybl", "mail 9876501234@gmail.com", "Call 9876501234 or pay 9123456780@ybl") == [["+919876543210", "+447911123456"], [], [], [], ["+919876501234"]]
    upi = lambda c: F.transform(identifiers.upi_ids(c), lambda u: F.concat_ws(" ", u["value"], u["category_suffix"], u["mobile_based"].cast("string")))
    assert values(spark, upi, "Pay to 9876543210@ybl or abc.brk@validhdfc", "mail compliance@abcresearch.in for details", "contact rahul@unknownbank", "UPI: rahul@unknownbank") == [["9876543210@ybl true", "abc.brk@validhdfc brk false"], [], [], ["rahul@unknownbank false"]]
    mail = lambda c: F.transform(identifiers.emails(c), lambda e: F.concat_ws(" ", e["domain"], e["free_mail"].cast("string")))
    assert values(spark, mail, "Write to support@abcresearch.in or abc.research.desk@gmail.com") == [["abcresearch.in false", "gmail.com true"]]
    bank = lambda c: F.transform(identifiers.bank_accounts(c), lambda b: F.concat_ws(" ", b["masked"], b["ifsc"]))
    assert values(spark, bank, "A/c No: 123456789012 IFSC: HDFC0001234", "account 12") == [["XXXX9012 HDFC0001234"], []]
    handle = lambda c: identifiers.handles(c)["value"]
    assert values(spark, handle, "Telegram: @SharmaVIPcalls", "Join @SharmaVIPcalls on Telegram", "टेलीग्राम पर जुड़ें @SharmaVIPcalls", "Write to help@telegramtips.in", "mortgage rates by @someone_x") == [["@sharmavipcalls"]] * 3 + [[], []]


def test_urls(spark):
    rows = ["Login at https://zerodha-kite.top/login and www.abcresearch.in. Short: bit.ly/x1", "Rs.500 per month, e.g. No.1 advisor", "Join our VIP group:\nt.me/+SharmaVIPcalls", "reply to t.me or call", "http://10.0.0.1/a.apk 10.0.0.2 https://play.google.com/store/apps/details?id=com.z.k3", "see https://x.nosuchsuffix/ and HTTPS://WWW.Example.co.uk/A https://www.example.co.uk/A"]
    df = spark.createDataFrame([*enumerate(rows)], "i int, text string")
    got = {}
    for r in identifiers.urls(df).orderBy("i", "start").collect():
        got.setdefault(r.i, []).append((r.raw, r.domain, r.shortener, r.apk, r.invite or r.app_store_id))
        assert rows[r.i][r.start : r.end] == r.raw
    assert got[0] == [("https://zerodha-kite.top/login", "zerodha-kite.top", False, False, None), ("www.abcresearch.in", "abcresearch.in", False, False, None), ("bit.ly/x1", "bit.ly", True, False, None)]
    assert 1 not in got and got[2] == [("t.me/+SharmaVIPcalls", "t.me", False, False, "telegram")] and 3 not in got
    assert got[4] == [("http://10.0.0.1/a.apk", None, False, True, None), ("https://play.google.com/store/apps/details?id=com.z.k3", "google.com", False, False, "com.z.k3")]
    assert got[5] == [("HTTPS://WWW.Example.co.uk/A", "example.co.uk", False, False, None)]
    assert values(spark, domains.registrable_domain, "kite.zerodha.com", "a.b.co.in", "co.in", "1.2.3.4", "foo.ck", "www.ck", "x.y.unknown", None, "") == ["zerodha.com", "b.co.in", None, None, None, "www.ck", "y.unknown", None, None]


def test_business_names(spark):
    name = lambda c: identifiers.business_names(c)["name"]
    assert values(spark, name, "Sharma Investments\nSEBI Registered", "360 ONE Distribution Services Limited\nSEBI RA", "Zerodha Support: your account is blocked", "Join our VIP group today. Pay now.") == [["Sharma Investments"], ["360 ONE Distribution Services Limited"], ["Zerodha"], []]


def kinds(spark, *rows):
    df = spark.createDataFrame([*enumerate(rows)], "i int, c string").select("i", text.clean_text(F.col("c")).alias("c"))
    return [r.v for r in df.select("i", phrases.phrases(F.col("c"))["kind"].alias("v")).orderBy("i").collect()]


def test_phrases(spark):
    got = kinds(spark, "Guaranteed 30% monthly returns", "पक्का मुनाफा, कोई नुकसान नहीं", "loss nahi hoga, pakka profit", "Investments are subject to market risks. Returns are not guaranteed.", "There is no guarantee of returns.", "Open an institutional trading account for pre-IPO allotment. Offer valid today only! Join our VIP group. Share OTP to activate.", "आज ही जुड़ें, सीमित सीट", "रोज़ 5% पक्का मुनाफ़ा", "रोज़ 5% पक्का मुनाफ़ा")
    assert all("GUARANTEE" in k for k in got[:3]) and not any("GUARANTEE" in k for k in got[3:5])
    assert {"SPECIAL_ACCESS", "URGENCY", "REMOTE_ACCESS_OR_OTP"} <= {*got[5]} and "URGENCY" in got[6]
    assert all({"GUARANTEE", "RETURN_RATE"} <= {*k} for k in got[7:])
    told = values(spark, phrases.phrases, "Earn 5% daily profit in F&O", "रोज़ 3% रिटर्न", "SEBI Registered Research Analyst", "SEBI approved tips daily", "SEBI approved advisor", "0% a day", "not approved by SEBI")
    one = lambda k, kind: next(p for p in told[k] if p.kind == kind)
    assert (one(0, "RETURN_RATE").percent, one(0, "RETURN_RATE").attr) == (5, "day") == (one(0, "RETURN_RATE").percent, "day")
    assert (one(1, "RETURN_RATE").percent, one(1, "RETURN_RATE").attr) == (3, "day") and one(2, "SEBI_REGISTRATION_MENTION").category == "RA"
    assert (one(3, "ENDORSEMENT").authority, one(3, "ENDORSEMENT").object, one(4, "ENDORSEMENT").object) == ("SEBI", "tip", "entity_registration") and told[5] == [] == told[6]
    assert values(spark, phrases.product_context, "Bank FD at 7.1% p.a.", "Intraday options calls", "Hello there") == ["deposit", "market", "unknown"]


@pytest.mark.parametrize("finder", [phrases.FINDER, identifiers.NUMBER_FINDER, identifiers.PHONE_FINDER, identifiers.OTHER_FINDER, identifiers.URL_FINDER, identifiers.NAME_FINDER])
def test_windows_lose_no_match(finder):
    rng = random.Random(1)
    pieces = ["Guaranteed 30% monthly returns", "loss nahi hoga", "SEBI registered", "INH000011431", "a@b.com", "pay@ybl", "t.me/x", "A/c 1234567890", "+91 98765 43210", "Alpha Capital Ltd", "word " * 300, "x" * 700, "आज ही", "ARN-1", "MF/001/93/0", "www.x.in", "Zen Team", "HDFC0001234", "telegram @abcdef", "100 % sure", "no risk", "\n"]
    for _ in range(60):
        t = " ".join(rng.choices(pieces, k=8))
        whole = sorted({(m.start(), k, m.end()) for k, p in enumerate(finder.patterns) for m in spans.regex.finditer(p, t, finder.flags)})
        assert [(x["start"], x["rule"], x["end"]) for x in finder(t)] == whole


def test_lines_and_quotes(spark):
    df = spark.createDataFrame([("ab\n  cde \nf", 7, 8)], "t string, a int, b int")
    r = df.select(spans.line_of(F.col("t"), F.col("a")).alias("n"), spans.line_text(F.col("t"), F.col("a")).alias("x"), spans.line_around(F.col("t"), F.col("a"), F.col("b")).alias("y"), spans.lines(F.col("t")).alias("all")).first()
    assert (r.n, r.x, r.y) == (1, "cde", "cde") and [(x.line, x.start, x.end) for x in r["all"]] == [(0, 0, 2), (1, 3, 9), (2, 10, 11)]
    long = "w " * 200 + "MATCH" + " v" * 200
    got = spark.createDataFrame([(long,)], "t string").select(spans.line_around(F.col("t"), F.lit(400), F.lit(405)).alias("x")).first().x
    assert len(got) <= 220 and 80 < got.index("MATCH") < 130
    for quote, t, want in [("Guaranteed returns daily", "We offer guaranteed  returns, daily!", "guaranteed  returns, daily"), ("INH000011431", "Reg INH 000 011 431 ok", "INH 000 011 431"), ("never said this at all", "We offer guaranteed returns", None), ("", "x", None), ("one two three four five six seven", "one two thre four five six seven", "one two thre four five six seven"), ("a b", "b", None)]:
        place = spans.locate(quote, t)
        assert (place and t[place[0] : place[1]]) == want
    assert spans.place_of("98-76", "call 9 8.7(6)") == (5, 12) and spans.place_of("xx", "x") is None
    segs = spark.createDataFrame([([(0, "none here", "nonehere"), (1, "Reg INH 000 011 431", "reginh000011431")],)], "s array<struct<seq int, text string, alnum string>>")
    r = segs.select(spans.locate_quote(F.lit("INH000011431"), F.col("s")).alias("q"), spans.identifier_occurs(F.lit("inh-000011431"), F.col("s")).alias("o"), spans.identifier_occurs(F.lit("inx"), F.col("s")).alias("p"), spans.locate_identifier(F.lit("000011"), F.col("s")).alias("i"), spans.locate_quote(F.lit("absent"), F.col("s")).alias("z")).first()
    assert tuple(r.q) == (1, 4, 19) and r.o and not r.p and tuple(r.i) == (1, 8, 15) and r.z is None


def test_tiles_and_json(spark):
    tiles = spark.createDataFrame([(["A\nB\nC", "C\nD", None, "D\nE"],)], "t array<string>")
    assert tiles.select(spans.merge_tiles(F.col("t"))).first()[0] == "A\nB\nC\nD\nE"
    assert values(spark, spans.extract_json, '```json\n{"a": "}"} x {"b": 1}', "none", '{"a": {', "{a}", None) == ['{"a": "}"}', None, None, None, None]


def test_entities_of_several_segments(spark):
    rows = [(1, 0, "INH0000I1431 and 9876543210, see www.xy.in/a", "image", "good", ["xy.in"]), (1, 1, "INH000011431\nme@xy.in A/c no 123456789", "text", "good", None), (2, 0, "INH000011431", "audio", "good", None)]
    got = {(r.msg_id, r.entity_id): r for r in identifiers.entities(spark.createDataFrame(rows, "msg_id int, seq int, text string, origin string, quality string, unclear array<string>")).collect()}
    assert {k for k in got} == {(1, "reg-1"), (1, "phone-1"), (1, "url-1"), (1, "email-1"), (1, "bank-1"), (2, "reg-1")}
    assert [tuple(s) for s in got[1, "reg-1"].spans] == [(0, 0, 12), (1, 0, 12)] and got[1, "reg-1"].legibility == "clear" and got[2, "reg-1"].legibility == "uncertain"
    assert got[1, "url-1"].attrs["domain"] == "xy.in" and got[1, "email-1"].attrs["free_mail"] == "false" and got[1, "phone-1"].legibility == "clear"
    df = spark.createDataFrame([(1, "reg", "a"), (1, "reg", "b")], "msg_id int, kind string, key string")
    assert [r.key for r in identifiers.disagreements(df, df.where("key = 'a'")).collect()] == ["b"]

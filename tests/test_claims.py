import json

import pytest

from proofsieve.operators import claims

SCAM = """Sharma Investments
SEBI Registered Research Analyst
Reg No: INH000099991
Join our premium group for 100% sure shot calls.
Guaranteed 30% monthly returns in F&O!
Pay Rs 4,999 joining fee to UPI: 9876501234@ybl
Website: www.sharma-investments.co.in
Offer valid today only!"""

MESSAGES = {
    1: SCAM,
    2: SCAM,
    3: "We are SEBI registered. 100% accuracy in calls.",
    4: "Mehta Wealth Ltd\nWe run SEBI approved tips.\nDownload our app https://dl.example.com/m.apk\nOTC trades and VIP group\n10% weekly profit assured, 2% daily assured\nno risk, 10% weekly",
    5: "SIP reminder for March",
    6: "Alpha One\nhello\nhello\nINH000011431 and pay xy@oksbi\nBeta Two INA000012345",
    7: "guaranteed returns",
}
ITEMS = [
    dict(msg_id=1, item="sender", ord=0, quote="Sharma Investments", name="Sharma Investments"),
    dict(msg_id=1, item="registration", ord=0, quote="Sharma Investments SEBI Registered Research Analyst Reg No: INH000099991", name="Sharma Investments", regulator="SEBI", category="research_analyst", number="INH000099991"),
    dict(msg_id=1, item="return", ord=0, quote="Guaranteed 30% monthly returns in F&O!", kind="guaranteed", percent=30.0, period="month", product="derivatives"),
    dict(msg_id=1, item="payment", ord=0, quote="Pay Rs 4,999 joining fee to UPI: 9876501234@ybl", method="upi", destination="9876501234@YBL"),
    dict(msg_id=1, item="pressure", ord=0, quote="Offer valid today only!", kind="urgency"),
    dict(msg_id=1, item="endorsement", ord=0, quote="never said by anyone here", authority="SEBI", object="tip"),
    dict(msg_id=1, item="endorsement", ord=1, quote="SEBI Registered Research Analyst", authority="SEBI", object="tip"),
    dict(msg_id=6, item="sender", ord=0, quote="Alpha One", name="Alpha One"),
    dict(msg_id=6, item="registration", ord=0, quote="Beta Two INA000012345", name="Beta Two", regulator="SEBI", category="investment_adviser", number="INA 000 012 345"),
    dict(msg_id=6, item="registration", ord=1, quote="Beta Two", name=None, regulator="SEBI", category="other", number="INZ999999999"),
    dict(msg_id=6, item="registration", ord=2, quote="Beta Two", name=None, regulator="RBI", category="other", number=None),
    dict(msg_id=6, item="access", ord=0, quote="Beta Two", kind="otc"),
    dict(msg_id=6, item="app", ord=0, quote="hello", name="Beta Two", link=None),
    dict(msg_id=6, item="person", ord=0, quote="Beta Two", name="Beta", title="Head"),
    dict(msg_id=7, item="return", ord=0, quote="guaranteed returns", kind="guaranteed", percent=5.0, period="day", product="fixed_deposit"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, 0, t, "text", "good", None) for i, t in MESSAGES.items()]
    segments = spark.createDataFrame(rows, "msg_id long, seq int, text string, origin string, quality string, unclear array<string>")
    names = [c.split()[0] for c in claims.ITEM.split(", ")]
    items = spark.createDataFrame([tuple(x.get(n) for n in names) for x in ITEMS], claims.ITEM)
    r = claims.read(segments, items)
    built = {}
    for c in claims.build(r).orderBy("msg_id", "seq_no").collect():
        built.setdefault(c.msg_id, []).append(c)
    return r, built


def brief(c):
    own = {k: v for k, v in c.asDict().items() if v is not None and k not in ("msg_id", "claim_id", "seq_no", "quote", "seq", "start", "end", "legibility")}
    return json.loads(json.dumps(own))


def test_claims_of_a_model(found):
    r, built = found
    assert [brief(c) for c in built[1]] == [
        {"type": "SEBI_REGISTRATION", "origin": "model+pattern", "category": "RA", "reg_id": "reg-1", "holder_name": "Sharma Investments", "holder_binding": "explicit"},
        {"type": "IDENTITY", "origin": "model", "org_name": "Sharma Investments", "presented_as": "intermediary"},
        {"type": "GUARANTEED_RETURNS", "origin": "model+pattern", "kind": "guaranteed", "percent": 30.0, "period": "month", "product_context": "market"},
        {"type": "PAYMENT_DESTINATION", "origin": "model", "method": "upi", "upi_id": "upi-1"},
        {"type": "SPECIAL_ACCESS", "origin": "pattern", "kind": "vip_group"},
    ]
    assert [c.claim_id for c in built[1]] == [f"claim-{k}" for k in range(1, 6)]
    assert built[1][0].quote.startswith("Sharma Investments SEBI Registered") and SCAM[built[1][2].start : built[1][2].end] == built[1][2].quote == "Guaranteed 30% monthly returns in F&O"
    assert {x.msg_id: x.n for x in r.discarded.collect()} == {1: 1}
    seen = {(p.msg_id, p.kind): p.origin for p in claims.behaviours(r).collect()}
    assert seen[1, "URGENCY"] == "model+pattern" and seen[2, "URGENCY"] == "pattern" and seen[1, "PERSONAL_ACCOUNT_PAYMENT"] == "pattern" and seen[3, "ACCURACY_CLAIM"] == "pattern"


def test_claims_of_patterns_alone(found):
    r, built = found
    assert [brief(c) for c in built[2]] == [
        {"type": "SEBI_REGISTRATION", "origin": "pattern", "category": "RA", "reg_id": "reg-1", "holder_name": "Sharma Investments", "holder_binding": "inferred"},
        {"type": "IDENTITY", "origin": "model", "org_name": "Sharma Investments", "presented_as": "intermediary"},
        {"type": "GUARANTEED_RETURNS", "origin": "pattern", "kind": "guaranteed", "percent": 30.0, "period": "month", "product_context": "market"},
        {"type": "PAYMENT_DESTINATION", "origin": "pattern", "method": "upi", "upi_id": "upi-1"},
        {"type": "SPECIAL_ACCESS", "origin": "pattern", "kind": "vip_group"},
    ]
    assert [brief(c) for c in built[3]] == [{"type": "SEBI_REGISTRATION", "origin": "pattern", "holder_binding": "none"}, {"type": "GUARANTEED_RETURNS", "origin": "pattern", "kind": "guaranteed", "product_context": "market"}]
    assert [brief(c) for c in built[4]] == [
        {"type": "IDENTITY", "origin": "model", "org_name": "Mehta Wealth Ltd", "presented_as": "other"},
        {"type": "REGULATOR_ENDORSEMENT", "origin": "pattern", "authority": "SEBI", "object": "tip"},
        {"type": "GUARANTEED_RETURNS", "origin": "pattern", "kind": "assured", "percent": 10.0, "period": "week", "product_context": "market"},
        {"type": "APP_INSTALL", "origin": "pattern", "url_id": "url-1", "sideload": True},
        {"type": "SPECIAL_ACCESS", "origin": "pattern", "kind": "otc"},
        {"type": "SPECIAL_ACCESS", "origin": "pattern", "kind": "vip_group"},
    ]
    assert 5 not in built


def test_bindings_and_what_the_model_adds(found):
    r, built = found
    got = [brief(c) for c in built[6]]
    assert got[0] == {"type": "SEBI_REGISTRATION", "origin": "model", "category": "IA", "reg_id": "reg-2", "holder_name": "Beta Two", "holder_binding": "explicit"}
    assert got[1] == {"type": "SEBI_REGISTRATION", "origin": "pattern", "reg_id": "reg-1", "holder_name": "Alpha One", "holder_binding": "inferred"}  # two lines between say nothing of registration
    assert [c["type"] for c in got[2:]] == ["IDENTITY", "PAYMENT_DESTINATION", "APP_INSTALL", "SPECIAL_ACCESS"]
    assert got[4] == {"type": "APP_INSTALL", "origin": "model", "app_name": "Beta Two", "sideload": True}
    assert [(p.name, p.title) for p in claims.persons(r).collect()] == [("Beta", "Head")] and [a.name for a in claims.apps(r).collect()] == ["Beta Two"]
    assert brief(built[7][0]) == {"type": "GUARANTEED_RETURNS", "origin": "model+pattern", "kind": "guaranteed", "product_context": "deposit"}  # the rate isn't in the quote


def test_texts_without_promises_are_not_read_for_what_they_speak_of(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(1, 0, "guaranteed returns", "text", "good", None), (2, 0, "a quiet day, trading as ever", "text", "good", None)]
    r = claims.read(spark.createDataFrame(rows, "msg_id long, seq int, text string, origin string, quality string, unclear array<string>"))
    only_promises = F.udf(lambda t: "market" if "guaranteed" in t else 1 // 0)
    monkeypatch.setattr(claims.phrases, "product_context", only_promises)
    assert [(c.msg_id, c.product_context) for c in claims.return_claims(r).collect()] == [(1, "market")]

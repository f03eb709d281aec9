import json

from proofsieve.operators import answers, claims


def test_answers_are_held_against_their_form(spark):
    good = {"investmentRelated": True, "sender": {"name": "Firm", "quote": "Firm"}, "registrationClaims": [{"regulator": "SEBI", "category": "research_analyst", "number": None, "holderName": "Firm", "quote": "q"}], "returnPromises": [{"kind": "fixed", "percent": 12.5, "period": "month", "product": "stocks", "quote": "r"}, {"kind": "assured", "percent": None, "period": "day", "product": "bond", "quote": "s"}], "pressure": [{"kind": "urgency", "quote": "now"}]}
    bad = good | {"registrationClaims": [{"regulator": "X", "category": None, "number": "1" * 61, "holderName": None, "quote": ""}], "pressure": [{"kind": "urgency", "quote": "q"}] * 11, "returnPromises": [{"kind": "fixed", "percent": -1, "period": "month", "product": "stocks", "quote": "r"}]}
    texts = {1: "Here it is:\n```json\n" + json.dumps(good) + "\n``` Thanks { }", 2: json.dumps(bad), 3: "I can't do that.", 4: None, 5: '{"sender": null, "investmentRelated": false}', 6: '{"sender": null}', 7: "{broken"}
    items, wrong = answers.items_of(spark.createDataFrame([*texts.items()], "msg_id long, answer string"))
    names = [c.split()[0] for c in claims.ITEM.split(", ")]
    assert items.columns == names
    got = sorted((r.msg_id, r.item, r.ord, r.name, r.quote, r.percent, r.kind, r.regulator) for r in items.collect())
    assert got == [(1, "pressure", 0, None, "now", None, "urgency", None), (1, "registration", 0, "Firm", "q", None, None, "SEBI"), (1, "return", 0, None, "r", 12.5, "fixed", None), (1, "return", 1, None, "s", None, "assured", None), (1, "sender", 0, "Firm", "Firm", None, None, None)]
    told = {r.msg_id: list(r.issues) for r in wrong.collect()}
    assert told.keys() == {2, 3, 4, 6, 7} and told[3] == told[4] == told[7] == ["no JSON object"] and told[6] == ["investmentRelated: missing"]
    assert [x.split(":")[0] for x in told[2]] == ["registrationClaims.0.regulator", "registrationClaims.0.category", "registrationClaims.0.number", "registrationClaims.0.quote", "returnPromises.0.percent"]

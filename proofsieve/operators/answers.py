"""Answers of a model as items for claims: the first JSON object of each, held against what an answer may contain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsieve.functions import spans
from proofsieve.operators.claims import ITEM
from proofsieve.session import checkpointed


@dataclass(frozen=True)
class Field:
    """A field of an item: the column that it becomes, and what it may be: one of some words, or a text or number up to a bound."""

    column: str
    words: tuple[str, ...] = ()
    most: int = 0
    nullable: bool = False
    number: bool = False


# Lists of an answer with the item that each makes, how many it may have, and the fields of an item.
QUOTE = Field("quote", most=600)
LISTS = {
    "registrationClaims": ("registration", 10, {"regulator": Field("regulator", ("SEBI", "AMFI", "RBI", "NSE", "BSE", "OTHER")), "category": Field("category", ("research_analyst", "investment_adviser", "stock_broker", "portfolio_manager", "mutual_fund", "other", "unspecified")), "number": Field("number", most=60, nullable=True), "holderName": Field("name", most=200, nullable=True), "quote": QUOTE}),
    "organizations": ("organization", 15, {"name": Field("name", most=200), "role": Field("role", ("sender", "mentioned", "regulator", "exchange", "platform")), "quote": QUOTE}),
    "persons": ("person", 10, {"name": Field("name", most=120), "title": Field("title", most=120, nullable=True), "quote": QUOTE}),
    "endorsements": ("endorsement", 10, {"authority": Field("authority", ("SEBI", "RBI", "NSE", "BSE", "GOVT")), "object": Field("object", ("entity_registration", "product", "tip", "scheme", "app", "returns", "group")), "quote": QUOTE}),
    "returnPromises": ("return", 10, {"kind": Field("kind", ("guaranteed", "assured", "fixed", "risk_free", "no_loss", "high_unqualified")), "percent": Field("percent", most=100_000, nullable=True, number=True), "period": Field("period", ("day", "week", "month", "year", "trade", "unspecified")), "product": Field("product", ("stocks", "derivatives", "ipo", "crypto", "forex", "mutual_fund", "fixed_deposit", "bond", "other", "unknown")), "quote": QUOTE}),
    "paymentRequests": ("payment", 10, {"method": Field("method", ("upi", "bank", "qr", "crypto", "other")), "destination": Field("destination", most=200, nullable=True), "quote": QUOTE}),
    "appInstalls": ("app", 10, {"appName": Field("name", most=120, nullable=True), "link": Field("link", most=500, nullable=True), "quote": QUOTE}),
    "specialAccess": ("access", 10, {"kind": Field("kind", ("institutional_account", "fpi_account", "pre_ipo", "ipo_allotment", "otc", "block_deal", "vip_group")), "quote": QUOTE}),
    "pressure": ("pressure", 10, {"kind": Field("kind", ("urgency", "secrecy", "contact_shift", "remote_access_or_otp", "pay_to_withdraw", "profit_screenshots")), "quote": QUOTE}),
}
SENDER = {"name": Field("name", most=200), "quote": QUOTE}
MOST_ISSUES = 5


def _kind(fields: dict[str, Field]) -> str:
    return "struct<" + ", ".join(f"{name}: {'double' if f.number else 'string'}" for name, f in fields.items()) + ">"


SCHEMA = "struct<investmentRelated: boolean, sender: " + _kind(SENDER) + ", " + ", ".join(f"{name}: array<{_kind(fields)}>" for name, (_, _, fields) in LISTS.items()) + ">"


def _problem(value: Column, f: Field) -> Column:
    """What is wrong with a value, or null."""
    if f.words:
        wrong, why = ~value.isin(*f.words), "not one of " + ", ".join(f.words)
    elif f.number:
        wrong, why = ~((value > 0) & (value <= f.most)), f"not above 0 and up to {f.most}"
    else:
        low = 1 if f is QUOTE else 0
        wrong, why = ~F.length(value).between(low, f.most), f"not of {low} to {f.most} characters"
    missing = F.lit(False) if f.nullable else value.isNull()
    return F.when(missing, "missing").when(wrong, why)


def _problems(item: Column, path: Column, fields: dict[str, Field]) -> Column:
    return F.array_compact(F.array(*(F.concat(path, F.lit(f".{name}: "), _problem(item[name], f)) for name, f in fields.items())))


def _of_all(own: Column, name: str, fields: dict[str, Field]) -> Column:
    return F.flatten(F.transform(own, lambda x, i: _problems(x, F.concat(F.lit(f"{name}."), i.cast("string")), fields)))


def issues(answer: Column) -> Column:
    """Array of what is wrong with a parsed answer, in its order, five at most."""
    none = F.array().cast("array<string>")
    found = [F.array_compact(F.array(F.when(answer["investmentRelated"].isNull(), "investmentRelated: missing"))), F.when(answer["sender"].isNotNull(), _problems(answer["sender"], F.lit("sender"), SENDER)).otherwise(none)]
    for name, (_, most, fields) in LISTS.items():
        own = F.coalesce(answer[name], F.array().cast(f"array<{_kind(fields)}>"))
        found += [F.array_compact(F.array(F.when(F.size(own) > most, f"{name}: more than {most}"))), _of_all(own, name, fields)]
    return F.slice(F.concat(*found), 1, MOST_ISSUES)


def items_of(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, problems) of answers (msg_id, answer): rows ITEM of answers that are as they should be, and rows (msg_id, issues)
    of the others; nothing of those is used. An answer is the first JSON object of a text, whatever is around it."""
    parsed = answers.select("msg_id", spans.extract_json(F.col("answer")).alias("json"))
    parsed = parsed.select("msg_id", "json", F.from_json("json", SCHEMA).alias("a"))
    found = F.when(F.col("json").isNull(), F.array(F.lit("no JSON object"))).otherwise(issues(F.col("a")))
    judged = checkpointed(parsed.select("msg_id", "a", found.alias("issues")))  # parsed once for all kinds of items
    good = judged.where(F.size("issues") == 0)
    columns = [c.split() for c in ITEM.split(", ")]

    def rows(df: DataFrame, kind: str, fields: dict[str, Field]) -> DataFrame:
        own = {f.column: F.col("x")[name] for name, f in fields.items()} | {"item": F.lit(kind), "ord": F.col("k"), "msg_id": F.col("msg_id")}
        return df.select(*(own.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns))

    out = rows(good.where("a.sender IS NOT NULL").select("msg_id", F.lit(0).alias("k"), F.col("a.sender").alias("x")), "sender", SENDER)
    for name, (kind, _, fields) in LISTS.items():
        out = out.unionByName(rows(good.select("msg_id", F.posexplode(F.col("a")[name]).alias("k", "x")), kind, fields))
    return out, judged.where(F.size("issues") > 0).select("msg_id", "issues")

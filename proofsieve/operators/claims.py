"""Claims: what messages say that can be checked, from patterns and from what a model has read in them.

Everything is a table keyed by message. What a model says counts only where its quote stands in the message, and
identifiers are always those that patterns have found. Items of a model are rows (msg_id, item, ord, quote, ...), see
ITEM; messages without any are read by patterns alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsieve.functions import identifiers, phrases, spans, text
from proofsieve.session import checkpointed, together

#: item is sender, organization, person, registration, endorsement, return, payment, app, access or pressure.
ITEM = "msg_id long, item string, ord int, quote string, name string, role string, title string, regulator string, number string, category string, authority string, object string, kind string, percent double, period string, product string, method string, destination string, link string"
# A model's names for categories and pressure; kinds of behaviour; wording of approval.
CATEGORIES = {"research_analyst": "RA", "investment_adviser": "IA", "stock_broker": "BROKER", "portfolio_manager": "PMS", "mutual_fund": "MF", "other": "OTHER"}
PRESSURE = {"urgency": "URGENCY", "secrecy": "SECRECY", "contact_shift": "CONTACT_SHIFT", "remote_access_or_otp": "REMOTE_ACCESS_OR_OTP", "pay_to_withdraw": "PAY_TO_WITHDRAW", "profit_screenshots": "PROFIT_SCREENSHOTS"}
BEHAVIOUR = ("URGENCY", "SECRECY", "CONTACT_SHIFT", "REMOTE_ACCESS_OR_OTP", "PAY_TO_WITHDRAW", "PROFIT_SCREENSHOTS", "CRYPTO_PAYMENT", "ACCURACY_CLAIM")
APPROVAL = phrases.composed("(?i)approv|certif|recommend|verified|authori[sz]|endors|backed|sanction|मान्यता|अनुमोद|प्रमाणित|स्वीकृत|मंजूर|मंज़ूर|सत्यापित|manzoor|pramanit|pass kiya|पास किया")
FIELDS = "category string, reg_id string, holder_name string, holder_binding string, org_name string, presented_as string, authority string, object string, kind string, percent double, period string, product_context string, method string, upi_id string, bank_id string, app_name string, url_id string, sideload boolean"


@dataclass
class Read:
    """What a batch of messages has: segments, entities, entities at each of their places and phrases as tables, and a
    model's items that are grounded."""

    segments: DataFrame
    entities: DataFrame
    places: DataFrame
    hits: DataFrame
    items: DataFrame
    discarded: DataFrame


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, whatever columns the rows have."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.select(F.struct("*").alias("row"), n.alias("n")).where("n = 1").select("row.*")


def quote_legibility(origin: Column, quality: Column, unclear: Column, quoted: Column) -> Column:
    """clear, or uncertain where the segment is spoken or read poorly, or the quote holds an unclear fragment."""
    plain = lambda f: F.lower(F.regexp_replace(f, r"[^\p{L}\p{N}]+", ""))
    held = F.exists(F.coalesce(unclear, F.array().cast("array<string>")), lambda f: (plain(f) != "") & F.contains(plain(quoted), plain(f)))
    return F.when(origin.isin("text", "url"), "clear").when((origin == "audio") | quality.isin("poor", "unreadable") | held, "uncertain").otherwise("clear")


def shared(seq: str, start: str, end: str) -> Column:
    """Whether a row's place (seq, start, end) and another one in columns of these names overlap."""
    return spans.overlaps(F.struct("seq", "start", "end"), F.struct(F.col(seq).alias("seq"), F.col(start).alias("start"), F.col(end).alias("end")))


def worst(a: Column, b: Column) -> Column:
    return F.when((a == "uncertain") | (b == "uncertain"), "uncertain").otherwise("clear")


def clipped(c: Column, most: int) -> Column:
    one = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.substring(one, 1, most - 1), F.lit("…")))


def read(segments: DataFrame, items: DataFrame | None = None) -> Read:
    """Extracts from segments (msg_id, seq, text, origin, quality, unclear) and grounds a model's items in them.

    Items whose quote is not in the message are counted in `discarded` (msg_id, n) and go.
    """
    spark = segments.sparkSession
    items = spark.createDataFrame([], ITEM) if items is None else items
    # Texts are few bytes and much work: they are dealt by message once, for what reads them and for all groups of messages.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    segments = checkpointed(segments.repartition(parts, "msg_id"))

    def entities_and_places() -> tuple[DataFrame, DataFrame]:
        entities = checkpointed(identifiers.entities(segments))
        return entities, checkpointed(placed_entities(segments, entities))

    (entities, places), hits, (there, discarded) = together(spark, entities_and_places, lambda: _phrases(segments), lambda: _grounded(segments, items, parts))
    return Read(segments, entities, places, hits, there, discarded)


def _phrases(segments: DataFrame) -> DataFrame:
    """Rows (msg_id, seq, n, phrase, line, legibility) of the phrases of segments."""
    t = F.col("text")
    rows = segments.select("msg_id", "seq", "text", "origin", "quality", "unclear", F.posexplode(phrases.phrases(t)).alias("n", "p"))
    line = spans.line_of(t, F.col("p.start"))
    return checkpointed(rows.select("msg_id", "seq", "n", "p.*", line.alias("line"), quote_legibility(F.col("origin"), F.col("quality"), F.col("unclear"), spans.piece(t, F.col("p.start"), F.col("p.end"))).alias("legibility")))


def _grounded(segments: DataFrame, items: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """A model's items whose quotes segments have, where they have them, and how many others there are by message."""
    t = F.col("text")
    own = segments.groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("segments"))
    placed = items.join(own, "msg_id").repartition(parts, "msg_id").select(*items.columns, spans.locate_quotes(F.array("quote", "name"), F.col("segments")).alias("places"))
    placed = placed.select(*items.columns, F.col("places")[0].alias("span"), F.col("places")[1].alias("at"))
    placed = checkpointed(placed)
    spoken = segments.select("msg_id", "seq", "text", "origin", "quality", "unclear")
    there = placed.where("span IS NOT NULL").withColumn("seq", F.col("span.seq")).join(spoken, ["msg_id", "seq"])
    said = spans.piece(t, F.col("span.start"), F.col("span.end"))
    there = there.select(*items.columns, "seq", F.col("span.start"), F.col("span.end"), F.col("at").isNotNull().alias("named"), said.alias("said"), spans.line_of(t, F.col("span.start")).alias("line"), quote_legibility(F.col("origin"), F.col("quality"), F.col("unclear"), said).alias("legibility"))
    discarded = placed.where("span IS NULL").groupBy("msg_id").agg(F.count("*").alias("n"))
    return checkpointed(there), discarded


def organizations(r: Read) -> DataFrame:
    """Rows (msg_id, org_id, name, role, guessed, seq, start, end): whom messages name, and who sends them.

    A model's names have to be in the message; names that fold to the same are one, a sender if any says so. Messages
    without a model's items have the names that patterns guess, of which the first is the sender.
    """
    of = r.items.where(F.col("item").isin("sender", "organization") & F.col("named")).select("msg_id", "ord", "name", F.when(F.col("item") == "sender", "sender").otherwise(F.col("role")).alias("role"), (F.col("item") != "sender").alias("later"), "seq", "start", "end")
    with_model = r.items.select("msg_id").distinct()
    guesses = r.segments.join(with_model, "msg_id", "left_anti").select("msg_id", "seq", F.posexplode(identifiers.business_names(F.col("text"))).alias("ord", "x")).select("msg_id", "ord", F.col("x.name").alias("name"), F.lit("mentioned").alias("role"), F.lit(True).alias("later"), "seq", "x.start", "x.end", F.lit(True).alias("guessed"))
    every = of.withColumn("guessed", F.lit(False)).unionByName(guesses).withColumn("folded", text.fold_for_match(F.col("name")))
    order = F.when(F.col("guessed"), F.struct(F.col("seq").alias("a"), F.col("ord").alias("b"))).otherwise(F.struct(F.col("later").cast("int").alias("a"), F.col("ord").alias("b")))
    every = every.withColumn("order", order)
    merged = every.groupBy("msg_id", "folded", "guessed").agg(F.min("order").alias("order"), F.bool_or(F.col("role") == "sender").alias("sends"), *(F.min_by(c, "order").alias(c) for c in ("name", "role", "seq", "start", "end")))
    n = F.row_number().over(Window.partitionBy("msg_id").orderBy("order"))
    numbered = merged.withColumn("n", n)
    role = F.when(F.col("sends") | (F.col("guessed") & (F.col("n") == 1)), "sender").otherwise(F.col("role"))
    return numbered.select("msg_id", F.concat(F.lit("org-"), n.cast("string")).alias("org_id"), clipped(F.col("name"), 160).alias("name"), role.alias("role"), "guessed", "seq", "start", "end", "n")


def persons(r: Read) -> DataFrame:
    """Rows (msg_id, person_id, name, title) of persons whose name and quote are in the message."""
    n = F.row_number().over(Window.partitionBy("msg_id").orderBy("ord"))
    return r.items.where((F.col("item") == "person") & F.col("named")).select("msg_id", F.concat(F.lit("person-"), n.cast("string")).alias("person_id"), clipped(F.col("name"), 120).alias("name"), clipped(F.col("title"), 80).alias("title"))


def apps(r: Read) -> DataFrame:
    """Rows (msg_id, app_id, name) of apps whose name and quote are in the message."""
    n = F.row_number().over(Window.partitionBy("msg_id").orderBy("ord"))
    return r.items.where((F.col("item") == "app") & F.col("named")).select("msg_id", F.concat(F.lit("app-"), n.cast("string")).alias("app_id"), clipped(F.col("name"), 80).alias("name"))


#: Kinds of entities whose lines claims ask for.
PLACED = ("reg", "upi", "bank", "url")


def placed_entities(segments: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows (msg_id, kind, entity_id, key, attrs, legible, n, k, seq, start, end, line, line_text): entities of the kinds
    PLACED at each of their spans, with the lines that they stand on. Texts are read once for all kinds."""
    own = entities.where(F.col("kind").isin(*PLACED)).select("msg_id", "kind", "entity_id", "key", "attrs", F.col("legibility").alias("legible"), F.posexplode("spans").alias("k", "s")).select("*", "s.*").drop("s")
    number = F.regexp_extract("entity_id", r"(\d+)$", 1).cast("int")
    joined = own.join(segments.select("msg_id", "seq", "text"), ["msg_id", "seq"])
    located = joined.select("msg_id", "kind", "entity_id", "key", "attrs", "legible", number.alias("n"), "k", "seq", "start", "end", "text", spans.line_of(F.col("text"), F.col("start")).alias("line"))
    return located.withColumn("line_text", F.trim(F.get(F.split("text", "\n"), F.col("line")))).drop("text")


def spans_of(r: Read, kind: str) -> DataFrame:
    """Rows (msg_id, entity_id, key, attrs, legible, n, k, seq, start, end, line, line_text): an entity of one of the kinds
    PLACED at each of its spans."""
    return r.places.where(F.col("kind") == kind).drop("kind")


def adjacent(r: Read, names: DataFrame) -> DataFrame:
    """Rows (msg_id, reg_id, name): numbers that stand by a name of names (msg_id, name): on its line or the next, or with
    up to two short lines between that each speak of registration."""
    regs = spans_of(r, "reg").select("msg_id", F.col("entity_id").alias("reg_id"), "seq", F.col("line").alias("reg_line"))
    # Lines farther than three from any number have no part in what is told: names are located on those near one only.
    around = regs.groupBy("msg_id", "seq").agg(F.collect_set("reg_line").alias("around"))
    numbered = F.transform(F.split("text", "\n"), lambda words, line: F.struct(line.alias("line"), words.alias("words")))
    near = F.filter(numbered, lambda x: F.exists("around", lambda n: F.abs(x["line"] - n) <= 3))
    each = r.segments.join(around, ["msg_id", "seq"]).select("msg_id", "seq", F.explode(near).alias("l")).select("msg_id", "seq", "l.line", "l.words")
    each = checkpointed(each)
    asked = names.select("msg_id", "name").distinct()
    found = each.join(asked, "msg_id").withColumn("at", spans.locate_quote(F.col("name"), F.array(F.struct(F.lit(0).alias("seq"), F.col("words").alias("text"))))).where("at IS NOT NULL").select("msg_id", "seq", "name", "line")
    mentions = r.hits.where("kind = 'SEBI_REGISTRATION_MENTION'").select("msg_id", "seq", "line").distinct()
    short = each.join(mentions, ["msg_id", "seq", "line"]).where(F.length("words") <= 60).select("msg_id", "seq", F.col("line").alias("between"))
    pairs = found.join(regs, ["msg_id", "seq"]).withColumn("apart", F.abs(F.col("line") - F.col("reg_line"))).where("apart <= 3")
    low, high = F.least("line", "reg_line"), F.greatest("line", "reg_line")
    told = pairs.join(short, ["msg_id", "seq"], "left").groupBy("msg_id", "seq", "name", "line", "reg_id", "reg_line", "apart").agg(F.count_if((F.col("between") > low) & (F.col("between") < high)).alias("told"))
    return told.where((F.col("apart") <= 1) | (F.col("told") == F.col("apart") - 1)).select("msg_id", "reg_id", "name").distinct()


def _claims(rows: DataFrame, type_: str, group: int, **fields: Column) -> DataFrame:
    """Claims of rows (msg_id, order struct, quote, seq, start, end, origin, legibility)."""
    columns = [c.split() for c in FIELDS.split(", ")]
    return rows.select("msg_id", F.lit(type_).alias("type"), F.lit(group).alias("group"), F.to_json(F.col("order")).alias("key"), F.col("order.a").cast("int").alias("a"), F.col("order.b").cast("int").alias("b"), F.col("order.c").cast("int").alias("c"), clipped(F.col("quote"), 300).alias("quote"), "seq", "start", "end", "origin", "legibility", *((fields[n] if n in fields else F.lit(None)).cast(k).alias(n) for n, k in columns)).drop("key")


def order(a, b, c=0) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, int) else F.col(x)
    return F.struct(lit(a).alias("a"), lit(b).alias("b"), lit(c).alias("c"))


def registration_claims(r: Read, orgs: DataFrame) -> DataFrame:
    """Claims to be registered: what a model read, each number that it left, else the first mention of registration."""
    regs = spans_of(r, "reg")
    first = regs.where("k = 0")
    told = r.items.where((F.col("item") == "registration") & F.col("regulator").isin("SEBI", "AMFI"))
    number = lambda c: F.get(identifiers.registration_numbers(c), F.lit(0))["normalized"]
    told = told.select(*told.columns, number(F.col("number")).alias("given"), number(F.col("said")).alias("quoted"))
    known = first.select("msg_id", "key", F.col("entity_id").alias("id"), "legible")
    told = told.join(known.select("msg_id", F.col("key").alias("given"), F.struct("id", "legible").alias("g")), ["msg_id", "given"], "left").join(known.select("msg_id", F.col("key").alias("quoted"), F.struct("id", "legible").alias("q")), ["msg_id", "quoted"], "left")
    told = told.withColumn("reg", F.when(F.col("number").isNotNull(), F.coalesce("g", "q")))
    # Only numbers that no pattern has found are looked for in the letters and digits of whole texts.
    told = checkpointed(told)
    unseen = told.where("number IS NOT NULL AND reg IS NULL").select("msg_id").distinct()
    texts = r.segments.join(unseen, "msg_id", "left_semi").groupBy("msg_id").agg(F.collect_list(F.struct(text.alnum_only(F.col("text")).alias("alnum"))).alias("plain"))
    told = told.join(texts, "msg_id", "left").withColumn("occurs", spans.identifier_occurs(F.coalesce("number", F.lit("")), F.col("plain")))
    told = told.where("number IS NULL OR reg IS NOT NULL OR occurs").drop("plain")
    holder = F.when(F.col("named"), clipped(F.col("name"), 160))
    told = checkpointed(told.withColumn("holder", holder).withColumn("reg_id", F.col("reg.id")))
    near = adjacent(r, orgs.where("role = 'sender'").select("msg_id", "name").unionByName(told.where("holder IS NOT NULL").select("msg_id", F.col("holder").alias("name"))))
    near = checkpointed(near.withColumn("near", F.lit(True)))
    held = spans.locate_quote(F.col("holder"), F.array(F.struct(F.lit(0).alias("seq"), F.col("said").alias("text")))).isNotNull()
    within = regs.select("msg_id", F.col("entity_id").alias("reg_id"), F.col("seq").alias("rs"), F.col("start").alias("ra"), F.col("end").alias("re"))
    inside = told.where("reg_id IS NOT NULL").join(within, ["msg_id", "reg_id"]).where(shared("rs", "ra", "re")).select("msg_id", "ord", F.lit(True).alias("inside")).distinct()
    told = told.withColumn("held", held).join(inside, ["msg_id", "ord"], "left").join(near.withColumnRenamed("name", "holder"), ["msg_id", "reg_id", "holder"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    explicit = F.col("reg_id").isNotNull() & ((yes("held") & yes("inside")) | yes("near"))
    binding = F.when(F.col("holder").isNull(), "none").when(explicit, "explicit").otherwise("inferred")
    mentioned = r.hits.where("kind = 'SEBI_REGISTRATION_MENTION'").select("msg_id").distinct().withColumn("mention", F.lit(True))
    one = F.row_number().over(Window.partitionBy("msg_id", "reg_id").orderBy("ord")) == 1
    told = told.join(mentioned, "msg_id", "left").withColumn("origin", F.when(F.col("reg_id").isNotNull() & one & yes("mention"), "model+pattern").otherwise("model"))
    model = _claims(told.withColumn("order", order(0, "ord")).withColumn("quote", F.col("said")).withColumn("legibility", worst(F.col("legibility"), F.coalesce("reg.legible", F.lit("clear")))), "SEBI_REGISTRATION", 0, category=identifiers.dimension(CATEGORIES)[F.col("category")], reg_id=F.col("reg_id"), holder_name=F.col("holder"), holder_binding=binding)
    left = first.join(told.select("msg_id", F.col("reg_id").alias("entity_id")).where("entity_id IS NOT NULL").distinct(), ["msg_id", "entity_id"], "left_anti")
    sender = first_by(orgs.where("role = 'sender'"), ["msg_id"], ["n"]).select("msg_id", F.col("name").alias("sender"), "guessed")
    by_segment = first_by(r.hits.where("kind = 'SEBI_REGISTRATION_MENTION'"), ["msg_id", "seq"], ["n"]).select("msg_id", "seq", "category")
    left = left.join(sender, "msg_id", "left").join(by_segment, ["msg_id", "seq"], "left").withColumnRenamed("entity_id", "reg_id").join(near.withColumnRenamed("name", "sender"), ["msg_id", "reg_id", "sender"], "left")
    bound = F.when(F.col("sender").isNull(), "none").when(~F.col("guessed") & yes("near"), "explicit").otherwise("inferred")
    pattern = _claims(left.select("*", order(1, "n").alias("order"), F.col("line_text").alias("quote"), F.lit("pattern").alias("origin"), F.col("legible").alias("legibility")), "SEBI_REGISTRATION", 0, category=F.col("category"), reg_id=F.col("reg_id"), holder_name=F.col("sender"), holder_binding=bound)
    both = model.unionByName(pattern)
    bare = first_by(r.hits.where("kind = 'SEBI_REGISTRATION_MENTION'"), ["msg_id"], ["seq", "n"]).join(both.select("msg_id").distinct(), "msg_id", "left_anti").join(sender, "msg_id", "left")
    bare = _claims(bare.select("*", order(2, 0).alias("order"), F.lit("pattern").alias("origin")), "SEBI_REGISTRATION", 0, category=F.col("category"), holder_name=F.col("sender"), holder_binding=F.when(F.col("sender").isNull(), "none").otherwise("inferred"))
    return both.unionByName(bare)


def identity_claims(r: Read, orgs: DataFrame, registrations: DataFrame) -> DataFrame:
    """A claim of each message with a sender to be that sender."""
    sender = first_by(orgs.where("role = 'sender'"), ["msg_id"], ["n"]).join(r.segments, ["msg_id", "seq"])
    t = F.col("text")
    intermediary = registrations.select("msg_id").distinct().withColumn("registered", F.lit(True))
    s = sender.join(intermediary, "msg_id", "left").select("msg_id", "name", "registered", "seq", "start", "end", order(0, 0).alias("order"), spans.line_text(t, F.col("start")).alias("quote"), F.lit("model").alias("origin"), quote_legibility(F.col("origin"), F.col("quality"), F.col("unclear"), spans.piece(t, F.col("start"), F.col("end"))).alias("legibility"))
    return _claims(s, "IDENTITY", 1, org_name=F.col("name"), presented_as=F.when(F.col("registered"), "intermediary").otherwise("other"))


def endorsement_claims(r: Read) -> DataFrame:
    """Claims that an authority approves of something but the sender's registration; a model's where wording bears it out."""
    hits = r.hits.where("kind = 'ENDORSEMENT'")
    at = hits.select("msg_id", "seq", F.col("start").alias("ha"), F.col("end").alias("hb")).distinct()
    told = r.items.where("item = 'endorsement' AND object <> 'entity_registration'")
    backed = told.join(at, ["msg_id", "seq"]).where(shared("seq", "ha", "hb")).select("msg_id", "ord", F.lit(True).alias("backed")).distinct()
    told = told.join(backed, ["msg_id", "ord"], "left").where(F.col("backed") | F.col("said").rlike(APPROVAL))
    told = checkpointed(told)
    model = _claims(told.withColumn("order", order(0, "ord")).withColumn("quote", F.col("said")).withColumn("origin", F.when(F.col("backed"), "model+pattern").otherwise("model")), "REGULATOR_ENDORSEMENT", 2, authority=F.col("authority"), object=F.col("object"))
    kept = told.select("msg_id", "seq", F.col("start").alias("ma"), F.col("end").alias("mb"))
    covered = hits.join(kept, ["msg_id", "seq"]).where(shared("seq", "ma", "mb")).select("msg_id", "seq", "n").distinct()
    own = hits.where("object IS NOT NULL AND object <> 'entity_registration'").join(covered, ["msg_id", "seq", "n"], "left_anti")
    return model.unionByName(_claims(own.select("*", order(1, "seq", "n").alias("order"), F.lit("pattern").alias("origin")), "REGULATOR_ENDORSEMENT", 2, authority=F.col("authority"), object=F.col("object")))


def return_claims(r: Read) -> DataFrame:
    """Promises of returns, one for each: a model's, then lines with a rate, then the first without."""
    t = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "\n")
    rates = first_by(r.hits.where("kind = 'RETURN_RATE'"), ["msg_id", "seq", "line"], ["n"]).select("msg_id", "seq", "line", F.col("percent").alias("line_percent"), F.col("attr").alias("line_period"))
    promises = r.hits.where("kind = 'GUARANTEE'")
    told = r.items.where("item = 'return' AND kind <> 'high_unqualified'")
    # Whole texts are read for what they speak of only where something is promised.
    asked = promises.select("msg_id").unionByName(told.select("msg_id")).distinct()
    context = r.segments.join(asked, "msg_id", "left_semi").groupBy("msg_id").agg(t.alias("all")).select("msg_id", phrases.product_context(F.col("all")).alias("context"))
    at = promises.select("msg_id", "seq", F.col("start").alias("ha"), F.col("end").alias("hb")).distinct()
    backed = told.join(at, ["msg_id", "seq"]).where(shared("seq", "ha", "hb")).select("msg_id", "ord", F.lit(True).alias("backed")).distinct()
    written = F.regexp_replace(F.regexp_replace(F.col("percent").cast("string"), r"\.0$", ""), r"\.", r"\\.")
    literal = F.regexp_like(F.col("said"), F.concat(F.lit(r"(?<![\d.])"), written, F.lit(r"\s?%")))
    told = told.join(backed, ["msg_id", "ord"], "left").join(context, "msg_id").join(rates, ["msg_id", "seq", "line"], "left").withColumn("own", F.coalesce(literal, F.lit(False)))
    product = F.when(F.col("product").isin("fixed_deposit", "bond"), "deposit").when(F.coalesce("product", F.lit("unknown")).isin("other", "unknown"), F.col("context")).otherwise("market")
    told = checkpointed(told.withColumn("rate", F.when(F.col("own"), F.struct("percent", "period")).otherwise(F.struct(F.col("line_percent").alias("percent"), F.col("line_period").alias("period")))).withColumn("product", product))
    model = _claims(told.select("*", order(0, "ord").alias("order"), F.when(F.col("backed"), "model+pattern").otherwise("model").alias("origin")).drop("quote").withColumnRenamed("said", "quote"), "GUARANTEED_RETURNS", 3, kind=F.col("kind"), percent=F.col("rate.percent"), period=F.col("rate.period"), product_context=F.col("product"))
    lines = first_by(promises, ["msg_id", "seq", "line"], ["n"]).join(told.select("msg_id", "seq", "line").distinct(), ["msg_id", "seq", "line"], "left_anti").join(rates, ["msg_id", "seq", "line"], "left")
    has = told.select("msg_id").distinct().withColumn("has", F.lit(True))
    said = told.where("own").select("msg_id", F.col("percent").alias("line_percent"), F.col("period").alias("line_period")).distinct().withColumn("known", F.lit(True))
    bare = F.col("line_percent").isNull()
    rank = F.row_number().over(Window.partitionBy("msg_id").orderBy(bare, "seq", "n"))
    again = F.row_number().over(Window.partitionBy("msg_id", "line_percent", "line_period").orderBy("seq", "n"))
    lines = lines.join(has, "msg_id", "left").join(said, ["msg_id", "line_percent", "line_period"], "left").withColumn("rank", rank).withColumn("again", again)
    new = ~bare & (F.col("again") == 1) & F.col("known").isNull()
    lines = lines.where((F.col("has").isNull() & (F.col("rank") == 1)) | new).join(context, "msg_id")
    return model.unionByName(_claims(lines.select("*", order(1, "rank").alias("order"), F.lit("pattern").alias("origin")), "GUARANTEED_RETURNS", 3, kind=F.col("attr"), percent=F.col("line_percent"), period=F.col("line_period"), product_context=F.col("context")))


def payment_claims(r: Read) -> DataFrame:
    """Where money is to go: a model's requests with the handle they name or that stands on their line, and other handles."""
    upis, banks = spans_of(r, "upi"), spans_of(r, "bank")
    told = r.items.where("item = 'payment'")
    named = upis.where("k = 0").select("msg_id", F.col("key").alias("destination"), F.col("entity_id").alias("by_name"))
    on_line = lambda e, name: first_by(e, ["msg_id", "seq", "line"], ["n"]).select("msg_id", "seq", "line", F.col("entity_id").alias(name))
    told = told.withColumn("destination", F.when(F.col("method") == "upi", F.lower("destination"))).join(named, ["msg_id", "destination"], "left").join(on_line(upis, "by_line"), ["msg_id", "seq", "line"], "left").join(on_line(banks, "bank"), ["msg_id", "seq", "line"], "left")
    told = checkpointed(told.withColumn("upi", F.coalesce("by_name", "by_line")))
    model = _claims(told.select("*", order(0, "ord").alias("order"), F.lit("model").alias("origin")).drop("quote").withColumnRenamed("said", "quote"), "PAYMENT_DESTINATION", 4, method=F.col("method"), upi_id=F.col("upi"), bank_id=F.col("bank"))
    rest = upis.where("k = 0").join(told.select("msg_id", F.col("upi").alias("entity_id")).where("entity_id IS NOT NULL").distinct(), ["msg_id", "entity_id"], "left_anti")
    return model.unionByName(_claims(rest.select("*", order(1, "n").alias("order"), F.col("line_text").alias("quote"), F.lit("pattern").alias("origin"), F.col("legible").alias("legibility")), "PAYMENT_DESTINATION", 4, method=F.lit("upi"), upi_id=F.col("entity_id")))


def app_claims(r: Read) -> DataFrame:
    """Apps to install: a model's, else one by the first link to a package, or by the first wording."""
    urls = spans_of(r, "url")
    facts = lambda e: e.select("msg_id", F.col("entity_id").alias("url_id"), F.coalesce(F.col("attrs")["apk"] == "true", F.lit(False)).alias("apk"), F.col("attrs")["app_store"].alias("store"))
    on_line = first_by(urls, ["msg_id", "seq", "line"], ["n"]).select("msg_id", "seq", "line", F.col("entity_id").alias("line_url"))
    told = r.items.where("item = 'app'").select("*", identifiers.analyse_url(F.coalesce("link", F.lit("")))["href"].alias("href"))
    linked = urls.where("k = 0").select("msg_id", F.col("key").alias("href"), F.col("entity_id").alias("link_url"))
    told = told.join(linked, ["msg_id", "href"], "left").join(on_line, ["msg_id", "seq", "line"], "left").withColumn("url_id", F.coalesce("link_url", "line_url"))
    about = facts(urls.where("k = 0"))
    side = F.when(F.col("url_id").isNull(), True).otherwise(F.col("apk") | F.col("store").isNull())
    told = told.join(about, ["msg_id", "url_id"], "left")
    model = _claims(told.select("*", order(0, "ord").alias("order"), F.lit("model").alias("origin")).drop("quote").withColumnRenamed("said", "quote"), "APP_INSTALL", 5, app_name=F.when(F.col("named"), clipped(F.col("name"), 80)), url_id=F.col("url_id"), sideload=side)
    packages = first_by(urls.where("k = 0 AND attrs['apk'] = 'true'"), ["msg_id"], ["n"]).select("msg_id", F.lit(0).alias("rank"), "seq", "start", "end", F.col("entity_id").alias("url_id"), F.col("line_text").alias("quote"))
    wording = first_by(r.hits.where("kind = 'APP_INSTALL'"), ["msg_id"], ["seq", "n"]).join(on_line, ["msg_id", "seq", "line"], "left").join(r.segments.select("msg_id", "seq", "text"), ["msg_id", "seq"]).select("msg_id", F.lit(1).alias("rank"), "seq", "start", "end", F.col("line_url").alias("url_id"), spans.line_text(F.col("text"), F.col("start")).alias("quote"))
    one = first_by(packages.unionByName(wording), ["msg_id"], ["rank"]).join(told.select("msg_id").distinct(), "msg_id", "left_anti")
    one = one.join(r.segments, ["msg_id", "seq"]).join(about, ["msg_id", "url_id"], "left")
    said = spans.piece(F.col("text"), F.col("start"), F.col("end"))
    one = one.select("*", quote_legibility(F.col("origin"), F.col("quality"), F.col("unclear"), said).alias("legibility"), order(1, 0).alias("order")).drop("origin").withColumn("origin", F.lit("pattern"))
    return model.unionByName(_claims(one, "APP_INSTALL", 5, url_id=F.col("url_id"), sideload=side))


def access_claims(r: Read) -> DataFrame:
    """Offers of special access, one for each kind: a model's first."""
    told = r.items.where("item = 'access'").select("msg_id", order(0, "ord").alias("order"), F.col("said").alias("quote"), "seq", "start", "end", F.lit("model").alias("origin"), "legibility", "kind")
    own = r.hits.where("kind = 'SPECIAL_ACCESS'").select("msg_id", order(1, "seq", "n").alias("order"), "quote", "seq", "start", "end", F.lit("pattern").alias("origin"), "legibility", F.col("attr").alias("kind"))
    return _claims(first_by(told.unionByName(own), ["msg_id", "kind"], ["order"]), "SPECIAL_ACCESS", 6, kind=F.col("kind"))


def behaviours(r: Read) -> DataFrame:
    """Rows (msg_id, pattern_id, kind, quote, seq, start, end, origin): pressure and the like, one for each kind.

    A model's come first, and are borne out by wording of their kind on their line; a handle that is a mobile number
    is a payment to a personal account.
    """
    told = r.items.where("item = 'pressure'").withColumn("kind", identifiers.dimension(PRESSURE)[F.col("kind")]).where("kind IS NOT NULL")
    told = first_by(told, ["msg_id", "kind"], ["ord"])
    own = r.hits.where(F.col("kind").isin(*BEHAVIOUR))
    same = own.select("msg_id", "kind", "seq", "line").distinct().withColumn("backed", F.lit(True))
    told = told.join(same, ["msg_id", "kind", "seq", "line"], "left").select("msg_id", order(0, "ord").alias("order"), "kind", F.col("said").alias("quote"), "seq", "start", "end", F.when(F.col("backed"), "model+pattern").otherwise("model").alias("origin"))
    pattern = own.select("msg_id", order(1, "seq", "n").alias("order"), "kind", "quote", "seq", "start", "end", F.lit("pattern").alias("origin"))
    personal = first_by(spans_of(r, "upi").where("attrs['mobile_based'] = 'true' AND k = 0"), ["msg_id"], ["n"]).select("msg_id", order(2, 0).alias("order"), F.lit("PERSONAL_ACCOUNT_PAYMENT").alias("kind"), F.col("line_text").alias("quote"), "seq", "start", "end", F.lit("pattern").alias("origin"))
    each = first_by(told.unionByName(pattern).unionByName(personal), ["msg_id", "kind"], ["order"])
    n = F.row_number().over(Window.partitionBy("msg_id").orderBy("order"))
    return each.select("msg_id", F.concat(F.lit("pattern-"), n.cast("string")).alias("pattern_id"), "kind", clipped(F.col("quote"), 240).alias("quote"), "seq", "start", "end", "origin")


def build(r: Read, orgs: DataFrame | None = None) -> DataFrame:
    """All claims of what was read, with its organizations() if they are there already: rows (msg_id, claim_id, seq_no, type, quote, seq, start, end, origin, legibility, FIELDS),
    numbered in the order of their types, a model's before those of patterns."""
    orgs = checkpointed(organizations(r)) if orgs is None else orgs

    def of_sender() -> DataFrame:
        registered = checkpointed(registration_claims(r, orgs))
        return registered.unionByName(identity_claims(r, orgs, registered))

    others = (endorsement_claims, return_claims, payment_claims, app_claims, access_claims)
    # Each kind is a table of its own, so that their plans stay small and are made at the same time.
    every, *rest = together(r.segments.sparkSession, lambda: checkpointed(of_sender()), *(lambda f=f: checkpointed(f(r)) for f in others))
    for more in rest:
        every = every.unionByName(more)
    n = F.row_number().over(Window.partitionBy("msg_id").orderBy("group", "a", "b", "c"))
    names = [c.split()[0] for c in FIELDS.split(", ")]
    return every.select("msg_id", F.concat(F.lit("claim-"), n.cast("string")).alias("claim_id"), n.alias("seq_no"), "type", "quote", "seq", "start", "end", "origin", "legibility", *names)

"""Messages as they come in: webhooks, forms, and the readable parts of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsieve.functions import spans, text

#: Characters of a text, parts of a message and media of a form that are taken at most, by the interface's definition.
TEXT_CHARS, PARTS, MEDIA = 20_000, 12, 10
MEDIA_FIELDS = "struct<id string, mime_type string, caption string>"
WEBHOOK = f"""object string, entry array<struct<changes array<struct<field string, value struct<
 metadata struct<phone_number_id string>,
 messages array<struct<id string, `from` string, timestamp string, type string, text struct<body string>, image {MEDIA_FIELDS}, document {MEDIA_FIELDS}, audio {MEDIA_FIELDS},
  button struct<text string>, interactive struct<button_reply struct<title string>, list_reply struct<title string>>, context struct<forwarded boolean, frequently_forwarded boolean>>>,
 statuses array<struct<id string, status string, errors array<struct<code int, title string>>>>>>>>>"""
PART = "array<struct<kind string, text string, url string, blob_ref string>>"


def _changes(payloads: DataFrame, number: str) -> DataFrame:
    own = payloads.select(F.from_json("payload", WEBHOOK).alias("p")).where("p.object = 'whatsapp_business_account'")
    own = own.select(F.explode("p.entry").alias("e")).select(F.explode("e.changes").alias("c")).where("c.field = 'messages'")
    return own.where(F.col("c.value.metadata.phone_number_id") == number).select("c.value.*")


def webhook_messages(payloads: DataFrame, number: str) -> DataFrame:
    """Rows (message_id, user_key, reply_to, text, media, forwarded, frequently_forwarded, received_at) of payloads
    (payload) that chat webhooks sent for this number. Kinds of messages without text or media are left out."""
    m = _changes(payloads, number).select(F.explode("messages").alias("m")).where("m.id <> '' AND m.from <> ''").select("m.*")
    caption = lambda c: F.coalesce(c, F.lit(""))
    words = (
        F.when(F.col("type") == "text", caption(F.col("text.body")))
        .when(F.col("type") == "image", caption(F.col("image.caption")))
        .when(F.col("type") == "document", caption(F.col("document.caption")))
        .when(F.col("type") == "button", caption(F.col("button.text")))
        .when(F.col("type") == "interactive", F.coalesce("interactive.button_reply.title", "interactive.list_reply.title", F.lit("")))
        .otherwise("")
    )
    kinds = {"image": "image/jpeg", "document": "application/octet-stream", "audio": "audio/ogg"}
    each = [F.when((F.col("type") == k) & F.col(f"{k}.id").isNotNull(), F.struct(F.lit("").alias("url"), F.coalesce(F.col(f"{k}.mime_type"), F.lit(mime)).alias("content_type"), F.col(f"{k}.id").alias("media_id"))) for k, mime in kinds.items()]
    media = F.array_compact(F.array(*each))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return m.where((F.trim(words) != "") | (F.size(media) > 0) | (F.col("type") == "text")).select(
        F.col("id").alias("message_id"),
        user_key(F.col("from")).alias("user_key"),
        F.col("from").alias("reply_to"),
        F.substring(words, 1, TEXT_CHARS).alias("text"),
        media.alias("media"),
        flag("context.forwarded").alias("forwarded"),
        flag("context.frequently_forwarded").alias("frequently_forwarded"),
        F.timestamp_seconds(F.col("timestamp").cast("long")).alias("received_at"),
    )


def webhook_statuses(payloads: DataFrame, number: str) -> DataFrame:
    """Rows (id, status, errors) of the deliveries that payloads report for this number."""
    return _changes(payloads, number).select(F.explode("statuses").alias("s")).where("s.id <> '' AND s.status <> ''").select("s.id", "s.status", F.coalesce("s.errors", F.array().cast("array<struct<code int, title string>>")).alias("errors"))


def user_key(sender: Column) -> Column:
    """What a sender is known by: a number's digits, eight at least, else the address as it is."""
    digits = F.regexp_replace(sender, r"\D", "")
    return F.when(F.length(digits) >= 8, F.concat(F.lit("tel:"), digits)).otherwise(F.concat(F.lit("raw:"), sender))


def form_messages(forms: DataFrame) -> DataFrame:
    """Rows like webhook_messages() of forms (body, received_at): bodies of posted forms, names and values encoded."""
    decode = lambda c: F.url_decode(c)
    decoded = F.transform(F.split("body", "&"), lambda p: F.struct(decode(F.split_part(p, F.lit("="), F.lit(1))).alias("key"), decode(F.split_part(p, F.lit("="), F.lit(2))).alias("value")))
    last = spans.let(decoded, lambda pairs: F.filter(pairs, lambda x, i: ~F.array_contains(F.slice(pairs["key"], i + 2, F.size(pairs)), x["key"])))
    f = forms.select(F.map_from_entries(last).alias("f"), "received_at")
    field = lambda name: F.col("f")[name]
    n = F.least(F.coalesce(F.expr("try_cast(f['NumMedia'] AS INT)"), F.lit(0)), F.lit(MEDIA))

    def medium(i: Column) -> Column:
        url = F.col("f")[F.concat(F.lit("MediaUrl"), i.cast("string"))]
        kind = F.coalesce(F.col("f")[F.concat(F.lit("MediaContentType"), i.cast("string"))], F.lit("application/octet-stream"))
        return F.when(F.coalesce(url, F.lit("")) != "", F.struct(url.alias("url"), kind.alias("content_type"), F.element_at(F.split(url, "/"), -1).alias("media_id")))

    none = F.array().cast("array<struct<url string, content_type string, media_id string>>")
    sender = F.coalesce(field("From"), F.lit(""))
    return f.select(
        F.coalesce(field("MessageSid"), field("SmsMessageSid"), F.lit("")).alias("message_id"),
        user_key(F.coalesce(field("WaId"), sender)).alias("user_key"),
        sender.alias("reply_to"),
        F.substring(F.coalesce(field("Body"), F.lit("")), 1, TEXT_CHARS).alias("text"),
        F.when(n > 0, F.array_compact(F.transform(F.sequence(F.lit(0), n - 1), medium))).otherwise(none).alias("media"),
        (F.coalesce(field("Forwarded"), F.lit("")) == "true").alias("forwarded"),
        (F.coalesce(field("FrequentlyForwarded"), F.lit("")) == "true").alias("frequently_forwarded"),
        "received_at",
    )


def valid_parts(parts: Column) -> Column:
    """Whether a message's parts are within the interface's bounds: 1 to 12, texts and addresses of allowed lengths."""
    one = lambda p: F.when(p["kind"] == "text", F.length(p["text"]).between(1, TEXT_CHARS)).when(p["kind"] == "url", F.length(p["url"]).between(4, 2048)).otherwise(p["blob_ref"].isNotNull())
    return F.size(parts).between(1, PARTS) & F.forall(parts, lambda p: F.coalesce(one(p), F.lit(False)))


def segments(messages: DataFrame, readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, unread) of messages (msg_id, parts): a text for each part that can be read.

    Texts are cleaned, addresses trimmed; media have a reading (blob_ref, text, quality, reason) that another step has
    made. Segments are (msg_id, seq, segment_id, kind, text, quality), unread parts (msg_id, seq, kind, reason).
    """
    parts = messages.select("msg_id", F.posexplode("parts").alias("seq", "p")).select("msg_id", "seq", "p.*")
    typed = parts.where("kind IN ('text', 'url')").select("msg_id", "seq", "kind", F.when(F.col("kind") == "url", F.trim("url")).otherwise(text.clean_text(F.col("text"))).alias("text"), F.lit("good").alias("quality"), F.lit("empty").alias("reason"))
    media = parts.where("kind NOT IN ('text', 'url')").drop("text").join(readings, "blob_ref", "left").select("msg_id", "seq", "kind", text.clean_text(F.col("text")).alias("text"), F.coalesce("quality", F.lit("unreadable")).alias("quality"), F.coalesce("reason", F.lit("not_read")).alias("reason"))
    every = typed.unionByName(media)
    there = F.coalesce(F.col("text"), F.lit("")) != ""
    name = F.concat(F.lit("seg-"), (F.col("seq") + 1).cast("string"))
    return every.where(there).select("msg_id", "seq", name.alias("segment_id"), "kind", "text", "quality"), every.where(~there).select("msg_id", "seq", "kind", "reason")

"""Register pages and exports, alert lists and domain records, as given rows or strings, into records."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsieve.functions import domains, text
from proofsieve.session import ship

# What a category's label has in it, in this order; headers of exports.
LABELS = {"research analyst": "RA", "investment advis": "IA", "stock broker": "BROKER", "portfolio manager": "PMS", "merchant banker": "MB", "mutual fund": "MF", "alternative investment": "AIF", "registrar": "RTA", "depository participant": "DP", "debenture trustee": "DT", "kyc": "KRA", "credit rating": "CRA"}
HEADERS = {"Name": "name", "Registration No.": "registration_no", "Contact Person": "contact_person", "Address": "address", "Email-Id": "email", "Telephone": "telephone", "Fax": "fax", "City": "city", "State": "state", "Pincode": "pincode", "From": "valid_from", "To": "valid_to", "Country": "country", "Exchange Name": "exchange_name", "Trade Name": "trade_name"}
CATEGORIES = tuple(LABELS.values())
VOID = frozenset("br hr img input link meta col".split())


def english_date(c: Column) -> Column:
    """The date of `Feb 16, 2023` or `February 16 2023`, of whose month three letters count; else null."""
    found = lambda k: F.regexp_extract(c, r"([A-Za-z]{3})[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})", k)
    return F.try_to_timestamp(F.nullif(F.concat_ws(" ", F.initcap(found(1)), F.nullif(found(2), F.lit("")), F.nullif(found(3), F.lit(""))), F.lit("")), F.lit("MMM d yyyy")).cast("date")


def validity(c: Column) -> Column:
    """Struct (valid_from, valid_to) of `A - B`; no end if it is perpetual."""
    parts = F.split(c, r"\s+-\s+")
    until = F.get(parts, F.lit(1))
    return F.struct(english_date(F.get(parts, F.lit(0))).alias("valid_from"), F.when(~F.lower(until).contains("perpetual"), english_date(until)).alias("valid_to"))


def category_of(label: Column) -> Column:
    low, found = F.lower(label), None
    for words, code in LABELS.items():
        found = F.when(low.contains(words), code) if found is None else found.when(low.contains(words), code)
    return found


def split_list(*cols: Column) -> Column:
    """The parts of all columns between commas, semicolons and slashes, each once, in their order."""
    every = F.flatten(F.array(*(F.split(F.coalesce(c, F.lit("")), r"[,;/]\s*") for c in cols)))
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x != ""))


def emails_of(*cols: Column) -> Column:
    return F.transform(F.filter(split_list(*cols), lambda x: x.contains("@")), F.lower)


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def records_of_rows(rows: DataFrame, category: str | None = None) -> DataFrame:
    """Register records of an export's rows, whose columns have the names of HEADERS' values, those of the
    correspondence address with corr_ before; missing columns count as blank. Rows without a number are left out."""
    col = lambda name: text.clean_text(F.coalesce(F.col(name), F.lit(""))) if name in rows.columns else F.lit("")
    name, trade = col("name"), col("trade_name")
    one = lambda c: F.when(c != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    parts = F.filter(F.array(col("address"), col("city"), col("state"), col("pincode")), lambda p: p != "")
    out = rows.select(
        F.upper(F.regexp_replace(col("registration_no"), r"\s+", "")).alias("registration_no"),
        (F.lit(category) if category else F.col("category")).alias("category"),
        one(name).alias("names"),
        F.when(F.lower(trade) != F.lower(name), one(trade)).otherwise(F.array().cast("array<string>")).alias("trade_names"),
        filled(col("contact_person")).alias("contact_person"),
        emails_of(col("email"), col("corr_email")).alias("emails"),
        split_list(col("telephone"), col("corr_telephone")).alias("phones"),
        filled(F.array_join(parts, ", ")).alias("address"),
        F.coalesce(filled(col("city")), filled(col("corr_city"))).alias("city"),
        F.coalesce(filled(col("state")), filled(col("corr_state"))).alias("state"),
        english_date(col("valid_from")).alias("valid_from"),
        F.when(~F.lower(col("valid_to")).contains("perpetual"), english_date(col("valid_to"))).alias("valid_to"),
        one(col("exchange_name")).alias("exchanges"),
        *(F.col(c) for c in ("ord",) if c in rows.columns),
    )
    return out.where("registration_no <> ''")


def header_keys(groups: list[str], headers: list[str]) -> list[str]:
    """Column names of an export by the two rows of its header: a group counts until the next, or until both are blank."""
    keys, group = [], ""
    for k, h in enumerate(headers):
        g, h = (groups[k] if k < len(groups) else "").strip(), h.strip()
        group = g or (group if h else "")
        base = HEADERS.get(h) or re.sub(r"\W+", "_", h.lower())
        keys.append(f"corr_{base}" if "correspondence" in group.lower() and base != "name" else base)
    return keys


def rows_of_sheets(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(titles, rows) of sheets given as cells (sheet, row, values array<string>), as readers of spreadsheets give them.

    Row 0 has the title with its date (sheet, title, as_of), rows 1 and 2 the header, others are data: rows
    (sheet, row, fields map). The header of each sheet is named in a task and joined with the rows.
    """
    ship(cells.sparkSession)
    title = F.trim(F.get("values", F.lit(0)))
    titles = cells.where("row = 0").select("sheet", title.alias("title"), english_date(F.regexp_extract(title, r"(?i)as on\s+(.+)$", 1)).alias("as_of"))

    @F.pandas_udf("array<string>")
    def named(groups: pd.Series, headers: pd.Series) -> pd.Series:
        none = lambda x: [] if x is None else [v or "" for v in x]
        return pd.Series([header_keys(none(g), none(h)) for g, h in zip(groups, headers)], dtype=object)

    head = cells.where("row IN (1, 2)").groupBy("sheet").agg(F.max(F.when(F.col("row") == 1, F.col("values"))).alias("g"), F.max(F.when(F.col("row") == 2, F.col("values"))).alias("h"))
    keys = head.select("sheet", named("g", "h").alias("keys"))
    value = lambda k, i: F.struct(k.alias("key"), F.coalesce(F.get("values", i), F.lit("")).alias("value"))
    last = lambda pairs: F.filter(pairs, lambda x, i: F.forall(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] != x["key"]))
    pairs = cells.where("row > 2").join(keys, "sheet").select("sheet", "row", F.transform("keys", value).alias("p"))
    return titles, pairs.select("sheet", "row", F.map_from_entries(last(F.col("p"))).alias("fields"))


class _Tree(HTMLParser):
    """Nodes [tag, classes, children] of a page; texts are strings."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", set(), []]
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = [tag, set((dict(attrs).get("class") or "").split()), []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k][0] == tag), None)
        if at:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        self.open[-1][2].append(data)


def _every(node: list, wanted) -> list:
    """Elements below that are wanted, in the order of the page."""
    out, stack = [], [*reversed(node[2])]
    while stack:
        c = stack.pop()
        if not isinstance(c, str):
            if wanted(c):
                out.append(c)
            stack += reversed(c[2])
    return out


def _text(node) -> str:
    out, stack = [], [node]
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            out.append(c)
        else:
            stack += reversed(c[2])
    return "".join(out)


def _plain(node) -> str:
    return " ".join(_text(node).split()) if node is not None else ""


def cards_of(page: str) -> tuple[int, list[dict[str, str]]]:
    """(total, cards) of a listing: of each card the values by their labels, of which the first counts."""
    tree = _Tree(page).root
    cards = []
    for table in _every(tree, lambda n: {"fixed-table-body", "card-table"} <= n[1]):
        card: dict[str, str] = {}
        for view in _every(table, lambda n: "card-view" in n[1]):
            part = lambda name: next((s for box in _every(view, lambda n: name in n[1]) for s in _every(box, lambda n: n[0] == "span")), None)  # noqa: B023, E731
            label = _plain(part("title"))
            if label:
                card.setdefault(label, _plain(part("value")))
        if card.get("Registration No."):
            cards.append(card)
    whole = _text(tree)
    m = re.search(r"(\d+)\s+to\s+(\d+)\s+of\s+(\d+)\s+records", whole)
    return int(m[3]) if m else 0 if "no record(s) available" in whole.lower() else len(cards), cards


def cards(page: Column) -> Column:
    """Struct (total, cards array<map>) of a listing page."""
    ship(SparkSession.active())

    @F.pandas_udf("total int, cards array<map<string,string>>")
    def parsed(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(n, found) for n, found in (cards_of(p or "") for p in pages)], columns=["total", "cards"])

    return parsed(page)


def records_of_cards(pages: DataFrame, fallback: str | None = None) -> DataFrame:
    """Register records of listing pages (page_id, html); a card's type names its category, else `fallback` does."""
    c = F.col("card")
    every = pages.select("page_id", F.posexplode(cards(F.col("html"))["cards"]).alias("ord", "card"))
    parts = F.filter(F.transform(F.split(F.coalesce(c["Address"], F.lit("")), ","), lambda x: F.trim(x)), lambda p: p != "")
    when = validity(c["Validity"])
    one = lambda x: F.when(F.coalesce(x, F.lit("")) != "", F.array(x)).otherwise(F.array().cast("array<string>"))
    out = every.select(
        "page_id",
        "ord",
        F.upper(F.regexp_replace(c["Registration No."], r"\s+", "")).alias("registration_no"),
        F.coalesce(category_of(c["Type"]), F.lit(fallback)).alias("category"),
        one(c["Name"]).alias("names"),
        F.when(F.coalesce(F.lower(c["Trade Name"]) != F.lower(F.coalesce(c["Name"], F.lit(""))), F.lit(False)), one(c["Trade Name"])).otherwise(F.array().cast("array<string>")).alias("trade_names"),
        filled(c["Contact Person"]).alias("contact_person"),
        emails_of(c["E-mail"], c["Correspondence E-mail"]).alias("emails"),
        split_list(c["Telephone"], c["Correspondence Telephone"]).alias("phones"),
        filled(c["Address"]).alias("address"),
        F.when(F.size(parts) >= 3, F.element_at(parts, -3)).alias("city"),
        F.when(F.size(parts) >= 2, F.element_at(parts, -2)).alias("state"),
        when["valid_from"].alias("valid_from"),
        when["valid_to"].alias("valid_to"),
        one(c["Exchange Name"]).alias("exchanges"),
    )
    return out.where("registration_no <> '' AND category IS NOT NULL")


def inactive_of_cards(pages: DataFrame) -> DataFrame:
    """Rows (registration_no, name, category_label, status) of the cards of pages (page_id, html) that have a status."""
    c = F.col("card")
    every = pages.select(F.explode(cards(F.col("html"))["cards"]).alias("card"))
    blank = lambda x: F.coalesce(x, F.lit(""))
    return every.where(F.coalesce(c["Status"], F.lit("")) != "").select(F.upper(c["Registration No."]).alias("registration_no"), blank(c["Name"]).alias("name"), blank(c["Type"]).alias("category_label"), c["Status"].alias("status"))


def table_rows(page: str) -> tuple[str, list[tuple[str, str]]]:
    """(text, rows) of a page with tables of names and websites: of their rows the second and third cells."""
    tree = _Tree(page).root
    found = []
    for table in _every(tree, lambda n: n[0] == "table"):
        rows = _every(table, lambda n: n[0] == "tr")
        head = _text(rows[0]).lower() if rows else ""
        if "name" in head and "website" in head:
            for row in rows[1:]:
                cells = [_plain(c) for c in _every(row, lambda n: n[0] == "td")]
                if len(cells) >= 3 and cells[1]:
                    found.append((cells[1], cells[2]))
    return " ".join(_text(tree).split()), found


def alert_entries(pages: DataFrame) -> DataFrame:
    """Rows (page_id, as_of, ord, name, websites, domains) of alert lists (page_id, html)."""
    ship(pages.sparkSession)

    @F.pandas_udf("whole string, rows array<struct<name string, sites string>>")
    def parsed(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(t, [{"name": a, "sites": b} for a, b in rows]) for t, rows in (table_rows(p or "") for p in column)], columns=["whole", "rows"])

    as_of = english_date(F.regexp_extract("p.whole", r"(?i)updated\s+as\s+on\s+([A-Za-z]+\s+\d{1,2},?\s+\d{4})", 1))
    rows = pages.select("page_id", parsed("html").alias("p")).select("page_id", as_of.alias("as_of"), F.posexplode("p.rows").alias("ord", "r"))
    sites = F.filter(F.split("r.sites", r"[\s,;]+"), lambda w: w.rlike(r"(?i)\.[a-z]{2,}"))
    rows = rows.select("page_id", "as_of", "ord", F.col("r.name").alias("name"), sites.alias("websites"))
    hosts = rows.select("page_id", "ord", F.posexplode("websites").alias("k", "site")).select("page_id", "ord", "k", domains.registrable_domain(F.split_part(F.regexp_replace("site", r"(?i)^https?://", ""), F.lit("/"), F.lit(1))).alias("domain"))
    named = hosts.where("domain IS NOT NULL").groupBy("page_id", "ord").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("k", "domain"))), lambda x: x["domain"])).alias("domains"))
    return rows.join(named, ["page_id", "ord"], "left").select("page_id", "as_of", "ord", "name", "websites", F.coalesce("domains", F.array().cast("array<string>")).alias("domains"))


def domain_record(json: Column) -> Column:
    """Struct (registered_on, registrar) of a domain's record in JSON."""
    r = F.from_json(json, "events array<struct<eventAction string, eventDate string>>, entities array<struct<roles array<string>, vcardArray array<string>>>")
    event = F.get(F.filter(r["events"], lambda e: e["eventAction"] == "registration"), F.lit(0))["eventDate"]
    registrar = F.get(F.filter(r["entities"], lambda e: F.array_contains(e["roles"], "registrar")), F.lit(0))
    fields = F.from_json(F.get(registrar["vcardArray"], F.lit(1)), "array<array<string>>")
    name = F.get(F.get(F.filter(fields, lambda f: F.get(f, F.lit(0)) == "fn"), F.lit(0)), F.lit(3))
    return F.struct(F.try_to_timestamp(event).alias("registered_on"), filled(name).alias("registrar"))

"""Made-up sources for development: a few records, an entry of an alert list, domains. Whatever rests on them says so."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from proofsieve.operators.investigate import AGES, ALERTS, REGISTER, Sources

RECORD = "registration_no string, category string, category_label string, names array<string>, trade_names array<string>, contact_person string, emails array<string>, phones array<string>, address string, city string, exchanges array<string>, valid_from date, valid_to date, source_url string, ord long"
ACCESS = "source string, up boolean, mode string, as_of date, retrieved_at timestamp, stale boolean, fixture boolean"
AT = "https://register.example/listing"
#: Firms that don't exist.
RECORDS = [
    ("INH000099991", "RA", "Research Analyst", ["ABC RESEARCH PRIVATE LIMITED"], [], "Anita Rao", ["compliance@abcresearch.in"], ["02041234567"], "12 MG Road, PUNE, MAHARASHTRA, 411001", "PUNE", [], dt.date(2021, 5, 3), None),
    ("INH000099993", "RA", "Research Analyst", ["RAHUL KUMAR SHARMA (Proprietor: Bull Insights)"], [], None, ["rahul.bullinsights@gmail.com"], ["9876500001"], "Indore, MADHYA PRADESH, 452001", "INDORE", [], dt.date(2022, 1, 10), None),
    ("INZ000099992", "BROKER", "Stock Broker", ["ZENITH BROKING LIMITED"], ["ZENITH"], None, ["support@zenithbroking.com"], ["02240001234"], "Lower Parel, MUMBAI, MAHARASHTRA, 400013", "MUMBAI", ["NATIONAL STOCK EXCHANGE OF INDIA LTD"], dt.date(2015, 9, 30), None),
    ("INA000099994", "IA", "Investment Adviser", ["OLD ADVISORY SERVICES LLP"], [], None, [], [], None, "DELHI", [], dt.date(2016, 1, 1), dt.date(2021, 12, 31)),
]
INACTIVE = [("INH000099990", "XYZ ADVISORY", "Research Analyst", "Cancelled", AT)]
ALERTED = [("Quick FX Markets", ["www.quick-fx-markets.com"], ["quick-fx-markets.com"], AT)]
COVERED = ("RA", "IA", "BROKER", "PMS")


def records(spark: SparkSession, rows: Iterable[tuple] = RECORDS) -> DataFrame:
    return spark.createDataFrame([(*r, AT, k) for k, r in enumerate(rows)], RECORD)


def fixture_sources(spark: SparkSession, more: Iterable[tuple] = (), domains: dict[str, str] | None = None, down: Iterable[str] = (), fixture: bool = True, stale: bool = False) -> Sources:
    """Sources over the made-up records and `more` of them; domains are registered on the days given, others not known."""
    day, loaded = dt.date(2026, 10, 3), dt.datetime(2026, 10, 4, 2, 0)
    access = [(name, name not in down, "live" if name == AGES else "snapshot", None if name == AGES else day, loaded, stale, fixture) for name in (REGISTER, ALERTS, AGES)]
    ages = [(d, "found", dt.datetime.fromisoformat(since), "Example Registrar", f"https://rdap.example/{d}") for d, since in (domains or {}).items()]
    return Sources(
        records(spark, [*RECORDS, *more]),
        spark.createDataFrame(INACTIVE, "registration_no string, name string, category_label string, status string, source_url string"),
        spark.createDataFrame(ALERTED, "name string, websites array<string>, domains array<string>, list_url string"),
        spark.createDataFrame(ages, "domain string, status string, registered_on timestamp, registrar string, rdap_url string"),
        spark.createDataFrame([(c,) for c in COVERED], "category string"),
        spark.createDataFrame(access, ACCESS),
    )

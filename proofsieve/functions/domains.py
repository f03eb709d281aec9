"""Registrable domains by the public suffix list that comes with Spark."""

from __future__ import annotations

import os
import zipfile
from functools import cache
from pathlib import Path

import pandas as pd
import pyspark
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from proofsieve.session import ship

LIST = "mozilla/public-suffix-list.txt"


@cache
def suffix_rules() -> dict[str, bool]:
    """The rules of the list for public registries, without its private part; True for exceptions."""
    home = Path(os.environ.get("SPARK_HOME") or pyspark.__path__[0])
    jar = sorted((home / "jars").glob("httpclient-4*.jar"))[0]
    with zipfile.ZipFile(jar) as z:
        text = z.read(LIST).decode("utf-8")
    rules = {}
    for line in text.split("===END ICANN DOMAINS===")[0].split("\n"):
        rule = line.strip()
        if rule and not rule.startswith("//"):
            rules[rule.lstrip("!")] = rule.startswith("!")
    return rules


def split_host(host: str | None, rules: dict[str, bool]) -> tuple[str, str, bool] | None:
    """(registrable domain, its label, whether its suffix is known) of a host; null for addresses and suffixes alone."""
    labels = (host or "").strip().strip(".").lower().split(".")
    if len(labels) < 2 or not all(labels) or all(x.isdigit() for x in labels) or ":" in labels[-1]:
        return None
    size, known = 1, labels[-1] in rules
    for k in range(len(labels)):
        rest = labels[k:]
        name, wild = ".".join(rest), ".".join(["*", *rest[1:]])
        if rules.get(name):  # an exception: its suffix is one label shorter
            size, known = len(rest) - 1, True
            break
        if name in rules or (len(rest) > 1 and wild in rules):
            size, known = len(rest), True
            break
    if len(labels) <= size:
        return None
    return ".".join(labels[-size - 1 :]), labels[-size - 1], known


def domain_parts(host: Column) -> Column:
    """Struct (domain, label, known) of the registrable domain of a host, or null."""
    spark = SparkSession.active()
    ship(spark)
    rules = spark.sparkContext.broadcast(suffix_rules())  # some thousand rules

    @F.pandas_udf("domain string, label string, known boolean")
    def parts(hosts: pd.Series) -> pd.DataFrame:
        found = {h: split_host(h, rules.value) or (None, None, None) for h in set(hosts)}
        return pd.DataFrame([found[h] for h in hosts], columns=["domain", "label", "known"])

    return parts(host)


def registrable_domain(host: Column) -> Column:
    return domain_parts(host)["domain"]

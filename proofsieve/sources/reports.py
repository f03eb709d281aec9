"""Reports on disk: views of investigations as JSON, held against what a report has to be before they are kept.

The folder is partitioned by batch; a batch that is stored again takes the place of what it left. Reports that are not as they
should be lie beside it with what is wrong. Of a message that several batches have, the last one counts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsieve.functions import catalog
from proofsieve.operators import adjudicate, report
from proofsieve.session import checkpointed

STATUSES = tuple(k.removeprefix("bstatus.") for k in catalog.WORDS if k.startswith("bstatus."))
REPORT = "msg_id long, report string, batch string"


def _each(items: Column, name: str, id_: str, wrong: list[tuple[str, object]]) -> Column:
    """What is wrong with items of an array of structs, each told by its id."""
    told = lambda x: F.array_compact(F.array(*(F.when(F.coalesce(test(x), F.lit(True)), F.concat(F.lit(f"{name}."), F.coalesce(x[id_], F.lit("?")), F.lit(f": {what}"))) for what, test in wrong)))
    return F.coalesce(F.flatten(F.transform(items, told)), F.array().cast("array<string>"))


def problems(views: DataFrame) -> Column:
    """Array of what is wrong with a row of render.views()."""
    c = F.col
    size = lambda name: F.coalesce(F.size(name), F.lit(0))
    repeated = lambda name, id_: F.when(F.size(F.array_distinct(F.transform(name, lambda x: x[id_]))) < F.size(name), f"{name}: an id twice")
    told = F.aggregate(F.array(*(c("counts")[v.lower()] for v in adjudicate.VERDICTS)), F.lit(0).cast("long"), lambda a, b: a + b)
    known = F.create_map(*(F.lit(x) for code in catalog.HEADLINES for x in (code, True)))
    whole = [
        F.when(c("msg_id").isNull(), "msg_id: missing"),
        F.when(F.coalesce(known[c("headline_code")], F.lit(False)) & (c("headline") != ""), None).otherwise("headline: unknown"),
        F.when(told != size("claims"), "counts: not as many as claims"),
        repeated("claims", "claim_id"),
        repeated("findings", "id"),
        F.when(size("steps") == 0, "steps: missing"),
    ]
    cited = lambda x: F.coalesce(F.size(x["evidence"]), F.lit(0)) + F.coalesce(F.size(x["rules"]), F.lit(0))
    parts = [
        _each(c("claims"), "claims", "claim_id", [("no verdict", lambda x: ~x["verdict"].isin(*adjudicate.VERDICTS)), ("no statement", lambda x: x["statement"] == ""), ("contradicted without evidence", lambda x: (x["verdict"] == "CONTRADICTED") & (cited(x) == 0))]),
        _each(c("findings"), "findings", "id", [("no severity", lambda x: ~x["severity"].isin(*report.SEVERITIES)), ("no text", lambda x: x["text"] == "")]),
        _each(c("bindings"), "bindings", "id", [("no status", lambda x: F.exists(x["rows"], lambda r: ~r["status"].isin(*STATUSES))), ("no record", lambda x: x["registration_no"].isNull())]),
    ]
    return F.concat(F.array_compact(F.array(*whole)), *parts)


def rejected(path: str) -> str:
    return path.rstrip("/") + "_rejected"


def store(path: str, views: DataFrame, batch: str) -> DataFrame:
    """Writes a batch of views; returns one row (batch, stored, rejected)."""
    judged = checkpointed(views.select("msg_id", problems(views).alias("problems"), report.as_json(views).alias("report"), F.lit(batch).alias("batch")))
    put = lambda rows, to: rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(to)
    put(judged.where(F.size("problems") == 0).select("msg_id", "report", "batch"), path)
    put(judged.where(F.size("problems") > 0), rejected(path))
    return judged.agg(F.lit(batch).alias("batch"), F.count_if(F.size("problems") == 0).alias("stored"), F.count_if(F.size("problems") > 0).alias("rejected"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """Rows (msg_id, report, batch): the last report of each message, by the names of batches."""
    try:
        rows = spark.read.schema(REPORT).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], REPORT)
    return rows.groupBy("msg_id").agg(F.max_by(F.struct("report", "batch"), "batch").alias("x")).select("msg_id", "x.report", "x.batch")

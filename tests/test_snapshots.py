import datetime as dt

import pytest
from pyspark.sql import functions as F

from proofsieve.sources import snapshots

SCHEMA = "source string, category string, registration_no string, name string, note string"
DAY = [dt.datetime(2026, 10, k, 12) for k in range(1, 6)]


def frame(spark, rows):
    return spark.createDataFrame([("reg", *r) for r in rows], SCHEMA)


def state(spark, table):
    rows = snapshots.entries(spark, table, spark.createDataFrame([], SCHEMA).schema).collect()
    return {(r.category, r.registration_no): (r.name, r.batch, r.first_seen_at.day, r.last_seen_at.day) for r in rows}


def load(spark, table, rows, batch, day):
    got = snapshots.replace(table, frame(spark, rows), batch, F.lit(DAY[day]))
    return {r.category: (r.inserted, r.updated, r.kept, r.removed) for r in got.collect()}


def test_categories_are_replaced(spark, tmp_path):
    table = str(tmp_path / "register")
    one = [("RA", "1", "a", None), ("RA", "2", "b", "x"), ("IA", "1", "c", None), ("IA", "9", "gone", None)]
    assert load(spark, table, one, "b1", 0) == {"RA": (2, 0, 0, 0), "IA": (2, 0, 0, 0)}
    assert load(spark, table, [("RA", "1", "a", None), ("RA", "2", "new", "x"), ("RA", "3", "d", None), ("RA", "3", "d", None)], "b2", 1) == {"RA": (1, 1, 1, 0)}
    assert state(spark, table) == {("RA", "1"): ("a", "b2", 1, 2), ("RA", "2"): ("new", "b2", 1, 2), ("RA", "3"): ("d", "b2", 2, 2), ("IA", "1"): ("c", "b1", 1, 1), ("IA", "9"): ("gone", "b1", 1, 1)}
    assert load(spark, table, [("IA", "1", "c", None)], "b3", 2) == {"IA": (0, 0, 1, 1)}
    before = state(spark, table)
    assert ("IA", "9") not in before and before["IA", "1"] == ("c", "b3", 1, 3)
    assert load(spark, table, [("IA", "1", "other", None)], "b3", 4) == {"IA": (0, 0, 1, 1)}  # the batch is known
    assert state(spark, table) == before and snapshots.batches(spark, table).count() == 4
    snapshots.forget(spark, table)
    assert state(spark, table) == {}


def test_runs_that_fail_leave_a_right_table(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "register")
    load(spark, table, [("RA", "1", "a", None)], "b1", 0)
    bad = frame(spark, [("RA", "1", "a", None), ("RA", "2", "b", "1")]).withColumn("note", F.when(F.col("registration_no") == "2", F.raise_error(F.lit("broken"))).otherwise(F.col("note")))
    with pytest.raises(Exception, match="broken"):
        snapshots.replace(table, bad, "b2", F.lit(DAY[1]))
    assert state(spark, table) == {("RA", "1"): ("a", "b1", 1, 1)}
    frames = type(spark.range(1))
    real = frames.write.fget

    class Stops:
        def __init__(self, writer):
            self.writer = writer

        def mode(self, name):
            if name == "append":
                raise RuntimeError("the log can't be written")
            return self.writer.mode(name)

    monkeypatch.setattr(frames, "write", property(lambda df: Stops(real(df))))
    rows = [("RA", "1", "A", None), ("RA", "2", "b", None)]
    with pytest.raises(RuntimeError):
        load(spark, table, rows, "b2", 1)
    monkeypatch.undo()
    assert load(spark, table, rows, "b2", 1)["RA"][3] == 0  # runs again, on what the first run has written
    assert state(spark, table) == {("RA", "1"): ("A", "b2", 1, 2), ("RA", "2"): ("b", "b2", 2, 2)}

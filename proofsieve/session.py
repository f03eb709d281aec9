"""What every job needs from its session: shared storage, shipped code and size-checked broadcasts."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a broadcast may hold, and what each row takes besides its values; larger sides are shuffled.
BROADCAST_BYTES, ROW_BYTES = 64_000_000, 32

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints; one of our own only where the session names none: beside the warehouse, if that is
    in a store that all machines see, or of this machine, if there is no other."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if sc.master.startswith("local[") or sc.master == "local":
            own = tempfile.mkdtemp(prefix="proofsieve-")
        else:
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            if "://" not in warehouse or warehouse.startswith("file:"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster see")
            own = warehouse.rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with a copy in the shared folder, which outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def together(spark: SparkSession, *jobs: Callable[[], Any]) -> list[Any]:
    """The results of jobs that need nothing of each other. They run at the same time, so that small ones and the planning of
    any don't leave the cluster idle."""
    shared_dir(spark)
    ship(spark)
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a file of that name to a folder of its own in the shared folder, and returns its path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_path(spark, 'file')}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path.toString()


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that shared_path() has named."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def ship(spark: SparkSession) -> None:
    """Sends the package's code to the executors once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"{root.name}/{path.relative_to(root)}")
    spark.sparkContext.addPyFile(shared_file(spark, f"{root.name}.zip", packed.getvalue()))
    _shipped.add(app)


def small_side(df: DataFrame, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a side for broadcast if its rows take no more than so many bytes, written out; else leaves it to a shuffle."""
    own = F.octet_length(F.to_json(F.struct("*"))) + ROW_BYTES
    return F.broadcast(df) if (df.agg(F.sum(own)).first()[0] or 0) <= size else df

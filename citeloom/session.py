"""Session plumbing: shipping the package to executors and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that UDFs import it there, and bound the
    batches that go to Python: texts are long, and the defaults of 10,000 rows and 64 MB are meant for narrow
    ones. Settings that the session has changed itself stay as they are."""
    app = spark.sparkContext.applicationId
    for name, default, ours in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", "67108864b", "4m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", default).rstrip("b") == default.rstrip("b"):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", ours)
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="citeloom-"), "citeloom.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none, a folder of this machine serves if all tasks run in this process;
    on a cluster its executors could not see each other's files, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.gettempdir()}/citeloom-shared"
    return named.rstrip("/")


_written: dict[str, list[str]] = {}


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return the reread table: lineage ends here,
    so a lost executor costs a reread and not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/citeloom-{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """Tables that settle() has written in this application and that were not removed."""
    return list(_written.get(spark.sparkContext.applicationId, ()))


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables of settle() that nothing reads any more."""
    held = _written.get(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        held.remove(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when a small file gives fewer partitions than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Tasks for each one that reads the input.
DEALT = 8


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to a number of tasks that grows with the input, so that what one task holds does not. df is a table as
    read, as counting the tasks of a plan with joins would run it."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), DEALT * df.rdd.getNumPartitions())
    return df.repartition(n, *keys)

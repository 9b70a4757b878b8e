"""Staging of intermediate tables and small helpers shared by the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: list[str] = []

#: The ASCII white space that separates words: space and \x09 to \x0D.
WHITESPACE = b" \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one that ``spark.checkpoint.dir`` names. Where that is unset, a local master gets
    a temporary folder and a cluster gets a folder in its warehouse, which is shared as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        if not _LOCAL_ROOT:
            _LOCAL_ROOT.append("file://" + tempfile.mkdtemp(prefix="gleanery-"))
        return _LOCAL_ROOT[0]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path below shared_root(), removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/gleanery-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have at most 1000 rows and 4 MB or one row.

    Texts pass to Python tasks in such batches; both the JVM and Python hold some at a time.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)
    return df


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, whatever store it is in."""
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended already; the folder is temporary
        pass


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage and keeps what was computed when executors are lost; each later read
    sees the same rows.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_alone(df: DataFrame, label: str) -> DataFrame:
    """As staged(), and what was shuffled for it goes when it is written, not when the driver collects garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return staged(df, label)
    finally:
        conf.set(key, before)


def unstaged(*tables: DataFrame) -> None:
    """Delete what staged() wrote for tables that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prefixed(df: DataFrame, *names: str) -> dict[str, str]:
    """Column names that the input does not have yet, one for each given name."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in names:
        new = name
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out[name] = new
    return out


def unsigned_hex(col) -> "F.Column":
    """16 lowercase hex digits of a long."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))

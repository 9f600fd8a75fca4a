"""Session defaults and the two things every operator needs from it: table loading and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(name: str = "siltstone", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's defaults; ``extra`` holds further settings with ``__`` for ``.``."""
    builder = SparkSession.builder.appName(name).config(map=DEFAULTS | {k.replace("__", "."): v for k, v in extra.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def load(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{root.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one of our own where that is unset (tests)."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Materialise a DataFrame in the shared folder, so that a lost executor never forces its lineage to run again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The DataFrame as a table written to the shared folder: like ``cut``, but compressed and read by columns.

    For intermediate rows that several steps read. The table is deleted when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a table's few files would leave some idle; larger tables stay as they are read.

    At most one scan partition per core is moved, so the shuffle has a bound that doesn't grow with the table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parallelism(spark: SparkSession) -> int:
    """The number of reduce tasks that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

"""Session building and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_cuts: list[str] = []


def local_session(app: str = "corpusloom", cpus: int | str = 8, **conf) -> SparkSession:
    """A session for tests and local benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CORPUSLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would be lost together with its executor.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    current = context.getCheckpointDir()
    if current is not None:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files.

    Unlike a checkpoint of rows, the table keeps its columns apart, so that
    later steps read only what they use, and its size is known to the planner.
    ``codec`` names a Parquet compression other than the session's.
    """
    path = scratch_path(df.sparkSession, "cut")
    _cuts.append(path)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> int:
    """Delete the tables :func:`cut_lineage` wrote for this process.

    For long-running applications, once the results that read them are stored.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    dropped = 0
    while _cuts:
        path = jvm.org.apache.hadoop.fs.Path(_cuts.pop())
        dropped += bool(path.getFileSystem(conf).delete(path, True))
    return dropped


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

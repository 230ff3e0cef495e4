"""Session factory and table access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(cores: int = 8, app: str = "derlem", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` (a file or a folder of files) below ``sf_dir``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give less than half of them something to do.

    A table of one small file is one task however long its texts take. Tables of many files stay
    as they are, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if have * 2 < cores else df


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints that every executor can read.

    Taken from ``spark.checkpoint.dir``; where that is unset, as in local tests, a temporary
    folder of this machine is set once for the session and removed with it.
    """
    sc = spark.sparkContext
    got = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        got = tempfile.mkdtemp(prefix="derlem-")
        atexit.register(shutil.rmtree, got, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(got)
    return got


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

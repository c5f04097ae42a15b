"""Session set-up, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", checkpoint_dir: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that every plan of this package assumes.

    ``checkpoint_dir`` is a folder that all executors share; it is needed on a
    cluster unless ``spark.checkpoint.dir`` is set there.
    """
    b = (
        SparkSession.builder.master(master)
        .appName("refloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    if checkpoint_dir:
        b = b.config("spark.checkpoint.dir", checkpoint_dir)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(df: DataFrame, waves: int = 2) -> int:
    """Partitions for a stage bound by CPU: the session's shuffle partitions, but at least ``waves`` for each task slot."""
    s = df.sparkSession
    return max(int(s.conf.get("spark.sql.shuffle.partitions")), waves * s.sparkContext.defaultParallelism)


def spread(df: DataFrame, waves: int = 2) -> DataFrame:
    """Redistribute a plan in front of a Python stage, unless it is a scan with a split for each task slot.

    Python stages are bound by CPU, so a table read in few splits, or an
    exchange that adaptive execution would coalesce by bytes, would leave
    executors idle. Only the splits of a plan without an exchange are looked
    at; asking a plan with one would run its shuffles.
    """
    q = df._jdf.queryExecution()
    if q.executedPlan().getClass().getSimpleName() != "AdaptiveSparkPlanExec" and q.toRdd().getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(width(df, waves))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the session; a folder of this machine only where the whole session runs on it."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "refloom-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and drop the lineage; the files survive the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def records(df: DataFrame, key: str) -> DataFrame:
    """One row for each record id, in partitions wide enough for a Python stage.

    The rows are hashed by the id once; the aggregate that drops re-delivered
    rows and the stage behind it use that one exchange. Of rows that differ
    (they differ at most in their time of loading) any one is kept.
    """
    return df.repartition(width(df), key).dropDuplicates([key])


"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "metaquarry", master: str | None = None, **conf) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller's own session is used."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session may fall back to a machine-local folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = tempfile.mkdtemp(prefix="metaquarry-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def new_run_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/metaquarry/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a result used several times is computed once and
    survives the loss of executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def store(df: DataFrame, label: str) -> DataFrame:
    """Write rows to the shared folder and read them back: for many narrow rows that are used
    several times, compressed where a checkpoint is not."""
    path = new_run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Inputs below this size per core (and in all) may sit in fewer file splits than cores.
SPREAD_BYTES_PER_CORE, SPREAD_BYTES = 32 << 20, 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """Give a small input as many partitions as there are cores before costly work per row.

    A small file is one split, so one task would do all the work. Large inputs come in
    enough splits and are returned as they are, without a shuffle. So are rows whose inputs
    were all spread before: what was made of them may be far larger than the input.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.toString().count("Repartition ") >= plan.collectLeaves().size():
        return df
    size = int(plan.stats().sizeInBytes())
    return df.repartition(cores) if size < min(cores * SPREAD_BYTES_PER_CORE, SPREAD_BYTES) else df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Not needed where the package is installed on all nodes or passed with --py-files.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root, name = os.path.split(package)
    base = os.path.join(tempfile.mkdtemp(prefix="metaquarry-"), name)
    sc.addPyFile(shutil.make_archive(base, "zip", root, name))
    _SHIPPED.add(sc.applicationId)

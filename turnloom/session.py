"""Session settings, and the shared folder where long lineages are cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int | None = None, app: str = "turnloom") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own settings."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.files.maxPartitionBytes", "4m")  # small tables still use all cores
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; a scratch one only in local mode where none is set, as in tests.

    Off local mode a folder of one machine is of no use to the others, so a missing setting is an error there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not is_local(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="turnloom-"))
    return context.getCheckpointDir()


def is_local(master: str) -> bool:
    """One process, one machine: local, local[n] or local[n, m]; not local-cluster."""
    return master == "local" or master.startswith("local[")


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write the frame once to the checkpoint folder and read on from there."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write the frame as a table to the checkpoint folder and read on from there, so that the planner knows its size."""
    path = f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def shuffled(frame: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is never broadcast.

    The planner goes by compressed sizes; rows of few values take twenty times as much in the driver's memory.
    """
    return frame.hint("merge")

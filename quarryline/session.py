"""Session settings and lineage cutting that behave alike locally and on a cluster."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUARRYLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of df with checkpoint() in the folder that the session names.

    spark.checkpoint.dir is the shared folder of the cluster. Only where it is unset in a local session,
    as in tests, a temporary folder is set; a cluster without the setting is an error, as its executors
    could not read each other's folders.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is not set")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="quarryline-"))
    return df.checkpoint(eager=eager)

"""Cuts of lineage for jobs of many rounds."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark 4.1's setting that removes an execution's shuffle files when it ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Executions planned inside drop their shuffle files when they end: what they wrote outside the shuffle is all that is read later.

    Otherwise the files of all rounds stay on the executors' disks until the
    driver happens to collect garbage.
    """
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before)


def cut(df: DataFrame) -> DataFrame:
    """df after a reliable checkpoint in the folder named by spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    with released(df.sparkSession):
        return df.select("*").checkpoint()  # planned anew, as a plan keeps the setting it was made under

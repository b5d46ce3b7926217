"""Cutting the lineage of a DataFrame, and what Python workers need."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def _shared_dir(spark: SparkSession) -> str:
    """The folder that the session names, which all executors share; a session in one
    process without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: for loops.  A checkpoint keeps the
    size that Spark guessed for it, joins multiply such guesses, and after a dozen rounds
    they are numbers of so many digits that planning stands still.  A table has its own size."""
    path = f"{_shared_dir(df.sparkSession)}/loop-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's setting for removing the shuffle files of a query when it ends
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """``written``, small, and the shuffle files of that work are removed with its end:
    else they stay until the driver collects its garbage, beside those of what follows."""
    conf = df.sparkSession.conf
    before = conf.get(RELEASE, None)
    conf.set(RELEASE, "true")
    try:
        return written(df, compression="zstd")
    finally:
        conf.unset(RELEASE) if before is None else conf.set(RELEASE, before)


def importable(spark: SparkSession) -> None:
    """Let Python workers that start from here on import this package where it is not installed."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)

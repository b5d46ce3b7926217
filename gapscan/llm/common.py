"""Shared plumbing of the training-data operators: reading, staging, sampling."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
ROOT = str(Path(__file__).resolve().parents[2])
#: Tables written by ``staged`` and not yet discarded, by path
LIVE: dict[str, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's reader only (any store Spark can open)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed on them, and hand
    them texts in batches of a few MB, unless the session sets that size itself."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(4 << 20))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares.  The session names it in
    ``spark.checkpoint.dir``; only a local session without it gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, a
    lost executor costs nothing, and Spark knows the size of what follows."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_at = path
    LIVE[path] = back
    return back


def discard(*frames: DataFrame) -> None:
    """Remove what ``staged`` wrote for ``frames``, once nothing reads it any more: what
    follows has been written in its turn."""
    for df in frames:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
        LIVE.pop(df.staged_at, None)


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    try:
        return int(spark.conf.get(key, str(default)))
    except ValueError:
        return default


def shuffle_width(spark: SparkSession) -> int:
    return conf_int(spark, "spark.sql.shuffle.partitions", 200)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def crc_mod(id_col: str, modulus: int):
    """crc32 of the id written as text, mod ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def bit_table(hashes: DataFrame, col: str, most_bytes: int = 64 << 20) -> np.ndarray:
    """A table of about 16 bits for each of the 64-bit numbers in ``col``, a bit set for
    each, at most ``most_bytes`` whatever their number.  Spark sums the table up in pieces
    of 4 kB; only it passes the driver."""
    n = hashes.count()
    bits = 1 << max(15, min((16 * max(n, 1)).bit_length(), most_bytes.bit_length() + 2))
    at = F.pmod(F.col(col), F.lit(bits)) + 1
    pieces = hashes.select(F.bitmap_bucket_number(at).alias("piece"), F.bitmap_bit_position(at).alias("bit"))
    table = np.zeros((bits >> 15, 4096), np.uint8)
    for r in pieces.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        table[r["piece"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return table.ravel()


def may_hold(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether each number's bit is set: always for what the table was made of, for
    others one time in sixteen, more often where the table is at its bound."""
    at = numbers.astype(np.uint64) & np.uint64(8 * len(table) - 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bit_filter(hashes: DataFrame, col: str, most_bytes: int = 64 << 20) -> Callable[[Column], Column]:
    """``may_hold`` of a ``bit_table`` as a column function."""
    table = bit_table(hashes, col, most_bytes)

    @F.pandas_udf("boolean")
    def among(x: pd.Series) -> pd.Series:
        return pd.Series(may_hold(table, x.to_numpy(np.int64)))

    return among


def keep_rows(docs: DataFrame, kept: DataFrame, key, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose ``(key, id)`` is in ``kept(__id, __key, __copies)``,
    one of those that share both, with the columns of ``docs``."""
    keyed = docs.withColumn("__row_key", key)
    same = (F.col("__row_key") == F.col("__key")) & F.col(id_col).eqNullSafe(F.col("__id"))
    whole = keyed.join(kept.hint("shuffle_hash"), same, "inner")
    if kept.filter("__copies > 1").head(1):  # rows repeated with id and text: one of them
        whole = whole.dropDuplicates(["__row_key", "__id"])
    return whole.select(*docs.columns)

"""Tables that are never half-written, and upserts that rewrite only what they touch.

A table is a folder.  Each write goes to a fresh folder of its own (``__version=...``, with
the partitions below it); then one small file, the manifest, that says which folder holds
each partition, is swapped by a rename.  Until then readers see the old rows, and a write that fails
leaves nothing but a folder that no manifest names.  One writer at a time."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST, VERSION, BUCKET = "_current.json", "__version", "__bucket"


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop
    place = hadoop.fs.Path(path)
    return hadoop, place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, path: str) -> dict | None:
    hadoop, place, fs = _fs(spark, f"{path}/{MANIFEST}")
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _swap(spark: SparkSession, path: str, manifest: dict) -> None:
    """Put ``manifest`` in place of the one there, in one step."""
    hadoop, place, fs = _fs(spark, f"{path}/{MANIFEST}")
    fresh = hadoop.fs.Path(f"{path}/.{MANIFEST}-{uuid.uuid4().hex}")
    stream = fs.create(fresh, False)
    try:
        stream.write(bytearray(json.dumps(manifest).encode()))
    finally:
        stream.close()
    context = hadoop.fs.FileContext.getFileContext(place.toUri() if place.isAbsolute() and place.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    modes = spark._sc._gateway.new_array(hadoop.fs.Options.Rename, 1)
    modes[0] = hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(place), modes)


def _partitions(spark: SparkSession, folder: str, depth: int) -> list[str]:
    """The partitions below ``folder`` by their relative names; of an unpartitioned table one, ``""``."""
    if not depth:
        return [""]
    hadoop, place, fs = _fs(spark, "/".join([folder] + ["*=*"] * depth))
    found = fs.globStatus(place)
    return ["/".join(str(s.getPath()).split("/")[-depth:]) for s in found or []]


def write_table(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """S-14: replace a table, or with keys just the partitions that ``df`` has rows for."""
    spark, keys = df.sparkSession, keys or []
    old = _manifest(spark, path)
    if old is not None and old["keys"] != keys and keys:
        raise ValueError(f"{path} is partitioned by {old['keys']}, not by {keys}")
    version = f"{VERSION}={uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*keys) if keys else writer).parquet(f"{path}/{version}")
    parts = {p: version for p in _partitions(spark, f"{path}/{version}", len(keys))}
    if keys and old is not None:
        parts = {**old["parts"], **parts}
    _swap(spark, path, {"keys": keys, "schema": json.loads(df.schema.json()), "parts": parts})


def read_table(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """The rows that the manifest names; ``only``: of these partitions (relative names)."""
    manifest = _manifest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"no table at {path}")
    schema = StructType.fromJson(manifest["schema"])
    folders = [f"{path}/{v}/{p}".rstrip("/") for p, v in manifest["parts"].items() if only is None or p in only]
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields]).add(VERSION, "string")).option("basePath", path).parquet(*folders)
    return rows.select(*schema.names)


def remove_unused(spark: SparkSession, path: str) -> int:
    """Remove the folders that the manifest does not name; how many.  For a table that nobody is reading or writing."""
    manifest = _manifest(spark, path) or {"parts": {}}
    hadoop, place, fs = _fs(spark, f"{path}/{VERSION}=*")
    stale = [s.getPath() for s in fs.globStatus(place) or [] if s.getPath().getName() not in set(manifest["parts"].values())]
    for p in stale:
        fs.delete(p, True)
    return len(stale)


def upsert_by_key(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """S-15: incoming rows replace current ones of the same key; among incoming rows of a
    key the last in ``order`` counts."""
    rows = current.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__new"), *[F.desc(c) for c in order or []]))
    return rows.withColumn("__n", latest).filter("__n = 1").drop("__n", "__new")


def _bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def upsert_table(incoming: DataFrame, path: str, keys: list[str], order: list[str] | None = None, buckets: int = 64) -> int:
    """S-15 on a stored table: it lies in ``buckets`` by a hash of the keys, and only buckets
    that ``incoming`` has keys of are read, merged and written anew.  Gives how many.  A
    table that is not there yet is made; its bucket count stays what it was made with."""
    spark = incoming.sparkSession
    old = _manifest(spark, path)
    if old is not None:
        buckets = old.get("buckets", buckets)
    rows = _bucketed(incoming, keys, buckets)
    touched = [f"{BUCKET}={r[0]}" for r in rows.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
    if old is not None and not touched:
        return 0
    if old is None:
        merged = upsert_by_key(rows.limit(0), rows, [BUCKET, *keys], order)
    else:
        merged = upsert_by_key(read_table(spark, path, only=touched), rows, [BUCKET, *keys], order)
    version = f"{VERSION}={uuid.uuid4().hex}"
    merged.repartition(BUCKET).write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{path}/{version}")
    parts = {p: version for p in _partitions(spark, f"{path}/{version}", 1)}
    kept = old["parts"] if old is not None else {}
    schema = json.loads(merged.schema.json())
    _swap(spark, path, {"keys": [BUCKET], "buckets": buckets, "schema": schema, "parts": {**kept, **parts}})
    return len(touched)

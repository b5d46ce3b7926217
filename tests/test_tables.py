"""Tables are swapped whole, and upserts write what they touch."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gapscan.sources import tables as B


def rows(df):
    return sorted(map(tuple, df.collect()))


def fail(spark, df):
    """``df`` whose rows cannot be written to the end."""
    return df.withColumn("v", F.when(F.col("k") < 10**6, F.raise_error(F.lit("half way"))).otherwise(F.col("v")))


@pytest.mark.parametrize("keys", [None, ["p"]])
def test_a_failed_write_leaves_the_old_rows(spark, tmp_path, keys):
    path = f"{tmp_path}/t"
    df = spark.createDataFrame([(k, f"v{k}", k % 3) for k in range(20)], "k long, v string, p int")
    B.write_table(df, path, keys)
    with pytest.raises(Exception):  # noqa: B017
        B.write_table(fail(spark, df), path, keys)
    assert rows(B.read_table(spark, path)) == rows(df)
    B.write_table(df.filter("p = 1 AND k > 9"), path, keys)
    want = df.filter("p = 1 AND k > 9") if keys is None else df.filter("p <> 1 OR k > 9")
    assert rows(B.read_table(spark, path)) == rows(want)
    assert B.remove_unused(spark, path) >= 1 and rows(B.read_table(spark, path)) == rows(want)
    assert not [f for f in os.listdir(path) if "json-" in f]


def test_missing_empty_and_odd_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        B.read_table(spark, f"{tmp_path}/none")
    df = spark.createDataFrame([(None, "a b/c"), (2, None)], "k long, p string")
    B.write_table(df, f"{tmp_path}/t", ["p"])
    assert {tuple(r) for r in B.read_table(spark, f"{tmp_path}/t").collect()} == {(None, "a b/c"), (2, None)}
    B.write_table(df.limit(0), f"{tmp_path}/e", ["p"])
    assert B.read_table(spark, f"{tmp_path}/e").count() == 0
    with pytest.raises(ValueError, match="partitioned"):
        B.write_table(df, f"{tmp_path}/t", ["k"])


def test_upserts_rewrite_only_their_buckets(spark, tmp_path):
    path = f"{tmp_path}/u"
    B.upsert_table(spark.range(500).selectExpr("id AS k", "0L AS v", "id AS seq"), path, ["k"], ["seq"], buckets=16)
    size = lambda: {p: p.stat().st_size for p in Path(path).rglob("*.parquet")}
    before = size()
    new = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (900, 3, 1)], "k long, v long, seq long")
    touched = B.upsert_table(new, path, ["k"], ["seq"])
    after = size()
    assert touched <= 2 and sum(n for p, n in after.items() if p not in before) < 0.4 * sum(before.values())
    got = {r.k: r.v for r in B.read_table(spark, path).collect()}
    assert got == {**dict.fromkeys(range(500), 0), 7: 2, 900: 3}
    assert B.upsert_table(new.limit(0), path, ["k"]) == 0
    with pytest.raises(Exception, match="half way"):
        B.upsert_table(new.withColumn("v", F.when(F.col("k") > 0, F.raise_error(F.lit("half way"))).cast("long")), path, ["k"])
    assert {r.k: r.v for r in B.read_table(spark, path).collect()} == got

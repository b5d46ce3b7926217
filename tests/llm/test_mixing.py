import duckdb
import pytest
from pyspark.sql import functions as F

from gapscan.llm.mixing import WEIGHTS, mix, mixed_order, oracle_sql, reference_cycle, schedule


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 2, "b": 1, "c": 1}, {"a": 7, "b": 5, "c": 3, "d": 1, "e": 1}, WEIGHTS])
def test_cycle_keeps_within_one_block(spark, weights):
    rows = schedule(spark, weights).orderBy("slot").collect()
    assert [(r.slot, r["class"], r.nth) for r in rows] == reference_cycle(weights)
    total, done = sum(weights.values()), dict.fromkeys(weights, 0)
    for r in rows:
        assert dict(zip(sorted(weights), r.done, strict=True)) == done
        done[r["class"]] += 1
        for c, w in weights.items():
            assert abs(done[c] * total - w * (r.slot + 1)) < total
    assert done == weights


def test_against_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    for weights, block in ((None, 32), ({"src0": 3, "src1": 2, "src2": 1}, 4)):
        got = mix(docs.select("doc_id", "source").repartition(5), weights, block=block, bucket_rows=7)
        names = ["doc_id", "source", "mix_class", "mix_slot", "mix_position"]
        want = con.execute(f"SELECT {', '.join(names)} FROM ({oracle_sql(weights, block)}) ORDER BY 5").fetchall()
        assert [tuple(r) for r in got.select(*names).orderBy("mix_position").collect()] == want


def test_edges(spark):
    rows = [(None, None, i) for i in range(40)] + [(1, "a", 0), (1, "a", 0), (2, "b", 1), (3, "zz", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, __rank int").withColumnRenamed("__rank", "mix_slot")
    out = mix(docs, {"a": 1, "b": 2}, block=2).collect()
    assert sorted(r.mix_position for r in out) == list(range(44))
    assert {r.mix_class for r in out} == {"a", "b", "other"}
    ordered = mixed_order(docs, {"a": 1, "b": 2})
    assert ordered.columns == docs.columns and ordered.count() == 44
    assert mix(docs.limit(0)).count() == 0


def test_native_plan(spark, sf_dir):
    plan = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))
    assert F is not None

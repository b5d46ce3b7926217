import importlib

from pyspark.sql import functions as F

from .test_near_dedup import brute
from .test_packing import check

corpus_pipeline = importlib.import_module("corpus_pipeline")


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, before, sf_dir)
        assert after.columns == docs.columns
        seen[name] = (before.select("doc_id", "text").collect(), after.select("doc_id", "text", "source").collect())
        before = spark.createDataFrame(after.collect(), docs.schema)
    kept = {r.doc_id for r in seen["quality classifier"][1]}
    wrong = [i for i, q in labels.items() if (i in kept) != bool(q)]
    assert len(wrong) <= 0.03 * len(labels)

    old, new = seen["exact dedup"]
    largest = {}
    for r in old:
        low = (r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        largest[low] = max(r.doc_id, largest.get(low, r.doc_id))
    assert sorted(r.doc_id for r in new) == sorted(largest.values())

    old, new = seen["MinHash near-dedup"]
    classes = brute([(r.doc_id, r.text) for r in old])
    assert sorted(r.doc_id for r in new) == sorted(min(old[i].doc_id for i in c) for c in classes.values())

    old, new = seen["mixing"]
    assert sorted(r.doc_id for r in old) == sorted(r.doc_id for r in new)
    lead = [r.source for r in new[:320]]
    assert abs(lead.count("src0") - 0.2 * len(lead)) <= 32 or len(new) < 320

    pieces = corpus_pipeline.STAGES[4][1](spark, before, sf_dir).collect()
    check(pieces, {r.doc_id: r.text for r in new}, 2048)


def test_run_gives_whole_sequences(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_run_orders_sequences_by_the_mixture(spark, tmp_path):
    """src0 has a third of the rows and a weight of 20 in 100: shares of prefixes of run()."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 2 = 0")
    at = F.pmod(F.xxhash64("doc_id"), F.lit(57))
    named = F.when(at < 19, F.lit("src0")).otherwise(F.concat(F.lit("src"), (1 + at % 19).cast("string")))
    docs.withColumn("source", named).write.parquet(f"{tmp_path}/documents.parquet")
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "source").collect()}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).filter("piece = 0").select("sequence_id", "doc_id").collect()
    order = [source[r.doc_id] for r in sorted(pieces, key=lambda r: r.sequence_id)]
    assert order.count("src0") > 0.29 * len(order)
    for share in (0.2, 0.3, 0.4, 0.5):
        lead = order[: int(share * len(order))]
        assert abs(lead.count("src0") / len(lead) - 0.2) < 0.05


def test_run_on_odd_tables(spark, tmp_path):
    """Nulls in any column, repeats, a very long text, clashing names; and no rows at all."""
    good = "the cat and the dog of the house walked to the river and it was good for them to rest in the shade of a tree"
    rows = [(1, None, None, None), (2, "", "en", "src1"), (None, good, "en", None), (None, good, "en", None), (3, good + " again", "en", "src0"), (3, good + " again", "en", "src0"),
            (4, (good + " and ") * 3000, None, "src2"), (5, "12 !! %%", "en", "src0")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, piece string")
    docs = docs.withColumns({"uid": F.lit(1), "score": F.lit("s"), "mix_position": F.lit("m"), "sequence_id": F.lit(9), "h": F.lit(0)})
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    firsts = [r.doc_id for r in out if r.piece == 0]
    # 3 repeats and is near the rows without an id, which lose to it; empty texts and junk are rejected
    assert firsts.count(3) == 1 and set(firsts) <= {3, 4}
    assert all(0 < r.length <= 2048 for r in out)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0

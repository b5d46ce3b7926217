import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from gapscan.llm import multi_index as M
from gapscan.llm.multi_index import search, walk


def brute(rows, is_query, k=20):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    ok = [(i, v) for i, v in ok if len(v) == len(ok[0][1])]
    out = {}
    for i, v in ok:
        if is_query(i):
            found = sorted({(-float((w * v).sum()), j) for j, w in ok if j != i})
            out[i] = [(j, -s) for s, j in found[:k]]
    return out


def test_walk_takes_cells_by_summed_distance():
    rng = np.random.default_rng(1)
    a, b, counts = rng.random(9), rng.random(7), rng.integers(0, 3, 63)
    order = sorted((a[i] + b[j], i * 7 + j) for i in range(9) for j in range(7) if counts[i * 7 + j])
    assert walk(a, b, counts, 10**9) == [c for _, c in order]
    assert sum(counts[c] for c in walk(a, b, counts, 12)) >= 12


def test_recall_and_scores_on_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, lambda i: i % 20 == 0)
    got = {}
    for r in search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert got.keys() == want.keys()
    hit = sum(len({x[0] for x in want[q]} & {x[0] for x in got[q].values()}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    for q, found in got.items():
        assert sorted(found) == list(range(1, len(found) + 1))
        assert all(abs(s - float(vectors[q] @ vectors[j])) < 1e-12 and j != q for j, s in found.values())


def test_edges_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5, -0.25]) for i in range(0, 60)] + [(100 + i, [0.1 * i, 1.0, 0.0]) for i in range(30)]
    rows += [(200, None), (220, []), (240, [0.0, 0.0, 0.0]), (260, [1.0, None, 0.0]), (280, [nan, 1.0, 1.0]), (300, [inf, 1.0, 1.0])]
    rows += [(320, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (120, [0.1 * 20, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(3)
    got = {}
    for r in search(df, F.col("vec_id") % 20 == 0, codebook=4, share=1.0, block=8).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, lambda i: i % 20 == 0)
    assert got.keys() == want.keys()
    for q in want:
        found = sorted(got[q])
        assert [(x[1]) for x in found] == [j for j, _ in want[q]]
        assert np.allclose([x[2] for x in found], [s for _, s in want[q]], rtol=1e-12)


@pytest.mark.parametrize("rows", [[], [(20, [1.0, 2.0])]])
def test_too_few(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert search(df, F.col("vec_id") % 20 == 0).count() == 0


def test_tight_clusters_fill_every_place(spark):
    """The neighbours lie in the first cell, but it holds fewer vectors than are asked for."""
    rng = np.random.default_rng(6)
    centers = 10 * rng.standard_normal((100, 8))
    rows = [(i, [float(x) for x in centers[i % 100] + 1e-3 * rng.standard_normal(8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for share in (None, 0.001):
        found = search(df, F.col("vec_id") % 20 == 0, share=share).groupBy("query_id").count().collect()
        assert len(found) == 15 and all(r["count"] == 20 for r in found)
    few = search(df.filter("vec_id < 21"), F.col("vec_id") % 20 == 0).groupBy("query_id").count().collect()
    assert len(few) == 2 and all(r["count"] == 20 for r in few)


def test_passed_ends_where_the_sorted_order_does():
    rng = np.random.default_rng(2)
    for sums in (rng.standard_normal(500), rng.integers(0, 4, 500) / 2, np.zeros(500), np.r_[rng.random(499), np.inf], np.r_[rng.random(499) * 1e-300, 1e300]):
        counts = rng.integers(1, 9, 500)
        order = np.argsort(sums, kind="stable")
        for wanted in (1, 2, 700, int(counts.sum()) - 1, int(counts.sum()), 10**6):
            want = order[: np.searchsorted(np.cumsum(counts[order]), wanted) + 1]
            assert np.flatnonzero(M.passed(sums, counts, wanted, 16)).tolist() == sorted(want.tolist())


def test_a_query_takes_a_few_array_steps_not_one_a_cell():
    """Calls of ``_probe`` follow the queries and units, not the 10,000 cells passed."""
    rng = np.random.default_rng(3)
    books, counts = [rng.standard_normal((128, 2)), rng.standard_normal((128, 2))], np.ones(128 * 128, np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array([7, 9]), pa.array(rng.standard_normal((2, 4)).tolist(), pa.list_(pa.float64()))], names=["q", "v"])
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        found = pa.Table.from_batches(list(M._probe([batch], books, counts, 4, 10_000, 4 * 128)))
    finally:
        sys.setprofile(None)
    assert len(calls) < 1_000
    v = np.array(batch.column("v").to_pylist())
    for q, x in zip((7, 9), v, strict=True):
        own = found.filter(pc.equal(found.column("q"), q)).to_pylist()
        got = [r["unit"] * 512 + int(c) for r in own for c in np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8)))]
        assert got == sorted(walk(-(books[0] @ x[:2]), -(books[1] @ x[2:]), counts, 10_000)) and len(got) == 10_000


def test_small_cells_scored_together_give_only_what_was_passed():
    rng = np.random.default_rng(4)
    qv, vv, at = rng.standard_normal((5, 3)), rng.standard_normal((40, 3)), rng.integers(0, 12, 40)
    marks = rng.random((5, 16)) < 0.4
    qs = [{"q": i, "v": v.tolist(), "bits": np.packbits(m).tobytes()} for i, (v, m) in enumerate(zip(qv, marks, strict=True))]
    vs = [{"g": j, "v": v.tolist(), "at": int(a)} for j, (v, a) in enumerate(zip(vv, at, strict=True))]
    v = pa.list_(pa.float64())
    types = (pa.list_(pa.struct([("q", pa.int64()), ("v", v), ("bits", pa.binary())])), pa.list_(pa.struct([("g", pa.int64()), ("v", v), ("at", pa.int32())])))
    pair = pa.RecordBatch.from_arrays([pa.array([qs], types[0]), pa.array([vs], types[1])], names=["qs", "vs"])
    want = {(i, j) for i in range(5) for j in sorted((j for j in range(40) if marks[i, at[j]]), key=lambda j: -(qv[i] @ vv[j]))[:3]}
    for together in (1, 4, 64):
        found = pa.Table.from_batches(list(M._score([pair], 3, 3, together=together))).to_pylist()
        assert {(r["q"], r["g"]) for r in found} == want
        assert all(abs(r["score"] - float(qv[r["q"]] @ vv[r["g"]])) < 1e-12 for r in found)

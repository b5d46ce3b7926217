import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapscan.llm.exact_dedup import Exchange, drop_exact_copies, exact_dedup, normalised, rice_decode, rice_encode

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize(("n", "universe"), [(1, 1), (1, 1 << 40), (1000, 1024), (5000, 1 << 30), (64, 64)])
def test_rice_round_trip(n, universe):
    values = np.sort(np.random.default_rng(n).choice(min(universe, 1 << 30), n, replace=False)).astype(np.int64)
    assert rice_decode(n, *rice_encode(values, universe)).tolist() == values.tolist()


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        first = True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 200_000), (8, "X" * 200_000), (9, "ab"),
        (9, "ab"), (10, "solo"), (10, "solo"), (11, "solo"), (None, "n"), (None, "N"), (None, "ab"), (12, "\x00"), (12, "other")]


def test_edges_against_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in exact_dedup(docs, sender_rows=3, owner_rows=2, salts=3).collect()]
    assert sorted(got, key=str) == brute(ROWS)
    named = docs.selectExpr("doc_id", "text", "'a' AS sha", "1 AS copies", "2 AS salt", "3 AS f")
    kept = drop_exact_copies(named)
    assert kept.columns == named.columns
    want = sorted((str(i), (t or "")) for i, t in {(r[0], (dict_text.get(r[0], {}) or {}).get(r[4], "")) for r in brute(ROWS) if r[3]})
    assert sorted((str(r.doc_id), (r.text or "").translate(LOWER)) for r in kept.collect()) == want


dict_text: dict = {}
for i_, t_ in ROWS:
    low = (t_ or "").translate(LOWER)
    dict_text.setdefault(i_, {})[hashlib.sha256(low.encode()).hexdigest()] = low


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup(none).count() == 0 and drop_exact_copies(none).count() == 0


def test_only_suspects_are_shuffled(spark):
    """Texts that pass the test are the copies and few others, wherever they lie."""
    rows = [(i, f"text {i} " + "filler " * 50) for i in range(4000)] + [(5000 + i, f"text {i % 40} " + "filler " * 50) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = Exchange(docs, "doc_id", "text", 10, 1_000_000, 2_000_000)
    passed = {r.doc_id for r in docs.filter(found.suspect(F.xxhash64(normalised()))).collect()}
    copies = set(range(40)) | set(range(5000, 5200))
    assert copies <= passed and len(passed) <= len(copies) + 0.05 * len(rows)
    assert {r.keep_id for r in found.groups.collect()} == set(range(5160, 5200))
    assert drop_exact_copies(docs).count() == 4000

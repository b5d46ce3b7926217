import random

import numpy as np
import pytest

from gapscan.llm.components import connected_components
from gapscan.llm.dartminhash import signatures
from gapscan.llm.near_dedup import drop_near_copies, near_duplicate_classes
from gapscan.llm.shingles import shingle_batch, word_hashes


def test_words_in_segments_and_batches_agree(monkeypatch):
    text = "alpha  beta\tgamma\n" * 900
    whole = word_hashes(text.encode())
    monkeypatch.setattr("gapscan.llm.shingles._SEGMENT", 1000)
    assert (word_hashes(text.encode()) == whole).all() and len(whole) == 2700


def test_shingles_of_short_and_empty_texts():
    doc, hashes, counts = shingle_batch(["a b c d e f", None, "", "a b", "A B", "x " * 9, "b c d e f"])
    assert doc.tolist() == [0, 0, 3, 4, 5, 6] and counts.tolist() == [1, 1, 1, 1, 5, 1]
    assert hashes[2] == hashes[3] and hashes[5] in hashes[:2]


@pytest.mark.parametrize(("wa", "wb"), [(1.0, 1.0), (2.5, 1.25), (0.01, 0.01), (30.0, 45.0)])
def test_signature_agreement_is_weighted_jaccard(wa, wb):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 50).astype(np.uint64)
    b = np.concatenate([a[:40], rng.integers(0, 2**63, 10).astype(np.uint64)])
    s = signatures(np.repeat([0, 1], 50), np.concatenate([a, b]), np.repeat([wa, wb], 50), 3, 4096)
    expect = 40 * min(wa, wb) / (40 * max(wa, wb) + 10 * wa + 10 * wb)
    assert abs((s[0] == s[1]).mean() - expect) < 0.04 and not s[2].any()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (300, 300), (201, 200)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute(rows, threshold=0.8):
    def shingles(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(find(i), []).append(i)
    return classes


def compare(spark, rows, parts=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = near_duplicate_classes(docs).collect()
    want = sorted((rows[i][0], min(rows[j][0] for j in c), len(c)) for c in brute(rows).values() for i in c)
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == want
    assert sum(r.kept for r in got) == len(brute(rows)) and all(r.doc_id == r.class_id for r in got if r.kept)


def test_classes_against_brute_force(spark):
    rng, rows = random.Random(5), []
    vocabulary = [f"w{i}" for i in range(500)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for base in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([30, 120, 400]))]
        for copy in range(rng.choice([1, 3, 8])):
            w = list(words)
            for _ in range(copy * len(w) // 120):
                w[rng.randrange(len(w))] = "new"
            rows.append((len(rows), " ".join(w if base % 3 else w + passage)))
    rows += [(1000, None), (1001, ""), (1002, "   "), (1003, "one two"), (1004, "One  two"), (1005, "x y z"), (1006, rows[0][1])]
    compare(spark, rows)


def test_chain_in_one_bucket(spark):
    """Neighbours link, ends do not: one class all the same."""
    words = [f"c{i}" for i in range(300)]
    rows = [(i, " ".join(["n%d_%d" % (i // 2, j) for j in range(8 * i)] + words[8 * i :])) for i in range(12)]
    compare(spark, rows, 3)


def test_large_group_of_scattered_copies(spark):
    """Copies of one text with many edits: few are near each other, all buckets are full."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(150)] = f"e{rng.random()}"
        rows.append((i, " ".join(w)))
    compare(spark, rows)


def test_null_ids_repeats_and_clashing_columns(spark):
    text = "a b c d e f g h"
    rows = [(None, text, 1), (5, text, 2), (5, text, 3), (4, text + " ", 4), (9, None, 5), (None, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid int")
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), (r.text or "").strip()) for r in kept.collect()) == [("4", text), ("9", ""), ("None", "")]
    assert drop_near_copies(docs.limit(0)).count() == 0

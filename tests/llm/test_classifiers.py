import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapscan.llm.language import identify_language
from gapscan.llm.quality import DOUBTS, PRAISE, LabelModel, drop_low_quality, score_quality
from gapscan.llm.toxicity import FactorizationMachine, _score, fit_toxicity_model, score_toxicity, terms
from gapscan.llm.words import ChunkRows, sigmoid


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def odd(spark):
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "a" * 100_000), (None, "the and of"), (5, "x"), (5, "x"), (6, "\n \t")]
    return spark.createDataFrame([(*r, "en" if r[0] else None, "s", 1) for r in rows], "doc_id long, text string, lang string, score string, y int")


def test_chunk_rows_stay_bounded_and_right():
    from collections import Counter

    rows = ChunkRows(lambda c: [len(c), 1.0], 2, most=10)
    for k in range(30):
        counts = Counter(["a" * (1 + (i * k) % 9) for i in range(20)])
        assert rows.total(counts).tolist() == [sum(len(c) * n for c, n in counts.items()), 20]
    assert rows.total(Counter({"b" * i: 1 for i in range(1, 50)})).tolist() == [1225, 49] and len(rows.at) <= 10


def test_language_held_out_accuracy(spark, tables):
    docs = tables[0]
    out = identify_language(docs, per_language=150).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.97
    sure = [r for r in held if r.accepted]
    assert len(sure) >= 0.5 * len(held) and np.mean([r.lang_pred == r.lang for r in sure]) >= 0.98


def test_language_edges(spark):
    some = odd(spark).unionByName(odd(spark).limit(1).selectExpr("0L AS doc_id", "'the and' AS text", "'en' AS lang", "score", "y"))
    out = {(r.doc_id, r.lang_pred, r.held_out) for r in identify_language(some).collect()}
    assert {(i, p) for i, p, _ in out if i in (1, 2, 3, 6)} == {(1, "und"), (2, "und"), (3, "und"), (6, "und")}
    assert (None, "en", False) in out
    assert identify_language(odd(spark).limit(0)).count() == 0
    nothing = identify_language(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_toxicity_held_out(spark, tables):
    docs, labels = tables
    out = score_toxicity(docs, labels)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) >= 0.97
    assert np.mean([r.predicted for r in held if r.toxic]) >= 0.6  # few to learn from here


def test_toxicity_edges(spark, tables):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    out = score_toxicity(odd(spark), labels).collect()
    assert len(out) == 8 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert score_toxicity(odd(spark).limit(0), labels).count() == 0
    assert all(r.predicted == 0 for r in score_toxicity(odd(spark), labels.limit(0)).collect())


def test_factorization_machine_learns_an_interaction():
    """Toxic only where both terms meet: linear weights alone cannot tell."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        rows.append(np.array(([7] if a else []) + ([9] if b else []) + rng.integers(100, 130, 3).tolist(), np.int32))
        y.append(a == b)
    y = np.array(y)
    model = FactorizationMachine(bits=8)
    model.index = {i: i for i in range(256)}
    model.w, model.v = np.zeros(256), rng.normal(0, 0.05, (256, 8))
    model.fit(rows[:1000], y[:1000].astype(float), epochs=40)
    hit = [(sigmoid(model.raw(x)) >= 0.5) == t for x, t in zip(rows[1000:], y[1000:], strict=True)]
    assert np.mean(hit) > 0.9


def test_toxicity_selects_pairs_without_a_marginal(spark):
    """Each word is as common in either class; only the pair tells."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows, labels = [], []
    for k in range(1500):
        a, b = rng.random(2) < 0.5
        text = " ".join((["zorblat"] if a else []) + (["quimfex"] if b else []) + [f"filler{chr(97 + i)}" for i in rng.integers(0, 26, 3)])
        rows.append((k, text))
        labels.append((k, int(a == b)))
    x, y = [terms(t, 255) for _, t in rows[:1000]], np.array([bool(t) for _, t in labels[:1000]])
    model = FactorizationMachine(bits=8)
    model.select(x, y, 5.0)
    assert {int(terms(w, 255)[i]) for w in ("zorblat", "quimfex") for i in range(len(terms(w, 255)))} <= set(model.index)

    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit_toxicity_model(docs, marks, epochs=40)
    held = [(t, y) for (k, t), (_, y) in zip(rows, labels, strict=True) if zlib.crc32(str(k).encode()) % 5 == 0]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(held))), "held_out": [True] * len(held), "x": [t for t, _ in held]})
    scores = next(_score([batch], model)).column(2).to_pylist()
    assert np.mean([(s >= 0.5) == bool(y) for s, (_, y) in zip(scores, held, strict=True)]) > 0.9


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    counts: dict[str, int] = {}
    for _ in range(4000):
        good = rng.random() < 0.7
        kind = rng.integers(len(DOUBTS))  # one kind of junk rouses one doubter, rarely others
        doubts = "".join("-" if rng.random() < (0.005 if good or i != kind else 0.9) else "0" for i in range(len(DOUBTS)))
        praise = "".join("+" if rng.random() < (0.9 if good else 0.2) else "~" for _ in PRAISE)
        counts[doubts + praise] = counts.get(doubts + praise, 0) + 1
    model = LabelModel(counts)
    assert abs(model.share - 0.7) < 0.05 and (model.accuracy > 0.75).all()
    assert abs(model.rates[True][2] - 0.9).max() < 0.06 and abs(model.rates[False][2] - 0.2).max() < 0.08


def test_quality_against_labels(spark, tables):
    docs, labels = tables
    rows = score_quality(docs, sample_rows=600).join(labels, "doc_id").collect()
    assert np.mean([r.kept == bool(r.quality) for r in rows]) >= 0.97
    assert np.mean([r.kept for r in rows if r.quality]) >= 0.99


def test_quality_edges(spark):
    scored = score_quality(odd(spark)).collect()
    assert len(scored) == 8 and all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in scored)
    kept = drop_low_quality(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == sum(r.kept for r in scored)
    assert score_quality(odd(spark).limit(0)).count() == 0 and drop_low_quality(odd(spark).limit(0)).count() == 0


def test_grams_of_many_chunks_at_once():
    from gapscan.llm.words import LETTERS, ngram_buckets, subwords

    chunks = ["don't", "a", "12", "éa!b", "日本語", "...", "Straße", "x" * 500]
    owner, buckets = ngram_buckets(chunks, (2, 3, 4), (1 << 40) - 1)
    want = [len(subwords(c, (2, 3, 4), 1 << 30)) - len(LETTERS.findall(c)) for c in chunks]
    assert np.bincount(owner, minlength=len(chunks)).tolist() == want
    again = ngram_buckets(["zz", "éa!b"], (2, 3, 4), (1 << 40) - 1)
    assert sorted(again[1][again[0] == 1]) == sorted(buckets[owner == 3])


def test_quality_scores_equal_a_plain_scorer(spark, tables):
    """From the same fitted weights, without caches, arrays or batches."""
    import re

    from gapscan.llm import quality as Q

    docs = tables[0].limit(150).cache()
    features = Q.read_features(docs)
    _, scorer = Q.fit_quality(features)
    got = {r.id: r.score for r in features.select("id", "ids", "x").mapInArrow(lambda it: Q._score(it, scorer, 0.5), "id long, score double, kept boolean").collect()}
    for r in docs.collect():
        text = r.text or ""
        words, raw = text.split(), scorer.bias
        for w in words:
            raw += (scorer.w[Q.bucket("t:" + w.lower(), scorer.mask)] + scorer.w[Q.bucket("s:" + Q._shape(w), scorer.mask)]) / len(words)
        measures = np.zeros(len(Q.MEASURES))
        if words:
            n, lines = len(words), text.split("\n")
            again = sum(len(x) for i, x in enumerate(lines) if x in lines[:i]) / len(text) if text.count("\n") > 1 else 0.0
            letters = sum(c.isalpha() for c in text)
            measures = np.array([
                sum(len(re.findall(r"[^\w\s.,;:'\"’()-]", w)) for w in words) / sum(map(len, words)),
                sum(c.isupper() for w in words for c in w if sum(map(str.isalpha, w)) > 1) / max(letters, 1),
                sum(w.strip(".,;:!?\"'()%&$*#|").lower() in Q.STOPWORDS for w in words) / n, max(map(words.count, words)) / n, len(set(words)) / n, again,
                sum(w.count("!") for w in words) / n, sum(not any(map(str.isalnum, w)) for w in words) / n, sum(map(len, words)) / n,
                sum(a == b for a, b in zip(words, words[1:])) / n,
            ])
        raw += 0.5 * scorer.w[scorer.measure_ids(measures, len(words))].sum()
        assert abs(got[r.doc_id] - float(sigmoid(raw))) < 1e-4, r.doc_id


def test_long_texts_alone_are_judged_too(spark):
    """No text short: junk is rejected and toxic terms are learned all the same."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    whole = docs.filter("lang = 'en'").join(labels.select("doc_id", "quality"), "doc_id").orderBy("doc_id").collect()
    rows = []
    for junk in (0, 1):
        held: list[str] = []
        for text in (r.text for r in whole if r.quality != junk):
            held.append(text)
            if sum(map(len, held)) > 21_000:
                rows.append((len(rows), "\n".join(held), junk))
                held = []
    assert sum(j for *_, j in rows) >= 3 and all(len(t) > 20_000 for _, t, _ in rows)
    long = spark.createDataFrame(rows, "doc_id long, text string, junk int")
    kept = {r.doc_id: r.kept for r in score_quality(long).collect()}
    assert np.mean([not kept[i] for i, _, junk in rows if junk]) > 0.5 and np.mean([kept[i] for i, _, junk in rows if not junk]) > 0.9
    marked = long.select("doc_id", F.concat("text", F.when(F.col("doc_id") % 2 == 0, F.lit(" vilefoe")).otherwise(" kindfoe")).alias("text"))
    marks = long.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))
    scored = {r.doc_id: r.predicted for r in score_toxicity(marked, marks, epochs=40).collect()}
    assert np.mean([scored[i] == (i % 2 == 0) for i in scored]) > 0.9
    assert {r.predicted for r in score_toxicity(marked, marks, sample_bytes=1).collect()} <= {0, 1}

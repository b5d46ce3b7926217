"""Language identification: averaged hashed subword embeddings and a linear softmax,
trained by stochastic gradient descent in numpy, with calibrated rejection.

Training rows are a bounded sample of labelled documents (``per_language`` rows of
each language of at most ``max_chars`` characters, and ``sample_rows`` in all: with
many languages each gets fewer, and none is left out); prediction reads whole texts.
A row is learned from whole and by six of its words, so that short texts are told
apart too; workers reduce both to feature arrays.  Averaging and the output layer are
linear, so prediction sums one small row for each distinct word.  A temperature is
fitted on a tenth of the sample's documents, none of which is trained on, and
``accepted`` tells where the calibrated score reaches the level at which ``target`` of
that tenth is right.

Defined cases: null text or one without a letter is ``und`` with score 0; with no
row to learn from all are ``und``; a null id is not held out and is not learned from;
a language whose texts are all beyond ``max_chars`` is learned from those; repeated
rows are predicted each, alike; languages that tie go by name; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .words import LETTERS, ChunkRows, ngram_buckets

ORDERS = (2, 3, 4)


class LanguageModel:
    def __init__(self, languages: list[str], dim: int = 16, bits: int = 15, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages, self.mask = languages, (1 << bits) - 1
        self.embed = rng.normal(0, 0.1, (1 << bits, dim))
        self.out = rng.normal(0, 0.1, (dim, len(languages)))
        self.bias = np.zeros(len(languages))
        self.temperature, self.level = 1.0, 0.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts = Counter(text.lower().split())
        if not counts:
            return np.zeros(0, np.int64), np.zeros(0)
        owner, buckets = ngram_buckets(list(counts), ORDERS, self.mask)
        ids, where = np.unique(buckets, return_inverse=True)
        w = np.bincount(where, np.fromiter(counts.values(), np.float64)[owner], len(ids))
        return ids, w / max(w.sum(), 1.0)

    def logits(self, ids, w) -> np.ndarray:
        return (w @ self.embed[ids]) @ self.out + self.bias

    def fit(self, rows: list[list[tuple]], labels: list[str], epochs: int = 4, rate: float = 0.5, target: float = 0.99, seed: int = 5) -> None:
        """``rows``: the feature arrays that each document gives, one list a document."""
        rng = np.random.default_rng(seed)
        where = {x: i for i, x in enumerate(self.languages)}
        docs = [[(f, where[label]) for f in own if len(f[0])] for own, label in zip(rows, labels, strict=True)]
        order = rng.permutation(len(docs))
        held = [x for i in order[: len(docs) // 10] for x in docs[i]]
        train = [x for i in order[len(docs) // 10 :] for x in docs[i]]
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for i in rng.permutation(len(train)):
                (ids, w), y = train[i]
                mean = w @ self.embed[ids]
                p = _softmax(mean @ self.out + self.bias)
                p[y] -= 1.0
                grad = self.out @ p
                self.out -= step * np.outer(mean, p)
                self.bias -= 0.1 * step * p
                # rows of a mean get small gradients; scaled up by the number of features
                self.embed[ids] -= np.outer(step * np.minimum(w * 20, 1.0), grad)
        if held:
            raw = np.array([self.logits(*f) for f, _ in held])
            truth = np.array([y for _, y in held])
            losses = {t: -np.log(_softmax(raw / t)[np.arange(len(raw)), truth] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
            self.temperature = float(min(losses, key=losses.get))
            p = _softmax(raw / self.temperature)
            right, top = p.argmax(1) == truth, p.max(1)
            order = np.argsort(-top)
            share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
            good = np.flatnonzero(share >= target)
            self.level = float(top[order][good[-1]]) if len(good) else 1.0


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _predict(batches, model: LanguageModel):
    table = model.embed @ model.out  # bucket -> contribution to each language
    width = table.shape[1]

    def sums(chunks: list[str]) -> np.ndarray:
        owner, buckets = ngram_buckets(chunks, ORDERS, model.mask)
        out = [np.bincount(owner, table[buckets, k], len(chunks)) for k in range(width)]
        return np.stack([*out, np.bincount(owner, minlength=len(chunks))], axis=1)

    rows = ChunkRows(sums, width + 1, many=True)
    for batch in batches:
        langs, scores = [], []
        for x in batch.column(batch.num_columns - 1):
            text = x.as_py()
            total = rows.total(Counter(text.lower().split())) if text and LETTERS.search(text) else None
            if total is None or not total[-1]:
                langs.append("und")
                scores.append(0.0)
                continue
            p = _softmax((total[:-1] / total[-1] + model.bias) / model.temperature)
            best = int(p.argmax())
            langs.append(model.languages[best])
            scores.append(float(p[best]))
        s = pa.array(scores, pa.float64())
        ok = pa.array([a != "und" and b >= model.level for a, b in zip(langs, scores, strict=True)])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), s, ok], names=["id", "held_out", "lang_pred", "score", "accepted"])


def _learn(batches):
    """Feature arrays (16-bit buckets, 32-bit weights) of a text and of six words of it."""
    blank = LanguageModel([])
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for x in batch.column(1):
            text = x.as_py()
            words = text.split()
            at = zlib.crc32(text.encode("utf-8", "surrogatepass")) % max(1, len(words) - 6)
            for k, part in enumerate((text, " ".join(words[at : at + 6]))):
                ids, w = blank.features(part)
                out[2 * k].append(ids.astype(np.uint16).tobytes())
                out[2 * k + 1].append(w.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in out)], names=["y", "ids", "w", "ids6", "w6"])


def fit_language_model(
    docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = 600, sample_rows: int = 12_000, max_chars: int = 20_000, **fit,
) -> LanguageModel | None:
    """Fit on a bounded sample: ``per_language`` rows of each language, fewer where there
    are more than ``sample_rows`` in all, drawn by hash among the rows that ``learn`` marks."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).alias("y"), F.col(text_col).alias("x"),
        (F.length(text_col) <= max_chars).alias("short"), F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 20)).alias("draw"),
    )
    # one number a language: the set of labels, not of rows
    sizes = {r["y"]: (r["short"], r["all"]) for r in rows.groupBy("y").agg(F.count_if("short").alias("short"), F.count(F.lit(1)).alias("all")).collect()}
    if not sizes:
        return None
    each = max(1, min(per_language, sample_rows // len(sizes)))
    share = [(y, short > 0, int((1 << 20) * min(1.0, 1.1 * each / (short or n) + 3 / (short or n))) + 1) for y, (short, n) in sorted(sizes.items())]
    cut = F.broadcast(docs.sparkSession.createDataFrame(share, "y string, brief boolean, cut int"))  # a row a language
    drawn = rows.join(cut, "y").filter((F.col("draw") < F.col("cut")) & (F.col("short") | ~F.col("brief")))
    taken = drawn.select("y", "x").mapInArrow(_learn, "y string, ids binary, w binary, ids6 binary, w6 binary").limit(2 * each * len(sizes) + 8 * len(sizes)).toArrow()
    left = dict.fromkeys(sizes, each)
    features, labels = [], []
    for y, *raw in sorted(zip(*(c.to_pylist() for c in taken.columns), strict=True)):
        if left[y] > 0:
            left[y] -= 1
            arrays = [np.frombuffer(x, kind) for x, kind in zip(raw, (np.uint16, np.float32) * 2, strict=True)]
            features.append([(arrays[0], arrays[1]), (arrays[2], arrays[3])])
            labels.append(y)
    del taken
    model = LanguageModel(sorted(set(labels)) or sorted(sizes))
    if features:
        model.fit(features, labels, **fit)
    return model


def identify_language(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_fold: int = 1, **options
) -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred``, ``score``, ``accepted``.
    Learns only where crc32(id as text) mod ``folds`` is not ``held_fold``."""
    common.ship(docs.sparkSession)
    fold = common.crc_mod(id_col, folds)
    model = fit_language_model(docs, fold != held_fold, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    slim = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("x")
    )
    if model is None:
        return slim.select(F.col("id").alias(id_col), "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    schema = "id long, held_out boolean, lang_pred string, score double, accepted boolean"
    return slim.mapInArrow(lambda it: _predict(it, model), schema).withColumnRenamed("id", id_col)

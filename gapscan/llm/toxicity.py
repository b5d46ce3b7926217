"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its words and their character 5-grams, hashed; each counts
once.  On a bounded sample of labelled documents, whose terms are counted by Spark and
of which only terms that may be selected reach the driver, terms are selected whose presence
differs significantly between the classes, alone or together with another term (the
covariance of the two), and a factorization machine
(weights, and ``factors`` latent numbers a term for pairwise interactions such as an
insult together with a group) is trained by AdaGrad.  Scoring reads whole texts.

Defined cases: null or empty text scores as no terms do; a null id is never learned
from and not held out; labels that are null are skipped and repeated ones count
once, as the largest; repeated rows are scored each, alike; texts beyond ``max_chars`` are
learned from where their class has no others, and scored whole; a score of just 0.5 is predicted toxic; without both classes to learn
from every score is the share of class 1 (0 without labels); an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import sigmoid, subwords

ORDERS = (5,)


def terms(text: str, mask: int) -> np.ndarray:
    found: set[int] = set()
    for chunk in set(text.lower().split()):
        found.update(subwords(chunk, ORDERS, mask))
    return np.fromiter(found, np.int32, len(found))


def _rows_as_bits(rows: list[np.ndarray], y: np.ndarray, size: int, least_z: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Buckets that may belong to a pair, the group of each (terms that stand in the same
    rows are one), and for either class its rows as bits, a line a group."""
    seen, print_ = np.zeros(size, np.int64), np.zeros(size, np.uint64)
    marks = np.random.default_rng(3).integers(0, 1 << 63, len(rows)).astype(np.uint64)
    for r, mark in zip(rows, marks, strict=True):
        seen[r] += 1
        print_[r] += mark
    buckets = np.flatnonzero((seen >= least_z**2) & (len(rows) - seen >= least_z**2))
    _, first, group = np.unique(print_[buckets], return_index=True, return_inverse=True)
    m, where = len(first), np.full(size, -1)
    where[buckets[first]] = np.arange(m)
    classes = []
    for label in (True, False):
        own = [r for r, x in zip(rows, y, strict=True) if x == label]
        bits = np.zeros((m, -(-len(own) // 8)), np.uint8)
        for i, r in enumerate(own):
            x = where[r]
            bits[x[x >= 0], i >> 3] |= 128 >> (i & 7)
        classes.append((len(own), bits))
    return buckets, group, classes


def _tile(classes: list[tuple[int, np.ndarray]], i: int, j: int, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest |z| of the difference in covariance, for each group from ``i`` on with
    those from ``j`` on, and the other way round."""

    def part(n: int, bits: np.ndarray, at: int) -> np.ndarray:
        return np.unpackbits(bits[at : at + tile], axis=1, count=n).astype(np.float32)

    gap, error = 0.0, 1e-12
    for (n, bits), sign in zip(classes, (1, -1), strict=True):
        a = part(n, bits, i)
        b = a if i == j else part(n, bits, j)
        joint, p, q = a @ b.T / n, a.mean(1)[:, None], b.mean(1)[None]
        covariance = joint - p * q
        square = (1 - 2 * p) * (1 - 2 * q) * joint + (1 - 2 * p) * p * q * q + (1 - 2 * q) * q * p * p + p * p * q * q
        gap = gap + sign * covariance
        error = error + np.maximum(square - covariance**2, 0) / n + 1 / n**2  # one row of doubt
    z = np.abs(gap) / np.sqrt(error)
    if i == j:
        np.fill_diagonal(z, 0)
    return z.max(1), z.max(0)


def _tiles(classes: list[tuple[int, np.ndarray]], pairs: list[tuple[int, int]], tile: int, spark: SparkSession | None):
    """``(start, greatest)`` of every pair of tiles, worked out by Spark's tasks if there is a session."""
    if spark is None:
        for i, j in pairs:
            yield from zip((i, j), _tile(classes, i, j, tile), strict=True)
        return
    held = spark.sparkContext.broadcast(classes)  # bits of the sample: its rows times its groups / 8 bytes

    def work(batches):
        for batch in batches:
            for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                best = [x.astype(np.float32).tobytes() for x in _tile(held.value, i, j, tile)]
                yield pa.RecordBatch.from_pydict({"at": pa.array([i, j], pa.int64()), "best": pa.array(best, pa.binary())})

    todo = spark.createDataFrame(pairs, "i long, j long").repartition(min(len(pairs), 4 * common.shuffle_width(spark)))
    found = todo.mapInArrow(work, "at long, best binary").toArrow()  # a number for each group and each tile it met
    held.destroy()
    for at, best in zip(*(c.to_pylist() for c in found.columns), strict=True):
        yield at, np.frombuffer(best, np.float32)


def _paired(rows: list[np.ndarray], y: np.ndarray, size: int, least_z: float, spark: SparkSession | None = None, tile: int = 512) -> np.ndarray:
    """Which buckets belong to a pair whose covariance differs between the classes by
    ``least_z`` standard errors, however common each is alone.  Pairs of all terms are
    looked at, but those in (or out of) too few rows to reach ``least_z``."""
    buckets, group, classes = _rows_as_bits(rows, y, size, least_z)
    m = len(classes[0][1])
    best = np.zeros(m, np.float32)
    pairs = [(i, j) for i in range(0, m, tile) for j in range(i, m, tile)]
    if pairs:
        for at, found in _tiles(classes, pairs, tile, spark):
            best[at : at + tile] = np.maximum(best[at : at + tile], found)
    found = np.zeros(size, bool)
    found[buckets[best[group] >= least_z]] = True
    return found


class FactorizationMachine:
    def __init__(self, base: float = 0.0, factors: int = 8, bits: int = 20, seed: int = 11):
        self.base, self.factors, self.bits, self.seed = base, factors, bits, seed
        self.index: dict[int, int] = {}
        self.w = np.zeros(0)
        self.v = np.zeros((0, factors))

    def select(self, rows: list[np.ndarray], y: np.ndarray, least_z: float, pair_z: float = 8.0, spark: SparkSession | None = None) -> list[np.ndarray]:
        """Keep the terms with |z| of the difference in presence at least ``least_z``, and
        those of any pair with |z| of the difference in covariance at least ``pair_z``;
        gives the rows as indexes of kept terms."""
        size = 1 << self.bits
        pos, neg = np.zeros(size), np.zeros(size)
        for r, label in zip(rows, y, strict=True):
            (pos if label else neg)[r] += 1
        n1, n0 = max(1, int(y.sum())), max(1, int((~y).sum()))
        p = (pos + neg) / (n1 + n0)
        z = (pos / n1 - neg / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-9)
        kept = np.abs(z) >= least_z
        if y.any() and not y.all():
            kept |= _paired(rows, y, size, pair_z, spark)
        strong = np.flatnonzero(kept)
        self.index = {int(b): i for i, b in enumerate(strong)}
        rng = np.random.default_rng(self.seed)
        self.w, self.v = np.zeros(len(strong)), rng.normal(0, 0.05, (len(strong), self.factors))
        where = np.full(size, -1)
        where[strong] = np.arange(len(strong))
        return [x[x >= 0] for x in (where[r] for r in rows)]

    def raw(self, x) -> float:
        s = self.v[x].sum(0)
        return float(self.base + self.w[x].sum() + 0.5 * (s @ s - (self.v[x] ** 2).sum()))

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, weight: float = 1.0) -> None:
        rng = np.random.default_rng(self.seed)
        gw, gv, g0 = np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                x = rows[i]
                s = self.v[x].sum(0)
                d = sigmoid(self.base + self.w[x].sum() + 0.5 * (s @ s - (self.v[x] ** 2).sum())) - y[i]
                d *= weight if y[i] else 1.0
                g0 += d * d
                self.base -= rate * d / np.sqrt(g0)
                grad = d + decay * self.w[x]
                gw[x] += grad**2
                self.w[x] -= rate * grad / np.sqrt(gw[x])
                grad = d * (s - self.v[x]) + decay * self.v[x]
                gv[x] += grad**2
                self.v[x] -= 0.5 * rate * grad / np.sqrt(gv[x])


def _collect_terms(batches, mask: int):
    for batch in batches:
        found = pa.array([terms(x.as_py() or "", mask) for x in batch.column(1)], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["y", "terms"])


def _numbered(batches, where: np.ndarray):
    """The kept terms of each row by their numbers, as bytes."""
    for batch in batches:
        lists, out = batch.column(1), []
        flat, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
        for i in range(batch.num_rows):
            x = where[flat[cuts[i] : cuts[i + 1]]]
            out.append(np.sort(x[x >= 0]).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["y", "terms"])


def _eligible(sample: DataFrame, least_z: float, pair_z: float) -> np.ndarray:
    """Buckets that may be selected, alone or in a pair: Spark counts the rows of each."""
    count = lambda y: F.count_if("y" if y else ~F.col("y"))
    n1, n0 = sample.agg(count(True), count(False)).first()
    seen = sample.select("y", F.explode("terms").alias("term")).groupBy("term").agg(count(True).alias("pos"), count(False).alias("neg"))
    p = (F.col("pos") + F.col("neg")) / (n1 + n0)
    z = (F.col("pos") / max(1, n1) - F.col("neg") / max(1, n0)) / F.sqrt(p * (1 - p) * (1 / max(1, n1) + 1 / max(1, n0)) + 1e-9)
    rows = F.col("pos") + F.col("neg")
    paired = (rows >= pair_z**2) & (n1 + n0 - rows >= pair_z**2)
    found = seen.filter((F.abs(z) >= 0.999 * least_z) | paired).select("term").toArrow()  # select() decides; at most 2**bits
    return np.sort(found.column(0).to_numpy()).astype(np.int64)


def _score(batches, model: FactorizationMachine, most: int = 300_000):
    mask, index = (1 << model.bits) - 1, model.index
    known: dict[str, tuple] = {}
    for batch in batches:
        scores = []
        for x in batch.column(batch.num_columns - 1):
            hit: set[int] = set()
            for chunk in set((x.as_py() or "").lower().split()):
                found = known.get(chunk)
                if found is None:
                    if len(known) >= most:
                        known.clear()
                    found = known[chunk] = tuple(index[b] for b in subwords(chunk, ORDERS, mask) if b in index)
                if found:
                    hit.update(found)
            scores.append(float(sigmoid(model.raw(np.fromiter(sorted(hit), np.int64, len(hit))))))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=["id", "held_out", "score"])


def fit_toxicity_model(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    folds: int = 5, held_fold: int = 0, per_class: int = 3000, max_chars: int = 20_000, sample_bytes: int = 256 << 20,
    least_z: float = 5.0, pair_z: float = 8.0, **fit,
) -> FactorizationMachine:
    """Fit on a bounded sample: ``per_class`` labelled documents of either class (twice
    as many of the negative one), drawn by hash of the id, of at most ``max_chars`` characters
    where the class has such documents and of any length where it has none; fewer where
    their terms, four bytes each, would pass ``sample_bytes``."""
    marked = labels.filter((common.crc_mod(id_col, folds) != held_fold) & F.col(label_col).isNotNull())
    marked = marked.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col) != 0).alias("y"))
    sizes = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    model = FactorizationMachine(base=-35.0 if not n1 else 35.0 if not n0 else float(np.log(n1 / n0)))
    if not n1 or not n0:
        return model
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    share = {True: min(1.0, 1.2 * per_class / n1), False: min(1.0, 2.4 * per_class / n0)}
    cut = F.when(F.col("y"), F.lit(int(share[True] * (1 << 20)) + 1)).otherwise(F.lit(int(share[False] * (1 << 20)) + 1))
    some = common.staged(marked.filter(draw < cut).limit(8 * per_class), "labelled")  # bounded, so it can be broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("x"))
    size = 1 << model.bits
    drawn = texts.join(F.broadcast(some), "id").select("y", "x", (F.length("x") <= max_chars).alias("short"))
    brief = {r["y"]: r["short"] for r in drawn.groupBy("y").agg(F.bool_or("short").alias("short")).collect()}
    drawn = drawn.filter(F.col("short") | F.when(F.col("y"), not brief.get(True)).otherwise(not brief.get(False)))
    read = drawn.select("y", "x").mapInArrow(lambda it: _collect_terms(it, size - 1), "y boolean, terms array<int>")
    sample = common.staged(read, "terms")
    kept = _eligible(sample, least_z, pair_z)
    where = np.full(size, -1, np.int32)
    where[kept] = np.arange(len(kept))
    numbered = sample.mapInArrow(lambda it: _numbered(it, where), "y boolean, terms binary")
    n, terms_ = sample.agg(F.count("*"), F.sum(F.size("terms"))).first()
    if n and 4 * terms_ > sample_bytes:
        numbered = numbered.filter(F.pmod(F.xxhash64("terms"), F.lit(1 << 20)) < int(sample_bytes / (4 * terms_) * (1 << 20)))
    if n > 8 * per_class:  # ids that repeat in ``docs`` make more rows than labels
        numbered = numbered.limit(8 * per_class)
    table = numbered.toArrow()
    common.discard(sample, some)
    found = sorted(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))
    del table
    if not found:
        return model
    y = np.array([label for label, _ in found])
    rows = model.select([kept[np.frombuffer(x, np.int32)].astype(np.int32) for _, x in found], y, least_z, pair_z, docs.sparkSession)
    if y.any() and not y.all():
        model.fit(rows, y.astype(float), **fit)
    return model


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 0, **options
) -> DataFrame:
    """One row per document: id, ``held_out``, ``score``, ``predicted``."""
    common.ship(docs.sparkSession)
    model = fit_toxicity_model(docs, labels, id_col=id_col, text_col=text_col, folds=folds, held_fold=held_fold, **options)
    held = F.coalesce(common.crc_mod(id_col, folds) == held_fold, F.lit(False))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held_out"), F.col(text_col).cast("string").alias("x"))
    scored = slim.mapInArrow(lambda it: _score(it, model), "id long, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

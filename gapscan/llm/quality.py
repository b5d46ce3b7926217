"""Quality classifier from weak labels.

1. One pass reads every whole text: heuristic labellers vote on its measures (some vote
   bad or nothing, some good or nothing), and its hashed terms, shapes and measures are
   written as a few small arrays.
2. Votes of all documents are counted by pattern; expectation-maximisation on those
   counts estimates each labeller's rates and the share of good documents, without any human label.
3. The posterior of a pattern labels a bounded sample of documents, on whose arrays a
   linear scorer is trained; no text reaches the driver.
4. The scorer reads every document's arrays; a document is kept at a score of 0.5 or more.

Defined cases: a null or empty text, or one of white space, is scored by its
measures alone (no words: rejected by every labeller that votes); null and repeated
ids are scored row by row, rows of equal texts alike; texts of any length are voted on,
trained on and scored whole; a score of just the threshold is kept;
an empty table gives no rows; other columns, whatever their names, are ignored by
``score_quality`` and returned unchanged by ``drop_low_quality``.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import ChunkRows, bucket, sigmoid

STOPWORDS = frozenset(
    """the of and to in a is that for it as was with be by on not he this are or from at an
    der die das und in zu den mit von für auf ist im dem nicht ein eine als auch
    de la le et les des en un une du dans que est pour qui au sur par plus
    el los las y una con por del se al lo como más su""".split()
)
_SYMBOL = re.compile(r"[^\w\s.,;:'\"’()-]")
MEASURES = ("symbols", "upper", "stopwords", "top_word", "distinct", "repeated_lines", "shouting", "bare", "word_length", "stutter")


def _chunk_measures(chunk: str) -> list[float]:
    n = len(chunk)
    if chunk.isalpha():
        upper = 0 if n < 2 or chunk.islower() else sum(map(str.isupper, chunk))
        return [n, 0, n, upper, chunk.lower() in STOPWORDS, 0, False, False]
    letters = sum(map(str.isalpha, chunk))
    upper = sum(map(str.isupper, chunk)) if letters > 1 else 0
    bare = chunk.strip(".,;:!?\"'()%&$*#|").lower()
    ends = chunk[-1] in ".!?"
    return [n, len(_SYMBOL.findall(chunk)), letters, upper, bare in STOPWORDS, chunk.count("!"), not any(map(str.isalnum, chunk)), ends]


class Measurer:
    """The measures of a whole text and the buckets of its terms and shapes, from cached
    rows of its chunks."""

    def __init__(self, scorer: Scorer | None = None):
        ids = (scorer or Scorer()).chunk_ids
        self.rows = ChunkRows(lambda c: [*_chunk_measures(c), *ids(c)], 10)

    def __call__(self, text: str) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
        """``(measures, words, buckets, counts)``, with buckets as often as chunks share them."""
        words = text.split()
        counts, n = Counter(words), len(words)
        if not n:
            return np.zeros(len(MEASURES)), 0, np.zeros(0, np.int64), np.zeros(0)
        sums, ids, weights = np.zeros(8), [], []
        for k, rows in self.rows.parts(counts):
            sums = sums + k @ rows[:, :8]
            ids.append(rows[:, 8:].astype(np.int64).T.ravel())
            weights += [k, k]
        buckets, tallies = np.concatenate(ids), np.concatenate(weights)
        size, symbols, letters, upper, stop, shout, bare, ends = sums.tolist()
        again = 0.0
        if text.count("\n") > 1:
            lines = Counter(text.split("\n"))
            again = sum(len(x) * (c - 1) for x, c in lines.items()) / len(text)
        stutter = sum(map(eq, words, words[1:])) / n
        values = [symbols / size, upper / max(letters, 1), stop / n, max(counts.values()) / n, len(counts) / n,
                  again, shout / n, bare / n, size / n, stutter]
        return np.array(values), n, buckets, tallies


#: Labellers that vote bad or nothing: measure, least words to vote, what is tolerated.
DOUBTS = (
    ("symbols", 1, (0.0, 0.1)),
    ("upper", 3, (0.0, 0.5)),
    ("stopwords", 20, (0.03, 1.0)),
    ("top_word", 20, (0.0, 0.3)),
    ("distinct", 40, (0.12, 1.0)),
    ("repeated_lines", 30, (0.0, 0.6)),
    ("shouting", 3, (0.0, 0.3)),
    ("bare", 5, (0.0, 0.15)),
    ("word_length", 5, (2.0, 14.0)),
    ("stutter", 5, (0.0, 0.2)),
)
#: Labellers that praise a text or, having looked, do not: least words to look, and a
#: range for each of some measures.
PRAISE = (
    (1, {"symbols": (0.0, 0.03), "upper": (0.0, 0.3), "shouting": (0.0, 0.1), "bare": (0.0, 0.05), "stutter": (0.0, 0.1)}),
    (8, {"stopwords": (0.06, 1.0), "symbols": (0.0, 0.06), "upper": (0.0, 0.4), "top_word": (0.0, 0.25), "bare": (0.0, 0.1), "stutter": (0.0, 0.15)}),
    (8, {"distinct": (0.2, 1.0), "word_length": (2.5, 11.0), "shouting": (0.0, 0.05), "symbols": (0.0, 0.05), "bare": (0.0, 0.1)}),
)


def votes(measures: np.ndarray, n: int) -> str:
    """One character a labeller: - doubt, + praise, ~ praise withheld, 0 nothing."""
    if n == 0:
        return "-" * len(DOUBTS) + "0" * len(PRAISE)
    x = dict(zip(MEASURES, measures.tolist(), strict=True))
    doubts = "".join("-" if n >= least and not lo <= x[m] <= hi else "0" for m, least, (lo, hi) in DOUBTS)
    return doubts + "".join("0" if n < least else "+" if all(lo <= x[m] <= hi for m, (lo, hi) in r.items()) else "~" for least, r in PRAISE)


class LabelModel:
    """Two classes, on counts of vote patterns.  Kinds of junk exclude each other, so
    doubters are not independent: whether any doubts is one variable, and which ones
    do, given that some do, come next.  Praise, given or withheld, is one variable a
    labeller.  Each has a rate in either class, hence an accuracy."""

    def __init__(self, counts: dict[str, int], rounds: int = 60, prior: float = 0.8, strength: float = 10.0):
        patterns = sorted(counts)
        seen = self._read(patterns)
        down, up, held = seen
        some = down.any(1)
        n = np.array([counts[p] for p in patterns], np.float64)
        k, first = len(DOUBTS), {True: (0.05, 0.9), False: (0.8, 0.3)}
        self.share = prior
        self.rates = {g: (any_, np.full(k, 0.2), np.full(len(PRAISE), praise)) for g, (any_, praise) in first.items()}
        for _ in range(rounds if patterns else 0):
            post = self._posterior(*seen)
            self.share = float((n @ post + prior * strength) / (n.sum() + strength))
            for good, w in ((True, n * post), (False, n * (1 - post))):
                any_, praise = first[good]
                self.rates[good] = (
                    float((w @ some + any_ * strength) / (w.sum() + strength)),
                    (w @ down + 0.2 * strength) / (w @ some + strength),
                    (w @ up + praise * strength) / (w @ (up | held) + strength),
                )
        post = self._posterior(*seen)
        right = np.concatenate([(n * (1 - post)) @ down, (n * post) @ up])
        self.accuracy = (right + 0.8 * strength) / (n @ np.hstack([down, up]) + strength)  # of each labeller's votes

    @staticmethod
    def _read(patterns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = np.array([list(p) for p in patterns]).reshape(len(patterns), len(DOUBTS) + len(PRAISE))
        praise = v[:, len(DOUBTS) :]
        return v[:, : len(DOUBTS)] == "-", praise == "+", praise == "~"

    def _posterior(self, down: np.ndarray, up: np.ndarray, held: np.ndarray) -> np.ndarray:
        some, log = down.any(1), {}
        for good, (any_, which, praise) in self.rates.items():
            log[good] = np.where(some, np.log(any_) + down @ np.log(which) + ~down @ np.log(1 - which), np.log(1 - any_))
            log[good] = log[good] + up @ np.log(praise) + held @ np.log(1 - praise)
        share = np.clip(self.share, 0.01, 0.99)
        return sigmoid(np.log(share / (1 - share)) + log[True] - log[False])

    def posterior(self, patterns: list[str]) -> np.ndarray:
        return self._posterior(*self._read(patterns)) if patterns else np.zeros(0)


_RUNS = ((re.compile(r"[^\W\d_]+"), None), (re.compile(r"\d+"), "9"), (re.compile(r"(.)\1+", re.S), r"\1"))


def _letters(run: re.Match) -> str:
    """Runs of capitals and of other letters, one sign each."""
    out = []
    for c in run[0]:
        sign = "A" if c.isupper() else "a"
        if not out or out[-1] != sign:
            out.append(sign)
    return "".join(out)


def _shape(chunk: str) -> str:
    """The whole chunk with each run of capitals, letters, digits or of one sign as a
    single character; the caller hashes it."""
    if chunk.isalpha():
        return "a" if chunk.islower() else "A" if chunk.isupper() else "Aa"
    core, last = chunk[:-1], chunk[-1]
    if core.isalpha() and (core.islower() or core.istitle()) and not last.isalnum():  # most words at the end of a clause
        return ("a" if core.islower() else "Aa" if len(core) > 1 else "A") + last
    (letters, _), (digits, nine), (same, one) = _RUNS
    return same.sub(one, digits.sub(nine, letters.sub(_letters, chunk)))


class Scorer:
    """Linear over hashed terms and shapes (as shares of the text) and over measures in
    hashed bins."""

    def __init__(self, bits: int = 16):
        self.mask = (1 << bits) - 1
        self.w = np.zeros(1 << bits)
        self.bias = 0.0
        self.shapes: dict[str, int] = {}

    def chunk_ids(self, chunk: str) -> tuple[int, int]:
        shape = _shape(chunk)
        known = self.shapes.get(shape)
        if known is None:
            if len(self.shapes) > 100_000:
                self.shapes.clear()
            known = self.shapes[shape] = bucket("s:" + shape, self.mask)
        return bucket("t:" + chunk.lower(), self.mask), known

    def measure_ids(self, measures: np.ndarray, n: int) -> list[int]:
        sized = min(6, n.bit_length() // 2)
        return [bucket(f"m:{name}:{int(min(x, 15.0) * (1 if x > 1 else 20))}", self.mask) for name, x in zip(MEASURES, measures, strict=True)] + [
            bucket(f"n:{sized}", self.mask)
        ]

    def features(self, measures: np.ndarray, n: int, buckets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ids and their values: shares of terms and shapes, halves for measures."""
        extra = np.array(self.measure_ids(measures, n))
        ids, where = np.unique(np.concatenate([buckets, extra]), return_inverse=True)
        return ids, np.bincount(where, np.concatenate([counts / max(n, 1), np.full(len(extra), 0.5)]), len(ids))

    def score(self, ids: np.ndarray, values: np.ndarray) -> float:
        return float(sigmoid(self.w[ids] @ values + self.bias))

    def fit(self, rows: list, y: np.ndarray, epochs: int = 8, rate: float = 0.5, decay: float = 1e-4, seed: int = 9) -> None:
        rng = np.random.default_rng(seed)
        scale = np.full(len(self.w), 1e-3)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                ids, x = rows[i]
                d = sigmoid(self.w[ids] @ x + self.bias) - y[i]
                g = d * x + decay * self.w[ids]
                scale[ids] += g**2
                self.w[ids] -= rate * g / np.sqrt(scale[ids])
                self.bias -= 0.02 * rate * d


_FEATURES = "pattern string, ids binary, x binary"


def _read(measure: Measurer, scorer: Scorer, text: str) -> tuple[str, bytes, bytes]:
    """Votes and feature arrays (16-bit ids, 32-bit values) of one text."""
    found = measure(text)
    ids, x = scorer.features(*found)
    return votes(*found[:2]), ids.astype(np.uint16).tobytes(), x.astype(np.float32).tobytes()


def _write(batches):
    """Batches whose last column is the text, with the features in its place."""
    scorer = Scorer()
    measure = Measurer(scorer)
    for batch in batches:
        rows = [_read(measure, scorer, x.as_py() or "") for x in batch.column(batch.num_columns - 1)]
        pattern, ids, values = zip(*rows, strict=True) if rows else ((), (), ())
        made = [pa.array(pattern, pa.string()), pa.array(ids, pa.binary()), pa.array(values, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "pattern", "ids", "x"])


def _arrays(ids: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.uint16).astype(np.int64), np.frombuffer(x, np.float32).astype(np.float64)


def _score(batches, scorer: Scorer, threshold: float):
    for batch in batches:
        scores = [scorer.score(*_arrays(*pair)) for pair in zip(batch.column("ids").to_pylist(), batch.column("x").to_pylist(), strict=True)]
        s = pa.array(scores, pa.float64())
        keep = pa.array([x >= threshold for x in scores], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("id"), s, keep], names=["id", "score", "kept"])


def read_features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, written to the shared folder: ``id``, ``draw`` (a hash of id
    and text), the votes and the feature arrays."""
    return _measured(docs, {"id": id_col}, id_col, text_col)


def _measured(docs: DataFrame, kept: dict[str, str], id_col: str, text_col: str) -> DataFrame:
    """``kept`` (new name to column) with ``draw`` and the features, written."""
    common.ship(docs.sparkSession)
    draw = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 20)).alias("draw")
    slim = docs.select(*[F.col(old).alias(new) for new, old in kept.items()], draw, F.col(text_col).cast("string").alias("x"))
    kinds = ", ".join(f"{new} {dict(docs.dtypes)[old]}" for new, old in kept.items())
    return common.staged(slim.mapInArrow(_write, f"{kinds}, draw long, {_FEATURES}"), "quality")


def fit_quality(features: DataFrame, *, sample_rows: int = 6000, sample_bytes: int = 128 << 20) -> tuple[LabelModel, Scorer]:
    """The label model on the votes of all documents, the scorer on a sample of at most
    ``sample_rows`` documents of any length, drawn by hash.  What reaches the driver is
    the sample's feature arrays, six bytes for each distinct bucket of a document; where
    documents are so rich that these would pass ``sample_bytes``, fewer are drawn."""
    counts = {r["pattern"]: r["count"] for r in features.groupBy("pattern").count().collect()}  # at most three to the number of labellers
    model, scorer = LabelModel(counts), Scorer()
    total = sum(counts.values())
    if total:
        mean = features.agg(F.avg(F.octet_length("ids") + F.octet_length("x"))).first()[0]
        sample_rows = max(1, min(sample_rows, int(sample_bytes / max(mean, 1))))
        draw = F.col("draw") < int(min(1.0, 1.2 * sample_rows / total) * (1 << 20)) + 1
        sampled = features.filter(draw).select("pattern", "ids", "x").limit(sample_rows).toArrow()
        if sampled.num_rows:
            rows = sorted(zip(*(c.to_pylist() for c in sampled.columns), strict=True))
            del sampled
            y = model.posterior([r[0] for r in rows])
            scorer.fit([_arrays(*r[1:]) for r in rows], y)
    return model, scorer


def score_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """One row per document: id, ``score`` (chance of being good), ``kept``."""
    features = read_features(docs, id_col=id_col, text_col=text_col)
    _, scorer = fit_quality(features, **options)
    kind = dict(docs.dtypes)[id_col]
    scored = features.select("id", "ids", "x").mapInArrow(lambda it: _score(it, scorer, threshold), f"id {kind}, score double, kept boolean")
    return scored.withColumnRenamed("id", id_col)


def drop_low_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """The documents that are kept, with all their columns.  Whole rows are written beside
    their features, so that texts are measured once and none is moved to be joined."""
    named = {f"c{i}": c for i, c in enumerate(docs.columns)}
    features = _measured(docs, named, id_col, text_col)
    _, scorer = fit_quality(features, **options)

    def keep(batches):
        for batch in batches:
            pairs = zip(batch.column("ids").to_pylist(), batch.column("x").to_pylist(), strict=True)
            good = [scorer.score(*_arrays(*pair)) >= threshold for pair in pairs]
            yield batch.select(list(named)).filter(pa.array(good, pa.bool_()))

    rows = features.select(*named, "ids", "x")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(named)])
    return rows.mapInArrow(keep, schema).toDF(*docs.columns)

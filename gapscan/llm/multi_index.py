"""Approximate nearest neighbours by an inverted multi-index, inner product.

Both halves of a vector are quantised with a codebook of their own, fitted on a
bounded sample.  The cells are pairs of centroids.  A query walks the cells in the
order of summed distance, the negative inner product of each half with its
centroid, until the cells passed hold a measured share of the vectors.  Where that
order ends is told by a histogram of the sums, in a few array steps a query and not one
step a cell.  Every vector is indexed; only vectors of the cells passed can be found,
by their exact scores.

Cells are fine, so that few vectors are scored, and neighbouring cells are stored
together as a unit: a query is sent to a unit once, with one bit for each cell it
passed there.  Units are cut into blocks of vectors and of queries, so none, however
full, meets in one task.  Equal vectors are indexed once with their ``k + 1`` smallest
ids: no other of them can be in a result, since ties go to the smaller id.

Defined cases: vectors that are null, empty, zero, hold a null or non-finite value,
or differ in length from most others take no part; null ids take no part; ids that
repeat are candidates once for each distinct vector, and ask once for each; other
columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def fit_codebook(sample: np.ndarray, size: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's k-means in numpy; an empty cluster takes a random row."""
    rng = np.random.default_rng(seed)
    size = min(size, len(sample))
    centres = sample[rng.choice(len(sample), size, replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = nearest(sample, centres)
        counts = np.bincount(near, minlength=size)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        centres[~full] = sample[rng.choice(len(sample), int((~full).sum()))]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * (x @ centres.T), axis=1)


def passed(sums: np.ndarray, counts: np.ndarray, wanted: int, slots: int = 4096) -> np.ndarray:
    """Marks the entries of least sum, in order, until their counts reach ``wanted``.
    A histogram of the sums tells the slot in which that happens; only it is sorted."""
    low, width = sums.min(initial=np.inf), np.ptp(sums) if len(sums) else 0.0
    if 0 < width < np.inf:
        slot = ((sums - low) / width * (slots - 1)).astype(np.int32)
    else:  # all alike, or sums beyond what a double holds
        slot = np.zeros(len(sums), np.int32)
    upto = np.cumsum(np.bincount(slot, counts, minlength=slots))
    last = int(np.searchsorted(upto, wanted))
    out = slot < last
    at = np.flatnonzero(slot == last)
    at = at[np.argsort(sums[at], kind="stable")]
    out[at[: np.searchsorted((upto[last - 1] if last else 0) + np.cumsum(counts[at]), wanted) + 1]] = True
    return out


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells ``i * len(second) + j`` by ascending ``first[i] + second[j]`` until they
    hold ``wanted`` vectors; cells without any are left out."""
    held = np.flatnonzero(counts)
    sums = np.add.outer(first, second).ravel()[held]
    near = np.flatnonzero(passed(sums, counts[held], wanted))
    return held[near[np.argsort(sums[near], kind="stable")]].tolist()


def measured_share(sample: np.ndarray, books, k: int, target: float, probes: int = 200) -> float:
    """The least share of the sample that cells must hold, walked in order, for
    ``target`` of the true ``k`` nearest to be among them."""
    half, n = len(books[0][0]), len(sample)
    cell = nearest(sample[:, :half], books[0]) * len(books[1]) + nearest(sample[:, half:], books[1])
    counts = np.bincount(cell, minlength=len(books[0]) * len(books[1]))
    needed = []
    for q in sample[np.linspace(0, n - 1, min(probes, n)).astype(int)]:
        score = sample @ q
        top = np.argpartition(-score, min(k, n - 1))[: k + 1]
        order = walk(-(books[0] @ q[:half]), -(books[1] @ q[half:]), counts, n)
        before = np.zeros(len(counts), np.int64)
        before[order] = np.cumsum(counts[order]) - counts[order]
        needed.extend((before[cell[top]] + 1).tolist())
    return float(np.quantile(needed, target)) / n


def _matrix(column, dim: int, dtype=np.float64) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(-1, dim).astype(dtype)


def _assign(batches, books, dim: int):
    half = len(books[0][0])
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column("v"), dim)
        cell = nearest(x[:, :half], books[0]) * len(books[1]) + nearest(x[:, half:], books[1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])


def _probe(batches, books, counts: np.ndarray, dim: int, wanted: int, span: int):
    """A row for each query and unit it passes, with the bits of the cells passed there."""
    half = len(books[0][0])
    held = np.flatnonzero(counts)
    of_first, of_second = np.divmod(held, len(books[1]))
    n_units = -(-len(counts) // span)
    for batch in batches:
        if not batch.num_rows:
            continue
        q = _matrix(batch.column("v"), dim)
        first, second = -(q[:, :half] @ books[0].T), -(q[:, half:] @ books[1].T)
        rows, units, bits = [], [], []
        for i, (x, y) in enumerate(zip(first, second, strict=True)):
            marks = np.zeros(n_units * span, bool)
            marks[held] = passed(x[of_first] + y[of_second], counts[held], wanted)
            packed = np.packbits(marks.reshape(n_units, span), axis=1)
            met = np.flatnonzero(packed.any(1))
            rows.extend([i] * len(met))
            units.extend(met.tolist())
            bits.extend(mark.tobytes() for mark in packed[met])
            if len(rows) >= 20_000 or i == len(q) - 1:
                part = batch.take(pa.array(rows))
                columns = [part.column("q"), part.column("v"), pa.array(units, pa.int32()), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["q", "v", "unit", "bits"])
                rows, units, bits = [], [], []


def _best(parts: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, vector, score) arrays each query's rows that score no less than its
    k-th best: ties stay."""
    q, g, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((-score, q))
    q, g, score = q[order], g[order], score[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    sizes = np.diff(starts, append=len(q))
    least = score[starts + np.minimum(sizes, k) - 1]
    keep = score >= np.repeat(least, sizes)
    return q[keep], g[keep], score[keep]


def _score(batches, dim: int, k: int, held_rows: int = 400_000, together: int = 64):
    """Block pairs to each query's best distinct vectors.  The best so far are held over
    the blocks of a task, so what leaves it follows its queries, not its blocks; beyond
    ``held_rows`` they are sent on and a new list begins."""
    parts: list[tuple] = []
    held = 0
    for batch in batches:
        for row in range(batch.num_rows):
            qs = np.asarray(batch.column("qs")[row].values.field("q"))
            qv = np.asarray(batch.column("qs")[row].values.field("v").flatten(), np.float64).reshape(-1, dim)
            vs = np.asarray(batch.column("vs")[row].values.field("g"))
            vv = np.asarray(batch.column("vs")[row].values.field("v").flatten(), np.float64).reshape(-1, dim)
            cells = np.asarray(batch.column("vs")[row].values.field("at"))
            bits = batch.column("qs")[row].values.field("bits")
            marks = np.unpackbits(np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(len(qs), -1), axis=1).astype(bool)
            order = np.argsort(cells, kind="stable")
            cells, vs, vv = cells[order], vs[order], vv[order]
            rough = np.full((len(qs), len(vs)), -np.inf)
            starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
            # cells of a few vectors go together: one product for those who passed any, then only what each passed
            starts = starts[np.r_[True, np.diff(starts // together) > 0]]
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(cells)], strict=True):
                own = marks[:, cells[lo:hi]]
                who = np.flatnonzero(own.any(1))
                rough[who, lo:hi] = np.where(own[who], qv[who] @ vv[lo:hi].T, -np.inf)
            take = min(k, len(vs))
            edge = np.partition(rough, len(vs) - take, axis=1)[:, len(vs) - take]
            i, j = np.nonzero((rough >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None]) & (rough > -np.inf))
            if not len(i):
                continue
            score = (vv[j] * qv[i]).sum(1)  # one order of summation, wherever a vector lies
            parts.append((qs[i], vs[j], score))
            held += len(i)
            if held > held_rows:
                parts = [_best(parts, k)]
                held = len(parts[0][0])
                if held > held_rows // 2:
                    yield _scored(parts[0])
                    parts, held = [], 0
    if parts:
        yield _scored(_best(parts, k))


def _scored(columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["q", "g", "score"])


def search(
    vectors: DataFrame,
    is_query,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    codebook: int | None = None,
    share: float | None = None,
    target_recall: float = 0.93,
    sample_rows: int = 20_000,
    block: int = 256,
    unit_rows: int = 2048,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` largest inner products
    found for each row that ``is_query`` (a Column) marks, among all other rows.

    ``codebook``: centroids a half (by default sqrt(n), between 8 and 256).
    ``share``: the share of the vectors that the cells passed must hold; by default
    the least that reaches ``target_recall`` among the sample, where it is measured
    by brute force.  ``sample_rows`` bounds the rows that the codebooks are fitted and
    the share is measured on.  ``unit_rows``: about how many vectors cells are stored
    together for; ``block``: queries of a block, and a quarter of its vectors.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    kept_as = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    v = F.col(vector_col).cast(f"array<{kept_as}>")
    sane = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = vectors.filter(F.col(id_col).isNotNull() & sane & F.exists(v, lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("is_q")
    )
    top = valid.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = top["dim"]
    valid = valid.filter(F.size("v") == dim)
    byhash = Window.partitionBy("h", "v").orderBy("id")
    few = valid.select("id", "v", F.xxhash64("v").alias("h")).distinct()
    few = few.withColumn("nth", F.row_number().over(byhash)).filter(F.col("nth") <= k + 1)
    grouped = common.staged(
        few.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("g", F.monotonically_increasing_id()),
        "vectors",
    )
    n = grouped.count()
    sampled = grouped.filter(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, 1.2 * sample_rows / n)) + 1))
    sample = np.array([r.v for r in sampled.select("v").limit(sample_rows).collect()], np.float64).reshape(-1, dim)
    if not len(sample):
        sample = np.array([r.v for r in grouped.select("v").limit(sample_rows).collect()], np.float64).reshape(-1, dim)
    half = max(1, dim // 2)
    codebook = codebook or int(min(256, max(8, n**0.5)))
    books = [fit_codebook(sample[:, :half], codebook), fit_codebook(sample[:, half:], codebook) if dim > 1 else np.zeros((1, 0))]
    cells = len(books[0]) * len(books[1])
    rows_of_cells = -(-len(books[0]) // max(1, min(len(books[0]), n // unit_rows)))
    span = rows_of_cells * len(books[1])  # cells of a unit: some neighbouring first centroids with all second ones
    indexed = common.staged(
        grouped.select("g", "v", "ids").mapInArrow(
            lambda it: _assign(it, books, dim), f"g long, v array<{kept_as}>, ids array<long>, cell int"
        ),
        "cells",
    )
    sizes = indexed.groupBy("cell").count().collect()  # at most codebook squared rows
    counts = np.zeros(cells, np.int64)
    for r in sizes:
        counts[r["cell"]] = r["count"]

    wanted = int(np.ceil((share if share is not None else measured_share(sample, books, k, target_recall)) * n))
    wanted = max(wanted, min(n, k + 1))  # the walk meets as many vectors as a query must return, its own beside

    queries = valid.filter("is_q").select("id", "v", F.xxhash64("v").alias("h"))
    asked = queries.select("h", "v").distinct().join(grouped.select("h", "v", "g").hint("merge"), ["h", "v"]).select(F.col("g").alias("q"), "v")
    visits = common.staged(
        asked.mapInArrow(lambda it: _probe(it, books, counts, dim, wanted, span), f"q long, v array<{kept_as}>, unit int, bits binary"), "visits"
    )
    held = np.add.reduceat(counts, np.arange(0, cells, span))
    asked_of = {r["unit"]: r["count"] for r in visits.groupBy("unit").count().collect()}  # at most a unit a centroid
    cut = spark.createDataFrame(
        [(u, int(-(-held[u] // (4 * block))), -(-m // block)) for u, m in asked_of.items()] or [(0, 1, 1)], "unit int, vcut int, qcut int"
    )
    cut = F.broadcast(cut)  # one row a unit
    place = F.col("cell") - F.col("unit") * span
    vblocks = (
        indexed.withColumn("unit", F.floor(F.col("cell") / span).cast("int")).join(cut, "unit").withColumn("b", F.pmod(F.xxhash64("g"), "vcut"))
        .groupBy("unit", "b").agg(F.collect_list(F.struct("g", "v", place.alias("at"))).alias("vs"))
    )
    qblocks = (
        visits.join(cut, "unit").withColumn("c", F.pmod(F.xxhash64("q"), "qcut"))
        .groupBy("unit", "c").agg(F.collect_list(F.struct("q", "v", "bits")).alias("qs"))
    )
    met = common.staged(qblocks, "qblocks").join(common.staged(vblocks, "vblocks").hint("shuffle_hash"), "unit").select("qs", "vs")
    # a task holds its queries' best, so some dozens of block pairs a task keep the lists few
    pairs = sum(-(-int(held[u]) // (4 * block)) * -(-m // block) for u, m in asked_of.items())
    scored = met.coalesce(max(1, -(-pairs // 8))).mapInArrow(lambda it: _score(it, dim, k + 1), "q long, g long, score double")
    # a query's own row may fill a place, hence k + 1 distinct vectors
    best = scored.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("r") <= k + 1)
    members = best.join(indexed.select("g", "ids").hint("merge"), "g").select("q", "score", F.explode("ids").alias("vec_id"))
    first = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    listed = members.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).groupBy("q").agg(
        F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found")
    )
    asking = queries.select("id", "h", "v").distinct().join(grouped.select("h", "v", "g").hint("merge"), ["h", "v"]).select(
        F.col("id").alias("query_id"), F.col("g").alias("q")
    )
    own = asking.join(listed.hint("merge"), "q").select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("pos", "x")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )

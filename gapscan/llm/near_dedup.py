"""MinHash near-duplicate classes from DartMinHash signatures.

1. One pass over the whole texts gives each document the band keys of its signature
   and a 128-bit fingerprint of its shingle set.  Equal sets collapse to one
   representative.
2. In each band bucket every member is paired with the bucket's most central member
   (the one that meets most others over all its bands), one pair a row.  Pairs are
   verified on the exact shingle sets, and verified pairs make classes.
3. Buckets that still hold several classes are finished exactly: members outside a
   bucket's largest class are compared with every member of another class, block by
   block.  Most of a large group of near copies is one class by then.

A link is a pair of documents that share a band and whose Jaccard similarity is at
least ``threshold``; classes are the connected components of links.

Defined cases: null text is empty; a text without words is a class of its own; a
text of fewer words than a shingle is one shingle; null ids and repeated rows each
count as documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .dartminhash import band_keys, signatures
from .shingles import mix, shingle_batch, text_batches

_SIG = "id long, h long, words int, hi long, lo long, bands array<long>"


def _weights(counts: np.ndarray, weighting: str) -> np.ndarray:
    return counts.astype(np.float64) if weighting == "count" else np.ones(len(counts))


def _sign(batches, width: int, k: int, rows: int, weighting: str):
    for batch in batches:
        ids, hs = batch.column(0), batch.column(1)
        for start, texts in text_batches(batch.column(2)):
            n = len(texts)
            doc, hashes, counts = shingle_batch(texts, width)
            w = _weights(counts, weighting)
            keys = band_keys(signatures(doc, hashes, w, n, k), rows).view(np.int64)
            each = mix(hashes + (w * 1024).astype(np.uint64))
            bounds = np.searchsorted(doc, np.arange(n + 1))
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (each, mix(each))]
            hi, lo = ((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(start, n).cast(pa.int64()),
                    hs.slice(start, n),
                    pa.array(np.diff(bounds).astype(np.int32)),
                    pa.array(hi),
                    pa.array(lo),
                    pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * keys.shape[1], keys.ravel()).cast(pa.list_(pa.int64())),
                ],
                names=["id", "h", "words", "hi", "lo", "bands"],
            )


def _sets(batches, width: int, weighting: str):
    """Sorted 64-bit shingles and their counts, for the documents to verify."""
    for batch in batches:
        for start, texts in text_batches(batch.column(2)):
            doc, hashes, counts = shingle_batch(texts, width)
            offsets = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            columns = [batch.column(i).slice(start, len(texts)) for i in (0, 1)]
            columns.append(pa.ListArray.from_arrays(offsets, hashes.view(np.int64)))
            columns.append(pa.ListArray.from_arrays(offsets, _weights(counts, weighting).astype(np.float32)))
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "met", "s", "w"])


def jaccard(a: np.ndarray, aw: np.ndarray, b: np.ndarray, bw: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets of distinct hashes."""
    common_, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = float(np.minimum(aw[ia], bw[ib]).sum())
    total = float(aw.sum()) + float(bw.sum()) - both
    return both / total if total else 0.0


def _verify(batches, threshold: float):
    for batch in batches:
        columns = {n: batch.column(n) for n in ("u", "v")}
        lists = {n: (batch.column(n).offsets.to_numpy(), batch.column(n).values.to_numpy()) for n in ("us", "uw", "vs", "vw")}
        ok = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            parts = [x[o[i] : o[i + 1]] for o, x in (lists[n] for n in ("us", "uw", "vs", "vw"))]
            ok[i] = jaccard(*parts) >= threshold
        keep = pa.array(ok)
        yield pa.RecordBatch.from_arrays([columns["u"].filter(keep), columns["v"].filter(keep)], names=["u", "v"])


def _verify_blocks(batches, threshold: float):
    """Links between a block of a bucket's minority and a block of its members, one for
    each document and class met."""
    for batch in batches:
        out: tuple[list, list] = ([], [])
        for row in range(batch.num_rows):
            us, vs = batch.column("us")[row].values, batch.column("vs")[row].values
            ids, labels = vs.field("uid").to_numpy(), vs.field("label").to_numpy()
            hashes, weights, owner = _flat(vs)
            total = np.bincount(owner, weights, len(ids))
            own_hashes, own_weights, own = _flat(us)
            cuts = np.searchsorted(own, np.arange(len(us) + 1))
            for i, (uid, label) in enumerate(zip(us.field("uid").to_pylist(), us.field("label").to_pylist(), strict=True)):
                a, aw = own_hashes[cuts[i] : cuts[i + 1]], own_weights[cuts[i] : cuts[i + 1]]
                at = np.minimum(np.searchsorted(a, hashes), len(a) - 1)
                hit = a[at] == hashes
                both = np.bincount(owner[hit], np.minimum(aw[at[hit]], weights[hit]), len(ids))
                near = np.flatnonzero((both >= threshold * (aw.sum() + total - both)) & (labels != label))
                for j in near[np.unique(labels[near], return_index=True)[1]].tolist():
                    out[0].append(uid)
                    out[1].append(int(ids[j]))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["u", "v"])


def _flat(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, weights and owner of a list of sets, each set in the order of its hashes."""
    lists, weights = block.field("s"), block.field("w")
    owner = np.repeat(np.arange(len(block)), np.diff(lists.offsets.to_numpy()))
    return lists.flatten().to_numpy().view(np.uint64), weights.flatten().to_numpy().astype(np.float64), owner


def _unlike_neighbours(members: DataFrame, label: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links between members of one bucket that are still in different classes.  The
    bucket's largest class needs no comparison within itself; what is left is compared
    with every member, block by block, and only links leave a block."""
    labelled = members.join(label.select(F.col("node").alias("uid"), "label").hint("merge"), "uid", "left")
    labelled = common.staged(labelled.select("key", "uid", F.coalesce("label", "uid").alias("label")), "labelled")
    kinds = labelled.groupBy("key", "label").count().groupBy("key").agg(
        F.max_by("label", F.struct("count", "label")).alias("major"),
        F.count(F.lit(1)).alias("kinds"), F.sum("count").alias("m"), F.max("count").alias("most"),
    )
    open_ = common.staged(kinds.filter("kinds > 1").drop("kinds"), "open")
    inside = common.staged(labelled.join(open_.hint("shuffle_hash"), "key"), "inside")
    full = inside.join(sets.select("uid", "s", "w").hint("shuffle_hash"), "uid")
    packed = F.collect_list(F.struct("uid", "label", "s", "w"))
    cut = lambda n: F.pmod(F.xxhash64("uid"), F.ceil(n / block))
    few = common.staged(full.filter("label <> major").groupBy("key", cut(F.col("m") - F.col("most")).alias("c")).agg(packed.alias("us")), "few")
    all_ = common.staged(full.groupBy("key", cut(F.col("m")).alias("b")).agg(packed.alias("vs")), "all")
    met = few.join(all_.hint("shuffle_hash"), "key").select("us", "vs")
    links = common.staged(met.mapInArrow(lambda it: _verify_blocks(it, threshold), "u long, v long").distinct(), "links")
    common.discard(labelled, open_, inside, few, all_)
    return links


def near_duplicate_classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    width: int = 5,
    bands: int = 27,
    rows: int = 5,
    weighting: str = "binary",
    block: int = 64,
) -> DataFrame:
    """One row per document: id, ``class_id`` (the smallest id of its class),
    ``class_size``, ``kept`` (one document of each class) and ``text_hash``.

    ``weighting``: ``binary`` compares shingle sets, ``count`` multisets.  With 27
    bands of 5, a pair at similarity 0.8 shares no band once in 45,000.
    """
    spark = docs.sparkSession
    common.ship(spark)
    k = bands * rows
    slim = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("t")
    )
    signed = slim.mapInArrow(lambda it: _sign(it, width, k, rows, weighting), _SIG)
    signed = common.staged(signed.withColumn("uid", F.monotonically_increasing_id()), "signed")
    empty = F.col("words") == 0
    keyed = signed.select(
        "uid", "id", "h", "words", F.when(empty, F.col("uid")).otherwise(F.col("hi")).alias("hi"),
        F.when(empty, F.lit(-1)).otherwise(F.col("lo")).alias("lo"), "bands",
    )
    order = F.struct(F.col("id").isNull(), F.col("id").alias("id"), F.col("uid").alias("uid"))
    groups = common.staged(
        keyed.groupBy("words", "hi", "lo").agg(F.min("uid").alias("rep"), F.min(order).alias("best"), F.count(F.lit(1)).alias("n")),
        "groups",
    )
    reps = keyed.filter("words > 0").join(groups.select(F.col("rep").alias("uid")).hint("shuffle_hash"), "uid", "left_semi")
    reps = common.staged(reps.select("uid", "id", "h", "bands"), "reps")

    # members of buckets of two and more; how many others a member meets over all its bands
    rows_ = reps.select("uid", F.explode("bands").alias("key"))
    sizes = common.staged(rows_.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
    shared = rows_.join(sizes.hint("shuffle_hash"), "key").groupBy("uid").agg(F.collect_list("key").alias("keys"), F.sum("size").alias("score"))
    shared = common.staged(shared, "shared")
    members = shared.select("uid", "score", F.explode("keys").alias("key"))
    leaders = common.staged(members.groupBy("key").agg(F.max_by("uid", F.struct("score", "uid")).alias("leader")), "leaders")
    met = members.join(leaders.hint("shuffle_hash"), "key").groupBy("uid").agg(F.collect_set("leader").alias("met"))
    met = met.withColumn("met", F.array_remove("met", F.col("uid")))
    named = common.staged(reps.select("uid", "id", "h").join(met.hint("merge"), "uid"), "named")

    # only texts of members move: a table of bits, of bounded size, tells them
    some = slim.filter(common.bit_filter(named, "h")(F.col("h")))
    same = (some["h"] == named["h"]) & some["id"].eqNullSafe(named["id"])
    texts = some.join(named.hint("shuffle_hash"), same).select(named["uid"], named["met"], some["t"])
    sets = texts.mapInArrow(lambda it: _sets(it, width, weighting), "uid long, met array<long>, s array<long>, w array<float>")
    sets = common.staged(sets, "sets")
    if sets.count() > named.count():  # rows repeated with id and text: one of them
        sets = common.staged(sets.dropDuplicates(["uid"]), "sets")

    left = sets.select(F.col("uid").alias("u"), F.explode("met").alias("v"), F.col("s").alias("us"), F.col("w").alias("uw"))
    right = sets.select(F.col("uid").alias("v"), F.col("s").alias("vs"), F.col("w").alias("vw"))
    full = left.join(right.hint("shuffle_hash"), "v").select("u", "v", "us", "uw", "vs", "vw")
    links = common.staged(full.mapInArrow(lambda it: _verify(it, threshold), "u long, v long"), "links")
    label = connected_components(links)
    more = _unlike_neighbours(members.select("key", "uid"), label, sets, threshold, block)
    if more.head(1):
        label = connected_components(label.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(more))

    sized = groups.join(label.select(F.col("node").alias("rep"), "label").hint("merge"), "rep", "left").select(
        "words", "hi", "lo", "best", "n", F.coalesce("label", "rep").alias("label")
    )
    sized = common.staged(sized, "labels")
    classes = common.staged(sized.groupBy("label").agg(F.min("best").alias("first"), F.sum("n").alias("class_size")), "sums")
    full = common.staged(
        sized.select("words", "hi", "lo", "label").join(classes.hint("merge"), "label").drop("label"), "classes"
    )
    common.discard(groups, reps, sizes, shared, leaders, named, sets, links, more, sized, classes)
    return keyed.drop("bands").join(full.hint("merge"), ["words", "hi", "lo"]).select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("class_id"),
        "class_size",
        (F.col("uid") == F.col("first.uid")).alias("kept"),
        F.col("h").alias("text_hash"),
    )


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, one of each class, with all their columns.  Rows whose
    class is theirs alone are not shuffled."""
    found = near_duplicate_classes(docs, id_col=id_col, text_col=text_col, **options)
    found = common.staged(found.select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__key"), "kept", "class_size"), "found")
    shared = common.bit_filter(found.filter("class_size > 1"), "__key")
    rows = found.filter(shared(F.col("__key"))).groupBy("__id", "__key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("__copies"))
    kept = common.staged(rows.filter("kept").drop("kept"), "kept")
    common.discard(found)
    key = F.xxhash64(text_col)
    return docs.filter(~shared(key)).unionByName(common.keep_rows(docs.filter(shared(key)), kept, key, id_col))

"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. Every row is reduced where it is read to id, SHA-256 and a fingerprint of its
   normalised text.  Each partition is a sender: it sorts its distinct fingerprints,
   splits them by owner (a fingerprint range) and sends the gaps Golomb-Rice coded.
2. An owner decodes what its senders sent and returns one bitmap to each: which of
   its fingerprints some other sender holds too.
3. Fingerprints marked by a bitmap, or repeated within one sender, are suspects.  Rows
   that are none are done where they stand.  A table of bits of bounded size tells
   tasks which texts are suspects, so only those (and a few others) are shuffled:
   grouping by the text itself compares their bytes, and a hot text is collapsed to
   one row per task before that.

Defined cases: null text counts as empty; a null id loses to any other id; rows
repeated with the same id and text count in the group, and one of them is kept;
very long texts are compared whole; of equal largest ids one row is kept; an empty
table gives no rows; columns other than id and text are ignored by ``exact_dedup`` and
returned unchanged, whatever their names, by ``drop_exact_copies``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text_col: str = "text") -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(common.text_or_empty(text_col), UPPER, LOWER)


def rice_encode(values: np.ndarray, universe: int) -> tuple[int, bytes, bytes]:
    """Sorted distinct non-negative numbers below ``universe`` as gaps: the
    quotients unary, the remainders of ``k`` bits in a stream of their own."""
    n = len(values)
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    k = max(0, int(math.log2(max(1.0, 0.69 * universe / max(n, 1)))))
    ends = np.cumsum((gaps >> k) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if n else 0, np.uint8)
    unary[ends] = 1
    bits = ((gaps[:, None] >> np.arange(k)) & 1).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(bits.ravel()).tobytes()


def rice_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k).astype(np.int64)
    return np.cumsum((quotients << k) + bits @ (1 << np.arange(k, dtype=np.int64)) + 1) - 1


def _blobs(f: np.ndarray, sender: int, shift: int) -> pa.RecordBatch:
    """A sender's distinct fingerprints for each owner, and which of them it holds twice."""
    found, counts = np.unique(f, return_counts=True)
    owners, starts = np.unique(found >> shift, return_index=True)
    rows = []
    for owner, part, times in zip(owners.tolist(), np.split(found, starts[1:]), np.split(counts, starts[1:]), strict=True):
        k, unary, rest = rice_encode(part - (owner << shift), 1 << shift)
        rows.append((owner, sender, len(part), k, unary, rest, np.packbits(times > 1).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)


_SENT = pa.schema(
    [("owner", pa.int64()), ("sender", pa.int64()), ("n", pa.int64()), ("k", pa.int32()), ("unary", pa.binary()), ("rest", pa.binary()), ("twice", pa.binary())]
)


def _send(batches, shift: int, sender_rows: int):
    held, rows, chunk = [], 0, TaskContext.get().partitionId() << 24
    for batch in batches:
        held.append(batch.column(0).to_numpy())
        rows += batch.num_rows
        if rows >= sender_rows:
            yield _blobs(np.concatenate(held), chunk, shift)
            held, rows, chunk = [], 0, chunk + 1
    if rows:
        yield _blobs(np.concatenate(held), chunk, shift)


def _own(pdf: pd.DataFrame) -> pd.DataFrame:
    lists = [rice_decode(*x) for x in zip(pdf["n"], pdf["k"], pdf["unary"], pdf["rest"], strict=True)]
    found, counts = np.unique(np.concatenate(lists), return_counts=True)
    twice = found[counts > 1]
    bitmaps = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in lists]
    return pd.DataFrame({"sender": pdf["sender"], "owner": pdf["owner"], "bitmap": bitmaps})


def _mark(frames, shift: int):
    """A sender's suspects: those that the owner's bitmap or its own marks."""
    for pdf in frames:
        for r in pdf.itertuples():
            marks = np.unpackbits(np.frombuffer(r.bitmap, np.uint8) | np.frombuffer(r.twice, np.uint8))[: r.n].astype(bool)
            yield pd.DataFrame({"f": (r.owner << shift) + rice_decode(r.n, r.k, r.unary, r.rest)[marks]})


class Exchange:
    """What the exchange of ``docs`` gives: ``slim`` (id, sha, h of every row), and
    ``suspect``, a test on the normalised text's hash."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, spare_bits: int, sender_rows: int, owner_rows: int):
        spark = docs.sparkSession
        common.ship(spark)
        norm = normalised(text_col)
        self.slim = common.staged(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(norm, 256)).alias("sha"), F.xxhash64(norm).alias("h")), "slim")
        n, width = max(2, self.slim.count()), common.shuffle_width(spark)
        bits = min(62, math.ceil(math.log2(n)) + spare_bits)
        owner_bits = min(bits, math.ceil(math.log2(max(n / owner_rows, width, 1))))
        shift = bits - owner_bits
        short = F.shiftrightunsigned(F.col("h"), 64 - bits)
        kinds = "owner long, sender long, n long, k int, unary binary, rest binary, twice binary"
        sent = common.staged(self.slim.select(short.alias("f")).mapInArrow(lambda it: _send(it, shift, sender_rows), kinds), "sent")
        bitmaps = sent.groupBy("owner").applyInPandas(_own, "sender long, owner long, bitmap binary")
        back = sent.join(common.staged(bitmaps, "bitmaps").hint("shuffle_hash"), ["sender", "owner"])
        suspects = common.staged(back.mapInPandas(lambda it: _mark(it, shift), "f long"), "suspects")
        test = common.bit_filter(suspects, "f")
        self.suspect = lambda h: test(F.shiftrightunsigned(h, 64 - bits))

        texts = docs.select(F.col(id_col).alias("id"), norm.alias("norm"), F.xxhash64(norm).alias("h")).filter(self.suspect(F.col("h")))
        #: Equal texts, compared byte by byte: sha, keep_id, group_size (of at least 2).
        self.groups = common.staged(
            texts.groupBy("norm")
            .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .filter("group_size > 1")
            .select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"),
            "groups",
        )
        common.discard(sent, suspects)

    def among_suspects(self, salts: int) -> DataFrame:
        """One row per distinct (id, text) of the suspects; a hot text's rows are salted."""
        groups = self.groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = self.slim.filter(self.suspect(F.col("h"))).groupBy("id", "sha").agg(F.count(F.lit(1)).alias("copies"))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
        alone = F.col("group_size").isNull()
        return rows.join(groups.hint("shuffle_hash"), ["sha", "salt"], "left").select(
            "id",
            "sha",
            "copies",
            F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).alias("group_size"),
        )


def exact_groups(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    spare_bits: int = 10,
    sender_rows: int = 1_000_000,
    owner_rows: int = 2_000_000,
    salts: int = 16,
) -> DataFrame:
    """One row per distinct (id, text): id, ``sha256`` (binary), ``copies`` (rows
    that share both), ``keep_id`` and ``group_size``.

    ``spare_bits``: a unique text is a false suspect with chance 2**-spare_bits.
    ``sender_rows``/``owner_rows``: rows per sender and owner, which bound their
    memory.  ``salts``: over how many tasks the rows of one hot text are spread.
    """
    found = Exchange(docs, id_col, text_col, spare_bits, sender_rows, owner_rows)
    alone = found.slim.filter(~found.suspect(F.col("h"))).select(
        "id", "sha", F.lit(1).cast("long").alias("copies"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    both = alone.unionByName(found.among_suspects(salts))
    return both.select(F.col("id").alias(id_col), F.col("sha").alias("sha256"), "copies", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``.  Of equal texts the row with the largest id stays."""
    found = exact_groups(docs, id_col=id_col, text_col=text_col, **options)
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        id_col,
        "keep_id",
        "group_size",
        (F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
    )


def drop_exact_copies(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", spare_bits: int = 10,
    sender_rows: int = 1_000_000, owner_rows: int = 2_000_000, salts: int = 16,
) -> DataFrame:
    """The documents that stay, with all their columns.  Rows that are no suspects are
    not shuffled."""
    found = Exchange(docs, id_col, text_col, spare_bits, sender_rows, owner_rows)
    kept = common.staged(
        found.among_suspects(salts)
        .filter(F.col("id").eqNullSafe(F.col("keep_id")))
        .select(F.col("id").alias("__id"), F.col("sha").alias("__key"), F.col("copies").alias("__copies")),
        "kept",
    )
    common.discard(found.slim, found.groups)
    norm = normalised(text_col)
    suspect = found.suspect(F.xxhash64(norm))
    return docs.filter(~suspect).unionByName(common.keep_rows(docs.filter(suspect), kept, F.unhex(F.sha2(norm, 256)), id_col))

"""Hierarchical residual packing.

Every partition tokenises its documents, cuts those longer than a sequence, and
packs the pieces best-fit.  Nearly full bins are final; underfull bins become the
items of the next round, where fewer partitions pack them best-fit again, until
one partition has seen all that is left or a round no longer helps.  A bin is one
row that carries its members (at most ``capacity`` of them), so no round joins.

Tokenising and packing may be done apart: ``cut_documents`` reads texts where they
stand and gives counts and checksums, which ``pack_cuts`` packs, so that no text moves.

With a position column the packing follows that order: a partition holds a range of
positions, ``span`` consecutive documents are packed together, a round merges the
underfull bins of neighbouring ranges, and sequences are numbered by ``place``, the
mean position of their ids.

Defined cases: null text is empty; an empty text is one piece holding the closing
id alone; null and repeated ids are packed row by row; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import tokenizer

BIN_SCHEMA = (
    "finished boolean, used int, ids array<long>, piece array<int>, start array<long>, "
    "length array<int>, crc array<long>, at array<int>, place double"
)
_ARROW = pa.schema(
    [
        ("finished", pa.bool_()),
        ("used", pa.int32()),
        ("ids", pa.list_(pa.int64())),
        ("piece", pa.list_(pa.int32())),
        ("start", pa.list_(pa.int64())),
        ("length", pa.list_(pa.int32())),
        ("crc", pa.list_(pa.int64())),
        ("at", pa.list_(pa.int32())),
        ("place", pa.float64()),
    ]
)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing.  Open bins are kept by free space; a bit mask of the
    free spaces in use finds the tightest bin that still takes the item."""
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = defaultdict(list)
    mask = 0
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            where = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
            bins[where].append(item)
        else:
            free, where = capacity, len(bins)
            bins.append([item])
        left = free - size
        if left:
            by_free[left].append(where)
            mask |= 1 << left
    return bins


class _Rows:
    """Bins on their way out, as columns."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in _ARROW.names]

    def add(self, *row) -> None:
        for c, v in zip(self.columns, row, strict=True):
            c.append(v)

    def __len__(self) -> int:
        return len(self.columns[0])

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, _ARROW, strict=True)], schema=_ARROW)
        self.columns = [[] for _ in _ARROW.names]
        return out


def _pack_items(items: list[tuple], capacity: int, enough: int, rows: _Rows) -> None:
    """``items``: (used, ids, piece, start, length, crc, at, place), each already a bin."""
    for members in best_fit([x[0] for x in items], capacity):
        used, out, weighed = 0, ([], [], [], [], [], []), 0.0
        for i in members:
            size, ids, piece, start, length, crc, at, place = items[i]
            for have, more in zip(out, (ids, piece, start, length, crc, [a + used for a in at]), strict=True):
                have.extend(more)
            used += size
            weighed += size * place
        rows.add(used >= enough, used, *out, weighed / used)


def _cut(batches, path: str, capacity: int, closing: bytes):
    """Batches whose last column is the text, with its ids' number and the checksums of
    its pieces in its place."""
    encode = tokenizer(path).id_bytes
    wide = 4 * capacity
    for batch in batches:
        tokens, crcs = [], []
        for text in batch.column(batch.num_columns - 1):
            raw = encode(text.as_py() or "") + closing
            tokens.append(len(raw) // 4)
            crcs.append([zlib.crc32(raw[at : at + wide]) for at in range(0, len(raw), wide)])
        made = [pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "tokens", "crcs"])


def _local(batches, capacity: int, enough: int, held: int, span: int | None):
    """Batches of id, place, tokens and crcs."""
    rows, items, taken = _Rows(), [], 0
    for batch in batches:
        for doc, place, tokens, crcs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for k, crc in enumerate(crcs):
                at = k * capacity
                n = min(capacity, tokens - at)
                if n == capacity:
                    rows.add(True, n, [doc], [k], [at], [n], [crc], [0], place)
                else:
                    items.append((n, [doc], [k], [at], [n], [crc], [0], place))
            taken += 1
            if len(items) >= held or (span and taken >= span):
                _pack_items(items, capacity, enough, rows)
                items, taken = [], 0
        if len(rows) >= 4000:
            yield rows.take()
    _pack_items(items, capacity, enough, rows)
    yield rows.take()


def _again(batches, capacity: int, enough: int, held: int):
    rows, items = _Rows(), []
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in _ARROW.names[1:]]
        items.extend(zip(*columns, strict=True))
        if len(items) >= held:
            _pack_items(items, capacity, enough, rows)
            items = []
            yield rows.take()
    _pack_items(items, capacity, enough, rows)
    yield rows.take()


def cut_documents(
    docs: DataFrame, tokenizer_path: str, *, kept: tuple[str, ...] = ("doc_id",), text_col: str = "text", capacity: int = 2048, closing_id: int = 0
) -> DataFrame:
    """One row per document, written: the columns ``kept``, ``tokens`` (ids with the
    closing one) and ``crcs`` (checksum of each piece of ``capacity`` ids)."""
    common.ship(docs.sparkSession)
    closing = int(closing_id).to_bytes(4, "little")
    slim = docs.select(*kept, F.col(text_col).cast("string").alias("text"))
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "tokens long", "crcs array<long>"])
    return common.staged(slim.mapInArrow(lambda it: _cut(it, tokenizer_path, capacity, closing), schema), "cut")


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    closing_id: int = 0,
    position_col: str | None = None,
    **options,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``.  Options as in ``pack_cuts``."""
    if position_col:
        cuts = cut_documents(docs, tokenizer_path, kept=(id_col, position_col), text_col=text_col, capacity=capacity, closing_id=closing_id)
        return pack_cuts(cuts, id_col=id_col, capacity=capacity, position_col=position_col, **options)
    common.ship(docs.sparkSession)
    closing = int(closing_id).to_bytes(4, "little")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.lit(0.0).alias("place"), F.col(text_col).cast("string").alias("text"))
    return _packed(slim, lambda it: _cut(it, tokenizer_path, capacity, closing), id_col, capacity, **options)


def pack_cuts(cuts: DataFrame, *, id_col: str = "doc_id", capacity: int = 2048, position_col: str | None = None, **options) -> DataFrame:
    """Pack what ``cut_documents`` gave, at the same capacity; columns as ``pack_documents``.

    ``slack``: a bin lacking at most so many ids is final at once.  ``held``: the
    most items that a task packs together, which bounds its memory.  ``fan_in``:
    how many partitions of underfull bins are merged into one in a round.
    ``position_col``: numbers in whose order the sequences come; ``span``: documents
    of consecutive positions that are packed together first.
    """
    place = F.col(position_col).cast("double") if position_col else F.lit(0.0)
    slim = cuts.select(F.col(id_col).cast("long").alias("id"), place.alias("place"), "tokens", "crcs")
    return _packed(slim, iter, id_col, capacity, ordered=position_col is not None, **options)


def _packed(
    slim: DataFrame, read, id_col: str, capacity: int, *,
    ordered: bool = False, slack: int = 4, held: int = 50_000, fan_in: int = 8, max_rounds: int = 12, span: int = 1024,
) -> DataFrame:
    """``read`` turns batches of ``slim`` into batches of id, place, tokens and crcs."""
    spark = slim.sparkSession
    common.ship(spark)
    enough, most = capacity - slack, span if ordered else None

    def dealt(df: DataFrame, parts: int) -> DataFrame:
        if not ordered:
            return df.repartition(parts)
        return df.repartitionByRange(parts, "place").sortWithinPartitions("place")

    if ordered:
        slim = dealt(slim, common.shuffle_width(spark))
    bins = common.staged(slim.mapInArrow(lambda it: _local(read(it), capacity, enough, held, most), BIN_SCHEMA), "pack0")
    final, rest = [bins.filter("finished")], bins.filter("NOT finished")
    n, width = rest.count(), max(1, common.shuffle_width(spark) // fan_in)
    for level in range(1, max_rounds + 1):
        if n == 0:
            break
        least = -(-n // held)
        width = max(least, width)
        packed = common.staged(
            dealt(rest, width).mapInArrow(lambda it: _again(it, capacity, enough, held), BIN_SCHEMA), f"pack{level}"
        )
        final.append(packed.filter("finished"))
        rest = packed.filter("NOT finished")
        left = rest.count()
        if width == 1 or (width == least and left > 0.98 * n):
            break
        n, width = left, width // fan_in
    final.append(rest)
    whole = final[0]
    for part in final[1:]:
        whole = whole.unionByName(part)
    if ordered:
        whole = dealt(whole, common.shuffle_width(spark))
    numbered = whole.withColumn("sequence_id", F.monotonically_increasing_id()).select(  # before explode makes rows
        "sequence_id",
        F.explode(F.arrays_zip("ids", "piece", "start", "length", "crc", "at")).alias("m"),
    )
    return numbered.select(
        F.col("m.ids").alias(id_col),
        F.col("m.piece").alias("piece"),
        F.col("m.start").alias("start"),
        F.col("m.length").cast("long").alias("length"),
        F.col("m.crc").alias("ids_crc32"),
        "sequence_id",
        F.col("m.at").cast("long").alias("offset"),
    )

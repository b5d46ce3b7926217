"""Sharding by a permutation-filled lookup table.

Every shard orders the slots of a prime-sized table by a permutation of its own
(offset and skip from its name's hash).  Shards take turns, each claiming the next
slot of its order that is still free, until the table is full: shares differ by at
most one slot, and when a shard goes, few keys of the others move.  A row's slot is
its key's hash modulo the table size; the table, a fixed number of slots whatever
the data, is broadcast, so a placement is one look-up.

Defined cases: a null key is placed by the row's ``fallback`` columns (here the
text), so that rows without a key do not gather on one shard; equal keys share a
shard; an empty table gives no rows; other columns are kept, but for any that bear
the names of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
SLOTS = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> list[int]:
    """The index of the shard that holds each slot.  A shard of weight w claims w slots
    a turn."""
    if not is_prime(slots) or not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("the table needs a prime size, and distinct shards, no more than slots")
    orders = []
    for name in shards:
        digest = hashlib.blake2b(name.encode(), digest_size=16).digest()
        orders.append((int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1))
    turns = [i for i in range(len(shards)) for _ in range(weights[i] if weights else 1)]
    table, reached, left = [-1] * slots, [0] * len(shards), slots
    while left:
        for i in turns:
            offset, skip = orders[i]
            while True:
                slot = (offset + reached[i] * skip) % slots
                reached[i] += 1
                if table[slot] < 0:
                    break
            table[slot] = i
            left -= 1
            if not left:
                break
    return table


def table_frame(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> DataFrame:
    table = fill_table(shards, slots, weights)
    return spark.createDataFrame([(s, i, shards[i]) for s, i in enumerate(table)], "slot int, shard int, shard_name string")


def key_hash(keys: Sequence[str], fallback: Sequence[str] = ()) -> Column:
    """The first 32 bits of the key's MD5 as a number; a key that is null in every
    column is replaced by the fallback columns."""
    written = lambda cols: F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols])
    key = written(keys)
    if fallback:
        known = F.lit(False)
        for c in keys:
            known = known | F.col(c).isNotNull()
        key = F.when(known, key).otherwise(written(fallback))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def place(
    rows: DataFrame, keys: Sequence[str], *, shards: Sequence[str] = SHARDS, slots: int = SLOTS,
    weights: Sequence[int] | None = None, fallback: Sequence[str] = (),
) -> DataFrame:
    """``rows`` with ``slot``, ``shard`` and ``shard_name``, without a shuffle."""
    common.ship(rows.sparkSession)
    table = table_frame(rows.sparkSession, shards, slots, weights)
    slot = (key_hash(keys, fallback) % slots).cast("int")
    rest = [c for c in rows.columns if c not in table.columns]  # columns of these names are replaced
    placed = rows.select(*rest, slot.alias("slot"))
    return placed.join(F.broadcast(table), "slot").select(*placed.columns, "shard", "shard_name")


def write_shards(rows: DataFrame, keys: Sequence[str], path: str, **options) -> None:
    """Write the rows to one folder for each shard.  Rows of a shard are spread over
    tasks by their hash, so a heavy shard is several files, not one task."""
    placed = place(rows, keys, **options)
    placed.write.partitionBy("shard_name").mode("overwrite").parquet(path)

import hashlib
from collections import Counter

import pytest

from gapscan.llm.sharding import SHARDS, SLOTS, fill_table, place, write_shards


def test_shares_are_even_and_few_keys_move():
    table = fill_table(SHARDS)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = fill_table(SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != len(SHARDS) - 1)
    assert moved < 0.05 * SLOTS
    weighted = Counter(fill_table(["a", "b"], 1009, [3, 1]))
    assert abs(weighted[0] - 3 * weighted[1]) <= 4
    with pytest.raises(ValueError):
        fill_table(["a"], 10)


def claimed(shards, slots):
    """The claim loop, plainly: each shard's whole order first, then turn by turn the
    first slot of its order that nobody holds."""
    orders = []
    for name in shards:
        raw = hashlib.blake2b(name.encode(), digest_size=16).digest()
        start, step = (int.from_bytes(raw[at : at + 8], "big") for at in (0, 8))
        orders.append(iter([(start % slots + k * (step % (slots - 1) + 1)) % slots for k in range(slots)]))
    holder = {}
    while len(holder) < slots:
        for i, order in enumerate(orders):
            free = next((s for s in order if s not in holder), None)
            if free is not None:
                holder[free] = i
    return [holder[s] for s in range(slots)]


def test_place_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    table = claimed(SHARDS, SLOTS)
    assert fill_table(SHARDS) == table
    out = place(docs, ["doc_id"], fallback=["text"])
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) % SLOTS
        assert (r.slot, r.shard, r.shard_name) == (slot, table[slot], SHARDS[table[slot]])
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    write_shards(docs, ["doc_id"], str(tmp_path / "out"), fallback=["text"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_edges(spark):
    rows = [(None, f"t{i}", "x") for i in range(50)] + [(1, "a", "y"), (1, "b" * 2_000_000, "y"), (2, None, None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = place(docs, ["doc_id"], fallback=["text"]).collect()
    assert len(out) == 54 and len({r.shard for r in out if r.doc_id is None}) > 10
    assert len({r.shard for r in out if r.doc_id == 1}) == 1
    assert place(docs.limit(0), ["doc_id"]).count() == 0

"""Streams whose events come out of order over many batches, late, or not at all."""

import random

import pytest
from pyspark.sql import functions as F

from gapscan.operators import telemetry as T
from gapscan.streaming import streams as X


EPOCH = 10**6  # a watermark begins at 0: what is not later is late


def feed(spark, path, rows, schema, batches):
    """``rows`` in files, one a batch, in the order given, their seconds from ``EPOCH`` on."""
    size = -(-len(rows) // batches)
    rows = [(*r[:-1], r[-1] + EPOCH) for r in rows]
    for i in range(0, len(rows), size):
        df = spark.createDataFrame(rows[i : i + size], schema).withColumn("ts", F.timestamp_seconds("sec"))
        df.coalesce(1).write.mode("append").parquet(path)
    return X.follow(spark, df, path, 1)


def shuffled(rows, within, seed=1):
    """Rows out of order, none later than ``within`` seconds behind the latest before it."""
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: r[-1] + rng.uniform(0, within))


@pytest.fixture(scope="module", autouse=True)
def narrow(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_target_states_over_ten_batches(spark, tmp_path):
    rng = random.Random(3)
    kinds = ["GENERATED", "REPAIR_REQUESTED", "REPAIRED", "TEST_FAILED", "PASSED"]
    rows = [("r", f"t{rng.randrange(6)}", i, rng.choices(kinds, [4, 4, 4, 4, 1])[0], 60 * rng.randrange(0, 400)) for i in range(160)]
    late = ("r", "end", 999, "GENERATED", 10**7)
    schema = "run_id string, target_id string, seq long, status string, sec long"
    stream = feed(spark, f"{tmp_path}/in", [*shuffled(rows, 1800), late], schema, 10)
    out = X.latest(X.run(X.stream_target_state(stream, "1 hour"), f"{tmp_path}/out", mode="update"), ["run_id", "target_id"], "n").drop("n")
    want = T.current_states(spark.createDataFrame(rows, schema).select("run_id", "target_id", "seq", "sec", "status"))
    assert sorted(map(tuple, out.collect())) == sorted((r.run_id, r.target_id, r.status, r.repair_rounds) for r in want.collect())


def test_state_of_ended_targets_is_dropped(spark, tmp_path):
    """Beyond its time an ended target begins anew; one that never ended goes on."""
    day = 86400
    rows = [("r", "a", 1, "REPAIR_REQUESTED", 0), ("r", "b", 2, "REPAIR_REQUESTED", 0), ("r", "a", 3, "PASSED", 60), ("r", "x", 4, "GENERATED", 9 * day),
            ("r", "x", 5, "GENERATED", 18 * day), ("r", "a", 6, "REPAIR_REQUESTED", 19 * day), ("r", "b", 7, "REPAIR_REQUESTED", 19 * day), ("r", "x", 8, "GENERATED", 99 * day)]
    stream = feed(spark, f"{tmp_path}/in", rows, "run_id string, target_id string, seq long, status string, sec long", len(rows))
    out = X.run(X.stream_target_state(stream, "1 hour", keep_ended_days=7), f"{tmp_path}/out", mode="update").collect()
    assert {("a", "PASSED", 1, 2), ("a", "REPAIR_REQUESTED", 1, 1), ("b", "REPAIR_REQUESTED", 2, 2)} <= {tuple(r)[1:] for r in out}


def test_stalls_over_ten_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"r{k}", i, rng.choice([0, 0, 1, None]), rng.choice([0, 0, None]), rng.random() < 0.4, 600 * i) for k in range(3) for i in range(40)]
    schema = "run_id string, cycle long, lines_delta long, branches_delta long, compile_failed boolean, sec long"
    stream = feed(spark, f"{tmp_path}/in", [*shuffled(rows, 3600), ("end", 1, 0, 0, False, 10**8)], schema, 10)
    out = X.run(X.stream_stall(stream, delay="2 hours"), f"{tmp_path}/out").select("run_id", "cycle", "stall_streak", "stalled").collect()
    want = T.stall_streak(spark.createDataFrame(rows, schema).drop("sec")).select("run_id", "cycle", "stall_streak", "stalled").collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, want))


def test_budget_alerts_a_silent_run_but_no_paused_one(spark, tmp_path):
    rows = [
        ("silent", 1, "tick", 0), ("silent", 2, "tick", 30), ("paused", 3, "tick", 0), ("paused", 4, "pause", 500), ("resumed", 5, "tick", 0), ("resumed", 6, "pause", 100),
        ("resumed", 7, "resume", 1100), ("busy", 8, "tick", 0), *[("busy", 10 + i, "cycle", 10 + i) for i in range(25)], ("late", 50, "tick", 0), ("late", 51, "tick", 5000), ("end", 99, "tick", 10**6),
    ]
    stream = feed(spark, f"{tmp_path}/in", rows, "run_id string, seq long, kind string, sec long", 5)
    out = X.run(X.stream_budget(stream, delay="3 hours"), f"{tmp_path}/out").withColumn("sec", F.col("sec") - EPOCH).collect()
    assert sorted(map(tuple, out)) == [("busy", 30, 30, 21, "cycles"), ("late", 601, 601, 0, "minutes"), ("resumed", 1601, 601, 0, "minutes"), ("silent", 601, 601, 0, "minutes")]


def test_sliding_windows_drop_what_is_later_than_the_watermark(spark, tmp_path):
    rows = [("r", "a", 5, 1, 100), ("r", "a", 7, 1, 4000), ("r", "a", 1, 1, 200), ("r", "a", 9, 1, 90_000), ("r", "end", 0, 0, 90_001), ("r", "a", 100, 1, 300), ("r", "end", 0, 0, 10**6)]
    schema = "run_id string, role string, tokens long, micro_usd long, sec long"
    stream = feed(spark, f"{tmp_path}/in", rows, schema, len(rows))
    out = X.run(X.stream_cost(stream, "2 hours", "1 hour", "2 hours"), f"{tmp_path}/out").filter("role = 'a'")
    got = {int(r.window_start.timestamp()): (r.tokens, r.n) for r in out.collect()}
    want: dict = {}
    for _, _, tokens, _, sec in rows[:4]:  # the row of 100 tokens came a day late
        for start in {(sec + EPOCH) // 3600 * 3600 - back for back in (0, 3600)}:
            held = want.get(start, (0, 0))
            want[start] = (held[0] + tokens, held[1] + 1)
    assert got == want
